"""Phrase mining with weighted acyclic automata.

Every task builds, for each range of first words, the minimal acyclic automaton of
the phrases it has seen, from the sorted phrases, registering each state when its
continuations are: a path spells a language and up to three words, and the weight of
the state it ends in is the count. Automata of one range meet in one task, which reads
their paths in order, sums equal ones and builds the union the same way. A candidate's first part is a
state on its own path; its rest is looked up by composing the sorted requests
with the union automaton of the range that the rest starts in.

Only phrases that may reach ``MIN_COUNT`` enter an automaton: a pass before counts
40-bit images (more with more text) of all phrases, dealt by image, and each task
answers with the cells of one bit map whose images reach the count. The map is
sent to all executors and has at most ``MAX_CELLS`` bits (32 MB); when it fills up,
more rare phrases enter the automata, whose counts are exact either way.

Scores use decimal arithmetic without rounding, up to counts of 10^15.

Defined cases. A null or empty text has no words and a null lang is ``und``; a lang
without words has no rows. Repeated rows count like any others. Ties are settled
by count, then phrase in UTF-8 byte order. An empty table gives an empty result.
Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import column, partitions, stored
from .suffix_dedup import packed, unpacked

MIN_COUNT = 10
TOP = 2000
SHADOWED = 50  # per cent of a phrase's count that a longer one must reach to drop it
MAX_WORDS = 3
CHUNK = 2 << 20  # bytes of text at a time
HELD = 1 << 20  # phrases a task holds before it sends them
MAX_CELLS = 1 << 28
PER_RANGE = 16 << 20  # bytes of text for each range of first words
UNKNOWN = "und"

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[32, 9]] = 1
_KIND[list(_BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- automata ----------------------------------------------------------------

class Automaton:
    """A minimal acyclic automaton with weighted states, in flat arrays.

    Arcs of a state lie together in the order of their labels; ``labels`` are in ascending
    order, and the last state is the root. No two states but the root are equal in
    weight and arcs.
    """

    def __init__(self, labels: list[str], weight: np.ndarray, first: np.ndarray, label: np.ndarray, target: np.ndarray):
        self.labels, self.weight, self.first, self.label, self.target = labels, weight, first, label, target

    @classmethod
    def from_table(cls, labels: list[str], ids: np.ndarray, weights: np.ndarray) -> "Automaton":
        """From sorted distinct paths, a row each: numbers of labels, -1 beyond the end.

        States are registered from the ends of the paths to the root: those of a level are
        prefixes of one length, whose arcs lead to states that are registered already.
        """
        n, depth = ids.shape
        length = (ids >= 0).sum(axis=1)
        changed = np.ones((n, depth), bool)
        changed[1:] = np.logical_or.accumulate(ids[1:] != ids[:-1], axis=1)
        ends: dict[int, int] = {}  # states without arcs, by weight
        known: dict[tuple, int] = {}
        weight, sizes, label, target, count = [], [], [], [], 0
        below, state_below = np.empty(0, np.int64), np.empty(0, np.int32)
        for d in range(depth, -1, -1):
            starts = np.flatnonzero(changed[:, d - 1] & (length >= d)) if d else np.zeros(1, np.int64)
            own = np.where(length[starts] == d, weights[starts], 0) if n else np.zeros(1, np.int64)
            arcs_label, arcs_target = ids[below, d].astype(np.int32) if d < depth else np.empty(0, np.int32), state_below
            arcs = np.bincount(np.searchsorted(starts, below, "right") - 1, minlength=len(starts)) if len(below) else np.zeros(len(starts), np.int64)
            upto = np.r_[0, np.cumsum(arcs)]
            state = np.empty(len(starts), np.int32)
            end = np.flatnonzero(arcs == 0) if d else np.empty(0, np.int64)
            values, place = np.unique(own[end], return_inverse=True)
            for v in values.tolist():
                if v not in ends:
                    ends[v], count = count, count + 1
                    weight.append(v)
                    sizes.append(0)
            state[end] = np.array([ends[v] for v in values.tolist()], np.int32)[place]
            for i in (np.flatnonzero(arcs) if d else np.zeros(1, np.int64)).tolist():
                x, y, w = upto[i], upto[i + 1], int(own[i])
                key = (w, arcs_label[x:y].tobytes(), arcs_target[x:y].tobytes())
                found = known.get(key) if d else None
                if found is None:
                    found, known[key], count = count, count, count + 1
                    weight.append(w)
                    sizes.append(int(y - x))
                    label.append(arcs_label[x:y])
                    target.append(arcs_target[x:y])
                state[i] = found
            below, state_below = starts, state
        none = [np.empty(0, np.int32)]
        return cls(labels, np.array(weight, np.int64), np.r_[0, np.cumsum(sizes)], np.concatenate(label or none), np.concatenate(target or none))

    @classmethod
    def build(cls, items: Iterable[tuple[tuple[str, ...], int]]) -> "Automaton":
        """From (path, weight) in ascending order; weights of equal paths are summed."""
        paths, weights = [], []
        for path, w in items:
            if paths and paths[-1] == path:
                weights[-1] += w
            else:
                paths.append(path)
                weights.append(w)
        labels = sorted({x for path in paths for x in path})
        number = {x: i for i, x in enumerate(labels)}
        ids = np.full((len(paths), max(map(len, paths), default=0)), -1, np.int32)
        for i, path in enumerate(paths):
            ids[i, :len(path)] = [number[x] for x in path]
        return cls.from_table(labels, ids, np.array(weights, np.int64))

    @classmethod
    def union(cls, automata: list["Automaton"]) -> "Automaton":
        """The automaton of all paths, with the sums of their weights."""
        labels = sorted(set().union(*(a.labels for a in automata)))
        number = {x: i for i, x in enumerate(labels)}
        tables = []
        for a in automata:
            ids, weights = a.table()
            own = np.array([number[x] for x in a.labels] + [-1], np.int32)
            tables.append((own[ids], weights[np.arange(len(ids)), (ids >= 0).sum(axis=1)]))
        depth = max(ids.shape[1] for ids, _ in tables)
        ids = np.concatenate([np.pad(ids, ((0, 0), (0, depth - ids.shape[1])), constant_values=-1) for ids, _ in tables])
        return cls.from_table(labels, *table_of(ids, np.concatenate([w for _, w in tables])))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths with a weight, in ascending order, and the weights of the states on each, root first."""
        state, ids, weights = np.array([len(self.weight) - 1]), np.empty((1, 0), np.int32), self.weight[-1:].reshape(1, 1)
        levels = []
        while len(state):
            kept = weights[:, -1] > 0
            levels.append((ids[kept], weights[kept]))
            size = self.first[state + 1] - self.first[state]
            ends = np.cumsum(size)
            arc = np.arange(size.sum()) + np.repeat(self.first[state] - (ends - size), size)
            of = np.repeat(np.arange(len(state)), size)
            state = self.target[arc].astype(np.int64)
            ids = np.concatenate([ids[of], self.label[arc].reshape(-1, 1)], axis=1)
            weights = np.concatenate([weights[of], self.weight[state].reshape(-1, 1)], axis=1)
        depth = max((x.shape[1] for x, _ in levels if len(x)), default=0)
        levels = [(x, w) for x, w in levels if x.shape[1] <= depth]
        ids = np.concatenate([np.pad(x, ((0, 0), (0, depth - x.shape[1])), constant_values=-1) for x, _ in levels])
        weights = np.concatenate([np.pad(w, ((0, 0), (0, depth + 1 - w.shape[1]))) for _, w in levels])
        order = np.lexsort(ids.T[::-1]) if depth else np.arange(len(ids))
        return ids[order], weights[order]

    def paths(self) -> Iterator[tuple[tuple[str, ...], int]]:
        """All (path, weight) with a weight, in ascending order."""
        ids, weights = self.table()
        for row, w, n in zip(ids.tolist(), weights.tolist(), (ids >= 0).sum(axis=1).tolist()):
            yield tuple(self.labels[k] for k in row[:n]), w[n]

    def compose(self, other: "Automaton") -> Iterator[tuple[tuple[str, ...], int]]:
        """(path, weight here) for all paths of ``other`` that are paths here, level by level."""
        ids, _ = other.table()
        number = {x: i for i, x in enumerate(self.labels)}
        own = np.array([number.get(x, -2) for x in other.labels] + [-1], np.int64)[ids]
        length = (ids >= 0).sum(axis=1)
        states = np.repeat(np.arange(len(self.weight)), np.diff(self.first))
        arcs = states * len(self.labels) + self.label  # in ascending order
        at, state = np.arange(len(ids)), np.full(len(ids), len(self.weight) - 1)
        for d in range(ids.shape[1] + 1):
            for i in at[(length[at] == d) & (self.weight[state] > 0)].tolist():
                yield tuple(other.labels[k] for k in ids[i, :d]), int(self.weight[state[np.searchsorted(at, i)]])
            go = length[at] > d
            at, state = at[go], state[go]
            if not len(at) or not len(arcs):
                return
            wanted = state * len(self.labels) + own[at, d]
            slot = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            hit = (arcs[slot] == wanted) & (own[at, d] >= 0)
            at, state = at[hit], self.target[slot[hit]].astype(np.int64)

    @property
    def states(self) -> list[tuple]:
        """(weight, ((label, target), ...)) of each state."""
        arcs = list(zip((self.labels[k] for k in self.label.tolist()), self.target.tolist()))
        return [(w, tuple(arcs[s:e])) for w, s, e in zip(self.weight.tolist(), self.first[:-1].tolist(), self.first[1:].tolist())]

    def to_bytes(self) -> bytes:
        raw = [x.encode() for x in self.labels]
        out = []
        for block in ([len(r) for r in raw], self.weight, np.diff(self.first), self.label, self.target):
            data, width = packed(np.asarray(block).astype(np.uint64))
            out += [np.array([len(block), width], "<u8").tobytes(), data]
        return b"".join(out + raw)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Automaton":
        at, blocks = 0, []
        for _ in range(5):
            n, width = np.frombuffer(data, "<u8", 2, at).tolist()
            blocks.append(unpacked(data[at + 16:at + 16 + n * width], width).astype(np.int64))
            at += 16 + n * width
        ends = np.cumsum(blocks[0]) + at
        labels = [data[e - n:e].decode() for e, n in zip(ends.tolist(), blocks[0].tolist())]
        return cls(labels, blocks[1], np.r_[0, np.cumsum(blocks[2])], blocks[3].astype(np.int32), blocks[4].astype(np.int32))


def table_of(ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in ascending order, equal ones as one with the sum of their weights."""
    order = np.lexsort(ids.T[::-1]) if ids.shape[1] else np.arange(len(ids))
    ids, weights = ids[order], weights[order]
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]) if len(ids) else np.empty(0, np.int64)
    return ids[starts], np.add.reduceat(weights, starts) if len(starts) else weights


# --- words and images --------------------------------------------------------

def mix(a: np.ndarray, b) -> np.ndarray:
    out = (a ^ b) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def word_images(body: bytes, starts: np.ndarray, lengths: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """64-bit images of words of any length, eight bytes at a time; ``body`` ends in eight spare bytes.

    Seeds are 64-bit numbers without small differences, since lengths are crossed with them.
    """
    words = np.ndarray((len(body) - 7,), "<u8", buffer=body, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    out, at, step = mix(seeds, lengths.astype(np.uint64)), np.arange(len(starts)), 0
    while len(at):
        left = lengths[at] - step
        out[at] = mix(out[at], words[starts[at] + step] & masks[np.minimum(left, 8)])
        at, step = at[left > 8], step + 8
    return out


def language_image(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


class Chunk:
    """The words of some texts: their images and which of them follow each other in a piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n" * 8, np.uint8)
        kind = _KIND[raw]
        self.body = _LOWER[raw].tobytes()
        inside = np.r_[False, kind == 0, False]
        turns = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
        self.starts, self.lengths = turns[:, 0], turns[:, 1] - turns[:, 0]
        document = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts]), self.starts, "right") - 1
        self.langs = sorted(set(langs))
        of = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([of[x] for x in langs], np.int64)[document]
        seeds = np.array([language_image(x) for x in self.langs], np.uint64)
        self.words = word_images(self.body, self.starts, self.lengths, seeds[self.lang])
        breaks = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        self.two = breaks[1:] == breaks[:-1]
        self.three = self.two[1:] & self.two[:-1]

    def grams(self):
        """[(place of the first word, image)] of the phrases of one, two and three words."""
        w = self.words
        two, three = np.flatnonzero(self.two), np.flatnonzero(self.three)
        pairs = mix(mix(w[:-1], np.uint64(2)), w[1:])
        return [(np.arange(len(w)), w), (two, pairs[two]), (three, mix(mix(pairs[three], np.uint64(3)), w[three + 2]))]

    def text(self, i: int) -> str:
        return self.body[self.starts[i]:self.starts[i] + self.lengths[i]].decode()


def chunks(batches) -> Iterator[Chunk]:
    texts, langs, size = [], [], 0
    for b in batches:
        raw = b.column(1).cast(pa.large_string()).cast(pa.large_binary())
        for lang, text in zip(b.column(0).to_pylist(), raw):
            text = text.as_py()
            if not text:
                continue
            texts.append(text)
            langs.append(UNKNOWN if lang is None else lang)
            size += len(text)
            if size >= CHUNK:
                yield Chunk(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Chunk(texts, langs)


def summed(keys: np.ndarray, counts: np.ndarray | None = None):
    """(distinct keys in order, sums of their counts, place of the first of each)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    if counts is None:
        counts = np.ones(len(keys), np.int64)
    sums = np.add.reduceat(counts[order], starts) if len(starts) else np.empty(0, np.int64)
    return keys[starts], sums, order[starts]


# --- which phrases may reach the count ---------------------------------------

def _images(buckets: int, key_bits: int, min_count: int):
    """Images of all phrases with their counts, as pieces by bucket: (bucket, widths, keys, counts)."""
    shift, top = np.uint64(64 - key_bits), np.uint64(key_bits - buckets.bit_length() + 1)

    def sent(held):
        keys, counts, _ = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]).astype(np.int64))
        counts = np.minimum(counts, min_count).astype(np.uint64)
        bounds = np.searchsorted((keys >> top).astype(np.int64), np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(bounds)):
            own = slice(bounds[k], bounds[k + 1])
            raw, width = packed(np.diff(keys[own], prepend=keys.dtype.type(int(k) << int(top))))
            more, wide = packed(counts[own])
            rows.append((int(k), width | wide << 8, raw, more))
        for i in range(0, len(rows), 1024):
            part = list(zip(*rows[i:i + 1024]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.binary()), pa.array(part[3], pa.binary())], ["bucket", "widths", "keys", "counts"])

    def run(batches):
        held, size = [], 0
        for chunk in chunks(batches):
            for _, images in chunk.grams():
                keys, counts, _ = summed(images >> shift)
                held.append((keys, np.minimum(counts, min_count).astype(np.uint8)))
                size += len(keys)
            if size > 2 * HELD:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    return run


def _frequent(buckets: int, key_bits: int, cells: int, min_count: int):
    """Sum one bucket at a time; the bits of its stretch of the map."""
    top = key_bits - buckets.bit_length() + 1
    down = np.uint64(key_bits - cells.bit_length() + 1)
    per_bucket = cells // buckets

    def bits(bucket, held):
        keys = np.concatenate([np.cumsum(unpacked(k, w & 255), dtype=np.uint64) for w, k, _ in held]) + np.uint64(bucket << top)
        keys, counts, _ = summed(keys, np.concatenate([unpacked(c, w >> 8) for w, _, c in held]).astype(np.int64))
        out = np.zeros(per_bucket, bool)
        out[((keys[counts >= min_count] >> down) - np.uint64(bucket * per_bucket)).astype(np.int64)] = True
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], ["bucket", "bits"])

    def run(batches):
        now, held = None, []
        for b in batches:
            for bucket, *piece in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now and held:
                    yield bits(now, held)
                    held = []
                now = bucket
                held.append(piece)
        if held:
            yield bits(now, held)

    return run


def frequent_cells(docs: DataFrame, size: int, min_count: int) -> tuple[bytes, int]:
    """The bit map of (lang, text) rows and its number of cells, a power of two."""
    grams = max(1, size // 2)  # three phrases for each word of some six bytes
    cells = min(MAX_CELLS, max(1 << 16, 1 << (grams - 1).bit_length()))
    buckets = min(1 << 13, 1 << (grams // (1 << 22)).bit_length())
    key_bits = min(64, max(40, 8 * ((grams.bit_length() + 11 + 7) // 8)))
    sent = docs.mapInArrow(_images(buckets, key_bits, min_count), "bucket int, widths int, keys binary, counts binary")
    dealt = sent.repartition(max(buckets, partitions(docs.sparkSession)), "bucket").sortWithinPartitions("bucket")
    out = bytearray(cells // 8)
    per_bucket = cells // buckets // 8
    for bucket, bits in dealt.mapInArrow(_frequent(buckets, key_bits, cells, min_count), "bucket int, bits binary").toLocalIterator():
        out[bucket * per_bucket:(bucket + 1) * per_bucket] = bits
    return bytes(out), cells


# --- counts ------------------------------------------------------------------

def _automata(bit_map, cells: int, ranges: int):
    """One automaton per range of first words, for every ``HELD`` phrases of a task."""
    down = np.uint64(64 - cells.bit_length() + 1)

    def range_of(images):
        return (images >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64) if ranges > 1 else np.zeros(len(images), np.int64)

    def sent(held, texts, totals):
        images, words = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        counts, lang = (np.concatenate([h[k] for h in held]) for k in (2, 3))
        _, sums, first = summed(images, counts)
        words, lang = words[first], lang[first]
        labels = sorted(set(texts.values()).union(totals))
        number = {x: i for i, x in enumerate(labels)}
        names = np.array(sorted(texts), np.uint64)
        spelled = np.array([number[texts[int(i)]] for i in names] + [-1], np.int32)
        at = np.where(words == 0, len(names), np.searchsorted(names, words))
        ids = np.concatenate([np.array([number.get(x, 0) for x in by_number] + [0], np.int32)[lang].reshape(-1, 1), spelled[at]], axis=1)
        # the number of words of each language is the weight of the state after its label
        whole = np.full((len(totals), MAX_WORDS + 1), -1, np.int32)
        whole[:, 0] = [number[x] for x in totals]
        part = np.r_[range_of(words[:, 0]), range_of(np.array([language_image(x) for x in totals], np.uint64))]
        ids, sums = np.concatenate([ids, whole]), np.r_[sums, np.array(list(totals.values()), np.int64)]
        order = np.lexsort((*ids.T[::-1], part))
        part, ids, sums = part[order], ids[order], sums[order]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for s, e in zip(starts.tolist(), np.r_[starts[1:], len(part)].tolist()):
            used = np.unique(ids[s:e])
            used = used[used >= 0]
            own = np.where(ids[s:e] < 0, -1, np.searchsorted(used, ids[s:e])).astype(np.int32)
            yield int(part[s]), Automaton.from_table([labels[k] for k in used], own, sums[s:e])

    by_number: list[str] = []

    def out(pairs):
        for r, automaton in pairs:
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([automaton.to_bytes()], pa.binary())], ["range", "automaton"])

    def run(batches):
        bits, number = np.frombuffer(bit_map.value, np.uint8), {}
        held, texts, totals, size = [], {}, {}, 0
        by_number.clear()

        def may(images):
            cell = images >> down
            return (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for chunk in chunks(batches):
            for name in chunk.langs:
                if name not in number:
                    number[name] = len(number)
                    by_number.append(name)
            of = np.array([number[x] for x in chunk.langs], np.int64)
            for k, n in enumerate(np.bincount(chunk.lang, minlength=len(chunk.langs)).tolist()):
                if n:
                    totals[chunk.langs[k]] = totals.get(chunk.langs[k], 0) + n
            for n, (at, images) in enumerate(chunk.grams(), 1):
                keep = may(images)
                if n == 1:
                    common = keep
                else:
                    for k in range(n):
                        keep &= common[at + k]
                at, images = at[keep], images[keep]
                keys, counts, first = summed(images)
                at = at[first]
                words = np.zeros((len(at), MAX_WORDS), np.uint64)
                for k in range(n):
                    words[:, k] = chunk.words[at + k]
                if n == 1:
                    texts.update((i, chunk.text(p)) for i, p in zip(keys.tolist(), at.tolist()) if i not in texts)
                held.append((keys, words, counts, of[chunk.lang[at]]))
                size += len(at)
            if size > HELD:
                yield from out(sent(held, texts, totals))
                held, texts, totals, size = [], {}, {}, 0
        if totals:
            yield from out(sent(held, texts, totals))

    return run


def _union(batches):
    """Rows (range, automaton) in order of range to one automaton per range."""
    def one(r, held):
        automaton = Automaton.union([Automaton.from_bytes(x) for x in held]) if len(held) > 1 else Automaton.from_bytes(held[0])
        return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([automaton.to_bytes()], pa.binary())], ["range", "automaton"])

    now, held = None, []
    for b in batches:
        for r, automaton in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if r != now and held:
                yield one(now, held)
                held = []
            now = r
            held.append(automaton)
    if held:
        yield one(now, held)


def _candidates(ranges: int, min_count: int):
    """(lang, phrase, words, a, cut, l, rest, range of the rest); cut 0 has the words of the language as a."""
    names = ["lang", "phrase", "words", "a", "cut", "l", "rest", "range"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]

    def batch(rows):
        langs = [language_image(r[0]) for r in rows]
        firsts = [r[6].partition(" ")[0].encode() for r in rows]
        lengths = np.array([len(f) for f in firsts])
        images = word_images(b"".join(firsts) + b"\n" * 8, np.cumsum(lengths) - lengths, lengths, np.array(langs, np.uint64))
        part = (images >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int32) if ranges > 1 else np.zeros(len(rows), np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] + [pa.array(part)], names)

    def run(batches):
        rows = []
        for b in batches:
            for data in b.column(1).to_pylist():
                automaton = Automaton.from_bytes(data)
                ids, weights = automaton.table()
                words = (ids >= 0).sum(axis=1) - 1
                own = weights[np.arange(len(ids)), words + 1]
                labels = automaton.labels
                for i in np.flatnonzero((words == 0) | (words > 1) & (own >= min_count)).tolist():
                    lang, *parts = [labels[k] for k in ids[i, :words[i] + 1].tolist()]
                    if not parts:
                        rows.append((lang, "", 0, int(own[i]), 0, 0, ""))
                    else:
                        phrase, w = " ".join(parts), weights[i].tolist()
                        rows += [(lang, phrase, len(parts), int(own[i]), k, w[k + 1], " ".join(parts[k:])) for k in range(1, len(parts))]
                    if len(rows) >= 8192:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def _look_up(batches):
    """Rows (range, automaton, null, null), then (range, null, lang, rest) in order, to (lang, rest, r)."""
    automaton, wanted = None, []

    def found():
        pairs = list(automaton.compose(Automaton.build((path, 1) for path in sorted(wanted))))
        return pa.RecordBatch.from_arrays([
            pa.array([p[0] for p, _ in pairs], pa.string()), pa.array([" ".join(p[1:]) for p, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64()),
        ], ["lang", "rest", "r"])

    for b in batches:
        for data, lang, rest in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
            if data is not None:
                if wanted:
                    yield found()
                automaton, wanted = Automaton.from_bytes(data), []
            else:
                wanted.append((lang, *rest.split(" ")))
                if len(wanted) >= 1 << 16:
                    yield found()
                    wanted = []
    if wanted:
        yield found()


def counted_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT):
    """(candidates with their cuts and counts, words per lang): both stored."""
    spark = docs.sparkSession
    d = docs.select(column(docs, lang_col).cast("string").alias("lang"), column(docs, text_col).alias("text"))
    size = d.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(1 << 15, 1 << (size // PER_RANGE).bit_length())
    bits, cells = frequent_cells(d, size, min_count)
    automata = d.mapInArrow(_automata(spark.sparkContext.broadcast(bits), cells, ranges), "range int, automaton binary")
    n = max(partitions(spark), ranges)
    unions = stored(automata.repartition(n, "range").sortWithinPartitions("range").mapInArrow(_union, "range int, automaton binary"), "automata")
    rows = stored(unions.mapInArrow(
        _candidates(ranges, min_count), "lang string, phrase string, words int, a bigint, cut int, l bigint, rest string, range int"), "candidates")
    cuts = rows.filter("cut > 0")
    asked = unions.select("range", "automaton", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("rest")).unionByName(
        cuts.select("range", F.lit(None).cast("binary").alias("automaton"), "lang", "rest").distinct())
    dealt = asked.repartition(n, "range").sortWithinPartitions("range", F.col("lang").asc_nulls_first(), "rest")
    answers = dealt.mapInArrow(_look_up, "lang string, rest string, r bigint")
    cuts = stored(cuts.drop("range").join(answers, ["lang", "rest"]), "cuts")
    return cuts, rows.filter("cut = 0").select("lang", F.col("a").alias("n"))


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    cuts, totals = counted_phrases(docs, lang_col, text_col, min_count)
    whole = "(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0)))"
    scored = cuts.withColumn("score", F.expr(f"{whole} div (CAST(l AS DECIMAL(16, 0)) * CAST(r AS DECIMAL(16, 0)))"))
    lowest = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select(
        "lang", "phrase", "words", "a", "m.l", "m.r", "m.score")
    longer = cuts.filter((F.col("words") == 3) & (F.col("cut") == 1))
    inner = longer.select("lang", "a", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    shadow = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = lowest.join(shadow, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < SHADOWED * F.col("a")))
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
