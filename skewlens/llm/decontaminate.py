"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are normalised: lower case, white space runs as one blank. A
document leaks an item if some part of it is within ``MAX_EDIT_SHARE`` of the
item's length in edits (insert, delete, replace of a code point).

Embedding (CGK). A walk over a window writes the character it stands on and
moves on, or stays, by a random bit drawn for the step and the character. Two
windows a few edits apart fall into step again soon after each edit, so their
walks agree in most steps: edit distance becomes Hamming distance. A table
samples a few steps of one walk (more of them the more items there are, so that
chance hits stay rare) and hashes their characters; a window and an item that
agree there are a candidate. Tables are added, each with a walk of its own, until
random edits of the items themselves, as many as are allowed, are found with the
target recall: 1,000 edited items of a class at least, and as many fresh ones,
must both say so with 95 % confidence. The first tables look at windows from every start, until each item's
walk has ended within it once: copies are always found. The others look at every
third start, and their recall is measured on windows that start beside the edited
passage as often as on it. A class of item lengths that ``MAX_TABLES`` tables do
not bring to the target has none: its windows are compared with each item by the
8-grams they share, and those that edits cannot rule out are verified (no loss).

Windows. Each class of item lengths (a factor of 1.25) has windows of its size,
starting at every character where they could reach an item at all: an item of
m characters keeps at least m - 7 - 8k of its 8-grams through k edits, so a
window with fewer 8-grams of items of its class cannot be near one (no loss).
A gram counts no more often than an item holds it, so a window that repeats one
word of an item has few.

Verification. Candidates are checked with Myers' bit-vector edit distance over
the text around them; each (document, item) is returned with its best match.

Items are taken in blocks of bounded size (``BLOCK_CHARS``), each with a pass
over all documents; nothing of the documents is collected.

Defined cases. Null texts are empty and leak nothing. Items that are null, or
shorter than ``MIN_CHARS`` characters once normalised, are no evidence and leak
nowhere. Items with equal texts are all returned. Ties of distance go to the
first end in the text. Repeated documents give repeated rows. An empty table on
either side gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, giving_back

MAX_EDIT_SHARE = 0.08
MIN_CHARS = 20
GRAM = 8
RATIO = 1.25
CHANCE = 0.01          # candidates by chance per window and table, at most
ALPHABET = 12         # characters that texts use about equally often
TARGET_RECALL = 0.99
MAX_TABLES = 256      # classes that need more are searched by shared 8-grams, without tables
TRIALS = 6            # random edits per item in the calibration,
LEAST_TRIALS = 1000   # at least so many for a class, however few its items,
MOST_TRIALS = 20_000  # and at most, which is enough to measure a share
CONFIDENCE_Z = 1.645  # the target lies below the recall with 95 % confidence
SEED = 11
BLOCK_CHARS = 4_000_000
PIECE_CHARS = 1_000_000  # searched for grams at once
STRIDE = 16
NEAR = 32             # places back to which repeats of a gram are looked for
MANY = 127            # repeats of a gram in an item beyond which they are not counted
STEP = 3              # starts of the tables that need not see every start
WALKERS = 1 << 16
MEET = 8              # the step at which walks that have met are first joined
POSTINGS = 1 << 20    # looked up at once
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def allowed(length: int, share: float = MAX_EDIT_SHARE) -> int:
    return int(length * share)


def folded(text: str) -> np.ndarray:
    """Characters as bytes: enough for walks and grams, exact only in the verification."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return ((wide ^ (wide >> 8)) & 0xFF).astype(np.uint8)


def grams(chars: np.ndarray) -> np.ndarray:
    """The 8-gram at every position, as one number; ``GRAM`` - 1 fewer than characters."""
    if len(chars) < GRAM:
        return np.empty(0, np.uint64)
    out = chars
    for kind, step in ((np.uint16, 1), (np.uint32, 2), (np.uint64, 4)):
        wide = out.astype(kind)
        out = wide[:-step] | (wide[step:] << kind(8 * step))
    return out


class Walk:
    """One CGK walk with its sampled steps, for windows of at least ``length`` characters."""

    def __init__(self, length: int, number: int, samples: int):
        self.drawn_by = (length, number, samples)
        rng = np.random.default_rng([SEED, length, number])
        steps = max(samples, int(1.6 * length))  # half the steps move on: four fifths of the window
        self.sampled = np.sort(rng.choice(steps, samples, replace=False))
        self.moves = rng.integers(0, 2, (int(self.sampled[-1]) + 1, 256), dtype=np.uint8)
        self.marks = rng.integers(0, 1 << 64, (samples, 256), dtype=np.uint64)

    def __reduce__(self):
        return Walk, self.drawn_by  # drawn again where it is needed

    def hashes(self, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The table's hash of the window at each start; ``chars`` (as indices) must go on beyond the last window.

        Where a walk leads depends on the step and the place alone: walks of neighbouring starts that have met go on
        as one, and few are left after some dozen steps. ``first`` is the first start of each.
        """
        out = np.empty(len(starts), np.uint64)
        moves, sampled = self.moves.astype(np.intp), set(self.sampled.tolist())
        for i in range(0, len(starts), WALKERS):
            at = starts[i:i + WALKERS].astype(np.intp)
            n, first = len(at), np.arange(len(at))
            h = np.zeros(n, np.uint64)
            here, move = np.empty_like(at), np.empty_like(at)
            k, meet = 0, MEET
            for step, row in enumerate(moves):
                chars.take(at, out=here, mode="clip")
                if step in sampled:
                    h += np.repeat(self.marks[k][here], np.diff(first, append=n))
                    k += 1
                row.take(here, out=move, mode="clip")
                at += move
                if step == meet:
                    own = np.r_[True, at[1:] != at[:-1]]
                    at, first = at[own], first[own]
                    here, move = here[:len(at)], move[:len(at)]
                    meet += meet // 2
            out[i:i + WALKERS] = h
        return out

    def stays_inside(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the walk over each text ends within it, so that what follows a copy of it cannot matter."""
        at = starts.astype(np.int64)
        for step in range(len(self.moves) - 1):
            at += self.moves[step][chars[at]]
        return at - starts < lengths


def padded(texts: list[str], pad: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, each followed by ``pad``; where each starts)."""
    sizes = np.array([len(t) + len(pad) for t in texts], np.int64)
    return folded("".join(t + pad for t in texts)).astype(np.intp), np.cumsum(sizes) - sizes


def edited(text: str, edits: int, rng) -> str:
    """``text`` after that many random edits."""
    out = list(text)
    for _ in range(edits):
        i, kind = int(rng.integers(len(out))), int(rng.integers(3))
        if kind == 0:
            del out[i]
        elif kind == 1:
            out.insert(i, chr(97 + int(rng.integers(26))))
        else:
            out[i] = chr(97 + int(rng.integers(26)))
    return "".join(out)


def surely(hits: np.ndarray) -> float:
    """The lower end of the confidence interval (Wilson) of a share."""
    n, p, z = len(hits), hits.mean(), CONFIDENCE_Z
    return float((p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


class LengthClass:
    """The items of one range of lengths, their tables and what a window must hold to be walked."""

    def __init__(self, texts: list[str], numbers: list[int], share: float, recall: float):
        lengths = [len(t) for t in texts]
        self.low, self.high = min(lengths), max(lengths)
        edits = [allowed(n, share) for n in lengths]
        self.reach = self.high + max(edits)
        self.need = max(1, min(n - GRAM + 1 - GRAM * k for n, k in zip(lengths, edits)))
        rng = np.random.default_rng([SEED, self.low])
        chars, starts = padded(texts, "\0" * 2 * self.high)
        count = 2 * min(MOST_TRIALS, max(LEAST_TRIALS, TRIALS * len(texts)))  # the second half is fresh to the first
        of = np.arange(count) % len(texts) if len(texts) < count else rng.choice(len(texts), count, replace=False)
        trials = [edited(texts[i], edits[i], rng) for i in of]
        trial_chars, trial_starts = padded(["  " + t for t in trials], "".join(chr(97 + x) for x in rng.integers(0, 26, 2 * self.high)))
        half = rng.permutation(count) < count // 2
        beside = rng.integers(-1, 2, count)
        found, copied = np.zeros(count, bool), np.zeros(len(texts), bool)
        self.tables = []
        samples = max(2, int(np.ceil(np.log(len(texts) / CHANCE) / np.log(ALPHABET))))

        def short():
            return min(surely(found[half]), surely(found[~half])) < recall or not copied.all()

        while len(self.tables) < MAX_TABLES and short():
            walk, every = Walk(self.low, len(self.tables), samples), not copied.all()
            hashes = walk.hashes(chars, starts)
            if every:
                copied |= walk.stays_inside(chars, starts, np.array(lengths))
            open_ = np.flatnonzero(~found)
            at = trial_starts[open_] + 2 + (0 if every else beside[open_])
            found[open_] = walk.hashes(trial_chars, at) == hashes[of[open_]]
            order = np.argsort(hashes, kind="stable")
            self.tables.append((walk, hashes[order], np.array(numbers)[order], every))
        self.exact = short()
        if self.exact:
            self.tables = []
            self.numbers, self.lengths = np.array(numbers), np.array(lengths)
            self.widths = self.lengths + edits - GRAM + 1
            self.needs = np.maximum(1, self.lengths - GRAM + 1 - GRAM * np.array(edits))
            self.own = [np.unique(grams(folded(t))) for t in texts]
            of = np.repeat(np.arange(len(texts)), [len(g) for g in self.own])
            every_gram = np.concatenate(self.own)
            order = np.argsort(every_gram, kind="stable")
            self.holders = of[order]  # the items of each gram, gram by gram
            self.grams, first = np.unique(every_gram[order], return_index=True)
            self.first = np.r_[first, len(order)]

    def sharing(self, codes: np.ndarray, at: np.ndarray):
        """(place of the item in the class, starts) wherever a window holds the 8-grams that the allowed edits leave of an item."""
        if not len(at):
            return
        width = self.reach - GRAM + 1
        for part in np.split(at, np.flatnonzero(np.diff(at // (4 * self.reach))) + 1):
            stretch = codes[part[0]:part[-1] + width]
            slot = np.minimum(np.searchsorted(self.grams, stretch), len(self.grams) - 1)
            slot, times = np.unique(slot[self.grams[slot] == stretch], return_counts=True)
            size = self.first[slot + 1] - self.first[slot]
            held = np.zeros(len(self.own), np.int64)
            for some in np.split(np.arange(len(slot)), np.flatnonzero(np.diff(np.cumsum(size) // POSTINGS)) + 1):
                n = size[some]
                where = np.repeat(self.first[slot[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                held += np.bincount(self.holders[where], np.repeat(times[some], n), len(held)).astype(np.int64)
            here = part - part[0]
            for i in np.flatnonzero(held >= self.needs):
                own = self.own[i]
                hit = own[np.minimum(np.searchsorted(own, stretch), len(own) - 1)] == stretch
                upto = np.r_[0, np.cumsum(hit)]
                good = part[upto[here + self.widths[i]] - upto[here] >= self.needs[i]]
                if len(good):
                    yield i, good


def pieces(texts: list[str], most: int = PIECE_CHARS):
    """(first, last + 1) of runs of texts with some ``most`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def grouped(items: list[tuple]) -> tuple[list[str], list[list], list[list[int]]]:
    """(distinct normalised texts in order, the item_ids of each, the texts of each length class)."""
    ids: dict[str, list] = {}
    for item_id, text in items:
        text = normalise(text)
        if len(text) >= MIN_CHARS:
            ids.setdefault(text, []).append(item_id)
    texts = sorted(ids)
    ranges: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        ranges.setdefault(int(np.log(len(t) / MIN_CHARS) / np.log(RATIO)), []).append(i)
    return texts, [ids[t] for t in texts], [r for _, r in sorted(ranges.items())]


class Index:
    """A block of items: distinct normalised texts, their length classes, and the 8-grams of all."""

    def __init__(self, items: list[tuple], share: float = MAX_EDIT_SHARE, recall: float = TARGET_RECALL, classes: list[LengthClass] | None = None):
        self.texts, self.ids, ranges = grouped(items)
        self.share = share
        self.own_grams: dict[int, np.ndarray] = {}
        self.classes = classes or [LengthClass([self.texts[i] for i in r], r, share, recall) for r in ranges]
        all_grams = np.unique(np.concatenate([grams(folded(t)) for t in self.texts])) if self.texts else np.empty(0, np.uint64)
        bits = max(16, int(len(all_grams) * 32).bit_length())
        self.shift = np.uint64(64 - bits)
        self.known = np.zeros(1 << bits, np.int8)  # how often an item holds the gram, at most
        for t in self.texts:
            own, times = np.unique(self.slots(grams(folded(t))), return_counts=True)
            self.known[own] = np.maximum(self.known[own], np.minimum(times, MANY))
        self.members = np.zeros(1 << bits, np.uint64)  # bit c: a gram of an item of class c
        for c, r in enumerate(ranges):
            own = self.slots(np.concatenate([grams(folded(self.texts[i])) for i in r]))
            self.members[own] |= np.uint64(1 << min(c, 63))

    def slots(self, g: np.ndarray) -> np.ndarray:
        return ((g * MULTIPLIER) >> self.shift).astype(np.intp)

    def repeats(self, slots: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Whether a place repeats a gram that stands within ``NEAR`` before it as often as any item holds it."""
        at = np.flatnonzero(held)
        gram, at = np.divmod(np.sort(slots[at] * len(slots) + at), len(slots))
        most = held[at]
        before = np.arange(len(at)) - most
        again = np.zeros(len(slots), bool)
        again[at] = (before >= 0) & (gram[before] == gram) & (at - at[before] <= NEAR) & (most < MANY)
        return again

    def windows(self, number: int, slots: np.ndarray, again: np.ndarray, total: np.ndarray, fresh: np.ndarray, n: int) -> np.ndarray:
        """Starts of windows with enough grams of the class: of any item first, then, around those, of its own.

        ``total`` sums the grams before each place and ``fresh`` those that are no repeats: a repeat at least ``NEAR``
        within a window has the places it repeats in the window, too, and does not count.
        """
        c = self.classes[number]
        width = c.reach - GRAM + 1
        near, far = min(NEAR, width), min(NEAR + STRIDE, width)
        some = total[far:far + n:STRIDE] - total[:n:STRIDE] + fresh[width + STRIDE:width + STRIDE + n:STRIDE] - fresh[far:far + n:STRIDE]
        coarse = np.flatnonzero(some >= c.need) * STRIDE  # one test for the starts up to the next
        at = (coarse[:, None] + np.arange(STRIDE)).ravel()
        at = at[at < n]
        at = at[total[at + near] - total[at] + fresh[at + width] - fresh[at + near] >= c.need]
        if not len(at):
            return at
        new = np.r_[True, at[1:] - at[:-1] > width]
        first = at[new]
        size = np.r_[at[:-1][new[1:]], at[-1]] + width - first
        base = np.cumsum(size) - size
        stretch = np.repeat(first - base, size) + np.arange(size.sum())
        own = (self.members[slots[stretch]] & np.uint64(1 << min(number, 63))) > 0
        upto, anew = (np.r_[0, np.cumsum(x)] for x in (own, own & ~again[stretch]))
        run = np.cumsum(new) - 1
        here = at - first[run] + base[run]
        return at[upto[here + near] - upto[here] + anew[here + width] - anew[here + near] >= c.need]

    def candidates(self, texts: list[str]):
        """Arrays of (item, text, position) that agree in a table."""
        tail = 2 * max(c.reach for c in self.classes) + GRAM + STRIDE
        open_ = [Open() for _ in self.classes]
        for s, e in pieces(texts):
            sizes = np.array([len(t) + 1 for t in texts[s:e]], np.int64)
            starts = np.cumsum(sizes) - sizes
            chars = folded("\0".join(texts[s:e]) + "\0" * tail)
            codes = grams(chars)
            slots = self.slots(codes)
            held = self.known[slots]
            again = self.repeats(slots, held)
            total, fresh = np.zeros((2, len(slots) + 1), np.int32)
            np.cumsum(held > 0, out=total[1:], dtype=np.int32)
            np.cumsum((held > 0) & ~again, out=fresh[1:], dtype=np.int32)
            for number, c in enumerate(self.classes):
                at = self.windows(number, slots, again, total, fresh, len(chars) - tail)
                if c.exact:
                    for i, good in c.sharing(codes, at):
                        text = np.searchsorted(starts, good, "right") - 1
                        new = np.r_[True, (np.diff(good) > 1) | (np.diff(text) > 0)]
                        kept = new | np.r_[new[1:], True] | (good % (c.lengths[i] // 2) == 0)  # enough for the search to join them
                        good, text = good[kept], text[kept]
                        yield np.stack([np.full(len(good), c.numbers[i]), text + s, good - starts[text]], axis=1)
                elif len(at):
                    open_[number].add(chars, at, starts, s, 2 * c.reach)
                    if open_[number].size > 4 * PIECE_CHARS:
                        yield from open_[number].agree(c)
        for o, c in zip(open_, self.classes):
            yield from o.agree(c)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of each pair within the allowed edits; ``texts`` normalised."""
        found = list(self.candidates(texts)) if self.texts else []
        if not found:
            return []
        item, text, at = np.unique(np.concatenate(found), axis=0).T
        # candidates of an item that lie closer than its length are verified in one stretch
        length = np.array([len(t) for t in self.texts])[item]
        new = np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (at[1:] - at[:-1] > length[1:])]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        bounds = np.flatnonzero(new)
        for s, e in zip(bounds, np.r_[bounds[1:], len(at)]):
            i, t = int(item[s]), int(text[s])
            pattern = self.texts[i]
            k = allowed(len(pattern), self.share)
            begin = max(0, int(at[s]) - k - STEP)
            stretch = texts[t][begin:int(at[e - 1]) + len(pattern) + 2 * k + STEP]
            if i not in self.own_grams:
                self.own_grams[i] = np.unique(grams(folded(pattern)))
            own, here = self.own_grams[i], grams(folded(stretch))
            kept = (own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here).sum()
            match = kept >= len(pattern) - GRAM + 1 - GRAM * k and best_match(pattern, stretch, k)
            if match:
                d, x, y = match
                best[t, i] = min(best.get((t, i), (d, y + begin, x + begin)), (d, y + begin, x + begin))
        return [(t, i, d, start, end) for (t, i), (d, end, start) in sorted(best.items())]


class Open:
    """Windows of one length class that wait to be walked together, with the characters around them."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.chars, self.at, self.near, self.text, self.position, self.size = [], [], [], [], [], 0

    def add(self, chars, at, starts, first_text, span):
        new = np.r_[True, at[1:] - at[:-1] > span]
        first, run = at[new], np.cumsum(new) - 1
        size = np.r_[at[:-1][new[1:]], at[-1]] + span - first
        base = np.cumsum(size) - size
        stretch = np.repeat(first - base, size) + np.arange(size.sum())
        self.chars.append(chars[np.minimum(stretch, len(chars) - 1)])
        here = at - first[run] + base[run] + self.size
        self.at.append(here)
        self.near.append(np.maximum(here + (at + STEP // 2) // STEP * STEP - at, 0))  # the next start on the coarse grid
        self.size += int(size.sum())
        text = np.searchsorted(starts, at, "right") - 1
        self.text.append(text + first_text)
        self.position.append(at - starts[text])

    def agree(self, c: LengthClass):
        if not self.at:
            return
        chars = np.concatenate(self.chars).astype(np.intp)
        at, near, text, position = (np.concatenate(x) for x in (self.at, self.near, self.text, self.position))
        self.clear()
        coarse, some = np.unique(near, return_index=True)
        for walk, hashes, numbers, every in c.tables:
            h = walk.hashes(chars, at if every else coarse)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(high > low)
            if len(hit):
                counts = (high - low)[hit]
                slot = np.repeat(low[hit] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                who = np.repeat(hit if every else some[hit], counts)
                yield np.stack([numbers[slot], text[who], position[who]], axis=1)


def distances(pattern: str, text: str):
    """Myers: the least edit distance of ``pattern`` to a part of ``text`` that ends at each position (1, 2, ...)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    plus, minus, score = full, 0, m
    for ch in text:
        eq = masks.get(ch, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full  # a match may start anywhere: the first row stays zero
        down = (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
        yield score


def best_match(pattern: str, text: str, limit: int):
    """(distance, start, end) of the part of ``text`` nearest to ``pattern``, or None above ``limit``; first end on ties."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    best, end = min(((d, i + 1) for i, d in enumerate(distances(pattern, text))), default=(limit + 1, 0))
    if best > limit:
        return None
    # the start: the same backwards from the end, shortest part
    back = text[max(0, end - len(pattern) - limit):end][::-1]
    size = next((i + 1 for i, d in enumerate(distances(pattern[::-1], back)) if d == best), len(back))
    return best, end - size, end


_INDEXES: dict = {}


def _classes(share: float, recall: float):
    """Rows (number, texts and their places) to (number, the class built and calibrated): a task per class."""
    def run(batches):
        for b in batches:
            for number, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                built = pickle.dumps(LengthClass(*pickle.loads(payload), share, recall))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([built], pa.binary())], ["number", "built"])

    return run


class Block:
    """A block of items whose classes are built once, in a Spark job, and broadcast.

    The tables of a block hold two numbers per item, at most ``MAX_TABLES`` of them: with
    ``BLOCK_CHARS`` that is their bound. Walks are drawn again by each worker.
    """

    def __init__(self, spark, items: list, share: float, recall: float):
        self.key = uuid.uuid4().hex
        texts, _, ranges = grouped(items)
        rows = [(n, pickle.dumps(([texts[i] for i in r], r))) for n, r in enumerate(ranges)]
        classes = []
        if rows:
            dealt = spark.createDataFrame(rows, "number int, payload binary").repartition(len(rows), "number")
            built = dict(dealt.mapInArrow(giving_back(_classes(share, recall)), "number int, built binary").collect())
            classes = [bytes(built[n]) for n in range(len(rows))]
        self.shared = spark.sparkContext.broadcast((items, share, recall, classes))

    def index(self) -> Index:
        if self.key not in _INDEXES:
            _INDEXES.clear()
            items, share, recall, classes = self.shared.value
            _INDEXES[self.key] = Index(items, share, recall, [pickle.loads(c) for c in classes])
        return _INDEXES[self.key]


def _leaks(block: Block, item_type):
    def run(batches):
        index = block.index()
        for b in batches:
            found = index.search([normalise(t.as_py()) for t in b.column(1)])
            rows = [(t, item, d, x, y) for t, i, d, x, y in found for item in index.ids[i]]
            if rows:
                at, item, d, x, y = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_type), *(pa.array(v, pa.int64()) for v in (d, x, y))],
                    ["doc_id", "item_id", "distance", "start", "end"])

    return run


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_CHARS):
    """The items in lists of bounded size, streamed from Spark."""
    block, size = [], 0
    for item_id, text in items.select(column(items, id_col).cast("long"), column(items, text_col)).toLocalIterator():
        block.append((item_id, text))
        size += len(text or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = MAX_EDIT_SHARE, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, item_id, distance, start, end (in the normalised text): one row per document and item it leaks."""
    spark = docs.sparkSession
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    schema = "doc_id bigint, item_id bigint, distance bigint, start bigint, end bigint"
    out = None
    for block in item_blocks(items):
        found = d.mapInArrow(giving_back(_leaks(Block(spark, block, share, recall), pa.int64())), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _clean(block: Block, text: int):
    def run(batches):
        index = block.index()
        for b in batches:
            rows = b.column(0)
            keep = np.ones(b.num_rows, bool)
            keep[[m[0] for m in index.search([normalise(t.as_py()) for t in rows.field(text)])]] = False
            yield pa.RecordBatch.from_arrays([rows.filter(pa.array(keep))], ["_row"])

    return run


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text", share: float = MAX_EDIT_SHARE, recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; no shuffle."""
    spark = docs.sparkSession
    wide = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("_row"))
    row = wide.schema
    text = next(i for i, c in enumerate(docs.columns) if c == text_col or text_col not in docs.columns and c.lower() == text_col.lower())
    for block in item_blocks(items):
        wide = wide.mapInArrow(giving_back(_clean(Block(spark, block, share, recall), text)), row)
    return wide.select("_row.*")
