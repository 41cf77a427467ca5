"""Repeated byte strings across documents, by a difference-cover suffix sort in blocks.

A byte is removed if it lies in a string of ``min_length`` bytes that also starts
in a document with a smaller doc_id.

Cover. With a difference cover D modulo v, two equal strings of ``min_length``
bytes at any two places hold, at one common offset below v, a cover place each,
with the same ``min_length - v + 1`` bytes after it. The strings at cover places
(5 of 21 for 50 bytes) are ranked first, bucket by bucket: one that stands in
one document only is alone in its rank. A suffix that has no shared cover string
within its first v places can therefore equal no other, and is never sorted.

Suffixes. The rest, cut at ``min_length``, are sorted bucket by bucket. A bucket is
a range of one 64-bit image of the string, its order that of a second one, so that buckets
are even however texts are distributed and a long tie costs one comparison. Each
block of documents sends a string once, with its smallest doc_id; the bucket
answers one bit, whether a smaller doc_id has the string.

Blocks (some 4 MB of documents) are written once, as a table bucketed by block:
the answers are joined to it without moving the texts again. Pieces that travel
are sorted numbers, sent as differences in as few bytes as the largest needs.
A task holds a few blocks, or one bucket, at a time.

Defined cases. A null or empty text has no bytes. A text that equals that of a
smaller doc_id is removed whole if it has ``min_length`` bytes, and is not sorted.
Rows that share a doc_id are not smaller than each other. A null doc_id counts
after all others. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from skewlens.session import shared_folder

from .common import column, partitions, stored

MIN_LENGTH = 50
BLOCK_BYTES = 4 << 20
TABLE_BYTES = 32 << 20  # texts in one bucket of the table of blocks
MOST_TABLE_BUCKETS = 1 << 16  # Spark refuses tables of over 100,000
PER_BUCKET = 1 << 22  # strings in one suffix bucket
# Difference covers, modulus and residues.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
LAST = (1 << 63) - 1
PIECES = "bucket int, block bigint, n int, widths int, base bigint, keys binary, ids binary"
ANSWERS = "block bigint, kind int, bucket int, bits binary"
COPIES, RANKS, SUFFIXES = 0, 1, 2


def cover(min_length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves more than half of the string to the cover places."""
    fit = [v for v in COVERS if v <= 0.45 * min_length]
    if min_length < 10:
        raise ValueError("min_length must be 10 at least")
    return max(fit), COVERS[max(fit)]


def images(body: bytes, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit images of the ``length`` bytes from each place, eight bytes at a time."""
    words = np.ndarray((max(0, len(body) - 7),), "<u8", buffer=body, strides=(1,))
    out = np.full(len(at), seed, np.uint64)
    steps = list(range(0, length - 7, 8))
    if steps[-1] != length - 8:
        steps.append(length - 8)
    for s in steps:
        out ^= words[at + s]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def packed(numbers: np.ndarray) -> tuple[bytes, int]:
    """Unsigned numbers in as few bytes as the largest needs, and how many."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def pieces(block: int, bucket: np.ndarray, keys: np.ndarray, ids: np.ndarray | None, buckets: int, shift: int | None = None):
    """One row per bucket of strings sorted by (bucket, key); the bucket is that part of the key from bit ``shift``, if given."""
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(bounds)):
        own = slice(bounds[k], bounds[k + 1])
        raw, width = packed(np.diff(keys[own], prepend=np.uint64(0 if shift is None else int(k) << shift)))
        base, more, wide = 0, b"", 0
        if ids is not None:
            base = int(ids[own].min())
            more, wide = packed((ids[own] - base).astype(np.uint64))
        rows.append((int(k), block, own.stop - own.start, width | wide << 8, base, raw, more))
    return rows


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), names)], [n for n, _ in names])


def _blocks(batches):
    """(doc_id, text) rows to blocks: ids, lengths, digests and the joined bytes, compressed."""
    part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

    def closed():
        ids = np.array([i for i, _ in held], "<i8").tobytes()
        lengths = np.array([len(t) for _, t in held], "<i8").tobytes()
        digests = b"".join(xxhash.xxh3_128_digest(t) for _, t in held)
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(t for _, t in held))
        row = (part << 32 | k, ids, lengths, digests, body)
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64())] + [pa.array([x], pa.binary()) for x in row[1:]], ["block", "ids", "lengths", "digests", "body"])

    for b in batches:
        texts = b.column(1).cast(pa.large_string()).cast(pa.large_binary())
        for i, t in zip(b.column(0).fill_null(LAST).to_pylist(), texts):
            held.append((i, t.as_py() or b""))
            size += len(held[-1][1])
            if size >= BLOCK_BYTES or len(held) >= 1 << 16:
                yield closed()
                k, held, size = k + 1, [], 0
    if held:
        yield closed()


def _digests(batches):
    for b in batches:
        for block, ids, digests in zip(*(b.column(i).to_pylist() for i in range(3))):
            d = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
            n = len(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.frombuffer(ids, "<i8")), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                ["block", "at", "id", "hi", "lo"])


class Block:
    """A block's documents, its cover strings and, once those are ranked, its suffixes that may repeat."""

    def __init__(self, block: int, ids: bytes, lengths: bytes, body: bytes, answers, length: int, buckets: int, key_bits: int):
        self.block, self.length, self.buckets, self.key_bits = block, length, buckets, key_bits
        self.shift = key_bits - buckets.bit_length() + 1  # of the bucket in the key of a cover string
        self.v, residues = cover(length)
        self.ids, self.lengths = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8")
        self.body = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, int(self.lengths.sum())))
        self.n, self.ends = len(self.body), np.cumsum(self.lengths)
        self.answers = {(a["kind"], a["bucket"]): a["bits"] for a in answers or ()}
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[np.frombuffer(self.answers.get((COPIES, 0), b""), "<i4")] = True
        self.place = np.arange(self.n, dtype=np.int64) - np.repeat(self.ends - self.lengths, self.lengths)
        self.room = np.repeat(np.where(self.copy, 0, self.lengths), self.lengths) - self.place
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)
        self.sampled = np.zeros(self.v, bool)
        self.sampled[list(residues)] = True

    def told(self, kind: int, bucket: np.ndarray) -> np.ndarray:
        """The answers' bits in the order of the strings sent."""
        out = np.zeros(len(bucket), bool)
        bounds = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            if bits := self.answers.get((kind, int(k))):
                n = bounds[k + 1] - bounds[k]
                out[bounds[k]:bounds[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        return out

    def cover_strings(self):
        """(places, order, rank within the block, bucket and key of each rank, ranks with two documents)."""
        short = self.length - self.v + 1
        at = np.flatnonzero(self.sampled[self.place % self.v] & (self.room >= short) & (self.room + self.place >= self.length))
        keys = images(self.body, at, short, 1) >> np.uint64(64 - self.key_bits)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        doc = self.doc[at][order]  # in order of place, as the sort is stable
        ends = np.r_[starts[1:], len(doc)][:len(starts)] - 1
        keys = keys[starts]
        return at, order, np.cumsum(first) - 1, (keys >> np.uint64(self.shift)).astype(np.int64), keys, doc[starts] != doc[ends]

    def suffixes(self):
        """(places in order, rank of each, bucket, key and smallest doc_id of each rank)."""
        at, order, rank, bucket, _, twice = self.cover_strings()
        shared = np.zeros(self.n + self.v + 1, np.int32)
        shared[at[order[(twice | self.told(RANKS, bucket))[rank]]] + 1] = 1
        reach = np.cumsum(shared, dtype=np.int32)
        at = np.flatnonzero((reach[self.v:self.v + self.n] > reach[:self.n]) & (self.room >= self.length))
        keys = images(self.body, at, self.length, 2)
        bucket = (images(self.body, at, self.length, 3) >> np.uint64(48)).astype(np.uint16)
        bucket >>= np.uint16(16 - self.buckets.bit_length() + 1)
        order = np.argsort(keys)
        order = order[np.argsort(bucket[order], kind="stable")]
        at, keys, bucket = at[order], keys[order], bucket[order]
        first = np.r_[True, (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])] if len(keys) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        ids = self.ids[self.doc[at]]
        least = np.minimum.reduceat(ids, starts) if len(starts) else ids
        return at, np.cumsum(first) - 1, bucket[starts].astype(np.int64), keys[starts], ids, least

    def removed(self):
        """Per document: (doc_id, bytes, bytes removed, spans, kept bytes)."""
        at, rank, bucket, _, ids, least = self.suffixes()
        gone = at[(ids > least[rank]) | self.told(SUFFIXES, bucket)[rank]]
        edges = np.zeros(self.n + 1, np.int32)
        edges[gone] += 1
        np.subtract.at(edges, gone + self.length, 1)
        covered = np.cumsum(edges[:-1]) > 0
        covered |= np.repeat(self.copy & (self.lengths >= self.length), self.lengths)
        body, out = np.frombuffer(self.body, np.uint8), []
        for i, s, n in zip(self.ids.tolist(), (self.ends - self.lengths).tolist(), self.lengths.tolist()):
            own = covered[s:s + n]
            turns = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            spans = [{"start": a, "end": b} for a, b in turns.tolist()]
            kept = body[s:s + n][~own].tobytes() if spans else self.body[s:s + n]
            out.append((i, n, int((turns[:, 1] - turns[:, 0]).sum()), spans, kept))
        return out


def _each(step, length: int, buckets: int, key_bits: int):
    """Run ``step`` over the blocks of a task, one at a time."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = [b.column(k)[i].as_py() for k in range(5)]
                yield from step(Block(*row, length, buckets, key_bits))

    return run


def _send_cover(block: Block):
    *_, bucket, keys, _ = block.cover_strings()
    if rows := pieces(block.block, bucket, keys, None, block.buckets, block.shift):
        yield batch_of(rows, PIECES)


def _send_suffixes(block: Block):
    _, _, bucket, keys, _, least = block.suffixes()
    if rows := pieces(block.block, bucket, keys, least, block.buckets):
        yield batch_of(rows, PIECES)


def _send_result(block: Block):
    ids, sizes, removed, spans, kept = zip(*block.removed())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    yield pa.RecordBatch.from_arrays(
        [pa.array([None if i == LAST else i for i in ids], pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
        ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _answer(kind: int):
    """Sort one bucket at a time and answer each piece: which of its strings repeat (cover), or have a smaller doc_id elsewhere."""
    def answers(bucket, held):
        keys = np.concatenate([np.cumsum(unpacked(raw, widths & 255), dtype=np.uint64) for _, _, widths, _, raw, _ in held])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        yes = np.zeros(len(keys), bool)
        if kind == RANKS:
            yes[order[1:][same]] = True
            yes[order[:-1][same]] = True
        else:
            ids = np.concatenate([unpacked(raw, widths >> 8).astype(np.int64) + base for _, _, widths, base, _, raw in held])
            starts = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(ids[order], starts)
            yes[order] = ids[order] > least[np.cumsum(np.r_[True, ~same]) - 1]
        rows, at = [], 0
        for block, n, *_ in held:
            if (own := yes[at:at + n]).any():
                rows.append((block, kind, bucket, np.packbits(own).tobytes()))
            at += n
        for i in range(0, len(rows), 1024):
            yield batch_of(rows[i:i + 1024], ANSWERS)

    def run(batches):
        now, held = None, []
        for b in batches:
            for bucket, *piece in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now and held:
                    yield from answers(now, held)
                    held = []
                now = bucket
                held.append(piece)
        if held:
            yield from answers(now, held)

    return run


def bucketed(df: DataFrame, name: str, n: int, key: str) -> DataFrame:
    """``df`` written below the shared folder in ``n`` buckets of ``key``, so that joins on it leave it in place."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    table = f"skewlens_{name}_{mark}"
    df.write.bucketBy(n, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(table)
    return spark.table(table)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start, end in bytes), kept (bytes): one row per row of ``docs``."""
    spark = docs.sparkSession
    v, residues = cover(min_length)
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    size = d.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_TABLE_BUCKETS, max(partitions(spark), size // TABLE_BYTES + 1))
    blocks = bucketed(d.mapInArrow(_blocks, "block bigint, ids binary, lengths binary, digests binary, body binary"), "blocks", n, "block")
    # Buckets for the cover strings serve the suffixes too, which are fewer; a chance hit in a thousand cover keys at most.
    strings = max(1, size * len(residues) // v)
    buckets = min(1 << 15, 1 << (strings // PER_BUCKET).bit_length())
    key_bits = min(64, 8 * ((strings.bit_length() + 10 + 7) // 8))

    rows = blocks.select("block", "ids", "digests").mapInArrow(_digests, "block bigint, at int, id bigint, hi bigint, lo bigint")
    texts = rows.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copies = rows.join(texts.select("hi", "lo", "first"), ["hi", "lo"]).filter("id > first")
    copies = copies.groupBy("block").agg(F.collect_list("at").alias("at")).mapInArrow(_copies, ANSWERS)
    answers = stored(copies, "copies")

    def asked(step, out, answers):
        by_block = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "bits")).alias("answers"))
        with_answers = blocks.select("block", "ids", "lengths", "body").join(by_block, "block", "left")
        return with_answers.mapInArrow(_each(step, min_length, buckets, key_bits), out)

    for kind, step in ((RANKS, _send_cover), (SUFFIXES, _send_suffixes)):
        dealt = asked(step, PIECES, answers).repartition(max(partitions(spark), buckets), "bucket").sortWithinPartitions("bucket")
        answers = answers.unionByName(stored(dealt.mapInArrow(_answer(kind), ANSWERS), "answers"))
    return asked(_send_result, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary", answers)


def _copies(batches):
    for b in batches:
        rows = [(block, COPIES, 0, np.array(at, "<i4").tobytes()) for block, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if rows:
            yield batch_of(rows, ANSWERS)
