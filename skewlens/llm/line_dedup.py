"""Line dedup with two Bloom filters, for lines seen once and lines seen twice.

Pass 1: every part of the table notes in which cells of a filter its (document,
line) pairs fall, once or twice; the notes of all parts are merged block by
block, and a cell is "twice" if two pairs met there, in one part or in two. A
line in two documents has all its cells in the twice filter, so none is missed.
Pass 2: only pairs whose cells are all "twice" are shuffled, as 128-bit digests
with their document; grouping them tells true repeats from chance hits and
gives each its first document. Pass 3: documents drop their lines on that list.

The filter grows with the lines up to ``MAX_CELLS`` (the twice filter, the only
one sent to the executors, takes an eighth of that in bytes). With more lines the
digests are cut into ranges, and passes 1 and 2 run for one range after another,
each with a filter of its own. Beyond ``MAX_PASSES`` ranges filters fill up and more
chance hits are shuffled; the result stays exact.

Defined cases. A null or empty text is one empty line. Rows that share a
doc_id are one document where repeats are counted, and each keeps its row. A
null doc_id counts as one document after all others. Ties cannot occur: the
first document is the smallest doc_id. An empty table gives an empty result.
Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, column, partitions, stored

MIN_CHARS = 10
CELLS_PER_LINE = 16
HASHES = 3
BLOCK = 1 << 16
MAX_CELLS = 1 << 28
MAX_PASSES = 16
LAST = (1 << 63) - 1  # stands for a null doc_id


def line_keys(texts: pa.Array):
    """(lines, number of lines per text, index of the lines with a key, their text, their 128-bit digests)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pc.ascii_lower(pc.ascii_trim(lines, characters=SPACE))
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), MIN_CHARS).to_numpy(zero_copy_only=False))
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(k) for k in keys.take(pa.array(at)).cast(pa.large_binary()).to_pylist()])
    return lines, per_text, at, np.frombuffer(raw, dtype=">u8").reshape(-1, 2).astype(np.uint64)


def pairs(batch: pa.RecordBatch, part: int = 0, parts: int = 1):
    """Distinct (doc_id, digest) pairs of a batch whose digest is in a range of ``parts``."""
    _, per_text, at, digests = line_keys(batch.column(1))
    ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.repeat(ids, per_text)[at]
    rows = np.empty(len(at), dtype=[("id", "i8"), ("hi", "u8"), ("lo", "u8")])
    rows["id"], rows["hi"], rows["lo"] = ids, digests[:, 0], digests[:, 1]
    if parts > 1:  # by the upper half of the digest's upper word; cells are found by the lower
        rows = rows[((rows["hi"] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32) == part]
    return np.unique(rows)


def cells_of(rows: np.ndarray, cells: int) -> np.ndarray:
    """The ``HASHES`` distinct-as-far-as-chance-allows cells of every pair: (rows, HASHES)."""
    step = rows["lo"] | np.uint64(1)
    return (rows["hi"][:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(cells - 1)


def _note(cells: int, part: int = 0, parts: int = 1):
    def run(batches):
        seen = [p for b in batches if b.num_rows for p in [pairs(b, part, parts)] if len(p)]
        if not seen:
            return
        at, hits = np.unique(cells_of(np.unique(np.concatenate(seen)), cells), return_counts=True)
        block = (at // BLOCK).astype(np.int64)
        inside = (at % BLOCK).astype("<u2")
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[starts[1:], len(at)]
        names, once, twice = [], [], []
        for i, (s, e) in enumerate(zip(starts, ends)):
            names.append(int(block[s]))
            once.append(inside[s:e].tobytes())
            twice.append(inside[s:e][hits[s:e] > 1].tobytes())
            if len(names) == 4096 or i == len(starts) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["block", "once", "twice"])
                names, once, twice = [], [], []

    return run


def _merge(batches):
    """Notes sorted by block in, the twice bits of each block out. Holds one block at a time."""
    now, once, twice = None, None, None

    def closed():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    for b in batches:
        for block, o, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if block != now:
                if now is not None and twice.any():
                    yield closed()
                now, once, twice = block, np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
            here = np.frombuffer(o, "<u2")
            twice[here[once[here]]] = True
            once[here] = True
            twice[np.frombuffer(t, "<u2")] = True
    if now is not None and twice.any():
        yield closed()


def twice_filter(docs: DataFrame, cells: int, part: int = 0, parts: int = 1) -> bytes:
    """The bits of the twice filter over (doc_id, text) rows; ``cells`` / 8 bytes."""
    notes = docs.mapInArrow(_note(cells, part, parts), "block bigint, once binary, twice binary")
    n = max(1, min(partitions(docs.sparkSession), cells // BLOCK))
    merged = notes.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_merge, "block bigint, bits binary")
    bits = bytearray(cells // 8)
    for r in merged.toLocalIterator():
        bits[r[0] * BLOCK // 8:(r[0] + 1) * BLOCK // 8] = r[1]
    return bytes(bits)


def _suspects(filter_bits, cells: int, part: int = 0, parts: int = 1):
    def run(batches):
        bits = np.frombuffer(filter_bits.value, np.uint8)
        for b in batches:
            if b.num_rows == 0:
                continue
            rows = pairs(b, part, parts)
            at = cells_of(rows, cells)
            hit = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            rows = rows[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["hi"].astype(np.int64)), pa.array(rows["lo"].astype(np.int64)), pa.array(rows["id"])], ["hi", "lo", "id"])

    return run


def _drop(batches):
    for b in batches:
        if b.num_rows == 0:
            continue
        lines, per_text, at, digests = line_keys(b.column(1))
        owner = np.repeat(np.arange(b.num_rows), per_text)
        drops = b.column(2)  # per document: digests as pairs of longs, in one list
        lengths = pc.fill_null(pc.list_value_length(drops), 0).to_numpy(zero_copy_only=False)
        flat = drops.flatten()
        listed = np.empty(len(flat), dtype=[("d", "i8"), ("hi", "u8"), ("lo", "u8")])
        listed["d"] = np.repeat(np.arange(b.num_rows), lengths)
        listed["hi"] = flat.field(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        listed["lo"] = flat.field(1).to_numpy(zero_copy_only=False).astype(np.uint64)
        mine = np.empty(len(at), dtype=listed.dtype)
        mine["d"], mine["hi"], mine["lo"] = owner[at], digests[:, 0], digests[:, 1]
        keep = np.ones(len(lines), bool)
        keep[at[np.isin(_plain(mine), _plain(listed))]] = False
        dropped = np.bincount(owner[~keep], minlength=b.num_rows)
        left = per_text - dropped
        kept = lines.filter(pa.array(keep))
        offsets = pa.array(np.r_[0, np.cumsum(left)], pa.int64())
        text = pc.binary_join(pa.LargeListArray.from_arrays(offsets, kept), pa.scalar("\n", pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(per_text), pa.array(dropped.astype(np.int64)), text.cast(pa.string())],
            ["doc_id", "n_lines", "n_dropped", "text"])


def _plain(rows: np.ndarray) -> np.ndarray:
    """Structured rows as plain bytes, which compare faster and without surprises."""
    return np.ascontiguousarray(rows).view("V24")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS, max_passes: int = MAX_PASSES) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the lines that stay): one row per row of ``docs``."""
    spark = docs.sparkSession
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    n_lines = d.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    wanted = int(n_lines) * CELLS_PER_LINE
    cells = max(BLOCK, min(max_cells, 1 << (wanted - 1).bit_length()))
    parts = min(max_passes, -(-wanted // cells))
    suspects = None
    for part in range(parts):
        bits = spark.sparkContext.broadcast(twice_filter(d, cells, part, parts))
        found = stored(d.mapInArrow(_suspects(bits, cells, part, parts), "hi bigint, lo bigint, id bigint"), "suspects")
        bits.unpersist()
        suspects = found if suspects is None else suspects.union(found)
    repeated = suspects.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    drops = (
        suspects.join(stored(repeated, "repeated"), ["hi", "lo"]).filter("id > first")
        .groupBy("id").agg(F.collect_set(F.struct("hi", "lo")).alias("drops"))
    )
    joined = d.withColumn("_id", F.coalesce("doc_id", F.lit(LAST))).join(drops, F.col("_id") == F.col("id"), "left")
    return joined.select("doc_id", "text", "drops").mapInArrow(_drop, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")
