"""SimHash near-dedup: fingerprints, bit-sliced comparison, groups.

Fingerprints. The text is lower-cased (A-Z), cut at white space, and every run
of three words is hashed (XXH64, seed 42); a fingerprint bit is 1 if more than
half of the hashes have it.

Candidates. 64 bits are cut into 5 blocks; fingerprints within 3 bits agree in
2 blocks at least, so each of the 10 pairs of blocks is a table, and only
fingerprints in one bucket of a table are compared. Buckets of more than
``TILE`` fingerprints are cut into chunks, and each pair of chunks is a task of
its own: no link is lost and no task holds more than two chunks.

Comparison. A block of fingerprints is stored as 64 bit planes, 64 fingerprints
to a machine word. Each query fingerprint adds its planes to a two-bit
carry-save counter with an overflow bit per fingerprint; words in which every
fingerprint has overflown, and queries without a word left, are abandoned.

Groups. A task returns, for each fingerprint, one link to the smallest member
of its local group, never all pairs; the links are joined to groups by passing
smallest labels along them and jumping pointers.

Defined cases. A null or empty text, or one of white space, has the fingerprint
zero, which links like any other. One or two words are one shingle. A row
without doc_id gets its fingerprint, links to nothing, and has a null
component_id. Rows that share a doc_id are compared each on its own text.
Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import column, giving_back, partitions, stored

SHINGLE = 3
SEED = 42
RADIUS = 3
WIDTHS = (13, 13, 13, 13, 12)  # of the blocks, from the lowest bit
TILE = 2048
QUERIES = 128
CHUNK = 1 << 16  # shingles whose bits are counted at once
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints ------------------------------------------------------------

def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six spaces only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        prints = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long), a row per row of ``docs``."""
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return d.mapInArrow(giving_back(_fingerprints), "doc_id bigint, fp bigint")


# --- comparison --------------------------------------------------------------

def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit i of all prints, 64 prints to a word."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, "<u8")
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within_radius(queries: np.ndarray, prints: np.ndarray, planes: np.ndarray, radius: int = RADIUS):
    """For each query that has a print in reach: (its index, a bool mask over ``prints``). Counts up to three bits."""
    assert 0 <= radius <= 3
    rows, cols = np.arange(len(queries)), np.arange(planes.shape[1])
    zero = np.zeros((len(rows), len(cols)), np.uint64)
    low, high, over = zero, zero.copy(), zero.copy()
    for bit in range(64):
        flip = (((queries[rows] >> np.uint64(bit)) & np.uint64(1)) * ALL)[:, None]
        differ = planes[bit, cols][None, :] ^ flip
        carry = low & differ
        low = low ^ differ
        over |= high & carry
        high = high ^ carry
        if bit % 8 == 7 and bit < 63:
            live = over != ALL
            r, c = live.any(axis=1), live.any(axis=0)
            if not r.any():
                return
            if not (r.all() and c.all()):
                rows, cols = rows[r], cols[c]
                low, high, over = (x[np.ix_(r, c)] for x in (low, high, over))
    near = ~over
    for limit in range(radius, 3):  # of the counts 0 to 3, drop those above the radius
        count = limit + 1
        near &= ~((low if count & 1 else ~low) & (high if count & 2 else ~high))
    found = near.any(axis=1)
    for i in np.flatnonzero(found):
        word = np.zeros(planes.shape[1], "<u8")
        word[cols] = near[i]
        yield int(rows[i]), np.unpackbits(word.view(np.uint8), bitorder="little")[:len(prints)].astype(bool)


def local_groups(prints: np.ndarray) -> np.ndarray:
    """For every print the index of its group's first member, groups by links within the radius."""
    root = np.arange(len(prints))
    planes = planes_of(prints)
    for i in range(0, len(prints), QUERIES):
        for q, mask in within_radius(prints[i:i + QUERIES], prints, planes):
            roots = root[mask]
            if (roots != roots[0]).any():
                first = roots.min()
                root[np.isin(root, np.unique(roots))] = first
    return root


def _links(batches):
    """Rows (bucket, print), sorted by bucket, to links (a, b), a < b. Small buckets share a block."""
    def link(prints):
        prints = np.unique(prints)
        root = local_groups(prints)
        at = np.flatnonzero(root != np.arange(len(root)))
        a, b = prints[root[at]].view(np.int64), prints[at].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held, last, parts, size = [], None, [], 0  # of the open bucket; of closed buckets that wait for each other
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buckets = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(buckets)]):
            if buckets[s] != last:
                if (n := sum(map(len, held))) > 1:
                    parts += held
                    size += n
                held, last = [], buckets[s]
                if size > 256:
                    yield link(np.concatenate(parts))
                    parts, size = [], 0
            held.append(prints[s:e])
    if sum(map(len, held)) > 1:
        parts += held
    if parts:
        yield link(np.concatenate(parts))


def candidate_links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all fingerprints within the radius of each other, from distinct ``fp``."""
    edges = np.cumsum((0,) + WIDTHS)
    keys = []
    for t, (i, j) in enumerate(combinations(range(len(WIDTHS)), len(WIDTHS) - RADIUS)):
        block = [F.shiftrightunsigned("fp", int(edges[x])).bitwiseAND(F.lit((1 << WIDTHS[x]) - 1)) for x in (i, j)]
        keys.append(F.lit(t << 26).bitwiseOR(F.shiftleft(block[0], WIDTHS[j])).bitwiseOR(block[1]).cast("long"))
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    crowded = rows.groupBy("key").count().filter(F.col("count") > tile)
    crowded = crowded.select("key", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("chunks"))
    rows = rows.join(stored(crowded, "crowded"), "key", "left")
    chunk = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    rows = rows.withColumn("chunk", chunk).withColumn(
        "other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )
    # the bucket of a tile is a hash: two that meet by chance are only compared in vain
    bucket = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = rows.select(bucket.alias("bucket"), "fp")
    n = partitions(prints.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(_links), "a bigint, b bigint").distinct()


# --- groups ------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node each linked node reaches. Rounds are stored, and their number is logarithmic in practice."""
    links = stored(links, "links")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("seen"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        # jump: take the label of the label
        of = labels.select(F.col("node").alias("n2"), F.col("root").alias("jump"))
        new = low.join(of, F.col("root") == F.col("n2"), "left").select("node", "old", F.least("root", "jump").alias("root"))
        new = stored(new, "labels")
        changed = new.filter("old != root").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable): one row per row of ``docs``."""
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(candidate_links(distinct.select("fp")))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    out = prints.join(of, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with all their columns.

    Of rows that repeat a representative's doc_id one stays. Rows without
    doc_id are in no group and stay.
    """
    found = near_duplicates(docs, id_col, text_col)
    first = found.filter("component_id is not null").select(F.col("component_id").alias("_keep")).distinct()
    row = F.struct(*[column(docs, c) for c in docs.columns]).alias("_row")
    key = column(docs, id_col).cast("long").alias("_key")
    wide = docs.select(row, key, F.xxhash64(column(docs, text_col)).alias("_tie"))
    one = wide.join(stored(first, "first").hint("merge"), F.col("_key") == F.col("_keep")).withColumn(
        "_n", F.row_number().over(Window.partitionBy("_key").orderBy("_tie")))
    return one.filter("_n = 1").select("_row.*").unionByName(wide.filter("_key is null").select("_row.*"))
