"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are counted over all documents. Two words one edit apart differ by at most
two in the squared distance of their letter counts, so blocks of words are held
against each other by one matrix product, |x|^2 + |y|^2 - 2 x.y, and only pairs at
two or less are compared letter by letter. A block holds words of adjacent lengths
t and t + 1 that share their first t // 2 letters, or all but those: of two words
one edit apart, one half is untouched. Of the two blocks a pair may meet in, the
one of the first half counts it, if that half is equal. Blocks above ``TILE`` words
are cut into chunks, and every pair of chunks is a task of its own.

A task returns, for each word with a near one, their number and the best of them:
pairs are never written. Chains of forms are followed by pointer jumping; each
link grows n tenfold, so a few rounds do.

Defined cases. A null or empty text has no words; a null doc_id counts as an
empty one where runs are damaged. Repeated rows count like any others. Ties of n
go to the smallest word in code-point order. Letters outside a to z share
counts, which only lets more pairs through to the exact comparison. An empty
table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, partitions, stored

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DAMAGE = 31
TILE = 4096
ROWS = 512  # of a block against all its columns at once
DIMENSIONS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST_HALF, SECOND_HALF = 0, 1

_DIMENSION = np.array([c - 97 if 97 <= c <= 122 else 26 + c % (DIMENSIONS - 26) for c in range(256)])


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n: lower-cased runs of letters, of which one in ``damage`` (by its crc32 with the doc_id) has lost a letter."""
    d = docs.select(
        F.coalesce(column(docs, id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(column(docs, text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("run"),
    )
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    d = d.select("_id", run.alias("run")).withColumn("h", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    d = d.withColumn("at", at).select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = d.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def letters(block: list[bytes]) -> np.ndarray:
    """(words, width): the Latin-1 letters, 0 beyond the end."""
    width = max(map(len, block))
    return np.array(block, f"S{width}").view(np.uint8).reshape(len(block), width)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """(words, DIMENSIONS) counts, exact in the type chosen."""
    n, width = codes.shape
    flat = (np.arange(n)[:, None] * DIMENSIONS + _DIMENSION[codes])[codes > 0]
    return np.bincount(flat, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32 if width < 2000 else np.float64)


def close_pairs(x: np.ndarray, y: np.ndarray, same: bool):
    """Index pairs at a squared distance of two or less, from products of row blocks; i < j if both sides are the ``same``."""
    left, right = [], []
    y_norm = (y * y).sum(axis=1)
    for s in range(0, len(x), ROWS):
        part = x[s:s + ROWS]
        start = s if same else 0
        near = (part * part).sum(axis=1)[:, None] + y_norm[start:] - 2 * (part @ y[start:].T) <= 2
        if same:
            near &= np.arange(start, len(y)) > np.arange(s, s + len(part))[:, None]
        i, j = np.nonzero(near)
        left.append(i + s)
        right.append(j + start)
    return np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])


def one_edit(a: np.ndarray, b: np.ndarray, length: int, longer: bool):
    """(rows of letters exactly one edit apart, length of the common start); b is one letter ``longer`` or as long."""
    differ = a[:, :length] != b[:, :length]
    start = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    if not longer:
        return differ.sum(axis=1) == 1, start
    differ = a[:, length - 1::-1] != b[:, length:0:-1]
    end = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return start + end >= length, start


def near_words(block: list[bytes], side: np.ndarray | None, length: int, half: int):
    """Index pairs (both directions) of the words of a block one edit apart; ``side`` limits them to pairs across."""
    codes, sizes = letters(block), np.array([len(w) for w in block])
    counts, found = letter_counts(codes), []
    sides = [(None, None)] if side is None else [(0, 1), (1, 0)]
    for left, right in sides:
        a = np.flatnonzero((sizes == length) & ((side == left) if side is not None else True))
        for longer in (False, True):
            if left == 1 and not longer:
                continue
            if side is None and not longer:
                b = a
            else:
                b = np.flatnonzero((sizes == length + longer) & ((side == right) if side is not None else True))
            if not len(a) or not len(b):
                continue
            i, j = close_pairs(counts[a], counts[b], side is None and not longer)
            i, j = a[i], b[j]
            for s in range(0, len(i), 1 << 18):
                p, q = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
                near, start = one_edit(codes[p], codes[q], length, longer)
                near &= (start >= length // 2) == (half == FIRST_HALF)
                found += [(p[near], q[near]), (q[near], p[near])]
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compare(batches):
    """Rows (half, length, bucket, side, word, n) in this order to (word, n_near, best_n, best): one row per word and block."""
    def results(rows, length, half):
        block = [w.encode("latin-1") for _, w, _ in rows]
        side = np.array([s for s, _, _ in rows])
        source, target = near_words(block, side if side[0] >= 0 else None, length, half)
        if not len(source):
            return
        n = np.array([c for _, _, c in rows], np.int64)
        rank = np.argsort(np.argsort(np.array(block)))
        order = np.lexsort((rank[target], -n[target], source))
        source, target = source[order], target[order]
        starts = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
        counts = np.diff(np.r_[starts, len(source)])
        yield pa.RecordBatch.from_arrays([
            pa.array([rows[i][1] for i in source[starts]]), pa.array(counts.astype(np.int64)), pa.array(n[target[starts]]),
            pa.array([rows[i][1] for i in target[starts]]),
        ], ["word", "n_near", "best_n", "best"])

    ready, held, now = [], [], None  # closed blocks that wait for more of their kind; the open block
    for b in batches:
        for half, length, bucket, side, word, n in zip(*(c.to_pylist() for c in b.columns)):
            if (half, length, bucket) != now:
                if held and held[0][0] >= 0:
                    yield from results(held, now[1], now[0])
                elif len(held) > 1:
                    ready += held
                if ready and (len(ready) >= ROWS or (half, length) != now[:2]):
                    yield from results(ready, now[1], now[0])
                    ready = []
                held, now = [], (half, length, bucket)
            held.append((side, word, n))
    if held and held[0][0] >= 0:
        yield from results(held, now[1], now[0])
    elif len(held) > 1:
        ready += held
    if ready:
        yield from results(ready, now[1], now[0])


def near_counts(vocabulary: DataFrame, min_length: int = MIN_LENGTH, tile: int = TILE) -> DataFrame:
    """word, n_near, best_n, best from distinct (word, n): words with a near word only."""
    size = F.length("word")
    keys = []
    for back in (0, 1):
        t = size - back
        keys += [
            F.when(t >= min_length, F.struct(F.lit(FIRST_HALF).alias("half"), t.alias("length"), F.expr(f"xxhash64(0, left(word, (length(word) - {back}) div 2))").alias("key"))),
            F.when(t >= min_length, F.struct(F.lit(SECOND_HALF).alias("half"), t.alias("length"), F.expr(
                f"xxhash64(1, right(word, length(word) - {back} - (length(word) - {back}) div 2))").alias("key"))),
        ]
    rows = vocabulary.select("word", "n", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k")).select("word", "n", "k.*")
    crowded = rows.groupBy("half", "length", "key").count().filter(F.col("count") > tile)
    crowded = crowded.select("half", "length", "key", F.ceil(F.col("count") / (tile // 2)).cast("int").alias("chunks"))
    rows = rows.join(stored(crowded, "crowded"), ["half", "length", "key"], "left")
    chunk = F.pmod(F.xxhash64("word"), F.coalesce("chunks", F.lit(1))).cast("int")
    rows = rows.withColumn("chunk", chunk).withColumn(
        "other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    side = F.when(F.col("chunk") == F.col("other"), -1).otherwise((F.col("chunk") > F.col("other")).cast("int"))
    bucket = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = rows.select("half", "length", bucket.alias("bucket"), side.alias("side"), "word", "n")
    rows = rows.repartition(partitions(vocabulary.sparkSession), "bucket").sortWithinPartitions("half", "length", "bucket")
    found = rows.mapInArrow(_compare, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct(-F.col("best_n"), F.col("best").alias("best"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("first.col1")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from distinct (word, form): the last form that can be reached. Rounds are stored and double the way."""
    labels = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        of = labels.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        new = labels.join(of, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        new = stored(new, "roots")
        labels = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return labels


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word."""
    vocabulary = stored(words(docs, id_col, text_col), "vocabulary")
    near = near_counts(vocabulary)
    takes = F.col("best_n") >= ratio * F.col("n")
    found = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"),
    )
    found = stored(found, "forms")
    out = found.join(roots(found.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
