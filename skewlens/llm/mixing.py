"""Mixing sources to target weights by fitting word budgets.

Targets. Sources in code point order (null last) weigh 3, 1, 2 in turn and share
150 % of all words; a target stops at twice its source's words, and what is
over is shared again by weight until no target is above its stop.

Fitting. A source's documents are counted by exact length. Whole passes over the
source come first; for the rest of the budget each length gives its share of
documents, rounded down, then single lengths are added as long as they fit, and
a bounded knapsack over the documents that are left finds the subset of lengths
that comes closest to the budget without passing it. Which documents of a length
are taken follows a seeded hash of the doc_id: lengths with many documents are
cut into hash buckets of some 1,000, whole buckets are taken, and only the last
one is ranked.

Sizes of groups: the knapsack sees the distinct lengths of one source, never its
documents; a ranked group is one bucket.

Defined cases. A null or empty text has size 0 and takes no words. Null sources
form one source. Rows that share a doc_id are documents of their own; equal ones
are interchangeable. Documents of equal length are ordered by hash, then doc_id,
so reruns agree. A null doc_id hashes like any value. An empty table gives an
empty result. Only the three named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import column, ordered_index, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_TIMES = 2
SEED = 17
BUCKET = 1024
MAX_BUDGET = 1 << 16  # of the knapsack, in words
RESERVE = 1 << 12     # left to the knapsack at least


def source_targets(hist: DataFrame, weights=WEIGHTS, share: float = SHARE, max_times: int = MAX_TIMES) -> DataFrame:
    """src (struct), idx, source_size, target from src, size, n. A few sums per round reach the driver."""
    totals = hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    totals = ordered_index(totals, F.col("src.source").asc_nulls_last(), name="idx")
    weight = F.element_at(F.lit(list(weights)), F.pmod("idx", F.lit(len(weights))).cast("int") + 1).cast("double")
    totals = totals.withColumn("weight", weight)
    stop = max_times * F.col("source_size")
    words = share * (totals.agg(F.sum("source_size")).first()[0] or 0)
    level, closed = 0.0, -1
    while True:
        full = F.col("weight") * level > stop if closed >= 0 else F.lit(False)
        r = totals.agg(
            F.sum(F.when(full, stop).otherwise(0)).alias("stopped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(full.cast("long")).alias("n"),
        ).first()
        if r["n"] is None or r["n"] == closed:
            break
        closed = r["n"]
        if not r["open"]:
            level = float("inf")
            break
        level = (words - r["stopped"]) / r["open"]
    target = F.least(F.col("weight") * F.lit(level), stop.cast("double"))
    return totals.select("src", "idx", "source_size", target.alias("target"))


def closest_subset(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that their sum is the largest not above ``budget``."""
    take = np.zeros(len(sizes), np.int64)
    if budget <= 0:
        return take
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    via = np.full(budget + 1, -1, np.int64)
    parts = []
    for i in np.argsort(sizes, kind="stable"):
        size, left, k = int(sizes[i]), int(counts[i]), 1
        if size <= 0:
            continue
        if size > budget or reach[budget]:
            break
        left = min(left, budget // size)
        while left > 0:  # a bounded count as parts of 1, 2, 4, ... and the rest
            k = min(k, left)
            step = k * size
            new = np.zeros_like(reach)
            new[step:] = reach[:-step] if step else reach
            new &= ~reach
            via[new] = len(parts)
            reach |= new
            parts.append((i, k, step))
            left -= k
            k *= 2
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        i, k, step = parts[via[at]]
        take[i] += k
        at -= step
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """(whole passes, documents per size for one more pass)."""
    total = int((sizes * counts).sum())
    if total == 0:
        return 1, np.zeros(len(sizes), np.int64)
    goal = int(np.floor(target + 0.5))
    passes = goal // total
    budget = goal - passes * total
    take = np.minimum(counts, np.floor(counts * (budget / total)).astype(np.int64))
    over = int((sizes * take).sum()) - budget
    for i in np.argsort(-sizes, kind="stable"):  # rounding of doubles only
        while over > 0 and take[i]:
            take[i] -= 1
            over -= int(sizes[i])
    rest = budget - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):  # long ones first: short ones fill gaps
        if rest > RESERVE and take[i] < counts[i] and 0 < sizes[i] <= rest - RESERVE:
            take[i] += 1
            rest -= int(sizes[i])
    if rest > MAX_BUDGET:
        for i in np.argsort(-sizes, kind="stable"):
            if sizes[i] > 0:
                more = min(int(counts[i] - take[i]), max(0, rest - RESERVE) // int(sizes[i]))
                take[i] += more
                rest -= more * int(sizes[i])
    if rest > MAX_BUDGET:
        # all that are left are longer than rest - RESERVE, so that at most one fits; shorter ones the knapsack sees
        fits = np.flatnonzero((take < counts) & (sizes > MAX_BUDGET) & (sizes <= rest))
        if len(fits):
            longest = fits[np.argmax(sizes[fits])]
            take[longest] += 1
            rest -= int(sizes[longest])
    small = min(rest, MAX_BUDGET)
    return passes, take + closest_subset(sizes, counts - take, small)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    passes, take = fit(sizes, counts, float(rows["target"].iloc[0]))
    return pd.DataFrame({"idx": rows["idx"], "size": sizes, "passes": np.int64(passes), "take": take})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per row of ``docs``; a document's words are taken ``copies`` times."""
    size = F.coalesce(F.regexp_count(column(docs, text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        column(docs, id_col).alias("doc_id"), F.struct(column(docs, source_col).alias("source")).alias("src"), size.alias("size"),
        F.xxhash64(column(docs, id_col), F.lit(seed)).alias("h"),
    )
    rows = stored(rows, "sizes")
    hist = stored(rows.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    targets = stored(source_targets(hist), "targets")
    plan = hist.join(targets, "src")
    taken = plan.select("idx", "size", "n", "target").groupBy("idx").applyInPandas(_fit, "idx bigint, size bigint, passes bigint, take bigint")
    plan = plan.join(taken, ["idx", "size"]).withColumn("buckets", F.ceil(F.col("n") / BUCKET))
    plan = stored(plan, "plan")
    joined = rows.join(plan.select("src", "size", "source_size", "target", "passes", "take", "n", "buckets"), ["src", "size"])
    bucket = F.shiftrightunsigned(F.shiftrightunsigned("h", 33) * F.col("buckets"), 31)
    joined = stored(joined.withColumn("bucket", bucket), "bucketed")
    # lengths with more than one bucket: what the buckets before hold
    before = (
        joined.filter("buckets > 1 and take > 0 and take < n").groupBy("src", "size", "bucket").agg(F.count(F.lit(1)).alias("held"))
        .withColumn("before", F.sum("held").over(Window.partitionBy("src", "size").orderBy("bucket")) - F.col("held"))
        .drop("held")
    )
    joined = joined.join(stored(before, "before"), ["src", "size", "bucket"], "left")
    rank = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "doc_id"))
    chosen = (F.col("take") > 0) & ((F.col("take") >= F.col("n")) | (F.coalesce("before", F.lit(0)) + rank <= F.col("take")))
    return joined.select(
        "doc_id", F.col("src.source").alias("source"), "size", "source_size", "target",
        (F.col("passes") + chosen.cast("long")).alias("copies"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows that share doc_id, source and size share their copies as evenly as they go.
    """
    key = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")).alias("_key")
    took = mix(docs, id_col, text_col, source_col, seed)
    took = took.groupBy(key(F.col("doc_id"), F.col("source"), F.col("size"))).agg(F.sum("copies").alias("_c"), F.count(F.lit(1)).alias("_n"))
    size = F.coalesce(F.regexp_count(column(docs, text_col), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.struct(*[column(docs, c) for c in docs.columns]).alias("_row")
    wide = docs.select(row, key(column(docs, id_col), column(docs, source_col), size))
    # as many rows as documents: never a side to broadcast, and the window below finds its rows in place
    took = stored(took, "copies").filter("_c > 0").withColumnRenamed("_key", "_of").hint("merge")
    wide = wide.join(took, F.col("_key") == F.col("_of"))
    wide = wide.withColumn("_i", F.row_number().over(Window.partitionBy("_of").orderBy("_of")))
    copies = F.floor(F.col("_c") / F.col("_n")) + (F.col("_i") <= F.pmod("_c", "_n")).cast("long")
    return wide.select("_row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_copy")).select("_row.*")
