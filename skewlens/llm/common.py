"""Helpers the operators of this package share."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skewlens.session import shared_folder

#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def column(df: DataFrame, name: str):
    """Column ``name`` whatever characters it holds."""
    return F.col(f"`{name}`")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives later joins a size
    that is known instead of estimated.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def giving_back(run):
    """``run`` of a mapInArrow whose worker returns freed memory to the system when a task has ended.

    Workers stay for later tasks, idle, on the executors of stages that need none: what their
    allocators hold counts there. What a worker keeps on purpose stays.
    """
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of Python and numpy, where the C library has it
        if trim:
            trim(0)

    return whole


def _sums(batches):
    """Rows whose last column is a number to the same rows with the sum of that column before them, within the part."""
    total = 0
    for b in batches:
        n = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
        before = np.cumsum(n) - n + total
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64())], [*b.schema.names, "_inside"])


def running_sum(df: DataFrame, value: str, *order, name: str = "before") -> DataFrame:
    """Rows with the sum of ``value`` (a long) over all rows before them in ``order``, without a task that sees all rows.

    As in :func:`ordered_index`: parts in order add up for themselves, and one number per part reaches the driver.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c != value]
    ranged = df.select(*rest, value).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    schema = T.StructType([*ranged.schema.fields, T.StructField("_inside", T.LongType())])
    kept = stored(ranged.mapInArrow(giving_back(_sums), schema).withColumn("_part", F.spark_partition_id()), "summed")
    sizes = {r[0]: r[1] for r in kept.groupBy("_part").agg(F.sum(value)).collect()}
    bases, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        bases.append(total)
        total += sizes.get(p, 0)
    base = F.element_at(F.lit(bases or [0]), F.col("_part") + 1)
    return kept.withColumn(name, (base + F.col("_inside")).cast("long")).drop("_inside", "_part")


def ordered_index(df: DataFrame, *order, name: str = "index") -> DataFrame:
    """Rows with their 0-based position in ``order``, without a task that sees all rows.

    The rows are range-partitioned and stored, the sizes of the parts are
    counted (one number per part reaches the driver), and each part counts on
    from the sum of the parts before it.
    """
    spark = df.sparkSession
    n = partitions(spark)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id())
    kept = stored(ranged, "ordered")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in kept.groupBy(part.alias("p")).count().collect()}
    bases, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        bases.append(total)
        total += sizes.get(p, 0)
    base = F.element_at(F.lit(bases or [0]), part.cast("int") + 1)
    return kept.withColumn(name, (base + row).cast("long")).drop("_at")
