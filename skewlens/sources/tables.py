"""Stored tables: notices, baseline counts and analysis results, kept as Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schemas import BASELINE_TABLE, RESULT_TABLE, WANTED_TABLE
from ..session import stored
from .commits import CommitLog

# What a manifest says: the batch joins those before it, or takes their place.
_MODES = {"append": "append", "replace": "replace", "fail": "append"}


def matches(filters: Mapping[str, Any]):
    """AND of ``column = value`` and ``column IN (list)``; pushed down to the Parquet scan."""
    tests = [F.col(k).isin(v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in filters.items()]
    return reduce(and_, tests, F.lit(True))


class TableStore:
    """Three tables under one folder that all executors can reach.

    Saves are staged: a batch is derived and written once, to a folder of its own, and joins
    the table by a manifest (:mod:`skewlens.sources.commits`). Readers see committed
    batches only, and a save that fails or is refused leaves the table as it was. The
    ``uid`` of notices is a key: every batch brings an index of its keys in hash buckets,
    and an append reads the committed index of its own buckets alone. Of two saves
    that compete, the later one tests the batches committed meanwhile before it tries again.
    """

    SCHEMAS: Mapping[str, StructType] = {
        "wanted_persons": WANTED_TABLE,
        "crime_statistics": BASELINE_TABLE,
        "bias_analysis_results": RESULT_TABLE,
    }
    PARTITIONS: Mapping[str, list[str]] = {
        "wanted_persons": ["publication_year"],
        "crime_statistics": ["year"],
        "bias_analysis_results": [],
    }
    #: Files are sorted by the columns that loads filter by, so that the value ranges of row groups tell most of them apart ...
    SORTED_BY: Mapping[str, list[str]] = {
        "wanted_persons": ["birth_state", "crime_family", "uid"],
        "crime_statistics": ["state", "crime_family"],
        "bias_analysis_results": [],
    }
    #: ... and columns of many values that the order does not serve have Bloom filters in every row group.
    BLOOM: Mapping[str, list[str]] = {"wanted_persons": ["uid"], "crime_statistics": [], "bias_analysis_results": []}
    ROW_GROUP_BYTES = 16 << 20
    KEY_BUCKETS = 16

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _log(self, table: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.path(table)}/commits")

    def exists(self, table: str) -> bool:
        return bool(self._log(table).entries())

    def create_tables(self) -> None:
        """Create each table that is absent, empty and with its declared columns."""
        for table in self.SCHEMAS:
            if not self.exists(table):
                self._log(table).try_commit(1, {"mode": "append", "batch": None})

    @staticmethod
    def _live(entries: list[dict[str, Any]]) -> list[str]:
        """The batches the table consists of after these manifests."""
        batches: list[str] = []
        for e in entries:
            batches = ([] if e["mode"] == "replace" else batches) + [b for b in [e["batch"]] if b]
        return batches

    def _stage(self, df: DataFrame, table: str) -> str:
        """Write ``df`` as a batch that is not committed yet."""
        schema, parts, batch = self.SCHEMAS[table], self.PARTITIONS[table], uuid.uuid4().hex
        # Full-size files per folder; AQE splits a folder that holds most rows over many tasks.
        rows = df.hint("rebalance", *parts) if parts else df
        if "id" in schema.names and "id" not in df.columns:
            # The batch and the row's place in its write task: never the same twice.
            rows = rows.withColumn("id", F.concat(F.lit(batch), F.lit("-"), F.hex(F.monotonically_increasing_id())))
        have = {c.lower() for c in rows.columns}
        by_name = rows.select(
            *[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        )
        if self.SORTED_BY[table]:
            by_name = by_name.sortWithinPartitions(*parts, *self.SORTED_BY[table])
        writer = by_name.write.option("parquet.block.size", self.ROW_GROUP_BYTES)
        for c in self.BLOOM[table]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        if parts:
            writer = writer.partitionBy(*parts)
        writer.parquet(self._batch_path(table, batch))
        return batch

    def _batch_path(self, table: str, batch: str) -> str:
        return f"{self.path(table)}/data/batch={batch}"

    def _batches(self, table: str, batches: list[str]) -> DataFrame:
        schema = self.SCHEMAS[table]
        if not batches:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path(table)}/data")
        return reader.parquet(*[self._batch_path(table, b) for b in batches]).select(*schema.names)

    def _read(self, table: str) -> DataFrame:
        entries = self._log(table).entries()
        if not entries:
            raise ValueError(f"{table} has not been created in {self.root}")
        return self._batches(table, self._live(entries))

    def _save(self, df: DataFrame, table: str, if_exists: str) -> None:
        """Stage and commit rows without a key."""
        self._check_mode(table, if_exists)
        batch, log = self._stage(df, table), self._log(table)
        while True:
            entries = log.entries()
            self._check_mode(table, if_exists, entries)
            if log.try_commit(len(entries) + 1, {"mode": _MODES[if_exists], "batch": batch}):
                return

    def _check_mode(self, table: str, if_exists: str, entries: list | None = None) -> None:
        if if_exists not in _MODES:
            raise ValueError(f"if_exists must be one of {', '.join(_MODES)}, not {if_exists}")
        if if_exists == "fail" and (self._log(table).entries() if entries is None else entries):
            raise AnalysisException(f"table {table} exists already in {self.root}")

    # --- keys of the notices ---

    def _index_path(self, batch: str) -> str:
        return f"{self.path('wanted_persons')}/keys/batch={batch}"

    def _index(self, batch: str) -> tuple[DataFrame, dict[str, Any]]:
        """Write the keys of a staged batch (uid, n, bucket) in order of bucket; what was seen on the way. Reads one column of it."""
        uids = self._batches("wanted_persons", [batch]).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
        bucket = F.pmod(F.xxhash64("uid"), F.lit(self.KEY_BUCKETS)).cast("int")
        seen = Observation()
        watched = uids.withColumn("bucket", bucket).observe(
            seen, F.count(F.lit(1)).alias("keys"), F.count_if(F.col("uid").isNull() | (F.col("n") > 1)).alias("bad"),
            F.bit_or(F.expr("shiftleft(1L, bucket)")).alias("buckets"))
        watched.repartition("bucket").sortWithinPartitions("bucket").write.parquet(self._index_path(batch))
        bits = seen.get["buckets"] or 0
        return self._keys([batch]), {
            "keys": seen.get["keys"], "bad": seen.get["bad"], "buckets": [b for b in range(self.KEY_BUCKETS) if bits >> b & 1]}

    def _keys(self, batches: list[str]) -> DataFrame:
        reader = self.spark.read.schema("uid string, n long, bucket int")
        return reader.parquet(*[self._index_path(b) for b in batches])

    def _known(self, index: DataFrame, buckets: list[int], batches: list[str]) -> DataFrame:
        """The keys of ``index`` that ``batches`` hold, from their buckets of the committed index (other row groups are skipped)."""
        there = self._keys(batches).where(F.col("bucket").isin(buckets)).select("uid", "bucket")
        return index.select("uid", "bucket").join(there, ["bucket", "uid"], "left_semi")

    def save_wanted(self, df: DataFrame, if_exists: str = "append", known: str = "refuse") -> None:
        """Save notices. ``uid`` is the key: null and repeated ones are refused, and so is a batch with stored ones.

        ``known='skip'`` leaves out notices that are stored already instead.
        """
        if known not in ("refuse", "skip"):
            raise ValueError(f"known must be refuse or skip, not {known}")
        self._check_mode("wanted_persons", if_exists)
        batch = self._stage(df, "wanted_persons")
        index, seen = self._index(batch)
        if seen["bad"]:
            raise ValueError("notices without a uid, or with the same one")
        log, tested = self._log("wanted_persons"), set()
        while True:
            entries = log.entries()
            self._check_mode("wanted_persons", if_exists, entries)
            new = [b for b in self._live(entries) if b not in tested] if if_exists == "append" else []
            if new and seen["keys"]:
                there = self._known(index, seen["buckets"], new)
                if known == "refuse":
                    if there.limit(1).count():
                        raise ValueError("a notice with this uid is stored already")
                else:
                    there = stored(there, "known")
                    found = there.count()
                    if found == seen["keys"]:
                        return
                    if found:
                        rest = self._batches("wanted_persons", [batch]).join(there.select("uid"), "uid", "left_anti")
                        batch = self._stage(rest, "wanted_persons")
                        index, seen = self._index(batch)
            tested |= set(new)
            if if_exists == "append" and not seen["keys"] and entries:
                return
            if log.try_commit(len(entries) + 1, {"mode": _MODES[if_exists], "batch": batch if seen["keys"] else None}):
                return

    def save_baseline(self, df: DataFrame, if_exists: str = "append") -> None:
        self._save(df, "crime_statistics", if_exists)

    def save_results(self, results: DataFrame) -> None:
        """Append rows of :func:`skewlens.operators.results.stored_results`."""
        self._save(results, "bias_analysis_results", "append")

    def load_wanted(self, filters: Mapping[str, Any] | None = None) -> DataFrame:
        return self._read("wanted_persons").where(matches(filters or {}))

    def load_baseline(self, filters: Mapping[str, Any] | None = None) -> DataFrame:
        return self._read("crime_statistics").where(matches(filters or {}))

    def analysis_history(self) -> DataFrame:
        """Stored results, newest first."""
        return self._read("bias_analysis_results").orderBy(F.desc("analysis_date"), "analysis_type")
