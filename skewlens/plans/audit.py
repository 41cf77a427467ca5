"""The whole audit: notices and baseline in, every result table out; at once, or batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..operators.category import analyze_categories
from ..operators.counts import case_cube, overview_from_cube
from ..operators.features import engineer_features
from ..operators.joins import yearly_baseline
from ..operators.persistence import anova_from_moments, moments, persistence_from_counts, value_counts
from ..operators.representation import analyze_geography
from ..operators.results import findings, result_table
from ..operators.state import ages_of, audit_state, cube_of, merge_states
from ..operators.trends import analyze_trends
from ..operators.weapons import analyze_weapons
from ..session import stored
from ..sources.commits import CommitLog
from .report import badges, dataset_summary

_FAMILY, _AGE = "crime_family", "case_age_days"


class AuditTables(Mapping[str, DataFrame]):
    """The result tables of all analyses, keyed ``analysis.table``, from the case cube and the case-age counts.

    An analysis is planned when a table of it is first asked for.
    """

    ANALYSES = ("geographic", "categorical", "temporal", "persistence", "weapons", "report")

    def __init__(
        self, cube: DataFrame, ages: DataFrame, baseline: DataFrame | None = None,
        crosswalk: Mapping[str, str] | None = K.BASELINE_CROSSWALK, confidence: float = K.CONFIDENCE,
    ):
        self._cube, self._ages, self._baseline = cube, ages, baseline
        self._crosswalk, self._confidence = crosswalk, confidence
        self._planned: dict[str, dict[str, DataFrame]] = {}

    def analysis(self, name: str) -> dict[str, DataFrame]:
        if name not in self._planned:
            self._planned[name] = getattr(self, f"_{name}")()
        return self._planned[name]

    def __getitem__(self, key: str) -> DataFrame:
        name, _, table = key.partition(".")
        if name not in self.ANALYSES:
            raise KeyError(key)
        return self.analysis(name)[table]

    def __iter__(self) -> Iterator[str]:
        return (f"{a}.{t}" for a in self.ANALYSES for t in self.analysis(a))

    def __len__(self) -> int:
        return sum(len(self.analysis(a)) for a in self.ANALYSES)

    def _geographic(self):
        return analyze_geography(self._cube, confidence=self._confidence, weight="n")

    def _categorical(self):
        return analyze_categories(self._cube, self._baseline, self._crosswalk, self._confidence, weight="n")

    def _temporal(self):
        return analyze_trends(self._cube, self._confidence, weight="n")

    def _persistence(self):
        return {
            "persistence_by_category": persistence_from_counts(self._ages, _FAMILY, _AGE),
            "test": anova_from_moments(moments(self._ages, _FAMILY, _AGE), _FAMILY, self._confidence),
        }

    def _weapons(self):
        return analyze_weapons(self._cube, weight="n")

    def _report(self):
        results = result_table(
            self["geographic.test"], self.analysis("categorical").get("test"), self["persistence.test"])
        one, trend = overview_from_cube(self._cube), self["temporal.trend"]
        return {
            "overview": one,
            "dataset_summary": dataset_summary(one),
            "results": results,
            "badges": badges(results, trend),
            "findings": findings(results, trend),
        }


def analyze_features(
    features: DataFrame,
    baseline: DataFrame | None = None,
    crosswalk: Mapping[str, str] | None = K.BASELINE_CROSSWALK,
    confidence: float = K.CONFIDENCE,
) -> AuditTables:
    """All analyses of engineered rows, lazily: every result table counts ``features`` anew."""
    return AuditTables(case_cube(features), value_counts(features, _FAMILY, _AGE), baseline, crosswalk, confidence)


def analyze_state(
    state: DataFrame, baseline: DataFrame | None = None, crosswalk: Mapping[str, str] | None = K.BASELINE_CROSSWALK,
    confidence: float = K.CONFIDENCE,
) -> AuditTables:
    """All result tables of the notices that ``state`` counts."""
    return AuditTables(cube_of(state), ages_of(state), baseline, crosswalk, confidence)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage, and a lost executor costs a re-read only."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_audit(
    notices: DataFrame,
    baseline: DataFrame,
    output: str,
    crosswalk: Mapping[str, str] | None = K.BASELINE_CROSSWALK,
    confidence: float = K.CONFIDENCE,
) -> AuditTables:
    """Engineer and count in one pass, analyse the counts.

    ``output`` must be a folder every executor reaches. The text rules run once, and no
    engineered row is shuffled or stored: the state of the notices, their case cube and
    case-age counts, is one aggregate. With the yearly baseline it is all that the some
    thirty result tables read, at any size of the data.
    """
    root = output.rstrip("/")
    yearly = _stored(yearly_baseline(baseline, crosswalk), f"{root}/baseline_yearly")
    state = _stored(audit_state(engineer_features(notices)), f"{root}/state")
    return analyze_state(state, yearly, None, confidence)


class AuditLog:
    """States of batches in a folder that all executors reach; each batch is counted once, whoever adds it.

    A new batch costs a pass over its own notices. The tables of all batches read the
    merged states, which are as small as one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._log = CommitLog(spark, f"{self.root}/commits")

    def add(self, batch: str, notices: DataFrame) -> bool:
        """Count flat ``notices`` as ``batch``; False if a batch of that name is counted already."""
        if batch in self.batches():
            return False
        path = f"{self.root}/states/{uuid.uuid4().hex}"
        audit_state(engineer_features(notices)).write.parquet(path)
        while True:
            seen = self.batches()
            if batch in seen:
                return False
            if self._log.try_commit(len(seen) + 1, {"batch": batch, "path": path}):
                return True

    def batches(self) -> list[str]:
        return [e["batch"] for e in self._log.entries()]

    def state(self) -> DataFrame:
        """The merged state of all batches, stored."""
        paths = [e["path"] for e in self._log.entries()]
        if not paths:
            raise ValueError(f"no batch has been counted in {self.root}")
        return stored(merge_states(self.spark.read.parquet(*paths)), "state")

    def tables(
        self, baseline: DataFrame, crosswalk: Mapping[str, str] | None = K.BASELINE_CROSSWALK, confidence: float = K.CONFIDENCE
    ) -> AuditTables:
        """All result tables over all batches."""
        yearly = stored(yearly_baseline(baseline, crosswalk), "baseline_yearly")
        return analyze_state(self.state(), yearly, None, confidence)
