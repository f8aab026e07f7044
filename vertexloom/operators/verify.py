"""Comparison of results (id, value) with a table of expected ones."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANK_TOLERANCE = 1e-6


@dataclass(frozen=True)
class LabelReport:
    total: int
    mismatches: int
    unexpected: int
    missing: int

    @property
    def passed(self) -> bool:
        return not (self.mismatches or self.unexpected or self.missing)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


@dataclass(frozen=True)
class RankReport:
    total: int
    unexpected: int
    missing: int
    max_abs_diff: float
    l1: float

    @property
    def passed(self) -> bool:
        return not (self.unexpected or self.missing) and self.max_abs_diff <= RANK_TOLERANCE  # false for NaN

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def matched(result: DataFrame, truth: DataFrame) -> DataFrame:
    """id, value, copies, expected: a full join; a row that repeats an id counts as unexpected beyond the first."""
    once = result.groupBy("id").agg(F.first("value").alias("value"), F.count("*").alias("copies"))
    return once.join(truth.select("id", F.col("value").alias("expected"), F.lit(True).alias("known")), "id", "full")


def _counts() -> dict:
    copies, known = F.coalesce("copies", F.lit(0)), F.coalesce("known", F.lit(False))
    return {
        "total": F.coalesce(F.sum(copies), F.lit(0)),
        "unexpected": F.coalesce(F.sum(F.when(known, F.greatest(copies - 1, F.lit(0))).otherwise(copies)), F.lit(0)),
        "missing": F.count_if(known & (copies == 0)),
    }


def label_differences(result: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: total, mismatches, unexpected, missing."""
    wrong = F.col("known") & (F.col("copies") > 0) & ~F.col("value").eqNullSafe(F.col("expected"))
    counts = _counts() | {"mismatches": F.count_if(wrong)}
    return matched(result, truth).agg(*(c.cast("bigint").alias(n) for n, c in counts.items()))


def rank_differences(result: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: total, unexpected, missing, max_abs_diff, l1; a NaN rank makes both differences NaN."""
    gap = F.when(F.col("known") & (F.col("copies") > 0), F.abs(F.col("value") - F.col("expected")))
    counts = [c.cast("bigint").alias(n) for n, c in _counts().items()]
    return matched(result, truth).agg(*counts, F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs_diff"), F.coalesce(F.sum(gap), F.lit(0.0)).alias("l1"))


def verify_labels(result: DataFrame, truth: DataFrame) -> LabelReport:
    row = label_differences(result, truth).first()
    return LabelReport(row["total"], row["mismatches"], row["unexpected"], row["missing"])


def verify_ranks(result: DataFrame, truth: DataFrame) -> RankReport:
    return RankReport(**rank_differences(result, truth).first().asDict())


def sample_mismatches(result: DataFrame, truth: DataFrame, n: int = 10) -> DataFrame:
    """The first differing labels."""
    both = matched(result, truth).filter(F.col("known") & F.col("copies").isNotNull() & ~F.col("value").eqNullSafe(F.col("expected")))
    return both.select("id", "value", "expected").orderBy("id").limit(n)
