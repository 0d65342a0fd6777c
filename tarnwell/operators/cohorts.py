"""Set operators between the answers of questions: cohorts of those that are in one answer, in both, or in one alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("union", "intersect", "except")


def cohort(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The different keys of both answers (union), of rows in both (intersect), or in left alone (except); null keys are equal.

    Each side is first brought to its different keys, so that one shuffle of keys is all that is needed.
    """
    if kind not in KINDS:
        raise ValueError(f"union, intersect or except, not {kind}")
    a, b = (df.select(*keys).distinct() for df in (left, right))
    return a.union(b).distinct() if kind == "union" else a.intersect(b) if kind == "intersect" else a.exceptAll(b)


def members(answer: DataFrame, of: DataFrame, keys: list[str], inside: bool = True) -> DataFrame:
    """Rows of an answer whose keys are in a cohort (or are not, without `inside`); null keys are equal."""
    mine = of.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(keys)]
    return answer.join(mine, same, "left_semi" if inside else "left_anti")


def retention(firsts: DataFrame, later: DataFrame, keys: list[str], period: str) -> DataFrame:
    """For each period of the first answer: its different members, and how many of these the later answer holds."""
    mine = firsts.select(period, *keys).distinct()
    back = later.select(*[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)]).distinct().withColumn("__back", F.lit(1))
    same = [F.col(k).eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(keys)]
    return mine.join(back, same, "left").groupBy(period).agg(F.count("*").alias("members"), F.count("__back").alias("returned"))
