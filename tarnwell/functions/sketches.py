"""Mergeable sketches as metrics: stored by day and segment, merged when a question is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the registers of a distinct count, and the size of a quantile sketch.
LG_K, K = 12, 200
#: Relative error of a distinct count and error of a quantile's rank that hold with a chance of 99 percent and more.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.0265


def sketched(rows: DataFrame, day: Column, segments: list[str], distinct: list[str] = (), quantiles: list[str] = ()) -> DataFrame:
    """One row for each day and segment: n, a distinct-count sketch of each column `distinct` and a quantile sketch of each
    column `quantiles`.  Nulls are in no sketch; rows without a day form a day of their own."""
    each = [F.hll_sketch_agg(F.col(c), LG_K).alias(f"{c}_distinct") for c in distinct]
    each += [F.kll_sketch_agg_double(F.col(c).cast("double"), K).alias(f"{c}_quantiles") for c in quantiles]
    return rows.groupBy(day.alias("day"), *segments).agg(F.count("*").alias("n"), *each)


def stored(sketches: DataFrame, path: str) -> None:
    """Write sketches by day; days that are written again replace the old ones, other days stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def answered(sketches: DataFrame, by: list[str], days: tuple[str, str] | None = None, ranks: tuple[float, ...] = (0.5,)) -> DataFrame:
    """For each group of `by` over a range of days (both ends count): n, the estimated distinct counts and quantiles.

    Only stored sketches are read and merged, whatever the period; a group without a value has 0 and null.
    """
    if days:
        sketches = sketches.where(F.col("day").between(*[F.to_date(F.lit(d)) for d in days]))
    kinds = {s: [c[: -len(s)] for c in sketches.columns if c.endswith(s)] for s in ("_distinct", "_quantiles")}
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), *[F.hll_union_agg(f"{c}_distinct").alias(f"{c}_distinct") for c in kinds["_distinct"]], *[F.kll_merge_agg_double(f"{c}_quantiles").alias(f"{c}_quantiles") for c in kinds["_quantiles"]],
    )
    some = lambda c: F.kll_sketch_get_n_double(f"{c}_quantiles") > 0
    out = [F.hll_sketch_estimate(f"{c}_distinct").alias(f"{c}_distinct") for c in kinds["_distinct"]]
    out += [F.when(some(c), F.kll_sketch_get_quantile_double(f"{c}_quantiles", F.lit(float(r)))).alias(f"{c}_q{round(100 * r)}") for c in kinds["_quantiles"] for r in ranks]
    return merged.select(*by, "n", *out)
