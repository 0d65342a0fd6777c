"""Joins on time: overlapping intervals by buckets of fitting size, and the last row before a moment."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

from tarnwell.sources.interim import written

#: Rows of a range, on average, when the last row before a moment is looked for.
RANGE_ROWS = 100_000


def _number(column: Column, kind: DataType) -> Column:
    """Days of a date, microseconds of a timestamp, and whole numbers as they are."""
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    return column.cast("long")


def _spans(df: DataFrame, span: tuple[str, str], mark: str) -> DataFrame:
    """df as one struct with the bounds of its intervals and their level: the smallest with buckets longer than the interval."""
    start, end = (_number(F.col(c), df.schema[c].dataType).alias(f"{mark}{n}") for c, n in zip(span, ("start", "end"), strict=True))
    rows = df.select(F.struct(*df.columns).alias(f"{mark}row"), start, end).where(f"{mark}start <= {mark}end")
    return rows.withColumn(f"{mark}level", F.expr(f"cast(length(bin({mark}end - {mark}start)) as int)"))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: dict[str, str] | None = None) -> DataFrame:
    """Pairs of rows whose intervals (both ends count) overlap, with equal values in the columns `by` (left to right).

    Bounds are dates, timestamps or whole numbers; a point has the same column twice.  Intervals are binned at every level
    of length that occurs and is no shorter than their own, so each lies in two buckets of a level at most, however long it
    is; two intervals meet at the longer one's level, in the first bucket that they share, so that each pair is found once,
    by an equi-join.  Null bounds, null keys and intervals that end before they start have no partner.  Columns of both sides must have different names.
    """
    if twice := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {', '.join(sorted(twice))}")
    by = by or {}
    sides = [_spans(left, left_span, "l"), _spans(right, right_span, "r")]
    found = sides[0].select(F.col("llevel").alias("v")).union(sides[1].select("rlevel")).distinct().collect()  # 64 at most
    levels = F.array(*[F.lit(v) for v in sorted(r["v"] for r in found)]).cast("array<int>")
    binned = []
    for side, mark, keys in zip(sides, "lr", (list(by), list(by.values())), strict=True):
        own = side.withColumn("at", F.explode(F.filter(levels, lambda v: v >= F.col(f"{mark}level"))))  # noqa: B023  called at once
        first, last = (F.expr(f"shiftright({mark}{c}, at)") for c in ("start", "end"))
        own = own.withColumn(f"{mark}first", first).withColumn("bucket", F.explode(F.sequence(f"{mark}first", last)))
        binned.append(own.withColumns({f"__k{i}": F.col(f"{mark}row.{k}") for i, k in enumerate(keys)}))
    pairs = binned[0].join(binned[1], ["at", "bucket", *[f"__k{i}" for i in range(len(by))]])
    once = (F.col("at") == F.greatest("llevel", "rlevel")) & (F.col("bucket") == F.greatest("lfirst", "rfirst"))
    return pairs.where(once & (F.col("lstart") <= F.col("rend")) & (F.col("rstart") <= F.col("lend"))).select("lrow.*", "rrow.*")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: dict[str, str], ties: list[str]) -> DataFrame:
    """Every row of left with the last row of right at or before its time, of those with equal keys `by` (left to right).

    Of right's rows of the same moment the one with the largest `ties` counts.  A left row without one, or with a null key
    or time, has nulls.  Both sides are stacked and dealt out by ranges of key and time, so that a key with very many rows
    lies in many ranges; the last row of right is carried on within each range, and from the ranges before it by their last
    rows alone.  Columns of both sides must have different names.
    """
    if twice := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {', '.join(sorted(twice))}")
    keys = [f"__k{i}" for i in range(len(by))]
    shape = right.schema
    value = F.struct(*[F.col(c) for c in (*ties, *[c for c in shape.names if c not in ties])])
    kind = right.select(value.alias("v")).schema["v"].dataType
    lefts = left.select(*[F.col(k).alias(n) for k, n in zip(by, keys, strict=True)], _number(F.col(left_time), left.schema[left_time].dataType).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("l"), F.lit(None).cast(kind).alias("r"))
    rights = right.select(*[F.col(k).alias(n) for k, n in zip(by.values(), keys, strict=True)], _number(F.col(right_time), shape[right_time].dataType).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(lefts.schema["l"].dataType).alias("l"), value.alias("r"))
    rights = rights.where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, "__t")]))
    both = lefts.union(rights)
    ranges = max(1, -(-both.count() // RANGE_ROWS))
    dealt = both.repartitionByRange(ranges, *keys, "__t", "__side") if ranges > 1 else both.coalesce(1)
    placed = written(dealt.withColumn("__range", F.spark_partition_id()), "asof")
    within = Window.partitionBy(*keys, "__range").orderBy("__t", "__side", "r").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.where("__side = 0").groupBy(*keys, "__range").agg(F.max_by("r", F.struct("__t", "r")).alias("end"))
    everywhere = placed.select(*keys, "__range").distinct().join(ends, [*keys, "__range"], "left")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = everywhere.withColumn("carried", F.last("end", ignorenulls=True).over(before)).drop("end")
    found = placed.withColumn("found", F.last("r", ignorenulls=True).over(within)).where("__side = 1").join(carried, [*keys, "__range"], "left")
    got = F.when(F.col("__t").isNotNull(), F.coalesce("found", "carried"))
    return found.withColumn("got", got).select("l.*", *[F.col(f"got.{c}").alias(c) for c in shape.names])
