"""Putting results of several tables together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_keys(parts: list[tuple[str, DataFrame]], dimension_columns: set[str]) -> list[str]:
    """Dimension columns that all parts have."""
    return [c for c in parts[0][1].columns if c in dimension_columns and all(c in df.columns for _, df in parts)]


def merge(parts: list[tuple[str, DataFrame]], dimension_columns: set[str]) -> DataFrame:
    """Full outer join on the dimension columns that all parts have; null keys match each other.

    A column that an earlier part has already gets the suffix _<channel>, and a number if that is taken, too.  Parts with no
    key in common are stacked.  One shuffle of already aggregated rows, whatever the number of parts: they are stacked with
    their number and grouped by the keys, so equal keys of one part (none after a grouping) give one row.
    """
    if len(parts) == 1:
        return parts[0][1]
    keys = shared_keys(parts, dimension_columns)
    if not keys:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df for _, df in parts])
    taken, renamed = set(keys), []
    for channel, df in parts:
        names = {}
        for c in df.columns:
            if c in keys:
                continue
            name, k = c, 1
            while name in taken:
                name, k = (f"{c}_{channel}", 2) if name == c else (f"{c}_{channel}_{k}", k + 1)
            taken.add(name)
            names[c] = name
        renamed.append(df.select(*keys, *[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
    return stacked.groupBy(*keys).agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in stacked.columns if c not in keys])


def ordered(df: DataFrame, sort: tuple[str, str] | None, limit: int | None, ties: list[str]) -> DataFrame:
    """Sorted by a column of that name or the first that begins with it; nulls count as largest.  Ties by the dimensions."""
    by = next((c for c in df.columns if sort and (c == sort[0] or c.startswith(f"{sort[0]}_"))), None)
    if by:
        first = F.col(by).asc_nulls_last() if sort[1].upper() == "ASC" else F.col(by).desc_nulls_first()
        df = df.orderBy(first, *[F.col(t).asc_nulls_last() for t in ties])
    return df.limit(limit) if limit else df


def unpivoted(df: DataFrame, ids: list[str], columns: list[str], name: str = "metric", value: str = "amount") -> DataFrame:
    """One row for each of the columns."""
    return df.unpivot(ids, columns, name, value)


def display(df: DataFrame, dimension_columns: set[str], shown: tuple[str, ...]) -> DataFrame:
    """Dimensions first, then the metrics that were asked for, each _val before its _vol."""
    base = lambda c: c[:-4] if c.endswith(("_val", "_vol")) else c
    dims = [c for c in df.columns if c in dimension_columns]
    values = [c for c in df.columns if c not in dims and not c.startswith("data_as_of") and base(c) in shown]
    return df.select(*dims, *sorted(values, key=lambda c: (shown.index(base(c)), c)))


def average_distinct(df: DataFrame, field: str, others: list[str]) -> DataFrame:
    """Mean over the groups of `others` of the number of different values of a field."""
    return df.groupBy(*others).agg(F.countDistinct(field).alias("n")).agg(F.avg("n").alias("mean_distinct"))
