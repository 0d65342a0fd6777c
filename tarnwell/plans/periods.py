"""Measures of periods from raw dates and one as-of date, and analytic frames over days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.plans.model import Frame, framed


#: Whole periods by the name of the period to date.
WHOLE = {"mtd": "month", "qtd": "quarter", "ytd": "year"}


def _year_before(day: date) -> date:
    return day.replace(year=day.year - 1, day=28) if (day.month, day.day) == (2, 29) else day.replace(year=day.year - 1)


def periods(as_of: date) -> dict[str, tuple[date, date]]:
    """First and last day of the month, quarter and year to date, of the same days a year before (prev_), and of the whole
    month, quarter and year before (last_).  The 29th of February has the 28th a year before."""
    start = _starts(as_of)
    out = {name: (day, as_of) for name, day in start.items()}
    out |= {f"prev_{name}": (_year_before(day), _year_before(as_of)) for name, day in start.items()}
    ends = {name: day - timedelta(days=1) for name, day in start.items()}
    return out | {f"last_{WHOLE[name]}": (_starts(day)[name], day) for name, day in ends.items()}


def _starts(day: date) -> dict[str, date]:
    return {"mtd": day.replace(day=1), "qtd": date(day.year, day.month - (day.month - 1) % 3, 1), "ytd": date(day.year, 1, 1)}


def period_columns(value: Column, day: Column, as_of: date, name: str, wanted: tuple[str, ...] = ("mtd", "prev_mtd", "qtd", "prev_qtd", "ytd", "prev_ytd")) -> dict[str, Column]:
    """mtd_<name> and so on: the value on rows of the period, 0 on others (also where the day is null)."""
    found = periods(as_of)
    return {f"{p}_{name}": F.when(day.between(*[F.lit(d) for d in found[p]]), value).otherwise(0.0) for p in wanted}


def with_periods(frame: Frame, as_of: date, day: str, value: str) -> Frame:
    """A frame in which the measures of periods are made from the day and the value, whatever the table has stored."""

    def made(wanted: set[str] | None = None) -> DataFrame:
        names = {f"{p}_{value}" for p in periods(as_of)}
        df = framed(frame, None if wanted is None else (wanted - names) | ({day, value} if wanted & names else set()))
        own = period_columns(F.col(value), F.to_date(day), as_of, value, tuple(periods(as_of)))
        return df.withColumns({n: c for n, c in own.items() if wanted is None or n in wanted})

    return made


def runtime_days(as_of: date) -> dict[str, int]:
    """The runtime variables of a month's run rates: its days in all, elapsed (the as-of day counts) and remaining."""
    after = (as_of.replace(day=28) + timedelta(days=4)).replace(day=1)
    total = (after - timedelta(days=1)).day
    return {"days_elapsed": as_of.day, "total_days": total, "days_remaining": total - as_of.day}


def framed_by_days(rows: DataFrame, by: list[str], day: Column, value: str, width: int = 7, tiles: int = 4) -> DataFrame:
    """A row for each group and day: total, the running sum of the last `width` days (days without rows count), the total to
    date, that of the row before and the change from it, the rank of the day in its group and its tile of `tiles` by total.

    Only daily totals are windowed, a row for each day of a group.  Rows without a day form a day that comes first.
    """
    daily = rows.groupBy(*by, day.alias("day")).agg(F.sum(value).alias("total"))
    number = F.unix_date("day")
    own = Window.partitionBy(*by)
    in_time, by_total = own.orderBy(F.col("day").asc_nulls_first()), own.orderBy(F.desc("total"), "day")
    return daily.withColumns({
        "running": F.sum("total").over(own.orderBy(number).rangeBetween(1 - width, 0)), "to_date": F.sum("total").over(in_time.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag("total").over(in_time),
        "change": F.col("total") - F.lag("total").over(in_time), "place": F.rank().over(own.orderBy(F.desc("total"))), "tile": F.ntile(tiles).over(by_total),
    })
