"""A catalog over the driver's tables: flat views of order lines, orders and events, with derived measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwell.plans.model import Catalog, Dimension, Formula, Frame, Metric, Policy, Table
from tarnwell.plans.rules import Rule

#: The day as of which period measures are taken, so that every engine sees the same periods.
AS_OF = "2001-06-15"

_LINE_REVENUE = "l.l_extendedprice * (1 - l.l_discount)"
_WHEN = lambda test: f"case when {test} then {_LINE_REVENUE} else 0e0 end"
_DAY = "cast(l.l_shipdate as date)"
#: Columns of a view, each with the table from which it comes.
LINE_COLUMNS = {
    "region": ("r", "r.r_name"), "nation": ("n", "n.n_name"), "part_type": ("p", "p.p_type"), "brand": ("p", "p.p_brand"), "segment": ("c", "c.c_mktsegment"), "priority": ("o", "o.o_orderpriority"), "return_flag": ("l", "l.l_returnflag"),
    "order_id": ("l", "l.l_orderkey"), "quantity": ("l", "l.l_quantity"), "ship_day": ("l", _DAY), "revenue": ("l", _LINE_REVENUE), "cost": ("p", "p.p_retailprice * l.l_quantity * 0.6e0"), "discount": ("l", "l.l_extendedprice * l.l_discount"),
    "returns_value": ("l", _WHEN("l.l_returnflag = 'R'")), "target_revenue": ("l", "l.l_extendedprice * (0.90e0 + 0.01e0 * (l.l_partkey % 11))"), "prev_revenue": ("l", _WHEN(f"l.l_shipdate < date '{AS_OF}' - interval '365' day")),
    "mtd_revenue": ("l", _WHEN(f"{_DAY} between date '2001-06-01' and date '{AS_OF}'")), "prev_mtd_revenue": ("l", _WHEN(f"{_DAY} between date '2000-06-01' and date '2000-06-15'")),
    "ytd_revenue": ("l", _WHEN(f"{_DAY} between date '2001-01-01' and date '{AS_OF}'")), "prev_ytd_revenue": ("l", _WHEN(f"{_DAY} between date '2000-01-01' and date '2000-06-15'")),
}
ORDER_COLUMNS = {
    "region": ("r", "r.r_name"), "nation": ("n", "n.n_name"), "segment": ("c", "c.c_mktsegment"), "priority": ("o", "o.o_orderpriority"), "order_id": ("o", "o.o_orderkey"), "order_day": ("o", "cast(o.o_orderdate as date)"), "revenue": ("o", "o.o_totalprice"), "target_revenue": ("o", "o.o_totalprice * 0.95e0"),
}
#: How a table is reached: the one before it, and the join.
_JOINS = {"o": ("l", "orders o on l.l_orderkey = o.o_orderkey"), "c": ("o", "customer c on o.o_custkey = c.c_custkey"), "n": ("c", "nation n on c.c_nationkey = n.n_nationkey"), "r": ("n", "region r on n.n_regionkey = r.r_regionkey"), "p": ("l", "part p on l.l_partkey = p.p_partkey")}


def view_sql(columns: dict[str, tuple[str, str]], fact: str, wanted: set[str] | None = None) -> str:
    """The view with the wanted columns (all without any) and the joins that they need; Spark SQL and DuckDB both run it.

    Keys of the fact table have a row in each dimension table, so a join that brings no column changes nothing.
    """
    names = [c for c in columns if wanted is None or c in wanted] or [next(iter(columns))]
    mark, needed = fact[0], set()
    for c in names:
        at = columns[c][0]
        while at != mark:
            needed.add(at)
            at = _JOINS[at][0]
    joins = [f"join {text}" for t, (_, text) in _JOINS.items() if t in needed]
    return " ".join([f"select {', '.join(f'{columns[c][1]} as {c}' for c in names)} from {fact} {mark}", *joins])


LINE_SQL, ORDER_SQL = view_sql(LINE_COLUMNS, "lineitem"), view_sql(ORDER_COLUMNS, "orders")
EVENT_SQL = "select event_type, user_id, event_id, cast(ts as date) as day, value from events"

_LINES = ("sales_line", "sales_line_value", "sales_line_volume")
_pct = lambda name, template, *parts: Formula(name, template, parts)

DIMENSIONS = [
    Dimension("location", None, ("place",), hierarchy="geo"),
    Dimension("region", "region", ("zone", "area"), (*_LINES, "sales_order"), hierarchy="geo", level=1),
    Dimension("nation", "nation", ("country",), (*_LINES, "sales_order"), hierarchy="geo", level=2, substring=True),
    Dimension("part_type", "part_type", ("category",), _LINES, hierarchy="product", level=1),
    Dimension("brand", "brand", (), _LINES, hierarchy="product", level=2),
    Dimension("segment", "segment", ("customer segment",), (*_LINES, "sales_order")),
    Dimension("priority", "priority", (), (*_LINES, "sales_order")),
    Dimension("return_flag", "return_flag", (), ("sales_line",)),
    Dimension("event_type", "event_type", (), ("events_daily",)),
]
_STORED = ("revenue", "cost", "quantity", "discount", "returns_value", "target_revenue", "prev_revenue", "mtd_revenue", "prev_mtd_revenue", "ytd_revenue", "prev_ytd_revenue")
METRICS = [
    *[Metric(m, m, category="cumulative" if m.startswith(("mtd", "ytd", "prev")) else "absolute", tables=("sales_line", "sales_line_value", "sales_order") if m in ("revenue", "target_revenue") else (*_LINES,) if m == "quantity" else ("sales_line",)) for m in _STORED],
    Metric("orders_count", "order_id", "COUNT", aliases=("number of orders",), tables=("sales_line", "sales_order")),
    Metric("avg_quantity", "quantity", "AVG", "average", tables=("sales_line",)),
    Metric("event_value", "value", tables=("events_daily",)),
    Metric("events_count", "event_id", "COUNT", tables=("events_daily",)),
]
# Names and expressions of the formula catalogue.
FORMULAS = [
    _pct("profit_margin_pct", "(SUM({revenue}) - SUM({cost})) / NULLIF(SUM({revenue}), 0) * 100", "revenue", "cost"),
    _pct("revenue_growth_pct", "(SUM({revenue}) / NULLIF(SUM({prev_revenue}), 0) - 1) * 100", "revenue", "prev_revenue"),
    _pct("target_achievement_pct", "SUM({revenue}) / NULLIF(SUM({target_revenue}), 0) * 100", "revenue", "target_revenue"),
    _pct("mtd_achievement_pct", "SUM({mtd_revenue}) / NULLIF(SUM({target_revenue}), 0) * 100", "mtd_revenue", "target_revenue"),
    _pct("mtd_growth_pct", "(SUM({mtd_revenue}) / NULLIF(SUM({prev_mtd_revenue}), 0) - 1) * 100", "mtd_revenue", "prev_mtd_revenue"),
    _pct("ytd_achievement_pct", "SUM({ytd_revenue}) / NULLIF(SUM({target_revenue}), 0) * 100", "ytd_revenue", "target_revenue"),
    _pct("ytd_growth_pct", "(SUM({ytd_revenue}) / NULLIF(SUM({prev_ytd_revenue}), 0) - 1) * 100", "ytd_revenue", "prev_ytd_revenue"),
    _pct("return_rate_pct", "SUM({returns_value}) / NULLIF(SUM({revenue}), 0) * 100", "returns_value", "revenue"),
    _pct("discount_rate_pct", "SUM({discount}) / NULLIF(SUM({revenue}) + SUM({discount}), 0) * 100", "discount", "revenue"),
    _pct("revenue_saliency_pct", "SUM({revenue}) / NULLIF(SUM(SUM({revenue})) OVER (), 0) * 100", "revenue"),
    _pct("avg_order_value", "SUM({revenue}) / NULLIF(COUNT({orders_count}), 0)", "revenue", "orders_count"),
    _pct("revenue_gap_to_target", "SUM({target_revenue}) - SUM({revenue})", "target_revenue", "revenue"),
    Formula("revenue_run_rate", "SUM({mtd_revenue}) / NULLIF({days_elapsed}, 0) * {total_days}", ("mtd_revenue",), ("days_elapsed", "total_days")),
    Formula("required_daily_revenue", "(SUM({target_revenue}) - SUM({mtd_revenue})) / NULLIF({days_remaining}, 0)", ("target_revenue", "mtd_revenue"), ("days_remaining",)),
    _pct("mtd_revenue_gap", "SUM({target_revenue}) - SUM({mtd_revenue})", "target_revenue", "mtd_revenue"),
    _pct("revenue_variance", "SUM({revenue}) - SUM({prev_revenue})", "revenue", "prev_revenue"),
]
_ALL_DIMS = ("region", "nation", "part_type", "brand", "segment", "priority")
TABLES = [
    Table("sales_line", "primary", None, "ship_day", "range", (*_ALL_DIMS, "return_flag"), (*_STORED, "orders_count", "avg_quantity", *[f.name for f in FORMULAS])),
    Table("sales_order", "secondary", None, "order_day", "range", ("region", "nation", "segment", "priority"), ("revenue", "target_revenue", "orders_count")),
    Table("sales_line_value", "variants", "value", None, "range", _ALL_DIMS, ("revenue", "target_revenue", "quantity"), "_val"),
    Table("sales_line_volume", "variants", "volume", None, "range", _ALL_DIMS, ("quantity",), "_vol"),
    Table("events_daily", "events", None, "day", "snapshot", ("event_type",), ("event_value", "events_count")),
]
RULES = [
    Rule(("keyword", "margin", "profit"), (("ensure_formula", "profit_margin_pct"),)),
    Rule(("metric_category", "cumulative"), (("ensure_formula", "mtd_growth_pct"),)),
    Rule(("keyword", "best"), (("set_sort", "revenue", "DESC"),)),
    Rule(("any_of", ("keyword", "worst"), ("keyword", "best")), (("set_sort", "revenue", "ASC"),)),
]


def catalog() -> Catalog:
    return Catalog.of(DIMENSIONS, METRICS, FORMULAS, TABLES, Policy(("revenue",), ("sales_line",)))


def frames(spark: SparkSession, sf_dir: str) -> dict[str, Frame]:
    """The flat views, made from those tables that a question's columns need; joins are left to Catalyst."""
    args = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "region", "part", "events")}

    def view(columns: dict[str, tuple[str, str]], fact: str) -> Frame:
        def made(wanted: set[str] | None = None) -> DataFrame:
            sql = view_sql(columns, fact, wanted)
            names = tuple(n for n in args if f"from {n} " in sql or f"join {n} " in sql)
            return spark.sql(_named(sql, names), **{n: args[n] for n in names})

        return made

    line, order = view(LINE_COLUMNS, "lineitem"), view(ORDER_COLUMNS, "orders")
    return {"sales_line": line, "sales_line_value": line, "sales_line_volume": line, "sales_order": order, "events_daily": spark.sql(_named(EVENT_SQL, ("events",)), events=args["events"])}


def _named(text: str, names: tuple[str, ...]) -> str:
    """Table names as parameters, so that no temporary view is left behind."""
    for n in names:
        text = text.replace(f"from {n}", f"from {{{n}}}").replace(f"join {n} ", f"join {{{n}}} ")
    return text
