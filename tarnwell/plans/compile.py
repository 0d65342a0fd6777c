"""A question to one lazy DataFrame for each table and hierarchy level, merged by channel."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnwell.functions.formulas import aggregate, column_of
from tarnwell.operators.merge import merge, ordered, shared_keys
from tarnwell.plans.model import Catalog, Dimension, Formula, Frame, Intent, Table, framed
from tarnwell.plans.routing import route
from tarnwell.plans.rules import Rule, completed, enrich

#: Strings that stand for a missing value in a dimension.
PLACEHOLDERS = ("-", "N.A.", "NA", "N/A")
#: Rows fetched from a table where a limit is wanted.
FETCH_LIMIT = 100
COMPARE = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}


@dataclass(frozen=True)
class Branch:
    label: str | None
    channel: str
    table: str
    df: DataFrame


def expanded(intent: Intent, catalog: Catalog) -> list[Intent]:
    """One labelled question for each concrete level of a virtual dimension, or of a virtual filter if no dimension is asked for."""
    virtual = lambda d: d in catalog.dimensions and not catalog.dimensions[d].column
    if not intent.dimensions and (found := [f for f in intent.filters if virtual(f[0])]):
        out = []
        for d, value in found:
            rest = tuple(f for f in intent.filters if f != (d, value))
            out += [replace(intent, dimensions=(x.name,), filters=(*rest, (x.name, value)), label=x.name) for x in catalog.levels(catalog.dimensions[d].hierarchy)]
        return out
    if found := [d for d in intent.dimensions if virtual(d)]:
        return [replace(intent, dimensions=tuple(x.name if y == d else y for y in intent.dimensions), label=x.name) for d in found for x in catalog.levels(catalog.dimensions[d].hierarchy)]
    return [intent]


def _filter(df: DataFrame, dim: Dimension, value: str, table: Table, catalog: Catalog) -> Column | None:
    if not dim.column:
        levels = [x for x in catalog.levels(dim.hierarchy) if x.name in table.dimensions and x.column in df.columns]
        return reduce(or_, [F.col(x.column).cast("string").ilike(f"%{value}%") for x in levels]) if levels else None
    if dim.name not in table.dimensions:
        return None
    c = F.col(dim.column)
    return c.cast("string").ilike(f"%{value}%") if dim.substring else c == F.lit(value)


def _present(df: DataFrame, dim: Dimension) -> Column:
    c = F.col(dim.column)
    plain = dim.keep_placeholders or not isinstance(df.schema[dim.column].dataType, StringType)
    return c.isNotNull() if plain else c.isNotNull() & ~c.isin(*PLACEHOLDERS)


def _needed(intent: Intent, table: Table, catalog: Catalog) -> set[str]:
    """Columns of a table that a question reads."""
    dims = [catalog.dimensions[d] for d in (*intent.dimensions, *[f for f, _ in intent.filters]) if d in catalog.dimensions]
    levels = [x for d in dims for x in ([d] if d.column else catalog.levels(d.hierarchy)) if x.name in table.dimensions]
    names = {*intent.metrics, *intent.formulas, *[x for a, _, b in (intent.having.conditions if intent.having else ()) for x in (a, b)]}
    for _ in range(2):  # a metric may stand for a formula, and a formula for metrics
        names |= {catalog.metrics[n].formula for n in names if n in catalog.metrics and catalog.metrics[n].formula}
        names |= {c for n in names if n in catalog.formulas for c in catalog.formulas[n].components}
    return {x.column for x in levels} | {catalog.metrics[n].column for n in names if n in catalog.metrics and catalog.metrics[n].column} | ({table.date_column} if table.date_column else set())


def _offered(formula: Formula, table: Table) -> bool:
    """A formula that a table doesn't list is there all the same if the table has all of its components."""
    return bool(formula.components) and set(formula.components) <= set(table.metrics)


def compile_table(intent: Intent, table: Table, frame: Frame, catalog: Catalog, runtime: dict[str, float] | None = None, fetch_limit: int | None = None) -> DataFrame | None:
    """The question's aggregate over one table, or None if the table has nothing of what is asked.

    Rows whose grouped dimensions are null or placeholders don't count.  Without dimensions the result is one row, also on an
    empty table.  `data_as_of` is the latest date behind each row.  fetch_limit (FETCH_LIMIT, for example) bounds the rows
    only if it is given: the first by the question's sort, else by all its metrics and formulas, largest first.  Groups
    with a gap to a target are ordered by the gap.
    """
    dims = [catalog.dimensions[d] for d in intent.dimensions if d in table.dimensions and catalog.dimensions[d].column]
    sfx, out = catalog.policy.suffix(table), {}
    for m in intent.metrics:
        if m in table.metrics and (x := catalog.metrics.get(m)):
            col = aggregate(x) if x.column else column_of(catalog.formulas[x.formula], catalog, runtime) if x.formula in catalog.formulas else None
            if col is not None:
                out[m + sfx] = col
    for f in intent.formulas:
        if f in catalog.formulas and (f in table.metrics or _offered(catalog.formulas[f], table)) and (col := column_of(catalog.formulas[f], catalog, runtime)) is not None:
            out[f.lower().replace(" ", "_") + sfx] = col
    if (intent.metrics or intent.formulas) and not out or intent.dimensions and not dims or not dims and not out:
        return None

    df = framed(frame, _needed(intent, table, catalog))
    wheres = [x for d, v in intent.filters if d in catalog.dimensions and (x := _filter(df, catalog.dimensions[d], v, table, catalog)) is not None]
    wheres += [_present(df, d) for d in dims]
    if table.date_column:
        day = F.to_date(table.date_column)
        if intent.date_range:
            wheres.append(catalog.policy.date_filter(table, day, intent.date_range, frame))
        elif table.date_mode == "snapshot":
            wheres.append(catalog.policy.snapshot_filter(table, day, frame))
        out["data_as_of"] = F.max(day)
    if wheres:
        df = df.where(reduce(and_, wheres))

    hidden, keep, gap = {}, None, False
    if intent.having:
        known = {m: catalog.metrics[m] for m in catalog.metrics if m in table.metrics and catalog.metrics[m].column}
        h = intent.having
        if h.kind == "metric_comparison":
            tests = []
            for k, (a, op, b) in enumerate(h.conditions):
                if a in known and b in known and op in COMPARE:
                    hidden |= {f"__a{k}": aggregate(known[a]), f"__b{k}": aggregate(known[b])}
                    tests.append(COMPARE[op](F.col(f"__a{k}"), F.col(f"__b{k}")))
            keep = reduce(and_ if h.connector.upper() == "AND" else or_, tests) if tests else None
        elif h.kind == "vs_average":
            name = next((x for x in ([h.conditions[0][0]] if h.conditions else intent.metrics) if x in known), None)
            if name:
                hidden["__a0"] = aggregate(known[name])
                mean = framed(frame, {known[name].column}).agg(F.avg(known[name].column).alias("m")).scalar()
                keep = COMPARE[h.operator or (">" if h.polarity == "above" else "<")](F.col("__a0"), mean)
        elif h.kind == "gap_to_target" and h.conditions and h.conditions[0][0] in known and h.conditions[0][2] in known:
            hidden["__gap"] = F.abs(aggregate(known[h.conditions[0][2]]) - aggregate(known[h.conditions[0][0]]))
            keep, gap = F.col("__gap") > 0, True

    made = [c.alias(n) for n, c in (out | hidden).items()]
    res = df.groupBy(*[F.col(d.column) for d in dims]).agg(*made) if dims else df.agg(*made)
    if keep is not None:
        res = res.where(keep)
    ties = [F.col(d.column) for d in dims]
    if fetch_limit or gap:
        by = [n for n in out if n != "data_as_of"]
        wanted = [n for n in by if intent.sort and n == intent.sort[0] + sfx]
        first = [F.col("__gap").asc()] if gap else [F.col(n).asc() if intent.sort[1].upper() == "ASC" else F.col(n).desc() for n in wanted] if intent.sort else [F.col(n).desc() for n in by]
        res = res.orderBy(*first, *ties)
    if fetch_limit:
        res = res.limit(fetch_limit)
    return res.drop(*hidden)


def branches(intent: Intent, catalog: Catalog, frames: dict[str, Frame], runtime: dict[str, float] | None = None, fetch_limit: int | None = None, errors: list[tuple[str, str]] | None = None) -> list[Branch]:
    """One branch for each hierarchy level and table; with `errors`, what fails there is noted and the others go on."""
    out = []
    for one in expanded(intent, catalog):
        for name in route(one, catalog):
            try:
                if name in frames and (df := compile_table(one, catalog.tables[name], frames[name], catalog, runtime, fetch_limit)) is not None:
                    df.columns  # noqa: B018  analysed here, so that a faulty branch shows
                    out.append(Branch(one.label, catalog.tables[name].channel, name, df))
            except (AnalysisException, ValueError, KeyError) as e:
                if errors is None:
                    raise
                errors.append((name, str(e)))
    return out


def answer(intent: Intent, catalog: Catalog, frames: dict[str, Frame], rules: list[Rule] = (), runtime: dict[str, float] | None = None, fetch_limit: int | None = None, errors: list[tuple[str, str]] | None = None, across_channels: bool = False) -> dict[tuple[str | None, str], DataFrame]:
    """One lazy DataFrame for each (label, channel): rules, routing, aggregates, merge, then the question's sort and limit.

    Parts without a common dimension are stacked under the channel `merged`.  With across_channels, groups that have a
    channel each are merged into one, too.
    """
    intent, catalog = enrich(completed(intent, catalog), list(rules), catalog)
    intent = completed(intent, catalog)
    groups: dict[tuple[str | None, str], list[tuple[str, DataFrame]]] = {}
    for b in branches(intent, catalog, frames, runtime, fetch_limit, errors):
        groups.setdefault((b.label, b.channel), []).append((b.channel, b.df))
    keys = {d.column for d in catalog.dimensions.values() if d.column}
    merged = {}
    for (label, channel), parts in groups.items():
        stacked = len(parts) > 1 and not shared_keys(parts, keys)
        merged[label, "merged" if stacked else channel] = merge(parts, keys)
    if across_channels and len(merged) > 1 and len({c for _, c in merged}) == len(merged):
        merged = {(None, "merged"): merge([(c, df) for (_, c), df in merged.items()], keys)}
    return {k: ordered(df, intent.sort, intent.limit, [c for c in df.columns if c in keys]) for k, df in merged.items()}
