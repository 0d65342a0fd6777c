"""Levels of hierarchies as grouping sets: one scan answers for every level, for rollups and for cubes."""

from __future__ import annotations

import itertools
import re
from dataclasses import replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnwell.functions.formulas import aggregate, sql_of
from tarnwell.operators.merge import merge
from tarnwell.plans.compile import PLACEHOLDERS, _filter, _needed, _offered
from tarnwell.plans.model import Catalog, Dimension, Frame, Intent, Table, framed
from tarnwell.plans.routing import route
from tarnwell.plans.rules import Rule, completed, enrich

#: The label of the set without dimensions.
TOTAL = "all"


def _choices(levels: list[str], how: str) -> list[tuple[str, ...]]:
    if how == "levels":
        return [(x,) for x in levels]
    if how == "rollup":
        return [tuple(levels[:k]) for k in range(len(levels), -1, -1)]
    if how == "cube":
        return [c for k in range(len(levels), -1, -1) for c in itertools.combinations(levels, k)]
    raise ValueError(f"levels, rollup or cube, not {how}")


def grouping_sets(intent: Intent, catalog: Catalog, how: str = "levels") -> tuple[list[tuple[str, ...]], dict[str, str]]:
    """The sets of dimensions that a question with virtual dimensions asks for, and the filter value of each level.

    A virtual dimension stands for its hierarchy: each level by itself (levels), the levels from the top down and their total
    (rollup), or all combinations (cube); several hierarchies are crossed.  Without dimensions, virtual filters give the
    levels, each filtered by itself.
    """
    virtual = lambda d: d in catalog.dimensions and not catalog.dimensions[d].column
    names = lambda d: [x.name for x in catalog.levels(catalog.dimensions[d].hierarchy)]
    if not intent.dimensions:
        found = [(d, v) for d, v in intent.filters if virtual(d)]
        return [(x,) for d, _ in found for x in names(d)], {x: v for d, v in found for x in names(d)}
    each = [_choices(names(d), how) if virtual(d) else [(d,)] for d in intent.dimensions]
    sets = [tuple(dict.fromkeys(itertools.chain(*s))) for s in itertools.product(*each)]
    return list(dict.fromkeys(sets)), {}


def _by_sets(intent: Intent, table: Table, frame: Frame, catalog: Catalog, sets: list[tuple[str, ...]], own: dict[str, str], runtime: dict[str, float] | None) -> DataFrame | None:
    """The question's aggregate over one table by several sets of dimensions, read once, with the label of each set."""
    dims: list[Dimension] = [catalog.dimensions[d] for d in dict.fromkeys(itertools.chain(*sets))]
    sfx, out = catalog.policy.suffix(table), {}
    for m in intent.metrics:
        if m in table.metrics and m in catalog.metrics and catalog.metrics[m].column:
            out[m + sfx] = aggregate(catalog.metrics[m])
    formulas = [*intent.formulas, *[catalog.metrics[m].formula for m in intent.metrics if m in catalog.metrics and not catalog.metrics[m].column]]
    for f in formulas:
        if f in catalog.formulas and (f in table.metrics or _offered(catalog.formulas[f], table)) and (sql := sql_of(catalog.formulas[f], catalog, runtime)):
            out[f.lower().replace(" ", "_") + sfx] = F.expr(re.sub(r"OVER\s*\(\s*\)", "OVER (PARTITION BY grouping_id())", sql, flags=re.I))  # totals of a set
    if not out or not dims:
        return None
    plain = [f for f in intent.filters if f[0] in catalog.dimensions and (catalog.dimensions[f[0]].column or not own)]
    df = framed(frame, _needed(replace(intent, dimensions=tuple(d.name for d in dims), filters=tuple(plain)), table, catalog))
    wheres = [x for d, v in plain if (x := _filter(df, catalog.dimensions[d], v, table, catalog)) is not None]
    if own:
        wheres.append(reduce(or_, [_filter(df, d, own[d.name], table, catalog) for d in dims if d.name in own]))
    if table.date_column:
        day = F.to_date(table.date_column)
        if intent.date_range:
            wheres.append(catalog.policy.date_filter(table, day, intent.date_range, frame))
        elif table.date_mode == "snapshot":
            wheres.append(catalog.policy.snapshot_filter(table, day, frame))
        out["data_as_of"] = F.max(day)
    if wheres:
        df = df.where(reduce(and_, wheres))
    # a placeholder is like null: it is no member of its level, but its rows count for the other levels
    hollow = [d for d in dims if not d.keep_placeholders and isinstance(df.schema[d.column].dataType, StringType)]
    df = df.withColumns({d.column: F.when(~F.col(d.column).isin(*PLACEHOLDERS), F.col(d.column)) for d in hollow})
    flags = {d.name: F.grouping(d.column).alias(f"__g_{d.name}") for d in dims}
    made = df.groupingSets([[F.col(catalog.dimensions[d].column) for d in s] for s in sets], *[F.col(d.column) for d in dims]).agg(*[c.alias(n) for n, c in out.items()], *flags.values())
    away = {d.name: F.col(f"__g_{d.name}") == 1 for d in dims}
    keep = [away[d.name] | F.col(d.column).isNotNull() for d in dims]
    keep += [away[d.name] | _filter(made, d, own[d.name], table, catalog) for d in dims if d.name in own]
    label = F.coalesce(*[F.when(reduce(and_, [~away[d.name] if d.name in s else away[d.name] for d in dims]), F.lit("+".join(s) or TOTAL)) for s in sets])
    return made.where(reduce(and_, keep)).withColumn("label", label).drop(*[f"__g_{n}" for n in flags])


def answer_levels(intent: Intent, catalog: Catalog, frames: dict[str, Frame], rules: list[Rule] = (), runtime: dict[str, float] | None = None, how: str = "levels") -> DataFrame:
    """One lazy DataFrame with a row for each group of every set of levels: dimensions, values, label and channel.

    A dimension that a set does not group by is null there; label names the set (TOTAL for none).  Each table is read once,
    whatever the number of sets.  Rows whose grouped dimension is null or a placeholder do not count for that set.  A share of
    a total is a share of its set's total.  Tables of a channel are merged by dimensions and label, channels are stacked; the
    question's sort and limit hold within each label and channel.  A question with HAVING is answered by answer().
    """
    intent, catalog = enrich(completed(intent, catalog), list(rules), catalog)
    intent = completed(intent, catalog)
    if intent.having:
        raise ValueError("HAVING holds for one level at a time: use answer()")
    sets, own = grouping_sets(intent, catalog, how)
    by_table: dict[str, list[tuple[str, ...]]] = {}
    for s in sets:
        for name in route(replace(intent, dimensions=s or tuple(dict.fromkeys(itertools.chain(*sets)))), catalog):
            if name in frames and set(s) <= set(catalog.tables[name].dimensions):
                by_table.setdefault(name, []).append(s)
    channels: dict[str, list[tuple[str, DataFrame]]] = {}
    for name, some in by_table.items():
        table = catalog.tables[name]
        if (df := _by_sets(intent, table, frames[name], catalog, some, own, runtime)) is not None:
            channels.setdefault(table.channel, []).append((table.channel, df))
    if not channels:
        raise ValueError("no table answers the question")
    keys = {d.column for d in catalog.dimensions.values() if d.column} | {"label"}
    parts = []
    for channel, dfs in channels.items():
        df = merge(dfs, keys).withColumn("channel", F.lit(channel))
        values = [c for c in df.columns if c not in keys and c not in ("channel", "data_as_of")]
        if intent.limit:
            by = next((c for c in values if intent.sort and c.startswith(intent.sort[0])), values[0])
            first = F.col(by).asc() if intent.sort and intent.sort[1].upper() == "ASC" else F.col(by).desc()
            ties = [F.col(c) for c in df.columns if c in keys]
            df = df.withColumn("__rn", F.row_number().over(Window.partitionBy("label").orderBy(first, *ties))).where(F.col("__rn") <= intent.limit).drop("__rn")
        parts.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
