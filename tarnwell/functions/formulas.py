"""Formula templates over aggregates, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.plans.model import Catalog, Formula, Metric

#: What a template may hold besides {names}: aggregates, NULLIF, ABS, OVER (), numbers and arithmetic.
_ALLOWED = re.compile(r"\s*(?:(?:SUM|AVG|COUNT|MIN|MAX|NULLIF|ABS|COALESCE|OVER)\b|\d+(?:\.\d+)?|[-+*/(),]|`[^`]+`)", re.I)
#: Values of runtime variables that a caller doesn't give.
RUNTIME = {"days_elapsed": 1, "total_days": 30, "days_remaining": 29}


def aggregate(metric: Metric) -> Column:
    c = F.col(metric.column)
    return {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count}[(metric.aggregate or "SUM").upper()](c)


def sql_of(formula: Formula, catalog: Catalog, runtime: dict[str, float] | None = None) -> str | None:
    """The expression, or None if a placeholder has no value."""
    given = RUNTIME | (runtime or {})
    names = {c: f"`{catalog.metrics[c].column}`" for c in formula.components if c in catalog.metrics and catalog.metrics[c].column}
    names |= {catalog.metrics[c].column: v for c, v in names.items()} | {v: f"{given[v]}" for v in formula.runtime if v in given}
    if any(x not in names for x in re.findall(r"{(\w+)}", formula.template)):
        return None
    sql = re.sub(r"{(\w+)}", lambda m: names[m[1]], formula.template)
    if _ALLOWED.sub("", sql).strip():
        raise ValueError(f"formula {formula.name} holds more than aggregates and arithmetic: {sql}")
    return f"SUM({sql}) OVER ()" if formula.window and "OVER" not in sql.upper() else sql


def column_of(formula: Formula, catalog: Catalog, runtime: dict[str, float] | None = None) -> Column | None:
    sql = sql_of(formula, catalog, runtime)
    return F.expr(sql) if sql else None
