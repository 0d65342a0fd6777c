"""A catalog and its rules from a folder of JSON files, and table schemas from a catalog."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.types import DateType, DecimalType, IntegerType, LongType, StringType, StructField, StructType

from tarnwell.plans.model import Catalog, Dimension, Formula, Metric, OutputHint, Policy, Table
from tarnwell.plans.rules import Rule

#: What the files call a polarity and what questions call it.
POLARITY = {"positive": "above", "negative": "below"}
FILES = ("dimensions", "metrics", "formulas", "tables", "business_rules")


@dataclass
class Metadata:
    catalog: Catalog
    rules: list[Rule]
    domain_context: str = ""
    metric_hints: list[dict] = field(default_factory=list)
    having_patterns: list[dict] = field(default_factory=list)
    displays: dict[str, str] = field(default_factory=dict)


def _trigger(t: dict) -> tuple:
    kind = t["type"]
    match kind:
        case "keyword":
            return (kind, *t.get("phrases", []))
        case "having_pattern":
            return ("having", t["having_type"], *[POLARITY[p] for p in [t.get("polarity")] if p])
        case "formula_requested":
            return (kind, *[f for f in [t.get("formula")] if f])
        case "metric_present":
            return (kind, *t.get("metrics", []))
        case "dimension_present":
            return (kind, *t.get("dimensions", []))
        case "metric_category":
            return (kind, t["category"])
        case "compound" | "any_of":
            return ("all_of" if kind == "compound" else kind, *map(_trigger, t.get("conditions", [])))
    raise ValueError(f"unknown trigger {kind}")


def _action(a: dict) -> tuple:
    kind = a["type"]
    match kind:
        case "ensure_metrics":
            return (kind, *a.get("metrics", []))
        case "ensure_dimensions":
            return (kind, *a.get("dimensions", []))
        case "ensure_formula":
            return (kind, a["formula"])
        case "create_formula":
            return (kind, a["name"], a["expression"], *a.get("components", []))
        case "override_formula":
            return (kind, a["formula"], a["expression"], *a.get("components", []))
        case "set_output_hint":
            columns = [tuple(a.get(c, [])) for c in ("columns", "primary_columns", "secondary_columns")]
            return ("output_hint", OutputHint(a.get("format") or "table", *columns, a.get("always_programmatic_enumeration", False)))
        case "set_channel":
            return (kind, *a.get("channels", []))
        case "set_sort":
            return (kind, a.get("metric"), a.get("direction") or "DESC")
    raise ValueError(f"unknown action {kind}")


def parsed(files: dict[str, dict], policy: Policy | None = None) -> Metadata:
    """The catalog, rules and texts that the five files describe."""
    tup = lambda d, k: tuple(d.get(k) or ())
    named = lambda kind, make: [make(d) for d in files[kind].get(kind, [])]
    dims = named("dimensions", lambda d: Dimension(d["name"], d.get("db_column"), tup(d, "aliases"), tup(d, "table_affinity"), tup(d, "primary_tables"), d.get("hierarchy_name"), d.get("hierarchy_level") or 0, d.get("filter_mode") == "ilike", bool(d.get("skip_null_exclusion"))))
    metrics = named("metrics", lambda m: Metric(m["name"], m.get("db_column"), m.get("aggregate_fn") or "SUM", m["category"], tup(m, "aliases"), m.get("formula_ref"), tup(m, "table_affinity")))
    formulas = named("formulas", lambda f: Formula(f["name"], f["expression"], tup(f, "components"), tup(f, "runtime_vars"), bool(f.get("window"))))

    def offered(t: dict) -> tuple[str, ...]:
        """A table's own metrics, and the formulas whose components it has."""
        own = tup(t, "metrics")
        return (*own, *[f.name for f in formulas if f.name not in own and f.components and set(f.components) <= set(own)])

    tables = named("tables", lambda t: Table(t["name"], t["channel"], t.get("variant"), t.get("date_column"), t.get("date_mode") or "range", tup(t, "dimensions"), offered(t), "", t.get("description") or ""))
    rules = files["business_rules"]
    made = [Rule(_trigger(r["trigger"]), tuple(map(_action, r.get("actions", []))), r["name"]) for r in rules.get("rules", [])]
    catalog = Catalog.of(dims, metrics, formulas, tables, policy)
    displays = {f["name"]: f.get("display", f["name"]) for f in files["formulas"].get("formulas", [])}
    hints = [h | {"polarity": POLARITY[h["polarity"]]} if h.get("polarity") else h for h in rules.get("metric_hints", [])]
    return Metadata(catalog, made, rules.get("domain_context", ""), hints, rules.get("having_patterns", []), displays)


def load(spark: SparkSession, folder: str, policy: Policy | None = None, check: bool = True) -> Metadata:
    """Read the five files of a folder that Spark can read; references to what isn't declared are an error."""
    rows = {n: spark.read.text(f"{folder}/{n}.json", wholetext=True).first()[0] for n in FILES}
    found = parsed({n: json.loads(t) or {} for n, t in rows.items()}, policy)
    if check and (wrong := [p for p in found.catalog.problems() if "no dimension" not in p]):
        raise ValueError("; ".join(wrong))
    return found


def metric_hint(question: str, metadata: Metadata) -> dict | None:
    """The first hint whose phrase the question holds."""
    low = question.lower()
    return next((h for h in metadata.metric_hints if h["phrase"].lower() in low), None)


def table_schema(table: Table, catalog: Catalog, integers: Callable[[str], bool] = lambda column: column.endswith(("_id", "_count", "quantity"))) -> StructType:
    """The columns that a table needs: a key, its date, its dimensions as text and its stored metrics as numbers."""
    stored = dict.fromkeys(catalog.metrics[m].column for m in table.metrics if m in catalog.metrics and catalog.metrics[m].column)
    columns = [StructField("id", LongType(), False), StructField(table.date_column or "created_at", DateType(), False)]
    columns += [StructField(catalog.dimensions[d].column, StringType()) for d in table.dimensions if d in catalog.dimensions and catalog.dimensions[d].column]
    return StructType(columns + [StructField(c, IntegerType() if integers(c) else DecimalType(15, 2)) for c in stored])
