"""Declared metadata (dimensions, metrics, formulas, tables) and the question that is asked of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A table, or what makes it from the columns that are wanted (all without any).
Frame = DataFrame | Callable[[set[str] | None], DataFrame]


def framed(frame: Frame, columns: set[str] | None = None) -> DataFrame:
    return frame if isinstance(frame, DataFrame) else frame(columns)


@dataclass(frozen=True)
class Dimension:
    name: str
    column: str | None = None  # None: virtual, stands for all levels of its hierarchy
    aliases: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    primary_tables: tuple[str, ...] = ()
    hierarchy: str | None = None
    level: int = 0
    substring: bool = False  # filters match substrings
    keep_placeholders: bool = False


@dataclass(frozen=True)
class Metric:
    name: str
    column: str | None = None
    aggregate: str = "SUM"  # SUM, AVG or COUNT
    category: str = "absolute"
    aliases: tuple[str, ...] = ()
    formula: str | None = None
    tables: tuple[str, ...] = ()


@dataclass(frozen=True)
class Formula:
    name: str
    template: str
    components: tuple[str, ...] = ()
    runtime: tuple[str, ...] = ()
    window: bool = False
    aliases: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    channel: str = "default"
    variant: str | None = None
    date_column: str | None = None
    date_mode: str = "range"  # snapshot: without a date range only the latest date counts
    dimensions: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    suffix: str = ""
    description: str = ""


@dataclass(frozen=True)
class OutputHint:
    """How an answer is to be shown."""

    format: str = "table"
    columns: tuple[str, ...] = ()
    primary_columns: tuple[str, ...] = ()
    secondary_columns: tuple[str, ...] = ()
    always_enumerate: bool = False


@dataclass(frozen=True)
class Having:
    """kind: metric_comparison (conditions joined by connector), vs_average or gap_to_target."""

    kind: str
    conditions: tuple[tuple[str, str, str], ...] = ()
    connector: str = "AND"
    polarity: str = "above"
    operator: str | None = None


@dataclass(frozen=True)
class Intent:
    question: str = ""
    dimensions: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    formulas: tuple[str, ...] = ()
    filters: tuple[tuple[str, str], ...] = ()
    date_range: tuple[str, str] | None = None  # YYYYMMDD, both ends count
    having: Having | None = None
    sort: tuple[str, str] | None = None  # name, ASC or DESC
    limit: int | None = None
    channels: tuple[str, ...] = ()
    channel_filter: str | None = None
    variant: str | None = None
    display: tuple[str, ...] = ()
    hint: OutputHint | None = None
    label: str | None = None
    confidence: float = 1.0
    applied_rules: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    """What a deployment may override by subclassing."""

    default_metrics: tuple[str, ...] = ()
    default_tables: tuple[str, ...] = ()
    default_variant: str | None = None
    embedding_threshold: float = 0.0  # share of the best similarity that a table needs in routing by meaning

    def suffix(self, table: Table) -> str:
        return table.suffix

    def date_filter(self, table: Table, day: Column, date_range: tuple[str, str], whole: Frame) -> Column:
        """Rows of a date range; both ends count."""
        return day.between(*[F.to_date(F.lit(x), "yyyyMMdd") for x in date_range])

    def snapshot_filter(self, table: Table, day: Column, whole: Frame) -> Column:
        """Rows of a snapshot table without a date range: those of the latest day of the whole table."""
        return day == framed(whole, {table.date_column}).agg(F.max(F.to_date(table.date_column)).alias("d")).scalar()


@dataclass(frozen=True)
class LatestInRange(Policy):
    """Snapshot tables give the latest day of a date range instead of all its days."""

    def date_filter(self, table: Table, day: Column, date_range: tuple[str, str], whole: Frame) -> Column:
        inside = super().date_filter(table, F.to_date(table.date_column), date_range, whole)
        if table.date_mode != "snapshot":
            return inside
        return day == framed(whole, {table.date_column}).where(inside).agg(F.max(F.to_date(table.date_column)).alias("d")).scalar()


@dataclass
class Catalog:
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)
    formulas: dict[str, Formula] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    policy: Policy = field(default_factory=Policy)

    def __post_init__(self):
        # the last definition of an alias wins
        self.aliases = {a.lower(): x.name for kind in (self.dimensions, self.metrics, self.formulas) for x in kind.values() for a in (x.name, *x.aliases)}

    @staticmethod
    def of(dimensions: Iterable[Dimension], metrics: Iterable[Metric], formulas: Iterable[Formula], tables: Iterable[Table], policy: Policy | None = None) -> Catalog:
        by = lambda xs: {x.name: x for x in xs}
        return Catalog(by(dimensions), by(metrics), by(formulas), by(tables), policy or Policy())

    def canonical(self, name: str) -> str | None:
        return self.aliases.get(name.lower())

    def described(self, kind: str, most: int = 5) -> str:
        """A line for each dimension, metric or formula, with at most so many aliases."""
        names = {"dimensions": self.dimensions, "metrics": self.metrics, "formulas": self.formulas}[kind].values()
        return "\n".join(f"- {x.name}" + (f" ({', '.join(x.aliases[:most])})" if x.aliases else "") for x in names)

    def levels(self, hierarchy: str) -> list[Dimension]:
        """Concrete levels of a hierarchy, in declared order."""
        return [d for d in self.dimensions.values() if d.hierarchy == hierarchy and d.column]

    def with_formula(self, formula: Formula) -> Catalog:
        """A copy for one question; the declared catalog never changes."""
        return Catalog(self.dimensions, self.metrics, self.formulas | {formula.name: formula}, self.tables, self.policy)

    def problems(self, frames: dict[str, Frame] | None = None) -> list[str]:
        """References to what is not declared, and with frames also columns that tables don't have."""
        out = [f"metric {m.name}: no formula {m.formula}" for m in self.metrics.values() if m.formula and m.formula not in self.formulas]
        out += [f"formula {f.name}: no component {c}" for f in self.formulas.values() for c in f.components if c not in self.metrics]
        for t in self.tables.values():
            out += [f"table {t.name}: no dimension {d}" for d in t.dimensions if d not in self.dimensions]
            out += [f"table {t.name}: no metric {m}" for m in t.metrics if m not in self.metrics and m not in self.formulas]
            if frames and t.name in frames:
                columns = framed(frames[t.name]).columns
                wanted = [self.dimensions[d].column for d in t.dimensions if d in self.dimensions] + [self.metrics[m].column for m in t.metrics if m in self.metrics] + [t.date_column]
                out += [f"table {t.name}: no column {c}" for c in wanted if c and c not in columns]
        return out
