"""Trees of conditions over dimensions and metrics' columns, as columns that Spark pushes down to the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.plans.compile import COMPARE
from tarnwell.plans.model import Catalog, Frame, framed


class Predicate:
    """A condition; & and | and ~ join conditions.  Nulls are unknown, as in SQL: neither a condition nor its negation holds."""

    def __and__(self, other: Predicate) -> Predicate:
        return All((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Any((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def names(self) -> set[str]:
        raise NotImplementedError

    def column(self, of: dict[str, Column]) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class All(Predicate):
    """All of the parts; without any it is true."""

    parts: tuple[Predicate, ...]

    def names(self) -> set[str]:
        return {n for p in self.parts for n in p.names()}

    def column(self, of: dict[str, Column]) -> Column:
        return reduce(and_, [p.column(of) for p in self.parts]) if self.parts else F.lit(True)


@dataclass(frozen=True)
class Any(Predicate):
    """One of the parts at least; without any it is false."""

    parts: tuple[Predicate, ...]

    def names(self) -> set[str]:
        return {n for p in self.parts for n in p.names()}

    def column(self, of: dict[str, Column]) -> Column:
        return reduce(or_, [p.column(of) for p in self.parts]) if self.parts else F.lit(False)


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def names(self) -> set[str]:
        return self.part.names()

    def column(self, of: dict[str, Column]) -> Column:
        return ~self.part.column(of)


@dataclass(frozen=True)
class Is(Predicate):
    """name operator value; = and <> are there beside the comparisons.  A None is compared as unknown."""

    name: str
    operator: str
    value: object

    def names(self) -> set[str]:
        return {self.name}

    def column(self, of: dict[str, Column]) -> Column:
        c, value = of[self.name], F.lit(self.value)
        if self.operator in ("=", "<>"):
            return c == value if self.operator == "=" else c != value
        if self.operator not in COMPARE:
            raise ValueError(f"no comparison {self.operator}")
        return COMPARE[self.operator](c, value)


@dataclass(frozen=True)
class In(Predicate):
    """One of the values; with a None among them a value that is not found is unknown.  No values: false."""

    name: str
    values: tuple[object, ...]

    def names(self) -> set[str]:
        return {self.name}

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.name].isin(*self.values) if self.values else F.lit(False)


@dataclass(frozen=True)
class Between(Predicate):
    """Both ends count; an end that is None is open."""

    name: str
    low: object = None
    high: object = None

    def names(self) -> set[str]:
        return {self.name}

    def column(self, of: dict[str, Column]) -> Column:
        c = of[self.name]
        ends = [c >= F.lit(self.low)] * (self.low is not None) + [c <= F.lit(self.high)] * (self.high is not None)
        return reduce(and_, ends) if ends else c.isNotNull()


@dataclass(frozen=True)
class Like(Predicate):
    """A pattern of % and _, in any case of letters."""

    name: str
    pattern: str

    def names(self) -> set[str]:
        return {self.name}

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.name].cast("string").ilike(self.pattern)


@dataclass(frozen=True)
class Missing(Predicate):
    """The value is null; never unknown."""

    name: str

    def names(self) -> set[str]:
        return {self.name}

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.name].isNull()


def parsed(tree: dict | list) -> Predicate:
    """A condition from plain data, as a front end sends it: {"and": [...]}, {"or": [...]}, {"not": ...}, {"name": ..., "in":
    [...]}, {"name": ..., "between": [low, high]}, {"name": ..., "like": ...}, {"name": ..., "missing": true}, {"name": ..., ">=": ...}."""
    if "name" not in tree:
        ((kind, of),) = tree.items()
        if kind == "not":
            return Not(parsed(of))
        if kind not in ("and", "or"):
            raise ValueError(f"no condition {kind}")
        return (All if kind == "and" else Any)(tuple(map(parsed, of)))
    name = tree["name"]
    ((kind, of),) = [(k, v) for k, v in tree.items() if k != "name"]
    if kind == "between":
        return Between(name, *of)
    if kind == "missing":
        return Missing(name) if of else Not(Missing(name))
    return In(name, tuple(of)) if kind == "in" else Like(name, of) if kind == "like" else Is(name, kind, of)


def resolved(predicate: Predicate, catalog: Catalog) -> dict[str, str]:
    """The column of each name in a condition: of a dimension, of a metric, or of that name itself."""
    out = {}
    for n in predicate.names():
        known = catalog.canonical(n) or n
        d = catalog.dimensions.get(known) or catalog.metrics.get(known)
        if d is not None and not d.column:
            raise ValueError(f"{n} has no column of its own")
        out[n] = d.column if d is not None else n
    return out


def where(frames: dict[str, Frame], predicate: Predicate, catalog: Catalog) -> dict[str, Frame]:
    """Frames whose rows fulfil a condition, before a question is compiled over them; of tables without one of its columns none is left."""
    columns = resolved(predicate, catalog)

    def kept(frame: Frame) -> Frame:
        def made(wanted: set[str] | None = None) -> DataFrame:
            df = framed(frame, None if wanted is None else wanted | set(columns.values()))
            return df.where(predicate.column({n: F.col(c) for n, c in columns.items()}))

        return made

    return {n: kept(f) for n, f in frames.items() if set(columns.values()) <= set(framed(f).columns)}
