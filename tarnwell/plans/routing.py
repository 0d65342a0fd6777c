"""Which tables answer a question."""

from __future__ import annotations

from tarnwell.plans.model import Catalog, Intent


def _shared(lists: list[tuple[str, ...]]) -> set[str] | None:
    sets = [set(x) for x in lists if x]  # nothing declared: no opinion
    return set.intersection(*sets) if sets else None


def _of_metric(name: str, catalog: Catalog) -> list[tuple[str, ...]]:
    if name in catalog.formulas:
        f = catalog.formulas[name]
        return [f.tables, *[catalog.metrics[c].tables for c in f.components if c in catalog.metrics]]
    return [catalog.metrics[name].tables] if name in catalog.metrics else []


def route(intent: Intent, catalog: Catalog) -> list[str]:
    """Names of tables, in declared order.  A narrowing that would leave none is not made.

    Dimensions and metrics whose declared tables have none in common are answered by no table; where nothing is declared,
    all tables may answer.
    """
    dims = [catalog.dimensions[d] for d in intent.dimensions if d in catalog.dimensions]
    measures = [x for m in (*intent.metrics, *intent.formulas) for x in _of_metric(m, catalog)]
    names = _shared([d.primary_tables for d in dims] + measures + [d.tables for d in dims if not d.primary_tables])
    names = names or _shared([d.tables for d in dims] + measures)
    if names is None:
        names = set(catalog.tables)

    def narrowed(keep) -> set[str]:
        return {n for n in names if n in catalog.tables and keep(catalog.tables[n])} or names

    if not dims:
        carriers = [set(catalog.dimensions[d].tables) for d, _ in intent.filters if d in catalog.dimensions and catalog.dimensions[d].tables]
        wanted = set.union(*carriers) if carriers else set(catalog.policy.default_tables)
        names = narrowed(lambda t: t.name in wanted)
    channels = intent.channels
    if intent.channel_filter and intent.channel_filter not in channels:
        channels = (intent.channel_filter,)
    if channels:
        names = narrowed(lambda t: t.channel in channels)
    variant = intent.variant or (catalog.policy.default_variant if not dims else None)
    if variant:
        names = narrowed(lambda t: t.variant == variant)
    return [n for n in catalog.tables if n in names]
