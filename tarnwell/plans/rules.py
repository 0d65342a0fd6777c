"""Business rules: ordered rewrites of a question before any DataFrame exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from tarnwell.plans.model import Catalog, Formula, Intent, OutputHint


@dataclass(frozen=True)
class Rule:
    """trigger: (kind, value...); actions: (kind, value...), carried out in order."""

    trigger: tuple
    actions: tuple[tuple, ...]
    name: str = ""


def holds(trigger: tuple, intent: Intent, catalog: Catalog) -> bool:
    kind, *args = trigger
    match kind:
        case "keyword":  # substrings of the question, in any case
            return any(k.lower() in intent.question.lower() for k in args)
        case "having":
            return bool(intent.having) and intent.having.kind == args[0] and (len(args) < 2 or intent.having.polarity == args[1])
        case "formula_requested":
            return any(f in intent.formulas for f in args) if args else bool(intent.formulas)
        case "metric_present":
            return any(m in intent.metrics or m in intent.formulas for m in args)
        case "dimension_present":
            return any(d in intent.dimensions for d in args)
        case "metric_category":
            return any(catalog.metrics[m].category in args for m in intent.metrics if m in catalog.metrics)
        case "all_of":
            return all(holds(t, intent, catalog) for t in args)
        case "any_of":
            return any(holds(t, intent, catalog) for t in args)
    raise ValueError(f"unknown trigger {kind}")


def _added(have: tuple[str, ...], names) -> tuple[str, ...]:
    return tuple(dict.fromkeys((*have, *names)))


def enrich(intent: Intent, rules: list[Rule], catalog: Catalog) -> tuple[Intent, Catalog]:
    """The question and a catalog overlay after all rules; each rule sees what earlier ones did.

    The first set_sort of a rule replaces the question's own sort (without a metric: by the question's first, if it has any);
    later ones have no effect.  applied_rules names the rules that held, in order.  Names of plain metrics that
    end among the formulas move to the metrics.
    """
    intent = replace(intent, display=intent.display or (*intent.metrics, *intent.formulas))
    sorted_by_rule, applied = False, []
    for rule in rules:
        if not holds(rule.trigger, intent, catalog):
            continue
        applied.append(rule.name)
        for kind, *args in rule.actions:
            match kind:
                case "ensure_metrics":
                    intent = replace(intent, metrics=_added(intent.metrics, [m for m in args if m in catalog.metrics]), formulas=_added(intent.formulas, [m for m in args if m in catalog.formulas and m not in catalog.metrics]))
                case "ensure_dimensions":
                    intent = replace(intent, dimensions=_added(intent.dimensions, args))
                case "ensure_formula":
                    intent = replace(intent, formulas=_added(intent.formulas, args))
                case "create_formula" | "override_formula":
                    name, template, *components = args
                    if kind == "override_formula" and name not in catalog.formulas:
                        continue
                    old = catalog.formulas.get(name)
                    catalog = catalog.with_formula(replace(old, template=template, components=tuple(components) or old.components) if old else Formula(name, template, tuple(components)))
                    intent = replace(intent, formulas=_added(intent.formulas, [name])) if kind == "create_formula" else intent
                case "output_hint":
                    intent = replace(intent, hint=args[0] if isinstance(args[0], OutputHint) else OutputHint(*args))
                case "set_channel":
                    intent = replace(intent, channels=tuple(args))
                case "set_sort":
                    if not sorted_by_rule:
                        metric, direction = (*args, None, None)[:2]
                        by = metric or next(iter((*intent.metrics, *intent.formulas)), None)
                        intent, sorted_by_rule = replace(intent, sort=(by, direction or "DESC")) if by else intent, True
                case _:
                    raise ValueError(f"unknown action {kind}")
    plain = [f for f in intent.formulas if f in catalog.metrics and f not in catalog.formulas]
    return replace(intent, formulas=tuple(f for f in intent.formulas if f not in plain), metrics=_added(intent.metrics, plain), applied_rules=tuple(applied)), catalog


def completed(intent: Intent, catalog: Catalog) -> Intent:
    """Defaults: metrics if none are asked for, the sort's metric among the metrics, a sort for a limit, the channel."""
    if not intent.metrics and not intent.formulas:
        intent = replace(intent, metrics=catalog.policy.default_metrics)
    if intent.sort and intent.sort[0] in catalog.metrics and intent.sort[0] not in intent.metrics:
        intent = replace(intent, metrics=(intent.sort[0], *intent.metrics))
    if intent.limit and not intent.sort and intent.metrics:
        intent = replace(intent, sort=(intent.metrics[0], "DESC"))
    if intent.channel_filter and not intent.channels:
        intent = replace(intent, channels=(intent.channel_filter,))
    return intent


def gated(question: str, parse: Callable[[str], Intent], answer: Callable[[Intent], object], fallback: Callable[[str], object], least: float = 0.7) -> object:
    """The answer to a parsed question, or the fallback's to the question itself where parsing fails or is too unsure."""
    try:
        intent = parse(question)
    except Exception:
        return fallback(question)
    return answer(intent) if intent.confidence >= least else fallback(question)
