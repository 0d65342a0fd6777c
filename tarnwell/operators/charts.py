"""Results as charts, tables and lists: data in long form, encodings, and text of what was collected."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.operators.merge import unpivoted

# What a column's type is in a chart, by the start of its type's name (the first that fits), and the marks.
CHART_TYPES = {"decimal": "quantitative", "double": "quantitative", "float": "quantitative", "real": "quantitative", "interval": "nominal", "int": "quantitative", "bigint": "quantitative", "smallint": "quantitative", "tinyint": "quantitative", "timestamp": "temporal", "date": "temporal"}
MARKS = ("arc", "area", "bar", "boxplot", "circle", "errorband", "errorbar", "geoshape", "image", "line", "point", "rect", "rule", "square", "text", "tick", "trail")
META_QUESTIONS = ("what can you do", "what data do you have", "help", "who are you")
# End of the fixed values.
#: A legend with more values can't be read; longer labels go to the vertical axis.
LEGEND, LABEL = 10, 10


def chart_type(type_name: str) -> str:
    low = type_name.lower().strip()
    return next((t for prefix, t in CHART_TYPES.items() if low.startswith(prefix)), "nominal")


def chart_types(df: DataFrame) -> dict[str, str]:
    return {c: chart_type(t) for c, t in df.dtypes}


def inferred_type(column: Column) -> Column:
    """An aggregate: temporal, quantitative or nominal, by all values of a text column that are neither null nor empty."""
    text = F.nullif(F.trim(column.cast("string")), F.lit(""))
    date = text.rlike(r"^\d{4}-\d{2}-\d{2}|^[A-Za-z]{3}\s+\d{1,2},?\s+\d{4}|^\d{1,2}/\d{1,2}/\d{4}$")
    number = F.regexp_replace(text, "[,₹%]", "").try_cast("double").isNotNull()
    of = lambda test: F.coalesce(F.min(F.when(text.isNotNull(), test)), F.lit(False))
    return F.when(of(date), "temporal").when(of(number), "quantitative").otherwise("nominal")


def cleaned(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Quantitative columns as numbers: currency and percent signs go, and a null is 0; text that is no number stays out as 0."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), "[₹,%]", "").try_cast("double")
    return df.select(*[F.coalesce(number(c), F.lit(0.0)).alias(c) if types.get(c) == "quantitative" else F.col(c) for c in df.columns])


def periods_long(df: DataFrame) -> DataFrame:
    """period1_value and period2_value as two rows (period, value); a period without a date has its column's name."""
    ids = [c for c in df.columns if not re.fullmatch(r"period[12]_(value|date)", c)]
    date = lambda k: F.coalesce(F.col(f"period{k}_date").cast("string"), F.lit(f"period{k}_value")) if f"period{k}_date" in df.columns else F.lit(f"period{k}_value")
    both = F.array(*[F.struct(date(k).alias("period"), F.col(f"period{k}_value").alias("value")) for k in (1, 2)])
    return df.select(*ids, F.inline(both))


def values_and_volumes_long(df: DataFrame) -> DataFrame:
    """Columns that come as _val and _vol, as rows (metric, amount) under their own names; other columns stay."""
    pairs = [c for c in df.columns if c[-4:] in ("_val", "_vol") and {f"{c[:-4]}_val", f"{c[:-4]}_vol"} <= set(df.columns)]
    return unpivoted(df, [c for c in df.columns if c not in pairs], pairs) if pairs else df


def bar_encoding(df: DataFrame, types: dict[str, str] | None = None) -> dict[str, str]:
    """Which column is y, color and x of a bar chart with two or more nominal columns; nothing for fewer.

    How much a column varies within the groups of the others is the number of different rows over that of the others alone,
    so one aggregate of distinct counts gives all that is needed.  The column that varies most is the color, unless it has
    more than LEGEND values: then it is y, and the most varied of the others that fits a legend is the color (the least
    varied, if none fits).  Otherwise y is the others' column with most values.  x is the number with most values.  Of equals
    the first column counts.
    """
    types = types or chart_types(df)
    nominal, numbers = ([c for c in df.columns if types[c] == kind] for kind in ("nominal", "quantitative"))
    if len(nominal) < 2:
        return {}
    different = lambda columns: F.count_distinct(F.struct(*[F.col(c) for c in columns]))
    counted = df.agg(different(nominal), *[different([c]) for c in (*nominal, *numbers)], *[different([o for o in nominal if o != c]) for c in nominal]).first()
    whole, values = counted[0], dict(zip((*nominal, *numbers), counted[1:], strict=False))
    apart = dict(zip(nominal, counted[-len(nominal) :], strict=True))
    place = {c: -k for k, c in enumerate(df.columns)}
    most = lambda columns, by: max(columns, key=lambda c: (by(c), place[c]))
    inner = most(nominal, lambda c: whole / apart[c] if apart[c] else 0.0)
    outer = [c for c in nominal if c != inner]
    fits = [c for c in outer if values[c] <= LEGEND]
    if values[inner] <= LEGEND:
        y, color = most(outer, values.get), inner
    else:
        y, color = inner, most(fits, values.get) if fits else most(outer, lambda c: -values[c])
    return {"y": y, "color": color} | ({"x": most(numbers, values.get)} if numbers else {})


def chart(df: DataFrame, mark: str, encoding: dict[str, str], title: str = "") -> dict:
    """A chart specification without its data: encoded columns with their types, legends below, all columns as tooltips.

    Bars with two or more nominal columns are encoded by bar_encoding(); bars whose labels are longer than LABEL lie.
    """
    if mark not in MARKS:
        raise ValueError(f"unknown mark {mark}")
    types = chart_types(df)
    if wrong := [c for c in encoding.values() if c not in types]:
        raise ValueError(f"no column {', '.join(wrong)}")
    channels = dict(encoding)
    lies = False
    if mark == "bar" and (found := bar_encoding(df, types)):
        channels, lies = channels | found | {"yOffset": found["color"]}, True
    elif mark == "bar" and types.get(channels.get("x")) == "nominal" and types.get(channels.get("y")) == "quantitative":
        longest = df.agg(F.max(F.length(F.col(channels["x"]).cast("string")))).first()[0] or 0
        if longest > LABEL:
            channels["x"], channels["y"], lies = channels["y"], channels["x"], True
    if mark == "bar" and "color" not in channels and (names := [channels[a] for a in ("y", "x") if types.get(channels.get(a)) == "nominal"]):
        channels["color"] = names[0]
    made: dict = {a: {"field": c, "type": types[c]} | ({"legend": {"orient": "bottom"}} if a in ("color", "size", "shape", "opacity") else {}) for a, c in channels.items()}
    made["tooltip"] = [{"field": c, "type": t} for c, t in types.items()]
    return {"mark": {"type": mark, "orient": "horizontal"} if lies else {"type": mark}, "encoding": made} | ({"title": title} if title else {})


def interleaved(columns: list[str]) -> list[str]:
    """Plain columns, then each _val with its _vol, then the other _vol columns by name."""
    vals, vols = [c for c in columns if c.endswith("_val")], {c for c in columns if c.endswith("_vol")}
    paired = [x for v in vals for x in (v, f"{v[:-4]}_vol") if x == v or x in vols]
    return [c for c in columns if c not in vols and c not in vals] + paired + sorted(vols - set(paired))


def markdown_table(channel: str, columns: list[str], rows: list[dict]) -> str:
    """Collected rows as a padded table with two decimals; nothing without rows."""
    if not rows or not columns:
        return ""
    columns = interleaved(columns)
    shown = lambda v: "" if v is None else f"{float(v):.2f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    cells = [[c.replace("_", " ").upper() for c in columns], *[[shown(r.get(c)) for c in columns] for r in rows]]
    width = [max(len(line[i]) for line in cells) for i in range(len(columns))]
    lines = ["| " + " | ".join(x.ljust(w) for x, w in zip(line, width, strict=True)) + " |" for line in cells]
    name = channel.replace("_", " ").title()
    return "\n".join([f"### {name}", f"*Showing {len(rows)} of {len(rows)} rows*", "", lines[0], "|" + "|".join("-" * (w + 2) for w in width) + "|", *lines[1:]])


def enumeration(groups: Iterable[tuple[str | None, str, list[dict]]], most: int | None = None) -> str:
    """Collected rows of (label, channel) groups as numbered lines without empty cells; labelled sections first.

    With `most`, a section ends after so many lines with a note of how many are left out.
    """
    found = [(a, c, r) for a, c, r in groups if r]
    sections: dict[tuple[bool, str], list[tuple[str, list[dict]]]] = {}
    for label, channel, rows in found:
        sections.setdefault((label is None, label or f"{channel}#{len(sections)}" if label is None else label), []).append((channel, rows))
    out, n = [], 0
    for (plain, name), parts in sorted(sections.items(), key=lambda s: s[0][0]):
        total = sum(len(r) for _, r in parts)
        lines = [f"### {parts[0][0].upper()} ({total} rows)" if plain else f"### {name.upper()} ({total} rows total)"]
        shown = 0
        for channel, rows in parts:
            lines += [] if plain else [f"  [{channel.upper()}]"]
            for row in rows:
                n += 1
                if most is None or shown < most:
                    cells = [f"{c}: {v}" for c, v in row.items() if v is not None and v != ""]
                    lines.append(("  " if plain else "    ") + " | ".join([f"{n}.", *cells]))
                    shown += 1
        out.append("\n".join(lines + [f"  ... {total - shown} more"] * (shown < total)))
    return "\n\n".join(out) or "No data returned."


def sections(text: str) -> tuple[str, str]:
    """(quick summary, analysis) of an answer with these headings; without them the first paragraph and the rest."""
    m = re.search(r"(?is)QUICK SUMMARY\W*(.*?)(?:^|\n)\W*ANALYSIS\W*(.*)", text)
    head, _, rest = text.partition("\n\n")
    return (m[1].strip(), m[2].strip()) if m else (head.strip(), rest.strip())


def about_the_engine(question: str) -> bool:
    """Whether a question is about what can be asked rather than about data."""
    return any(p in question.lower() for p in META_QUESTIONS)
