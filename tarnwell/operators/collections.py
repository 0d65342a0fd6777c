"""Choosing collections of vectors for a question, and putting what their search finds in order."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.operators.vectors import overlapping, parsed_name

# Phrases by which a question names a direction, and the words that stand for a missing percentage.
DIRECTIONS = {
    "highest_negative": ("highest negative", "biggest decline", "largest drop", "most decline", "biggest drop"),
    "lowest": ("lowest", "worst", "bottom", "minimum", "min "),
    "highest_positive": ("highest", "best", "top", "maximum", "max ", "most growth", "most positive"),
}
NO_BASE = "null (base period was zero; report the change_absolute value as a plain number with no % symbol and no currency symbol — never output infinity or ∞)"
# End of the fixed values.


def chosen_dimension(explicit: str | None, values: dict[str, list[str]], hierarchy: list[str]) -> str:
    """The dimension that is named, else the first of the hierarchy of which all parts have values, else overall."""
    if explicit and explicit not in ("null", "None"):
        return explicit
    given = {k for k, v in values.items() if v}
    return next((d for d in hierarchy if d != "overall" and set(d.split("_")) <= given), "overall")


def fallback_dimension(wanted: str, available: set[str], rules: dict[str, str] | None = None) -> str:
    """The wanted dimension, the one a rule names for it, or the one with most parts in common (then most parts, then name)."""
    if wanted in available or not available:
        return wanted
    if (to := (rules or {}).get(wanted)) in available:
        return to
    parts = set(wanted.split("_"))
    return min(available, key=lambda d: (-len(parts & set(d.split("_"))), -len(set(d.split("_"))), d))


def available_dimensions(collections: DataFrame) -> DataFrame:
    return collections.select("dimension").distinct()


def found(collections: DataFrame, dimension: str, granularities: list[str] | None = None, start: int | None = None, end: int | None = None, values: list[str] | None = None) -> DataFrame:
    """Collections of a dimension by granularity, overlapping dates and dimension values, from their metadata."""
    out = collections.where(F.col("dimension") == dimension)
    if granularities:
        out = out.where(F.col("time_granularity").isin(*[g.lower() for g in granularities]))
    if start and end:
        out = overlapping(out, start, end)
    return out.where(F.arrays_overlap("dimension_values", F.array(*map(F.lit, values)))) if values else out


def found_by_name(names: DataFrame, dimension: str, granularities: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """collection_name and time_granularity, read off the names alone; names whose dates can't be read are kept."""
    rest = F.substring("collection_name", len(dimension) + 2, 1 << 20)
    gran = F.coalesce(*[F.when(F.startswith(rest, F.lit(f"{g}_")), F.lit(g)) for g in granularities])
    out = names.where(F.startswith("collection_name", F.lit(f"{dimension}_"))).withColumn("time_granularity", gran).where("time_granularity is not null").withColumn("p", parsed_name(F.col("collection_name")))
    if start and end:
        hit = lambda p: (F.col(f"p.{p}_start") <= end) & (F.col(f"p.{p}_end") >= start)
        out = out.where(F.col("p.period1_start").isNull() | hit("period1") | hit("period2"))
    return out.select("collection_name", "time_granularity")


def valid_day(text: str) -> bool:
    try:
        return len(text) == 8 and text.isdigit() and bool(datetime.strptime(text, "%Y%m%d"))
    except ValueError:
        return False


def date_range(specified: bool, start: object, end: object, today: str) -> tuple[int | None, int | None, str]:
    """(start, end, status): valid, not_specified, invalid_format, invalid_range or future_date."""
    if not specified:
        return None, None, "not_specified"
    a, b = str(start), str(end)
    if not (valid_day(a) and valid_day(b)):
        return None, None, "invalid_format"
    if int(b) < int(a):
        return None, None, "invalid_range"
    return (None, None, "future_date") if today.isdigit() and min(int(a), int(b)) > int(today) else (int(a), int(b), "valid")


def known_metric(name: str, known: list[str]) -> str | None:
    """The declared metric of that name in any case, else the first that holds it or is held by it."""
    low = name.lower()
    return next((k for k in known if k.lower() == low), None) or next((k for k in known if low in k.lower() or k.lower() in low), None)


def expanded_granularities(names: list[str], groups: dict[str, list[str]]) -> list[str]:
    """Each name (in any case) by what its group holds, each once, in order."""
    by = {k.upper(): v for k, v in groups.items()}
    return list(dict.fromkeys(g for n in names for g in by.get(n.upper(), [n.lower()])))


def of_granularities(results: DataFrame, wanted: list[str], gran: str = "gran") -> DataFrame:
    """Results of the wanted granularities, or all if there are none of them."""
    mine = results.where(F.col(gran).isin(*wanted)) if wanted else results
    return results if not wanted or mine.isEmpty() else mine


def batched(results: DataFrame, size: int, by: list[str], order: list[Column]) -> DataFrame:
    """results with batch: so many results of each group, in order, to a batch; the input is k rows of each group."""
    return results.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size) + 1)


def marked_zero_base(context: Column) -> Column:
    """In every part `In section`, a percentage of 0 whose base is 0 and whose absolute change isn't becomes a marker."""
    figure = r"(?:\s+with\s+value\s*|:\s*)"

    def part(text: Column) -> Column:
        zero = text.rlike(rf"period1_value{figure}0(?:\.0)?\b")
        change = F.regexp_extract(text, rf"change_absolute{figure}(\d+(?:\.\d+)?)", 1).try_cast("double")
        return F.when(zero & (change != 0), F.regexp_replace(text, rf"(change_percentage{figure})0(?:\.0)?\b", "$1" + NO_BASE)).otherwise(text)

    return F.array_join(F.transform(F.split(context, r"(?=\bIn section\b)"), part), "")


def direction(question: str) -> str:
    """What a question asks for: highest_negative, lowest, highest_positive or all."""
    low = question.lower()
    return next((d for d, words in DIRECTIONS.items() if any(w in low for w in words)), "all")


def directed(rows: DataFrame, question: str, change: str = "change_pct", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the direction that the question asks for, sorted; without any such row all of them as they are."""
    c, to = F.col(change), direction(question)
    if to == "all":
        return rows
    if to == "lowest":
        low = rows.where(c.isNull() | (c <= 0))
        return (rows if low.isEmpty() else low).orderBy(c.asc_nulls_last(), *ties)
    kept = rows.where(c > 0 if to == "highest_positive" else c < 0)
    return rows if kept.isEmpty() else kept.orderBy(c.desc() if to == "highest_positive" else c.asc(), *ties)


def data_period(collections: DataFrame) -> DataFrame:
    """The first and last day of collections, by their names."""
    p = collections.select(parsed_name(F.col("collection_name")).alias("p"))
    return p.agg(F.min("p.period1_start").alias("first_day"), F.max("p.period2_end").alias("last_day"))


def detail_rows(details: DataFrame, text: str = "detail") -> DataFrame:
    """Blocks `**dimension - metric (granularity)**` with bullets of dates and values, as rows; a single date is the second period."""
    blocks = details.select(F.explode(F.split(F.trim(text), r"\n\n+")).alias("b"))
    head = r"\*\*(.+?)\s*-\s*(.+?)\s*\((\w+)\)\*\*"
    bullets = F.transform(F.regexp_extract_all("b", F.lit(r"(?m)^-\s+(.+?:\s*.+)$"), F.lit(1)), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^(.+?):\s*(.+)$", 1)).alias("label"), F.trim(F.regexp_extract(x, r"^(.+?):\s*(.+)$", 2)).alias("value")))
    is_change = lambda x: F.lower(x["label"]) == "change"
    parsed = blocks.where(F.col("b").rlike(head)).select(*[F.trim(F.regexp_extract("b", head, k)).alias(n) for k, n in ((1, "dimension"), (2, "metric"), (3, "granularity"))], F.filter(bullets, lambda x: ~is_change(x)).alias("p"), F.filter(bullets, is_change).alias("c"))
    number = lambda v: F.regexp_replace(v, "[₹,%]", "").try_cast("double")
    item = lambda k, f: F.try_element_at("p", F.lit(k))[f]
    two = F.size("p") >= 2
    change = F.regexp_extract(F.element_at("c", -1)["value"], r"([+-]?)[^\d+-]*(\d+(?:\.\d+)?)", 0)
    return parsed.where(F.size("p") > 0).select(
        "dimension", "metric", "granularity", F.when(two, item(1, "label")).alias("period1_date"), F.when(two, number(item(1, "value"))).alias("period1_value"),
        F.when(two, item(2, "label")).otherwise(item(1, "label")).alias("period2_date"), F.when(two, number(item(2, "value"))).otherwise(number(item(1, "value"))).alias("period2_value"),
        F.when(F.size("c") > 0, F.regexp_replace(change, r"[^\d.+-]", "").try_cast("double")).alias("change_pct"),
    )


def tokens(text: Column) -> Column:
    """An estimate: four characters to a token."""
    return F.ceil(F.length(text) / 4).cast("long")


def within_limit(chunks: DataFrame, most: int = 7500, text: str = "text") -> DataFrame:
    """Chunks that an encoder takes as they are."""
    return chunks.where(tokens(F.col(text)) <= most)


#: Texts that a task holds as Python strings at a time, with their pieces, while it cuts them.
CUT_ROWS = 64


def subdivided(chunks: DataFrame, most: int = 7500, text: str = "text") -> DataFrame:
    """chunks with part: texts of too many tokens in pieces that end with a sentence or a word; no character is lost or twice."""

    def cut(t: str) -> list[str]:
        if t is None or math.ceil(len(t) / 4) <= most:
            return [t]
        n, at, out = math.ceil(len(t) / 4) // most + 1, 0, []
        while at < len(t):
            to = min(len(t), at + max(1, min(len(t) // n, most * 4)))
            if to < len(t):
                stop = end = 0
                for m in re.finditer(r"[.!?]?\s", t[at:to]):
                    end = m.end()
                    stop = end if m.end() - m.start() > 1 else stop
                to = at + (stop or end or to - at)
            out.append(t[at:to])
            at = to
        return out

    kind = pa.list_(pa.string())

    @F.arrow_udf("array<string>")
    def parts(column: pa.Array) -> pa.Array:
        each = [pa.array([cut(t) for t in column.slice(k, CUT_ROWS).to_pylist()], kind) for k in range(0, len(column), CUT_ROWS)]
        return pa.concat_arrays(each) if each else pa.array([], kind)

    return chunks.select("*", F.posexplode(parts(F.col(text))).alias("part", "__piece")).drop(text).withColumnRenamed("__piece", text)


#: Tries of a request, seconds of the longest wait before another try, and requests after which a task rests.
TRIES, LONGEST_WAIT, RESTS_AFTER = 3, 60.0, 5


class EncoderFailed(RuntimeError):
    """An encoder gave no vectors for a request, however often it was asked."""


def _asked(encoder: Callable[[list[str]], list[list[float]]], texts: list[str], tries: int, wait: Callable[[float], None]) -> list[list[float]]:
    """The encoder's vectors; after a failure it is asked again, each time after twice the wait."""
    last: Exception | None = None
    for k in range(tries):
        if k:
            wait(min(2.0 ** (k - 1), LONGEST_WAIT))
        try:
            vectors = encoder(texts)
        except Exception as e:  # noqa: BLE001  whatever an encoder raises
            last = e
            continue
        if len(vectors) == len(texts):
            return vectors
        last = ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    raise EncoderFailed(f"no vectors after {tries} tries: {last}")


def embedded(
    chunks: DataFrame, encoder: Callable[[list[str]], list[list[float]]], per_request: int = 8000, text: str = "text", per_text: int | None = None, tries: int = TRIES, rest: float = 0.0, rests_after: int = RESTS_AFTER, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """chunks with embedding (array<float>) by an encoder of lists of texts; no request holds more than per_request tokens.

    Texts of more tokens than a request go alone; those of more than per_text (if it is given) are not sent and have a null
    embedding, as null texts have.  A request that fails is tried again after 1, 2, 4 ... seconds (LONGEST_WAIT at most) and fails the task after
    `tries`; a task rests for `rest` seconds after every rests_after requests.  The encoder is sent to the tasks.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", embedding array<float>"
    longest = per_text or math.inf

    def requests(texts: pd.Series) -> Iterator[list[int]]:
        batch, held = [], 0
        for i, t in enumerate(texts):
            n = math.ceil(len(t) / 4) if t is not None else 0
            if t is None or n > longest:
                continue
            if batch and held + n > per_request:
                yield batch
                batch, held = [], 0
            batch.append(i)
            held += n
        if batch:
            yield batch

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = 0
        for pdf in frames:
            out: list = [None] * len(pdf)
            for batch in requests(pdf[text]):
                if rest and sent and sent % rests_after == 0:
                    wait(rest)
                for k, v in zip(batch, _asked(encoder, [pdf[text].iloc[k] for k in batch], tries, wait), strict=True):
                    out[k] = v
                sent += 1
            yield pdf.assign(embedding=out)

    return chunks.mapInPandas(rows, schema)
