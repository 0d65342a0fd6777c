"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import let, merged_runs, small_side, text_key, words, written

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: Place holders beyond the ends of a document and of an item: they are like no word and like each other no more.
_OUT_DOC, _OUT_ITEM = -1, -2


def gram_size(window: int) -> int:
    """Words of a gram: a little over half of a window keeps chance hits few and selects about two grams in a window's place."""
    return min(window, window // 2 + 2)


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(1), n)


def grams(w: Column, window: int) -> Column:
    """A number for every gram of a text's words (a number for each)."""
    gram = gram_size(window)
    return F.transform(_upto(F.size(w) - gram + 1), lambda i: F.xxhash64(F.lit(window), F.slice(w, i, gram)))


def lowest(g: Column, window: int) -> Column:
    """For every window the smallest of its grams."""
    wide = window - gram_size(window) + 1
    return F.transform(_upto(F.size(g) - wide + 1), lambda i: F.array_min(F.slice(g, i, wide)))


def prints(w: Column, window: int) -> Column:
    """Winnowing: the smallest gram of every window, each once; texts that share a window share one.  Null for a shorter text."""
    return F.when(F.size(w) >= window, let(grams(w, window), lambda g: F.array_distinct(lowest(g, window))))


def fingerprints(w: Column, window: int, outside: int) -> Column:
    """The prints of a text with their places, as (print, at, around).

    at: the gram's first word.  around: the numbers of the words from window - gram words before the gram to as many behind
    it, `outside` where there is none.  Of equal smallest grams of a window all are there.  Null for a shorter text.
    """
    gram = gram_size(window)
    wide, pad = window - gram + 1, window - gram
    beyond = F.array_repeat(F.lit(outside).cast("long"), pad)

    def selected(g: Column, low: Column) -> Column:
        # the windows that hold gram i start at i - wide + 1 to i; slice ends with the array
        first = lambda i: F.greatest(i - wide + 1, F.lit(1))
        own = F.filter(_upto(F.size(g)), lambda i: F.element_at(g, i) == F.array_max(F.slice(low, first(i), i - first(i) + 1)))
        return let(F.concat(beyond, w, beyond), lambda p: F.transform(own, lambda i: F.struct(F.element_at(g, i).alias("print"), (i - 1).alias("at"), F.slice(p, i, gram + 2 * pad).alias("around"))))

    return F.when(F.size(w) >= window, let(grams(w, window), lambda g: let(lowest(g, window), lambda low: selected(g, low))))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, h1, h2, n_words, n_hit, n_items, items (array<string>), items_sha256, contaminated, spans of every row.

    h1, h2 stand for the text.  spans: the runs (s, e) of words that lie in an occurrence of a window of an item.  Every
    document is winnowed in one scan, and its prints meet those of the items in a join (broadcast while the items' written
    prints are small, else by shuffle).  Texts with a print in common, and only these, are read again: their prints are
    joined with places, hits are extended word by word to both sides, and runs of a whole window or more are gathered by
    text.  Items of fewer than WINDOW words are windows of their own length; documents are winnowed for each such length
    that the items have, too, at most WINDOW - 1.

    Null texts have no words; documents without words are not contaminated; items without words match nothing.  Null ids and
    repeated rows are rows as any other.  Items with the same id count once; words of an item without an id are hit, but it is no item of
    n_items and items.  Empty tables give no rows or no hits.  Other
    columns are not read.
    """
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    bench = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    bench = written(bench.select("item", hashed(F.col("w")).alias("w"), F.least(F.size("w"), F.lit(WINDOW)).alias("window")), "items")
    lengths = sorted(r[0] for r in bench.select("window").distinct().collect())  # 1 to WINDOW
    key = text_key(F.col("text"))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns({"h1": key["h1"], "h2": key["h2"]})

    of_items = F.when(F.col("window") == WINDOW, prints(F.col("w"), WINDOW))
    for window in lengths:
        of_items = F.when(F.col("window") == window, prints(F.col("w"), window)).otherwise(of_items)
    known = written(bench.select(F.explode(of_items).alias("print")).distinct().withColumn("known", F.lit(True)), "prints")
    none = F.array().cast("array<bigint>")
    all_prints = lambda w: F.concat(none, *[F.coalesce(prints(w, window), none) for window in lengths])
    seen = let(hashed(words(F.col("text"))), lambda w: F.struct(F.size(w).alias("n"), all_prints(w).alias("prints")))
    rows = given.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h1", "h2", seen.alias("x"))
    rows = rows.select("row", "doc_id", "h1", "h2", F.col("x.n").cast("long").alias("n_words"), F.explode_outer("x.prints").alias("print"))
    rows = rows.join(small_side(known), "print", "left").groupBy("row", "doc_id", "h1", "h2", "n_words").agg(F.max(F.coalesce("known", F.lit(False))).alias("near")).drop("row")
    every = written(rows, "winnowed")

    near = written(every.where("near").select("h1", "h2").distinct(), "near")
    texts = given.join(small_side(near), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    texts = texts.select("h1", "h2", hashed(words(F.col("text"))).alias("w"))
    parts = []
    for window in lengths:
        gram, pad = gram_size(window), window - gram_size(window)
        place = lambda of, outside, window=window: F.explode(let(of, lambda w: fingerprints(w, window, outside))).alias("f")
        theirs = bench.where(F.col("window") == window).select("item", place(F.col("w"), _OUT_ITEM)).select("item", "f.*")
        theirs = written(theirs.groupBy("print", F.col("around").alias("theirs")).agg(F.collect_set("item").alias("hits")), "places")
        met = texts.select("h1", "h2", place(F.col("w"), _OUT_DOC)).select("h1", "h2", "f.*").join(small_side(theirs), "print")
        same = lambda k: F.element_at("around", k) == F.element_at("theirs", k)
        # words that agree before and behind the gram, which spans places pad + 1 to pad + gram
        inner = F.lit(True)
        before, behind = _run([same(pad - k) for k in range(pad)]), _run([same(pad + gram + 1 + k) for k in range(pad)])
        for k in range(gram):
            inner = inner & same(pad + 1 + k)
        hit = met.where(inner).select("h1", "h2", (F.col("at") - before).alias("s"), (F.col("at") + gram + behind).alias("e"), "hits").where(F.col("e") - F.col("s") >= window)
        parts.append(hit)

    if parts:
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.union(p)
        hits = hits.groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("items"))
        every = every.join(small_side(written(hits, "hits")), ["h1", "h2"], "left")
    else:
        every = every.withColumns({"runs": F.lit(None).cast("array<struct<s:int,e:int>>"), "items": F.lit(None).cast("array<string>")})
    none = F.array().cast("array<struct<s:int,e:int>>")
    out = every.withColumn("spans", merged_runs(F.coalesce("runs", none))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"])
    out = out.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.select("doc_id", "h1", "h2", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans")


def _run(same: list[Column]) -> Column:
    """How many of these hold before the first that does not."""
    total = F.lit(0)
    for x in reversed(same):
        total = F.when(x, total + 1).otherwise(F.lit(0))
    return total
