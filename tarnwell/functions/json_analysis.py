"""What a JSON document is like: structure, content, the chunking strategy that fits it, and warnings.  One row a document.

structure(), content(), analysed() and discovered() take nodes (json_chunks.leaves), which they group, or documents
(document_id, doc), which are told within their rows: nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.json_chunks import called
from tarnwell.functions.json_parts import facts, key_rows
from tarnwell.functions.json_words import COLLECTIONS, DOMAINS, DRILL_DOWN, KEY_TYPES, METADATA, METRIC_PATTERNS, PERFORMANCE, REASONING, STRATEGIES, TECHNICAL, TEMPORAL, TEXTS, THRESHOLDS, TYPES, WRITTEN


def _any(words: tuple[str, ...], *texts: Column) -> Column:
    return reduce(or_, [F.contains(t, F.lit(w)) for t in texts for w in words])


def _is_upper(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def key_type(key: Column) -> Column:
    """What a key names: the first type with a word that it holds, else how it is written."""
    low, out = F.lower(key), F.when(key.isNull(), F.lit(None).cast("string"))
    for name, words in KEY_TYPES.items():
        out = out.when(_any(words, low), name)
    return out.when(key.rlike(r"^\d+$"), "numeric_key").when(_is_upper(key), "constant").when(F.contains(key, F.lit("_")), "snake_case").when(key.rlike("^[a-z][a-zA-Z0-9]*$"), "camelCase").otherwise("other")


def key_pattern(key: Column) -> Column:
    """How a key is written."""
    lower = (key == F.lower(key)) & (key != F.upper(key))
    return (
        F.when(key.isNull(), F.lit(None).cast("string")).when(F.contains(key, F.lit("_")), "snake_case").when(key.rlike("^[a-z][a-zA-Z0-9]*[A-Z]"), "camelCase").when(_is_upper(key), "UPPER_CASE").when(lower, "lowercase").when(F.contains(key, F.lit("-")), "kebab-case").otherwise("mixed")
    )


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def text_pattern(text: Column) -> Column:
    """What a text value looks like."""
    return (
        F.when(text.isNull(), F.lit(None).cast("string")).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), "date_iso").when(text.rlike(r"^\d+\.?\d*%?$"), "numeric_string")
        .when(_words(text) > 10, "long_text").when(_words(text) > 3, "sentence").when(_is_upper(text), "uppercase_text").otherwise("short_text")
    )


def _counts(name: str, of: Column, kinds: tuple[str, ...]) -> Column:
    """A map of how often each of a fixed set of kinds occurs."""
    each = F.create_map(*[x for k in kinds for x in (F.lit(k), F.count(F.when(of == k, 1)))])
    return F.map_filter(each, lambda _, v: v > 0).alias(name)


def _facts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What _structural() and _contentual() aggregate, of documents."""
    out = called(docs, facts, keep)
    counts = {"entity_types": ("types", TYPES), "key_patterns": ("written", WRITTEN), "text_patterns": ("forms", TEXTS)}
    maps = {name: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.col(c)), lambda _, v: v > 0) for name, (c, kinds) in counts.items()}
    domains = {f"_{d}": F.col("hits")[k].cast("int") for k, d in enumerate(DOMAINS)}
    return out.withColumns(maps | domains).drop("types", "written", "forms", "hits")


def structure(nodes: DataFrame) -> DataFrame:
    """Size, depth, counts, flags, repeating patterns and complexity of each document.

    max_depth: 0 where the root holds plain values only.  size: bytes of the compact JSON text, chars its characters.
    """
    if "doc" in nodes.columns:
        names = ("size", "chars", "max_depth", "keys", "arrays", "objects", "leaves", "drill_down", "large_array", "uniform_array", "root_is_object")
        return _shaped(_facts(nodes).select("document_id", *names))
    return _shaped(nodes.groupBy("document_id").agg(*_structural()))


def _structural() -> list[Column]:
    count = lambda c: F.count(F.when(c, 1))
    kind, root = F.col("kind"), F.col("level") == 0
    array = kind == "array"
    return [
        F.max(F.when(root, F.col("bytes"))).alias("size"), F.max(F.when(root, F.col("chars"))).cast("long").alias("chars"), F.greatest(F.max("level") - 1, F.lit(0)).alias("max_depth"), F.count("key").alias("keys"), count(array).alias("arrays"),
        count(kind == "object").alias("objects"), count(~kind.isin("object", "array")).alias("leaves"), F.coalesce(F.max(_any(DRILL_DOWN, F.lower("text"))), F.lit(False)).alias("drill_down"),
        F.coalesce(F.max(array & ~F.col("listed") & (F.col("n") > 10)), F.lit(False)).alias("large_array"), F.coalesce(F.max(F.when(array & ~F.col("listed"), F.col("uniform"))), F.lit(False)).alias("uniform_array"),
        F.coalesce(F.max(F.when(root, kind == "object")), F.lit(False)).alias("root_is_object"),
    ]


def _shaped(out: DataFrame) -> DataFrame:
    ratio = F.when(F.col("objects") > 0, F.col("keys") / F.col("objects")).otherwise(0.0)
    out = out.withColumns({"branching": ratio, "array_dominance": F.coalesce(F.col("arrays") / F.nullif(F.col("arrays") + F.col("objects"), F.lit(0)) > 0.6, F.lit(False))})
    patterns = F.array_compact(F.array(F.when(F.col("large_array"), F.lit("large_array")), F.when(F.col("uniform_array"), F.lit("uniform_array"))))
    out = out.withColumn("repeating_patterns", patterns)
    part = lambda c, whole, weight: F.least(c / whole, F.lit(1.0)) * weight
    score = part(F.col("size") / (1 << 20), 10.0, 0.2) + part(F.col("max_depth"), 10.0, 0.3) + part(F.col("branching"), 20.0, 0.2) + F.when(F.col("array_dominance"), 0.15).otherwise(0.0) + part(F.size("repeating_patterns"), 5.0, 0.05)
    return out.withColumn("complexity", score)


def content(nodes: DataFrame) -> DataFrame:
    """Types of keys and texts, domain, metrics, sections, entities and flags of each document."""
    if "doc" in nodes.columns:
        return _told(_facts(nodes).drop("size", "chars", "max_depth", "keys", "arrays", "objects", "leaves", "drill_down", "large_array", "uniform_array", "root_is_object"))
    return _told(_worded(nodes).groupBy("document_id").agg(*_contentual()))


def analysed(nodes: DataFrame) -> DataFrame:
    """structure() and content() of each document, by one aggregate over its nodes."""
    if "doc" in nodes.columns:
        return _told(_shaped(_facts(nodes)))
    return _told(_shaped(_worded(nodes).groupBy("document_id").agg(*_structural(), *_contentual())))


def _worded(nodes: DataFrame) -> DataFrame:
    key = F.col("key")
    rows = nodes.withColumn("low", F.lower("key"))
    return rows.withColumns({"key_type": key_type(key), "key_pattern": key_pattern(key), "text_pattern": text_pattern(F.col("text")), "low_text": F.lower("text"), "long": F.when(_words(F.col("text")) > 5, F.lower("text"))})


def _contentual() -> list[Column]:
    key = F.col("key")
    count = lambda c: F.count(F.when(c, 1))
    holds = lambda words, *texts: F.coalesce(F.max(F.coalesce(_any(words, *[F.coalesce(t, F.lit("")) for t in texts]), F.lit(False))), F.lit(False))
    low, texts = F.col("low"), F.col("low_text")
    entity = (F.length("key") >= 2) & ~low.isin(*TECHNICAL)
    inner = F.col("parent").isin(*[f"$.{c}" for c in COLLECTIONS])
    found = lambda words, of: F.array_compact(F.array(*[F.when(holds((w,), of), F.lit(w)) for w in words]))
    return [
        _counts("entity_types", F.col("key_type"), TYPES), _counts("key_patterns", F.col("key_pattern"), WRITTEN),
        _counts("text_patterns", F.col("text_pattern"), TEXTS),
        F.array_compact(F.array(*[F.when(F.max(F.coalesce(low.rlike(p), F.lit(False))), F.lit(n)) for n, p in METRIC_PATTERNS.items()])).alias("named_metrics"),
        F.coalesce(F.max(F.coalesce(low.rlike(TEMPORAL), F.lit(False)) | F.coalesce(texts.rlike(TEMPORAL), F.lit(False))), F.lit(False)).alias("temporal_data"),
        found(PERFORMANCE, low).alias("performance_metrics"), found(REASONING, F.col("long")).alias("reasoning_content"),
        F.array_sort(F.collect_set(F.when((F.col("level") == 1) & _any(METADATA, low), key))).alias("metadata_sections"),
        F.array_sort(F.collect_set(F.when(((F.col("level") == 1) | inner) & entity, key))).alias("business_entities"),
        count(F.col("shape") == "BOOLEAN").alias("booleans"), count(F.col("kind") == "text").alias("texts"), count(F.col("kind").isin("numeric", "boolean")).alias("numbers"),
        count(F.col("shape").isin("DECIMAL", "DOUBLE")).alias("floats"), holds(("metric",), low).alias("has_metric"), *[reduce(add, [holds((w,), low, texts).cast("int") for w in words]).alias(f"_{d}") for d, words in DOMAINS.items()],
    ]


def _told(out: DataFrame) -> DataFrame:
    has = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0)) > 0
    numeric = has("text_patterns", "numeric_string")
    bonus = {
        "analytics": F.when(numeric, 2).otherwise(0) + (F.col("floats") > F.col("texts")).cast("int"),
        "configuration": has("entity_types", "identifiers").cast("int") + (F.col("booleans") > 0).cast("int"),
        "business_data": has("entity_types", "names").cast("int"),
    }
    scores = [F.struct((F.col(f"_{d}") + bonus.get(d, F.lit(0))).alias("score"), F.lit(-k).alias("order"), F.lit(d).alias("domain")) for k, d in enumerate(DOMAINS)]
    best = F.array_max(F.array(*scores))
    heavy = F.col("numbers") > F.col("texts")
    return out.withColumns({
        "domain_type": F.when(best["score"] > 0, best["domain"]).otherwise("general"),
        "metric_patterns": F.concat("named_metrics", F.array_compact(F.array(F.when(numeric, F.lit("numeric_strings")), F.when(heavy, F.lit("numeric_heavy"))))),
        "configuration_data": has("entity_types", "identifiers") | (F.col("booleans") > 0), "analytics_data": heavy | F.col("has_metric"),
    }).drop("named_metrics", "has_metric", "booleans", "floats", *[f"_{d}" for d in DOMAINS])


def chosen(texts: DataFrame) -> DataFrame:
    """document_id, t, strategy and confidence of documents' compact JSON (document_id, t): analysed() and decided() within their rows."""
    return decided(_told(_shaped(_facts(texts, ("t",)))), keep=("t",)).select("document_id", "t", "confidence", "strategy")


def decided(analysed: DataFrame, thresholds: dict[str, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The chunking strategy of each document with its confidence, all scores, two alternatives and warnings.

    analysed: structure() and content() of each document.  Ties go to the strategy named first; below the least confidence it is hybrid.
    """
    t = THRESHOLDS | (thresholds or {})
    c, one = F.col, F.lit(1.0)
    some = F.greatest(c("keys"), F.lit(1))
    ratio, density = c("arrays") / some, (F.size("performance_metrics") + F.size("reasoning_content")) / some
    f = {
        "size": F.least(c("chars") / t["large_document_size"], one), "depth": F.least(c("max_depth") / 10.0, one), "complex": F.least(c("keys") / 100.0, one),
        "hierarchy": F.when(c("max_depth") >= t["min_hierarchical_depth"], 1.0).otherwise(0.3), "dimensional": F.when(ratio >= t["dimensional_array_ratio"], 1.0).otherwise(ratio),
        "semantic": F.least(density, one), "domain": F.when(c("domain_type") != "general", 1.0).otherwise(0.3), "flat": F.when((c("max_depth") <= t["max_flat_depth"]) & (c("keys") <= t["max_flat_keys"]), 1.0).otherwise(0.2),
        "ratio": ratio, "density": density,
    }
    out = analysed.withColumns({f"f_{k}": v for k, v in f.items()})
    x = {k: c(f"f_{k}") for k in f}
    scores = {
        "flat": x["flat"] * 0.6 + (1 - x["complex"]) * 0.2 + (1 - x["size"]) * 0.2,
        "hierarchical": x["hierarchy"] * 0.4 + x["complex"] * 0.3 + x["depth"] * 0.3,
        "semantic": x["semantic"] * 0.5 + x["domain"] * 0.3 + x["density"] * 0.2,
        "dimensional": x["dimensional"] * 0.6 + x["ratio"] * 0.4,
        "hybrid": x["size"] * 0.3 + x["complex"] * 0.3 + x["semantic"] * 0.2 + x["dimensional"] * 0.2,
    }
    advice = {
        "flat": x["flat"] * 0.6 + (1 - x["complex"]) * 0.4,
        "hierarchical": x["hierarchy"] * 0.5 + x["complex"] * 0.5,
        "semantic": x["semantic"] * 0.6 + x["domain"] * 0.4,
        "dimensional": x["dimensional"] * 0.7 + x["ratio"] * 0.3,
        "hybrid": (x["size"] + x["complex"] + x["semantic"] + x["dimensional"]) / 4,
    }
    ranked = lambda s: F.reverse(F.array_sort(F.array(*[F.struct(s[n].alias("score"), F.lit(-k).alias("order"), F.lit(n).alias("strategy")) for k, n in enumerate(STRATEGIES)])))
    best, second = F.element_at(ranked(scores), 1), ranked(advice)
    warn = [
        (~c("root_is_object"), "root is not an object"), (c("chars") > 10 << 20, "larger than 10 MB"), (c("chars") < 100, "very small"), (c("max_depth") > 20, "deeper than 20 levels"),
        (c("keys") > 10_000, "more than 10000 keys"), (c("chars") > 1 << 20, "stream it"), (c("max_depth") > 10, "prefer hierarchical"),
    ]
    weak = best["score"] < t["min_confidence"]
    return out.select(
        "document_id", F.when(weak, "hybrid").otherwise(best["strategy"]).alias("strategy"), F.when(weak, t["min_confidence"]).otherwise(best["score"]).alias("confidence"),
        *[v.alias(f"{n}_score") for n, v in scores.items()], F.transform(F.slice(second, 2, 2), lambda s: s["strategy"]).alias("alternatives"), c("root_is_object").alias("valid"),
        F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in warn])).alias("warnings"), *keep,
    )


def discovered(nodes: DataFrame) -> DataFrame:
    """key_type, keys: the different keys of all documents under what they name; the start of a configuration of one's own."""
    keys = called(nodes, key_rows) if "doc" in nodes.columns else nodes.where("key is not null")
    return keys.select("key").distinct().groupBy(key_type(F.col("key")).alias("key_type")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
