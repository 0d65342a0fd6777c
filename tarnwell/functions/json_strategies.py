"""Chunks of JSON documents by strategy: flat, hierarchical, semantic, and a mixture chosen section by section."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.json_chunks import called, whole_dimensional_chunks
from tarnwell.functions.json_parts import LEAST_SCORE, REGION_CHARS, mixed_chunks, scored_objects, section_rows, told_chunks
from tarnwell.functions.json_walk import flat_chunks, hierarchical_chunks

# Words by which chunks are tagged.
PLACE_TAGS = {"domain:user_management": ("user", "customer", "client"), "domain:product_catalog": ("product", "catalog", "inventory"), "domain:transaction": ("order", "transaction", "payment"), "domain:configuration": ("config", "setting", "preference")}
KEY_TAGS = {
    "structure:entity": ("id", "uuid", "identifier"), "structure:named_entity": ("name", "title", "label"), "structure:temporal": ("date", "time", "created", "updated"), "structure:metadata": ("meta", "metadata", "info"),
    "semantic:descriptive": ("description", "comment", "note", "reason"), "semantic:quantitative": ("metric", "measure", "value", "count"),
}
# End of the fixed values.
CHUNK = "document_id, chunk_id, chunk_type, path, level, parent_id, size, key_count, contains_arrays, tags, content"


def _kept(docs: DataFrame) -> tuple[str, ...]:
    """The confidence of documents that were decided on goes along into their chunks."""
    return ("confidence",) if "confidence" in docs.columns else ()


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def tags(path: Column, keys: Column) -> Column:
    """What a chunk is about, by the words of its place (the first that fits) and of its keys."""
    place, names = F.lower(path), F.lower(F.array_join(keys, " "))
    first = F.coalesce(*[F.when(_has(place, words), F.lit(tag)) for tag, words in PLACE_TAGS.items()])
    return F.array_sort(F.array_compact(F.array(first, *[F.when(_has(names, words), F.lit(tag)) for tag, words in KEY_TAGS.items()])))


def flat(docs: DataFrame, size: int = 10) -> DataFrame:
    """The values of objects at any depth, `size` to a chunk in path order and nested again; arrays stay whole.

    A document that is an array is one value under the key `items`.  Empty objects have no values.
    """
    made = called(docs, flat_chunks, _kept(docs), size=size)
    return made.select(
        "document_id", F.concat_ws("_", "document_id", F.lit("flat"), "chunk").alias("chunk_id"), F.lit("flat").alias("chunk_type"), F.concat(F.lit("flat_chunk_"), "chunk").alias("path"), "level", F.lit(None).cast("string").alias("parent_id"),
        F.octet_length("content").cast("long").alias("size"), "key_count", "contains_arrays", tags(F.lit(""), F.col("paths")).alias("tags"), "content", *_kept(docs),
    )


def hierarchical(docs: DataFrame, max_bytes: int = 100_000, depth: int = 3, max_tokens: int = 7600, skipped_levels: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Objects that are large, deep, wide or mixed are chunks, each with its nearest chunk above as its parent.

    Objects in arrays take part if one of the array's first five items is an object or an array; plain arrays of more than ten
    items are chunks under their key.  Chunks of the skipped levels are left out beyond max_tokens (four characters each);
    what is below them then belongs to the next chunk above.  An object is compared by its compact JSON text.
    """
    made = called(docs, hierarchical_chunks, _kept(docs), max_bytes=max_bytes, depth=depth, max_tokens=max_tokens, skipped_levels=list(skipped_levels))
    named = lambda level, path: F.concat_ws("_", "document_id", F.lit("hier"), level, path)
    return made.select(
        "document_id", named("level", "path").alias("chunk_id"), F.lit("hierarchical").alias("chunk_type"), "path", "level", F.when(F.col("up").isNotNull(), named("up_level", "up")).alias("parent_id"),
        F.octet_length("content").cast("long").alias("size"), "key_count", "contains_arrays", tags(F.col("path"), F.col("own")).alias("tags"), "content", *_kept(docs),
    )


def scored(docs: DataFrame) -> DataFrame:
    """Objects with what they tell: score, content type and keywords."""
    return called(docs, scored_objects)


def semantic(docs: DataFrame, least: float = LEAST_SCORE, limit: int = REGION_CHARS) -> DataFrame:
    """The topmost objects that tell enough, related ones together; a document without any is chunked by its top level.

    A document is scored and put together within its row, in one pass.
    """
    name = F.when(F.col("chunk_type") == "semantic", "semantic").otherwise("fallback")
    return called(docs, told_chunks, _kept(docs), least=least, limit=limit).select(
        "document_id", F.concat_ws("_", "document_id", name, "name").alias("chunk_id"), "chunk_type", "path", "level", F.lit(None).cast("string").alias("parent_id"), F.octet_length("content").cast("long").alias("size"),
        F.regexp_count("content", F.lit('":')).cast("long").alias("key_count"), F.contains("content", F.lit("[")).alias("contains_arrays"), "tags", "content", *_kept(docs),
    )


def dimensional(docs: DataFrame, rest: str = "$") -> DataFrame:
    """whole_dimensional_chunks() in the form of the other strategies; what is in no large array has the path `rest`."""
    return whole_dimensional_chunks(docs.sparkSession, docs, keep=_kept(docs)).select(
        "document_id", F.concat_ws("_", "document_id", "kind", "path", "slice").alias("chunk_id"), F.lit("dimensional").alias("chunk_type"), F.coalesce("path", F.lit(rest)).alias("path"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"),
        F.octet_length("content").cast("long").alias("size"), F.col("items").cast("long").alias("key_count"), (F.col("kind") == "array").alias("contains_arrays"), F.array().cast("array<string>").alias("tags"), "content", *_kept(docs),
    )


def sections(docs: DataFrame, flat_depth: int = 2, large: int = 10_000, array_ratio: float = 0.4, telling: float = 2.0) -> DataFrame:
    """document_id, section, strategy and JSON of every top-level key; a small plain document is one section by itself."""
    return called(docs, section_rows, flat_depth=flat_depth, large=large, array_ratio=array_ratio, telling=telling)


def hybrid(docs: DataFrame, small: int = 500, few_keys: int = 5, large: int = 100_000) -> DataFrame:
    """Each section's chunks by the strategy that fits it; neighbouring small chunks are joined and very large ones cut flat.

    A document's sections, their chunks and what is joined of them are made within its row, in one pass.
    """
    made = called(docs, mixed_chunks, _kept(docs), small=small, few_keys=few_keys, large=large)
    own = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("_", "document_id", c))
    about = F.concat(F.flatten(F.transform("places", lambda p: tags(p, F.array().cast("array<string>")))), tags(F.lit(""), F.col("names")), F.col("marks"))
    return made.select(
        F.col("document_id").cast("string").alias("document_id"), own("name").alias("chunk_id"), "chunk_type", "path", "level", own("parent").alias("parent_id"), "size", "key_count", "contains_arrays", F.concat(F.array_sort(F.array_distinct(about)), "last").alias("tags"), "content", *_kept(docs),
    )
