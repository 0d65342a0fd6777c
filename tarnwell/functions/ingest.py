"""From JSON documents to chunks that are worth storing: analysis, the strategy that fits, text and keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.chunk_text import content_type, text_and_density, value_types
from tarnwell.functions.json_analysis import analysed, decided
from tarnwell.functions.json_analysis import chosen as decided_texts
from tarnwell.functions.json_chunks import as_text, dimension_value, leaves, text_hash, worth_storing
from tarnwell.functions.json_strategies import CHUNK, dimensional, flat, hierarchical, hybrid, semantic
from tarnwell.sources.interim import small_side, written

#: A chunker makes chunks (see json_strategies) from the session, documents (document_id, doc) and their nodes.
Chunker = Callable[[SparkSession, DataFrame, DataFrame], DataFrame]

#: Strategies by name; a caller's own stand beside them or instead of them.
STRATEGIES: dict[str, Chunker] = {
    "flat": lambda spark, docs, nodes: flat(docs),
    "hierarchical": lambda spark, docs, nodes: hierarchical(docs),
    "semantic": lambda spark, docs, nodes: semantic(docs),
    "dimensional": lambda spark, docs, nodes: dimensional(docs),
    "hybrid": lambda spark, docs, nodes: hybrid(docs),
}


def sql_chunker(function: str) -> Chunker:
    """A chunker that calls a table function registered in SQL on the JSON text of each document.

    The function gives path and content of each chunk, and whatever else of a chunk's columns it knows; others are filled in.
    """
    blank = {
        "chunk_id": F.concat_ws("_", "document_id", F.lit(function), "path"), "chunk_type": F.lit(function), "level": F.lit(1), "parent_id": F.lit(None).cast("string"), "size": F.octet_length("content").cast("long"),
        "key_count": F.lit(None).cast("long"), "contains_arrays": F.contains("content", F.lit("[")), "tags": F.array().cast("array<string>"),
    }

    def chunker(spark: SparkSession, docs: DataFrame, nodes: DataFrame) -> DataFrame:
        made = spark.sql(f"select d.document_id, c.* from {{docs}} d, lateral {function}(d.t) c", docs=as_text(docs))
        return made.withColumns({n: c for n, c in blank.items() if n not in made.columns}).select(*CHUNK.split(", "))

    return chunker


def sql_analysis(function: str) -> Callable[[DataFrame], DataFrame]:
    """An analysis by a table function registered in SQL, called with the nodes of each document as its partition.

    The function gives document_id, strategy and confidence.
    """

    def analysis(nodes: DataFrame) -> DataFrame:
        return nodes.sparkSession.sql(f"select document_id, strategy, confidence from {function}(table({{nodes}}) partition by document_id)", nodes=nodes)

    return analysis


def ingested(spark: SparkSession, docs: DataFrame, strategies: dict[str, Chunker | str] | None = None, analysis: Callable[[DataFrame], DataFrame] | str | None = None, forced: str | None = None, mode: str = "contextual_description", shortest: int = 10, density: float = 0.1) -> DataFrame:
    """Chunks of document_id and doc (VARIANT) with strategy, confidence, text, text_hash, semantic_density and types.

    Each document is chunked by the strategy that decided() names, or all by `forced`.  strategies: chunkers of one's own by
    name, or names of table functions (sql_chunker); analysis: nodes to document_id, strategy and confidence instead of
    decided(), or the name of a table function (sql_analysis).  Documents are walked within their rows, once for the analysis
    and once for the chunks; only the documents with their strategies are written in between, by strategy.  Without chunkers or an
    analysis of one's own nothing is joined: JSON text, strategy and confidence stay in one row, so ids may repeat.  Chunks whose text is shorter than
    `shortest` or says less than `density` are left out.  Documents that are null have no chunks; ids are read as text.
    """
    docs = docs.select(F.col("document_id").cast("string").alias("document_id"), "doc")
    simple = not (forced or strategies or analysis)
    if simple:
        chosen = decided_texts(as_text(docs))
    elif forced:
        chosen = docs.where("doc is not null").withColumns({"strategy": F.lit(forced), "confidence": F.lit(1.0)})
    else:
        own = sql_analysis(analysis) if isinstance(analysis, str) else analysis
        fits = written((own(leaves(spark, docs)) if own else decided(analysed(docs))).select("document_id", "strategy", "confidence"), "strategies")
        chosen = docs.where("doc is not null").join(small_side(fits), "document_id")
    chosen = written(chosen.select("document_id", "t" if simple else "doc", "confidence", "strategy"), "chosen", "strategy")
    known, made = STRATEGIES | {n: sql_chunker(c) if isinstance(c, str) else c for n, c in (strategies or {}).items()}, []
    for (name,) in chosen.select("strategy").distinct().collect():  # a row for each strategy
        mine = chosen.where(F.col("strategy") == name).select("document_id", *(["t", "confidence"] if simple else ["doc"]))
        made.append(known[name](spark, mine, leaves(spark, mine)).drop("section").withColumn("strategy", F.lit(name)))
    if not made:
        return spark.createDataFrame([], "document_id string, chunk_id string, strategy string, confidence double, chunk_type string, path string, level int, parent_id string, size long, key_count long, contains_arrays boolean, tags array<string>, content string, text string, text_hash string, text_length int, semantic_density double, content_type string, value_types array<string>, dimension_value string")
    chunks = reduce(DataFrame.unionByName, made)
    if forced:
        chunks = chunks.withColumn("confidence", F.lit(1.0))
    elif not simple:
        sure = chosen.groupBy("document_id").agg(F.max("confidence").alias("confidence"))
        chunks = chunks.join(small_side(written(sure, "confidence")), "document_id")
    place = F.nullif(F.regexp_replace("path", r"^\$\.?", ""), F.lit(""))
    body = F.col("content")
    out = chunks.withColumn("__said", text_and_density(body, place, mode)).select("document_id", "chunk_id", "strategy", "confidence", "chunk_type", "path", "level", "parent_id", "size", "key_count", "contains_arrays", "tags", "content", F.col("__said.text").alias("text"), F.col("__said.density").alias("semantic_density"), content_type(body).alias("content_type"), value_types(body).alias("value_types"), dimension_value(F.col("path")).alias("dimension_value"))
    return out.where(worth_storing(F.col("text"), F.col("semantic_density"), shortest, density)).withColumns({"text_hash": text_hash(F.col("text")), "text_length": F.length("text")})


def batch_requests(chunks: DataFrame, model: str, text: str = "text") -> DataFrame:
    """One JSON request for each chunk, under custom_id chunk_<id>; written as text they are a batch file."""
    own = F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string"))
    body = F.struct(F.lit(model).alias("model"), F.col(text).alias("input"), F.lit("float").alias("encoding_format"))
    return chunks.select(F.to_json(F.struct(own.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body"))).alias("value"))


def batch_results(chunks: DataFrame, results: DataFrame, line: str = "value") -> DataFrame:
    """chunks with the embedding of their result line; failed and missing ones have no row, a repeated one counts once."""
    shape = "custom_id string, response struct<status_code: int, body: struct<data: array<struct<embedding: array<float>>>>>"
    read = results.select(F.from_json(line, shape).alias("r")).where("r.response.status_code = 200").select(F.col("r.custom_id").alias("__custom"), F.element_at("r.response.body.data", 1)["embedding"].alias("embedding")).where("embedding is not null")
    read = read.groupBy("__custom").agg(F.min("embedding").alias("embedding"))
    return chunks.withColumn("__custom", F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string"))).join(read, "__custom").drop("__custom")
