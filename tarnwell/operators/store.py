"""Namespaces of vectors as catalog tables: insert, look up, change, delete, copy; and statistics of what they hold."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.sources.interim import dropped, small_side, written
from tarnwell.sources.tables import namespace_path, new_vectors

#: Columns of a namespace's table; it is partitioned by collection.
SCHEMA = "chunk_id string, document_id string, text string, text_hash string, embedding array<float>, path string, level int, strategy string, content_type string, semantic_density double, confidence double, text_length long, dimension_value string, created_at timestamp, updated_at timestamp, collection_name string"


def table_name(namespace: str) -> str:
    return namespace_path("", namespace)


def create(spark: SparkSession, namespace: str) -> None:
    spark.sql(f"create table {table_name(namespace)} ({SCHEMA}) using parquet partitioned by (collection_name)")


def exists(spark: SparkSession, namespace: str) -> bool:
    return spark.catalog.tableExists(table_name(namespace))


def names(spark: SparkSession) -> list[str]:
    """All namespaces; backups that a move left are none."""
    found = [r.tableName for r in spark.sql("show tables").collect() if r.tableName.startswith("embeddings_") and not r.isTemporary]
    return sorted(n[len("embeddings_") :] for n in found if "_backup_" not in n)


def drop(spark: SparkSession, namespace: str, confirm: bool = False) -> None:
    if not confirm:
        raise ValueError("dropping a namespace needs confirm=True")
    spark.sql(f"drop table if exists {table_name(namespace)}")


def insert(spark: SparkSession, namespace: str, vectors: DataFrame) -> int:
    """Append vectors whose chunk_id, and whose text within its document, are not stored yet; the number of those.

    Missing columns are null, created_at is now where it isn't given; a row without a collection goes to `default`.
    """
    now = F.current_timestamp()
    given = {f.name: f.dataType for f in spark.table(table_name(namespace)).schema}
    cols = [(F.col(c) if c in vectors.columns else F.lit(None)).cast(t).alias(c) for c, t in given.items()]
    rows = vectors.select(*cols).withColumns({"created_at": F.coalesce("created_at", now), "collection_name": F.coalesce("collection_name", F.lit("default"))})
    fresh = written(new_vectors(rows, spark.table(table_name(namespace))).select(*given), "insert")
    fresh.write.insertInto(table_name(namespace))
    n = fresh.count()
    dropped(fresh)
    return n


def by_chunk(spark: SparkSession, namespace: str, chunk_id: str) -> DataFrame:
    return spark.table(table_name(namespace)).where(F.col("chunk_id") == chunk_id)


def by_document(spark: SparkSession, namespace: str, document_id: str, collection: str | None = None) -> DataFrame:
    """A document's chunks by level and path."""
    rows = spark.table(table_name(namespace)).where(F.col("document_id") == document_id)
    return (rows.where(F.col("collection_name") == collection) if collection else rows).orderBy("level", "path")


def _rewritten(spark: SparkSession, namespace: str, touched: Column, change) -> int:
    """Write those partitions anew that hold rows to which `touched` applies; the number of such rows."""
    table = table_name(namespace)
    old = spark.table(table)
    counts = {r[0]: r[1] for r in old.where(touched).groupBy("collection_name").count().collect()}  # a row for each collection
    if not counts:
        return 0
    new = written(change(old.where(F.col("collection_name").isin(*counts))).select(*old.columns), "rewritten")
    _swapped(spark, table, new, set(counts))
    dropped(new)
    return sum(counts.values())


def _swapped(spark: SparkSession, table: str, new: DataFrame, collections: set[str]) -> None:
    """A table's partitions of these collections, written anew; those without a row are dropped.

    Partitions are overwritten one after the other when the job commits, and emptied ones dropped afterwards: a failure in
    between leaves some old and some new, which the same change done again puts right.
    """
    left = {r[0] for r in new.select("collection_name").distinct().collect()}  # names of collections
    place = spark.sql(f"describe formatted {table}").where("col_name = 'Location'").first()["data_type"]
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_name").parquet(place)
    spark.catalog.refreshTable(table)
    for c in collections - left:
        spark.sql(f"alter table {table} drop partition (collection_name = {_quoted(c)})")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def delete(spark: SparkSession, namespace: str, collection: str | None = None, document_id: str | None = None) -> int:
    """Delete a collection, a document in all collections, or a document in one; the number of rows that went."""
    if collection is None and document_id is None:
        raise ValueError("name a collection or a document")
    gone = F.lit(True)
    gone = gone & (F.col("collection_name") == collection) if collection is not None else gone
    gone = gone & F.col("document_id").eqNullSafe(F.lit(document_id)) if document_id is not None else gone
    return _rewritten(spark, namespace, gone, lambda rows: rows.where(~gone))


def update(spark: SparkSession, namespace: str, chunk_id: str, **values: object) -> int:
    """Set columns of a chunk; names that are no column are ignored, and the collection stays."""
    mine = F.col("chunk_id") == chunk_id
    kinds = {f.name: f.dataType for f in spark.table(table_name(namespace)).schema}
    to = {c: F.when(mine, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items() if c in kinds and c not in ("chunk_id", "collection_name", "updated_at")}
    to["updated_at"] = F.when(mine, F.current_timestamp()).otherwise(F.col("updated_at"))
    return _rewritten(spark, namespace, mine, lambda rows: rows.withColumns(to))


def replace_document(spark: SparkSession, namespace: str, document_id: str, vectors: DataFrame) -> int:
    """A document's rows go from all collections, and the given ones come instead."""
    delete(spark, namespace, document_id=document_id)
    return insert(spark, namespace, vectors)


def replace_documents(spark: SparkSession, namespace: str, documents: DataFrame, vectors: DataFrame | None) -> int:
    """Rows of all these documents (document_id) go, in one rewrite of the collections that hold any, and the given ones come
    instead; the number of rows that came.  Doing it again changes nothing."""
    table = table_name(namespace)
    new = written(vectors, "new") if vectors is not None else None  # made before the old rows go
    ids = small_side(written(documents.select("document_id").distinct(), "ids"))
    old = spark.table(table)
    touched = [r[0] for r in old.join(ids, "document_id", "left_semi").select("collection_name").distinct().collect()]  # names of collections
    if touched:
        kept = written(old.where(F.col("collection_name").isin(*touched)).join(ids, "document_id", "left_anti").select(*old.columns), "rewritten")
        _swapped(spark, table, kept, set(touched))
        dropped(kept)
    return insert(spark, namespace, new) if new is not None else 0


def migrate(spark: SparkSession, source: str, target: str, mode: str = "copy") -> int:
    """Copy a namespace to a new one, rows counted; a move leaves the source as a backup under another name."""
    if mode not in ("copy", "move"):
        raise ValueError(f"unknown mode {mode}")
    if not exists(spark, source) or exists(spark, target):
        raise ValueError("the source must exist and the target must not")
    old, new = table_name(source), table_name(target)
    spark.sql(f"create table {new} using parquet partitioned by (collection_name) as select * from {old}")
    n, m = spark.table(old).count(), spark.table(new).count()
    if n != m:
        spark.sql(f"drop table {new}")
        raise RuntimeError(f"{m} of {n} rows were copied")
    if mode == "move":
        spark.sql(f"alter table {old} rename to {old}_backup_{datetime.now(UTC):%Y%m%d%H%M%S%f}")
    return n


def collection_view(spark: SparkSession, namespace: str, collection: str, view: str) -> DataFrame:
    """A temporary view of one collection, the newest rows first."""
    rows = spark.table(table_name(namespace)).where(F.col("collection_name") == collection).orderBy(F.desc("created_at"))
    rows.createOrReplaceTempView(view)
    return spark.table(view)


def _distribution(column: str, name: str) -> Column:
    """kind=count, joined by commas, by name; from counts that were grouped before."""
    return F.array_join(F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.concat(F.col(column), F.lit("="), F.col("n").cast("string"))))), ",").alias(name)


def collection_stats(vectors: DataFrame) -> DataFrame:
    """One row for each collection: totals, averages, and counts by strategy and content type.

    One aggregate over the vectors; its rows (a collection, strategy and type each) are then grouped twice.
    """
    parts = vectors.groupBy("collection_name", "strategy", "content_type").agg(
        F.count("*").alias("n"), F.sum("semantic_density").alias("d"), F.count("semantic_density").alias("nd"), F.sum("confidence").alias("c"), F.count("confidence").alias("nc"), F.sum("text_length").alias("l"), F.count("text_length").alias("nl"),
        F.min("text_length").alias("shortest"), F.max("text_length").alias("longest"),
    )
    by = lambda k, name: parts.groupBy("collection_name", k).agg(F.sum("n").alias("n")).groupBy("collection_name").agg(_distribution(k, name))
    mean = lambda s, n: F.sum(s) / F.nullif(F.sum(n), F.lit(0))
    total = parts.groupBy("collection_name").agg(F.sum("n").alias("total"), mean("d", "nd").alias("avg_density"), mean("c", "nc").alias("avg_confidence"), mean("l", "nl").alias("avg_length"), F.min("shortest").alias("min_length"), F.max("longest").alias("max_length"))
    return total.join(by("strategy", "strategies"), "collection_name").join(by("content_type", "content_types"), "collection_name")


def namespace_stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("total"), F.countDistinct("collection_name").alias("collections"), F.countDistinct("document_id").alias("documents"))


def metadata_summary(collections: DataFrame) -> DataFrame:
    """By dimension and granularity: the number of collections and the least, most and all of their vectors."""
    n = "total_embeddings"
    return collections.groupBy("dimension", "time_granularity").agg(F.count("*").alias("collections"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("vectors"))


def granularity_summary(collections: DataFrame) -> DataFrame:
    """By granularity: the first and the last day and the number of dimensions."""
    return collections.groupBy("time_granularity").agg(F.min("period1_start").alias("first_day"), F.max("period2_end").alias("last_day"), F.countDistinct("dimension").alias("dimensions"))


def date_span(collections: DataFrame, dimension: str) -> DataFrame:
    return collections.where(F.col("dimension") == dimension).agg(F.min("period1_start").alias("first_day"), F.max("period2_end").alias("last_day"))


def processing_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, chunks for each document, lengths and densities; zeros and nulls for no chunk."""
    each = [f(c).alias(f"{n}_{c}") for c in ("text_length", "semantic_density") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"), (F.count("*") / F.nullif(F.countDistinct("document_id"), F.lit(0))).alias("chunks_per_document"), *each)
