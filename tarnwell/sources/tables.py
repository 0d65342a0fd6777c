"""Readers of tables and documents, and writers of chunks and vectors."""

from __future__ import annotations

from functools import reduce
from operator import and_
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id (the file's stem), body (text) and doc (VARIANT; null for text that is no JSON), one row for each file."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    name = F.element_at(F.split("file", "/"), -1)
    return raw.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("document_id"), F.col("value").alias("body"), F.try_parse_json("value").alias("doc"))


def metric_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a KPI file that have a name and a type."""
    rows = spark.read.csv(path, header=True)
    return rows.where("trim(Metric_Name) <> '' and trim(Metric_Type) <> ''")


def export_chunks(chunks: DataFrame, path: str, kind: str = "jsonl") -> None:
    flat = chunks.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) and kind == "csv" else F.col(c) for c, t in chunks.dtypes])
    match kind:
        case "json" | "jsonl":
            flat.write.json(path)
        case "csv":
            flat.write.csv(path, header=True)
        case _:
            raise ValueError(f"unknown format {kind}")


def new_vectors(vectors: DataFrame, stored: DataFrame) -> DataFrame:
    """Vectors whose chunk_id, and whose text within its document, are not stored yet.

    Of several new ones with one chunk_id, or one text of a document, the first by chunk_id and all other columns stays.  A
    null text_hash, document_id or chunk_id is like no other.
    """
    cols = [F.col(c) for c in vectors.columns]

    def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
        known = reduce(and_, [F.col(k).isNotNull() for k in keys])
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_id", F.to_json(F.struct(*cols))))
        return rows.where(~known).union(rows.where(known).withColumn("__rank", rank).where("__rank = 1").drop("__rank"))

    fresh = first_of(first_of(vectors, ["chunk_id"]), ["text_hash", "document_id"])
    fresh = fresh.join(stored.select("chunk_id"), "chunk_id", "left_anti")
    return fresh.join(stored.select("text_hash", "document_id"), ["text_hash", "document_id"], "left_anti").select(*vectors.columns)


def namespace_path(root: str, namespace: str) -> str:
    """The folder of a namespace; its name is checked."""
    if not namespace or len(namespace) > 50 or namespace in {"backup", "temp", "tmp", "system", "admin"} or not all(c.isdigit() or c == "_" or "a" <= c <= "z" for c in namespace):
        raise ValueError(f"not a namespace: {namespace!r}")
    return str(PurePosixPath(root) / f"embeddings_{namespace}")
