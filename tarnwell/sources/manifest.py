"""Incremental ingest: a log of the files that were read, compared with a folder's listing, so that only changes are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import store
from tarnwell.sources.interim import dropped, small_side, written

#: An entry of the log; the latest one of a path counts.
ENTRY = "path string, document_id string, length long, modified timestamp, hash string, gone boolean, run long"
#: Files that are read and stored together; a failure loses one such block at most.
BLOCK_FILES = 10_000
#: Tasks that look up the files of a block.
LISTING_TASKS = 32


def _root(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def listing(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """path, document_id (the path below the folder without its ending), length and modified of every file; no file is opened."""
    root = _root(spark, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    below = F.substring(F.col("path"), len(root) + 2, 1 << 30)
    return files.select("path", F.regexp_replace(below, r"\.[^./]*$", "").alias("document_id"), "length", F.col("modificationTime").alias("modified"))


def _log(spark: SparkSession, log: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(log)


def known(spark: SparkSession, log: str) -> DataFrame:
    """The files that the log says are stored."""
    latest = _log(spark, log).groupBy("path").agg(F.max_by(F.struct("document_id", "length", "modified", "hash", "gone", "run"), "run").alias("e"))
    return latest.select("path", "e.*").where("not gone").drop("gone", "run")


def changes(files: DataFrame, stored: DataFrame) -> DataFrame:
    """path, document_id, length, modified, old hash and status of every file that is new, changed (in length or time) or gone."""
    old = stored.select("path", F.col("document_id").alias("o_id"), F.col("length").alias("o_length"), F.col("modified").alias("o_modified"), "hash")
    status = F.when(F.col("o_id").isNull(), "new").when(F.col("document_id").isNull(), "gone").when((F.col("length") != F.col("o_length")) | (F.col("modified") != F.col("o_modified")), "changed")
    both = files.join(old, "path", "full").withColumn("status", status).where("status is not null")
    return both.select("path", F.coalesce("document_id", "o_id").alias("document_id"), "length", "modified", "hash", "status")


def blocks(changed: DataFrame, size: int = BLOCK_FILES) -> Iterator[list[str]]:
    """Paths to read, the smallest files first, so many at a time; the driver holds one block."""
    held: list[str] = []
    for r in changed.where("status <> 'gone'").orderBy("length", "path").select("path").toLocalIterator():
        held.append(r["path"])
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, hash and body (text) of these files; Spark deals them out to tasks by their sizes.

    Spark looks up the paths in as many tasks as there are paths, each of which sends the driver far more than its file's
    entry; here LISTING_TASKS look up all of them.
    """
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key)
    spark.conf.set(key, min(int(old), LISTING_TASKS))
    try:
        read = spark.read.format("binaryFile").load([p.replace("{", "\\{").replace("[", "\\[").replace("*", "\\*").replace("?", "\\?") for p in paths])
    finally:
        spark.conf.set(key, old)
    return read.select("path", F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("body"))


@contextmanager
def _entries(spark: SparkSession, log: str, run: int):
    """Entries that are appended to the log when the block ends well, in one commit."""
    made: list[DataFrame] = []
    yield made
    for df in made:
        df.select("path", "document_id", "length", "modified", "hash", F.lit(False).alias("gone") if "gone" not in df.columns else "gone", F.lit(run).cast("long").alias("run")).write.mode("append").parquet(log)


def ingest_changes(spark: SparkSession, folder: str, log: str, namespace: str, chunks_of: Callable[[DataFrame], DataFrame], pattern: str = "*.json", block: int = BLOCK_FILES) -> dict[str, int]:
    """Bring a namespace of vectors up to date with a folder of JSON files; the numbers of files by what was done.

    chunks_of makes rows of a namespace (store.SCHEMA; document_id at least) from document_id and doc (VARIANT, null for text
    that is no JSON).  Only new and changed files are opened; one whose bytes are the same after all is noted and left alone.
    A changed document's rows are replaced, a gone one's deleted.  Files are stored block by block, the smallest first, and a
    block's log entries are written after its rows: a run that fails is done again from that block on, and doing a block
    again gives the same rows.
    """
    run = (_log(spark, log).agg(F.max("run")).first()[0] or 0) + 1
    found = written(changes(listing(spark, folder, pattern), known(spark, log)), "changes")
    done = {s: 0 for s in ("new", "changed", "same", "gone")}
    for paths in blocks(found, block):
        read = written(contents(spark, paths), "contents")
        files = written(found.drop("hash").join(read.select("path", "hash"), "path").join(found.select("path", F.col("hash").alias("old")), "path").withColumn("same", F.col("hash").eqNullSafe(F.col("old"))), "files")
        fresh = files.where("not same").join(read.select("path", "body"), "path").select("document_id", F.try_parse_json("body").alias("doc"))
        with _entries(spark, log, run) as entries:
            ids = files.where("not same").select("document_id")
            if not ids.isEmpty():
                store.replace_documents(spark, namespace, ids, chunks_of(fresh))
            entries.append(files)
        for r in files.groupBy("status", "same").count().collect():  # a row for each status
            done["same" if r["same"] else r["status"]] += r["count"]
        dropped(read, files)
    gone = found.where("status = 'gone'")
    if n := gone.count():
        with _entries(spark, log, run) as entries:
            store.replace_documents(spark, namespace, gone.select("document_id"), None)
            entries.append(gone.withColumn("gone", F.lit(True)))
        done["gone"] = n
    dropped(found)
    return done


def compacted(spark: SparkSession, log: str, target: str) -> None:
    """The log's present state as a new log of one entry for each file."""
    small_side(written(known(spark, log), "log")).withColumns({"gone": F.lit(False), "run": F.lit(0).cast("long")}).select(*[c.split()[0] for c in ENTRY.split(", ")]).write.parquet(target)
