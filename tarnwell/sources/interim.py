"""Interim tables in the folder that all executors share, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: A side of a join is broadcast only if it was written and its rows are no larger than this in memory.
BROADCAST_BYTES = 32 << 20
#: Rows of a batch that is sent to a Python task while an interim table is written.
BATCH_ROWS = 2000

_own_dir: list[str] = []
_open: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tarnwell-"))
    return _own_dir[0]


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Rows go to Python tasks in batches of BATCH_ROWS at most, or of `rows`: texts are long, and a task holds some batches at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, min(int(old), rows) if int(old) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def written(df: DataFrame, name: str, by: str | None = None, rows: int = BATCH_ROWS) -> DataFrame:
    """df as a written table (partitioned by a column, if one is named): lineage is cut, and a lost executor costs only a new read.

    Python tasks get at most `rows` rows of it at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, rows):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnwell_path = path
    if _open:
        _open[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tarnwell_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def memory_bytes(df: DataFrame) -> int:
    """Bytes that df's rows take in memory, counted over all rows; an item of an array counts 8 bytes for each of its fields and 16 more."""
    wide = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (StringType, BinaryType)):
            wide.append(F.octet_length(c))
        elif isinstance(kind, ArrayType):
            wide.append((16 + 8 * len(kind.elementType.fields) if isinstance(kind.elementType, StructType) else 8) * F.greatest(F.size(c), F.lit(0)))
    return df.agg(F.sum(sum([F.coalesce(w, F.lit(0)) for w in wide], F.lit(16 + 8 * len(df.columns))))).first()[0] or 0


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, with a broadcast hint if its rows are within the limit in memory; else Spark shuffles both sides."""
    return F.broadcast(df) if memory_bytes(df) <= limit else df


@contextmanager
def tidied() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those put into the list that is given."""
    kept: list[DataFrame] = []
    _open.append([])
    try:
        yield kept
    finally:
        made = _open.pop()
        paths = {df._tarnwell_path for df in kept}
        dropped(*[df for df in made if df._tarnwell_path not in paths])
        if _open:
            _open[-1] += [df for df in made if df._tarnwell_path in paths]
