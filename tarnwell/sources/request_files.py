"""A data source of batch files: JSON lines, split at the limits of a batch, that appear when a write is committed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Lines and bytes of a batch file; a line that is longer has a file of its own.
MOST_LINES, MOST_BYTES = 50_000, 100 << 20
STAGED, COMMITS = "_staged", "_commits"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    """One partition for each committed file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        fs, root = _opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
        names = []
        for info in found:
            if info.path.endswith(".json"):
                with fs.open_input_stream(info.path) as f:
                    names += json.loads(f.read())["files"]
        return [_File(n) for n in sorted(set(names))] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _opened(self.path)
        lines, size, rest = [], 0, b""
        with fs.open_input_stream(f"{root}/{partition.name}") as f:
            while block := f.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                lines += [x.decode() for x in whole]
                size += len(block)
                if size > 8 << 20:
                    yield self._batch(lines, partition.name)
                    lines, size = [], 0
        if lines:
            yield self._batch(lines, partition.name)

    @staticmethod
    def _batch(lines: list[str], name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([name] * len(lines), pa.string())], ["value", "file"])


@dataclass
class _Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is, and its name after the commit


class _Writer(DataSourceArrowWriter):
    """Tasks write to a folder of the write's own; the commit moves their files and then lists them in one file of its own.

    What is not listed is not there: neither files of a failed or repeated task nor those of a write that was broken off.
    A write under a batch id that was committed before leaves everything as it is.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.lines, self.bytes = int(options.get("max_lines", MOST_LINES)), int(options.get("max_bytes", MOST_BYTES))
        self.batch = options.get("batch_id") or uuid.uuid4().hex
        self.mark = hashlib.sha256(self.batch.encode()).hexdigest()[:16]  # batch ids may hold any character
        self.job = uuid.uuid4().hex

    def _done(self, fs: pafs.FileSystem, root: str) -> bool:
        return fs.get_file_info(f"{root}/{COMMITS}/{self.mark}.json").type == pafs.FileType.File

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Staged:
        fs, root = _opened(self.path)
        if self._done(fs, root):
            return _Staged([])
        place, task = f"{root}/{STAGED}/{self.job}/{uuid.uuid4().hex}", TaskContext.get().partitionId()
        made, out, lines, size = [], None, 0, 0
        for batch in batches:
            for line in batch.column(batch.schema.get_field_index("value")):
                raw = line.as_buffer().to_pybytes() + b"\n" if line.is_valid else b""
                if not raw:
                    continue
                if out is None or lines >= self.lines or size + len(raw) > self.bytes:
                    if out is not None:
                        out.close()
                    fs.create_dir(place, recursive=True)
                    name = f"{self.mark}-{task:05}-{len(made):05}.jsonl"
                    made.append((f"{place}/{name}", name))
                    out, lines, size = fs.open_output_stream(f"{place}/{name}"), 0, 0
                out.write(raw)
                lines, size = lines + 1, size + len(raw)
        if out is not None:
            out.close()
        return _Staged(made)

    def commit(self, messages: list[_Staged | None]) -> None:
        fs, root = _opened(self.path)
        fs.create_dir(f"{root}/{COMMITS}", recursive=True)
        if not self._done(fs, root):
            files = [f for m in messages if m for f in m.files]
            for staged, name in files:
                fs.move(staged, f"{root}/{name}")
            at = f"{root}/{COMMITS}/{self.mark}.json"
            with fs.open_output_stream(f"{at}.{self.job}") as f:
                f.write(json.dumps({"batch": self.batch, "files": [n for _, n in files]}).encode())
            fs.move(f"{at}.{self.job}", at)
        self._cleared(fs, root)

    def abort(self, messages: list[_Staged | None]) -> None:
        self._cleared(*_opened(self.path))

    def _cleared(self, fs: pafs.FileSystem, root: str) -> None:
        place = f"{root}/{STAGED}/{self.job}"
        if fs.get_file_info(place).type == pafs.FileType.Directory:
            fs.delete_dir(place)


class BatchFiles(DataSource):
    """Format `batch_files`: reads value (a line) and file; writes a column `value`, by append alone.

    Options: path, max_lines and max_bytes of a file, and batch_id, under which a write is done once however often it is
    tried.  Paths are those of pyarrow's file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "batch_files"

    def schema(self) -> str:
        return "value string, file string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("batch files are appended; write to a new folder instead")
        if "value" not in schema.names:
            raise ValueError("no column value")
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BatchFiles)


def write_lines(lines: DataFrame, path: str, batch_id: str | None = None, max_lines: int = MOST_LINES, max_bytes: int = MOST_BYTES) -> None:
    """Append the column `value` of lines as batch files; with a batch id once, however often it is called.  Null lines are left out."""
    register(lines.sparkSession)
    options = {"path": path, "max_lines": max_lines, "max_bytes": max_bytes} | ({"batch_id": batch_id} if batch_id else {})
    lines.select("value").write.format("batch_files").mode("append").options(**options).save()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and file of every committed line."""
    register(spark)
    return spark.read.format("batch_files").option("path", path).load()


def stream_lines(stream: DataFrame, path: str, checkpoint: str, name: str, max_lines: int = MOST_LINES):
    """Write each micro-batch of a stream (column `value`) as batch files, once: a batch that is done again after a failure
    finds its id committed.  `name` is the stream's own, the same after a restart."""
    return (
        stream.writeStream.foreachBatch(lambda df, batch: write_lines(df, path, f"{name}-{batch}", max_lines))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
