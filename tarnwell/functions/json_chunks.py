"""JSON documents as rows: the nodes of each, its profile, and the places of rows in large groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from tarnwell.functions.json_walk import Walk, dimensional_chunks
from tarnwell.sources.interim import written

#: What leaves() tells of a node, beside document_id.
NODE = "path string, level int, parent string, key string, pos int, kind string, shape string, n int, text string, chars int, bytes long, listed boolean, open boolean, rich boolean, uniform boolean, deepest int, keys long, arrays boolean, own array<string>, json string"
#: Nodes or chunks of a batch that a task passes on, and characters of the documents that it is made of.
BATCH_NODES, BATCH_CHARS = 50_000, 8 << 20
OF_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def as_text(docs: DataFrame) -> DataFrame:
    """document_id and t, the compact JSON of the documents (VARIANT) that are not null; documents may have come to t before."""
    return docs.select("document_id", "t") if "doc" not in docs.columns else docs.where("doc is not null").select("document_id", F.to_json("doc").alias("t"))


def leaves(spark: SparkSession, docs: DataFrame, top: int = -1) -> DataFrame:
    """Every node of each document, the root included: one row each, made in one pass over the document within its row.

    path is $.a.b[0]; a key that holds a dot, a bracket or a quote stands in brackets as a JSON string.  parent is the path
    above, key is null for an item of an array, pos the place among the siblings.  kind is object, array, text, numeric,
    boolean or null, shape the type that a number has (a decimal without fraction counts as a whole number), n the number of
    keys or items, own the keys.  text is the value of a text, chars and bytes (the root's) the length of the compact JSON,
    json that JSON itself for levels up to `top`.  listed: an array lies above.  rich: one of the first five items is an
    object or an array.  open: no array above holds plain values only or other arrays.  uniform: an array of several items
    of one kind, objects with the same keys.  deepest, keys and arrays tell of the nodes below: the deepest level, how many
    have a key, and whether there is an array.
    """
    given = as_text(docs)
    kind = given.schema["document_id"].dataType.simpleString()
    names = ["document_id", *[c.split()[0] for c in NODE.split(", ")]]
    kinds = [OF_ARROW[c.split()[1]] for c in NODE.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, documents = [[] for _ in kinds], []

            def flush(columns: list[list], documents: list[int], ids: pa.Array = batch.column(0)) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([ids.take(pa.array(documents, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

            for row, text in enumerate(batch.column(1)):
                w = Walk(text.as_py())
                size = len(w)
                parents = [None, *[w.path[p] for p in w.parent[1:]]]
                chars = [e - s for s, e in zip(w.start, w.end, strict=True)]
                own = [w.own.get(i, []) if w.kind[i] == "object" else None for i in range(size)]
                shown = [w.part(i) if w.level[i] <= top else None for i in range(size)] if top >= 0 else [None] * size
                made = (w.path, w.level, parents, w.key, w.pos, w.kind, w.shape, w.n, w.text, chars, [w.bytes(0)] + [None] * (size - 1), w.listed, w.open, w.rich, w.uniform, w.deepest, w.keys, w.arrays, own, shown)
                for c, x in zip(columns, made, strict=True):
                    c += x
                documents += [row] * size
                if len(documents) >= BATCH_NODES:
                    yield flush(columns, documents)
                    columns, documents = [[] for _ in kinds], []
            if documents:
                yield flush(columns, documents)

    return given.mapInArrow(rows, f"document_id {kind}, {NODE}")


def profile(nodes: DataFrame) -> DataFrame:
    """Structure of each document: depth, objects, arrays and leaves."""
    kind = F.col("kind")  # of the whole document, the root included
    count = lambda c: F.count(F.when(c, 1))
    return nodes.groupBy("document_id").agg(F.max("level").alias("max_depth"), count(kind == "object").alias("objects"), count(kind == "array").alias("arrays"), count(~kind.isin("object", "array")).alias("leaves"))


def called(docs: DataFrame, function: UserDefinedTableFunction, keep: tuple[str, ...] = (), **options: object) -> DataFrame:
    """document_id and what a table function gives of each document's JSON text; documents go to it in Arrow batches.

    keep: columns that stand beside the JSON text `t` (or that text itself) and go along into each row.
    A table function that is not made by json_walk.table_function is called by a lateral join.
    """
    given = docs.select("document_id", "t", *[F.col(c).alias(f"__{c}") for c in keep]) if keep else as_text(docs)
    if not hasattr(function, "called"):
        made = function(F.col("d.t").outer(), **{n: F.lit(v) for n, v in options.items()})
        return given.alias("d").lateralJoin(made.alias("c")).select("d.document_id", "c.*")
    schema, chunks, defaults = function.called
    if unknown := set(options) - set(defaults):
        raise ValueError(f"no option {', '.join(sorted(unknown))}; there are {', '.join(defaults)}")
    given_options = defaults | options
    columns = [c.split() for c in (schema(**given_options) if callable(schema) else schema).split(", ")]
    kind = given.schema["document_id"].dataType.simpleString()
    kept = "".join(f", `{c}` {given.schema[f'__{c}'].dataType.simpleString()}" for c in keep)

    def flushed(batch: pa.RecordBatch, documents: list[int], made: list[tuple]) -> pa.RecordBatch:
        out, at = _batch(batch.column(0), documents, made, columns), pa.array(documents, pa.int64())
        for k, c in enumerate(keep):
            out = out.append_column(c, batch.column(2 + k).take(at))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, documents, held = [], [], 0
            for row, text in enumerate(batch.column(1)):
                t = text.as_py()
                for c in chunks(Walk(t), **given_options):
                    made.append(c)
                    documents.append(row)
                held += len(t)
                if len(made) >= BATCH_NODES or held >= BATCH_CHARS:
                    yield flushed(batch, documents, made)
                    made, documents, held = [], [], 0
            if made:
                yield flushed(batch, documents, made)

    return given.mapInArrow(rows, f"document_id {kind}, {', '.join(f'`{n}` {k.replace('long', 'bigint')}' for n, k in columns)}{kept}")


def _batch(ids: pa.Array, documents: list[int], made: list[tuple], columns: list[list[str]]) -> pa.RecordBatch:
    """Rows of documents, whose ids are taken from theirs."""
    values = zip(*made, strict=True) if made else [()] * len(columns)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(documents, pa.int64())), *[pa.array(v, OF_ARROW[k]) for v, (_, k) in zip(values, columns, strict=True)]], ["document_id", *[n for n, _ in columns]])


def whole_dimensional_chunks(spark: SparkSession, docs: DataFrame, least: int = 50, size: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """document_id, kind, path, slice, items and content of all chunks of each document; every value is in one chunk.

    kind `array`: the slices of each large array, wherever it stands (one inside of another goes with that).  kind
    `remaining`: what is in no large array, `size` leaves to a chunk in path order, as the JSON object of their paths and
    values; empty objects and arrays are leaves, and a large array leaves a reference.
    """
    return called(docs, dimensional_chunks, keep, least=least, size=size)


#: Rows of a range, on average, when positions in large groups are found.
RANGE_ROWS = 50_000


def positions(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with pos, the place in its group by `order` (nulls last), and total, the group's rows.

    No group is gathered: rows are dealt out by ranges of group and order, so that a large group lies in many ranges; rows
    are counted by group and range, the counts are summed up, and only a range's rows of a group are put in order together.
    """
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, *[F.asc_nulls_last(c) for c in (*by, order)]) if ranges > 1 else rows.coalesce(1)
    placed = written(dealt.withColumn("__range", F.spark_partition_id()), "placed")
    whole = Window.partitionBy(*by)
    counts = placed.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("__n").over(whole)})
    keys = [*by, "__range"]
    at = counts.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(keys)], "__before", "total")
    same = [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(keys)]
    found = placed.join(at, same).withColumn("pos", F.col("__before") + F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(order))) - 1)
    return found.drop("__range", "__before", *[f"__c{i}" for i in range(len(keys))])


def dimension_value(path: Column) -> Column:
    """The name after `dimension_analyses` in a path, unless it is a number."""
    name = F.regexp_extract(path, r"dimension_analyses\.([^.\[]+)", 1)
    return F.when((name != "") & ~name.rlike(r"^\d+$"), name)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def worth_storing(text: Column, density: Column, shortest: int = 10, least: float = 0.1) -> Column:
    return (F.length(F.trim(text)) > 0) & (F.length(text) >= shortest) & (density >= least)
