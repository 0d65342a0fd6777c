"""Exact vector search, collections and granularity-balanced results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows that are compared at a time, when there are many queries.
QUERY_BLOCK, ROW_BLOCK = 256, 2048
#: More than a matrix product of unit vectors may be off.
SLACK = 1e-9


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine in double precision; null for a null or zero vector, or one of another length."""
    q = [float(x) for x in query]
    norm = sum(x * x for x in q) ** 0.5
    lit = F.array(*[F.lit(x) for x in q])
    dot = F.aggregate(F.zip_with(vector, lit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(vector) == len(q)) & (own > 0) & F.lit(norm > 0), dot / (own * F.lit(norm)))


def _packed(df: DataFrame, size: int, mark: str) -> DataFrame:
    """Rows id, grp and v, in blocks of at most `size`, each block one row of arrays."""
    each = df.withColumn("block", F.floor(F.monotonically_increasing_id() / size))
    return each.groupBy("block").agg(F.collect_list(F.struct("id", "grp", "v")).alias("r")).select(*[F.col(f"r.{c}").alias(mark + c) for c in ("id", "grp", "v")])


def _unit(vectors: pa.ListScalar) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors, in double precision, by length; without null, empty and zero vectors and those with a null."""
    of: dict[int, list[int]] = {}
    data = [None if v is None or any(x is None for x in v) else np.array(v, dtype="f8") for v in vectors.as_py()]
    for i, v in enumerate(data):
        if v is not None and v.any():
            of.setdefault(len(v), []).append(i)
    out = {}
    for n, places in of.items():
        m = np.stack([data[i] for i in places])
        out[n] = np.array(places), m / np.sqrt((m * m).sum(1))[:, None]
    return out


def best_of(q: np.ndarray, m: np.ndarray, sims: np.ndarray, part: np.ndarray, k: int | None, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows `part` the k most similar to a query, with all that tie with the k-th, and their cosines, each summed by itself.

    sims, of a matrix product, are summed in an order that depends on where a row stands in its block, so equal vectors may
    differ there in the last digits.  Summed one by one they tie, and ids decide.
    """
    part = part[~np.isnan(sims[part])]
    if k and len(part) > k:
        s = sims[part]
        part = part[s >= np.partition(s, len(s) - k)[len(s) - k] - SLACK - (10.0**-digits if digits is not None else 0.0)]
    out = (m[part] * q).sum(1)
    if digits is not None:
        out = np.round(out, digits) + 0.0
    if k and len(part) > k:
        last = out >= np.partition(out, len(out) - k)[len(out) - k]
        part, out = part[last], out[last]
    return part, out


def search_all(vectors: DataFrame, queries: DataFrame, k: int | None = 10, threshold: float = 0.0, filters: dict[str, object] | None = None, by: list[str] | None = None, vector: str = "embedding", id_col: str = "chunk_id", digits: int | None = None) -> DataFrame:
    """search() for each row of queries (query_id and the vector), as query_id, id, the columns `by` and similarity.

    Blocks of QUERY_BLOCK queries meet blocks of ROW_BLOCK rows, every pair once, as one matrix product; a pair of blocks
    passes on the k best of each query (and collection), of which the k best of all are taken.  With `digits`, similarities
    are rounded before they are ranked.
    """
    for c, v in (filters or {}).items():
        if c in vectors.columns:
            vectors = vectors.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v))
    by = by or []
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = _packed(vectors.select(F.col(id_col).alias("id"), group.alias("grp"), F.col(vector).alias("v")), ROW_BLOCK, "r")
    asked = _packed(queries.select(F.col("query_id").alias("id"), F.lit("").alias("grp"), F.col(vector).alias("v")), QUERY_BLOCK, "q").drop("qgrp")
    id_type, query_type = kinds[id_col], queries.schema["query_id"].dataType.simpleString()
    fields = f"query_id {query_type}, id {id_type}, grp string, similarity double"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(c) for c in batch.schema.names}
            schema = pa.schema([("query_id", at["qid"].type.value_type), ("id", at["rid"].type.value_type), ("grp", pa.string()), ("similarity", pa.float64())])
            for i in range(batch.num_rows):
                ids, groups = at["rid"][i].values, np.array(at["rgrp"][i].as_py(), dtype=object)
                found = _unit(at["rv"][i])
                for n, (asking, q) in _unit(at["qv"][i]).items():
                    if n not in found:
                        continue
                    places, m = found[n]
                    parts = [np.flatnonzero(groups[places] == g) for g in sorted(set(groups[places]))]
                    sims = q @ m.T
                    for row, own, s in zip(asking, q, sims, strict=True):
                        took = []
                        for part in parts:
                            p, of = best_of(own, m, s, part, k, digits)
                            if threshold > 0:
                                p, of = p[of >= threshold], of[of >= threshold]
                            s[p] = of
                            took.append(p)
                        t = np.concatenate(took)
                        if len(t):
                            where = pa.array(places[t])
                            yield pa.RecordBatch.from_arrays([pa.array([at["qid"][i].values[int(row)].as_py()] * len(t), schema.field(0).type), ids.take(where), pa.array(groups[places[t]], pa.string()), pa.array(s[t])], schema=schema)

    found = rows.crossJoin(asked).select("rid", "rgrp", "rv", "qid", "qv").mapInArrow(pairs, fields)
    if k:
        order = Window.partitionBy("query_id", "grp").orderBy(F.desc("similarity"), "id")
        found = found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    named = [F.from_json("grp", shape).getField(c).alias(c) for c in by]
    return found.select("query_id", F.col("id").alias(id_col), *named, "similarity")


def search(vectors: DataFrame, query: list[float], k: int | None = 10, threshold: float = 0.0, filters: dict[str, object] | None = None, by: list[str] | None = None, vector: str = "embedding", id_col: str = "chunk_id") -> DataFrame:
    """Rows by falling similarity, those under a positive threshold left out; with `by`, the k best of each collection.

    A list filters by membership, any other value by equality; names that are no column are ignored.  Ties by id.  Every
    row is compared, so recall is exact; a whole-table top k needs no shuffle but of k rows of each task.
    """
    for c, v in (filters or {}).items():
        if c in vectors.columns:
            vectors = vectors.where(F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v))
    found = vectors.withColumn("similarity", cosine(F.col(vector), query)).where("similarity is not null")
    if threshold > 0:
        found = found.where(F.col("similarity") >= threshold)
    order = [F.desc("similarity"), F.asc(id_col)]
    if by and k:
        found = found.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= k).drop("__rn")
        return found
    return found.orderBy(*order).limit(k) if k else found


def balanced(results: DataFrame, k: int, most: int, gran: str = "gran", id_col: str = "chunk_id", sim: str = "sim", each: str | None = None) -> DataFrame:
    """k results spread over granularities; with `each`, k results of each of its values (such as queries).

    Granularities rank by their number of results, best similarity and name.  With two or more, the best result of each of
    the first `most` comes first, and what is left of k is filled granularity by granularity; else the best k overall.
    The input is a search's result, k rows of each collection.
    """
    e = [each] if each else []
    own = Window.partitionBy(*e)
    grans = results.groupBy(*e, gran).agg(F.count("*").alias("n"), F.max(sim).alias("best"))
    grans = grans.withColumn("g", F.row_number().over(own.orderBy(F.desc("n"), F.desc("best"), gran))).withColumn("t", F.least(F.lit(most), F.count("*").over(own)))
    x = results.join(grans.select(*e, gran, "g", "t"), [*e, gran]).withColumn("rn", F.row_number().over(Window.partitionBy(*e, gran).orderBy(F.desc(sim), id_col)))
    lead = (F.col("t") >= 2) & (F.col("g") <= F.col("t")) & (F.col("rn") == 1)
    x = x.withColumn("lead", lead).withColumn("led", F.max(F.col("lead").cast("int")).over(Window.partitionBy(*e, id_col)))
    x = x.withColumn("d", F.row_number().over(Window.partitionBy(*e, id_col, "lead").orderBy("g", "rn")))
    x = x.withColumn("n", F.count(F.when(F.col("lead"), 1)).over(own))
    rest = x.where("not lead and (t < 2 or (led = 0 and d = 1))").withColumn("o", F.row_number().over(own.orderBy(*[F.when(F.col("t") >= 2, F.col(c)) for c in ("g", "rn")], F.desc(sim), id_col)))
    return x.where("lead").unionByName(rest.where(F.col("o") <= F.lit(k) - F.col("n")).drop("o")).select(*e, gran, id_col, sim)


def overlapping(collections: DataFrame, start: int, end: int) -> DataFrame:
    """Collections of which either period (YYYYMMDD integers) overlaps the range."""
    hit = lambda p: (F.col(f"{p}_start") <= end) & (F.col(f"{p}_end") >= start)
    return collections.where(hit("period1") | hit("period2"))


#: Names of granularities in collection names.
GRANULARITIES = ("dod", "wow", "mom", "qoq", "yoy")


def parsed_name(name: Column) -> Column:
    """dimension, granularity and the four dates of names such as `brand_qoq_20250601_20250831_vs_20250901_20251130`."""
    pattern = rf"^(?:(.+)_)?({'|'.join(GRANULARITIES)})_(\d{{8}})_(\d{{8}})_vs_(\d{{8}})_(\d{{8}})(?:_date_\w+)?$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    dates = ("period1_start", "period1_end", "period2_start", "period2_end")
    return F.struct(F.coalesce(part(1), F.lit("overall")).alias("dimension"), part(2).alias("time_granularity"), *[part(k + 3).cast("int").alias(d) for k, d in enumerate(dates)])


def collection_metadata(vectors: DataFrame) -> DataFrame:
    """One row for each collection: its parsed name, its dimension values and its number of vectors."""
    value = F.when(F.trim("dimension_value") != "", F.col("dimension_value"))
    stats = vectors.groupBy("collection_name").agg(F.count("*").alias("total_embeddings"), F.array_sort(F.collect_set(value)).alias("dimension_values"))
    return stats.withColumn("p", parsed_name(F.col("collection_name"))).select("collection_name", "p.*", "dimension_values", "total_embeddings")


def subtree(chunks: DataFrame, path: str, depth: int) -> DataFrame:
    """Chunks below a path, at most so many levels deeper."""
    return chunks.where(F.col("path").startswith(path) & (F.col("level") <= len(path.split(".")) + depth)).orderBy("level", "path")


def budget(names: dict[str, list[str]], most: int) -> dict[str, list[str]]:
    """Collections to search, of each granularity the latest by name, `most` in all.

    By name of the granularity: one of each, then an even share of what is left (the first ones get the remainder of that
    division), then one each in turn while there are any.
    """
    grans = sorted(g for g in names if names[g])
    left = min(most, sum(len(names[g]) for g in grans))
    if left == sum(len(names[g]) for g in grans):
        return {g: sorted(names[g]) for g in grans}
    take = dict.fromkeys(grans, 0)

    def give(gran: str, n: int) -> None:
        nonlocal left
        n = min(n, len(names[gran]) - take[gran], left)
        take[gran], left = take[gran] + n, left - n

    for g in grans:
        give(g, 1)
    share, more = divmod(left, len(grans))
    for k, g in enumerate(grans):
        give(g, share + (k < more))
    while left:
        for g in grans:
            give(g, 1)
    return {g: sorted(names[g])[-take[g] :] for g in grans if take[g]}


def search_text(vectors: DataFrame, text: str, encoder: Callable[[list[str]], list[list[float]]], k: int | None = 10, threshold: float = 0.0, **options) -> DataFrame:
    """search() for a text, by an encoder of lists of texts."""
    return search(vectors, encoder([text])[0], k, threshold, **options)
