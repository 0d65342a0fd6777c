"""Near-duplicates: an inverted join of MinHash coordinates with prefix and skip merging, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import small_side, text_key, tidied, written
from tarnwell.llm.graph import components
from tarnwell.llm.npwords import Hasher, mix, shingle_set

#: Coordinates of a signature, and equal ones that a pair must have.  At a similarity of 0.75 the number of equal ones is
#: binomial (48, 0.75): fewer than 23 have a chance of 1e-5, and less above.
COORDINATES, MATCHES = 48, 23
#: A document posts under its rarest coordinates only: of MATCHES equal ones, one at least is among these in both documents.
PREFIX = COORDINATES - MATCHES + 1
#: Members of a list that one task compares with each other, and shingles of theirs; longer lists are cut into chunks.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
#: Shingles of the lists that share a task's group on average.
GROUP_SHINGLES = 1 << 19


def _multipliers() -> np.ndarray:
    return mix(np.arange(1, COORDINATES + 1, dtype="u8")) | np.uint64(1)


def _class_of(shingles: np.ndarray) -> int:
    total = np.add.reduce(mix(shingles), keepdims=True) + np.array([len(shingles)], dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(total).view("i8")[0])


def _signatures(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, by = Hasher(), _multipliers()
        for batch in batches:
            sizes, classes, sigs = [], [], []
            for w in hasher.texts(batch.column(1)):
                s = shingle_set(w, words)
                sizes.append(len(s))
                classes.append(_class_of(s))
                low = np.full(COORDINATES, np.uint64(2**64 - 1))
                for i in range(0, len(s), 2048):
                    np.minimum(low, (s[i : i + 2048, None] * by).min(0), out=low)
                sigs.append((low >> np.uint64(32)).astype("u4").view("i4"))
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, "i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1) * COORDINATES, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), lists, batch.column(2), batch.column(3)], ["doc_id", "n_shingles", "cls", "sig", "h1", "h2"])

    return rows


def _sets(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            sets = [shingle_set(w, words) for w in hasher.texts(batch.column(1))]
            own = [_class_of(s) == c for s, c in zip(sets, batch.column(0).to_pylist(), strict=True)]
            kept = pa.array([s.tobytes() for s, o in zip(sets, own, strict=True) if o], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(own, pa.bool_())), kept], ["cls", "shingles"])

    return rows


class Forest:
    """Which of n nodes links have united so far."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def unite(self, i: int, j: int) -> bool:
        """Whether i and j were apart until now."""
        x, y = self.of[i], self.of[j]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)
        return bool(x != y)


class Members:
    """Signatures and sets of some classes, compared within one task."""

    def __init__(self, rows: pa.Table):
        self.cls, self.n = rows["cls"].to_numpy(), rows["n"].to_numpy()
        self.sig = rows["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        self.sets = [np.frombuffer(x.as_buffer(), dtype="u8") for x in rows["shingles"]]
        self._coded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many shingles i has in common with each of others."""
        if len(others) < 8:
            x, out = self.sets[i], []
            for j in others:
                a, b = (x, self.sets[j]) if len(x) <= len(self.sets[j]) else (self.sets[j], x)
                out.append(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
            return np.array(out, dtype="i8")
        if self._coded is None:  # number the shingles of all members once
            names, codes = np.unique(np.concatenate(self.sets), return_inverse=True)
            self._coded = codes, np.concatenate([[0], np.cumsum(self.n)]), np.zeros(len(names), dtype=bool)
        codes, at, mine = self._coded
        mine[codes[at[i] : at[i + 1]]] = True
        hits = np.concatenate([[0], np.cumsum(mine[codes])])
        mine[codes[at[i] : at[i + 1]]] = False
        return hits[at[others + 1]] - hits[at[others]]

    def links(self, first: np.ndarray, second: np.ndarray, forest: Forest, percent: int) -> list[tuple[int, int]]:
        """Of the links between a row of first and one of second, those that unite two groups of the forest."""
        found = []
        for i in first:
            j = second[(forest.of[second] != forest.of[i]) & (100 * np.minimum(self.n[i], self.n[second]) >= percent * np.maximum(self.n[i], self.n[second]))]
            j = j[np.count_nonzero(self.sig[j] == self.sig[i], axis=1) >= MATCHES] if len(j) else j
            if len(j):
                both = self.common(i, j)
                found += [(i, k) for k in j[100 * both >= percent * (self.n[i] + self.n[j] - both)] if forest.unite(i, k)]
        return found


_LINKS = "a long, b long"


def _parts(rows: pa.Table, *keys: str) -> Iterator[pa.Table]:
    """The rows of each list (and chunk) of a group."""
    rows = rows.sort_by([(k, "ascending") for k in keys])
    new = np.zeros(len(rows), dtype=bool)
    for k in keys:
        v = rows[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    for part in np.split(np.arange(len(rows)), np.flatnonzero(new)):
        yield rows.slice(part[0], len(part))


def _table(pairs: list[np.ndarray]) -> pa.Table:
    both = np.concatenate([np.zeros((0, 2), "i8"), *pairs])
    return pa.table({"a": both.min(axis=1), "b": both.max(axis=1)}) if len(both) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _within(percent: int):
    """Links among the members of each chunk; its list's leader, which every chunk has, is compared first."""

    def links(rows: pa.Table) -> pa.Table:
        out = []
        for part in _parts(rows, "token", "chunk"):
            m, leader = Members(part), part["leader"].to_numpy()
            forest = Forest(len(m.cls))
            order = np.argsort(~leader, kind="stable")
            found = [p for k, i in enumerate(order) for p in m.links(order[k : k + 1], order[k + 1 :], forest, percent)]
            out += [m.cls[np.array(found)]] if found else []
        return _table(out)

    return links


def _between(percent: int):
    """Links between queries and the members of a chunk that other links have not united yet."""

    def links(rows: pa.Table) -> pa.Table:
        out = []
        for part in _parts(rows, "token", "query", "chunk"):
            m, asks = Members(part), part["asks"].to_numpy()
            forest = Forest(len(m.cls))
            forest.of = np.unique(part["root"].to_numpy(), return_inverse=True)[1]
            found = m.links(np.flatnonzero(asks), np.flatnonzero(~asks), forest, percent)
            out += [m.cls[np.array(found)]] if found else []
        return _table(out)

    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept, h1, h2 and group_class, for every row of docs.

    Rows whose sets are equal are one class, and one class takes part in the join whatever its number of copies.  Each class
    has a signature of COORDINATES minima and is posted under its (coordinate, value) pairs; pairs that no other class has
    cannot match.  Of the others a class keeps only its rarest (prefix), so that the MATCHES - 1 most frequent ones are
    skipped and merely counted when two members are merged, and lists with the same members are merged into one.

    A list, cut into chunks, goes with signatures and sets to tasks.  There collisions are counted, pairs with MATCHES equal
    coordinates are confirmed on their full sets, and only links that unite two groups leave the task, so a group's rows
    grow with its size.  Every chunk has its list's leader, too, which unites most of a long list.  Then the members of a
    longer list that are outside of its largest component are compared with all of its other chunks.

    The chance that two sets of similarity 0.75 have fewer than MATCHES equal coordinates is about 1e-5; no other link is lost.
    h1 and h2 are text_key() of the row's text, group_class stands for the row's component (null without shingles).

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing.  A null id is linked with
    nothing: its component_id is null and it is kept.  Repeated rows get equal results (they are one class).  Ties do not
    occur: the smallest id wins.  An empty table gives no rows.  Other columns of docs are not read.
    """
    with tidied() as kept:
        base, labels = _labelled(docs, id_col, text_col, words, percent, chunk)
        kept += [base, labels]
        labels = small_side(labels)
    out = base.select("doc_id", "n_shingles", "cls", "h1", "h2").join(labels, "cls", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    group = F.when(F.col("n_shingles") > 0, F.coalesce("root", "cls"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"), "h1", "h2", group.alias("group_class"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their classes, and of classes with copies or links the root and component_id."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), text_key(F.col(text_col)).alias("k"))
    given = given.select("doc_id", "text", "k.h1", "k.h2")
    base = written(given.mapInArrow(_signatures(words), "doc_id long, n_shingles long, cls long, sig array<int>, h1 long, h2 long"), "minhash")
    classes = base.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes, "classes")

    token = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    tokens = classes.select("cls", F.posexplode("sig")).select("cls", token.alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(shared, "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))  # COORDINATES at most
    prefix = F.slice("t", 1, F.greatest(F.lit(0), PREFIX - COORDINATES + F.size("t")))
    posted = written(ranked.select("cls", F.explode(prefix).alias("t")).select("cls", "t.token").join(classes.select("cls", "n"), "cls"), "posted")
    hashed = F.xxhash64("cls")
    lists = posted.groupBy("token").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.sum(hashed.cast("decimal(38,0)")).alias("same"), F.min_by("cls", F.xxhash64("cls", "token")).alias("first"))
    lists = lists.where("m > 1").groupBy("m", "shingles", "same").agg(F.min(F.struct("token", "first")).alias("l"))
    chunks = F.greatest(F.ceil(F.col("m") / chunk), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    lists = written(lists.select("l.token", "l.first", "m", "shingles", chunks.alias("chunks")), "lists")
    posted = written(posted.join(small_side(lists), "token").withColumn("chunk", F.pmod(hashed, F.col("chunks")).cast("int")), "listed")

    ids = written(classes.join(posted.select("cls").distinct(), "cls", "left_semi").select(F.col("rep").alias("doc_id"), "cls", "n", "sig"), "ids")
    texts = given.join(small_side(ids.select("doc_id", "cls")), "doc_id").select("cls", "text")
    sets = texts.mapInArrow(_sets(words), "cls long, shingles binary")
    # of an id that stands on rows with several texts, _sets keeps those of the class itself
    sets = written((sets.dropDuplicates(["cls"]) if _ids_repeat(base) else sets).join(ids.select("cls", "n", "sig"), "cls"), "sets")

    def dealt(rows: DataFrame, total: Column, of: DataFrame, links, *keys: str) -> DataFrame:
        """Lists with signatures and sets, several to a group of bounded size; total: the shingles that rows bring, summed over `of`."""
        groups = max(1, (of.agg(F.sum(total)).first()[0] or 0) // GROUP_SHINGLES)
        return rows.join(sets, "cls").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(groups))).repartition(groups, "bucket").groupBy("bucket").applyInArrow(links, _LINKS)

    inner = posted.where("cls <> first or chunks = 1").select("cls", "token", "chunk", (F.col("cls") == F.col("first")).alias("leader"))
    leaders = lists.where("chunks > 1").select(F.col("first").alias("cls"), "token", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("leader"))
    links = written(dealt(inner.union(leaders), F.col("shingles"), lists, _within(percent), "token", "chunk"), "links")

    long = posted.where("chunks > 1")
    if not long.isEmpty():
        own = written(long.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "long")
        largest = own.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.sum(F.lit(1)).alias("roots"))
        own = own.join(small_side(written(largest.where("roots > 1"), "largest")), "token").withColumn("asks", F.col("root") != F.col("largest"))
        asked = own.groupBy("token").agg(F.greatest(F.ceil(F.sum(F.col("asks").cast("int")) / chunk), F.ceil(F.sum(F.when(F.col("asks"), F.col("n"))) / CHUNK_SHINGLES)).cast("int").alias("queries"))
        own = written(own.join(small_side(written(asked, "asked")), "token"), "open")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cols = ["cls", "token", "root"]
        queries = own.where("asks").select(*cols, F.pmod(F.xxhash64(F.lit(5), "cls"), F.col("queries")).cast("int").alias("query"), every("chunks").alias("chunk"), F.lit(True).alias("asks"))
        others = own.select(*cols, "chunk", every("queries").alias("query"), F.lit(False).alias("asks")).select(*queries.columns)
        sent = F.col("n") * (F.col("queries") + F.when(F.col("asks"), F.col("chunks")).otherwise(0))  # a member goes to each query, one that asks to each chunk
        links = written(links.union(dealt(queries.union(others), sent, own, _between(percent), "token", "query", "chunk")), "links")
    final = written(components(links), "roots")

    known = classes.select("cls", "rep", "copies").join(final.withColumnRenamed("node", "cls"), "cls", "left").where("copies > 1 or root is not null")
    known = written(known, "known")
    least = known.where("root is not null").groupBy("root").agg(F.min("rep").alias("component_id"))
    return base, written(known.join(least, "root", "left").select("cls", "root", F.coalesce("component_id", "rep").alias("component_id")), "labels")


def _ids_repeat(base: DataFrame) -> bool:
    return not base.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
