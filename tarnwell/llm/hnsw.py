"""Near-duplicate vectors: navigable small-world graphs for each shard, audited beams, components of confirmed links."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import small_side, tidied, written
from tarnwell.llm.graph import components
from tarnwell.llm.npwords import mix

#: Vectors of a shard at most (a shard's graph lies in one task's memory); a label has as many shards as it needs.
SHARD = 8192
#: Neighbours of a node in upper layers (twice as many in the lowest), beam while building, first beam while searching.
NEIGHBOURS, BUILD_BEAM, BEAM = 12, 48, 32
#: The widest beam; a shard whose audit still fails with it is compared in whole blocks.
WIDEST = 512
#: Queries of a shard that are held against brute force, and of these the ones of which nearest vectors are audited, too.
#: Of the links, and of the AUDIT_NEAREST nearest vectors, this share must be found, as a mean over the queries.
AUDIT, AUDIT_PLAIN, AUDIT_NEAREST, RECALL = 192, 24, 3, 0.95
#: Rows of a block that is compared as a matrix product.
BLOCK = 256


class Graph:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, x: np.ndarray, layers: list[dict[int, np.ndarray]] | None = None, entry: int = -1, ids: np.ndarray | None = None):
        self.x, self.layers, self.entry = x, layers if layers is not None else [], entry
        if layers is None:
            draw = (mix(ids.astype("u8")) >> np.uint64(11)).astype("f8") / 2**53
            tops = np.minimum((-np.log(np.maximum(draw, 1e-18)) / np.log(NEIGHBOURS)).astype(int), 8)
            for i in range(len(x)):
                self._insert(i, int(tops[i]))

    def _insert(self, i: int, top: int) -> None:
        q, at = self.x[i], [self.entry] if self.entry >= 0 else []
        for level in range(len(self.layers) - 1, -1, -1):
            if level > top:
                at = [n for _, n in self.search(q, at, 1, level)][:1] or at
                continue
            found = self.search(q, at, BUILD_BEAM, level)
            most = NEIGHBOURS * (2 if level == 0 else 1)
            mine = self._spread(found, NEIGHBOURS)
            layer = self.layers[level]
            layer[i] = np.array(mine, dtype="i4")
            for n in mine:
                theirs = np.append(layer[n], np.int32(i))
                if len(theirs) > most:
                    near = self.x[theirs] @ self.x[n]
                    ranked = sorted(zip(near.tolist(), theirs.tolist(), strict=True), reverse=True)
                    theirs = np.array(self._spread(ranked, most), dtype="i4")
                layer[n] = theirs
            at = [n for _, n in found]
        for _ in range(len(self.layers), top + 1):
            self.layers.append({i: np.zeros(0, dtype="i4")})
            self.entry = i
        if self.entry < 0:
            self.entry = i

    def _spread(self, ranked: list[tuple[float, int]], most: int) -> list[int]:
        """Of candidates, nearest first, those nearer to the node than to one already taken; then the nearest others."""
        if len(ranked) <= most:
            return [n for _, n in ranked]
        ids = np.array([n for _, n in ranked])
        each = self.x[ids] @ self.x[ids].T
        taken: list[int] = []
        for k, (near, _) in enumerate(ranked):
            if len(taken) == most:
                break
            if not taken or each[k, taken].max() < near:
                taken.append(k)
        rest = [k for k in range(len(ranked)) if k not in set(taken)][: most - len(taken)]
        return [int(ids[k]) for k in taken + rest]

    def search(self, q: np.ndarray, starts: list[int], beam: int, level: int) -> list[tuple[float, int]]:
        """The beam's (cosine, node), nearest first."""
        layer, seen = self.layers[level], set(starts)
        near = [(float(self.x[s] @ q), s) for s in starts]
        best, open_ = list(near), [(-d, s) for d, s in near]
        heapq.heapify(best)
        heapq.heapify(open_)
        while open_:
            d, n = heapq.heappop(open_)
            if len(best) >= beam and -d < best[0][0]:
                break
            new = [m for m in layer[n].tolist() if m not in seen]
            if not new:
                continue
            seen.update(new)
            for c, m in zip((self.x[new] @ q).tolist(), new, strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (c, m))
                    heapq.heappush(open_, (-c, m))
                elif c > best[0][0]:
                    heapq.heapreplace(best, (c, m))
                    heapq.heappush(open_, (-c, m))
        return sorted(best, reverse=True)

    def nearest(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        at = [self.entry]
        for level in range(len(self.layers) - 1, 0, -1):
            at = [self.search(q, at, 1, level)[0][1]]
        return self.search(q, at, beam, 0)

    def links(self, q: np.ndarray, beam: int, least: float) -> list[int] | None:
        """Nodes of at least this cosine; None if the beam holds nothing else, so that there may be more."""
        found = self.nearest(q, beam)
        return [n for c, n in found if c >= least] if len(found) < beam or found[-1][0] < least else None

    def audited_beam(self, queries: np.ndarray, least: float, ids: np.ndarray) -> tuple[int, float]:
        """The first beam, doubling from BEAM, with which audits against brute force pass, and its recall of links; 0: none.

        Links and nearest vectors are audited apart, each as a mean over queries, so that a large group counts no more than
        others.  A query whose beam is full of links is compared in blocks later, so it has all of its links.
        """
        pick = np.argsort(mix(ids.astype("u8")), kind="stable")[:AUDIT]
        exact = queries[pick] @ self.x.T
        wanted = [(p, set(np.flatnonzero(row >= least).tolist())) for p, row in zip(pick, exact, strict=True)]
        wanted = [(p, w) for p, w in wanted if w]
        near = [(p, set(np.argsort(-row, kind="stable")[:AUDIT_NEAREST].tolist())) for p, row in zip(pick[:AUDIT_PLAIN], exact, strict=False)]
        beam = BEAM
        while beam <= WIDEST:
            share = lambda w, found: 1.0 if found is None else len(w.intersection(found)) / len(w)
            linked = [share(w, self.links(queries[p], beam, least)) for p, w in wanted]
            plain = [share(w, [n for _, n in self.nearest(queries[p], beam)]) for p, w in near]
            recall = float(np.mean(linked)) if linked else 1.0
            if recall >= RECALL and (not plain or np.mean(plain) >= RECALL):
                return beam, recall
            beam *= 2
        return 0, 1.0

    def packed(self) -> tuple[bytes, bytes, int]:
        rows = [(level, n, len(m)) for level, layer in enumerate(self.layers) for n, m in layer.items()]
        flat = [m for layer in self.layers for m in layer.values()]
        return np.array(rows, dtype="i4").tobytes(), np.concatenate(flat).astype("i4").tobytes(), self.entry

    @staticmethod
    def unpacked(x: np.ndarray, rows: bytes, flat: bytes, entry: int) -> Graph:
        layers: list[dict[int, np.ndarray]] = []
        links, at = np.frombuffer(flat, dtype="i4"), 0
        for level, n, k in np.frombuffer(rows, dtype="i4").reshape(-1, 3).tolist():
            while len(layers) <= level:
                layers.append({})
            layers[level][n] = links[at : at + k]
            at += k
        return Graph(x, layers, entry)


def _confirmed(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Pairs of rows whose cosine in double precision is at least `least`."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))) >= least


class Links:
    """Counts of links of the classes of one or two shards, and as many links as their components need."""

    def __init__(self, cls: np.ndarray, copies: np.ndarray):
        self.cls, self.copies, self.degree, self.of, self.need = cls, copies, np.zeros(len(cls), dtype="i8"), np.arange(len(cls)), []

    def unite(self, i: int, others: np.ndarray) -> None:
        """A link from i to one node of each group that is not united with i yet."""
        groups, first = np.unique(self.of[others], return_index=True)
        apart = groups != self.of[i]
        if apart.any():
            self.need += [(i, int(others[k])) for k in first[apart]]
            self.of[np.isin(self.of, groups)] = self.of[i]

    def rows(self) -> pd.DataFrame:
        some = np.flatnonzero(self.degree)
        need = np.array(self.need, dtype="i8").reshape(-1, 2)
        return pd.concat([pd.DataFrame({"cls": self.cls[some], "links": self.degree[some], "to": self.cls[some]}), pd.DataFrame({"cls": self.cls[need[:, 0]], "links": 0, "to": self.cls[need[:, 1]]})])


def _linked(graph: Graph, q: np.ndarray, x: np.ndarray, ids: np.ndarray, least: float, out: Links, base: int) -> None:
    """Adds the links between rows of q (numbers from 0 in out) and those of the graph's x (numbers from base) to out.

    base is 0 if both are the same rows.  Queries whose beam is full of links, and all of a graph whose audit fails, are
    compared with x in blocks of a matrix product; of these nothing but counts and needed links is kept.
    """
    units, same = _units(q), base == 0
    beam, _ = graph.audited_beam(units, least - 1e-4, ids)
    found = [graph.links(u, beam, least - 1e-4) for u in units] if beam else [None] * len(q)
    dense = np.array([f is None for f in found])
    pairs = np.column_stack([np.repeat(np.arange(len(q)), [len(f or ()) for f in found]), np.concatenate([np.zeros(0, "i8"), *[np.array(f, dtype="i8") for f in found if f]])])
    keep = [_confirmed(q[p[:, 0]], x[p[:, 1]], least) for p in np.array_split(pairs, len(pairs) // 65536 + 1)]
    pairs = pairs[np.concatenate(keep)]
    if same:  # once for both directions, and dense rows count their own
        pairs = pairs[(pairs[:, 0] != pairs[:, 1]) & ~dense[pairs[:, 1]]]
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    np.add.at(out.degree, pairs[:, 0], out.copies[base + pairs[:, 1]])
    np.add.at(out.degree, base + pairs[:, 1], out.copies[pairs[:, 0]])
    for part in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1) if len(pairs) else ():
        out.unite(int(part[0, 0]), base + part[:, 1])
    a, b = (v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None] for v in (q, x))
    rows = np.flatnonzero(dense)
    for i in range(0, len(rows), BLOCK):
        of = rows[i : i + BLOCK]
        cosine = a[of] @ b.T
        hit = cosine >= least
        for r, c in zip(*np.nonzero(np.abs(cosine - least) < 1e-12), strict=True):
            hit[r, c] = _confirmed(q[of[r]][None], x[c][None], least)[0]
        if same:
            hit[np.arange(len(of)), of] = False
        out.degree[of] += hit @ out.copies[base : base + len(x)]
        each = hit[:, :].copy()
        if same:
            each[:, dense] = False  # they count from their own rows
        out.degree[base : base + len(x)] += out.copies[of] @ each
        for k, r in enumerate(of):
            if hit[k].any():
                out.unite(int(r), base + np.flatnonzero(hit[k]))


def _units(exact: np.ndarray) -> np.ndarray:
    return (exact / np.sqrt(np.einsum("ij,ij->i", exact, exact))[:, None]).astype("f4")


_OUT = "cls long, links long, to long"


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row: links are cosines of at least `least` under one label.

    Equal vectors of a label are one class with a number of copies.  The classes of a label (and length) are dealt by hash to
    shards of about `shard` vectors; each shard gets a graph.  Every class queries its own shard, and of two shards of a label
    the classes of one query the other's graph; shards meet by their numbers, so no label is a hot key.  A shard's beam widens
    until audits against brute force find RECALL of the links and of the nearest vectors; where the widest beam fails, and
    for a query whose beam holds links alone, blocks are compared whole.  Links are confirmed in double precision.  A task
    passes on one count for each class and as many links as components need, so a group of near copies makes rows in
    proportion to its size, and no list of its pairs exists.

    Null vectors and labels, empty and zero vectors and those with a null or non-finite component are linked with nothing.
    A null id is linked with nothing, has a null component and is kept.  Repeated rows are copies and count as links of each
    other.  The smallest id names a component, so ties do not occur.  An empty table gives no rows.  Other columns are not
    read.
    """
    with tidied() as kept:
        base, known = _known(vectors, id_col, vector_col, label_col, least, shard)
        kept += [base, known]
        known = small_side(known)
    out = base.select("vec_id", "cls").join(known, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))


def _known(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, least: float, shard: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their classes, and of classes with copies or links n_links and component_id."""
    row = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    row = row.withColumn("cls", F.when(F.coalesce(ok, F.lit(False)), F.xxhash64("label", "v")))
    base = written(row, "vectors")
    classes = base.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = written(classes.withColumn("dim", F.size("v")), "vector_classes")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "cls"), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        cls, copies = pdf["cls"].to_numpy(), pdf["copies"].to_numpy()
        exact = np.stack(pdf["v"].to_list())
        graph, out = Graph(_units(exact), ids=cls), Links(cls, copies)
        _linked(graph, exact, exact, cls, least, out, 0)
        many = int(pdf["shards"].iloc[0]) > 1
        rows, flat, entry = graph.packed() if many else (b"", b"", 0)
        blob = lambda x: x.tobytes() if many else b""
        return pd.DataFrame({
            "label": [pdf["label"].iloc[0]], "dim": [exact.shape[1]], "shard": [pdf["shard"].iloc[0]], "shards": [pdf["shards"].iloc[0]], "inner": [out.rows().to_dict("records")],
            "cls": [blob(cls)], "copies": [blob(copies)], "exact": [blob(exact)], "rows": [rows], "flat": [flat], "entry": [entry],
        })

    kind = dict(classes.dtypes)["label"]
    made = dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"label {kind}, dim int, shard int, shards int, inner array<struct<{_OUT.replace(' ', ':').replace(',:', ',')}>>, cls binary, copies binary, exact binary, rows binary, flat binary, entry int")
    graphs = written(made, "graphs")

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["asked"].to_numpy()
        q, g = pdf[~asked].iloc[0], pdf[asked].iloc[0]
        read = lambda r, c, kind: np.frombuffer(r[c], dtype=kind)
        x, y = (read(r, "exact", "f8").reshape(-1, int(r["dim"])) for r in (q, g))
        ids = read(q, "cls", "i8")
        out = Links(np.concatenate([ids, read(g, "cls", "i8")]), np.concatenate([read(q, "copies", "i8"), read(g, "copies", "i8")]))
        _linked(Graph.unpacked(_units(y), g["rows"], g["flat"], int(g["entry"])), x, y, ids, least, out, len(ids))
        return out.rows()

    found = graphs.select(F.explode("inner").alias("l")).select("l.*")
    many = graphs.where("shards > 1").drop("inner")
    if not many.isEmpty():
        # each two shards of a label once, as links have no direction: shard q asks the half of the others that follow it
        half = F.floor((F.col("shards") - 1) / 2) + F.when((F.col("shards") % 2 == 0) & (F.col("q") < F.col("shards") / 2), 1).otherwise(0)
        steps = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("shards") / 2).cast("int"))))
        asks = steps.withColumns({"q": F.col("shard"), "t": F.pmod(F.col("shard") + F.col("k"), "shards"), "asked": F.lit(False), "rows": F.lit(b""), "flat": F.lit(b"")})
        asked = steps.withColumns({"q": F.pmod(F.col("shard") - F.col("k"), "shards"), "t": F.col("shard"), "asked": F.lit(True)})
        both = asks.unionByName(asked).where(F.col("k") <= half)
        found = found.union(both.groupBy("label", "dim", "q", "t").applyInPandas(cross, _OUT))
    found = written(found, "vector_links")
    degree = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.where("cls <> to").select(F.col("cls").alias("a"), F.col("to").alias("b")))
    known = classes.select("cls", "rep", "copies").join(degree, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    known = written(known, "vector_roots")
    least_id = known.where("root is not null").groupBy("root").agg(F.min("rep").alias("component_id"))
    known = known.join(least_id, "root", "left").select("cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    return base, written(known.where("n_links > 0"), "vectors_known")
