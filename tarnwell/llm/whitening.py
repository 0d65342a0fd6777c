"""Whitening of embeddings: exact sums and a centred covariance summed in Spark, eigenvectors by tridiagonalisation, a broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import dropped, written

#: An entry c counts as the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of this magnitude have no exact whole number of 64 bits; they count as non-finite.
LARGEST = float(1 << 52)
#: Whole numbers are summed as multiples of 2**31 and the rest, so that sums of 2**31 rows stay exact.
_LIMB = 31
#: Tasks that add up the parts of a covariance.
ADDERS = 16
#: Eigenvalues nearer than this share of the largest are a cluster, in which vectors are orthogonalised again.
CLUSTER = 1e-3


@dataclass
class Whitening:
    """What the fit list gives: its number of rows, exact sums, and the leading components (columns) with their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the rows whose vector is not null or empty and has neither null nor non-finite entries."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row numbers and the whole numbers of the vectors of each size."""
    sizes, values = np.asarray(column.value_lengths()), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        at = starts[rows][:, None] + np.arange(d)
        yield rows, np.floor(SCALE * values[at]).astype("i8") + SHIFT


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """The most frequent size of a vector (of equally frequent ones the largest), its number of rows and their exact sums."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                n, d = x.shape
                high = x >> _LIMB
                cols = [np.full(d, d), np.arange(d), np.full(d, n), high.sum(0), (x - (high << _LIMB)).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["d", "j", "n", "high", "low"])

    found = vectors.select("v").mapInArrow(rows, "d long, j long, n long, high long, low long")
    table = written(found.groupBy("d", "j").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))), "sums")
    top = table.where("j = 0").orderBy(F.desc("n"), F.desc("d")).first()
    of_top = table.where(F.col("d") == top["d"]).orderBy("j").collect() if top else []  # a row for each dimension
    dropped(table)
    return (top["d"], top["n"], [(r["high"] << _LIMB) + r["low"] for r in of_top]) if top else (0, 0, [])


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of matrices whose rows (i, row) come from many tasks, each row of the sum added up in one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(row.as_buffer(), dtype="f8")
                total[i] = total[i] + found if i in total else found
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["i", "row"])

    found = sorted((r["i"], r["row"]) for r in parts.repartition(ADDERS, "i").mapInArrow(rows, "i long, row binary").collect())  # a row for each dimension
    return np.stack([np.frombuffer(r, dtype="f8") for _, r in found])


def _products(blocks: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of the sum of y.T @ y over a task's centred blocks y."""
    total = None
    for y in blocks:
        total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])


def _covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the vectors' whole numbers, divisor n.

    Vectors are centred on their mean, rounded to whole numbers, before they are multiplied; what the rounding left (at most
    a half in each dimension) is taken out at the end.  Products and their sums are thus whole numbers, which stay exact up
    to 2**53, so that neither the order of tasks nor a repeated task changes a bit.
    """
    d, centre = len(sums), np.array([_rounded(s, n) for s in sums], dtype="i8")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _products((x - centre).astype("f8") for batch in batches for _, x in _matrices(batch.column(0)) if x.shape[1] == d)

    left = _left(n, sums, centre)
    return _added(vectors.select("v").mapInArrow(rows, "i long, row binary")) / n - np.outer(left, left)


def _rounded(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def _left(n: int, sums: list[int], centre: np.ndarray) -> np.ndarray:
    return np.array([(s - n * int(m)) / n for s, m in zip(sums, centre, strict=True)])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reflections that make the symmetric a tridiagonal: its diagonal, the entries beside it, and the reflections' vectors."""
    a, turns = np.array(a, dtype="f8"), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= length
        size = np.linalg.norm(v)
        v = v / size if size else v
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = length if size else 0.0
        turns.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), turns


def sturm_count(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each value, by the signs of its Sturm sequence."""
    tiny = np.finfo("f8").tiny * max(1.0, float((beside**2).max(initial=0)))
    q = diagonal[0] - at
    count = (q < 0).astype("i8")
    for d, e in zip(diagonal[1:], beside, strict=True):
        q = d - at - e * e / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, each by bisection until no double lies between its bounds."""
    reach = np.append(np.abs(beside), 0) + np.append(0, np.abs(beside))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, np.nextafter((diagonal + reach).max(), np.inf))
    place = len(diagonal) - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        moved = (middle > low) & (middle < high)
        if not moved.any():
            return middle
        over = sturm_count(diagonal, beside, middle) >= place
        high, low = np.where(moved & over, middle, high), np.where(moved & ~over, middle, low)


def _solved(diagonal: np.ndarray, beside: np.ndarray, value: float, b: np.ndarray) -> np.ndarray:
    """x of (T - value) x = b for a tridiagonal T, by elimination with row exchanges; a zero pivot counts as a tiny one."""
    n = len(b)
    tiny = np.finfo("f8").eps * max(float(np.abs(diagonal).max()), float(np.abs(beside).max(initial=0)), np.finfo("f8").tiny)
    rows = [[d - value, e, 0.0] for d, e in zip(diagonal, np.append(beside, 0.0), strict=True)]
    x = b.tolist()
    for i in range(n - 1):
        under = [beside[i], *rows[i + 1][:2]]
        if abs(under[0]) > abs(rows[i][0]):
            rows[i], under, x[i], x[i + 1] = under, rows[i], x[i + 1], x[i]
        if abs(rows[i][0]) < tiny:
            rows[i][0] = tiny
        f = under[0] / rows[i][0]
        rows[i + 1] = [under[1] - f * rows[i][1], under[2] - f * rows[i][2], 0.0]
        x[i + 1] -= f * x[i]
    for i in range(n - 1, -1, -1):
        pivot = rows[i][0] if abs(rows[i][0]) >= tiny else tiny
        x[i] = (x[i] - (rows[i][1] * x[i + 1] if i + 1 < n else 0) - (rows[i][2] * x[i + 2] if i + 2 < n else 0)) / pivot
    out = np.array(x)
    return out / np.abs(out).max()


def leading_vectors(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray, steps: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) for falling eigenvalues, by inverse iteration; those of a cluster are made orthogonal in each step."""
    n, near = len(diagonal), CLUSTER * float(np.abs(values).max(initial=0))
    chance, out = np.random.default_rng(7), []
    for k, value in enumerate(values):
        cluster = [out[j] for j in range(k) if values[j] - value <= near]
        x = chance.standard_normal(n)
        for _ in range(steps):
            x = _solved(diagonal, beside, value, x)
            for _ in range(2):
                for v in cluster:
                    x = x - (v @ x) * v
            x = x / np.linalg.norm(x)
        out.append(x)
    return np.stack(out, axis=1)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the symmetric a, falling, and their unit eigenvectors as columns; each one's largest entry is positive."""
    top = float(np.abs(a).max(initial=0))
    if not top:
        return np.zeros(min(k, len(a))), np.eye(len(a))[:, :k]
    unit = 2.0 ** np.ceil(np.log2(top))
    diagonal, beside, turns = tridiagonal(a / unit)
    values = leading_values(diagonal, beside, min(k, len(a)))
    vectors = leading_vectors(diagonal, beside, values)
    for i in range(len(turns) - 1, -1, -1):
        vectors[i + 1 :] -= 2 * np.outer(turns[i], turns[i] @ vectors[i + 1 :])
    largest = np.abs(vectors).argmax(0)
    return values * unit, vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """The components of all usable rows of the most frequent size (`usable`); None without any.

    Only sums leave the tasks: a row for each dimension, and a matrix of dimensions by dimensions, added up in Spark and
    small on the driver.  Null and repeated ids are rows like others.
    """
    given = usable(vectors, id_col, vector_col)
    d, n, sums = _sums(given)
    if not n:
        return None
    v = _covariance(given, n, sums)
    values, parts = leading(v, components)
    return Whitening(n, sums, parts, values, float(np.trace(v)))


def _squares(y: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row of whole numbers, as decimal(38,0); null beyond 38 digits."""
    kind, top = pa.decimal128(38, 0), int(np.abs(y).max(initial=0))
    if top * top * y.shape[1] < 1 << 62:
        return pa.array((y * y).sum(1)).cast(kind)
    low, middle, high = y & 0xFFFFF, (y >> 20) & 0xFFFFF, y >> 40
    part = {(i, j): (a * b).sum(1).tolist() for i, a in enumerate((low, middle, high)) for j, b in enumerate((low, middle, high)) if i <= j}
    totals = [sum(p << (20 * (i + j) + (i != j)) for (i, j), p in zip(part, row, strict=True)) for row in zip(*part.values(), strict=True)]
    return pa.array([t if t < 10**38 else None for t in totals], kind)


def transform(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation decimal(38,0) and whitened array<double> of every usable row of the model's size.

    x are a vector's whole numbers, S the sums of the fit list's, n its rows.  deviation is the exact sum over dimensions of
    (n * x - S)**2 (null beyond 38 digits), whitened are the projections of x - S / n on the components, over the square
    roots of their variances; a component without variance gives null.  The model is broadcast: it grows with the square of
    the dimensions, not with rows.  Without a model there are no rows.
    """
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        d, n = len(m.sums), m.n
        centre = np.array([_rounded(s, n) for s in m.sums], dtype="i8")
        rest, left = np.array([s - n * int(c) for s, c in zip(m.sums, centre, strict=True)], dtype="i8"), _left(n, m.sums, centre)
        some = m.variances > np.finfo("f8").eps * d * max(m.trace, 0.0)
        scale = np.sqrt(np.where(some, m.variances, 1.0))
        for batch in batches:
            for at, x in _matrices(batch.column(1)):
                if x.shape[1] != d:
                    continue
                y = x - centre
                if int(np.abs(y).max(initial=0)) * n + n < 1 << 61:
                    squares = _squares(n * y - rest)
                else:
                    whole = [sum((n * a - b) ** 2 for a, b in zip(r, rest.tolist(), strict=True)) for r in y.tolist()]
                    squares = pa.array([t if t < 10**38 else None for t in whole], pa.decimal128(38, 0))
                white = (y - left) @ m.components / scale
                values = pa.array(white.ravel(), mask=np.tile(~some, len(y)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(scale), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), squares, lists], ["vec_id", "deviation", "whitened"])

    return usable(vectors, id_col, vector_col).mapInArrow(rows, schema)


def identity_error(whitened: DataFrame, model: Whitening | None) -> float:
    """How far the covariance of the table of whitened rows (divisor n, centred) is from the identity, at most; components without variance are left out."""
    if model is None:
        return 0.0
    means = whitened.agg(*(F.avg(F.element_at("whitened", k + 1)).alias(f"m{k}") for k in range(len(model.variances)))).first()
    some = np.array([k for k in range(len(model.variances)) if means[k] is not None], dtype="i8")
    if not len(some):
        return 0.0
    centre, k = np.array([means[int(i)] for i in some]), len(model.variances)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _products(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)[:, some] - centre for batch in batches)

    found = _added(whitened.select("whitened").mapInArrow(rows, "i long, row binary")) / model.n
    return float(np.abs(found - np.eye(len(some))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Components are numbered from 1 by falling variance; explained is a component's share of the total variance (0 where there
    is none), identity_error one value for all rows.  There are as many components as dimensions at most.  Vectors that are
    null or empty, hold null or non-finite entries, or have another size than most are dropped; null ids and repeated rows
    are rows like others; equal vectors give equal values.  Other columns are not read; an empty table gives no rows.
    """
    model = fit(vectors, components, id_col, vector_col)
    table = written(transform(vectors, model, id_col, vector_col), "whitened")
    error = identity_error(table, model)
    shares = [float(e) / model.trace if model.trace > 0 else 0.0 for e in model.variances] if model else []
    each = table.select("*", F.posexplode("whitened").alias("k", "w"))
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("k") + 1) if shares else F.lit(0.0)
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"))
