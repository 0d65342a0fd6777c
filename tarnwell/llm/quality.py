"""Quality classifier: co-training of a text-content and a page-metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import dropped, small_side, written

#: The bounded training sample of labelled documents; unlabelled ones all take part.
LABELLED = 3000
#: Passes over the taught documents in a refit, and the bins of margin in which all unlabelled documents are counted.
PASSES, BIN, FAR = 20, 1 / 256, 60.0
#: Hashed byte trigrams of the content view; buckets of language and source of the metadata view.
TRIGRAMS, BUCKETS = 1024, 16
ROUNDS, SHARE = 4, 0.05
#: Rows of features that a task holds as a matrix.
ROWS = 512
#: Vectors of sums that the driver adds up at most; those of more tasks are added up in tasks first.
FAN = 128
#: Documents with a smaller probability of good quality are rejected.
ACCEPT = 0.5
_N_META = 2 * BUCKETS + 9


def content_view(data: np.ndarray) -> np.ndarray:
    """Hashed trigrams of the whole text's bytes (log counts of unit length) and how much its words repeat."""
    counts = np.zeros(TRIGRAMS)
    for i in range(0, max(0, len(data) - 2), 1 << 20):
        x = data[i : i + (1 << 20) + 2].astype("u4")
        mixed = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
        counts += np.bincount(mixed >> np.uint32(22), minlength=TRIGRAMS)
    v = np.log1p(counts)
    v /= np.sqrt(v @ v) or 1.0
    words = data.tobytes().split()
    n = len(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0
    return np.concatenate([v, [3 * again, 1 - len(set(words)) / n if n else 0.0]])


_KINDS = np.zeros(256, dtype="i8")
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 2
_KINDS[[9, 10, 13, 32]] = 4
_KINDS[[33, 44, 46, 58, 59, 63, 39, 34, 45, 40, 41]] = 5


def metadata_view(data: np.ndarray, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language, source, length and layout of the page: shares of kinds of characters, lines and their lengths.

    Layout is read off the text, but no letters or words are: which bytes stand where is left to the other view.
    """
    out = np.zeros(_N_META)
    out[zlib.crc32((lang or "").encode()) % BUCKETS] = 1
    out[BUCKETS + zlib.crc32((source or "").encode()) % BUCKETS] = 1
    kinds = np.bincount(_KINDS[data], minlength=6) / max(1, len(data))
    lines = int(np.count_nonzero(data == 10)) + 1
    out[2 * BUCKETS :] = [np.log1p(len(data) if n_chars is None else abs(n_chars)) / 10, *(4 * kinds), np.log1p(lines) / 5, np.log1p(len(data) / lines) / 10]
    return out


class Logistic:
    """L2-regularized logistic regression, by accelerated gradient steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]).astype("f4")
        w = prior = np.zeros(z.shape[1], dtype="f4")
        weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())).astype("f4")
        rate = 4.0 / float(np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 + l2)
        for k in range(steps):
            ahead = w + (k / (k + 3)) * (w - prior)
            p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
            prior, w = w, ahead - rate * (z.T @ (weight * (p - y)) + l2 * ahead)
        self.w, self.slope, self.shift = w.astype("f8"), 1.0, 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on documents that were not trained on, by Newton steps with a weak prior."""
        m, a, b = np.clip(self.margin(x), -30, 30), 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            g, h = np.array([((p - y) * m).sum() + (a - 1), (p - y).sum() + 0.1 * b]), p * (1 - p)
            hess = np.array([[(h * m * m).sum() + 1, (h * m).sum()], [(h * m).sum(), h.sum() + 0.1]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, g)
        self.slope, self.shift = max(float(a), 0.05), float(b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.margin(x) + self.shift, -12, 12)


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :-_N_META], x[:, -_N_META:]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="f2").reshape(len(column), -1).astype("f4")


#: The models of a round and, of each, the bins up to and from which documents are confident, with the shares taken of these two bins.
Round = tuple[list[Logistic], list[tuple[int, float, int, float]]]


def _taught(x: np.ndarray, u: np.ndarray, rounds: list[Round]) -> list[np.ndarray]:
    """Labels that each view was taught by the other one in these rounds; -1 for none.  u: a fraction by the hash of the id."""
    out = [np.full(len(x), -1.0) for _ in range(2)]
    for models, cuts in rounds:
        for k, v in enumerate(_split(x)):
            m = models[k].margin(v)
            b, (low, some_low, high, some_high), free = np.floor(np.clip(m, -FAR, FAR) / BIN), cuts[k], out[1 - k] < 0
            out[1 - k][free & (m < 0) & ((b < low) | ((b == low) & (u < some_low)))] = 0
            out[1 - k][free & (m > 0) & ((b > high) | ((b == high) & (u < some_high)))] = 1
    return out


def _cuts(counts: dict[int, int], n_low: int, n_high: int) -> tuple[int, float, int, float]:
    """Bins at which the n_low smallest negative and the n_high largest positive margins end, with the shares of these bins."""

    def cut(bins: list[int], n: int, end: int) -> tuple[int, float]:
        for b in bins:
            if counts[b] > n:
                return b, n / counts[b]
            n -= counts[b]
        return end, 0.0

    return *cut(sorted(b for b in counts if b < 0), n_low, 0), *cut(sorted((b for b in counts if b >= 0), reverse=True), n_high, -1)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a bounded number of rows, so that matrices of features stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _summed(table: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(labels, features) over a table of taught documents; each task passes on one vector.

    The vectors of more than FAN tasks are added up in FAN tasks first, so at most FAN of them come to the driver.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _blocks(batches):
            found = part(np.column_stack([batch.column(k).to_numpy() for k in (0, 1)]), _matrix(batch.column(2)))
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for t in batch.column(0):
                v = np.frombuffer(t.as_buffer(), dtype="f8")
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    sums = table.mapInArrow(rows, "total binary")
    if table.rdd.getNumPartitions() > FAN:
        sums = sums.repartition(FAN).mapInArrow(added, "total binary")
    return np.sum([np.frombuffer(r["total"], dtype="f8") for r in sums.collect()], axis=0)  # FAN vectors at most


def _moments(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = []
    for k, v in enumerate(_split(x)):
        own, y = v[t[:, k] >= 0].astype("f8"), t[t[:, k] >= 0, k]
        out += [[(y == 0).sum(), (y == 1).sum()], own.sum(0), (own * own).sum(0)]
    return np.concatenate(out)


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss and gradient of the standardized rows x under weights of the two classes."""
    raw = w[:-1] / scale
    m = x.astype("f8") @ raw + (w[-1] - mean @ raw)
    weight = np.where(y > 0.5, weights[1], weights[0])
    r = weight * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y)
    return np.concatenate([[weight @ (np.logaddexp(0, m) - y * m)], (r @ x - mean * r.sum()) / scale, [r.sum()]])


def _lbfgs(w: np.ndarray, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], None]:
    """Points at which to evaluate; sent loss and gradient of each."""
    f, g = yield w
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        d, back = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            back.append(a)
            d = d - a * y
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(back), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0 if pairs else min(1.0, 1 / (float(np.linalg.norm(g)) or 1.0))
        while True:
            ahead = w + step * d
            f_ahead, g_ahead = yield ahead
            if f_ahead <= f + 1e-4 * step * (g @ d) or step < 1e-4:
                break
            step /= 2
        if (ahead - w) @ (g_ahead - g) > 1e-12:
            pairs = [*pairs, (ahead - w, g_ahead - g)][-memory:]
        w, f, g = ahead, f_ahead, g_ahead


def _refit(models: list[Logistic], x: np.ndarray, y: np.ndarray, taught: DataFrame, l2: float = 1e-4) -> list[Logistic]:
    """Both models fitted to the labelled rows x, y and to all taught documents, by L-BFGS on gradients summed in Spark."""
    views = _split(x)
    own = np.column_stack([y, y]).astype("f8")
    sums = _summed(taught, _moments) + _moments(own, x)
    new, weights, at = [], [], 0
    for k, v in enumerate(views):
        d, model, old = v.shape[1], Logistic.__new__(Logistic), models[k]
        n, total, squares = sums[at : at + 2], sums[at + 2 : at + 2 + d], sums[at + 2 + d : at + 2 + 2 * d]
        at += 2 + 2 * d
        model.mean = total / n.sum()
        model.scale = np.sqrt(np.maximum(squares / n.sum() - model.mean**2, 0)) + 1e-3
        raw = old.w[:-1] / old.scale
        model.w = np.append(raw * model.scale, old.w[-1] + (model.mean - old.mean) @ raw)
        model.slope, model.shift = 1.0, 0.0
        new.append(model)
        weights.append(0.5 / np.maximum(1, n))
    given = [(m.mean, m.scale, c) for m, c in zip(new, weights, strict=True)]
    steps = [_lbfgs(m.w) for m in new]
    points = [next(s) for s in steps]
    best = [np.inf, np.inf]
    for _ in range(PASSES):

        def part(t: np.ndarray, z: np.ndarray, points: list[np.ndarray] = points) -> np.ndarray:
            return np.concatenate([_loss(v[t[:, k] >= 0], t[t[:, k] >= 0, k], points[k], *given[k]) for k, v in enumerate(_split(z))])

        both = _summed(taught, part) + part(own, x)
        cut = len(points[0]) + 1
        after = []
        for k, found in enumerate((both[:cut], both[cut:])):
            loss = float(found[0] + l2 / 2 * points[k] @ points[k])
            if loss < best[k]:
                best[k], new[k].w = loss, points[k]
            after.append(steps[k].send((loss, found[1:] + l2 * points[k])))
        points = after
    return new


def co_train(x: np.ndarray, y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> tuple[Logistic, Logistic]:
    """x, y: the labelled documents; pool: u and v of all unlabelled ones, a written table.

    In each round each view's most confident documents of the whole pool teach the other view.  A quarter of the labelled
    documents is kept for calibration.  `share` of the pool is passed on in a round, with the two classes in the proportion
    that the labels have.
    """
    held = np.arange(len(y)) % 4 == 3
    base, known = x[~held], y[~held].astype("f8")
    models = [Logistic(v, known) for v in _split(base)]
    good, size = float(known.mean()) if len(known) else 0.5, pool.count()
    n = max(1, int(share * size))
    history: list[Round] = []
    for _ in range(rounds if size else 0):

        def margins(batches: Iterator[pa.RecordBatch], models: list[Logistic] = models, before: list[Round] = tuple(history)) -> Iterator[pa.RecordBatch]:
            for batch in _blocks(batches):
                z = _matrix(batch.column(1))
                taught = _taught(z, batch.column(0).to_numpy(), before)
                for k, v in enumerate(_split(z)):
                    b, c = np.unique(np.floor(np.clip(models[k].margin(v[taught[1 - k] < 0]), -FAR, FAR) / BIN).astype("i4"), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), k, dtype="i4")), pa.array(b), pa.array(c.astype("i8"))], ["k", "b", "c"])

        counted = pool.mapInArrow(margins, "k int, b int, c long").groupBy("k", "b").agg(F.sum("c").alias("c")).collect()  # the bins of two views
        history.append((models, [_cuts({r["b"]: r["c"] for r in counted if r["k"] == k}, int(n * (1 - good)), int(n * good)) for k in (0, 1)]))

        def rows(batches: Iterator[pa.RecordBatch], before: list[Round] = tuple(history)) -> Iterator[pa.RecordBatch]:
            for batch in _blocks(batches):
                t = _taught(_matrix(batch.column(1)), batch.column(0).to_numpy(), before)
                some = pa.array((t[0] >= 0) | (t[1] >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(t[1]), batch.column(1)], ["t0", "t1", "v"]).filter(some)

        taught = written(pool.mapInArrow(rows, "t0 double, t1 double, v binary"), "taught")
        if not taught.isEmpty():
            models = _refit(models, base, known, taught)
        dropped(taught)
    for model, v in zip(models, _split(x[held]), strict=True):
        model.calibrate(v, y[held])
    return models[0], models[1]


def _odds(models: tuple[Logistic, Logistic], batch: pa.RecordBatch) -> np.ndarray:
    """The calibrated log-odds of both views for each row."""
    views = [np.stack(v).astype("f4") for v in zip(*_views(batch), strict=True)]
    return np.column_stack([m.logit(v) for m, v in zip(models, views, strict=True)])


def _views(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    langs, sources, sizes = (batch.column(k).to_pylist() for k in (2, 3, 4))
    for text, lang, source, size in zip(batch.column(1), langs, sources, sizes, strict=True):
        data = np.frombuffer(text.as_buffer(), dtype="u1")
        yield content_view(data), metadata_view(data, lang, source, size)


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    col = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), col("lang", "string"), col("source", "string"), col("n_chars", "long"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> tuple[Logistic, Logistic] | None:
    """The two calibrated models, or None if the labels of these documents have fewer than two classes of four each.

    The labelled sample is the documents whose id has the smallest hash, chosen from ids alone; all documents with an id
    and no label are the pool.  Rows of labels with a null id or label teach nothing; an id with several labels counts as
    the lowest.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = written(labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("y")).where("doc_id is not null"), "labels")
    sample = ids.join(small_side(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select("doc_id", "y")
    sample = sample.sparkSession.createDataFrame(sample.collect(), "doc_id long, y int")  # `labelled` rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            both = [np.concatenate(v).astype("f4").tobytes() for v in _views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(both, pa.binary())], ["doc_id", "y", "v"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            both = [np.concatenate(v).astype("f2").tobytes() for v in _views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(5), pa.array(both, pa.binary())], ["u", "v"])

    texts = _given(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    found = sorted({r["doc_id"]: (r["y"], r["v"]) for r in texts.mapInArrow(rows, "doc_id long, y int, v binary").collect()}.items())
    y = np.array([f[1][0] for f in found])
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return None
    x = np.stack([np.frombuffer(f[1][1], dtype="f4") for f in found])
    free = _given(docs, id_col, text_col).where("doc_id is not null").join(small_side(known), "doc_id", "left_anti")
    pool = written(free.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)).mapInArrow(features, "u double, v binary"), "pool")
    models = co_train(x, y, pool)
    dropped(pool, known)
    return models


def score_quality(docs: DataFrame, models: tuple[Logistic, Logistic] | None, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """doc_id, p_content, p_metadata, score and accepted for every row of docs, one row for each.

    p_content and p_metadata are the calibrated probabilities of good quality of the two views, score the probability by the
    mean of their log-odds.  Null and empty texts are scored as empty texts.  Without models every document has 0.5 and is
    accepted.  Null ids and repeated rows are rows as any other; lang, source and n_chars may be null or missing; other
    columns are not read; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            odds = _odds(models, batch) if models else np.zeros((batch.num_rows, 2))
            p = 1 / (1 + np.exp(-np.column_stack([odds, odds.mean(1)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= accept)], ["doc_id", "p_content", "p_metadata", "score", "accepted"])

    return _given(docs, id_col, text_col).mapInArrow(rows, "doc_id long, p_content double, p_metadata double, score double, accepted boolean")


def keep_good(docs: DataFrame, models: tuple[Logistic, Logistic] | None, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that score_quality accepts, with all their columns."""
    if not models:
        return docs

    @F.arrow_udf("boolean")
    def good(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            batch = pa.RecordBatch.from_arrays([columns[1], *columns], ["id", "text", "lang", "source", "n_chars"])
            found = [1 / (1 + np.exp(-_odds(models, b).mean(1))) >= accept for b in _blocks([batch])]
            yield pa.array(np.concatenate([np.zeros(0, bool), *found]), pa.bool_())

    col = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind)
    return docs.where(good(F.coalesce(F.col(text_col).cast("string"), F.lit("")), col("lang", "string"), col("source", "string"), col("n_chars", "long")))
