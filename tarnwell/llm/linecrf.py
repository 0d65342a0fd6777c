"""Quality rules: counts of a text, and a linear-chain conditional random field that marks its lines as content or boilerplate."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import dropped, small_side, written
from tarnwell.llm.quality import _lbfgs

#: The bounded training sample of labelled documents, taken whole, and the tasks that hold it.
LABELLED, TASKS = 2000, 6
#: Times that lines of bad documents are labelled anew, and passes over the sample in each fit.
ROUNDS, PASSES = 3, 15
L2 = 1e-2
#: Base rules: fewest words, and the largest share in percent of words in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Documents with a smaller share of words on content lines are rejected.
CONTENT = 0.5
CONTENT_LINE, BOILERPLATE = 0, 1
#: Bytes that are measured together.
BLOCK = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")

#: Kinds of bytes: other, white space, capital, small letter (or of a letter beyond ASCII), digit, symbol, exclamation.
_KINDS = np.zeros(256, dtype="i8")
_KINDS[[9, 10, 11, 12, 13, 32]] = 1
_KINDS[65:91], _KINDS[97:123], _KINDS[128:], _KINDS[48:58] = 2, 3, 3, 4
_KINDS[list(b"#*$%&|<>")], _KINDS[list(b"!?")] = 5, 6
_N_KINDS = 7
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?:;\"')")] = True
N_FEATURES = 12


@dataclass
class Measured:
    """Counts of a text, and for each line with a word its number, its words and its features."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    lines: np.ndarray
    words: np.ndarray
    features: np.ndarray


def _word_ids(data: bytes) -> np.ndarray:
    """A number for each word in order, equal for equal words."""
    known: dict[bytes, int] = {}
    parts, at = [np.zeros(0, "i8")], 0
    while at < len(data):
        gap = _WHITE.search(data, at + BLOCK)
        to = gap.end() if gap else len(data)
        words = data[at:to].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype="i8", count=len(words)))
        at = to
    return np.concatenate(parts)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of `window` words (a power of two) that is found twice or more; windows are compared exactly, by ranks of pairs."""
    n = len(ids) - window + 1
    if n < 2:
        return np.zeros(len(ids), dtype=bool)
    rank, width = ids, 1
    while width < window:
        rank = np.unique(rank[:-width] * (int(rank.max()) + 1) + rank[width:], return_inverse=True)[1]
        width *= 2
    twice = (np.bincount(rank) > 1)[rank]
    edges = np.zeros(len(ids) + 1, dtype="i8")
    edges[:n] += twice
    edges[window:] -= twice
    return np.cumsum(edges)[:-1] > 0


def measured(data: bytes) -> Measured:
    """The counts and line features of a text's bytes."""
    flat = np.frombuffer(data, dtype="u1")
    n_lines, line, white, chars = data.count(b"\n") + 1, 0, True, 0
    kinds, starts, ends = np.zeros((n_lines, _N_KINDS), dtype="i8"), [], []
    for at in range(0, len(flat), BLOCK):
        block = flat[at : at + BLOCK]
        kind = _KINDS[block]
        of_line = np.cumsum(block == 10)
        found = np.bincount((of_line - (block == 10)) * _N_KINDS + kind, minlength=(int(of_line[-1]) + 1) * _N_KINDS).reshape(-1, _N_KINDS)
        kinds[line : line + len(found)] += found
        line += int(of_line[-1])
        blank = np.append(white, kind == 1)
        starts.append(at + np.flatnonzero(blank[:-1] & ~blank[1:]))
        ends.append(at + np.flatnonzero(~blank[:-1] & blank[1:]) - 1)
        white = bool(blank[-1])
        chars += int(np.count_nonzero((kind != 1) & ((block & 0xC0) != 0x80)))
    if not white:
        ends.append([len(flat) - 1])
    first, last = (np.concatenate([np.zeros(0, "i8"), *x]).astype("i8") for x in (starts, ends))
    ids = _word_ids(data)
    again = repeated_words(ids)
    fresh = np.zeros(len(ids), dtype=bool)
    fresh[np.unique(ids, return_index=True)[1]] = True
    of_word = np.searchsorted(np.flatnonzero(flat == 10), first)
    lines, words = np.unique(of_word, return_counts=True)
    here = np.searchsorted(lines, of_word)
    seen: set[bytes] = set()
    double = np.zeros(len(lines), dtype=bool)
    with_words = set(lines.tolist())
    k = 0
    for i, x in enumerate(data.split(b"\n")):
        if i in with_words:
            double[k] = x in seen
            seen.add(x)
            k += 1
    of = kinds[lines].astype("f8")
    size = np.maximum(of.sum(1) - of[:, 1], 1)
    mean = lambda flags: np.bincount(here, weights=flags, minlength=len(lines)) / np.maximum(words, 1)
    columns = [
        np.ones(len(lines)), np.log1p(words) / 6, of[:, 2] / np.maximum(of[:, 2] + of[:, 3], 1), of[:, 4] / size, np.minimum(1, 4 * of[:, 5] / size), np.minimum(1, 8 * of[:, 6] / size),
        _ENDS[flat[last[np.cumsum(words) - 1]]] if len(lines) else np.zeros(0), np.minimum(1, size / np.maximum(words, 1) / 12), words <= 3, mean(~fresh), double, mean(again),
    ]
    features = np.column_stack([np.asarray(c, dtype="f8") for c in columns]).reshape(-1, N_FEATURES)
    return Measured(len(ids), chars, int(kinds[:, 5].sum()), int(double.sum()), int(again.sum()), lines, words, features)


class Chain:
    """A linear-chain field of two states.  A line's features weigh for boilerplate; transitions and the first state have weights too."""

    def __init__(self, w: np.ndarray | None = None):
        self.w = np.zeros(N_FEATURES + 5) if w is None else w

    def scores(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return features @ self.w[:N_FEATURES], self.w[N_FEATURES : N_FEATURES + 4].reshape(2, 2), float(self.w[-1])

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most probable labels; of equally probable ones content."""
        if not len(features):
            return np.zeros(0, dtype="i8")
        emitted, move, start = self.scores(features)
        (cc, cb), (bc, bb) = move.tolist()
        content, boiler, back = 0.0, float(emitted[0]) + start, []
        for e in emitted[1:].tolist():
            from_c, from_b = boiler + bc > content + cc, boiler + bb > content + cb
            back.append((from_c, from_b))
            content, boiler = max(content + cc, boiler + bc), max(content + cb, boiler + bb) + e
        state = int(boiler > content)
        out = [state]
        for choice in reversed(back):
            state = int(choice[state])
            out.append(state)
        return np.array(out[::-1])

    def loss(self, features: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Minus the log-likelihood of the labels and its gradient, by the forward and backward sums."""
        emitted, move, start = self.scores(features)
        n = len(emitted)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        (cc, cb), (bc, bb) = move.tolist()
        e = emitted.tolist()
        a, b = 0.0, e[0] + start
        forward[0] = a, b
        for i in range(1, n):
            a, b = _both(a + cc, b + bc), _both(a + cb, b + bb) + e[i]
            forward[i] = a, b
        total = _both(a, b)
        a = b = 0.0
        for i in range(n - 2, -1, -1):
            a, b = _both(cc + a, cb + e[i + 1] + b), _both(bc + a, bb + e[i + 1] + b)
            backward[i] = a, b
        p = np.exp(forward[:, 1] + backward[:, 1] - total)
        onto = np.column_stack([np.zeros(n - 1), emitted[1:]]) + backward[1:]
        pairs = np.exp(forward[:-1, :, None] + move + onto[:, None, :] - total).sum(0)
        counted = np.zeros((2, 2))
        np.add.at(counted, (labels[:-1], labels[1:]), 1)
        own = emitted @ labels + (counted * move).sum() + start * labels[0]
        return np.concatenate([[total - own], (p - labels) @ features, (pairs - counted).ravel(), [p[0] - labels[0]]])


def _both(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log1p(math.exp(-abs(a - b)))


def _labels(chain: Chain | None, features: np.ndarray, good: bool) -> np.ndarray:
    """Labels that teach: lines of good documents are content; those of bad ones boilerplate where the chain says so, at least the likeliest one."""
    if good:
        return np.zeros(len(features), dtype="i8")
    if chain is None:
        return np.ones(len(features), dtype="i8")
    out = chain.viterbi(features)
    if not out.any():
        out[int((features @ chain.w[:N_FEATURES]).argmax())] = 1
    return out


def _total(sample: DataFrame, part: Callable[[np.ndarray, bool], np.ndarray]) -> np.ndarray:
    """The sum of part(features, good) over the sampled documents; each of the TASKS tasks passes on one vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for y, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = part(np.frombuffer(raw.as_buffer(), dtype="f4").reshape(-1, N_FEATURES).astype("f8"), bool(y))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return np.sum([np.frombuffer(r["total"], dtype="f8") for r in sample.mapInArrow(rows, "total binary").collect()], axis=0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS) -> Chain | None:
    """A field learned from documents labelled good (1) or bad (0); None if either kind is missing among those with words.

    All lines of good documents are content.  Lines of bad documents are boilerplate in the first round and afterwards what
    the field of the round before says of them, at least one of each document, so that clean lines of bad documents do not
    teach.  The sample is the labelled ids with the smallest hashes; of several labels of an id the lowest counts, and all
    texts of a repeated id up to `labelled` rows take part.  Null ids, ids without a label and texts without words teach nothing.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("y")).where("doc_id is not null")
    known = written(known, "labels")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = written(given.where("text is not null").select("doc_id").join(small_side(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "ids")
    ones = F.broadcast(ids.distinct())  # `labelled` rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                f = measured(text.as_buffer().to_pybytes()).features
                if len(f):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([y], pa.int32()), pa.array([f.astype("f4").tobytes()], pa.binary())], ["doc_id", "y", "f"])

    found = given.where("text is not null").join(ones, "doc_id").mapInArrow(rows, "doc_id long, y int, f binary")
    sample = written(found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("f")).limit(labelled).repartition(TASKS).select("y", "f"), "lines")
    kinds = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chain = None
    for _ in range(rounds if len(kinds) == 2 else 0):
        steps = _lbfgs(np.zeros(N_FEATURES + 5) if chain is None else chain.w)
        point, best, taught = next(steps), (math.inf, None), chain
        for _ in range(PASSES):

            def part(f: np.ndarray, good: bool, at: np.ndarray = point, before: Chain | None = taught) -> np.ndarray:
                return Chain(at).loss(f, _labels(before, f, good))

            total = _total(sample, part)
            loss = float(total[0] + L2 / 2 * point @ point)
            if loss < best[0]:
                best = loss, point
            point = steps.send((loss, total[1:] + L2 * point))
        chain = Chain(best[1])
    dropped(known, ids, sample)
    return chain


RULED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_boilerplate long, content_share double, kept boolean, boilerplate array<int>"


def rule_lines(docs: DataFrame, chain: Chain | None, content: float = CONTENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rules and the field's verdict for every row of docs.

    Words are runs without ASCII white space; lines are cut at line feeds.  base_failed: fewer than LEAST_WORDS words, or more
    than MOST_REPEATED percent of the words in repeated windows.  boilerplate: the numbers (from 0) of lines with words that
    the field marks so; content_share: the share of words on the others (0 without words); kept: no base rule failed and the
    share is `content` or more.  Without a field all lines are content.  A null text counts as one without words; null ids and
    repeated rows are rows like others; other columns are not read; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RULED.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int32())]
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = measured(text.as_buffer().to_pybytes() if text.is_valid else b"")
                marked = chain.viterbi(m.features) == BOILERPLATE if chain else np.zeros(len(m.lines), dtype=bool)
                failed = m.n_words < LEAST_WORDS or 100 * m.n_repeat_words > MOST_REPEATED * m.n_words
                share = float(m.words[~marked].sum() / m.n_words) if m.n_words else 0.0
                out.append((key, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, len(m.lines), int(marked.sum()), share, not failed and share >= content, m.lines[marked]))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, RULED)
