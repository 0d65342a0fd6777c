"""Alignment of two tokenizers' tokens of the same bytes, and how often their ids are linked in a corpus."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import small_side, written

#: Entries of each of the two halves of a worker's cache of words, so its memory is bounded.  Longer words are not kept.
CACHE_WORDS, CACHE_CHARACTERS = 200_000, 64
#: Characters, and so tokens in about, that are aligned together; a longer text is aligned in several blocks of whole words.
BLOCK_TOKENS = 1 << 16
#: Linked pairs of a batch of results.
BATCH_PAIRS = 1 << 20
#: A space before which a text may be cut: neither tokenizer has a token that reaches over it.  A's words begin with such a
#: space, and no piece of B holds a space after another character.
CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
#: Ids of B are below this; a pair of ids is one number.
B_IDS = 1 << 20


class Words:
    """Ids of both tokenizers for a space and a word.

    New words of a block are encoded as one text.  A full cache becomes the older half, of which words that occur again are
    taken over, so frequent words stay known.
    """

    def __init__(self, rank_path: str, pattern: str, piece_path: str):
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes = {i: b for b, i in ranks.items()}
        shown = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in shown]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, dtype="i8")
        self.a_sizes[list(self.a_bytes)] = [len(b) for b in self.a_bytes.values()]
        self.b_sizes = np.array([len(b) for b in self.b_bytes], dtype="i8")
        self.known: dict[str, tuple[bytes, ...]] = {}
        self.older: dict[str, tuple[bytes, ...]] = {}

    def ids(self, words: list[str]) -> list[tuple[bytes, ...]] | None:
        """Each word's ids; None where the bytes of either tokenizer do not give the characters of all words again."""
        found = list(map(self.known.get, words))
        if None in found:
            new = self._new(list(dict.fromkeys(w for w, ids in zip(words, found, strict=True) if ids is None)))
            found = [new[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found if all(found) else None

    def _new(self, words: list[str]) -> dict[str, tuple[bytes, ...]]:
        """Ids of words that are not known; () for one that is not given again."""
        out = dict(zip(words, map(self.older.get, words), strict=True))
        asked = [w for w, ids in out.items() if ids is None]
        if asked:
            out.update(zip(asked, self._encoded(asked), strict=True))
        for word, ids in out.items():
            if len(word) <= CACHE_CHARACTERS:
                if len(self.known) >= CACHE_WORDS:
                    self.known, self.older = {}, self.known
                self.known[word] = ids
        return out

    def _encoded(self, words: list[str]) -> list[tuple[bytes, ...]]:
        """Ids of words, encoded as one text; if that cannot be cut into these words again, each half of them by itself."""
        text, parts = " ".join(words), []
        if len(words) == 1 or CUT.split(text) == words:
            raw, until = (" " + text).encode(), np.cumsum([len(w.encode()) + 1 for w in words])
            for ids, sizes, shown in ((self.bpe.encode_ordinary(" " + text), self.a_sizes, self.a_bytes), (self.pieces.encode(text), self.b_sizes, self.b_bytes)):
                if b"".join(map(shown.__getitem__, ids)) != raw:
                    break
                found = np.array(ids, dtype="u4")
                ends = np.cumsum(sizes[found])
                last = np.searchsorted(ends, until)
                if (ends[last] != until).any():
                    break
                flat, cuts = found.tobytes(), [0, *(4 * (last + 1)).tolist()]
                parts.append([flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False)])
        if len(parts) == 2:
            return list(zip(*parts, strict=True))
        half = len(words) // 2
        return self._encoded(words[:half]) + self._encoded(words[half:]) if half else [()]


def aligned(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two rows of tokens, of these sizes in bytes, that cover the same bytes.

    All tokens are put in order of their starts (lexsort; A's before B's); a group ends where the next start reaches the
    running maximum of the ends so far.  Within the order, each distinct start opens a stretch of bytes under the last token
    of A and the last token of B so far: these two overlap, and every two that overlap meet in one such stretch.  Gives
    order (A's tokens numbered first), its side (0 for A) and group for each place, and the tokens of A and of B of each link.
    """
    ends = np.concatenate([np.cumsum(a_sizes), np.cumsum(b_sizes)])
    starts = ends - np.concatenate([a_sizes, b_sizes])
    sides = np.repeat(np.array([0, 1], dtype="i1"), [len(a_sizes), len(b_sizes)])
    order = np.lexsort((sides, starts))
    start, side, far = starts[order], sides[order], np.maximum.accumulate(ends[order])
    group = np.cumsum(np.append(True, start[1:] >= far[:-1])[: len(order)]) - 1
    last = np.append(start[1:] != start[:-1], True)[: len(order)]
    return order, side, group, (np.cumsum(side == 0) - 1)[last], (np.cumsum(side == 1) - 1)[last]


_POWERS = 10 ** np.arange(9, -1, -1)


class _Numbers:
    """Decimal digits and separators of ids, from a table made once."""

    def __init__(self, largest: int):
        ids = np.arange(largest + 1)
        self.width = len(str(largest))
        digits = (ids[:, None] // _POWERS[-self.width :]) % 10
        seen = np.maximum.accumulate(digits > 0, axis=1)
        seen[:, -1] = True
        self.table = np.where(seen, digits + 48, 0).astype("u1")

    def shown(self, ids: np.ndarray, side: np.ndarray, group: np.ndarray) -> bytes:
        """Ids in order of groups, A's before B's: a1,a2|b1;a3|b2."""
        text = np.empty((len(ids), self.width + 1), dtype="u1")
        text[:, :-1] = self.table[ids]
        text[:-1, -1] = np.where(group[1:] != group[:-1], ord(";"), np.where(side[1:] != side[:-1], ord("|"), ord(",")))
        text[-1, -1] = 0
        flat = text.ravel()
        return flat[flat > 0].tobytes()


class Aligner:
    """Aligns whole texts, block by block."""

    def __init__(self, rank_path: str, pattern: str, piece_path: str):
        self.words = Words(rank_path, pattern, piece_path)
        self.numbers = _Numbers(max(len(self.words.a_sizes), len(self.words.b_sizes)))

    def text(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of A and B, groups, links, the digest of the groups, and the distinct pairs of linked ids with their numbers."""
        sha, counts, pairs, times = hashlib.sha256(), np.zeros(4, dtype="i8"), [], []
        for words in _blocks(text):
            found = self.words.ids(words)
            if found is None:
                return 0, 0, 0, 0, "", np.zeros(0, "i8"), np.zeros(0, "i8")
            ids = [np.frombuffer(b"".join(x), dtype="u4").astype("i8") for x in zip(*found, strict=True)]
            order, side, group, of_a, of_b = aligned(self.words.a_sizes[ids[0]], self.words.b_sizes[ids[1]])
            if counts[2]:
                sha.update(b";")
            by_group = np.argsort(2 * group + side, kind="stable")
            sha.update(self.numbers.shown(np.concatenate(ids)[order][by_group], side[by_group], group[by_group]))
            counts += [len(ids[0]), len(ids[1]), group[-1] + 1, len(of_a)]
            pair, n = np.unique(ids[0][of_a] * B_IDS + ids[1][of_b], return_counts=True)
            pairs.append(pair)
            times.append(n)
            if len(pairs) > 16:
                pairs, times = [[x] for x in _merged(pairs, times)]
        pair, n = _merged(pairs, times)
        return *counts.tolist(), sha.hexdigest() if counts[0] else "", pair, n


def _blocks(text: str) -> Iterator[list[str]]:
    """The words of a text, in blocks that end at the first cut after BLOCK_TOKENS characters."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + BLOCK_TOKENS) if len(text) - at > BLOCK_TOKENS else None
        end = cut.start() if cut else len(text)
        yield CUT.split(text[at:end])
        at = end + 1


def _merged(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(pairs) == 1:
        return pairs[0], times[0]
    if not pairs:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return pair, np.bincount(at, weights=np.concatenate(times), minlength=len(pair)).astype("i8")


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def align(docs: DataFrame, rank_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's alignment: numbers of tokens, groups and links, the digest of its groups, and its distinct linked pairs.

    A pair is A's id * B_IDS + B's id, `times` says how often it is linked in the text, `row` numbers the rows within a run.
    A null or empty text, and one whose bytes either tokenizer does not give again, has no tokens: zeros, '' and no pairs.
    Texts are aligned whole, in blocks of words; only a stretch without any space to cut at is encoded in one piece.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row, out, held = Aligner(rank_path, pattern, piece_path), TaskContext.get().partitionId() << 33, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            sizes = np.concatenate([[0], np.cumsum([len(r[7]) for r in out])])
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([r[k] for r in out]), kind)) for k, kind in ((7, pa.int64()), (8, pa.int32()))]
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate([pa.int64()] * 6 + [pa.string()])]
            out, held = [], 0
            return pa.RecordBatch.from_arrays([*cols, *lists], [c.split()[0] for c in ALIGNED.split(", ")])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = aligner.text(text.as_py() or "")
                out.append((row, key, *found))
                row, held = row + 1, held + len(found[5]) + 64
                if held >= BATCH_PAIRS:
                    yield flush()
        if out:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, ALIGNED)


def pair_counts(aligned_docs: DataFrame) -> DataFrame:
    """pair, a, b, count (documents that hold the pair linked) and best: no pair of the same id of A has a higher count."""
    counts = written(aligned_docs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pairs")
    a = F.floor(F.col("pair") / B_IDS).cast("long")
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))
    return counts.withColumn("a", a).join(highest, "a").select("pair", "a", (F.col("pair") % B_IDS).alias("b"), "count", (F.col("count") == F.col("highest")).alias("best"))


def cross_alignment(docs: DataFrame, rank_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of docs.

    n_best are the links whose pair has the highest count of its id of A (ties included), count_sum the sum of the counts of
    all links.  The table of counts is bounded by the vocabularies and broadcast while it is small; otherwise Spark shuffles.
    Null ids and repeated rows are documents like others; other columns are not read; an empty table gives no rows.
    """
    table = written(align(docs, rank_path, pattern, piece_path, id_col, text_col), "aligned")
    counts = small_side(written(pair_counts(table).select("pair", "count", "best"), "counts"))
    links = table.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    best = F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best")
    found = links.join(counts, "pair").groupBy("row").agg(best, F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return table.drop("pairs", "times").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
