"""Cost-balanced packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a worker's word cache; it starts anew beyond them, so its memory is bounded.
CACHE_WORDS = 400_000
#: Sequences that are open at a time in a task.  Descending order and lowest cost hold among them.
OPEN_SEQUENCES = 256


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them for its JSON file.

    Words that follow a single space are encoded one by one and kept; texts in which white space stands in longer runs are
    encoded whole, and texts that hold the vocabulary's special string go to the tokenizers library itself.
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str, special: str = "<|endoftext|>"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(rank_path, "rb"))}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.special, self.whole = json_path, special, None
        self.after_space = _Words(self.bpe)

    def ids(self, text: str) -> np.ndarray:
        if self.special in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if "  " in text or text[-1:].isspace() or "\n " in text or " \n" in text or "\t" in text or "\r" in text:
            return np.array(self.bpe.encode_ordinary(text), dtype="<u4")
        first, *rest = text.split(" ")
        if len(self.after_space) > CACHE_WORDS:
            self.after_space.clear()
        head = np.array(self.bpe.encode_ordinary(first), dtype="<u4").tobytes()
        return np.frombuffer(head + b"".join(map(self.after_space.__getitem__, rest)), dtype="<u4")


class _Words(dict):
    def __init__(self, bpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        got = self[word] = np.array(self.bpe.encode_ordinary(" " + word), dtype="<u4").tobytes()
        return got


def attention_cost(lengths: np.ndarray, linear: float, quadratic: float) -> np.ndarray:
    return linear * lengths + quadratic * lengths.astype("f8") ** 2


def balanced(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths into ceil(total / size) sequences; returns (document, start, length, sequence, offset).

    Documents longer than a sequence give full pieces first.  Pieces then go, by descending cost, to the sequence of lowest
    cost with room; where none has room for a whole piece, it is cut to fill the cheapest sequence that is not full.
    """
    n = int(-(-int(lengths.sum()) // size))
    cost, room, out = np.zeros(n), np.full(n, size, dtype="i8"), []
    pieces, full = [], 0
    for doc, length in enumerate(lengths.tolist()):
        start = 0
        while length - start >= size:
            out.append((doc, start, size, full, 0))
            room[full] = 0
            full, start = full + 1, start + size
        if length > start:
            pieces.append((doc, start, length - start))
    pieces.sort(key=lambda p: (-p[2], p[0]))
    for doc, start, length in pieces:
        while length:
            fits = room >= length
            open_ = fits if fits.any() else room > 0
            at = int(np.where(open_, cost, np.inf).argmin())
            part = int(min(length, room[at]))
            out.append((doc, start, part, at, int(size - room[at])))
            room[at] -= part
            cost[at] += linear * part + quadratic * float(part) ** 2
            start, length = start + part, length - part
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def pack(docs: DataFrame, json_path: str, rank_path: str, pattern: str, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048, with_ids: bool = False, open_sequences: int = OPEN_SEQUENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence of at most `size` tokens.

    A document is its text's ids and end_id; a null or empty text is end_id alone.  Every id lies in exactly one piece.  Each
    task packs its own rows, open_sequences sequences at a time (more of them balance costs better and need more memory), so nothing is shuffled, a hot source is as good as any
    other, and each batch leaves less than one sequence of padding.  sequence_id is the task's number in the upper bits and a
    running number below.  Null ids and repeated rows are documents like others; other columns are not read; an empty table
    gives no rows.  with_ids adds the ids themselves (array<long>).
    """
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(json_path, rank_path, pattern)
        base, seq = TaskContext.get().partitionId() << 32, 0
        keys, ids, total = [], [], 0

        def flush():
            nonlocal seq, keys, ids, total
            lengths = np.array([len(x) for x in ids], dtype="i8")
            placed = balanced(lengths, size, linear, quadratic)
            part = [ids[d][s : s + n] for d, s, n, _, _ in placed]
            cols = [
                pa.array([keys[p[0]] for p in placed], pa.int64()),
                pa.array([p[1] for p in placed], pa.int64()),
                pa.array([p[2] for p in placed], pa.int64()),
                pa.array([zlib.crc32(x) for x in part], pa.int64()),
                pa.array([int(lengths[p[0]]) for p in placed], pa.int64()),
                pa.array([base + seq + p[3] for p in placed], pa.int64()),
                pa.array([p[4] for p in placed], pa.int64()),
                pa.array([linear * p[2] + quadratic * float(p[2]) ** 2 for p in placed], pa.float64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
            if with_ids:
                cols.append(pa.array([x.astype("i8") for x in part], pa.list_(pa.int64())))
                names.append("ids")
            seq += int(-(-int(lengths.sum()) // size))
            keys, ids, total = [], [], 0
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                got = np.append(bpe.ids(text), np.uint32(end_id)).astype("<u4")
                keys.append(key)
                ids.append(got)
                total += len(got)
                if total >= open_sequences * size:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, schema)
