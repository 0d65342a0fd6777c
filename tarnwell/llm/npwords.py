"""Words and shingles of whole batches of texts as arrays of 64-bit hashes, for Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed together; longer texts are cut at white space, so a text's length does not decide the memory.
CHUNK = 1 << 17
_R = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype="u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input changes about half of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes the words between ASCII white space, A-Z as a-z."""

    def __init__(self):
        self.low = np.arange(256, dtype="u8")
        self.low[65:91] += 32
        self.low = mix(self.low + np.uint64(1))
        self.white = np.zeros(256, dtype=bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        steps = np.full(CHUNK + 1, _R)
        steps[0] = 1
        self.up = np.multiply.accumulate(steps)
        steps[1:] = np.uint64(pow(int(_R), -1, 1 << 64))
        self.down = np.multiply.accumulate(steps)

    def words(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words of one chunk of at most CHUNK bytes."""
        return self.ends(data)[0]

    def ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words of one chunk."""
        edge = np.diff(self.white[data].astype("i1"), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(len(data) + 1, dtype="u8")
        np.cumsum(self.low[data] * self.up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype("u8")), start

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each text of a column the hashes of its words; null has none."""
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype="i8")[column.offset : column.offset + n + 1] if n else np.zeros(1, "i8")
        data = np.frombuffer(column.buffers()[2] or b"", dtype="u1") if n else np.zeros(0, "u1")
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK - (n - at), side="right")) - 1)
            to = min(to, n)
            while to > at + 1 and offsets[to] - offsets[at] + (to - at) > CHUNK:
                to -= 1
            if to == at + 1:
                yield self.long(data[offsets[at] : offsets[to]])
            else:  # a space after each text, so that words end with it
                bounds = offsets[at : to + 1] - offsets[at] + np.arange(to - at + 1)
                joined = np.full(int(bounds[-1]), 32, dtype="u1")
                keep = np.ones(len(joined), dtype=bool)
                keep[bounds[1:] - 1] = False
                joined[keep] = data[offsets[at] : offsets[to]]
                hashes, starts = self.ends(joined)
                yield from np.split(hashes, np.searchsorted(starts, bounds[1:-1]))
            at = to

    def long(self, data: np.ndarray) -> np.ndarray:
        if len(data) <= CHUNK:
            return self.words(data)
        parts, at = [], 0
        while at < len(data):
            to = min(len(data), at + CHUNK)
            if to < len(data):
                gaps = np.flatnonzero(self.white[data[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:  # one word longer than a chunk: it counts as one word, hashed over its parts
                    end = to
                    while end < len(data) and not self.white[data[end]]:
                        end += 1
                    total = np.uint64(end - at)
                    for i in range(at, end, CHUNK):
                        total = mix(np.array([total]) + self.words(data[i : min(end, i + CHUNK)]))[0]
                    parts.append(np.array([total]))
                    at = end
                    continue
            parts.append(self.words(data[at:to]))
            at = to
        return np.concatenate(parts)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """The distinct shingles of n words, sorted; of fewer words the whole sequence; of none nothing."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, dtype="u8")
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * _ODD[i % len(_ODD)] + np.uint64(i)
    return np.unique(mix(total + np.uint64(k)))
