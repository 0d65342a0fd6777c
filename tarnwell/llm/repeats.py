"""Exact repeats of long byte strings, from the common-prefix interval trees of enhanced suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import merged_runs, small_side, tidied, written
from tarnwell.llm.npwords import _R, CHUNK, mix

#: Bytes of the grams whose smallest hash in a window stands for the window.
GRAM = 32
#: Bytes of different contexts that get one suffix array.  A fingerprint with more of them is parted by longer grams.
ARRAY_BYTES = 1 << 19
#: Windows of a segment; longer runs under one fingerprint (texts of a short period) are cut, so that equal pieces meet as such.
MOST_WINDOWS = 4096
#: A fingerprint of more segments is not gathered: its windows are counted by hash instead, over all tasks.
GATHERED = 20_000


class Windows:
    """Cuts the windows of `length` bytes of a text into segments of neighbours with the same smallest gram."""

    def __init__(self, length: int, gram: int = GRAM):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        n = CHUNK + 2 * length
        steps = np.full(n + 1, _R)
        steps[0] = 1
        self.up = np.multiply.accumulate(steps)
        steps[1:] = np.uint64(pow(int(_R), -1, 1 << 64))
        self.down = np.multiply.accumulate(steps)
        self.byte = mix(np.arange(1, 257, dtype="u8"))

    def hashes(self, data: np.ndarray, width: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype="u8")
        np.cumsum(self.byte[data] * self.up[: len(data)], out=total[1:])
        return mix((total[width:] - total[:-width]) * self.down[: len(data) - width + 1])

    def smallest(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window the hash of its smallest gram and the (leftmost) gram's place."""
        g = self.hashes(data, self.gram)
        best = (g & np.uint64(~0xFFFFFFF & (2**64 - 1))) | np.arange(len(g), dtype="u8")
        width = 1
        while 2 * width <= self.span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < self.span:
            rest = self.span - width
            best = np.minimum(best[:-rest], best[rest:])
        place = (best & np.uint64(0xFFFFFFF)).astype("i8")
        return g[place], place

    def segments(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text (fingerprints, first windows, numbers of windows, whether it may repeat within the text)."""
        at = 0
        while at < len(bounds) - 1:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1)
            if to == at + 1:
                yield self._long(data[bounds[at] : bounds[to]])
            else:
                part, cuts = data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
                found = self.smallest(part) if len(part) >= self.length else None
                for o, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    yield self._again(self._cut(found[0][o : e - self.length + 1], found[1][o : e - self.length + 1]) if e - o >= self.length else _NONE)
            at = to

    def _long(self, data: np.ndarray):
        parts = [_NONE]
        for i in range(0, max(0, len(data) - self.length + 1), CHUNK):
            fp, start, count, moved = self._cut(*self.smallest(data[i : i + CHUNK + self.length - 1]))
            parts.append((fp, start + i, count, moved))
        return self._again(tuple(np.concatenate([p[k] for p in parts]) for k in range(4)))

    @staticmethod
    def _cut(prints: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments of windows with one fingerprint, MOST_WINDOWS at most: fingerprint, first, number, and whether its gram moves."""
        start = np.flatnonzero(np.diff(prints, prepend=~prints[:1]))
        count = np.diff(start, append=len(prints))
        pieces = -(-count // MOST_WINDOWS)
        if len(start) and pieces.max() > 1:
            nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = np.repeat(count, pieces) - nth * MOST_WINDOWS
            start, count = np.repeat(start, pieces) + nth * MOST_WINDOWS, np.minimum(left, MOST_WINDOWS)
        return prints[start], start, count, places[start] != places[start + count - 1]

    @staticmethod
    def _again(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
        fp, start, count, moved = found
        _, group, times = np.unique(fp, return_inverse=True, return_counts=True)
        return fp.view("i8"), start.astype("i4"), count.astype("i4"), (times[group] > 1) | moved


_NONE = (np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, bool))


def _segments(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length)
        for batch in batches:
            text = batch.column(3).cast(pa.large_binary())
            bounds = np.frombuffer(text.buffers()[1], dtype="i8")[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, "i8")
            data = np.frombuffer(text.buffers()[2] or b"", dtype="u1") if len(text) else np.zeros(0, "u1")
            found = list(windows.segments(data, bounds))
            at = pa.array(np.cumsum([0] + [len(f[0]) for f in found]), pa.int32())
            join = lambda k, kind, found=found, at=at: pa.ListArray.from_arrays(at, pa.array(np.concatenate([f[k] for f in found]) if found else [], kind))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(3)], pa.array(np.diff(bounds), pa.int64()), join(0, pa.int64()), join(1, pa.int32()), join(2, pa.int32()), join(3, pa.bool_())],
                ["doc_id", "h1", "h2", "n_bytes", "fp", "first", "windows", "again"],
            )

    return rows


def _contexts(length: int):
    names = ["fp", "h1", "h2", "first", "ctx"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for a, b, text, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.as_buffer().to_pybytes()
                first, count, fp = (x.to_numpy(zero_copy_only=False) for x in segments.values.flatten())
                for i in range(0, len(fp), 1024):
                    f, c = first[i : i + 1024], count[i : i + 1024]
                    ctx = pa.array([data[s:e] for s, e in zip(f.tolist(), (f + c + length - 1).tolist(), strict=True)], pa.binary())
                    held.append(pa.RecordBatch.from_arrays([pa.array(fp[i : i + 1024]), pa.array(np.full(len(f), a)), pa.array(np.full(len(f), b)), pa.array(f), ctx], names))
                    size += ctx.nbytes
                    if size > 4 << 20:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held, size = [], 0
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return rows


def suffix_order(data: np.ndarray, end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts`, sorted, and each one's common prefix with the one before it.

    data: joined strings, each suffix ending at end[i].  Ranks double from 8 bytes on until they span the longest string.
    """
    n = len(data)
    left = end - np.arange(n)
    padded = np.zeros(n + 8, dtype="u8")
    padded[:n] = data
    key = np.zeros(n, dtype="u8")
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(left > i, padded[i : n + i], np.uint64(0))
    order = np.lexsort((np.minimum(left, 8), key))
    step = np.empty(n, dtype="i4")
    step[order] = np.cumsum(np.concatenate(([1], (np.diff(key[order]) != 0) | (np.diff(np.minimum(left, 8)[order]) != 0)))) if n else 0
    del padded, key, order
    ranks, width, longest = [step], 8, int(left.max(initial=0))
    while width < longest:
        both = ranks[-1].astype("i8") * (n + 1)
        both[: max(0, n - width)] += np.where(left[: max(0, n - width)] > width, ranks[-1][width:], 0)
        order = np.argsort(both, kind="stable")
        both = both[order]
        rank = np.empty(n, dtype="i4")
        rank[order] = np.cumsum(np.concatenate(([1], both[1:] != both[:-1])), dtype="i4")
        del order, both
        ranks.append(rank)
        width *= 2
    sa = starts[np.argsort(ranks[-1][starts], kind="stable")]
    i, j = sa[:-1], sa[1:]
    room = np.minimum(left[i], left[j])
    lcp = np.zeros(len(room), dtype="i8")
    for k in range(len(ranks) - 1, -1, -1):
        width = 8 << k
        can = lcp + width <= room
        same = can & (ranks[k][np.minimum(i + lcp, n - 1)] == ranks[k][np.minimum(j + lcp, n - 1)])
        lcp += width * same
    for _ in range(7):
        same = (lcp < room) & (data[np.minimum(i + lcp, n - 1)] == data[np.minimum(j + lcp, n - 1)])
        lcp += same
    return sa, np.concatenate(([0], lcp)) if len(sa) else lcp


def intervals(lcp: np.ndarray, left: np.ndarray, length: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The tree of intervals of at least `length` common bytes whose suffixes differ in the byte before them.

    lcp[i] belongs to suffixes i - 1 and i.  left: the byte before each suffix, or a negative number that is like no other.
    Returns (common prefix, number of the enclosing interval or -1) of each interval, and for each suffix the number of the
    smallest interval that holds it, or -1.  The stack holds the open intervals, the longest common prefix on top.
    """
    turns = np.concatenate(([0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0) | (left[:-1] < 0)))) if len(left) else left
    heights: list[int] = []
    parents: list[int] = []
    own = np.full(len(lcp), -1, dtype="i8")
    inside = np.concatenate((lcp >= length, [False]))
    edge = np.diff(inside.astype("i1"), prepend=0)
    for a, b in zip((np.flatnonzero(edge == 1) - 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True):
        if turns[a] == turns[b]:  # every suffix of the run has the same byte before it
            continue
        stack, closed = [(int(lcp[a + 1]), a)], []
        for i, value in enumerate([*lcp[a + 2 : b + 1].tolist(), 0], a + 2):
            first = i - 1
            while stack and stack[-1][0] > value:
                height, first = stack.pop()
                if turns[first] != turns[i - 1]:
                    number = len(heights)
                    heights.append(height)
                    parents.append(-1)
                    part = own[first:i]
                    part[part < 0] = number
                    while closed and closed[-1][0] >= first:
                        parents[closed.pop()[1]] = number
                    closed.append((first, number))
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, first))
    return list(zip(heights, parents, strict=True)), own


def _groups(length: int, named: bool):
    """Contexts, sorted by fingerprint, to the occurrences of maximal repeats in each (if `named`) and the runs of bytes that they cover."""

    def gathered(row, start, size, number, outer, pick):
        """One row for each context with occurrences, however many these are."""
        order = np.lexsort((start, row))
        row, start, size = row[order], start[order], size[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        wide = int((start + size).max(initial=0)) + 1  # keeps the contexts apart in one running maximum
        far = np.maximum.accumulate(row * wide + start + size) if len(row) else row
        opens = np.flatnonzero(np.concatenate(([True], (row * wide + start)[1:] > far[:-1]))) if len(row) else row
        ends = far[np.append(opens[1:], len(row)) - 1] - row[opens] * wide if len(row) else row
        cuts = pa.array(np.append(np.searchsorted(opens, first), len(opens)), pa.int32())
        struct = lambda names, *cols: pa.StructArray.from_arrays([pa.array(c) for c in cols], names=names)
        runs = pa.ListArray.from_arrays(cuts, struct(["s", "e"], start[opens], ends))
        if named:
            above = pa.array(outer[order], pa.int64(), mask=outer[order] < 0)
            of = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), struct(["number", "outer", "length", "start"], number[order], above, size, start))
        else:
            of = pa.nulls(len(first), pa.list_(pa.struct([(n, pa.int64()) for n in ("number", "outer", "length", "start")])))
        return pa.RecordBatch.from_arrays([*pick(row[first]), of, runs], ["fp", "h1", "h2", "occurrences", "runs"])

    cutters: dict[int, Windows] = {}

    def recut(strings: dict[bytes, list], gram: int) -> Iterator[dict[bytes, list]]:
        """The windows of strings under one fingerprint, parted by their smallest grams of `gram` bytes: equal windows stay together."""
        windows = cutters.setdefault(gram, Windows(length, gram))
        parted: dict[int, dict[bytes, list]] = {}
        for c, at in strings.items():
            data = np.frombuffer(c, dtype="u1")
            for f, start, count, _ in windows.segments(data, np.array([0, len(data)])):
                for x, i, n in zip(f.tolist(), start.tolist(), count.tolist(), strict=True):
                    parted.setdefault(x, {}).setdefault(c[i : i + n + length - 1], []).extend((r, o + i) for r, o in at)
        yield from parted.values()

    def repeats(fp, h1, h2, first, ctx):
        """Strings are held with the places where they stand: (rows of the contexts, offset in these)."""
        under: dict[int, dict[bytes, list[int]]] = {}
        for r, (f, c) in enumerate(zip(fp, ctx, strict=True)):
            under.setdefault(f, {}).setdefault(c, []).append(r)
        places, parts, number = np.array(first, dtype="i8"), [], 0
        held, size = [], 0

        def spread(at: list) -> tuple[np.ndarray, np.ndarray]:
            rows = np.concatenate([np.asarray(r, dtype="i8") for r, _ in at])
            return rows, np.repeat(np.array([o for _, o in at], dtype="i8"), [len(r) for r, _ in at])

        def whole(c: bytes, at: list) -> None:
            """A string that stands in several places repeats as a whole, its ends being open."""
            nonlocal number
            rows, offset = spread(at)
            if len(rows) > 1:
                parts.append((rows, places[rows] + offset, np.full(len(rows), len(c)), np.full(len(rows), number), np.full(len(rows), -1)))
                number += 1

        def arrayed() -> None:
            nonlocal held, size, number
            if held:
                data = np.frombuffer(b"".join(c for c, _ in held), dtype="u1")
                sizes = np.array([len(c) for c, _ in held])
                ends = np.cumsum(sizes)
                owner = np.repeat(np.arange(len(held), dtype="i4"), sizes)
                end = ends[owner]
                where = np.flatnonzero(end - np.arange(len(data)) >= length)
                sa, lcp = suffix_order(data, end, where)
                begin = (ends - sizes)[owner[sa]]
                left = np.where(sa == begin, -1, data[np.maximum(sa - 1, 0)].astype("i8"))
                tree, own = intervals(lcp, left, length)
                at = np.flatnonzero(own >= 0)
                spreads = [spread(x) for _, x in held]
                many = np.array([len(r) for r, _ in spreads])
                flat, offset = (np.concatenate([x[k] for x in spreads]) for k in (0, 1))
                from_ = np.cumsum(many) - many
                mine, shift, node = owner[sa[at]], (sa - begin)[at], own[at]
                copies = many[mine]
                each = np.repeat(np.arange(len(at)), copies)  # an occurrence in each text that has the string
                pick = from_[mine][each] + np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
                heights, above = (np.array([t[k] for t in tree], dtype="i8") for k in (0, 1))
                parts.append((flat[pick], places[flat[pick]] + offset[pick] + shift[each], heights[node][each], number + node[each], np.where(above < 0, -1, number + above)[node][each]))
                number += len(tree)
            held, size = [], 0

        def put(strings: dict[bytes, list], gram: int) -> None:
            nonlocal size
            some = {c: at for c, at in strings.items() if len(strings) > 1 or len(c) > 2 * length - gram or _regrams(c, gram)}
            total = sum(map(len, some))
            if total > ARRAY_BYTES and gram < length:
                for part in recut(strings, min(2 * gram, length)):
                    put(part, min(2 * gram, length))
                return
            for c, at in strings.items():
                whole(c, at)
            if size and size + total > ARRAY_BYTES:
                arrayed()
            held.extend(some.items())
            size += total

        for strings in under.values():
            put({c: [(r, 0)] for c, r in strings.items()}, GRAM)
        arrayed()
        none = (np.zeros(0, "i8"),) * 5
        return gathered(*(np.concatenate([p[k] for p in [none, *parts]]) for k in range(5)), lambda at: [pa.array([x[r] for r in at.tolist()], pa.int64()) for x in (fp, h1, h2)])

    def _regrams(c: bytes, gram: int) -> bool:
        """Whether a window can occur twice in a context of no more windows than grams: the last gram of its first window then does, too."""
        tail = c[length - gram : length]
        return c.find(tail) != c.rfind(tail)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= ARRAY_BYTES and row[0] != last:
                    yield repeats(*held)
                    held, size = [[], [], [], [], []], 0
                for k in range(5):
                    held[k].append(row[k])
                size, last = size + len(row[4]), row[0]
        if held[0]:
            yield repeats(*held)

    return rows


def _window_hashes(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(length)
        for batch in batches:
            for f, a, b, first, ctx in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                data = np.frombuffer(ctx, dtype="u1")
                for i in range(0, len(data) - length + 1, CHUNK):
                    h = windows.hashes(data[i : i + CHUNK + length - 1], length).view("i8")
                    n = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v), pa.int64()) for v in (f, a, b)] + [pa.array(h), pa.array(first + i + np.arange(n), pa.int64())], ["fp", "h1", "h2", "w", "start"])

    return rows


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"), text.cast("binary").alias("text"))


_OCCURRENCES = "array<struct<number: bigint, outer: bigint, length: bigint, start: bigint>>"
_RUNS = "array<struct<s: bigint, e: bigint>>"


def repeated_contexts(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", gathered: int = GATHERED, named: bool = True) -> tuple[DataFrame, DataFrame]:
    """fp, h1, h2, occurrences (null unless `named`) and runs of every context with repeats, and the table of the texts themselves.

    Every window of `length` bytes belongs to the fingerprint of its smallest gram, so equal windows meet under one
    fingerprint wherever they stand.  Texts are cut into segments of at most MOST_WINDOWS neighbouring windows with one fingerprint; fingerprints
    that occur once are left out, and for the others the segments' bytes (contexts) get suffix arrays whose interval trees
    yield the repeats.  A context's occurrences and the runs (s, e) that they cover are one row, so rows grow with the
    contexts alone.  Copies of a text count once.  A fingerprint of more than `gathered` segments is not gathered in a task:
    its windows are counted by hash over all tasks (repeats of `length`, a row for each).
    Second table: doc_id, h1, h2, n_bytes of every row.
    """
    base = written(keyed(docs, id_col, text_col).select("doc_id", "h1", "h2", "text").mapInArrow(_segments(length), "doc_id long, h1 long, h2 long, n_bytes long, fp array<long>, first array<int>, windows array<int>, again array<boolean>"), "segments")
    copies = written(base.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    single = base.join(small_side(copies), ["h1", "h2"], "left").where(F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("rep")))
    segments = single.select("doc_id", "h1", "h2", F.explode(F.arrays_zip("first", "windows", "fp", "again")).alias("s")).select("doc_id", "h1", "h2", "s.*")
    repeated = segments.groupBy("fp").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("again").alias("again"), F.count("*").alias("n")).where("again or lo <> hi")
    wanted = segments.join(repeated.select("fp", (F.col("n") > gathered).alias("hot")), "fp")
    lists = wanted.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.collect_set(F.struct("first", "windows", "fp", "hot")).alias("segments"))
    lists = written(lists, "candidates")
    # by text and the id that stands for it, so that copies of a text don't meet; shuffled at any size
    every, one = keyed(docs, id_col, text_col).alias("t"), lists.alias("l")
    mine = (F.col("t.h1") == F.col("l.h1")) & (F.col("t.h2") == F.col("l.h2")) & F.col("t.doc_id").eqNullSafe(F.col("l.rep"))
    texts = every.join(one.hint("merge"), mine).select("t.doc_id", "t.h1", "t.h2", "t.text", "l.segments")
    context_type = "fp long, h1 long, h2 long, first int, ctx binary"
    part = lambda hot: texts.select("h1", "h2", "text", F.filter("segments", lambda s: s["hot"] == F.lit(hot)).alias("s")).where(F.size("s") > 0).select("h1", "h2", "text", F.transform("s", lambda s: F.struct(s["first"], s["windows"], s["fp"])).alias("s")).mapInArrow(_contexts(length), context_type)
    found = part(False).repartition("fp").sortWithinPartitions("fp").mapInArrow(_groups(length, named), f"fp long, h1 long, h2 long, occurrences {_OCCURRENCES}, runs {_RUNS}")
    if not lists.where(F.exists("segments", lambda s: s["hot"])).isEmpty():
        windows = part(True).mapInArrow(_window_hashes(length), "fp long, h1 long, h2 long, w long, start long")
        twice = windows.groupBy("fp", "w").agg(F.count("*").alias("n"), F.min("start").alias("s0"), F.max("start").alias("s1"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi or s0 <> s1").select("fp", "w")
        one = F.array(F.struct(F.col("w").alias("number"), F.lit(None).cast("long").alias("outer"), F.lit(length).cast("long").alias("length"), F.col("start").alias("start")))
        run = F.array(F.struct(F.col("start").alias("s"), (F.col("start") + length).alias("e")))
        found = found.union(windows.join(twice, ["fp", "w"]).select("fp", "h1", "h2", one.cast(_OCCURRENCES), run.cast(_RUNS)))
    return found, base.select("doc_id", "h1", "h2", "n_bytes")


def maximal_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", gathered: int = GATHERED) -> tuple[DataFrame, DataFrame]:
    """Maximal repeats of at least `length` bytes among the distinct texts, and the table of the texts themselves.

    First table: fp, number (a repeat's name within fp and task), outer (the repeat of which it is an extension, or null),
    length, h1, h2 (a text's key), start.  Each occurrence has one row, under the longest of its repeats; it is one of the
    outer ones, too, so a repeat's occurrences are its own rows and those of the repeats inside it.  A segment's ends count as
    left-diverse, so repeats that run over several segments come out piece by piece and their union is whole.
    """
    found, base = repeated_contexts(docs, length, id_col, text_col, gathered)
    return found.select("fp", "h1", "h2", F.explode("occurrences").alias("o")).select("fp", "o.number", "o.outer", "o.length", "h1", "h2", "o.start"), base


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", gathered: int = GATHERED) -> DataFrame:
    """h1, h2, spans: for every text with such bytes the maximal runs (s, e) of bytes that a repeat covers."""
    with tidied() as kept:
        found, base = repeated_contexts(docs, length, id_col, text_col, gathered, named=False)
        whole = base.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("n_bytes").alias("b")).where(f"n > 1 and b >= {length}").select("h1", "h2", F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("b").alias("e"))).alias("runs"))
        each = found.select("h1", "h2", "runs").union(whole).groupBy("h1", "h2").agg(F.flatten(F.collect_list("runs")).alias("runs"))  # the runs of one text
        kept.append(written(each.select("h1", "h2", merged_runs(F.sort_array("runs")).alias("spans")), "spans"))
    return kept[0]


def _outside(data, runs):
    """The bytes of data that lie in none of the runs; as Latin-1 characters, because only strings can be joined."""
    piece = lambda at, to: F.decode(F.substring(data, (at + 1).cast("int"), (to - at).cast("int")), "ISO-8859-1")
    end = lambda k: F.when(k > 0, F.element_at(runs, F.greatest(k, F.lit(1)))["e"]).otherwise(0)
    start = lambda k: F.when(k < F.size(runs), F.element_at(runs, F.least(k + 1, F.size(runs)))["s"]).otherwise(F.octet_length(data))
    pieces = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda k: piece(end(k), start(k)))
    return F.when(F.size(runs) == 0, data).otherwise(F.encode(F.array_join(pieces, ""), "ISO-8859-1"))


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", gathered: int = GATHERED) -> DataFrame:
    """docs with the bytes that remove_repeats takes out gone from the text, and with them the rest of characters they cut.

    All rows and other columns stay as they are; a null text stays null, a text that is one repeat becomes empty.
    """
    spans = small_side(repeated_spans(docs, length, id_col, text_col, gathered)).withColumnsRenamed({"h1": "__h1", "h2": "__h2", "spans": "__spans"})
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(7), text)}).join(spans, ["__h1", "__h2"], "left")
    cut = F.make_valid_utf8(_outside(text.cast("binary"), F.col("__spans")).cast("string"))
    cut = F.when(F.contains(F.col(text_col), F.lit("\ufffd")), cut).otherwise(F.replace(cut, F.lit("\ufffd"), F.lit("")))
    return both.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut)).select(*docs.columns)


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", gathered: int = GATHERED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of every row of docs.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in the same text or another; strings
    are judged on the input, so all copies go.  Null and empty texts have no bytes.  Null ids and repeated rows are rows as
    any other (a repeated row repeats its text).  Texts shorter than `length` stay whole.  An empty table gives no rows.
    Other columns are not read.
    """
    spans = repeated_spans(docs, length, id_col, text_col, gathered)
    both = keyed(docs, id_col, text_col).join(small_side(spans), ["h1", "h2"], "left")
    runs = F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>"))
    n = F.octet_length("text")
    kept = _outside(F.col("text"), runs)
    removed = F.aggregate(runs, F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"])
    out = both.select("doc_id", n.cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size(runs).cast("long").alias("n_spans"), kept.alias("kept"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256))
