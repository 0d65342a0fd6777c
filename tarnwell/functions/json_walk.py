"""A JSON document walked within its row: nodes with what lies below them, and table functions that chunk a document."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from functools import cached_property
from json.decoder import scanstring

from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"t": ("boolean", "BOOLEAN", 4), "f": ("boolean", "BOOLEAN", 5), "n": ("null", "VOID", 4)}
_SPECIAL = re.compile(r'[.\[\]"]')
STEP = re.compile(r'(\.[^.\[\]"]+|\["(?:[^"\\]|\\.)*"\]|\[\d+\])')


def step(key: str) -> str:
    """A key as a step of a path."""
    return json.dumps([key], ensure_ascii=False) if _SPECIAL.search(key) else "." + key


class Walk:
    """The nodes of a compact JSON text in the order of the document, as lists with one item for each node; the root is node 0.

    start and end say where a node's own JSON stands in the text, so that no part of it is written anew; n counts the items
    or keys, text is the value of a text.  path, level, listed, open, rich and uniform are what json_chunks.leaves says of
    them; deepest, keys and arrays tell of the nodes below (deepest level, number with a key, whether there is an array).
    What is not asked for is not made.
    """

    def __init__(self, text: str):
        self.json = text
        self._ascii = text.isascii()
        self._read(text)

    def __len__(self) -> int:
        return len(self.parent)

    def part(self, i: int) -> str:
        return self.json[self.start[i] : self.end[i]]

    def section(self, node: int, end: int, text: str) -> Walk:
        """The walk of the JSON object of a key and its value, which is a node and what is below it (up to the node `end`), without reading it again."""
        w = Walk.__new__(Walk)
        w.json, w._ascii = text, text.isascii()
        by = len(text) - 1 - self.end[node]
        w.parent = [-1, 0, *[p - node + 1 for p in self.parent[node + 1 : end]]]
        w.pos = [0, 0, *self.pos[node + 1 : end]]
        w.start, w.end = [0, *[x + by for x in self.start[node:end]]], [len(text), *[x + by for x in self.end[node:end]]]
        w.key, w.kind, w.shape, w.n, w.text = [None, *self.key[node:end]], ["object", *self.kind[node:end]], ["OBJECT", *self.shape[node:end]], [1, *self.n[node:end]], [None, *self.text[node:end]]
        return w

    def _read(self, s: str) -> None:
        nodes, n, end, objects = [], [], [], []
        add, i, up, k, stack = nodes.append, 0, -1, None, []
        number, words = _NUMBER.match, _WORDS
        while True:
            c, here, pos = s[i], i, 0
            if up >= 0:
                pos = n[up]
                n[up] += 1
            if c == '"':
                value, i = scanstring(s, i + 1, False)
                add((up, k, pos, "text", "STRING", here, value))
                n.append(None)
                end.append(i)
            elif c == "{" or c == "[":
                add((up, k, pos, "object", "OBJECT", here, None) if c == "{" else (up, k, pos, "array", "ARRAY", here, None))
                n.append(0)
                end.append(i + 2)
                i += 1
                if s[i] not in "}]":
                    up, k = len(n) - 1, None
                    stack.append(up)
                    objects.append(c == "{")
                    if c == "{":
                        k, i = scanstring(s, i + 1, False)
                        i += 1
                    continue
                i += 1
            else:
                if c in words:
                    name, form, size = words[c]
                    i += size
                else:
                    found = number(s, i)
                    i = found.end()
                    name, form = "numeric", "BIGINT" if found.lastindex is None and i - here < 19 else _form(s[here:i])
                add((up, k, pos, name, form, here, None))
                n.append(None)
                end.append(i)
            while stack:
                if s[i] == ",":
                    up = stack[-1]
                    i += 1
                    if objects[-1]:
                        k, i = scanstring(s, i + 1, False)
                        i += 1
                    else:
                        k = None
                    break
                i += 1
                end[stack.pop()] = i
                objects.pop()
            else:
                break
        self.parent, self.key, self.pos, self.kind, self.shape, self.start, self.text = map(list, zip(*nodes, strict=True))
        self.n, self.end = n, end

    @cached_property
    def own(self) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for p, k in zip(self.parent, self.key, strict=True):
            if k is not None:
                out.setdefault(p, []).append(k)
        return out

    @cached_property
    def rich(self) -> list[bool]:
        out = [False] * len(self)
        for i in range(1, len(self)):
            if self.n[i] is not None and self.pos[i] < 5 and self.kind[self.parent[i]] == "array":
                out[self.parent[i]] = True
        return out

    @cached_property
    def uniform(self) -> list[bool]:
        first, alike = {}, {}
        for i in range(1, len(self)):
            p = self.parent[i]
            if self.kind[p] == "array":
                form = ("OBJECT", *self.own.get(i, ())) if self.shape[i] == "OBJECT" else self.kind[i]  # the text of a number does not tell 5.0 from 5
                if first.setdefault(p, form) != form:
                    alike[p] = False
        return [self.kind[i] == "array" and self.n[i] > 1 and alike.get(i, True) for i in range(len(self))]

    @cached_property
    def path(self) -> list[str]:
        out = ["$"]
        for i in range(1, len(self)):
            k = self.key[i]
            out.append(out[self.parent[i]] + (f"[{self.pos[i]}]" if k is None else step(k)))
        return out

    @cached_property
    def level(self) -> list[int]:
        out = [0]
        for p in self.parent[1:]:
            out.append(out[p] + 1)
        return out

    @cached_property
    def listed(self) -> list[bool]:
        out = [False]
        for i in range(1, len(self)):
            out.append(out[self.parent[i]] or self.key[i] is None)
        return out

    @cached_property
    def open(self) -> list[bool]:
        out = [True]
        for i in range(1, len(self)):
            p = self.parent[i]
            out.append(out[p] and (self.key[i] is not None or (self.rich[p] and self.kind[i] == "object")))
        return out

    @cached_property
    def deepest(self) -> list[int | None]:
        out: list[int | None] = [None] * len(self)
        for i in range(len(self) - 1, 0, -1):
            p, d = self.parent[i], self.level[i] if out[i] is None else out[i]
            if out[p] is None or d > out[p]:
                out[p] = d
        return out

    @cached_property
    def keys(self) -> list[int]:
        out = [0] * len(self)
        for i in range(len(self) - 1, 0, -1):
            out[self.parent[i]] += out[i] + (self.key[i] is not None)
        return out

    @cached_property
    def arrays(self) -> list[bool]:
        out = [False] * len(self)
        for i in range(len(self) - 1, 0, -1):
            if out[i] or self.kind[i] == "array":
                out[self.parent[i]] = True
        return out

    def bytes(self, i: int) -> int:
        return self.end[i] - self.start[i] if self._ascii else len(self.part(i).encode())

    @cached_property
    def _children(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for i in range(1, len(self)):
            out.setdefault(self.parent[i], []).append(i)
        return out

    def below(self, i: int) -> list[int]:
        """The nodes directly below a node."""
        return self._children.get(i, [])


def _form(number: str) -> str:
    if "e" in number or "E" in number:
        return "DOUBLE"
    digits = len(number.lstrip("-").replace(".", ""))
    if "." not in number and (digits < 19 or digits == 19 and -(1 << 63) <= int(number) < 1 << 63):
        return "BIGINT"
    return "DECIMAL" if digits <= 38 else "DOUBLE"


def nested(w: Walk, nodes: list[int]) -> str:
    """Nodes that no array lies above as one object, under the keys that lead to them; the root stands under `items`."""
    top: dict = {}
    deepest = 0
    for i in nodes:
        keys, up = [], i
        while up:
            keys.append(w.key[up])
            up = w.parent[up]
        at = top
        for k in reversed(keys[1:]):
            at = at.setdefault(k, {})
        at[keys[0] if keys else "items"] = w.part(i)
        deepest = max(deepest, len(keys))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * deepest + 1000))
    shown = lambda x: x if isinstance(x, str) else "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{shown(v)}" for k, v in x.items()) + "}"
    return shown(top)


_TYPES = {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType()), "array<long>": ArrayType(LongType())}


def _fields(columns: str) -> list[StructField]:
    """Fields by name and type; an analyzer runs without a session that could read them."""
    return [StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))]


def table_function(schema: str, chunks: Callable[..., Iterator[tuple]], **defaults: object) -> UserDefinedTableFunction:
    """A table function of a JSON text, for lateral joins and for SQL: chunks(walk, **options) gives the rows.

    Options are constants and named; a document that is null has no rows.  The schema (names with string, int, long, double,
    boolean, array<string> or array<long>) may be a function of the options.  json_chunks.called() calls it on a DataFrame's
    documents, batch by batch.
    """

    class Documents:
        @staticmethod
        def analyze(doc: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(doc.dataType, StringType):
                raise ValueError(f"a document is JSON text, not {doc.dataType.simpleString()}")
            for name, option in options.items():
                if name not in defaults:
                    raise ValueError(f"no option {name}; there are {', '.join(defaults)}")
                if not option.isConstantExpression:
                    raise ValueError(f"option {name} has to be a constant")
            values = defaults | {n: o.value for n, o in options.items()}
            return AnalyzeResult(StructType(_fields(schema(**values) if callable(schema) else schema)))

        def eval(self, doc: str, **options: object) -> Iterator[tuple]:
            if doc is not None:
                yield from chunks(Walk(doc), **(defaults | options))

    function = udtf(Documents)
    function.called = schema, chunks, defaults
    return function


def _flat(w: Walk, size: int) -> Iterator[tuple]:
    values = [i for i in range(len(w)) if not w.listed[i] and w.kind[i] != "object"]
    values.sort(key=lambda i: w.path[i].encode())
    for k in range(0, len(values), size):
        some = values[k : k + size]
        paths = [w.path[i] for i in some]
        yield k // size, len(some), any(w.kind[i] == "array" for i in some), max(w.level[i] for i in some), paths, nested(w, some)


#: The values of objects at any depth in path order, `size` to a chunk; arrays stay whole.
flat_chunks = table_function("chunk long, key_count long, contains_arrays boolean, level int, paths array<string>, content string", _flat, size=10)


def _hierarchical(w: Walk, max_bytes: int, depth: int, max_tokens: int, skipped_levels: list[int]) -> Iterator[tuple]:
    kinds: dict[int, set[str]] = {}
    for i in range(1, len(w)):
        if w.key[i] is not None:
            kinds.setdefault(w.parent[i], set()).add("numeric" if w.kind[i] == "boolean" else w.kind[i])
    above: list[int | None] = [None] * len(w)
    for i in range(len(w)):
        near = above[w.parent[i]] if i else None
        above[i] = near
        if not w.open[i] or w.n[i] is None:
            continue
        own, types = w.own.get(i, []), kinds.get(i, set())
        if w.kind[i] == "object":
            mixed = len(types) > 2 and bool(types & {"object", "array"})
            if not own or not (w.bytes(i) > max_bytes or w.deepest[i] - w.level[i] >= depth or len(own) >= 10 or mixed):
                continue
            content, keys, arrays = w.part(i), w.keys[i], w.arrays[i]
        elif not w.rich[i] and w.n[i] > 10 and w.key[i] is not None:
            content, keys, arrays, own = f"{{{json.dumps(w.key[i], ensure_ascii=False)}:{w.part(i)}}}", w.keys[i] + 1, True, [w.key[i]]
        else:
            continue
        if w.level[i] in skipped_levels and len(content) // 4 > max_tokens:
            continue
        if w.kind[i] == "object":
            above[i] = i
        up = (None, None) if near is None else (w.path[near], w.level[near])
        yield w.path[i], w.level[i], *up, keys, arrays, own, content


#: Objects that are large, deep, wide or mixed, and long plain arrays, each with the path and level of its nearest chunk above.
hierarchical_chunks = table_function(
    "path string, level int, up string, up_level int, key_count long, contains_arrays boolean, own array<string>, content string", _hierarchical, max_bytes=100_000, depth=3, max_tokens=7600, skipped_levels=[0, 1],
)


def _dimensional(w: Walk, least: int, size: int) -> Iterator[tuple]:
    inside, rest = [False] * len(w), []
    for i in range(len(w)):
        p = w.parent[i]
        inside[i] = i > 0 and (inside[p] or (w.kind[p] == "array" and w.n[p] >= least))
        if inside[i]:
            continue
        if w.kind[i] == "array" and w.n[i] >= least:
            step = min(100, max(10, w.n[i] // 10))
            items = [w.part(j) for j in w.below(i)]
            for k in range(0, len(items), step):
                yield "array", w.path[i], k // step, len(items[k : k + step]), f"[{','.join(items[k : k + step])}]"
            rest.append((w.path[i], json.dumps({"_large_array_reference": {"original_path": w.path[i], "size": w.n[i]}}, ensure_ascii=False, separators=(",", ":"))))
        elif not w.n[i]:
            rest.append((w.path[i], w.part(i)))
    rest.sort(key=lambda x: x[0].encode())
    for k in range(0, len(rest), size):
        pairs = [f"{json.dumps(path, ensure_ascii=False)}: {value}" for path, value in rest[k : k + size]]
        yield "remaining", None, k // size, len(pairs), f"{{{', '.join(pairs)}}}"


#: The slices of large arrays, and what is in none of them, `size` leaves to a chunk in path order.
dimensional_chunks = table_function("kind string, path string, slice long, items long, content string", _dimensional, least=50, size=10)


def _objects(w: Walk) -> Iterator[tuple]:
    for i in range(len(w)):
        if w.kind[i] == "object":
            below = w.below(i)
            yield w.path[i], w.level[i], w.part(i), w.own.get(i, []), [w.text[j] for j in below if w.kind[j] == "text"], [w.kind[j] for j in below], [w.part(j) for j in below]


#: Every object with its keys and its own values: texts, kinds and JSON.
object_rows = table_function("path string, level int, json string, own array<string>, texts array<string>, kinds array<string>, parts array<string>", _objects)


class _Regions:
    """The telling objects of one document, in path order: the topmost ones, related ones together, small similar regions joined.

    Objects are related that share a content type (but `general`), two keywords or the top-level key.  Each such trait is
    looked up among those of the objects that opened a region, so the work grows with traits and not with pairs.  A region
    smaller than half the limit takes in the most similar later one with which it stays within the limit.
    """

    def __init__(self):
        self.tops: set[str] = set()
        self.regions: list[dict] = []
        self.opened: dict[tuple, int] = {}
        self.document = self.limit = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if limit.value is None:
            raise ValueError("the limit has to be a constant")
        own = StructField("document_id", rows.dataType["document_id"].dataType)
        return AnalyzeResult(StructType([own, *_fields("path string, level int, score double, content_type string, keywords array<string>, content string, number int")]))

    def eval(self, row, limit: int) -> None:
        self.document, self.limit = row["document_id"], limit
        steps = STEP.findall(row["path"])
        if any("$" + "".join(steps[:k]) in self.tops for k in range(len(steps))):
            return
        self.tops.add(row["path"])
        words = sorted(set(row["keywords"]))
        traits = [("key", steps[0])] if steps else []
        traits += [("type", row["content_type"])] if row["content_type"] != "general" else []
        traits += [("words", a, b) for k, a in enumerate(words) for b in words[k + 1 :]]
        at = min((self.opened[t] for t in traits if t in self.opened), default=None)
        if at is None:
            for t in traits:
                self.opened[t] = len(self.regions)
            self.regions.append({"path": row["path"], "steps": steps, "level": row["level"], "score": row["score"], "type": row["content_type"], "words": set(words), "parts": [row["content"]]})
        else:
            region = self.regions[at]
            region["score"] += row["score"]
            region["words"].update(words)
            region["parts"].append(row["content"])

    def terminate(self) -> Iterator[tuple]:
        parts = [_joined(r["parts"][0], [(f"node_{k + 1}", p) for k, p in enumerate(r["parts"][1:])]) for r in self.regions]
        sizes = [len(json.dumps(json.loads(p))) for p in parts]
        taken: dict[int, int | None] = {}
        for i, r in enumerate(self.regions):
            if i not in taken and sizes[i] < self.limit // 2:
                free = [j for j in range(i + 1, len(parts)) if j not in taken and sizes[i] + sizes[j] <= self.limit]
                likeness, place = max(((_likeness(r, self.regions[j]), -j) for j in free), default=(0.0, 0))
                if likeness > 0.3:
                    taken[-place] = i
        partner, number = {i: j for j, i in taken.items()}, 0
        for i, r in enumerate(self.regions):
            if i in taken:
                continue
            more = self.regions[partner[i]] if i in partner else None
            content = _joined(parts[i], [(f"merged_content_{partner[i]}", parts[partner[i]])]) if more else parts[i]
            yield self.document, r["path"], r["level"], r["score"] + (more["score"] if more else 0), r["type"], sorted(r["words"] | (more["words"] if more else set())), content, number
            number += 1


def _joined(content: str, more: list[tuple[str, str]]) -> str:
    """A JSON object with further entries at its end; an entry whose name it has takes that one's place."""
    if not more:
        return content
    own = json.loads(content)
    if any(name in own for name, _ in more):
        return json.dumps(own | {name: json.loads(part) for name, part in more}, ensure_ascii=False, separators=(",", ":"))
    inner = ",".join(f"{json.dumps(name)}:{part}" for name, part in more)
    return f"{content[:-1]}{',' if own else ''}{inner}}}"


# The shares of type, keywords and place in the likeness of two regions.
TYPE_SHARE, WORD_SHARE, PLACE_SHARE = 0.3, 0.5, 0.2


def _likeness(a: dict, b: dict) -> float:
    shared, steps = 0, (a["steps"], b["steps"])
    for x, y in zip(*steps, strict=False):
        if x != y:
            break
        shared += 1
    words = WORD_SHARE * len(a["words"] & b["words"]) / len(a["words"] | b["words"]) if a["words"] and b["words"] else 0.0
    place = PLACE_SHARE * shared / max(map(len, steps)) if all(steps) else 0.0
    return min(1.0, TYPE_SHARE * (a["type"] == b["type"]) + words + place)


#: Called with a table partitioned by document_id and ordered by path (path, level, score, content_type, keywords, content), and a limit.
semantic_regions = udtf(_Regions)

#: Table functions by the names under which SQL calls them.
FUNCTIONS = {"json_flat_chunks": flat_chunks, "json_hierarchical_chunks": hierarchical_chunks, "json_dimensional_chunks": dimensional_chunks, "json_objects": object_rows, "json_semantic_regions": semantic_regions}


def register(spark, **more: UserDefinedTableFunction) -> None:
    """Register the table functions, and a caller's own, for SQL."""
    for name, f in (FUNCTIONS | more).items():
        spark.udtf.register(name, f)
