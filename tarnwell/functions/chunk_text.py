"""Chunks as text for an encoder, with how much they say and what they hold."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _inner(value) -> str:
    """The content of an object or an array in words."""
    if isinstance(value, list):
        each = [str(x) if isinstance(x, (str, int, float)) else (f"object with {t}" if (t := _inner(x)) else "object") if isinstance(x, dict) else type(x).__name__ for x in value]
        return ", ".join(each)
    out = []
    for key, v in value.items():
        if isinstance(v, (int, float)):
            out.append(f"{key} {v}")
        elif isinstance(v, str):
            out.append(f"{key} '{v}'")
        elif isinstance(v, dict):
            out.append(f"{key} with {t}" if (t := _inner(v)) else f"{key} object")
        elif isinstance(v, list):
            out.append(f"{key} list with {t}" if (t := _inner(v)) else f"{key} list of {len(v)} items")
    return ", ".join(out)


def _described(chunk: dict, path: str) -> str:
    where = f"In section '{' > '.join(path.split('.'))}'" if path else "At the root level"
    out = []
    for key, v in chunk.items():
        if isinstance(v, dict):
            out.append(f"has {key} containing {t}" if (t := _inner(v)) else f"contains a {key} object with {len(v)} properties")
        elif isinstance(v, list):
            out.append(f"includes {key} with {_inner(v) or f'{len(v)} items'}")
        elif isinstance(v, str):
            out.append(f"has {key} set to '{v}'")
        elif isinstance(v, (int, float)):
            out.append(f"has {key} with value {v}")
        else:
            out.append(f"contains {key} with {type(v).__name__} data")
    return f"{where}, this structure {', '.join(out)}." if out else f"{where}, this is an empty structure."


def _pairs(chunk: dict, path: str) -> str:
    short = lambda v: f"object with {len(v)} properties" if isinstance(v, dict) else f"array with {len(v)} elements" if isinstance(v, list) else str(v)[:100] + "..." * (len(str(v)) > 100)
    return f"[{path or 'root'}] " + " | ".join(f"{k}: {short(v)}" for k, v in chunk.items())


def _narrated(chunk: dict, path: str) -> str:
    of = lambda kind, word: [f"{k} {word}" for k, v in chunk.items() if kind(v)]
    objects, arrays, values = of(lambda v: isinstance(v, dict), "object"), of(lambda v: isinstance(v, list), "collection"), of(lambda v: not isinstance(v, (dict, list)), "property")
    plural = lambda xs: "s" * (len(xs) > 1)
    parts = [f"{', '.join(objects)} structure{plural(objects)}"] * bool(objects) + [f"{', '.join(arrays)} data"] * bool(arrays) + [f"{', '.join(values)} value{plural(values)}"] * bool(values)
    place = path or "document root"
    return f"This document section at {place} defines {' and '.join(parts)}." if parts else f"This document section at {place} is empty."


def _json(chunk, path: str) -> str:
    return f"[{path or 'root'}]: {json.dumps(chunk, separators=(',', ':'))}"


MODES = {"contextual_description": _described, "key_value_pairs": _pairs, "structured_narrative": _narrated, "json": _json}


def chunk_text(content: Column, path: Column, mode: str = "contextual_description") -> Column:
    """A chunk's JSON in words; unknown modes give the JSON itself.  A chunk that is no object is one under `items`; null stays null."""
    write = MODES.get(mode, _json)

    @F.pandas_udf(StringType())
    def text(contents: pd.Series, paths: pd.Series) -> pd.Series:
        def one(c, p):
            if c is None:
                return None
            v = json.loads(c)
            return write(v if isinstance(v, dict) else {"items": v}, p or "")

        return pd.Series([one(c, p) for c, p in zip(contents, paths, strict=True)], dtype=object)

    return text(content, F.coalesce(path, F.lit("")))


def _density(*todo) -> float:
    total, said, todo = 0.0, 0.0, list(todo)
    while todo:
        v = todo.pop()
        if isinstance(v, (dict, list)):
            todo += v.values() if isinstance(v, dict) else v
            continue
        total += 1
        if isinstance(v, str):
            said += len(v.strip()) > 3 and not v.replace("_", "").replace("-", "").isdigit()
        elif isinstance(v, bool):
            said += 0.5
    return said / max(total, 1)


@F.pandas_udf(DoubleType())
def semantic_density(contents: pd.Series) -> pd.Series:
    """Of a chunk's plain values the share that are texts of over three characters and no numbers; booleans count half."""
    return pd.Series([_density() if c is None else _density(json.loads(c)) for c in contents], dtype="float64")


def text_and_density(content: Column, path: Column, mode: str = "contextual_description") -> Column:
    """chunk_text() and semantic_density() as a struct, by one reading of the chunk."""
    write = MODES.get(mode, _json)

    def both(contents: pd.Series, paths: pd.Series) -> pd.DataFrame:
        out = []
        for c, p in zip(contents, paths, strict=True):
            v = None if c is None else json.loads(c)
            out.append((None, _density()) if c is None else (write(v if isinstance(v, dict) else {"items": v}, p or ""), _density(v)))
        return pd.DataFrame(out, columns=["text", "density"]).astype({"text": object, "density": "float64"})

    # a filter would be pushed below a deterministic function, which then runs twice
    return F.pandas_udf(both, "text string, density double").asNondeterministic()(content, F.coalesce(path, F.lit("")))


def content_type(content: Column) -> Column:
    """text, numeric, structured, mixed or empty, by the values of a chunk's own keys."""
    kinds = F.array_distinct(F.filter(_kinds(content, {"STRING": "text", "OBJECT": "structured", "ARRAY": "structured", "BIGINT": "numeric", "DECIMAL": "numeric", "DOUBLE": "numeric", "BOOLEAN": "numeric"}), lambda k: k.isNotNull()))
    return F.when(F.size(_kinds(content, {})) == 0, "empty").when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("mixed")


def value_types(content: Column) -> Column:
    """The different types of a chunk's own values, sorted; booleans count as integers, nulls as other."""
    return F.array_sort(F.array_distinct(_kinds(content, {"STRING": "string", "OBJECT": "object", "ARRAY": "array", "BIGINT": "integer", "DECIMAL": "float", "DOUBLE": "float", "BOOLEAN": "integer", "VOID": "other"})))


def _kinds(content: Column, names: dict[str, str]) -> Column:
    values = F.map_values(F.try_variant_get(F.try_parse_json(content), "$", "map<string,variant>"))
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    of = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.transform(values, lambda v: F.try_element_at(name, of(v)) if names else of(v))
