"""What a JSON document's own walk tells: facts for the analysis, scored objects, semantic regions, sections and their mixture."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from tarnwell.functions import json_words as words
from tarnwell.functions.json_walk import Walk, _dimensional, _flat, _hierarchical, _Regions, step, table_function

# Words by which objects and sections are scored.
TELLING = ("description", "reasoning", "analysis", "explanation", "comment")
CONTENT_TYPES = {
    "reasoning": ("reasoning", "explanation", "analysis", "insight", "conclusion"), "descriptive": ("description", "comment", "note", "summary"), "configuration": ("config", "setting", "option", "parameter"),
    "entity": ("id", "name", "title", "type"), "temporal": ("date", "time", "created", "updated", "period"),
}
SECTION_WORDS = ("description", "reasoning", "analysis", "explanation", "insight", "performance", "metric", "trend", "growth")
CONFIG_WORDS = ("config", "setting", "option", "preference", "parameter")
# End of the fixed values.
_EVERY = tuple(w for ws in words.DOMAINS.values() for w in ws)
_NAMED = tuple(dict.fromkeys((*words.PERFORMANCE, *words.REASONING, *_EVERY)))
_FIGURE, _RATE, _SPACE = re.compile(r"\d+%|\d+\.\d+", re.A), re.compile(r"\d+%|\d+\.\d+%|ratio|rate|percentage", re.A), re.compile(r'("(?:[^"\\]|\\.)*")|\s+')
_WEIGHTS = {x: (x in words.PERFORMANCE) + 1.5 * (x in words.REASONING) + 0.5 * _EVERY.count(x) for x in _NAMED}
_TELLING, _PLAIN, _OF = frozenset(TELLING), frozenset(("data", "info", "item")), {n: frozenset(ws) for n, ws in CONTENT_TYPES.items()}
#: Objects that tell at least this much are regions of at most this many characters.
LEAST_SCORE, REGION_CHARS = 3.0, 2048


def _scored(w: Walk, least: float) -> Iterator[tuple]:
    for i in range(len(w)):
        if w.kind[i] != "object":
            continue
        content, own = w.part(i), w.own.get(i, [])
        low, below = content.lower(), w.below(i)
        texts = [w.text[j] for j in below if w.text[j] is not None]
        named = [x for x in _NAMED if x in low]
        score = sum(_WEIGHTS[x] for x in named) + sum(len(t) > 50 for t in texts) + (0 if _TELLING.isdisjoint(own) else 2)
        if any(len(t) > 20 for t in texts):
            score += any(w.kind[j] in ("numeric", "boolean") for j in below) or any(_FIGURE.search(t) for t in texts)
        if score < least:
            continue
        of = [n for n, ws in _OF.items() if not ws.isdisjoint(own)]
        kind = "reasoning" if "reasoning" in of else "performance_metrics" if any(_RATE.search(w.part(j)) for j in below) else of[0] if of else "general"
        long_keys = [k.lower() for k in own if len(k) > 3 and k.lower() not in _PLAIN]
        yield w.path[i], w.level[i], content, float(score), kind, sorted({*named, *long_keys})


#: Objects with what they tell, if they tell enough.
scored_objects = table_function("path string, level int, content string, score double, content_type string, keywords array<string>", _scored, least=float("-inf"))


def _told(w: Walk, least: float, limit: int) -> Iterator[tuple]:
    found = sorted(_scored(w, least), key=lambda r: r[0].encode())
    if found:
        regions = _Regions()
        for path, level, content, score, kind, keywords in found:
            regions.eval({"document_id": None, "path": path, "level": level, "score": score, "content_type": kind, "keywords": keywords, "content": content}, limit)
        for _, path, level, _, kind, keywords, content, number in regions.terminate():
            yield "semantic", str(number), path, level, [f"content_type:{kind}", *[f"keyword:{k}" for k in keywords[:5]]], content
        return
    for i in w.below(0):
        if w.key[i] is not None and w.n[i]:
            yield "semantic_fallback", w.key[i], w.path[i], 1, [], keyed(w.key[i], w.part(i))


#: The regions of a document, or without any its top level; name is a region's number or a key.
told_chunks = table_function("chunk_type string, name string, path string, level int, tags array<string>, content string", _told, least=LEAST_SCORE, limit=REGION_CHARS)


def keyed(key: str, value: str) -> str:
    """The JSON object of one key and a value's JSON."""
    return f"{{{json.dumps(key, ensure_ascii=False)}:{value}}}"


def _sectioned(w: Walk, flat_depth: int, large: int, array_ratio: float, telling: float) -> Iterator[tuple]:
    """section, strategy and JSON of each section, with its node and the node after its last one; the root's is the whole document."""
    tops, depth, items, arrays = [i for i, p in enumerate(w.parent) if p == 0], {0: 0}, {0: 1}, {0: int(w.kind[0] == "array")}
    for t, end in zip(tops, [*tops[1:], len(w)], strict=True):
        depth[t], items[t], arrays[t] = max(w.level[t:end]), end - t, w.kind[t:end].count("array")
    if max(depth.values()) + 1 <= flat_depth and len(w.json) < large and not sum(arrays.values()):
        yield "entire_document", "flat", w.json, 0, len(w)
        return
    for t, end in zip(tops, [*tops[1:], len(w)], strict=True):
        if w.key[t] is None:
            continue
        text, score, config = w.part(t), 0, False
        if w.n[t] is not None:
            low = text.lower()
            score = sum(x in low for x in SECTION_WORDS) + (len(text) > 1000)
        if w.kind[t] == "object" and depth[t] == 3:
            key, inner = w.key[t].lower(), " ".join(w.own.get(t, [])).lower()
            config = any(x in key or x in inner for x in CONFIG_WORDS)
        if arrays[t] and arrays[t] / items[t] >= array_ratio:
            strategy = "dimensional"
        elif score >= telling:
            strategy = "semantic"
        elif depth[t] > flat_depth or (depth[t] > 2 and not (config and depth[t] <= 3)):
            strategy = "hierarchical"
        else:
            strategy = "flat"
        yield w.key[t], strategy, keyed(w.key[t], text), t, end


def _sections(w: Walk, **options: object) -> Iterator[tuple]:
    return (s[:3] for s in _sectioned(w, **options))


#: The strategy that fits each top-level key; a small plain document is one section by itself.
section_rows = table_function("section string, strategy string, json string", _sections, flat_depth=2, large=10_000, array_ratio=0.4, telling=2.0)


def _section_chunks(whole: Walk, section: str, strategy: str, text: str, node: int, end: int) -> Iterator[tuple]:
    """path, id, type, level, parent, number of keys, arrays, places and names to tag by, tags and content of a section's chunks."""
    marks = [f"hybrid_strategy:{strategy}", f"hybrid_section:{section}"]
    if strategy == "flat" and node and whole.n[node] is None:  # one plain value
        yield "flat_chunk_0", f"{section}_flat_0", 1, None, 1, False, [], ["$" + step(section)], marks, text
        return
    w = whole.section(node, end, text) if node else whole
    if strategy == "flat":
        for n, keys, arrays, level, paths, content in _flat(w, 10):
            yield f"flat_chunk_{n}", f"{section}_flat_{n}", level, None, keys, arrays, [], paths, marks, content
    elif strategy == "hierarchical":
        for path, level, up, up_level, keys, arrays, own, content in _hierarchical(w, **hierarchical_defaults):
            yield path, f"{section}_hier_{level}_{path}", level, None if up is None else f"{section}_hier_{up_level}_{up}", keys, arrays, [path], own, marks, content
    elif strategy == "semantic":
        for kind, name, path, level, tags, content in _told(w, LEAST_SCORE, REGION_CHARS):
            yield path, f"{section}_{'fallback' if kind == 'semantic_fallback' else 'semantic'}_{name}", level, None, content.count('":'), "[" in content, [], [], [*tags, *marks], content
    else:
        for kind, path, piece, n, content in _dimensional(w, 50, 10):
            yield path or "remaining", "_".join([section, kind, *([path] if path else []), str(piece)]), 1, None, n, kind == "array", [], [], marks, content


hierarchical_defaults = {"max_bytes": 100_000, "depth": 3, "max_tokens": 7600, "skipped_levels": [0, 1]}


def _mixed(w: Walk, small: int, few_keys: int, large: int) -> Iterator[tuple]:
    chunks = sorted(((section, c[0], c[1], strategy, *c[2:]) for section, strategy, *at in _sectioned(w, **section_rows.called[2]) for c in _section_chunks(w, section, strategy, *at)), key=lambda c: (c[:3], c[-1]))
    runs, tiny = [], False
    for c in chunks:
        size, before = len(c[-1].encode()), tiny
        tiny = size < small and c[6] < few_keys
        if not (tiny and before):
            runs.append([])
        runs[-1].append((size, c))
    for number, run in enumerate(runs, 1):
        size, (_, path, own, strategy, level, parent, keys, arrays, places, names, marks, content) = sum(s for s, _ in run), run[0][1]
        kind, name = f"hybrid_{strategy}", own
        if len(run) > 1:
            several = [c for _, c in run]
            level, keys, arrays = max(c[4] for c in several), sum(c[6] for c in several), any(c[7] for c in several)
            places, names, marks = ([x for c in several for x in c[k]] for k in (8, 9, 10))
            kind, path, parent, name = "hybrid_merged", "merged_small_chunks", None, f"hybrid_merged_{number}"
            content = f"{{{','.join(f'{chr(34)}merged_section_{k}{chr(34)}:{c[-1]}' for k, c in enumerate(several))}}}"
        if size <= large:
            yield name, kind, path, level, parent, size, keys, arrays, places, names, marks, [], content
            continue
        for n, keys, arrays, level, paths, part in _flat(Walk(_SPACE.sub(r"\1", content)), 10):
            yield f"{name}_{n}", f"{kind}_split", f"flat_chunk_{n}", level, None, len(part.encode()), keys, arrays, [], paths, [], ["split_from_large_chunk"], part


#: Each section's chunks by the strategy that fits it; neighbouring small chunks are joined and very large ones cut flat.
mixed_chunks = table_function(
    "name string, chunk_type string, path string, level int, parent string, size long, key_count long, contains_arrays boolean, places array<string>, names array<string>, marks array<string>, last array<string>, content string", _mixed, small=500, few_keys=5, large=100_000,
)

# --- facts ------------------------------------------------------------------------------------------------------------
_END = r"(?:\n|\r\n?|\x85| | )?\Z"  # where Java's $ matches
_DIGITS, _CAMEL, _CAMEL_UP = re.compile(rf"\d+{_END}", re.A), re.compile(rf"[a-z][a-zA-Z0-9]*{_END}"), re.compile("[a-z][a-zA-Z0-9]*[A-Z]")
_ISO, _NUMBER, _WORD, _TEMPORAL = re.compile(r"\d{4}-\d{2}-\d{2}", re.A), re.compile(rf"\d+\.?\d*%?{_END}", re.A), re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile(words.TEMPORAL, re.A)
_METRICS = {n: re.compile(p, re.A) for n, p in words.METRIC_PATTERNS.items()}
_upper = lambda t: t == t.upper() and t != t.lower()


#: Facts of keys and of short texts that a task has met; no more than KNOWN of each.
KNOWN, _keys, _texts = 1 << 14, {}, {}


def _met(known: dict[str, tuple], word: str, of: Callable[[str], tuple]) -> tuple:
    if (found := known.get(word)) is None:
        found = of(word)
        if len(known) < KNOWN:
            known[word] = found
    return found


def _key_facts(key: str) -> tuple:
    """The places of a key's type and pattern, and the words that it holds."""
    low, has = key.lower(), lambda ws: frozenset(x for x in ws if x in low)
    kind = next((n for n, ws in words.KEY_TYPES.items() if has(ws)), None) or ("numeric_key" if _DIGITS.match(key) else "constant" if _upper(key) else "snake_case" if "_" in key else "camelCase" if _CAMEL.match(key) else "other")
    written = "snake_case" if "_" in key else "camelCase" if _CAMEL_UP.match(key) else "UPPER_CASE" if _upper(key) else "lowercase" if key == low and key != key.upper() else "kebab-case" if "-" in key else "mixed"
    found = frozenset(n for n, p in _METRICS.items() if p.search(low))
    entity = len(key) >= 2 and low not in words.TECHNICAL
    return words.TYPES.index(kind), words.WRITTEN.index(written), found, bool(_TEMPORAL.search(low)), has(words.PERFORMANCE), bool(has(words.METADATA)), entity, "metric" in low, has(_EVERY)


def _text_facts(text: str) -> tuple:
    low, n = text.lower(), len(_WORD.findall(text))
    kind = "date_iso" if _ISO.match(text) else "numeric_string" if _NUMBER.match(text) else "long_text" if n > 10 else "sentence" if n > 3 else "uppercase_text" if _upper(text) else "short_text"
    reasons = frozenset(x for x in words.REASONING if x in low) if n > 5 else frozenset()
    return words.TEXTS.index(kind), any(x in low for x in words.DRILL_DOWN), bool(_TEMPORAL.search(low)), reasons, frozenset(x for x in _EVERY if x in low)


def _facts(w: Walk) -> Iterator[tuple]:
    types, written, forms = [0] * len(words.TYPES), [0] * len(words.WRITTEN), [0] * len(words.TEXTS)
    metrics, performance, reasons, domains, sections, entities = (set() for _ in range(6))
    drill = temporal = named_metric = False
    top = {0, *(i for i in w.below(0) if w.key[i] in words.COLLECTIONS)}
    for i, key in enumerate(w.key):
        if key is not None:
            kind, pattern, found, timed, performing, meta, entity, metric, domain = _met(_keys, key, _key_facts)
            types[kind] += 1
            written[pattern] += 1
            metrics |= found
            performance |= performing
            domains |= domain
            temporal, named_metric = temporal or timed, named_metric or metric
            if meta and w.parent[i] == 0:
                sections.add(key)
            if entity and w.parent[i] in top:
                entities.add(key)
        text = w.text[i]
        if text is not None:
            form, drilled, timed, why, domain = _met(_texts, text, _text_facts) if len(text) < 64 else _text_facts(text)
            forms[form] += 1
            drill, temporal = drill or drilled, temporal or timed
            reasons |= why
            domains |= domain
    count, shape = w.kind.count, w.shape.count
    arrays = [i for i, k in enumerate(w.kind) if k == "array" and not w.listed[i]] if count("array") else []
    hits = [sum(x in domains for x in ws) for ws in words.DOMAINS.values()]
    inside = lambda ws, found: [x for x in ws if x in found]
    yield (
        w.bytes(0), len(w.json), max(max(w.level) - 1, 0), sum(types), count("array"), count("object"), len(w) - count("array") - count("object"), drill, any(w.n[i] > 10 for i in arrays), any(w.uniform[i] for i in arrays), w.kind[0] == "object",
        types, written, forms, inside(_METRICS, metrics), temporal, inside(words.PERFORMANCE, performance), inside(words.REASONING, reasons), sorted(sections), sorted(entities), shape("BOOLEAN"), count("text"), count("numeric") + count("boolean"), shape("DECIMAL") + shape("DOUBLE"), named_metric, hits,
    )


#: What json_analysis aggregates over the nodes of a document, by one pass within its row.
facts = table_function(
    "size long, chars long, max_depth int, keys long, arrays long, objects long, leaves long, drill_down boolean, large_array boolean, uniform_array boolean, root_is_object boolean, types array<long>, written array<long>, forms array<long>, named_metrics array<string>, temporal_data boolean, "
    "performance_metrics array<string>, reasoning_content array<string>, metadata_sections array<string>, business_entities array<string>, booleans long, texts long, numbers long, floats long, has_metric boolean, hits array<long>", _facts,
)


def _hits(w: Walk, domains: list[list[str]]) -> Iterator[tuple]:
    hits = [0] * len(domains)
    for key, text in zip(w.key, w.text, strict=True):
        key, text = (key or "").lower(), (text or "").lower()
        for k, ws in enumerate(domains):
            hits[k] += any(x in key or x in text for x in ws)
    yield hits, sorted({k for k in w.key if k is not None})


#: The nodes whose key or text holds a word of each domain (in lower case), and the document's different keys.
config_hits = table_function("hits array<long>, keys array<string>", _hits, domains=[])

#: A document's different keys.
key_rows = table_function("key string", lambda w: ((k,) for k in {k for k in w.key if k is not None}))
