"""Documents walked within their rows: nodes, table functions in SQL, regions, against plain recursive versions."""

import itertools
import json
import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tarnwell.functions import json_parts, json_walk
from tarnwell.functions.ingest import ingested
from tarnwell.functions.json_analysis import analysed
from tarnwell.functions.json_chunks import leaves, profile
from tarnwell.functions.json_strategies import scored, semantic
from tarnwell.functions.json_walk import Walk, table_function


def made_up(chance, depth=0):
    kind = chance.random()
    if depth < 5 and kind < 0.35:
        keys = ["a", "b.c", 'q"uote', "ünï", "d]", "", "long key", "e\\f", " x"]
        return {k: made_up(chance, depth + 1) for k in sorted(chance.sample(keys, chance.randint(0, 4)))}
    if depth < 5 and kind < 0.6:
        return [made_up(chance, depth + 1) for _ in range(chance.randint(0, 7))]
    return chance.choice([None, True, False, 0, -7, 12.5, 1e300, 10**25, "", "text", 'tab\tand "quotes" \\ 中文', "x" * 50])


def plain(value, path="$", level=0, key=None, listed=False, is_open=True):
    """Nodes as (path, level, key, kind, listed, open, keys below, arrays below, deepest below, json)."""
    kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "boolean" if isinstance(value, bool) else "text" if isinstance(value, str) else "numeric"
    rows = []
    if kind == "object":
        for k, v in value.items():
            step = json.dumps([k], ensure_ascii=False) if re.search(r'[.\[\]"]', k) else "." + k
            rows += plain(v, path + step, level + 1, k, listed, is_open)
    if kind == "array":
        rich = any(isinstance(v, (dict, list)) for v in value[:5])
        for i, v in enumerate(value):
            rows += plain(v, f"{path}[{i}]", level + 1, None, True, is_open and rich and isinstance(v, dict))
    own = (path, level, key, kind, listed, is_open, sum(r[2] is not None for r in rows), any(r[3] == "array" for r in rows), max((r[1] for r in rows), default=None), json.dumps(value, ensure_ascii=False, separators=(",", ":")))
    return [own, *rows]


def test_walk_equals_plain_recursion():
    chance = random.Random(3)
    for _ in range(400):
        value = made_up(chance)
        text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        w = Walk(text)
        got = [(w.path[i], w.level[i], w.key[i], w.kind[i], w.listed[i], w.open[i], w.keys[i], w.arrays[i], w.deepest[i], w.part(i)) for i in range(len(w))]
        assert got == plain(value)
        assert w.bytes(0) == len(text.encode())


def test_walk_has_no_depth_cap():
    deep = "1"
    for _ in range(3000):
        deep = '{"a":[' + deep + "]}"
    w = Walk(deep)
    assert len(w) == 6001 and w.level[-1] == 6000 and w.keys[0] == 3000


def test_shapes_of_numbers_and_uniform_arrays():
    w = Walk('{"a":[1,2,3],"b":[1,2.5],"c":[{"x":1},{"x":[]}],"d":[{"x":1},{"y":1}],"e":[7],"f":[99999999999999999999,1e5],"g":[[1],[]],"h":[1,"x"],"i":[true,1]}')
    assert [w.uniform[w.path.index(f"$.{k}")] for k in "abcdefghi"] == [True, True, True, False, False, True, True, False, False]
    assert [w.shape[w.path.index(p)] for p in ("$.a[0]", "$.b[1]", "$.f[0]", "$.f[1]")] == ["BIGINT", "DECIMAL", "DECIMAL", "DOUBLE"]


def documents(spark, rows):
    return spark.createDataFrame([(k, json.dumps(v) if v is not ... else None) for k, v in rows], "document_id string, t string").select("document_id", F.try_parse_json("t").alias("doc"))


def test_nodes_of_null_repeated_and_empty_tables(spark):
    docs = documents(spark, [("a", {"x": [1, {"y": None}]}), ("a", {"z": "t"}), (None, {}), ("null", ...), ("json null", None), ("root", [1])])
    got = sorted((r.document_id or "-", r.path, r.kind) for r in leaves(spark, docs).collect())
    assert got == [("-", "$", "object"), ("a", "$", "object"), ("a", "$", "object"), ("a", "$.x", "array"), ("a", "$.x[0]", "numeric"), ("a", "$.x[1]", "object"), ("a", "$.x[1].y", "null"), ("a", "$.z", "text"), ("json null", "$", "null"), ("root", "$", "array"), ("root", "$[0]", "numeric")]
    assert profile(leaves(spark, docs.limit(0))).count() == 0
    both = analysed(leaves(spark, docs)).collect()
    assert {r.document_id for r in both} == {"a", None, "json null", "root"}


def test_table_functions_stand_in_sql(spark):
    json_walk.register(spark)
    docs = documents(spark, [("one", {f"k{i:02}": i for i in range(23)}), ("two", {"a": {"b": [1]}}), ("none", ...)]).select("document_id", F.to_json("doc").alias("t"))
    docs.createOrReplaceTempView("json_texts")
    try:
        got = spark.sql("select document_id, chunk, key_count from json_texts, lateral json_flat_chunks(t, size => 10) order by document_id, chunk").collect()
        assert [tuple(r) for r in got] == [("one", 0, 10), ("one", 1, 10), ("one", 2, 3), ("two", 0, 1)]
        assert spark.sql("select count(*) from json_texts, lateral json_hierarchical_chunks(t)").first()[0] == 2
        for wrong in ("json_flat_chunks(t, sizes => 10)", "json_flat_chunks(t, size => length(t))", "json_flat_chunks(7)"):
            with pytest.raises(AnalysisException):
                spark.sql(f"select * from json_texts, lateral {wrong}").collect()
    finally:
        spark.catalog.dropTempView("json_texts")


def test_own_table_functions_chunk_and_analyse(spark):
    """A chunker whose columns follow an option, and an analyzer over a document's nodes as its partition."""
    own = table_function(lambda top: "path string, content string" + (", level int" if top else ""), lambda w, top: ((w.path[i], w.part(i), *([w.level[i]] if top else [])) for i in w.below(0)), top=False)
    assert len(spark.range(1).lateralJoin(own(F.lit('{"a":1}'), top=F.lit(True))).columns) == 4

    class Counted:
        def __init__(self):
            self.document, self.n = None, 0

        def eval(self, row):
            self.document, self.n = row["document_id"], self.n + 1

        def terminate(self):
            yield self.document, "mine" if self.n > 3 else "flat", self.n / 10

    json_walk.register(spark, own_chunks=own, own_analysis=udtf(Counted, returnType="document_id string, strategy string, confidence double"))
    docs = documents(spark, [("large", {"first": "some words here", "second": "and other words", "third": {"x": "deep words"}}), ("small", {"name": "a name of some length"})])
    got = {(r.document_id, r.path): r for r in ingested(spark, docs, {"mine": "own_chunks"}, "own_analysis", density=0.0).collect()}
    assert set(got) == {("large", "$.first"), ("large", "$.second"), ("large", "$.third"), ("small", "flat_chunk_0")}
    assert got["large", "$.third"].confidence == 0.5 and got["large", "$.third"].chunk_type == "own_chunks" and got["small", "flat_chunk_0"].strategy == "flat"


def brute_regions(objects, limit):
    """Every pair compared: objects (path, score, type, words, content) of one document, sorted by path."""
    tops = [o for o in objects if not any(o[0] != p[0] and o[0].startswith(p[0]) and o[0][len(p[0])] in ".[" for p in objects)]
    head = lambda o: json_walk.STEP.findall(o[0])[:1]
    near = lambda a, b: a[2] == b[2] != "general" or len(a[3] & b[3]) > 1 or head(a) == head(b) != []
    opener = {}
    for i, o in enumerate(tops):
        opener[i] = next((k for k in range(i) if opener[k] == k and near(tops[k], o)), i)
    out = []
    for k in [k for k in opener if opener[k] == k]:
        members = [tops[i] for i in opener if opener[i] == k]
        own = json.loads(members[0][4]) | {f"node_{n}": json.loads(m[4]) for n, m in enumerate(members[1:], 1)}
        out.append((members[0][0], sum(m[1] for m in members), members[0][2], set().union(*(m[3] for m in members)), own))

    def likeness(a, b):
        x, y = (json_walk.STEP.findall(r[0]) for r in (a, b))
        common = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(x, y, strict=False))))
        return min(1.0, 0.3 * (a[2] == b[2]) + (0.5 * len(a[3] & b[3]) / len(a[3] | b[3]) if a[3] and b[3] else 0) + (0.2 * common / max(len(x), len(y)) if x and y else 0))

    size, merged, gone = [len(json.dumps(r[4])) for r in out], [], set()
    for i, r in enumerate(out):
        if i in gone:
            continue
        ranked = sorted(((-likeness(r, out[j]), j) for j in range(i + 1, len(out)) if j not in gone and size[i] + size[j] <= limit), key=lambda x: x) if size[i] < limit // 2 else []
        if ranked and -ranked[0][0] > 0.3:
            j = ranked[0][1]
            gone.add(j)
            r = (r[0], r[1] + out[j][1], r[2], r[3] | out[j][3], r[4] | {f"merged_content_{j}": out[j][4]})
        merged.append(r)
    return [(p, round(s, 6), t, sorted(w), c) for p, s, t, w, c in merged]


def test_semantic_regions_equal_all_pairs(spark):
    chance = random.Random(8)
    types = ["general", "general", "entity", "reasoning", "temporal", "descriptive"]
    rows = []
    for d in range(60):
        paths = {"$" + "".join(chance.choice([".a", ".b", '["c.d"]', "[0]", "[1]", ".ab"]) for _ in range(chance.randint(0 if d == 0 else 1, 4))) for _ in range(chance.randint(1, 14))}
        for p in sorted(paths):
            content = {k: "x" * chance.randint(0, 40) for k in chance.sample(["k", "l", "node_1", "m"], chance.randint(0, 2))}
            rows.append((f"d{d}", p, p.count("."), float(chance.randint(3, 9)), chance.choice(types), chance.sample(["one", "two", "three", "four", "five", "six", "seven"], chance.randint(0, 3)), json.dumps(content)))
    objects = spark.createDataFrame(rows, "document_id string, path string, level int, score double, content_type string, keywords array<string>, content string")
    for limit in (150, 2048):
        want = {d: brute_regions([(r[1], r[3], r[4], set(r[5]), r[6]) for r in sorted(of, key=lambda r: r[1])], limit) for d, of in itertools.groupby(rows, lambda r: r[0])}
        got = {}
        for r in sorted(json_walk.semantic_regions(objects.asTable().partitionBy("document_id").orderBy("path"), F.lit(limit)).collect(), key=lambda r: r.number):
            got.setdefault(r.document_id, []).append((r.path, round(r.score, 6), r.content_type, list(r.keywords), json.loads(r.content)))
        assert got == want
    assert json_walk.semantic_regions(objects.limit(0).asTable().partitionBy("document_id").orderBy("path"), F.lit(9)).count() == 0


def test_telling_objects_and_fallbacks(spark):
    telling = {"reasoning": "because the trend was due to growth of 12% in a long explanation of the analysis", "rate": 0.5}
    rows = [("told", {"x": {"first": telling}, "y": {"plain": {"q": 1}}}), ("none", ...), ("flat", {"a": {"b": 1}, "c": 2, "d": {}})]
    docs = documents(spark, rows)
    found = {(r.document_id, r.path): r for r in scored(docs).collect()}
    assert found["told", "$.x.first"].score >= 3 and found["told", "$.x.first"].content_type == "reasoning" and found["flat", "$.a"].score < 3
    chunks = semantic(docs).collect()
    assert {(c.document_id, c.chunk_type) for c in chunks} == {("told", "semantic"), ("flat", "semantic_fallback")}
    assert [json.loads(c.content) for c in chunks if c.document_id == "flat"] == [{"a": {"b": 1}}] and json.loads(next(c.content for c in chunks if c.document_id == "told")) == rows[0][1]


def test_documents_told_in_their_rows_equal_their_grouped_nodes(spark):
    from tarnwell.functions.json_analysis import content, decided, discovered, structure
    from tarnwell.functions.json_configs import domains_by_config

    chance = random.Random(8)
    telling = [{"metric_id": 5, "Total_Count": "12%", "Überschrift": "2024-01-05 because of the growth in every region of the land"}, {"data": [{"price": 1.5, "orderTime": "X"}], "META": {}, "a-b": "ABC"}, {"items": {"name": "7", "12": "due to a time that was"}}, ["percent", {"Config": True}], {"": 1, "x\n": "1\n"}, "breakdown"]
    docs = documents(spark, [(str(k), made_up(chance)) for k in range(150)] + [(f"t{k}", v) for k, v in enumerate(telling)] + [("null", ...)])
    nodes = leaves(spark, docs)
    for of in (structure, content, analysed, lambda x: decided(analysed(x)), discovered, lambda x: domains_by_config(x, {"domain_patterns": {"d": ["a", "Met"], "e": []}, "metric_patterns": {"m": "^a|count"}})):
        within, grouped = of(docs), of(nodes)
        assert sorted(within.columns) == sorted(grouped.columns) and dict(within.dtypes) == dict(grouped.dtypes)
        shown = lambda df: sorted(str(sorted(r.asDict(True).items(), key=lambda x: x[0])) for r in df.collect())
        assert shown(within) == shown(grouped)


def test_documents_are_chunked_without_a_shuffle(spark):
    from tarnwell.functions.json_analysis import decided
    from tarnwell.functions.json_strategies import flat, hierarchical, hybrid, sections

    docs = documents(spark, [("a", {"x": {"y": 1}})])
    for df in (flat(docs), hierarchical(docs), semantic(docs), sections(docs), hybrid(docs), scored(docs), decided(analysed(docs))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_sections_with_an_empty_key_and_large_merged_chunks(spark):
    from tarnwell.functions.json_strategies import hybrid, sections

    docs = documents(spark, [("a", {"": {"x": {"y": {"z": 1}}}, "b": [1, 2], "c": 3})])
    assert sorted((r.section, r.strategy, r.json) for r in sections(docs).collect()) == [("", "hierarchical", '{"":{"x":{"y":{"z":1}}}}'), ("b", "flat", '{"b":[1,2]}'), ("c", "flat", '{"c":3}')]
    long = {"n": [{"k": i} for i in range(60)], "p": "x y"}
    cut = hybrid(documents(spark, [("d", long)]), large=40).orderBy("chunk_id").collect()
    assert all(r.chunk_type.endswith("_split") and r.tags[-1] == "split_from_large_chunk" for r in cut if "_split" in r.chunk_type) and any(r.chunk_type.endswith("_split") for r in cut) and all(json.loads(r.content) for r in cut)


def test_sections_share_the_walk_of_their_document():
    doc = {"customer": {"name": "ü", "at": {"x.y": [1, 2.5, {"a": None}]}}, "id": 7, "lines": [{"part": 1, "returned": True}, []], 'q"t': {"": {"b": "text"}}}
    w = json_walk.Walk(json.dumps(doc, ensure_ascii=False, separators=(",", ":")))
    tops = w.below(0)
    for t, end in zip(tops, [*tops[1:], len(w)], strict=True):
        text = json_parts.keyed(w.key[t], w.part(t))
        own, read = w.section(t, end, text), json_walk.Walk(text)
        for name in ("json", "parent", "key", "pos", "kind", "shape", "start", "end", "n", "text", "path", "level", "keys", "deepest"):
            assert getattr(own, name) == getattr(read, name)


def test_empty_keys_are_nested_under_their_own_names():
    w = json_walk.Walk('{"a":{"":{"b":1},"c":2},"":3}')
    (chunk,) = json_walk._flat(w, 10)
    assert json.loads(chunk[-1]) == {"a": {"": {"b": 1}, "c": 2}, "": 3}


def test_ids_may_repeat_and_a_text_is_made_once(spark):
    docs = spark.createDataFrame([(1, '{"name":"one of them"}'), (1, '{"name":"another one"}'), (2, '{"name":"the last"}'), (3, None)], "document_id long, t string").select("document_id", F.try_parse_json("t").alias("doc"))
    out = ingested(spark, docs)
    assert sorted((r.document_id, r.content) for r in out.collect()) == [("1", '{"name":"another one"}'), ("1", '{"name":"one of them"}'), ("2", '{"name":"the last"}')]
    assert {(r.strategy, r.confidence > 0.4) for r in out.collect()} == {("flat", True)}
    done = out.select("document_id", "text_hash", "semantic_density")._jdf.queryExecution().executedPlan().toString()
    assert done.count("ArrowEvalPython") == 1 and "Join" not in done
