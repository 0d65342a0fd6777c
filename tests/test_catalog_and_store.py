"""Metadata from files, routing by meaning, namespaces of vectors, collections, JSON strategies and charts."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.chunk_text import chunk_text
from tarnwell.functions.ingest import batch_requests, batch_results, ingested
from tarnwell.functions.json_analysis import content, decided, structure
from tarnwell.functions.json_chunks import leaves
from tarnwell.functions.json_strategies import flat, hierarchical, hybrid, semantic
from tarnwell.operators import charts, collections, store
from tarnwell.operators.vectors import search_text
from tarnwell.plans.compile import answer, branches
from tarnwell.plans.meaning import TableIndex, route_by_meaning, table_documents
from tarnwell.plans.model import Catalog, Dimension, Intent, Metric, Policy, Table
from tarnwell.plans.rules import enrich
from tarnwell.sources.metadata import load, metric_hint, parsed, table_schema

FILES = {
    "dimensions": {"dimensions": [{"name": "place", "aliases": ["spot"], "db_column": "place_col", "table_affinity": ["orders"], "hierarchy_name": "geo", "hierarchy_level": 1, "filter_mode": "ilike"}, {"name": "anywhere", "hierarchy_name": "geo"}]},
    "metrics": {"metrics": [{"name": "revenue", "db_column": "rev", "category": "absolute", "table_affinity": ["orders"]}, {"name": "goal", "db_column": "goal", "category": "absolute", "aggregate_fn": "AVG"}, {"name": "share", "category": "percentage", "formula_ref": "achieved"}]},
    "formulas": {"formulas": [{"name": "achieved", "display": "Achieved %", "expression": "SUM({revenue}) / NULLIF(SUM({goal}), 0) * 100", "components": ["revenue", "goal"]}]},
    "tables": {"tables": [{"name": "orders", "channel": "main", "date_column": "day", "description": "all orders", "dimensions": ["place"], "metrics": ["revenue", "goal", "share"], "date_mode": "snapshot"}]},
    "business_rules": {
        "domain_context": "shop", "metric_hints": [{"phrase": "below target", "polarity": "negative", "operator": "<"}], "having_patterns": [{"type": "vs_average", "description": "d", "sql_template": "t"}],
        "rules": [
            {"name": "highlight", "trigger": {"type": "keyword", "phrases": ["highlight"]}, "actions": [{"type": "ensure_formula", "formula": "achieved"}, {"type": "set_output_hint", "format": "enumeration", "columns": ["a"], "always_programmatic_enumeration": True}]},
            {"name": "both", "trigger": {"type": "compound", "conditions": [{"type": "any_of", "conditions": [{"type": "metric_present", "metrics": ["revenue"]}, {"type": "having_pattern", "having_type": "vs_average"}]}, {"type": "dimension_present", "dimensions": ["place"]}, {"type": "metric_category", "category": "absolute"}, {"type": "formula_requested", "formula": "achieved"}]},
             "actions": [{"type": "ensure_metrics", "metrics": ["goal"]}, {"type": "ensure_dimensions", "dimensions": ["place"]}, {"type": "create_formula", "name": "gap", "expression": "SUM({goal}) - SUM({revenue})", "components": ["goal", "revenue"]}, {"type": "override_formula", "formula": "achieved", "expression": "SUM({goal})", "components": ["goal"]}, {"type": "set_channel", "channels": ["main"]}, {"type": "set_sort", "direction": "ASC"}]},
        ],
    },
}


def test_metadata_files_make_a_catalog_that_answers(spark, tmp_path):
    for name, data in FILES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    m = load(spark, str(tmp_path))
    assert m.domain_context == "shop" and m.displays == {"achieved": "Achieved %"} and metric_hint("revenue BELOW target?", m)["polarity"] == "below" and metric_hint("x", m) is None
    t = m.catalog.tables["orders"]
    assert t.metrics == ("revenue", "goal", "share", "achieved") and m.catalog.metrics["revenue"].aggregate == "SUM" and m.catalog.canonical("SPOT") == "place"
    out, over = enrich(Intent(question="highlight it", dimensions=("place",), metrics=("revenue",)), m.rules, m.catalog)
    assert out.applied_rules == ("highlight", "both") and out.hint.format == "enumeration" and out.hint.columns == ("a",) and out.hint.always_enumerate
    assert out.metrics == ("revenue", "goal") and out.formulas == ("achieved", "gap") and out.sort == ("revenue", "ASC") and over.formulas["achieved"].template == "SUM({goal})"
    rows = spark.createDataFrame([("a", 2.0, 4.0, "2024-01-02"), ("b", 1.0, 1.0, "2024-01-02"), ("a", 9.0, 9.0, "2024-01-01")], "place_col string, rev double, goal double, day string")
    got = answer(Intent(dimensions=("place",), metrics=("revenue", "share")), m.catalog, {"orders": rows})
    assert sorted(tuple(r)[:3] for r in next(iter(got.values())).collect()) == [("a", 2.0, 50.0), ("b", 1.0, 100.0)]
    assert [f.name for f in table_schema(t, m.catalog)] == ["id", "day", "place_col", "rev", "goal"]
    broken = json.loads(json.dumps(FILES))
    broken["metrics"]["metrics"][0]["formula_ref"] = "nothing"
    (tmp_path / "metrics.json").write_text(json.dumps(broken["metrics"]))
    with pytest.raises(ValueError, match="no formula nothing"):
        load(spark, str(tmp_path))
    with pytest.raises(ValueError, match="unknown trigger"):
        parsed(FILES | {"business_rules": {"rules": [{"name": "x", "trigger": {"type": "odd"}}]}})
    assert "place (spot)" in m.catalog.described("dimensions")


def letters(texts):
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def test_routing_by_meaning(tmp_path):
    dims = [Dimension("region", "r", ("zone",), ("wide",)), Dimension("zulu", "z", (), ("narrow",))]
    tables = [Table("wide", "one", dimensions=("region",), metrics=("revenue",), description="regions"), Table("narrow", "two", "small", dimensions=("zulu",), metrics=("revenue",)), Table("other", "two", dimensions=(), metrics=("quota",))]
    cat = Catalog.of(dims, [Metric("revenue", "v", aliases=("sales", "a", "b", "c")), Metric("quota", "q")], [], tables, Policy(default_tables=("wide",), embedding_threshold=0.0))
    docs = table_documents(cat)
    assert docs["wide"] == "Table: wide | Channel: one | Description: regions | Dimensions: region(zone) | Metrics: revenue(sales, a, b)" and "Dimensions: none" in docs["other"]
    calls = []
    encoder = lambda texts: calls.append(len(texts)) or letters(texts)
    cache = str(tmp_path / "c" / "v.json")
    index = TableIndex(cat, encoder, cache)
    assert TableIndex(cat, encoder, cache).vectors == index.vectors and calls == [3]
    assert route_by_meaning(Intent(dimensions=("region",), metrics=("revenue",)), index) == ["wide"]
    assert route_by_meaning(Intent(metrics=("revenue",)), index) == ["wide"]
    assert route_by_meaning(Intent(metrics=("revenue",), filters=(("zulu", "x"),)), index) == ["narrow"]
    assert route_by_meaning(Intent(metrics=("quota",), channels=("two",)), index) == ["other"]
    assert set(route_by_meaning(Intent(dimensions=("nothing",)), index)) == {"wide", "narrow", "other"}
    strict = TableIndex(Catalog.of(dims, cat.metrics.values(), [], tables, Policy(embedding_threshold=0.9999)), letters)
    assert len(route_by_meaning(Intent(dimensions=("nothing",)), strict)) == 1
    assert all(s == 0.0 for _, s in TableIndex(cat, lambda t: [[0.0] for _ in t]).ranked("x"))


def test_a_faulty_branch_leaves_the_others(spark):
    tables = [Table("good", "a", dimensions=("d",), metrics=("x",)), Table("bad", "b", dimensions=("d",), metrics=("x",))]
    cat = Catalog.of([Dimension("d", "d")], [Metric("x", "x")], [], tables)
    frames = {"good": spark.createDataFrame([("a", 1)], "d string, x int"), "bad": spark.createDataFrame([("a", 1)], "d string, y int")}
    errors = []
    found = branches(Intent(dimensions=("d",), metrics=("x",)), cat, frames, errors=errors)
    assert [b.table for b in found] == ["good"] and errors[0][0] == "bad"
    with pytest.raises(Exception, match="x"):
        branches(Intent(dimensions=("d",), metrics=("x",)), cat, frames)


def test_namespaces_of_vectors(spark):
    store.create(spark, "one")
    rows = [("c1", "d1", "h1", [1.0, 0.0], "$.a", 1, "en"), ("c2", "d1", "h2", [0.0, 1.0], "$", 0, "en"), ("c3", "d2", "h3", None, "$", 0, "it's"), ("c4", "d2", "h3", None, "$", 0, "en")]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, text_hash string, embedding array<float>, path string, level int, collection_name string")
    assert store.exists(spark, "one") and not store.exists(spark, "two") and store.insert(spark, "one", df) == 3 and store.insert(spark, "one", df) == 0
    assert [r.chunk_id for r in store.by_document(spark, "one", "d1").collect()] == ["c2", "c1"] and store.by_chunk(spark, "one", "c3").first().collection_name == "it's"
    assert store.by_document(spark, "one", "d1", "none").count() == 0
    assert store.update(spark, "one", "c1", path="$.z", nothing=1) == 1 and store.update(spark, "one", "c9", path="x") == 0
    changed = store.by_chunk(spark, "one", "c1").first()
    assert changed.path == "$.z" and changed.updated_at is not None and store.by_chunk(spark, "one", "c2").first().updated_at is None
    assert store.migrate(spark, "one", "two") == 3 and store.names(spark) == ["one", "two"]
    with pytest.raises(ValueError):
        store.migrate(spark, "one", "two")
    assert store.delete(spark, "one", collection="it's") == 1 and store.delete(spark, "one", document_id="d9") == 0
    assert store.replace_document(spark, "one", "d1", df.where("chunk_id = 'c2'")) == 1 and spark.table(store.table_name("one")).count() == 1
    assert store.collection_view(spark, "two", "en", "en_only").count() == 2
    assert store.migrate(spark, "two", "three", "move") == 3 and store.names(spark) == ["one", "three"]
    with pytest.raises(ValueError):
        store.drop(spark, "one")
    with pytest.raises(ValueError):
        store.delete(spark, "one")
    for n in store.names(spark):
        store.drop(spark, n, confirm=True)
    assert store.names(spark) == []


def test_choosing_collections_and_dates():
    assert collections.chosen_dimension("a_b", {}, []) == "a_b" and collections.chosen_dimension("null", {"a": ["x"], "b": ["y"]}, ["a_b_c", "a_b", "a", "overall"]) == "a_b" and collections.chosen_dimension(None, {"a": []}, ["a"]) == "overall"
    assert collections.fallback_dimension("a", {"a"}) == "a" and collections.fallback_dimension("a_b", {"a_c", "x"}, {"a_b": "x"}) == "x"
    assert collections.fallback_dimension("a_b", {"a", "a_b_c", "z"}) == "a_b_c" and collections.fallback_dimension("a", set()) == "a"
    when = lambda *x: collections.date_range(True, *x, "20240601")
    assert when("20240101", "20240131") == (20240101, 20240131, "valid") and when("20240131", "20240101")[2] == "invalid_range" and when("2024013", "20240101")[2] == "invalid_format"
    assert when("20240230", "20240301")[2] == "invalid_format" and when("20250101", "20250102")[2] == "future_date" and collections.date_range(False, None, None, "20240601")[2] == "not_specified"
    assert collections.known_metric("cpm", ["eCPM", "CPM"]) == "CPM" and collections.known_metric("total cpm", ["CPM"]) == "CPM" and collections.known_metric("x", ["CPM"]) is None
    assert collections.expanded_granularities(["month", "qoq", "MONTH"], {"Month": ["mom", "mtd"]}) == ["mom", "mtd", "qoq"]


def test_results_in_order_and_embedded(spark):
    df = spark.createDataFrame([(1, "mom", 3.0), (2, "qoq", None), (3, "mom", -2.0)], "id int, gran string, change_pct double")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(collections.directed(df, "highest growth")) == [1] and ids(collections.directed(df, "lowest change")) == [3, 2] and ids(collections.directed(df, "tell me")) == [1, 2, 3]
    assert ids(collections.of_granularities(df, ["qoq"])) == [2] and ids(collections.of_granularities(df, ["yoy"])) == [1, 2, 3]
    texts = spark.createDataFrame([(i, None if i == 3 else "word " * (i + 1)) for i in range(6)], "i int, text string").coalesce(1)
    sent = []

    def encoder(batch):
        sent.append(len(batch))
        assert len(batch) == 1 or sum(math.ceil(len(t) / 4) for t in batch) <= 8
        return [[float(len(t))] for t in batch]

    got = {r.i: r.embedding for r in collections.embedded(texts, encoder, per_request=8).collect()}
    assert got == {i: None if i == 3 else [5.0 * (i + 1)] for i in range(6)}


def test_json_strategies(spark):
    docs = {
        "deep": {"d": {"e": {"f": {"g": {"h": [1.5, 2]}}}}},
        "wide": {f"k{i}": i for i in range(23)},
        "mixed": {"customer": {"name": "n", "list": list(range(12)), "deep": {"u": {"v": {"w": 1}}}}, "rows": [{"x": i, "note": "text", "in": {"y": i}} for i in range(3)]},
        "told": {"first": {"explanation": "growth change rate performance of it is low", "score": 3}, "second": {"reasoning": "because the trend was due to growth", "rate": 0.5}, "third": {"q": 1}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [("none", None), ("bad", "{x")], "document_id string, t string").select("document_id", F.try_parse_json("t").alias("doc"))
    nodes = leaves(spark, df)
    flats = flat(df).collect()
    assert sorted(c.key_count for c in flats if c.document_id == "wide") == [3, 10, 10]
    merged = {}
    for c in flats:
        for k, v in json.loads(c.content).items():
            old = merged.setdefault(c.document_id, {})
            old[k] = old[k] | v if isinstance(v, dict) and k in old else v
    assert merged["deep"] == docs["deep"] and merged["wide"] == docs["wide"] and merged["told"] == docs["told"]
    h = {(c.document_id, c.path): c for c in hierarchical(df).collect()}
    assert {p for d, p in h if d == "deep"} == {"$", "$.d", "$.d.e", "$.d.e.f"} and h["deep", "$.d.e"].parent_id == h["deep", "$.d"].chunk_id and h["deep", "$"].parent_id is None
    assert ("wide", "$") in h and {"$.customer", "$.customer.list", "$.customer.deep", "$.rows[0]", "$.rows[2]"} <= {p for d, p in h if d == "mixed"}
    assert json.loads(h["mixed", "$.customer.list"].content) == {"list": list(range(12))} and h["mixed", "$.rows[1]"].parent_id.endswith("$")
    big = spark.createDataFrame([("b", json.dumps({"a": {"b": {"c": {"d": "x" * 40_000}}}}))], "document_id string, t string").select("document_id", F.parse_json("t").alias("doc"))
    assert {c.path for c in hierarchical(big).collect()} == set()  # levels 0 and 1 are too large, the rest too shallow
    s = semantic(df).collect()
    assert {(c.document_id, c.chunk_type) for c in s if c.document_id in ("told", "deep")} == {("told", "semantic"), ("deep", "semantic_fallback")}
    y = hybrid(df).collect()
    assert {c.document_id for c in y} == set(docs) and all(json.loads(c.content) for c in y)
    told = {r.document_id: r.strategy for r in decided(structure(nodes).join(content(nodes), "document_id")).collect()}
    assert told["deep"] == "hierarchical" and set(told) == set(docs)
    text = df.where("document_id in ('told', 'none')").select("document_id", chunk_text(F.to_json("doc"), F.lit("")).alias("t")).collect()
    assert {r.document_id: r.t is None or r.t.startswith("At the root level, this structure has first containing explanation") for r in text} == {"told": True, "none": True}
    modes = {m: df.where("document_id = 'told'").select(chunk_text(F.to_json("doc"), F.lit("p"), m)).first()[0] for m in ("key_value_pairs", "structured_narrative", "other")}
    assert modes["key_value_pairs"].startswith("[p] first: object with 2 properties | ") and modes["structured_narrative"] == "This document section at p defines first object, second object, third object structures." and modes["other"].startswith("[p]: {")


def test_charts_and_text(spark):
    rows = [(f"town number {i}", f"zone{i % 3}", float(i), i % 4) for i in range(30)]
    df = spark.createDataFrame(rows, "town string, zone string, amount double, kind int")
    assert charts.chart_types(df) == {"town": "nominal", "zone": "nominal", "amount": "quantitative", "kind": "quantitative"} and charts.chart_type("interval day") == "nominal" and charts.chart_type("decimal(10,2)") == "quantitative"
    assert charts.bar_encoding(df) == {"y": "town", "color": "zone", "x": "amount"}
    spec = charts.chart(df, "bar", {"x": "zone", "y": "amount"}, "t")
    assert spec["encoding"]["y"]["field"] == "town" and spec["encoding"]["color"]["legend"] == {"orient": "bottom"} and spec["mark"]["orient"] == "horizontal" and len(spec["encoding"]["tooltip"]) == 4
    lying = charts.chart(df.select("town", "amount"), "bar", {"x": "town", "y": "amount"})
    assert lying["encoding"]["x"]["field"] == "amount" and lying["encoding"]["color"]["field"] == "town"
    with pytest.raises(ValueError):
        charts.chart(df, "blob", {})
    with pytest.raises(ValueError):
        charts.chart(df, "line", {"x": "nothing"})
    assert charts.interleaved(["d", "a_val", "b_val", "a_vol", "c_vol"]) == ["d", "a_val", "a_vol", "b_val", "c_vol"]
    table = charts.markdown_table("main_channel", ["d", "x"], [{"d": "a", "x": 1.234}, {"d": None, "x": 2}])
    assert "| D | X    |" in table and "| a | 1.23 |" in table and "### Main Channel" in table
    listed = charts.enumeration([(None, "one", [{"a": 1, "b": None}]), ("zsm", "two", [{"a": 2}, {"a": 3}]), ("zsm", "three", []), ("rsm", "x", [{"a": ""}])], most=1)
    assert listed.split("\n\n")[0] == "### ZSM (2 rows total)\n  [TWO]\n    1. | a: 2\n  ... 1 more" and listed.endswith("### ONE (1 rows)\n  4. | a: 1")
    assert charts.enumeration([]) == "No data returned." and charts.sections("QUICK SUMMARY: short\nANALYSIS: long") == ("short", "long") and charts.sections("a\n\nb") == ("a", "b")
    assert charts.about_the_engine("Help me") and not charts.about_the_engine("revenue by zone")


def test_documents_are_ingested_by_the_strategy_that_fits(spark):
    docs = {"plain": {"name": "a long enough name", "note": "words that say something"}, "deep": {"a": {"b": {"c": {"d": {"e": "some text far below"}}}}}, "rows": {"items": [{"text": f"row number {i}"} for i in range(60)]}, "none": None}
    df = spark.createDataFrame([(k, json.dumps(v) if v else None) for k, v in docs.items()], "document_id string, t string").select("document_id", F.try_parse_json("t").alias("doc"))
    got = ingested(spark, df).collect()
    by = {}
    for r in got:
        by.setdefault(r.document_id, []).append(r)
        assert r.text.startswith("In section") or r.text.startswith("At the root") and r.text_length >= 10 and r.semantic_density >= 0.1 and len(r.text_hash) == 64
    assert set(by) == {"plain", "deep", "rows"} and by["plain"][0].strategy == "flat" and by["deep"][0].strategy == "hierarchical"
    forced = ingested(spark, df, forced="dimensional").collect()
    assert {r.strategy for r in forced} == {"dimensional"} and sum(len(json.loads(r.content)) for r in forced if r.contains_arrays and r.document_id == "rows") == 60
    own = ingested(spark, df, {"mine": lambda spark, docs, nodes: flat(docs, 1)}, lambda nodes: nodes.where("level = 0").select("document_id", F.lit("mine").alias("strategy"), F.lit(0.5).alias("confidence"))).collect()
    assert {r.strategy for r in own} == {"mine"} and sum(r.document_id == "plain" for r in own) == 2
    assert ingested(spark, df.where("doc is null")).count() == 0
    chunks = spark.createDataFrame([("x", "one"), ("y", "two"), ("z", "three")], "chunk_id string, text string")
    lines = [json.loads(r.value) for r in batch_requests(chunks, "m").collect()]
    assert {x["custom_id"] for x in lines} == {"chunk_x", "chunk_y", "chunk_z"} and lines[0]["body"]["model"] == "m"
    answer_line = lambda c, code: json.dumps({"custom_id": c, "response": {"status_code": code, "body": {"data": [{"embedding": [1.0, 2.0]}]}}})
    results = spark.createDataFrame([(answer_line("chunk_x", 200),), (answer_line("chunk_x", 200),), (answer_line("chunk_y", 500),), ("{bad",)], "value string")
    assert [(r.chunk_id, r.embedding) for r in batch_results(chunks, results).collect()] == [("x", [1.0, 2.0])]
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    assert [r.chunk_id for r in search_text(vectors, "q", lambda ts: [[0.0, 2.0] for _ in ts], 1).collect()] == ["y"]
