"""Rules, routing, merging, names, budgets, documents and streams on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tarnwell import star
from tarnwell.functions.formulas import sql_of
from tarnwell.functions.json_chunks import dimension_value, leaves, profile, whole_dimensional_chunks, worth_storing
from tarnwell.operators.merge import display, merge, ordered
from tarnwell.operators.vectors import balanced, budget, collection_metadata, cosine, overlapping, search, subtree
from tarnwell.plans.compile import answer, compile_table, expanded
from tarnwell.plans.model import Catalog, Dimension, Formula, Having, Intent, Metric, Policy, Table
from tarnwell.plans.routing import route
from tarnwell.plans.rules import Rule, completed, enrich, gated, holds
from tarnwell.sources.tables import export_chunks, json_documents, namespace_path, new_vectors
from tarnwell.streaming.events import append_new, windowed


def test_star_catalog_is_sound(spark, sf_dir):
    cat = star.catalog()
    assert cat.problems(star.frames(spark, sf_dir)) == []
    assert cat.canonical("ZONE") == "region" and cat.canonical("nothing") is None
    assert [d.name for d in cat.levels("geo")] == ["region", "nation"]
    bad = Catalog.of([], [Metric("m", formula="f")], [Formula("g", "SUM({x})", ("x",))], [Table("t", dimensions=("d",), metrics=("n",))])
    assert len(bad.problems()) == 4


def test_rules_triggers_and_actions():
    cat = star.catalog()
    it = Intent(question="Please STOP", metrics=("revenue",), having=Having("vs_average", polarity="below"))
    assert holds(("keyword", "top"), it, cat) and holds(("having", "vs_average", "below"), it, cat) and not holds(("having", "gap_to_target"), it, cat)
    assert holds(("metric_present", "revenue"), it, cat) and not holds(("dimension_present", "region"), it, cat)
    assert holds(("all_of", ("keyword", "stop"), ("metric_category", "absolute")), it, cat) and not holds(("formula_requested",), it, cat)
    rules = [
        Rule(("keyword", "stop"), (("ensure_metrics", "cost", "profit_margin_pct"), ("ensure_dimensions", "region"), ("create_formula", "x", "SUM({cost})", "cost"), ("output_hint", "h"), ("set_channel", "primary"), ("set_sort", "cost", "ASC")), "first"),
        Rule(("metric_present", "x"), (("override_formula", "x", "SUM({revenue})", "revenue"), ("set_sort", "revenue", "DESC")), "second"),
    ]
    out, over = enrich(it, rules, cat)
    assert out.metrics == ("revenue", "cost") and out.formulas == ("profit_margin_pct", "x") and out.sort == ("cost", "ASC") and out.display == ("revenue",)
    assert over.formulas["x"].template == "SUM({revenue})" and "x" not in cat.formulas and out.hint.format == "h" and out.applied_rules == ("first", "second") and out.channels == ("primary",)
    moved, _ = enrich(Intent(formulas=("revenue",)), [], cat)
    assert moved.metrics == ("revenue",) and moved.formulas == ()
    done = completed(Intent(limit=3), cat)
    assert done.metrics == ("revenue",) and done.sort == ("revenue", "DESC")


def test_routing_narrows_but_never_to_nothing():
    cat = star.catalog()
    assert route(Intent(metrics=("revenue",)), cat) == ["sales_line"]
    assert route(Intent(dimensions=("region",), metrics=("quantity",), channels=("variants",)), cat) == ["sales_line_value", "sales_line_volume"]
    assert route(Intent(dimensions=("brand",), metrics=("cost",), channels=("events",)), cat) == ["sales_line"]
    assert route(Intent(dimensions=("brand",), metrics=("quantity",), variant="volume"), cat) == ["sales_line_volume"]
    assert route(Intent(dimensions=("event_type",), metrics=("cost",)), cat) == []  # no table in common
    assert route(Intent(), Catalog.of([], [], [], cat.tables.values())) == list(cat.tables)  # nothing declared


def test_set_sort_without_a_metric_leaves_the_default():
    cat = star.catalog()
    out, _ = enrich(Intent(question="best", limit=3), [Rule(("keyword", "best"), (("set_sort",),))], Catalog(cat.dimensions, cat.metrics, cat.formulas, cat.tables))
    assert out.sort is None
    by_first, _ = enrich(Intent(question="best", metrics=("cost",)), [Rule(("keyword", "best"), (("set_sort", None, "ASC"),))], cat)
    assert by_first.sort == ("cost", "ASC")
    assert gated("q", lambda q: Intent(confidence=0.9), lambda i: "answer", lambda q: "fallback") == "answer"
    assert gated("q", lambda q: Intent(confidence=0.6), lambda i: "answer", lambda q: "fallback") == "fallback"
    assert gated("q", lambda q: 1 / 0, lambda i: "answer", lambda q: "fallback") == "fallback"


def test_formula_templates_hold_arithmetic_only():
    cat = star.catalog()
    assert "15" in sql_of(cat.formulas["revenue_run_rate"], cat, {"days_elapsed": 15})
    assert sql_of(Formula("f", "SUM({nothing})"), cat) is None
    assert sql_of(Formula("f", "SUM({cost})", ("cost",), window=True), cat).endswith("OVER ()")
    with pytest.raises(ValueError):
        sql_of(Formula("f", "(select 1 from t)"), cat)


CAT = Catalog.of([Dimension("d", "d", tables=("t",)), Dimension("n", "n", tables=("t",), keep_placeholders=True)], [Metric("x", "x", tables=("t",)), Metric("y", "y", tables=("t",))], [], [Table("t", dimensions=("d", "n"), metrics=("x", "y"), date_column="day", date_mode="snapshot")], Policy(("x",)))


def test_placeholders_dates_and_empty_tables(spark):
    rows = [("a", 1, 1.0, 2.0, dt.date(2024, 1, 1)), ("N/A", 1, 5.0, 1.0, dt.date(2024, 1, 2)), (None, 2, 7.0, 1.0, dt.date(2024, 1, 2)), ("it's", None, 3.0, None, dt.date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "d string, n int, x double, y double, day date")
    t = CAT.tables["t"]
    ask = lambda **k: sorted(map(tuple, compile_table(Intent(**k), t, df, CAT).drop("data_as_of").collect()), key=repr)
    assert ask(dimensions=("d",), metrics=("x",)) == [("it's", 3.0)]
    assert ask(dimensions=("d",), metrics=("x",), date_range=("20240101", "20240102")) == sorted([("a", 1.0), ("it's", 3.0)], key=repr)
    assert ask(dimensions=("n",), metrics=("x",)) == [(1, 5.0), (2, 7.0)]
    assert ask(metrics=("x",), filters=(("d", "it's"),)) == [(3.0,)]
    assert compile_table(Intent(metrics=("z",)), t, df, CAT) is None and compile_table(Intent(dimensions=("z",), metrics=("x",)), t, df, CAT) is None
    assert compile_table(Intent(metrics=("x",)), t, df.limit(0), CAT).collect()[0][0] is None
    top = compile_table(Intent(dimensions=("n",), metrics=("x",), sort=("x", "ASC"), date_range=("20240101", "20240102")), t, df, CAT, fetch_limit=1)
    assert [r.n for r in top.collect()] == [1]
    gap = Having("gap_to_target", (("x", "", "y"),))
    near = compile_table(Intent(dimensions=("n",), metrics=("x",), having=gap, date_range=("20240101", "20240102")), t, df, CAT)
    assert [r.n for r in near.collect()] == [1, 2]  # a gap of 3 before one of 6
    assert ask(dimensions=("n",), metrics=("x",), having=gap) == [(1, 5.0), (2, 7.0)]


def test_virtual_dimensions_expand_to_levels():
    cat = star.catalog()
    assert [i.label for i in expanded(Intent(dimensions=("location",)), cat)] == ["region", "nation"]
    found = expanded(Intent(filters=(("location", "x"), ("segment", "y"))), cat)
    assert [i.filters for i in found] == [(("segment", "y"), ("region", "x")), (("segment", "y"), ("nation", "x"))]


def test_merge_matches_null_keys_and_renames(spark):
    a = spark.createDataFrame([("p", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([(None, 3), ("q", 4)], "k string, v int")
    c = spark.createDataFrame([("p", 5)], "k string, v int")
    out = merge([("one", a), ("two", b), ("two", c)], {"k"})
    assert out.columns == ["k", "v", "v_two", "v_two_2"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("p", 1, None, 5), (None, 2, 3, None), ("q", None, 4, None)], key=repr)
    stacked = merge([("one", a), ("two", spark.createDataFrame([(9,)], "w int"))], {"k"})
    assert stacked.count() == 3 and stacked.columns == ["k", "v", "w"]
    assert [r.k for r in ordered(out, ("v", "DESC"), None, ["k"]).collect()] == ["q", None, "p"]
    wide = spark.createDataFrame([("p", 1, 2, 3, 4)], "k string, b_vol int, a_val int, b_val int, data_as_of int")
    assert display(wide, {"k"}, ("b", "a")).columns == ["k", "b_val", "b_vol", "a_val"]


def test_answer_merges_channels_and_labels(spark, sf_dir):
    got = answer(Intent(dimensions=("location",), metrics=("revenue",), limit=2), star.catalog(), star.frames(spark, sf_dir))
    assert set(got) == {("region", "primary"), ("region", "secondary"), ("region", "variants"), ("nation", "primary"), ("nation", "secondary"), ("nation", "variants")}
    assert all(df.count() == 2 for df in got.values())


def test_vectors_and_collections(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, [1.0])], "chunk_id long, embedding array<float>")
    got = {r.chunk_id: r.similarity for r in search(df, [2.0, 0.0], None, -1.0).collect()}
    assert got[1] == 1.0 and abs(got[4] - 0.5**0.5) < 1e-9 and set(got) == {1, 4}
    assert df.select(cosine(F.col("embedding"), [0.0, 0.0]).alias("c")).where("c is not null").count() == 0
    names = ["brand_qoq_20250601_20250831_vs_20250901_20251130", "a_b_wow_20250101_20250107_vs_20250108_20250114_date_x", "mom_20250101_20250131_vs_20250201_20250228", "odd"]
    rows = [(n, v) for n in names for v in ("x", "", None, "y", "x")]
    meta = collection_metadata(spark.createDataFrame(rows, "collection_name string, dimension_value string"))
    by = {r.collection_name: r for r in meta.collect()}
    assert by[names[0]].dimension == "brand" and by[names[0]].period2_end == 20251130 and by[names[0]].dimension_values == ["x", "y"] and by[names[0]].total_embeddings == 5
    assert by[names[1]].dimension == "a_b" and by[names[2]].dimension == "overall" and by["odd"].time_granularity is None
    assert {r.collection_name for r in overlapping(meta, 20250110, 20250120).collect()} == {names[1], names[2]}
    many = {"a": ["a1", "a2", "a3", "a4", "a5"], "b": ["b1"], "c": ["c1", "c2", "c3", "c4", "c5"]}
    assert budget(many, 7) == {"a": ["a2", "a3", "a4", "a5"], "b": ["b1"], "c": ["c4", "c5"]}
    assert budget(many, 2) == {"a": ["a5"], "b": ["b1"]} and budget(many, 11) == many and budget({}, 3) == {}
    flat = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.8)], "gran string, chunk_id long, sim double")
    assert [r.chunk_id for r in balanced(flat, 1, 3).collect()] == [1]
    chunks = spark.createDataFrame([("$.a", 1), ("$.a.b", 2), ("$.c", 1)], "path string, level int")
    assert [r.path for r in subtree(chunks, "$.a", 1).collect()] == ["$.a", "$.a.b"]


def test_json_documents(spark, tmp_path):
    doc = {"a": {"b": [1, {"c": None}], "d": True}, "rows": [{"i": i} for i in range(120)], "e'\"x": "text"}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{no json")
    docs = json_documents(spark, str(tmp_path))
    assert {r.document_id: r.ok for r in docs.select("document_id", F.col("doc").isNotNull().alias("ok")).collect()} == {"one": True, "bad": False}
    nodes = leaves(spark, docs)
    paths = {r.path for r in nodes.select("path").collect()}
    assert {"$", "$.a.b[0]", "$.a.b[1].c", "$.rows[119].i"} <= paths
    p = profile(nodes).first()
    assert (p.max_depth, p.arrays, p.objects, p.leaves) == (4, 2, 123, 124)
    slices = whole_dimensional_chunks(spark, docs).where("kind = 'array'").collect()
    assert sorted(s["items"] for s in slices) == [12] * 10 and sorted(x["i"] for s in slices for x in json.loads(s.content)) == list(range(120))
    v = spark.createDataFrame([("$.dimension_analyses.BRAND.x",), ("$.dimension_analyses.12",), ("$.y",)], "path string")
    assert [r[0] for r in v.select(dimension_value(F.col("path"))).collect()] == ["BRAND", None, None]
    t = spark.createDataFrame([("long enough text", 0.5), ("short", 0.5), ("long enough text", 0.0), (None, 1.0)], "t string, d double")
    assert t.where(worth_storing(F.col("t"), F.col("d"))).count() == 1


def test_sinks_and_streams(spark, sf_dir, tmp_path):
    stored = spark.createDataFrame([("c1", "h1", "d1")], "chunk_id string, text_hash string, document_id string")
    new = spark.createDataFrame([("c1", "h9", "d1"), ("c2", "h1", "d1"), ("c3", "h2", "d1"), ("c3", "h2", "d1")], stored.schema)
    assert [r.chunk_id for r in new_vectors(new, stored).collect()] == ["c3"]
    odd = spark.createDataFrame([("n1", None, "d1"), ("n2", None, "d1"), ("m2", "h5", "d2"), ("m1", "h5", "d2")], stored.schema)
    assert {r.chunk_id for r in new_vectors(odd, stored).collect()} == {"n1", "n2", "m1"}
    export_chunks(new, f"{tmp_path}/j", "jsonl")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    with pytest.raises(ValueError):
        export_chunks(new, f"{tmp_path}/x", "xml")
    with pytest.raises(ValueError):
        namespace_path("/r", "Temp-1")
    assert namespace_path("/r", "a_1") == "/r/embeddings_a_1"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    twice = events.union(events)
    twice.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    append_new(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "event_id", "ts", "40 days").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()
    assert windowed(events).agg(F.sum("n")).first()[0] == events.count()
