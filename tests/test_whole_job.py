"""Operators do the whole job: every query vector, every part of a document, documents of any depth and number."""

import json

from pyspark.sql import functions as F

from tarnwell.functions import json_chunks
from tarnwell.functions.json_chunks import leaves, positions, profile, whole_dimensional_chunks
from tarnwell.operators import vectors


def test_search_all_answers_every_query(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 70)
    odd = spark.createDataFrame([(90001, None, 3), (90002, [0.0] * 64, 3), (90003, [1.0], 3), (90004, [None] * 64, 3), (90005, [1.0] * 64, None)], "vec_id long, embedding array<float>, label int")
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").union(odd)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    queries = {r.query_id: [float(x) for x in r.embedding] for r in asked.collect()}
    assert len(queries) == 5
    for by in (None, ["label"]):
        got = vectors.search_all(v, asked, 3, by=by, id_col="vec_id").collect()
        assert {r.query_id for r in got} == set(queries)
        for q, x in queries.items():
            want = sorted((r.vec_id, round(r.similarity, 9)) for r in vectors.search(v, x, 3, by=by, id_col="vec_id").collect())
            assert sorted((r.vec_id, round(r.similarity, 9)) for r in got if r.query_id == q) == want


def test_leaves_have_no_row_or_depth_cap(spark):
    deep = "1"
    for _ in range(60):
        deep = '{"a":[' + deep + "]}"
    docs = spark.createDataFrame([(1, deep), (2, '{"b":{},"c":null}'), (3, None)], "document_id long, t string").select("document_id", F.try_parse_json("t").alias("doc"))
    limit = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "20")
    try:
        got = {r.document_id: tuple(r)[1:] for r in profile(leaves(spark, docs)).collect()}
    finally:
        spark.conf.set(limit, old)
    assert got == {1: (120, 60, 60, 1), 2: (1, 2, 0, 1)}


def test_dimensional_chunks_cover_the_whole_document(spark):
    doc = {"rows": list(range(120)), "x": {"deep": [{"i": i} for i in range(50)], "few": [1, 2], "none": {}}, "name": None, "list": [[*range(60)]]}
    texts = [(1, json.dumps(doc)), (2, json.dumps({"rows": [7, 8]})), (3, json.dumps(list(range(55))))]
    docs = spark.createDataFrame(texts, "document_id long, t string").select("document_id", F.parse_json("t").alias("doc"))
    got = whole_dimensional_chunks(spark, docs).collect()
    arrays = {}
    for r in sorted((r for r in got if r.kind == "array"), key=lambda r: r.slice):
        arrays.setdefault((r.document_id, r.path), []).append(json.loads(r.content))
    assert {k: [x for part in v for x in part] for k, v in arrays.items()} == {(1, "$.rows"): doc["rows"], (1, "$.x.deep"): doc["x"]["deep"], (1, "$.list[0]"): doc["list"][0], (3, "$"): list(range(55))}
    assert [len(part) for part in arrays[1, "$.rows"]] == [12] * 10
    rest = {1: {}, 2: {}, 3: {}}
    for r in got:
        if r.kind == "remaining":
            assert r.items <= 10
            rest[r.document_id] |= json.loads(r.content)
    reference = lambda path, n: {"_large_array_reference": {"original_path": path, "size": n}}
    assert rest[1] == {"$.rows": reference("$.rows", 120), "$.x.deep": reference("$.x.deep", 50), "$.list[0]": reference("$.list[0]", 60), "$.x.few[0]": 1, "$.x.few[1]": 2, "$.x.none": {}, "$.name": None}
    assert rest[2] == {"$.rows[0]": 7, "$.rows[1]": 8} and rest[3] == {"$": reference("$", 55)}


def test_positions_without_gathering_a_group(spark, monkeypatch):
    monkeypatch.setattr(json_chunks, "RANGE_ROWS", 30)
    rows = [(u, None if i == 5 else i * 37 % 101) for u, n in ((1, 100), (2, 3), (None, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "u long, x long")
    got = sorted((tuple(r) for r in positions(df, ["u"], "x").select("u", "pos", "x", "total").collect()), key=repr)
    want = []
    for u in (1, 2, None):
        xs = sorted((x for v, x in rows if v == u), key=lambda x: (x is None, x or 0))
        want += [(u, k, x, len(xs)) for k, x in enumerate(xs)]
    assert got == sorted(want, key=repr)
