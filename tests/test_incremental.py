"""Incremental ingest of a folder, batch files with commits, encoder retries."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import store
from tarnwell.sources import manifest
from tarnwell.sources.request_files import read_lines, stream_lines, write_lines


def test_only_changes_are_read_and_stored_once(spark, tmp_path, monkeypatch):
    folder, log, space = tmp_path / "docs", f"{tmp_path}/log", "incremental_test"
    (folder / "sub").mkdir(parents=True)
    put = lambda name, value: (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
    for i in range(7):
        put(f"d{i}.json", {"n": i, "text": "x" * i * 10})
    put("sub/d0.json", {"n": 100})
    put("bad.json", "{no json")
    put("note.txt", "no document")
    store.drop(spark, space, confirm=True)
    store.create(spark, space)
    opened = []
    real = manifest.contents
    monkeypatch.setattr(manifest, "contents", lambda s, paths: (opened.append(sorted(p.rsplit("/docs/", 1)[1] for p in paths)), real(s, paths))[1])

    def chunks(docs):
        n = F.variant_get("doc", "$.n", "long")
        return docs.where("doc is not null").select(F.concat_ws("-", "document_id", n.cast("string")).alias("chunk_id"), "document_id", n.cast("string").alias("text"), F.sha2(n.cast("string"), 256).alias("text_hash"), F.when(n % 2 == 0, "even").otherwise("odd").alias("collection_name"))

    state = lambda: {r.document_id: r.text for r in spark.table(store.table_name(space)).collect()}
    run = lambda: manifest.ingest_changes(spark, str(folder), log, space, chunks, block=4)
    try:
        assert run() == {"new": 9, "changed": 0, "same": 0, "gone": 0}
        assert state() == {**{f"d{i}": str(i) for i in range(7)}, "sub/d0": "100"} and [len(o) for o in opened] == [4, 4, 1]
        sizes = [max(os.path.getsize(folder / p) for p in o) for o in opened]
        assert sizes == sorted(sizes)
        opened.clear()
        assert run() == {"new": 0, "changed": 0, "same": 0, "gone": 0} and opened == []
        time.sleep(0.01)
        put("d1.json", {"n": 11})
        put("d2.json", {"n": 2, "text": "x" * 20})  # the same bytes, another time
        put("new.json", {"n": 8})
        (folder / "d6.json").unlink()
        (folder / "sub/d0.json").unlink()
        assert run() == {"new": 1, "changed": 1, "same": 1, "gone": 2}
        assert opened == [["d1.json", "d2.json", "new.json"]]
        assert state() == {"d0": "0", "d1": "11", "d2": "2", "d3": "3", "d4": "4", "d5": "5", "new": "8"}
        assert spark.table(store.table_name(space)).count() == 7 and run() == {"new": 0, "changed": 0, "same": 0, "gone": 0}
        put("d3.json", {"n": 33})
        boom = lambda docs: chunks(docs).withColumn("text", F.assert_true(F.lit(False)).cast("string"))
        with pytest.raises(Exception):  # noqa: B017  whatever Spark raises
            manifest.ingest_changes(spark, str(folder), log, space, boom)
        assert run()["changed"] == 1 and state()["d3"] == "33" and len(state()) == 7
        manifest.compacted(spark, log, f"{tmp_path}/log2")
        same = lambda at: sorted(map(tuple, manifest.known(spark, at).collect()), key=repr)
        assert same(f"{tmp_path}/log2") == same(log)
    finally:
        store.drop(spark, space, confirm=True)


def test_batch_files_are_split_and_committed(spark, tmp_path):
    path = f"{tmp_path}/out"
    lines = spark.range(0, 1000, 1, 3).select(F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "t": "ü"}')).alias("value")).union(spark.createDataFrame([(None,)], "value string"))
    write_lines(lines, path, "first/1", max_lines=100)
    got = read_lines(spark, path)
    assert sorted(json.loads(r.value)["id"] for r in got.collect()) == list(range(1000))
    assert got.groupBy("file").count().agg(F.max("count")).first()[0] == 100 and got.select("file").distinct().count() == 12
    write_lines(lines, path, "first/1", max_lines=100)  # done before
    assert read_lines(spark, path).count() == 1000
    write_lines(lines.limit(10), path, max_bytes=40)
    assert read_lines(spark, path).count() == 1010 and {"_commits", "_staged"} <= set(os.listdir(path)) and os.listdir(f"{path}/_staged") == []
    write_lines(lines.limit(0), f"{tmp_path}/none", "x")
    assert read_lines(spark, f"{tmp_path}/none").count() == 0 and read_lines(spark, f"{tmp_path}/nowhere").count() == 0
    with pytest.raises(Exception, match="appended"):
        lines.write.format("batch_files").mode("overwrite").option("path", path).save()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    good = spark.range(100).select(F.col("id").cast("string").alias("value"))
    write_lines(good, path, "good")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        write_lines(bad, path, "bad", max_lines=5)
    assert read_lines(spark, path).count() == 100 and not [f for f in os.listdir(path) if f.endswith(".jsonl") and f not in {r.file for r in read_lines(spark, path).select("file").distinct().collect()}]
    write_lines(good, path, "bad")  # its id was not used up
    assert read_lines(spark, path).count() == 200


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/out"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").cast("string").alias("value")).write.mode("append").parquet(folder)
        stream_lines(spark.readStream.schema("value string").parquet(folder), path, f"{tmp_path}/cp", "mine", 4).awaitTermination(120)
    assert sorted(int(r.value) for r in read_lines(spark, path).collect()) == list(range(30))
    stream_lines(spark.readStream.schema("value string").parquet(folder), path, f"{tmp_path}/cp2", "mine", 4).awaitTermination(120)  # without its checkpoint the batch has the same id
    assert read_lines(spark, path).count() == 30


def test_encoders_are_asked_again_and_long_texts_left_out(spark):
    from tarnwell.operators.collections import EncoderFailed, _asked, embedded

    calls, waits = [], []

    def shaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise TimeoutError("busy")
        return [[1.0]] * len(texts)

    assert _asked(shaky, ["a", "b"], 5, waits.append) == [[1.0], [1.0]] and waits == [1.0, 2.0]
    with pytest.raises(EncoderFailed, match="1 vectors for 2 texts"):
        _asked(lambda texts: [[1.0]], ["a", "b"], 2, waits.append)
    texts = spark.createDataFrame([(1, "x" * 40), (2, "y" * 4), (3, None), (4, "z" * 400)], "i int, text string").coalesce(1)
    got = {r.i: r.embedding for r in embedded(texts, lambda ts: [[float(len(t))] for t in ts], per_request=20, per_text=50).collect()}
    assert got == {1: [40.0], 2: [4.0], 3: None, 4: None}
    alone = {r.i: r.embedding for r in embedded(texts, lambda ts: [[float(sum(map(len, ts)))] for _ in ts], per_request=20).collect()}
    assert alone == {1: [44.0], 2: [44.0], 3: None, 4: [400.0]}


def test_configurations_are_merged_checked_and_applied(spark, tmp_path):
    from tarnwell.functions.json_chunks import leaves
    from tarnwell.functions.json_configs import Configurations, checked, domains_by_config, merged

    assert merged({"a": [1], "b": {"x": [1], "y": 2}, "extends": "p", "c": 1}, {"a": [1, 2], "b": {"x": [3], "z": 4}, "c": [5]}) == {"a": [1, 1, 2], "b": {"x": [1, 3], "y": 2, "z": 4}, "c": [5]}
    bad = checked({"domain_patterns": {"d": "word", "e": []}, "metric_patterns": []})
    assert not bad.valid and len(bad.errors) == 2 and bad.warnings == ["domain e has no words"] and checked({}).warnings and checked({}).valid
    assert checked({"domain_patterns": {str(i): ["w"] for i in range(21)}}).suggestions[0].startswith("split")
    put = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    put("base.json", {"description": "b", "domain_patterns": {"shop": ["cart"]}})
    put("child.json", {"extends": "base.json", "domain_patterns": {"shop": ["order"], "web": ["url"]}})
    put("of_default.json", {"extends": "default", "domain_patterns": {"web": ["url"]}})
    put("loop.json", {"extends": "loop.json"})
    put("broken.json", "{")
    put("wrong.json", {"domain_patterns": ["x"]})
    put("orphan.json", {"extends": "nowhere.json"})
    known = Configurations()
    names, wrong = known.take_in(spark, str(tmp_path), "c_")
    assert names == ["c_base", "c_child", "c_of_default"] and set(wrong) == {"c_loop", "c_broken", "c_wrong", "c_orphan"}
    assert known.get("c_child")["domain_patterns"] == {"shop": ["cart", "order"], "web": ["url"]} and "analytics" in known.get("c_of_default")["domain_patterns"]
    both = known.merge("c_base", "c_child", into="both")
    assert both["merged_from"] == ["c_base", "c_child"] and known.get("both")["domain_patterns"]["shop"] == ["cart", "cart", "order"]
    docs = spark.createDataFrame([(1, '{"Cart": {"url": "an ORDER"}}'), (2, '{"q": 1}'), (3, "{}"), (4, None), (5, '{"url": 1, "urls": 2, "cart": 3}')], "document_id long, t string").select("document_id", F.try_parse_json("t").alias("doc"))
    got = {r.document_id: (r.domain, r.hits, list(r.domains)) for r in domains_by_config(leaves(spark, docs), known.get("c_child")).collect()}
    assert got == {1: ("shop", 2, ["shop", "web"]), 2: ("general", 0, []), 3: ("general", 0, []), 5: ("web", 2, ["shop", "web"])}
    assert {r.domain for r in domains_by_config(leaves(spark, docs), {}).collect()} == {"general"}
    known.forget()
    assert set(known.known) == {"default"}
    with pytest.raises(KeyError):
        known.get("both")


def test_deployments_and_scoped_tables(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from tarnwell.plans.deployments import deployment, scoped_frames
    from tarnwell.plans.model import Catalog, Policy, Table

    meta = tmp_path / "config/metadata"
    meta.mkdir(parents=True)
    files = {"dimensions": {"dimensions": []}, "metrics": {"metrics": []}, "formulas": {"formulas": []}, "tables": {"tables": []}, "business_rules": {"rules": []}}
    for name, value in files.items():
        (meta / f"{name}.json").write_text(json.dumps(value))
    with pytest.raises(FileNotFoundError):
        deployment(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text(json.dumps({"name": "mine", "charts": True}))
    plain = deployment(spark, str(tmp_path))
    assert plain.name == "mine" and plain.mode == "sql" and type(plain.policy) is Policy and not plain.answers("suffix") and plain.settings["charts"]
    (tmp_path / "policy.py").write_text("from tarnwell.plans.model import Policy, LatestInRange\n\nclass Mine(Policy):\n    def suffix(self, table):\n        return '_mine'\n")
    own = deployment(spark, str(tmp_path))
    assert type(own.policy).__name__ == "Mine" and own.answers("suffix") and not own.answers("date_filter") and own.metadata.catalog.policy.suffix(None) == "_mine"
    (tmp_path / "policy.py").write_text("raise ValueError('no')")
    assert type(deployment(spark, str(tmp_path)).policy) is Policy and deployment(spark, str(tmp_path)).warnings
    (tmp_path / "manifest.json").write_text(json.dumps({"mode": "embedding"}))
    assert deployment(spark, str(tmp_path)).metadata is None
    (tmp_path / "manifest.json").write_text(json.dumps({"mode": "other"}))
    with pytest.raises(ValueError):
        deployment(spark, str(tmp_path))

    def read(name):
        if name not in ("a", "z"):
            raise AnalysisException(f"no {name}")
        return spark.range(1)

    found, missing = scoped_frames(spark, Catalog.of([], [], [], [Table("a"), Table("b")]), read)
    assert set(found) == {"a"} and missing == ["b"]
    assert set(scoped_frames(spark, Catalog.of([], [], [], [Table("b")]), read, ["a", "z"])[0]) == {"a", "z"}
    spark.sql("create database scoped")
    spark.range(3).write.saveAsTable("scoped.one")
    try:
        found, missing = scoped_frames(spark, Catalog.of([], [], [], [Table("one"), Table("two")]), "scoped")
        assert found["one"].count() == 3 and missing == ["two"]
    finally:
        spark.sql("drop database scoped cascade")


def test_paths_of_a_block_are_looked_up_in_few_tasks(spark, tmp_path):
    for k in range(120):
        (tmp_path / f"f{k} [x].json").write_text(str(k))
    key, jobs = "spark.sql.sources.parallelPartitionDiscovery.parallelism", f"listing {tmp_path}"
    before = spark.conf.get(key)
    spark.sparkContext.setJobGroup(jobs, jobs)
    try:
        found = manifest.contents(spark, [f"file:{tmp_path}/f{k} [x].json" for k in range(120)])
        tracker = spark.sparkContext.statusTracker()
        tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(jobs) for s in tracker.getJobInfo(j).stageIds]
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert tasks and max(tasks) <= manifest.LISTING_TASKS and spark.conf.get(key) == before
    assert sorted(int(r.body) for r in found.select("body").collect()) == list(range(120))
