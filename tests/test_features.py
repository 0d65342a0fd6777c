"""The vector index, grouping sets, time joins, sketches, periods, frames, conditions and cohorts, against plain versions."""

import itertools
import random
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell import star
from tarnwell.functions.sketches import DISTINCT_ERROR, RANK_ERROR, answered, sketched, stored
from tarnwell.operators import timejoins, vector_index
from tarnwell.operators.cohorts import cohort, members, retention
from tarnwell.operators.timejoins import asof_join, overlap_join
from tarnwell.operators.vectors import search_all
from tarnwell.plans.levels import answer_levels, grouping_sets
from tarnwell.plans.model import Having, Intent
from tarnwell.plans.periods import framed_by_days, periods, runtime_days, with_periods
from tarnwell.plans.predicates import All, Any, Between, In, Is, Like, Missing, parsed, where


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- vector index -----------------------------------------------------------------------------------------------------


def test_index_finds_neighbours_in_the_probed_cells(spark, tmp_path):
    chance = np.random.default_rng(4)
    centres = chance.standard_normal((20, 16)) * 3
    data = [(i, (centres[i % 20] + chance.standard_normal(16)).tolist()) for i in range(1500)] + [(5000 + i, centres[0].tolist()) for i in range(300)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [1.0, 2.0]), (9004, [None] * 16), (9005, [float("nan")] * 16), (9006, [])]
    df = spark.createDataFrame(data + odd, "chunk_id long, embedding array<double>").withColumn("cell_name", F.lit("mine"))
    index = vector_index.build(df, f"{tmp_path}/i", cells=20)
    assert index.rows.count() == len(data) + len(odd) and index.rows.where("cell = -1").count() == len(odd) and index.probes < 10
    asked = df.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding").union(spark.createDataFrame([(-1, None), (-2, [0.0] * 16)], "query_id long, embedding array<double>"))
    exact = search_all(df, asked, 10)
    found = vector_index.search_index(index, asked, 10)
    (one,) = vector_index.recall(found, exact).collect()
    assert one.queries == asked.count() - 2 and one.neighbours == 10 * one.queries and one.recall >= 0.95
    near = lambda d: [(q, c, round(s, 9)) for q, c, s in rows(d.select("query_id", "chunk_id", "similarity"))]
    for again in (index, vector_index.opened(spark, f"{tmp_path}/i")):
        assert near(vector_index.search_index(again, asked, 10, probes=1, exact=True)) == near(exact)
    some = plan(index.probed([3, 4]))
    assert "PartitionFilters: [" in some and "cell" in some.split("PartitionFilters: [")[1].split("]")[0]
    inputs = lambda cells: sum(f"/cell={c}/" in f for f in index.probed(cells).inputFiles() for c in cells)
    assert inputs([3, 4]) == len(index.probed([3, 4]).select(F.input_file_name()).distinct().collect())
    none = vector_index.build(df.limit(0), f"{tmp_path}/none")
    assert vector_index.search_index(none, asked, 3).count() == 0 and vector_index.search_index(index, asked.limit(0), 3, exact=True).count() == 0


def test_calibration_holds_for_rows_that_no_centre_started_from(spark, tmp_path):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(6000, 32)))], "chunk_id long, embedding array<float>").repartition(8).cache()
    asked = df.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = vector_index.build(df, f"{tmp_path}/i", cells=256)  # as many centres as calibration rows
    (one,) = vector_index.recall(vector_index.search_index(index, asked, 10), search_all(df, asked, 10)).collect()
    assert (one.queries, one.neighbours) == (300, 3000) and one.recall >= 0.95 and index.probes < 256
    df.unpersist()


def test_asking_vectors_are_not_sent_to_the_driver(spark, tmp_path):
    chance = np.random.default_rng(5)
    df = spark.createDataFrame([(i, chance.standard_normal(8).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(50)], "chunk_id long, embedding array<double>")
    asked = df.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = vector_index.build(df, f"{tmp_path}/i", cells=6)
    first = vector_index.fitted(df, 450, steps=0)
    assert len(first) == 401 == len({tuple(c) for c in first.tolist()})
    found = vector_index._compared(index, vector_index._asked(index, asked, 2), 5, None)
    assert found.collect()
    done = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in done and "Broadcast" not in done


def test_a_query_is_sent_once_to_each_part_that_it_asks_for(spark, tmp_path, monkeypatch):
    chance = np.random.default_rng(6)
    df = spark.createDataFrame([(i, chance.standard_normal(8).tolist()) for i in range(600)], "chunk_id long, embedding array<double>").repartition(3).cache()
    asked = df.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    index = vector_index.build(df, f"{tmp_path}/i", cells=24)
    assert vector_index._asked(index, asked, 24).count() == 60  # not a row for each cell
    monkeypatch.setattr(vector_index, "PART_CELLS", 5)
    near = lambda d: [(q, c, round(s, 9)) for q, c, s in rows(d.select("query_id", "chunk_id", "similarity"))]
    assert near(vector_index.search_index(index, asked, 7, probes=2, exact=True)) == near(search_all(df, asked, 7))
    df.unpersist()


# --- hierarchies ------------------------------------------------------------------------------------------------------


def test_levels_are_read_once_and_placeholders_count_elsewhere(spark, sf_dir):
    catalog, tables = star.catalog(), star.frames(spark, sf_dir)
    intent = Intent(dimensions=("location",), metrics=("revenue",), channels=("primary",))
    assert plan(answer_levels(intent, catalog, tables)).split("== Physical Plan ==")[1].count("lineitem.parquet") == 1
    data = [("EAST", "one", 1.0), ("EAST", "N/A", 2.0), ("-", "two", 4.0), (None, None, 8.0), ("WEST", "one", 16.0)]
    frame = spark.createDataFrame(data, "region string, nation string, revenue double").withColumn("ship_day", F.lit(date(2000, 1, 1)))
    got = {(r.label, r.region, r.nation): r.revenue for r in answer_levels(intent, catalog, {"sales_line": frame}).collect()}
    assert got == {("region", "EAST", None): 3.0, ("region", "WEST", None): 16.0, ("nation", None, "one"): 17.0, ("nation", None, "two"): 4.0}
    roll = {(r.label, r.region, r.nation): r.revenue for r in answer_levels(intent, catalog, {"sales_line": frame}, how="rollup").collect()}
    assert roll == {("region+nation", "EAST", "one"): 1.0, ("region+nation", "WEST", "one"): 16.0, ("region", "EAST", None): 3.0, ("region", "WEST", None): 16.0, ("all", None, None): 31.0}
    top = answer_levels(Intent(dimensions=("location",), metrics=("revenue",), channels=("primary",), limit=1), catalog, {"sales_line": frame})
    assert {(r.label, r.revenue) for r in top.collect()} == {("region", 16.0), ("nation", 17.0)}
    assert answer_levels(intent, catalog, {"sales_line": frame.limit(0)}).count() == 0
    assert grouping_sets(intent, catalog, "cube")[0] == [("region", "nation"), ("region",), ("nation",), ()]
    two = answer_levels(Intent(dimensions=("location",), metrics=("quantity",), channels=("variants",)), catalog, tables)
    assert {"quantity_val", "quantity_vol"} <= set(two.columns)
    with pytest.raises(ValueError):
        answer_levels(Intent(dimensions=("location",), metrics=("revenue",), having=Having("vs_average")), catalog, tables)
    with pytest.raises(ValueError):
        answer_levels(intent, catalog, tables, how="pivot")


# --- time joins -------------------------------------------------------------------------------------------------------


def test_overlap_join_equals_all_pairs(spark):
    chance = random.Random(6)

    def some(n, kind):
        out = []
        for i in range(n):
            a = chance.randint(-400, 400)
            b = a + chance.choice([0, 0, 1, 5, 30, 900, 4000, -3])
            out.append((i, chance.choice(["x", "x", "x", "y", None]), None if chance.random() < 0.05 else a, None if chance.random() < 0.05 else b))
        return spark.createDataFrame(out, f"{kind}_id long, {kind}_k string, {kind}_a long, {kind}_b long"), out

    (left, lefts), (right, rights) = some(300, "l"), some(200, "r")
    fits = lambda a, b: None not in (*a[2:], *b[2:]) and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3]
    got = overlap_join(left, right, ("l_a", "l_b"), ("r_a", "r_b"))
    assert rows(got.select("l_id", "r_id")) == sorted(((a[0], b[0]) for a in lefts for b in rights if fits(a, b)), key=repr)
    keyed = overlap_join(left, right, ("l_a", "l_b"), ("r_a", "r_b"), {"l_k": "r_k"})
    assert rows(keyed.select("l_id", "r_id")) == sorted(((a[0], b[0]) for a in lefts for b in rights if fits(a, b) and a[1] == b[1] is not None), key=repr)
    assert "NestedLoop" not in plan(got) and "CartesianProduct" not in plan(got)
    point = overlap_join(left.select("l_id", "l_a"), right, ("l_a", "l_a"), ("r_a", "r_b"))
    assert rows(point.select("l_id", "r_id")) == sorted(((a[0], b[0]) for a in lefts for b in rights if fits((*a[:3], a[2]), b)), key=repr)
    assert overlap_join(left.limit(0), right, ("l_a", "l_b"), ("r_a", "r_b")).count() == 0
    days = spark.createDataFrame([(date(2024, 1, 1), date(2024, 3, 1)), (date(2024, 4, 1), date(2024, 4, 1))], "a date, b date")
    times = spark.createDataFrame([(datetime(2024, 1, 1, 12), datetime(2024, 1, 2)), (datetime(2025, 1, 1), datetime(2025, 1, 2))], "c timestamp, d timestamp")
    assert overlap_join(days, days.withColumnsRenamed({"a": "e", "b": "f"}), ("a", "b"), ("e", "f")).count() == 2 and overlap_join(times, times.withColumnsRenamed({"c": "g", "d": "h"}), ("c", "d"), ("g", "h")).count() == 2
    with pytest.raises(ValueError):
        overlap_join(days, days, ("a", "b"), ("a", "b"))


@pytest.mark.parametrize("ranges", [20, 100_000])
def test_asof_join_equals_a_plain_search(spark, monkeypatch, ranges):
    monkeypatch.setattr(timejoins, "RANGE_ROWS", ranges)
    chance = random.Random(7)
    lefts = [(i, chance.choice(["hot"] * 6 + ["b", "c", None]), None if i % 17 == 0 else chance.randint(0, 300)) for i in range(400)] + [(1, "hot", 7)]
    rights = [(i, chance.choice(["hot"] * 6 + ["b", None]), None if i % 23 == 0 else chance.randint(0, 300), chance.choice(["p", "q", None])) for i in range(300)]
    left, right = spark.createDataFrame(lefts, "l_id long, l_k string, l_t long"), spark.createDataFrame(rights, "r_id long, r_k string, r_t long, r_v string")
    got = rows(asof_join(left, right, "l_t", "r_t", {"l_k": "r_k"}, ["r_id"]))
    want = []
    for row in lefts:
        fits = [r for r in rights if row[1] is not None and row[2] is not None and r[1] == row[1] and r[2] is not None and r[2] <= row[2]]
        want.append((*row, *(max(fits, key=lambda r: (r[2], r[0])) if fits else (None,) * 4)))
    assert got == sorted(want, key=repr)
    assert asof_join(left.limit(0), right, "l_t", "r_t", {"l_k": "r_k"}, ["r_id"]).count() == 0
    alone = asof_join(left, right.limit(0), "l_t", "r_t", {"l_k": "r_k"}, ["r_id"])
    assert alone.count() == len(lefts) and alone.where("r_id is not null").count() == 0


# --- sketches ---------------------------------------------------------------------------------------------------------


def test_sketches_answer_wider_periods_within_their_bounds(spark, tmp_path):
    base = spark.range(60_000).select(
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 10).cast("int")).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("who"), F.when(F.col("id") % 11 != 0, F.col("id") * 0.5).alias("value"),
    )
    path = f"{tmp_path}/s"
    stored(sketched(base, F.col("day"), ["kind"], ["who"], ["value"]), path)
    stored(sketched(base.where("day = date '2024-01-03'"), F.col("day"), ["kind"], ["who"], ["value"]), path)  # again: it replaces its day alone
    table = spark.read.parquet(path)
    assert table.count() == 20
    for by, days in ((["kind"], None), ([], None), (["kind"], ("2024-01-02", "2024-01-05"))):
        mine = base.where(F.col("day").between(*[F.to_date(F.lit(d)) for d in days])) if days else base
        exact = {tuple(r[: len(by)]): r for r in mine.groupBy(*by).agg(F.count("*"), F.countDistinct("who"), F.sort_array(F.collect_list("value"))).collect()}
        got = answered(table, by, days, (0.1, 0.5, 0.99)).collect()
        assert len(got) == len(exact)
        for r in got:
            n, who, values = exact[tuple(r[: len(by)])][len(by) :]
            assert r.n == n and abs(r.who_distinct - who) <= DISTINCT_ERROR * who
            for q in (0.1, 0.5, 0.99):
                assert abs(np.searchsorted(values, r[f"value_q{round(100 * q)}"]) / len(values) - q) <= RANK_ERROR
    empty = sketched(base.withColumns({"who": F.lit(None).cast("long"), "value": F.lit(None).cast("double")}), F.col("day"), ["kind"], ["who"], ["value"])
    assert {(r.who_distinct, r.value_q50) for r in answered(empty, ["kind"]).collect()} == {(0, None)}
    assert answered(table.limit(0), ["kind"]).count() == 0


# --- periods and frames -----------------------------------------------------------------------------------------------


def test_periods_of_an_as_of_date(spark):
    p = periods(date(2024, 2, 29))
    assert p["mtd"] == (date(2024, 2, 1), date(2024, 2, 29)) and p["prev_mtd"] == (date(2023, 2, 1), date(2023, 2, 28)) and p["qtd"][0] == date(2024, 1, 1) and p["last_month"] == (date(2024, 1, 1), date(2024, 1, 31))
    assert periods(date(2024, 1, 1))["last_quarter"] == (date(2023, 10, 1), date(2023, 12, 31)) and periods(date(2024, 1, 1))["last_year"] == (date(2023, 1, 1), date(2023, 12, 31))
    assert runtime_days(date(2024, 2, 10)) == {"days_elapsed": 10, "total_days": 29, "days_remaining": 19} and runtime_days(date(2023, 12, 31))["days_remaining"] == 0
    df = spark.createDataFrame([(date(2024, 2, 3), 1.0), (date(2023, 2, 3), 2.0), (date(2024, 1, 3), 4.0), (None, 8.0), (date(2024, 3, 1), 16.0)], "day date, revenue double")
    made = with_periods(df, date(2024, 2, 29), "day", "revenue")({"mtd_revenue", "prev_ytd_revenue", "last_month_revenue", "revenue"})
    assert made.agg(*[F.sum(c) for c in ("mtd_revenue", "prev_ytd_revenue", "last_month_revenue", "revenue")]).first()[:] == (1.0, 2.0, 4.0, 31.0) and "ytd_revenue" not in made.columns


def test_frames_over_days(spark):
    data = [("a", date(2024, 1, d), float(v)) for d, v in ((1, 5), (1, 5), (3, 10), (8, 1), (10, 10))] + [("b", date(2024, 1, 1), 1.0), ("a", None, 100.0)]
    got = {(r.k, r.day): r for r in framed_by_days(spark.createDataFrame(data, "k string, d date, v double"), ["k"], F.col("d"), "v", tiles=2).collect()}
    one = got["a", date(2024, 1, 8)]
    assert (one.total, one.running, one.before, one.change, one.place, one.tile) == (1.0, 11.0, 10.0, -9.0, 5, 2)
    assert got["a", date(2024, 1, 10)].running == 11.0 and got["a", date(2024, 1, 3)].place == 2 and got["a", date(2024, 1, 1)].to_date == 110.0 and got["b", date(2024, 1, 1)].before is None
    assert framed_by_days(spark.createDataFrame([], "k string, d date, v double"), ["k"], F.col("d"), "v").count() == 0


# --- conditions -------------------------------------------------------------------------------------------------------


def test_conditions_have_three_values_like_sql(spark):
    values = [None, -1, 0, 1, 5]
    data = [(i, a, b, s) for i, (a, b, s) in enumerate(itertools.product(values, values, [None, "", "Abc", "b_c"]))]
    df = spark.createDataFrame(data, "i long, a long, b long, s string")
    con = duckdb.connect()
    con.sql("create table t (i bigint, a bigint, b bigint, s varchar)")
    con.executemany("insert into t values (?, ?, ?, ?)", data)
    catalog = star.Catalog()
    trees = [
        (Is("a", ">", 0), "a > 0"), (~Is("a", "=", 1), "not a = 1"), (Is("a", "<>", None), "a <> null"), (In("a", (1, None)), "a in (1, null)"), (~In("a", (1, None)), "a not in (1, null)"), (In("a", ()), "false"),
        (Between("a", 0, 1) | Is("b", "<=", 0), "a between 0 and 1 or b <= 0"), (~(Between("a", None, 0) & Like("s", "%b%")), "not (a <= 0 and s ilike '%b%')"), (Missing("s") & ~Missing("a"), "s is null and a is not null"),
        (All(()), "true"), (Any(()), "false"), (~(Is("a", "=", 1) | (Is("b", "=", 1) & ~Like("s", "a%"))), "not (a = 1 or (b = 1 and not s ilike 'a%'))"), (Between("a"), "a is not null"),
    ]
    for tree, sql in trees:
        got = where({"t": lambda wanted, tree=tree: df}, tree, catalog)["t"](None)
        assert sorted(r.i for r in got.collect()) == sorted(r[0] for r in con.sql(f"select i from t where {sql}").fetchall()), sql
    assert where({"t": df}, Is("nowhere", "=", 1), catalog) == {}
    with pytest.raises(ValueError):
        Is("a", "~", 1).column({"a": F.col("a")})
    with pytest.raises(ValueError):
        parsed({"xor": []})
    with pytest.raises(ValueError):
        where({"t": df}, Is("location", "=", "x"), star.catalog())


def test_conditions_reach_the_scan(spark, sf_dir):
    tables = where(star.frames(spark, sf_dir), parsed({"and": [{"name": "quantity", "between": [5, 40]}, {"name": "return_flag", "in": ["A", "N"]}]}), star.catalog())
    assert set(tables) == {"sales_line", "sales_line_value", "sales_line_volume"}
    spark.conf.set("spark.sql.maxMetadataStringLength", 9999)
    shown = plan(tables["sales_line"]({"revenue"}))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_quantity,5" in shown and "In(l_returnflag, [A,N])" in shown


# --- cohorts ----------------------------------------------------------------------------------------------------------


def test_cohorts_take_null_keys_as_equal(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, None)], "k long, p string")
    b = spark.createDataFrame([(None, 5), (3, 6), (1, 7)], "k long, q long")
    of = lambda kind: sorted((r.k for r in cohort(a, b, ["k"], kind).collect()), key=lambda k: (k is None, k or 0))
    assert of("union") == [1, 2, 3, None] and of("intersect") == [1, None] and of("except") == [2]
    assert cohort(a.limit(0), b, ["k"], "except").count() == 0
    assert members(a, b, ["k"]).count() == 3 and members(a, b, ["k"], inside=False).count() == 1
    assert {(r.p, r.members, r.returned) for r in retention(a, b, ["k"], "p").collect()} == {("x", 1, 1), ("y", 1, 1), (None, 1, 0)}
    with pytest.raises(ValueError):
        cohort(a, b, ["k"], "minus")


# --- sessions ---------------------------------------------------------------------------------------------------------


def test_sessions_of_a_stream_with_late_rows_and_a_restart(spark, tmp_path):
    from tarnwell.streaming.sessions import closed_sessions, session_windows

    start, chance = datetime(2024, 1, 1), random.Random(9)
    moments = sorted(chance.sample(range(4000), 400))
    events = [(i, start + timedelta(minutes=m), chance.choice([1, 2, 3]), chance.choice(["view", "click"]), float(i % 7)) for i, m in enumerate(moments)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    parts = [events[:150], events[150:300], events[300:]]
    parts[1], parts[0] = parts[1] + parts[0][140:150], parts[0][:140]  # late rows, still within the watermark
    end = [(10_000 + k, start + timedelta(days=30 + k), 99, "end", 0.0) for k in range(3)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, made in (("windows", lambda s: session_windows(s, "user_id", late="1 day")), ("state", lambda s: closed_sessions(s, "user_id", late="1 day"))):
            folder = tmp_path / name
            for k, part in enumerate([*parts, *[[e] for e in end]]):  # each run ends and the next one starts from the checkpoint
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
                stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
                q = made(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
                q.awaitTermination(300)
                assert q.exception() is None, k
            got = spark.read.parquet(f"{folder}/out").where("user_id <> 99")
            want = session_windows(spark.createDataFrame(events, schema), "user_id")
            cols = ["user_id", "start", "last", "n", "total"]
            assert rows(got.select(*cols)) == rows(want.select(*cols)), name
            if name == "state":
                types = {(r.user_id, r.start): (r.first_type, r.last_type) for r in got.collect()}
                by_time = {(e[2], e[1]): e[3] for e in events}
                assert all(types[r.user_id, r.start] == (by_time[r.user_id, r.start], by_time[r.user_id, r["last"]]) for r in want.collect())
    finally:
        spark.conf.unset(provider)


def test_equal_vectors_tie_wherever_they_stand_in_a_block():
    from tarnwell.operators.vectors import best_of

    chance = np.random.default_rng(11)
    q, one, other = (x / np.sqrt((x * x).sum()) for x in chance.standard_normal((3, 67)))
    seen = set()
    for size in (3, 17, 64, 301):
        m = np.tile(other, (size, 1))
        m[::2] = one
        p, near = best_of(q, m, m @ q + chance.uniform(-1e-15, 1e-15, size), np.arange(size), 1)
        same = m[p[0]]
        assert p.tolist() == [i for i in range(size) if (m[i] == same).all()] and len(set(near)) == 1
        seen.add(float(near[0]))
    assert len(seen) == 1


def test_a_task_holds_few_texts_while_it_cuts_them(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from tarnwell.operators import collections

    made = []

    def taken(kind):
        return lambda f: made.append(f) or (lambda c: F.array())

    class Chunks:
        def select(self, *_):
            return self

        drop = withColumnRenamed = select

    monkeypatch.setattr(collections.F, "arrow_udf", taken)
    monkeypatch.setattr(collections.F, "posexplode", lambda c: F)
    monkeypatch.setattr(collections.F, "col", lambda c: c)
    monkeypatch.setattr(collections.F, "array", lambda: F)
    monkeypatch.setattr(collections.F, "alias", lambda *_: None, raising=False)
    collections.subdivided(Chunks(), 100)
    texts = pa.array([("A sentence of words. " * 50 + str(k)) for k in range(3000)] + [None, ""])
    tracemalloc.start()
    out = made[0](texts)
    assert tracemalloc.get_traced_memory()[1] < texts.nbytes / 8  # all texts as strings take more than texts.nbytes
    tracemalloc.stop()
    assert ["".join(x) for x in out.to_pylist()[:50]] == texts.to_pylist()[:50] and out.to_pylist()[-2:] == [[None], [""]]
    assert made[0](texts[:0]).to_pylist() == [] and max(len(x) for x in out.to_pylist()[0]) <= 400
