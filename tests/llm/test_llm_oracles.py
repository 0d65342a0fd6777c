"""Registered operators against their SQL in DuckDB, on the driver's tables and on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwell.llm.queries import ORACLE_SQL, QUERIES

NAMES = ("op2_winnowing", "op5_minhash_near_dups", "op9_hnsw_near_dups", "op10_suffix_repeats")
TABLES = ("documents", "benchmark", "embeddings")


def check(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from read_parquet('{folder}/{t}.parquet{'/*.parquet' if str(folder).startswith('/tmp') else ''}')")
    want = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, str(folder))
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_operator_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, name)


@pytest.fixture(scope="module")
def odd(spark, sf_dir, docs, tmp_path_factory):
    """The small tables with null, empty and repeated rows, and short, repeated and unnamed items; DuckDB copies a text for each of its windows, so very long texts have tests of their own."""
    folder = tmp_path_factory.mktemp("odd")
    docs.where("text is null or length(text) < 50000").write.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    more = spark.createDataFrame([(9001, "quick brown fox"), (9001, "wizards box"), (9002, None), (9003, " "), (None, "the lazy dog")], "item_id long, text string")
    items.select("item_id", "text").union(more).write.parquet(f"{folder}/benchmark.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label"))
    v = [float(k % 7) for k in range(64)]
    extra = [(90001, v, 3), (90002, v, 3), (90002, v, 3), (90003, v, None), (90004, None, 3), (90005, [], 3), (90006, [0.0] * 64, 3), (90007, [None, *v[1:]], 3), (90008, [float("nan"), *v[1:]], 3), (None, v, 3)]
    vectors.union(spark.createDataFrame(extra, "vec_id long, embedding array<float>, label int")).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_operator_equals_sql_on_odd_rows(spark, odd, name):
    check(spark, odd, name)
