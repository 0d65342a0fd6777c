"""The registered queries of the semantic layer and the vector search, each with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell import star
from tarnwell.functions.json_chunks import leaves, positions, profile, text_hash
from tarnwell.operators.merge import average_distinct, unpivoted
from tarnwell.operators.vectors import balanced, collection_metadata, search_all
from tarnwell.plans.compile import answer
from tarnwell.plans.model import Having, Intent
from tarnwell.streaming.events import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
VIEWS = {"sales_line": star.LINE_SQL, "sales_order": star.ORDER_SQL, "events_daily": star.EVENT_SQL}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to four places, so that the order in which they were added doesn't show."""
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ask(name: str, intent: Intent, sql: str, rules=(), runtime=None) -> None:
    """Register a question; results of several labels or channels are stacked with these."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = answer(intent, star.catalog(), star.frames(spark, sf_dir), rules, runtime)
        if len(found) == 1:
            return _rounded(next(iter(found.values())))
        parts = [df.withColumns({"label": F.lit(label).cast("string"), "channel": F.lit(channel)}) for (label, channel), df in found.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return _rounded(out)

    QUERIES[name] = run
    used = [v for v in VIEWS if v in sql]
    ORACLE_SQL[name] = "with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in used) + sql


def _sum(*names: str) -> str:
    return ", ".join(f"round(sum({n}), 4) as {n}" for n in names)


AS_OF = "max(ship_day) as data_as_of"
P = "sales_line"
by_region = dict(dimensions=("region",), channels=("primary",))

ask("metric_by_dim", Intent(metrics=("revenue",), sort=("revenue", "DESC"), **by_region), f" select region, {_sum('revenue')}, {AS_OF} from {P} group by 1")
ask("metric_multi_dim", Intent(dimensions=("region", "segment"), metrics=("revenue", "cost"), channels=("primary",)), f" select region, segment, {_sum('revenue', 'cost')}, {AS_OF} from {P} group by 1, 2")
ask("avg_metric", Intent(dimensions=("brand",), metrics=("avg_quantity",)), f" select brand, round(avg(quantity), 4) as avg_quantity, {AS_OF} from {P} group by 1")
ask("count_metric", Intent(dimensions=("priority",), metrics=("orders_count",), channels=("secondary",)), " select priority, count(order_id) as orders_count, max(order_day) as data_as_of from sales_order group by 1")
ask("global_agg", Intent(metrics=("revenue", "quantity")), f" select {_sum('revenue', 'quantity')}, {AS_OF} from {P}")
ask("top_n_desc", Intent(dimensions=("nation",), metrics=("revenue",), channels=("primary",), limit=5), f" select nation, {_sum('revenue')}, {AS_OF} from {P} group by 1 order by sum(revenue) desc, nation limit 5")
ask("bottom_n_asc", Intent(dimensions=("brand",), metrics=("quantity",), channels=("primary",), sort=("quantity", "ASC"), limit=7), f" select brand, {_sum('quantity')}, {AS_OF} from {P} group by 1 order by sum(quantity), brand limit 7")
ask("filter_exact", Intent(dimensions=("segment",), metrics=("revenue",), filters=(("region", "ASIA"),), channels=("primary",)), f" select segment, {_sum('revenue')}, {AS_OF} from {P} where region = 'ASIA' group by 1")
ask("filter_substring", Intent(metrics=("revenue",), filters=(("nation", "tion_1"),), **by_region), f" select region, {_sum('revenue')}, {AS_OF} from {P} where nation ilike '%tion_1%' group by 1")
ask("filter_virtual_or", Intent(dimensions=("segment",), metrics=("revenue",), filters=(("location", "asia"),), channels=("primary",)), f" select segment, {_sum('revenue')}, {AS_OF} from {P} where region ilike '%asia%' or nation ilike '%asia%' group by 1")
ask("date_range", Intent(metrics=("revenue",), date_range=("19970101", "19971231"), **by_region), f" select region, {_sum('revenue')}, {AS_OF} from {P} where ship_day between date '1997-01-01' and date '1997-12-31' group by 1")
ask("snapshot_latest", Intent(dimensions=("event_type",), metrics=("events_count", "event_value")), " select event_type, count(event_id) as events_count, round(sum(value), 4) as event_value, max(day) as data_as_of from events_daily where day = (select max(day) from events_daily) group by 1")
ask("snapshot_with_range", Intent(dimensions=("event_type",), metrics=("events_count",), date_range=("20240105", "20240112")), " select event_type, count(event_id) as events_count, max(day) as data_as_of from events_daily where day between date '2024-01-05' and date '2024-01-12' group by 1")
for _f in star.FORMULAS:
    _c = star.catalog()
    _sql = _f.template.format_map({c: _c.metrics[c].column for c in _f.components} | {"days_elapsed": "15", "total_days": "30", "days_remaining": "15"})
    ask(f"fm_{_f.name}", Intent(dimensions=("region",), formulas=(_f.name,), channels=("primary",)), f" select region, round({_sql}, 4) as {_f.name}, {AS_OF} from {P} group by 1", runtime={"days_elapsed": 15, "total_days": 30, "days_remaining": 15})
for _how in ("and", "or"):
    _having = Having("metric_comparison", (("revenue", "<", "target_revenue"), ("quantity", "<" if _how == "and" else ">", "cost")), _how.upper())
    ask(f"having_compare_{_how}", Intent(dimensions=("brand",), metrics=("revenue", "target_revenue"), channels=("primary",), having=_having), f" select brand, {_sum('revenue', 'target_revenue')}, {AS_OF} from {P} group by 1 having sum(revenue) < sum(target_revenue) {_how} sum(quantity) {'<' if _how == 'and' else '>'} sum(cost)")
ask("having_vs_average", Intent(dimensions=("brand",), metrics=("revenue",), channels=("primary",), having=Having("vs_average", polarity="above")), f" select brand, {_sum('revenue')}, {AS_OF} from {P} group by 1 having sum(revenue) > (select avg(revenue) from {P})")
ask("gap_to_target", Intent(dimensions=("nation",), metrics=("revenue",), channels=("primary",), having=Having("gap_to_target", (("revenue", "", "target_revenue"),))), f" select nation, {_sum('revenue')}, {AS_OF} from {P} group by 1 having abs(sum(target_revenue) - sum(revenue)) > 0")
ask("rule_margin_keyword", Intent(question="profit margin by region", metrics=("revenue",), **by_region), f" select region, {_sum('revenue')}, round((sum(revenue) - sum(cost)) / nullif(sum(revenue), 0) * 100, 4) as profit_margin_pct, {AS_OF} from {P} group by 1", star.RULES)
ask("rule_category_growth", Intent(dimensions=("segment",), metrics=("mtd_revenue",)), f" select segment, {_sum('mtd_revenue')}, round((sum(mtd_revenue) / nullif(sum(prev_mtd_revenue), 0) - 1) * 100, 4) as mtd_growth_pct, {AS_OF} from {P} group by 1", star.RULES)
ask("rule_sort_first_wins", Intent(question="best nations", dimensions=("nation",), channels=("primary",), sort=("revenue", "ASC"), limit=3), f" select nation, {_sum('revenue')}, {AS_OF} from {P} group by 1 order by sum(revenue) desc, nation limit 3", star.RULES)
ask(
    "merge_full_outer_variants", Intent(dimensions=("brand",), metrics=("quantity",), channels=("variants",)),
    f" select brand, round(sum(quantity), 4) as quantity_val, round(sum(quantity), 4) as quantity_vol from {P} group by 1",
)
ask(
    "channels_side_by_side", Intent(dimensions=("region",), metrics=("revenue",), channels=("primary", "secondary")),
    f" select region, {_sum('revenue')}, {AS_OF}, cast(null as varchar) as label, 'primary' as channel from {P} group by 1 union all select region, round(sum(revenue), 4), max(order_day), null, 'secondary' from sales_order group by 1",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _queries(vectors: DataFrame) -> DataFrame:
    """The whole query set: every row whose id is divisible by 100."""
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


PAIRS = """ with s as (select q.vec_id as query_id, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as similarity
from embeddings e, embeddings q where q.vec_id % 100 = 0)"""


@query(PAIRS + " select query_id, vec_id, similarity from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rn from s) where rn <= 20")
def cosine_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return search_all(v, _queries(v), 20, id_col="vec_id", digits=6)


@query(PAIRS + " select query_id, vec_id, similarity from s where similarity >= 0.1")
def cosine_threshold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return search_all(v, _queries(v), None, 0.1, id_col="vec_id", digits=6)


@query(PAIRS + " select query_id, vec_id, label, similarity from (select *, row_number() over (partition by query_id, label order by similarity desc, vec_id) as rn from s where label in (1, 2, 3)) where rn <= 5")
def cosine_topk_per_collection_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    found = search_all(v, _queries(v), 5, filters={"label": [1, 2, 3], "unknown": 1}, by=["label"], id_col="vec_id", digits=6)
    return found.select("query_id", "vec_id", "label", "similarity")


@query(
    PAIRS
    + """,
     res as (select query_id, label as gran, vec_id as chunk_id, similarity as sim from (select *, row_number() over (partition by query_id, label order by similarity desc, vec_id) as k from s) where k <= 4),
     g as (select query_id, gran, row_number() over (partition by query_id order by count(*) desc, max(sim) desc, gran) as g from res group by query_id, gran),
     x as (select res.*, g.g, row_number() over (partition by res.query_id, res.gran order by sim desc, chunk_id) as rn from res join g using (query_id, gran))
select query_id, gran, chunk_id, sim from x where g <= 3 and rn = 1
union all select query_id, gran, chunk_id, sim from (select *, row_number() over (partition by query_id order by g, rn) as o from x where not (g <= 3 and rn = 1)) where o <= 5"""
)
def balanced_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    found = search_all(v.withColumnsRenamed({"label": "gran", "vec_id": "chunk_id"}), _queries(v), 4, by=["gran"], digits=6)
    return balanced(found.withColumnRenamed("similarity", "sim"), 8, 3, each="query_id")


for _name in ("cosine_topk", "cosine_threshold", "cosine_topk_per_collection", "balanced_topk"):
    # the search over the whole query set, under both of its names
    QUERIES[_name], ORACLE_SQL[_name] = QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"]


COLLECTION = "'brand_qoq_2024010' || (label % 3 + 1) || '_20240331_vs_20240401_20240630'"


@query(None)
def rebuilt_collection_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings").select(F.expr(COLLECTION).alias("collection_name"), F.col("label").cast("string").alias("dimension_value"))
    return collection_metadata(v).withColumn("dimension_values", F.array_join("dimension_values", ","))


ORACLE_SQL["rebuilt_collection_metadata"] = f"""
with v as (select {COLLECTION} as collection_name, label % 3 as k, cast(label as varchar) as d from embeddings)
select collection_name, 'brand' as dimension, 'qoq' as time_granularity, cast(20240101 + any_value(k) as integer) as period1_start, 20240331 as period1_end, 20240401 as period2_start,
       20240630 as period2_end, array_to_string(list_sort(list_distinct(list(d))), ',') as dimension_values, count(*) as total_embeddings from v group by 1
"""


@query(" select event_type, metric, amount from (unpivot (select event_type, round(sum(value), 4) as total_val, round(avg(value), 4) as mean_val from events group by 1) on total_val, mean_val into name metric value amount)")
def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total_val"), F.round(F.avg("value"), 4).alias("mean_val"))
    return unpivoted(e, ["event_type"], ["total_val", "mean_val"])


@query(" select round(avg(n), 6) as mean_distinct from (select count(distinct user_id) as n from events group by event_type)")
def chart_average_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_distinct(_table(spark, sf_dir, "events"), "user_id", ["event_type"]).select(F.round("mean_distinct", 6).alias("mean_distinct"))


@query(" select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(_table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(" select event_id as document_id, 1 as max_depth, cast(1 as bigint) as objects, cast(0 as bigint) as arrays, cast(len(json_keys(props)) as bigint) as leaves from events")
def json_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), F.try_parse_json("props").alias("doc"))
    return profile(leaves(spark, docs))


WHOLE_SQL = """
with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as pos, count(*) over (partition by user_id) as n from events),
     p as (select *, '$.rows[' || pos || ']' as path from e where n < 50)
select user_id as document_id, 'array' as kind, cast(floor(pos / least(100, greatest(10, floor(n / 10)))) as double) as slice, event_id from e where n >= 50
union all select user_id, 'remaining', floor((row_number() over (partition by user_id order by path) - 1) / 10), event_id from p
"""


@query(WHOLE_SQL)
def json_dimensional_chunks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of every user: in slices, or in remainder chunks by path where a user has too few for a large array."""
    e = positions(_table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), "event_id"), ["document_id"], "event_id")
    size = F.least(F.lit(100), F.greatest(F.lit(10), F.floor(F.col("total") / 10)))
    of = lambda kind, x, slice_: x.select("document_id", F.lit(kind).alias("kind"), F.floor(slice_).cast("double").alias("slice"), "event_id")
    by_path = F.row_number().over(Window.partitionBy("document_id").orderBy(F.concat(F.lit("$.rows["), F.col("pos").cast("string"), F.lit("]")))) - 1  # fewer than 50 rows
    return of("array", e.where("total >= 50"), F.col("pos") / size).union(of("remaining", e.where("total < 50"), by_path / 10))


@query(" select doc_id, sha256(text) as text_hash from documents where text is not null")
def hashed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text_hash(F.col("text")).alias("text_hash"))
