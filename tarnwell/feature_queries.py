"""Registered queries of the vector index, hierarchies by grouping sets, time joins, sessions, sketches, periods, conditions and cohorts."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import star
from tarnwell.functions.ingest import batch_requests, batch_results
from tarnwell.functions.json_chunks import whole_dimensional_chunks
from tarnwell.functions.json_strategies import hybrid, semantic
from tarnwell.functions.json_configs import Configurations, domains_by_config
from tarnwell.functions.sketches import DISTINCT_ERROR, RANK_ERROR, answered, sketched
from tarnwell.operators import charts, store
from tarnwell.operators.cohorts import cohort
from tarnwell.operators.timejoins import asof_join, overlap_join
from tarnwell.operators.vector_index import VectorIndex, build, recall, search_index
from tarnwell.operators.vectors import collection_metadata, search_all
from tarnwell.more_queries import _DUCK, ORDER_SQL, _named, order_documents
from tarnwell.plans.compile import answer
from tarnwell.plans.levels import answer_levels
from tarnwell.plans.model import Intent
from tarnwell.plans.periods import framed_by_days, runtime_days, with_periods
from tarnwell.plans.predicates import parsed, where
from tarnwell.queries import AS_OF, ORACLE_SQL, PAIRS, QUERIES, VIEWS, P, _queries, _rounded, _sum, _table, query
from tarnwell.sources import manifest
from tarnwell.sources.interim import shared_dir, written
from tarnwell.sources.request_files import _opened, read_lines, write_lines
from tarnwell.streaming.sessions import session_windows

# --- vector index -----------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return build(_table(spark, sf_dir, "embeddings"), f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}", id_col="vec_id")


@query(PAIRS + " select query_id, vec_id, similarity from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rn from s) where rn <= 10")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's exact search: what the probed cells leave open is settled by the cells' radii."""
    return search_index(_index(spark, sf_dir), _queries(_table(spark, sf_dir, "embeddings")), 10, exact=True, digits=6)


@query(" select count(*) filter (vec_id % 100 = 0) as queries, count(*) filter (vec_id % 100 = 0) * 10 as neighbours, true as reached from embeddings")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate search finds 95 percent of the exact neighbours of all queries, every row indexed."""
    v = _table(spark, sf_dir, "embeddings")
    found = search_index(_index(spark, sf_dir), _queries(v), 10)
    return recall(found, search_all(v, _queries(v), 10, id_col="vec_id"), "vec_id").select("queries", "neighbours", (F.col("recall") >= 0.95).alias("reached"))


# --- hierarchies ------------------------------------------------------------------------------------------------------


def _levels(name: str, intent: Intent, sql: str, how: str = "levels") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(answer_levels(intent, star.catalog(), star.frames(spark, sf_dir), how=how))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"with {P} as ({VIEWS[P]})" + sql


def _label(*columns: str) -> str:
    """The names of the columns that a set groups by, joined; Oracle of the labels of grouping sets."""
    return f"coalesce(nullif(concat_ws('+', {', '.join(f'case when grouping({c}) = 0 then {chr(39)}{c}{chr(39)} end' for c in columns)}), ''), 'all') as label"


_primary = dict(channels=("primary",))
_levels("hierarchy_expand_dim", Intent(dimensions=("location",), metrics=("revenue",), **_primary), f" select region, nation, {_sum('revenue')}, {AS_OF}, {_label('region', 'nation')}, 'primary' as channel from {P} group by grouping sets ((region), (nation))")
_levels(
    "hierarchy_expand_filter", Intent(metrics=("revenue",), filters=(("location", "ASIA"),), **_primary),
    f" select region, cast(null as varchar) as nation, {_sum('revenue')}, {AS_OF}, 'region' as label, 'primary' as channel from {P} where region = 'ASIA' group by 1 union all select null, nation, round(sum(revenue), 4), max(ship_day), 'nation', 'primary' from {P} where nation ilike '%ASIA%' group by 2",
)
_levels(
    "hierarchy_rollup_shares", Intent(dimensions=("location", "segment"), metrics=("revenue", "orders_count"), formulas=("revenue_saliency_pct",), **_primary),
    f" select region, nation, segment, {_sum('revenue')}, count(order_id) as orders_count, round(sum(revenue) / nullif(sum(sum(revenue)) over (partition by grouping(region), grouping(nation)), 0) * 100, 4) as revenue_saliency_pct, {AS_OF}, {_label('region', 'nation', 'segment')}, 'primary' as channel from {P} group by grouping sets ((region, nation, segment), (region, segment), (segment))",
    "rollup",
)
_two_hierarchies = star.catalog()
_two_hierarchies.dimensions["product"] = star.Dimension("product", None, hierarchy="product")


def hierarchy_cube_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of the levels of two hierarchies, in one scan."""
    intent = Intent(dimensions=("location", "product"), metrics=("revenue",), filters=(("segment", "BUILDING"),), **_primary)
    return _rounded(answer_levels(intent, _two_hierarchies, star.frames(spark, sf_dir), how="cube"))


QUERIES["hierarchy_cube_of_two"] = hierarchy_cube_of_two
ORACLE_SQL["hierarchy_cube_of_two"] = f"with {P} as ({VIEWS[P]}) select region, nation, part_type, brand, {_sum('revenue')}, {AS_OF}, {_label('region', 'nation', 'part_type', 'brand')}, 'primary' as channel from {P} where segment = 'BUILDING' group by cube (region, nation, part_type, brand)"

# --- time joins -------------------------------------------------------------------------------------------------------
#: Question periods: one for each nation, from a day to three months long.
_ASKED = "select n_nationkey, date '2023-12-20' + (n_nationkey * 11)::int as asked_from, date '2023-12-20' + (n_nationkey * 11 + n_nationkey % 4 * 30)::int as asked_to from nation"


@query(
    _DUCK
    + f""", c as (select collection_name, unnest([1, 2]) as period, unnest([strptime(period1_start::varchar, '%Y%m%d')::date, strptime(period2_start::varchar, '%Y%m%d')::date]) as p_from, unnest([strptime(period1_end::varchar, '%Y%m%d')::date, strptime(period2_end::varchar, '%Y%m%d')::date]) as p_to from m), a as ({_ASKED})
select n_nationkey, collection_name, period from c join a on p_from <= asked_to and asked_from <= p_to"""
)
def collections_of_question_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of collections that overlap the periods of a table of questions."""
    day = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMMdd")
    m = collection_metadata(_named(spark, sf_dir))
    periods = m.select("collection_name", F.explode(F.array(*[F.struct(F.lit(k).alias("period"), day(f"period{k}_start").alias("p_from"), day(f"period{k}_end").alias("p_to")) for k in (1, 2)])).alias("p")).select("collection_name", "p.*")
    n = _table(spark, sf_dir, "nation")
    start = F.date_add(F.lit(date(2023, 12, 20)), (F.col("n_nationkey") * 11).cast("int"))
    asked = n.select("n_nationkey", start.alias("asked_from"), F.date_add(start, (F.col("n_nationkey") % 4 * 30).cast("int")).alias("asked_to"))
    return overlap_join(periods, asked, ("p_from", "p_to"), ("asked_from", "asked_to")).select("n_nationkey", "collection_name", "period")


@query(
    " select p_brand, count(*) as lines, round(sum(l_extendedprice), 4) as price, count(distinct p_partkey) as parts from lineitem join part on l_partkey = p_partkey and l_shipdate::date between date '1995-01-01' + (p_partkey % 2000)::int and date '1995-01-01' + (p_partkey % 2000 + p_size * 20)::int group by 1"
)
def lines_in_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that were shipped during a promotion of their part."""
    first = F.date_add(F.lit(date(1995, 1, 1)), (F.col("p_partkey") % 2000).cast("int"))
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", first.alias("from_day"), F.date_add(first, (F.col("p_size") * 20).cast("int")).alias("to_day"))
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", F.to_date("l_shipdate").alias("day"))
    found = overlap_join(lines, parts, ("day", "day"), ("from_day", "to_day"), {"l_partkey": "p_partkey"})
    return _rounded(found.groupBy("p_brand").agg(F.count("*").alias("lines"), F.sum("l_extendedprice").alias("price"), F.countDistinct("p_partkey").alias("parts")))


@query(
    """ with o as (select o_custkey, o_orderdate + interval 8340 day as since, max(o_orderkey) as order_in_force from orders group by 1, 2)
select event_id, order_in_force, since from events asof left join o on user_id = o_custkey and ts >= since"""
)
def events_with_order_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the latest order of its user up to that moment (order dates moved into the years of the events)."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderdate") + F.expr("interval 8340 days")).alias("since"), F.col("o_orderkey").alias("order_in_force"))
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return asof_join(e, o, "ts", "since", {"user_id": "o_custkey"}, ["order_in_force"]).select("event_id", "order_in_force", "since")


# --- sessions ---------------------------------------------------------------------------------------------------------
@query(
    """ with s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from events))
select user_id, min(ts) as start, max(ts) as last, count(*) as n, round(sum(value), 4) as total from s group by user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_windows(_table(spark, sf_dir, "events"), "user_id")
    return s.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "last")], "n", F.round("total", 4).alias("total"))


# --- sketches ---------------------------------------------------------------------------------------------------------


@query(" select event_type, count(*) as n, count(distinct user_id) as users, true as users_close, true as median_close from events where ts::date between date '2024-01-05' and date '2024-01-20' group by 1")
def metrics_of_stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and the median value of a period, from sketches stored by day, beside exact counts of the same rows."""
    e = _table(spark, sf_dir, "events")
    days = ("2024-01-05", "2024-01-20")
    table = written(sketched(e, F.to_date("ts"), ["event_type"], ["user_id"], ["value"]), "sketches")
    found = answered(table, ["event_type"], days)
    mine = e.where(F.to_date("ts").between(*[F.to_date(F.lit(d)) for d in days]))
    exact = mine.join(F.broadcast(found.select("event_type", "value_q50")), "event_type").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), (F.count(F.when(F.col("value") < F.col("value_q50"), 1)) / F.count("value")).alias("under"), (F.count(F.when(F.col("value") <= F.col("value_q50"), 1)) / F.count("value")).alias("up_to"),
    )
    close = F.abs(F.col("user_id_distinct") - F.col("users")) <= F.greatest(F.col("users") * DISTINCT_ERROR, F.lit(1))
    rank = (F.col("under") - RANK_ERROR <= 0.5) & (F.col("up_to") + RANK_ERROR >= 0.5)
    return found.join(exact, "event_type").select("event_type", "n", "users", close.alias("users_close"), rank.alias("median_close"))


# --- periods and frames -----------------------------------------------------------------------------------------------
_as_of = date.fromisoformat(star.AS_OF)
for _name in ("mtd_achievement_pct", "mtd_growth_pct", "ytd_achievement_pct", "ytd_growth_pct", "revenue_run_rate", "required_daily_revenue", "mtd_revenue_gap"):

    def _run(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        """A formula of periods that are made from the day and the revenue of each line, not from stored columns."""
        tables = star.frames(spark, sf_dir)
        tables["sales_line"] = with_periods(tables["sales_line"], _as_of, "ship_day", "revenue")
        (df,) = answer(Intent(dimensions=("region",), formulas=(name,), **_primary), star.catalog(), tables, runtime=runtime_days(_as_of)).values()
        return _rounded(df)

    QUERIES[f"from_dates_{_name}"] = _run
    ORACLE_SQL[f"from_dates_{_name}"] = ORACLE_SQL[f"fm_{_name}"]


@query(
    """ with d as (select event_type, ts::date as day, sum(value) as total from events group by 1, 2)
select event_type, day, round(total, 4) as total, round(sum(total) over (partition by event_type order by day range between interval 6 day preceding and current row), 4) as running, round(sum(total) over (partition by event_type order by day), 4) as to_date,
 round(lag(total) over (partition by event_type order by day), 4) as before, round(total - lag(total) over (partition by event_type order by day), 4) as change, rank() over (partition by event_type order by total desc)::int as place, ntile(4) over (partition by event_type order by total desc, day)::int as tile from d"""
)
def daily_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(framed_by_days(_table(spark, sf_dir, "events"), ["event_type"], F.to_date("ts"), "value"))


# --- conditions and cohorts -------------------------------------------------------------------------------------------
#: A condition as a front end sends it.
CONDITION = {
    "and": [
        {"or": [{"name": "region", "in": ["ASIA", "EUROPE", None]}, {"and": [{"name": "nation", "like": "%tion_1%"}, {"not": {"name": "segment", "=": "BUILDING"}}]}]},
        {"name": "quantity", "between": [5, 40]}, {"not": {"or": [{"name": "return_flag", "=": "R"}, {"name": "brand", "<": "Brand#2"}]}}, {"name": "ship_day", "between": ["1996-01-01", None]},
    ]
}


@query(
    f"with {P} as ({VIEWS[P]})"
    + f" select part_type, {_sum('revenue')}, {AS_OF} from {P} where (region in ('ASIA', 'EUROPE', null) or (nation ilike '%tion_1%' and not segment = 'BUILDING')) and quantity between 5 and 40 and not (return_flag = 'R' or brand < 'Brand#2') and ship_day >= date '1996-01-01' group by 1"
)
def conditions_as_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = star.catalog()
    tables = where({"sales_line": star.frames(spark, sf_dir)["sales_line"]}, parsed(CONDITION), catalog)
    (df,) = answer(Intent(dimensions=("part_type",), metrics=("revenue",), **_primary), catalog, tables).values()
    return _rounded(df)


def _buyers(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    return _table(spark, sf_dir, "orders").where(F.year("o_orderdate") == year).select("o_custkey")


for _kind in ("union", "intersect", "except"):

    def _run_cohort(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        """Buyers of 1996 and 1997: of either year, of both, or of the first alone."""
        return cohort(_buyers(spark, sf_dir, 1996), _buyers(spark, sf_dir, 1997), ["o_custkey"], kind)

    QUERIES[f"cohort_{_kind}"] = _run_cohort
    ORACLE_SQL[f"cohort_{_kind}"] = f" select o_custkey from orders where year(o_orderdate) = 1996 {_kind} select o_custkey from orders where year(o_orderdate) = 1997"

# --- JSON -------------------------------------------------------------------------------------------------------------
#: Each customer with all of their orders, of which ten and more are a large array.
_CUSTOMER_SQL = """
with o as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, count(*) over (partition by o_custkey) as n from orders),
     r as (select o_custkey as id, '$.orders' as path, '{"_large_array_reference":{"original_path":"$.orders","size":' || n || '}}' as text from o where n >= 10 and pos = 0
           union all select o_custkey, '$.orders[' || pos || '].' || k, case k when 'key' then o_orderkey::varchar else '"' || o_orderstatus || '"' end from o, (select unnest(['key', 'status']) as k) where n < 10
           union all select distinct o_custkey, '$.customer', o_custkey::varchar from o),
     p as (select *, floor((row_number() over (partition by id order by path) - 1) / 10)::bigint as slice from r)
select o_custkey as document_id, 'array' as kind, '$.orders' as path, floor(pos / least(100, greatest(10, floor(n / 10))))::bigint as slice, count(*) as items, '[' || string_agg('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' order by pos) || ']' as content from o where n >= 10 group by o_custkey, floor(pos / least(100, greatest(10, floor(n / 10))))
union all select id, 'remaining', null, slice, count(*), '{' || string_agg('"' || path || '": ' || text, ', ' order by path) || '}' from p group by id, slice
"""


@query(_CUSTOMER_SQL)
def json_dimensional_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of customers with their orders, sliced by the table function."""
    one = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(one)).alias("orders"))  # a customer's orders are one document
    docs = orders.select(F.col("o_custkey").alias("document_id"), F.parse_json(F.to_json(F.struct(F.col("o_custkey").alias("customer"), "orders"))).alias("doc"))
    return whole_dimensional_chunks(spark, docs, 10).withColumn("items", F.col("items").cast("long"))


#: Words of one configuration on top of another.
_WORDS = {"domain_patterns": {"sales": ["customer"], "goods": ["part"]}, "metric_patterns": {"count": "quantity|count"}}, {"domain_patterns": {"sales": ["PRICE"], "goods": ["quant"], "none": ["nowhere"]}}


@query(
    ORDER_SQL
    + """, h as (select document_id, 2 + (lower(name) like '%customer%' or lower(name) like '%price%')::int + (lower(segment) like '%customer%' or lower(segment) like '%price%')::int as sales, 2 * n + (lower(name) like '%part%' or lower(name) like '%quant%')::int + (lower(segment) like '%part%')::int as goods from d)
select document_id, case when goods > sales then 'goods' else 'sales' end as domain, greatest(goods, sales)::bigint as hits, 'sales,goods' as domains, 'count' as metrics from h"""
)
def json_domains_by_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' documents under a configuration that was merged of two."""
    known = Configurations()
    for k, words in enumerate(_WORDS):
        known.put(f"part{k}", words)
    found = domains_by_config(order_documents(spark, sf_dir), known.merge("part0", "part1"))
    return found.select("document_id", "domain", "hits", *[F.array_join(c, ",").alias(c) for c in ("domains", "metrics")])


#: A document for each customer: two objects that explain, one that comments at length, and one that tells nothing.
_FIRST, _LATER, _SAID = "'plain words about ' || lower(c_mktsegment)", "'more words about ' || lower(c_mktsegment)", "'what somebody has said at some length about all of the ' || lower(c_mktsegment)"


@query(
    f""" with c as (select c_custkey, {_FIRST} as one, {_LATER} as two, {_SAID} as said from customer)
select c_custkey as document_id, unnest([0, 1])::int as number, 'semantic' as chunk_type, unnest(['$.a', '$.b']) as path, unnest(['content_type:reasoning,keyword:explanation', 'content_type:descriptive,keyword:comment']) as tags,
 unnest(['{{"explanation":"' || one || '","node_1":{{"explanation":"' || two || '"}}}}', '{{"comment":"' || said || '"}}']) as content from c"""
)
def json_semantic_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telling objects of documents, of which related ones come together as a region."""
    inner = lambda name, text: F.struct(F.expr(text).alias(name))
    doc = F.struct(inner("explanation", _FIRST).alias("a"), inner("comment", _SAID).alias("b"), F.struct(F.col("c_custkey").alias("q")).alias("c"), inner("explanation", _LATER).alias("d"))
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.parse_json(F.to_json(doc)).alias("doc"))
    return semantic(docs).select("document_id", F.substring_index("chunk_id", "_", -1).cast("int").alias("number"), "chunk_type", "path", F.array_join("tags", ",").alias("tags"), "content")


@query(
    ORDER_SQL
    + """, s as (select document_id, n, unnest([1, 2, 3, 4, 5]) as k, unnest(['customer', 'id', 'lines', 'price', 'status']) as section, unnest(['{"customer":' || customer || '}', '{"id":' || document_id || '}', '{"lines":' || lines || '}', '{"price":' || price || '}', '{"status":"' || status || '"}']) as content,
  unnest([2, 1, 1 + 3 * n, 1, 1]) as key_count from d),
 t as (select *, case when n = 1 then 1 when k < 3 then 1 when k = 3 then 2 else 3 end as run, row_number() over (partition by document_id, case when n = 1 then 1 when k < 3 then 1 when k = 3 then 2 else 3 end order by k) - 1 as nth, strlen(content) as size from s)
select document_id::varchar as document_id, case when count(*) > 1 then document_id || '_hybrid_merged_' || run else document_id || '_lines_hier_0_$' end as chunk_id, case when count(*) > 1 then 'hybrid_merged' else 'hybrid_hierarchical' end as chunk_type, case when count(*) > 1 then 'merged_small_chunks' else '$' end as path,
 sum(size)::bigint as size, sum(key_count)::bigint as key_count, case when count(*) > 1 then '{' || string_agg('"merged_section_' || nth || '":' || content, ',' order by nth) || '}' else any_value(content) end as content from t group by document_id, run"""
)
def json_hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(order_documents(spark, sf_dir)).select("document_id", "chunk_id", "chunk_type", "path", "size", "key_count", "content")


# --- files and stores -------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """ select s_suppkey::varchar as document_id, (s_acctbal + case when s_suppkey % 5 = 0 then 1 else 0 end)::decimal(20, 2)::varchar as text, 2::bigint as runs from supplier where s_suppkey % 7 <> 0"""
)
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each supplier, ingested; then some files change and some go, and the second run brings the namespace up to date."""
    folder, log, space = _scratch(spark, "files"), _scratch(spark, "log"), f"q_{uuid.uuid4().hex}"
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(20,2)").cast("double").alias("balance"))

    def put(rows) -> None:  # the tasks write the files
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        for r in rows:
            at = f"{root}/{r['s_suppkey']}.json"
            if r["balance"] is None:
                fs.delete_file(at)
            else:
                with fs.open_output_stream(at) as f:
                    f.write(f'{{"balance": "{r["balance"]:.2f}"}}'.encode())

    def chunks(docs: DataFrame) -> DataFrame:
        return docs.select(F.col("document_id").alias("chunk_id"), "document_id", F.variant_get("doc", "$.balance", "string").alias("text"))

    store.create(spark, space)
    suppliers.foreachPartition(put)
    manifest.ingest_changes(spark, folder, log, space, chunks)
    changed = F.when(F.col("s_suppkey") % 7 != 0, F.col("balance") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0))
    suppliers.where("s_suppkey % 5 = 0 or s_suppkey % 7 = 0").withColumn("balance", changed).foreachPartition(put)
    manifest.ingest_changes(spark, folder, log, space, chunks)
    runs = manifest._log(spark, log).agg(F.max("run").alias("runs"))
    found = written(spark.table(store.table_name(space)).select("document_id", "text").crossJoin(F.broadcast(runs)), "found")  # one row of runs
    store.drop(spark, space, confirm=True)
    return found


@query(" select 'chunk_' || doc_id as custom_id, sha256(text) as input, true as within from documents where text is not null and doc_id is not null")
def batch_requests_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests in committed batch files, read again; no file has more than its lines."""
    path = _scratch(spark, "requests")
    docs = _table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select(F.col("doc_id").alias("chunk_id"), "text")
    for _ in range(2):  # the second time its batch is there already
        write_lines(batch_requests(docs, "encoder"), path, "requests", max_lines=500)
    lines = read_lines(spark, path)
    most = lines.groupBy("file").count().agg((F.max("count") <= 500).alias("within"))
    return lines.select(F.from_json("value", "custom_id string, body struct<input: string>").alias("r")).select("r.custom_id", F.sha2("r.body.input", 256).alias("input")).crossJoin(F.broadcast(most))  # one row


@query(" select doc_id as chunk_id, n_chars::double as first, doc_id::double as second from documents where doc_id is not null and doc_id % 7 <> 0")
def batch_results_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines of batch files, joined with their chunks; requests that failed have no vector."""
    path = _scratch(spark, "results")
    docs = _table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("float").alias("n"))
    body = F.struct(F.array(F.struct(F.array("n", F.col("chunk_id").cast("float")).alias("embedding"))).alias("data"))
    answer_ = F.struct(F.when(F.col("chunk_id") % 7 == 0, 500).otherwise(200).alias("status_code"), body.alias("body"))
    write_lines(docs.select(F.to_json(F.struct(F.concat(F.lit("chunk_"), F.col("chunk_id").cast("string")).alias("custom_id"), answer_.alias("response"))).alias("value")), path, max_lines=500)
    found = batch_results(docs.select("chunk_id"), read_lines(spark, path).select("value"))
    return found.select("chunk_id", *[F.element_at("embedding", k).cast("double").alias(n) for k, n in ((1, "first"), (2, "second"))])


@query(
    """ with d as (select doc_id::varchar as chunk_id, source as document_id, coalesce(lang, 'default') as collection_name, sha256(text) as h from documents where doc_id is not null),
 f as (select * from (select *, row_number() over (partition by h, document_id order by chunk_id) as rn from d) where rn = 1 or h is null or document_id is null)
select chunk_id, document_id, collection_name, case when chunk_id = '12' then 'changed' end as strategy from f where collection_name <> 'fr' and document_id is distinct from 'src5' and not (document_id is not distinct from 'src3' and collection_name = 'de')
union all select 'new' || k, 'src5', 'renewed', null from (select unnest([1, 2]) as k)"""
)
def namespace_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A namespace of all documents: inserted without repeats, parts deleted, a chunk updated, a document replaced, and all copied."""
    space, copy = f"q_{uuid.uuid4().hex}", f"c_{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents").where("doc_id is not null")
    rows = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.col("lang").alias("collection_name"), F.sha2("text", 256).alias("text_hash"))
    store.create(spark, space)
    store.insert(spark, space, rows)
    store.delete(spark, space, "fr")
    store.delete(spark, space, "de", "src3")
    store.update(spark, space, "12", strategy="changed", nothing=1)
    fresh = spark.range(1, 3).select(F.concat(F.lit("new"), F.col("id").cast("string")).alias("chunk_id"), F.lit("src5").alias("document_id"), F.lit("renewed").alias("collection_name"))
    store.replace_document(spark, space, "src5", fresh)
    store.migrate(spark, space, copy)
    found = written(spark.table(store.table_name(copy)).select("chunk_id", "document_id", "collection_name", "strategy"), "found")
    for name in (space, copy):
        store.drop(spark, name, confirm=True)
    return found


@query(" select 'o_orderstatus' as y, 'o_orderpriority' as color, 'o_totalprice' as x")
def chart_bar_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels of a bar chart over two nominal columns and a number, from one aggregate of distinct counts."""
    o = _table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    found = charts.bar_encoding(o)
    return spark.createDataFrame([(found["y"], found["color"], found["x"])], "y string, color string, x string")
