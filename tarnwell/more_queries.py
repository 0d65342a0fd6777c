"""More registered queries: rules, hooks and limits, JSON analysis and chunks, collections and statistics; each with DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell import star
from tarnwell.functions.chunk_text import chunk_text, content_type, semantic_density, value_types
from tarnwell.functions.ingest import ingested
from tarnwell.functions.json_analysis import analysed, content, decided, discovered, structure
from tarnwell.functions.json_chunks import dimension_value, worth_storing
from tarnwell.functions.json_strategies import flat, hierarchical, sections, semantic
from tarnwell.operators import charts, collections, store
from tarnwell.operators.vectors import collection_metadata, subtree
from tarnwell.plans.compile import FETCH_LIMIT, answer
from tarnwell.plans.model import Catalog, Dimension, Formula, Having, Intent, LatestInRange, Metric, Table
from tarnwell.plans.rules import Rule
from tarnwell.queries import AS_OF, ORACLE_SQL, QUERIES, VIEWS, P, _rounded, _sum, _table, ask, query

by_region = dict(dimensions=("region",), channels=("primary",))

# --- rules -----------------------------------------------------------------------------------------------------------
_below = Having("metric_comparison", (("revenue", "<", "target_revenue"),), "AND", "below")
ask("rule_having_adds_metrics", Intent(dimensions=("brand",), metrics=("revenue",), channels=("primary",), having=_below), f" select brand, {_sum('revenue', 'target_revenue', 'prev_revenue')}, {AS_OF} from {P} group by 1 having sum(revenue) < sum(target_revenue)", [Rule(("having", "metric_comparison", "below"), (("ensure_metrics", "revenue", "target_revenue", "prev_revenue"),), "both_negative")])
ask("rule_overrides_formula", Intent(question="ytd achievement", formulas=("target_achievement_pct",), **by_region), f" select region, round(sum(ytd_revenue) / nullif(sum(target_revenue), 0) * 100, 4) as target_achievement_pct, {AS_OF} from {P} group by 1", [Rule(("all_of", ("formula_requested", "target_achievement_pct"), ("keyword", "ytd")), (("override_formula", "target_achievement_pct", "SUM({ytd_revenue}) / NULLIF(SUM({target_revenue}), 0) * 100", "ytd_revenue", "target_revenue"),), "ytd")])
ask("rule_metric_adds_dimension", Intent(metrics=("mtd_revenue",), **by_region), f" select region, segment, {_sum('mtd_revenue', 'prev_mtd_revenue')}, {AS_OF} from {P} group by 1, 2", [Rule(("metric_present", "mtd_revenue", "prev_mtd_revenue"), (("ensure_dimensions", "segment"), ("ensure_metrics", "mtd_revenue", "prev_mtd_revenue")))])
ask("rule_dimension_creates_formula", Intent(question="gap to target", metrics=("revenue",), **by_region), f" select region, {_sum('revenue')}, round(sum(target_revenue) - sum(revenue), 4) as gap, {AS_OF} from {P} group by 1", [Rule(("all_of", ("dimension_present", "region", "nation"), ("keyword", "gap to target")), (("create_formula", "gap", "SUM({target_revenue}) - SUM({revenue})", "target_revenue", "revenue"),))])
ask("rule_sets_channel", Intent(question="bookings by segment", dimensions=("segment",), metrics=("revenue",)), " select segment, round(sum(revenue), 4) as revenue, max(order_day) as data_as_of from sales_order group by 1", [Rule(("keyword", "bookings"), (("set_channel", "secondary"),))])
ask("rule_sort_by_first_metric", Intent(question="worst brands", dimensions=("brand",), metrics=("quantity",), channels=("primary",), limit=4), f" select brand, {_sum('quantity')}, {AS_OF} from {P} group by 1 order by sum(quantity), brand limit 4", [Rule(("keyword", "worst"), (("set_sort", None, "ASC"),))])
ask("filter_of_a_level_without_dimension", Intent(metrics=("revenue", "orders_count"), filters=(("nation", "nation_2"),), channels=("secondary",)), " select round(sum(revenue), 4) as revenue, count(order_id) as orders_count, max(order_day) as data_as_of from sales_order where nation ilike '%nation_2%'")


def _asked(name: str, sql: str, intent: Intent, catalog: Catalog, frames=None, **options) -> None:
    """Register a question to a catalog of its own; results are stacked with label and channel where there are several."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = star.frames(spark, sf_dir)
        found = answer(intent, catalog, frames(tables) if frames else tables, **options)
        parts = [df if len(found) == 1 else df.withColumn("channel", F.lit(channel)) for (_, channel), df in found.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return _rounded(out)

    QUERIES[name] = run
    ORACLE_SQL[name] = "with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in VIEWS if v in sql) + sql


_cat = star.catalog()
_asked("fetch_limit_default_order", f" select brand, nation, {_sum('revenue')}, {AS_OF} from {P} group by 1, 2 order by sum(revenue) desc, brand, nation limit {FETCH_LIMIT}", Intent(dimensions=("brand", "nation"), metrics=("revenue",), channels=("primary",)), _cat, fetch_limit=FETCH_LIMIT)
_latest = Catalog(_cat.dimensions, _cat.metrics, _cat.formulas, _cat.tables, LatestInRange(("revenue",), ("sales_line",)))
_asked("snapshot_latest_in_range", " select event_type, count(event_id) as events_count, max(day) as data_as_of from events_daily where day = (select max(day) from events_daily where day between date '2024-01-05' and date '2024-01-12') group by 1", Intent(dimensions=("event_type",), metrics=("events_count",), date_range=("20240105", "20240112")), _latest)
_asked("window_grand_total", f" select region, round(sum(sum(revenue)) over (), 4) as all_revenue, {AS_OF} from {P} group by 1", Intent(formulas=("all_revenue",), **by_region), Catalog(_cat.dimensions, _cat.metrics, {"all_revenue": Formula("all_revenue", "SUM({revenue})", ("revenue",), window=True)}, {"sales_line": replace(_cat.tables["sales_line"], metrics=("all_revenue",))}, _cat.policy))
_holes = lambda tables: tables | {"events_daily": tables["events_daily"].withColumn("event_type", F.expr("case event_type when 'view' then 'N/A' when 'click' then '-' when 'error' then null else event_type end"))}
_asked("placeholders_excluded", " select event_type, count(event_id) as events_count, max(day) as data_as_of from events_daily where event_type not in ('view', 'click', 'error') and day = (select max(day) from events_daily) group by 1", Intent(dimensions=("event_type",), metrics=("events_count",)), _cat, _holes)
_two = {n: replace(t, channel="all") for n, t in _cat.tables.items() if n in ("sales_line", "events_daily")}
_both = Catalog({d: replace(_cat.dimensions[d], tables=("sales_line", "events_daily")) for d in ("region", "event_type")}, {m: replace(_cat.metrics[m], tables=("sales_line", "events_daily")) for m in ("quantity", "events_count")}, {}, _two)
_asked("stacked_without_common_keys", f" select region, null as event_type, {_sum('quantity')}, null as events_count, {AS_OF} from {P} group by 1 union all select null, event_type, null, count(event_id), max(day) from events_daily where day = (select max(day) from events_daily) group by 2", Intent(dimensions=("region", "event_type"), metrics=("quantity", "events_count")), _both)
_asked("merged_across_channels", f" select coalesce(a.region, b.region) as region, a.revenue, b.revenue as revenue_secondary, a.data_as_of, b.data_as_of as data_as_of_secondary from (select region, {_sum('revenue')}, {AS_OF} from {P} group by 1) a full join (select region, round(sum(revenue), 4) as revenue, max(order_day) as data_as_of from sales_order group by 1) b on a.region is not distinct from b.region", Intent(dimensions=("region",), metrics=("revenue",), channels=("primary", "secondary")), _cat, across_channels=True)

#: A catalog of consumer goods, by the names that its formulas use.
_GOODS = {"cymtd": "mtd_revenue", "lymtd": "prev_mtd_revenue", "tgt": "target_revenue", "ty_ytd": "ytd_revenue", "ytd_tgt": "target_revenue"}
# The formulas of that catalog.
GOODS_FORMULAS = [
    Formula("ach_pct_mtd", "SUM({cymtd}) / NULLIF(SUM({tgt}), 0) * 100", ("cymtd", "tgt")),
    Formula("mtd_gr_pct", "(SUM({cymtd}) / NULLIF(SUM({lymtd}), 0) - 1) * 100", ("cymtd", "lymtd")),
    Formula("ytd_ach_pct", "SUM({ty_ytd}) / NULLIF(SUM({ytd_tgt}), 0) * 100", ("ty_ytd", "ytd_tgt")),
    Formula("btd", "SUM({tgt}) - SUM({cymtd})", ("tgt", "cymtd")),
    Formula("crr", "SUM({cymtd}) / NULLIF({days_elapsed}, 0) * {total_days}", ("cymtd",), ("days_elapsed", "total_days")),
    Formula("rrr", "(SUM({tgt}) - SUM({cymtd})) / NULLIF({days_remaining}, 0)", ("tgt", "cymtd"), ("days_remaining",)),
]
_goods = Catalog.of([Dimension("region", "region"), Dimension("brand", "brand")], [Metric(n, c, category="cumulative") for n, c in _GOODS.items()], GOODS_FORMULAS, [Table("sales_line", date_column="ship_day", dimensions=("region", "brand"), metrics=(*_GOODS, *[f.name for f in GOODS_FORMULAS]))])
_days = {"days_elapsed": 15, "total_days": 30, "days_remaining": 15}
for _f in GOODS_FORMULAS:
    _sql = _f.template.format_map(_GOODS | {k: str(v) for k, v in _days.items()})
    _asked(f"fm_{_f.name}", f" select brand, round({_sql}, 4) as {_f.name}, {AS_OF} from {P} group by 1", Intent(dimensions=("brand",), formulas=(_f.name,)), _goods, runtime=_days)

# --- JSON documents ---------------------------------------------------------------------------------------------------
#: One document for each order, as DuckDB writes it; keys in order, numbers whole, so that both engines write the same text.
ORDER_SQL = """
with l as (select l_orderkey as id, count(*) as n, list({'part': l_partkey, 'quantity': l_quantity::bigint, 'returned': l_returnflag = 'R'} order by l_linenumber, l_partkey, l_quantity, l_returnflag = 'R') as lines,
                  string_agg('object with part ' || l_partkey || ', quantity ' || l_quantity::bigint || ', returned ' || case when l_returnflag = 'R' then 'True' else 'False' end, ', ' order by l_linenumber, l_partkey, l_quantity, l_returnflag = 'R') as said from lineitem group by 1),
     d as (select o_orderkey as document_id, n, said, c_name as name, c_mktsegment as segment, round(o_totalprice * 100)::bigint as price, o_orderstatus as status, to_json({'name': c_name, 'segment': c_mktsegment})::varchar as customer, to_json(lines)::varchar as lines,
                  to_json({'customer': {'name': c_name, 'segment': c_mktsegment}, 'id': o_orderkey, 'lines': lines, 'price': round(o_totalprice * 100)::bigint, 'status': o_orderstatus})::varchar as doc
           from orders join l on o_orderkey = l.id join customer on o_custkey = c_custkey)
"""


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id and doc (VARIANT): an order with its customer and lines."""
    line = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_returnflag") == "R").alias("returned"))
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x.dropFields("l_linenumber")).alias("lines"))  # the lines of an order
    both = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    doc = F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("customer"), F.col("o_orderkey").alias("id"), "lines", F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), F.col("o_orderstatus").alias("status"))
    return both.select(F.col("o_orderkey").alias("document_id"), F.to_variant_object(doc).alias("doc"))


@query(ORDER_SQL + " select document_id, strlen(doc) as size, 2 as max_depth, 7 + 3 * n as keys, 1::bigint as arrays, 2 + n as objects, 5 + 3 * n as leaves, round((7 + 3 * n) / (2 + n), 6) as branching, false as drill_down, case when n > 10 then 'large_array,' else '' end || case when n > 1 then 'uniform_array' else '' end as patterns, round(least(strlen(doc) / 1048576 / 10, 1) * 0.2 + 0.06 + least((7 + 3 * n) / (2 + n) / 20, 1) * 0.2 + (case when n > 1 then 1 else 0 end + case when n > 10 then 1 else 0 end) / 5 * 0.05, 6) as complexity from d")
def json_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = structure(order_documents(spark, sf_dir))
    patterns = F.concat(F.when(F.col("large_array"), "large_array,").otherwise(""), F.when(F.col("uniform_array"), "uniform_array").otherwise(""))
    return s.select("document_id", "size", "max_depth", "keys", "arrays", "objects", "leaves", F.round("branching", 6).alias("branching"), "drill_down", patterns.alias("patterns"), F.round("complexity", 6).alias("complexity"))


@query(ORDER_SQL + " select document_id, 'camelCase=' || (4 + 3 * n) || ',identifiers=1,names=1,values=1' as entity_types, 'lowercase=' || (7 + 3 * n) as key_patterns, 'configuration' as domain_type, 'count,numeric_heavy' as metric_patterns, false as temporal_data, '' as metadata_sections, 'customer,lines,price,status' as business_entities, true as configuration_data, true as analytics_data from d")
def json_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = content(order_documents(spark, sf_dir))
    listed = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias(m)
    joined = lambda a: F.array_join(a, ",").alias(a)
    return c.select("document_id", listed("entity_types"), listed("key_patterns"), "domain_type", joined("metric_patterns"), "temporal_data", joined("metadata_sections"), joined("business_entities"), "configuration_data", "analytics_data")


@query(
    ORDER_SQL
    + """, f as (select document_id, strlen(doc) as size, (7 + 3 * n)::double as k, case when n <= 4 then 1.0 else 0.2 end as fit from d),
 s as (select document_id, size, k, fit * 0.6 + (1 - least(k / 100, 1)) * 0.2 + (1 - size / 1000000) * 0.2 as flat, 0.3 * 0.4 + least(k / 100, 1) * 0.3 + 0.06 as hier, fit * 0.6 + (1 - least(k / 100, 1)) * 0.4 as a1, 0.15 + least(k / 100, 1) * 0.5 as a2, (size / 1000000 + least(k / 100, 1) + 1 / k) / 4 as a5 from f)
select document_id, 'flat' as strategy, round(flat, 6) as confidence, round(hier, 6) as hierarchical_score, 0.3::double as semantic_score, round(1 / k, 6) as dimensional_score,
       array_to_string(list_transform(list_sort([{'s': a1, 'n': 'flat'}, {'s': a2, 'n': 'hierarchical'}, {'s': 0.4, 'n': 'semantic'}, {'s': 1 / k, 'n': 'dimensional'}, {'s': a5, 'n': 'hybrid'}], 'desc')[2:3], lambda x: x.n), ',') as alternatives, true as valid, case when size < 100 then 'very small' else '' end as warnings from s"""
)
def json_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided(analysed(order_documents(spark, sf_dir)))
    six = lambda c: F.round(c, 6).alias(c)
    return d.select("document_id", "strategy", six("confidence"), six("hierarchical_score"), six("semantic_score"), six("dimensional_score"), F.array_join("alternatives", ",").alias("alternatives"), "valid", F.array_join("warnings", ",").alias("warnings"))


FLAT_SQL = (
    ORDER_SQL
    + """, c as (select document_id, name, segment, n, said, price, status, 0 as chunk, 4::bigint as key_count, '{"customer":' || customer || ',"id":' || document_id || ',"lines":' || lines || '}' as content from d
 union all select document_id, name, segment, n, said, price, status, 1, 2, '{"price":' || price || ',"status":"' || status || '"}' from d)"""
)


@query(FLAT_SQL + " select document_id, document_id || '_flat_' || chunk as chunk_id, key_count, chunk = 0 as contains_arrays, content from c")
def json_flat_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(order_documents(spark, sf_dir), 4).select("document_id", "chunk_id", "key_count", "contains_arrays", "content")


@query(
    FLAT_SQL
    + """ select document_id, chunk, case when chunk = 0 then 'In section ''orders > flat'', this structure has customer containing name ''' || name || ''', segment ''' || segment || ''', has id with value ' || document_id || ', includes lines with ' || said || '.'
 else 'In section ''orders > flat'', this structure has price with value ' || price || ', has status set to ''' || status || '''.' end as text,
 round(case when chunk = 0 then (2 + 0.5 * n) / (3 + 3 * n) else 0 end, 6) as density, 'mixed' as content_type, case when chunk = 0 then 'array,integer,object' else 'integer,string' end as value_types, chunk = 0 as stored from c"""
)
def json_chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = flat(order_documents(spark, sf_dir), 4)
    made = c.select("document_id", F.substring_index("chunk_id", "_", -1).cast("int").alias("chunk"), chunk_text(F.col("content"), F.lit("orders.flat")).alias("text"), F.round(semantic_density("content"), 6).alias("density"), content_type(F.col("content")).alias("content_type"), F.array_join(value_types(F.col("content")), ",").alias("value_types"))
    return made.withColumn("stored", worth_storing(F.col("text"), F.col("density")))


@query(ORDER_SQL + " select document_id, document_id || '_hier_0_$' as chunk_id, '$' as path, 0 as level, null::varchar as parent_id, strlen(doc) as size, 7 + 3 * n as key_count, true as contains_arrays, 'structure:entity' as tags, doc as content from d union all select document_id, document_id || '_hier_1_$.lines', '$.lines', 1, null, 0, 0, true, '', '' from d where false")
def json_hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchical(order_documents(spark, sf_dir))
    return h.select("document_id", "chunk_id", "path", "level", "parent_id", "size", "key_count", "contains_arrays", F.array_join("tags", ",").alias("tags"), "content")


@query(ORDER_SQL + " select document_id, unnest(['customer', 'lines']) as section, 'semantic_fallback' as chunk_type, unnest(['{\"customer\":' || customer || '}', '{\"lines\":' || lines || '}']) as content from d")
def json_semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic(order_documents(spark, sf_dir)).select("document_id", F.substring_index("chunk_id", "_", -1).alias("section"), "chunk_type", "content")


@query(ORDER_SQL + " select document_id, unnest(['customer', 'id', 'lines', 'price', 'status']) as section, unnest(['flat', 'flat', 'hierarchical', 'flat', 'flat']) as strategy from d")
def json_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(order_documents(spark, sf_dir)).select("document_id", "section", "strategy")


@query(" select * from (values ('camelCase', 'customer,lines,part,quantity,returned,segment,status'), ('identifiers', 'id'), ('names', 'name'), ('values', 'price')) t(key_type, keys)")
def json_discovered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovered(order_documents(spark, sf_dir)).select("key_type", F.array_join("keys", ",").alias("keys"))


#: The text of an order's only chunk, hashed.
INGEST_SQL = """ select document_id::varchar as document_id, 'flat' as strategy, 6::bigint as key_count, round((2 + 0.5 * n) / (5 + 3 * n), 6) as semantic_density, sha256('In section ''flat_chunk_0'', this structure has customer containing name ''' || name || ''', segment ''' || segment || ''', has id with value ' || document_id
 || ', includes lines with ' || said || ', has price with value ' || price || ', has status set to ''' || status || '''.') as text_hash from d"""


@query(ORDER_SQL + INGEST_SQL)
def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from documents to chunks with text and hash."""
    return ingested(spark, order_documents(spark, sf_dir)).select("document_id", "strategy", "key_count", "text_hash", F.round("semantic_density", 6).alias("semantic_density"))


# --- collections and statistics ---------------------------------------------------------------------------------------
#: Texts as stored chunks.
CHUNKS = "select doc_id as chunk_id, lang as collection_name, source as document_id, case when n_chars > 2000 then 'hierarchical' else 'flat' end as strategy, case when n_chars % 2 = 0 then 'text' else 'mixed' end as content_type, (n_chars % 10) / 10e0 as semantic_density, (n_chars % 4) / 4e0 as confidence, n_chars as text_length from documents"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CHUNKS.replace("from documents", "from {documents}"), documents=_table(spark, sf_dir, "documents"))


def _sixes(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f""" with v as ({CHUNKS}), s as (select collection_name, strategy as k, count(*) as n from v group by 1, 2), t as (select collection_name, content_type as k, count(*) as n from v group by 1, 2),
 g as (select collection_name, count(*) as total, round(avg(semantic_density), 6) as avg_density, round(avg(confidence), 6) as avg_confidence, round(avg(text_length), 6) as avg_length, min(text_length) as min_length, max(text_length) as max_length from v group by 1)
select g.*, (select string_agg(k || '=' || n, ',' order by k || '=' || n) from s where s.collection_name = g.collection_name) as strategies, (select string_agg(k || '=' || n, ',' order by k || '=' || n) from t where t.collection_name = g.collection_name) as content_types from g where collection_name is not null""")
def collection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(store.collection_stats(_chunks(spark, sf_dir)))


@query(f" with v as ({CHUNKS}) select count(*) as total, count(distinct collection_name) as collections, count(distinct document_id) as documents from v")
def namespace_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.namespace_stats(_chunks(spark, sf_dir))


@query(f" with v as ({CHUNKS}) select count(*) as chunks, count(distinct document_id) as documents, round(count(*) / count(distinct document_id), 6) as chunks_per_document, round(avg(text_length), 6) as avg_text_length, min(text_length) as min_text_length, max(text_length) as max_text_length, round(avg(semantic_density), 6) as avg_semantic_density, min(semantic_density) as min_semantic_density, max(semantic_density) as max_semantic_density from v")
def processing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sixes(store.processing_stats(_chunks(spark, sf_dir)))


#: Customers as vectors of collections: a dimension, a granularity and a quarter in the name.
NAMED = "select ['brand', 'region', 'brand_region'][c_custkey % 3 + 1] || '_' || ['mom', 'qoq'][c_custkey % 2 + 1] || '_2024010' || (c_custkey % 5 + 1) || '_20240331_vs_20240401_202406' || (10 + c_custkey % 7) as collection_name, c_mktsegment as dimension_value from customer"
_DUCK = f""" with v as ({NAMED}), m as (select collection_name, regexp_extract(collection_name, '^(.+)_(mom|qoq)_', 1) as dimension, regexp_extract(collection_name, '_(mom|qoq)_', 1) as time_granularity, regexp_extract(collection_name, '_(\\d{{8}})_\\d{{8}}_vs', 1)::int as period1_start,
 20240331 as period1_end, 20240401 as period2_start, regexp_extract(collection_name, '(\\d{{8}})$', 1)::int as period2_end, list_sort(list_distinct(list(dimension_value))) as dimension_values, count(*) as total_embeddings from v group by 1)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % n + 1).cast("int"))
    text = lambda c: c.cast("string")
    name = F.concat(at(["brand", "region", "brand_region"], 3), F.lit("_"), at(["mom", "qoq"], 2), F.lit("_2024010"), text(F.col("c_custkey") % 5 + 1), F.lit("_20240331_vs_20240401_202406"), text(F.col("c_custkey") % 7 + 10))
    return _table(spark, sf_dir, "customer").select(name.alias("collection_name"), F.col("c_mktsegment").alias("dimension_value"))


@query(_DUCK + " select dimension, time_granularity, count(*) as collections, min(total_embeddings) as least, max(total_embeddings) as most, sum(total_embeddings)::bigint as vectors from m group by 1, 2")
def metadata_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.metadata_summary(collection_metadata(_named(spark, sf_dir)))


@query(_DUCK + " select time_granularity, min(period1_start) as first_day, max(period2_end) as last_day, count(distinct dimension) as dimensions from m group by 1")
def granularity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.granularity_summary(collection_metadata(_named(spark, sf_dir)))


@query(_DUCK + " select min(period1_start) as first_day, max(period2_end) as last_day from m where dimension = 'brand'")
def dimension_date_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.date_span(collection_metadata(_named(spark, sf_dir)), "brand")


@query(_DUCK + " select collection_name, total_embeddings from m where dimension = 'brand' and time_granularity = 'mom' and (period1_start <= 20240103 and period1_end >= 20240101 or period2_start <= 20240103 and period2_end >= 20240101) and list_has_any(dimension_values, ['FURNITURE', 'NONE'])")
def collections_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collections.found(collection_metadata(_named(spark, sf_dir)), "brand", ["MOM"], 20240101, 20240103, ["FURNITURE", "NONE"])
    return found.select("collection_name", "total_embeddings")


@query(_DUCK + " select collection_name, time_granularity from m where collection_name like 'brand\\_mom\\_%' escape '\\' and period2_start <= 20240615 and period2_end >= 20240612")
def collections_found_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _named(spark, sf_dir).select("collection_name").distinct()
    return collections.found_by_name(names, "brand", ["mom"], 20240612, 20240615)


@query(_DUCK + " select distinct dimension from m")
def collections_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.available_dimensions(collection_metadata(_named(spark, sf_dir)))


@query(_DUCK + " select min(period1_start) as first_day, max(period2_end) as last_day from m")
def collections_data_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.data_period(_named(spark, sf_dir))


@query(" select c_custkey, floor((row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) - 1) / 25)::bigint + 1 as batch from customer")
def results_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return collections.batched(c, 25, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "batch")


@query(" select c_custkey, c_acctbal from customer where c_acctbal < 0")
def results_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.directed(_table(spark, sf_dir, "customer"), "Which customers show the biggest decline?", "c_acctbal", ("c_custkey",)).select("c_custkey", "c_acctbal")


_DETAIL = "'**' || c_name || ' - balance (MOM)**' || chr(10) || '- Jan 01, 2024: ₹' || c_custkey || '.50' || chr(10) || case when c_custkey % 3 = 0 then '' else '- Feb 01, 2024: ' || c_custkey * 2 || '%' || chr(10) end || '- Change: ' || case when c_custkey % 2 = 0 then '+' else '-' end || c_custkey % 100 || '.25%'"


@query(" select c_name as dimension, 'balance' as metric, 'MOM' as granularity, case when c_custkey % 3 <> 0 then 'Jan 01, 2024' end as period1_date, case when c_custkey % 3 <> 0 then c_custkey + 0.5 end::double as period1_value, case when c_custkey % 3 <> 0 then 'Feb 01, 2024' else 'Jan 01, 2024' end as period2_date, case when c_custkey % 3 <> 0 then c_custkey * 2 else c_custkey + 0.5 end::double as period2_value, (case when c_custkey % 2 = 0 then 1 else -1 end * (c_custkey % 100 + 0.25))::double as change_pct from customer")
def detail_texts_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.detail_rows(_table(spark, sf_dir, "customer").select(F.expr(_DETAIL).alias("detail")))


_CONTEXT = "'In section a period1_value with value ' || c_custkey % 3 || ', change_absolute with value ' || c_custkey % 2 || ', change_percentage with value 0.0 In section b period1_value: 5, change_percentage: 0'"


@query(f" select c_custkey, case when c_custkey % 3 = 0 and c_custkey % 2 = 1 then replace({_CONTEXT}, 'change_percentage with value 0.0', 'change_percentage with value {collections.NO_BASE}') else {_CONTEXT} end as context from customer")
def zero_base_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", collections.marked_zero_base(F.expr(_CONTEXT)).alias("context"))


@query(" select doc_id, length(text) as length from documents where text is not null and ceil(length(text) / 4) <= 500")
def chunks_within_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.within_limit(_table(spark, sf_dir, "documents"), 500).select("doc_id", F.length("text").alias("length"))


@query(" select doc_id, sha256(text) as whole, true as short from documents where text is not null")
def oversize_texts_subdivided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each text, put together again, are the text, and none is too long."""
    parts = collections.subdivided(_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), 500)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")  # the pieces of a text
    return parts.groupBy("doc_id").agg(F.sha2(whole, 256).alias("whole"), (F.max(F.length("text")) <= 2000).alias("short"))


_PATH = "'root.' || coalesce(lang, 'none') || '.' || coalesce(source, 'none') || case when n_chars % 2 = 0 then '.deep.er' else '' end"


@query(f" select doc_id, path, level from (select doc_id, {_PATH} as path, len(string_split({_PATH}, '.')) as level from documents) where starts_with(path, 'root.en') and level <= 3")
def subtree_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path")).withColumn("level", F.size(F.split("path", r"\.")).cast("long"))
    return subtree(rows, "root.en", 1)


@query(" select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment end as value from customer")
def dimension_values_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("dimension_analyses."), "c_mktsegment", F.lit(".metrics"))).otherwise(F.lit("dimension_analyses.12.metrics"))
    return _table(spark, sf_dir, "customer").select("c_custkey", dimension_value(path).alias("value"))


# --- charts -----------------------------------------------------------------------------------------------------------
@query(" select event_type, metric, round(amount, 4) as amount from (unpivot (select event_type, sum(value) as cost_val, count(value)::double as cost_vol from events group by 1) on cost_val, cost_vol into name metric value amount)")
def chart_values_and_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("cost_val"), F.count("value").cast("double").alias("cost_vol"))
    return charts.values_and_volumes_long(e).withColumn("amount", F.round("amount", 4))


@query(" select c_custkey, unnest(['Jan', 'period2_value']) as period, unnest([c_acctbal, c_acctbal * 2]) as value from customer")
def chart_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("period1_value"), (F.col("c_acctbal") * 2).alias("period2_value"), F.lit("Jan").alias("period1_date"), F.lit(None).cast("string").alias("period2_date"))
    return charts.periods_long(c)


@query(" select c_custkey, case when c_custkey % 5 = 0 then 0 else c_custkey + 0.5 end::double as amount from customer")
def chart_values_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("₹"), F.col("c_custkey").cast("string"), F.lit(".50%")))
    return charts.cleaned(_table(spark, sf_dir, "customer").select("c_custkey", amount.alias("amount")), {"amount": "quantitative"})


@query(" select 'temporal' as day, 'quantitative' as amount, 'nominal' as name")
def chart_types_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit("%")).alias("amount"), F.col("o_orderpriority").alias("name"))
    return o.agg(*[charts.inferred_type(F.col(c)).alias(c) for c in o.columns])
