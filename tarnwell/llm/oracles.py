"""DuckDB SQL of the operators' queries, by plain definitions: every window, every pair of sets or vectors, every string."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_RUNS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), [])"

#: Every window of every document against those of the items.
WINNOWING = rf"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select distinct item_id::varchar as item, {_WORDS} as w from benchmark),
sized as (select item, w, least(len(w), 13) as k from b where len(w) > 0),
theirs as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as g from sized, unnest(range(1, len(w) - k + 2)) as t(i)),
ours as (
  select r, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from d, (select distinct k from theirs) as sizes, unnest(range(1, len(w) - k + 2)) as t(i) where len(w) >= k),
hits as (select r, i, o.k, item from ours o join theirs t on o.k = t.k and o.g = t.g),
hit as (select r, count(distinct i + j) as n from hits, unnest(range(0, k)) as t(j) group by r),
named as (select r, list_sort(list(distinct item) filter (item is not null)) as items from hits group by r),
x as (
  select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(items, []) as items
  from d left join hit on d.r = hit.r left join named on d.r = named.r)
select doc_id, n_words, n_hit, len(items)::bigint as n_items, sha256(array_to_string(items, ',')) as items_sha256,
       n_hit > 0 and 20 * n_hit >= n_words as contaminated
from x
"""

#: Every two different sets with a shingle in common.
NEAR_DUPLICATES = rf"""
with recursive d as (select row_number() over () as r, doc_id, {_RUNS} as w from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                    else list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) end as s
  from d),
keyed as (select r, doc_id, len(s) as n, case when len(s) > 0 and doc_id is not null then md5(array_to_string(s, chr(10))) end as c, s from sets),
classes as (select c, min(doc_id) as rep, any_value(n) as n, any_value(s) as s from keyed where c is not null group by c),
shingles as (select c, n, unnest(s) as g from classes),
links as (
  select a.c as a, b.c as b from shingles a join shingles b on a.g = b.g and a.c <> b.c
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach as (select c as a, c as b from classes union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select reach.a as c, min(rep) as component from reach join classes on classes.c = reach.b group by reach.a)
select doc_id, n::bigint as n_shingles, coalesce(component, doc_id) as component_id, doc_id is null or doc_id = coalesce(component, doc_id) as kept
from keyed left join least using (c)
"""

#: Every two vectors of a label.
NEAR_VECTORS = """
with recursive e as (
  select row_number() over () as r, vec_id, label, embedding::double[] as v,
         vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
         and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok
  from embeddings),
fit as (select r, vec_id, label, v, len(v) as k, sqrt(list_inner_product(v, v)) as size from e where ok),
links as (
  select a.r as a, b.r as b from fit a join fit b on a.label = b.label and a.k = b.k and a.r <> b.r
  where list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.93),
reach as (select r as a, r as b from fit union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select reach.a as r, min(vec_id) as component from reach join fit on fit.r = reach.b group by reach.a),
degree as (select a as r, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component, vec_id) as component_id, vec_id is null or vec_id = coalesce(component, vec_id) as kept
from e left join least using (r) left join degree using (r)
"""

#: Every string of 200 bytes.
REPEATS = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
strings as (select r, i, md5(b[i:i + 199]) as g from d, unnest(range(1, octet_length(b) - 198)) as t(i) where octet_length(b) >= 200),
gone as (select r, i from (select r, i, count(*) over (partition by g) as n from strings) where n > 1),
marked as (select r, i, case when i <= lag(i) over (partition by r order by i) + 200 then 0 else 1 end as new from gone),
runs as (select r, min(i) as s, max(i) + 200 as e from (select r, i, sum(new) over (partition by r order by i) as run from marked) group by r, run),
cuts as (select r, s, e, lag(e, 1, 1) over (partition by r order by s) as before from runs),
sums as (
  select cuts.r, sum(e - s) as removed, count(*) as spans, string_agg(hex(b[before:s - 1]), '' order by s) as head, max(e) as last
  from cuts join d on d.r = cuts.r where s > 0 group by cuts.r)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
       case when removed is null then sha256(b) else sha256(unhex(head || hex(b[last:octet_length(b)]))) end as kept_sha256
from d left join sums using (r)
"""
