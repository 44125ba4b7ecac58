"""Queries of the metric groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import graph as G
from ..operators import keys as H
from ..operators import metrics as M
from ..operators import reports as R
from .base import query, r6

query("entity_set", "select kg, entity from ents")(lambda p: p.entities())
query("degrees", "select * from deg")(lambda p: p.degrees())
query("basic_stats", f"""
select kg, n_entities, n_relations, n_attributes, n_literals, n_rel_triples, n_attr_triples, {r6("n_attr_triples / n_rel_triples")} as attr_to_rel_ratio, {r6("n_rel_triples / n_entities")} as rel_triples_per_entity, {r6("n_attr_triples / n_entities")} as attr_triples_per_entity
from (select kg, count(*) as n_entities from ents group by kg) join (select kg, count(*) as n_rel_triples, count(distinct relation) as n_relations from rel group by kg) using (kg)
join (select kg, count(*) as n_attr_triples, count(distinct attribute) as n_attributes, count(distinct literal) as n_literals from attr group by kg) using (kg)""")(M.basic)
query("basic_pair", f"""
select (select count(*) from gold) as n_alignments, {r6("(select count(*) from gold) / (select min(n) from (select count(*) as n from ents group by kg))")} as alignment_ratio, (select count(*) from ents) as n_entities_total,
  (select count(*) from rel) + (select count(*) from attr) as n_triples_total, (select {r6("(max(n) - min(n)) / max(n)")} from (select count(*) as n from rel group by kg)) as size_asymmetry""")(M.basic_pair)

_KIND = "(select kg, 'in' as kind, in_degree as x from deg union all select kg, 'out', out_degree from deg union all select kg, 'total', total_degree from deg)"


@query("degree_summary", f"""select kg, kind, count(*) as n, {r6("avg(x)")} as mean, {r6("quantile_cont(x, 0.5)")} as median, {r6("stddev_pop(x)")} as std, min(x)::double as min, max(x)::double as max from {_KIND} group by kg, kind""")
def degree_summary(p):
    return S.describe(M.degree_kinds(p), ["kg", "kind"], "degree").select("kg", "kind", "n", "mean", "median", "std", "min", "max")


@query("degree_quantiles", f"""select kg, kind, {", ".join(r6(f"quantile_cont(x, {q / 100})") + f" as p{q}" for q in (25, 75, 95, 99))} from {_KIND} group by kg, kind""")
def degree_quantiles(p):
    return S.describe(M.degree_kinds(p), ["kg", "kind"], "degree").select("kg", "kind", "p25", "p75", "p95", "p99")


@query("degree_moments", f"""select kg, kind, round(skewness(x), 4) as skew, round(kurtosis(x), 3) as kurtosis from {_KIND} group by kg, kind""")
def degree_moments(p):
    return S.describe(M.degree_kinds(p), ["kg", "kind"], "degree").select("kg", "kind", F.round("skew", 4).alias("skew"), F.round("kurtosis", 3).alias("kurtosis"))


@query("degree_gini", f"""select kg, kind, {r6("greatest(0, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*))")} as gini from (select kg, kind, x::double as x, row_number() over (partition by kg, kind order by x) as i from {_KIND}) group by kg, kind""")
def degree_gini(p):
    return S.describe(M.degree_kinds(p), ["kg", "kind"], "degree").select("kg", "kind", "gini")


query("degree_powerlaw", f"""select kg, case when count(*) >= 50 then {r6("1 + count(*) / sum(ln(total_degree / 0.5))")} end as alpha, 1.0::double as xmin from deg where total_degree >= 1 group by kg""")(lambda p: S.powerlaw(p.degrees(), ["kg"], "total_degree"))
query("degree_shares", f"""select kg, {r6("avg((total_degree <= 0)::int)")} as share_isolated, {r6("avg((total_degree <= 2)::int)")} as share_deg_le_2, {r6("avg((total_degree <= 5)::int)")} as share_deg_le_5 from deg group by kg""")(M.degree_shares)
query("degree_histogram", """
, top as (select kg, greatest(max(total_degree), 2)::double as t from deg group by kg),
points as (select distinct kg, round_even(pow(10, log10(t) * i / 19), 0) as e from top, range(20) r(i)),
edges as (select kg, e as lo, coalesce(lead(e) over (partition by kg order by e), e + 1) as hi, lead(e) over (partition by kg order by e) is null as last from points)
select kg, 0.0::double as bin_lower, 0.0::double as bin_upper, count(*) as count from deg where total_degree = 0 group by kg
union all select d.kg, lo::double, hi::double, count(*) from deg d join edges e on d.kg = e.kg and total_degree >= lo and (total_degree < hi or last and total_degree = hi) where total_degree > 0 group by d.kg, lo, hi""")(lambda p: S.log_histogram(p.degrees(), ["kg"], "total_degree"))

_COUNTS = "(select kg, 'rel' as kind, relation as property, count(*) as n from rel group by all union all select kg, 'attr', attribute, count(*) from attr group by all)"
query("property_counts", f"""select kg, kind, property, n, {r6("n / sum(n) over (partition by kg, kind)")} as share from {_COUNTS}""")(M.property_counts)
query("property_entropy", f"""select kg, kind, {r6("-sum(p * log2(p))")} as entropy, {r6("case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 0 end")} as entropy_norm from (select kg, kind, n / sum(n) over (partition by kg, kind) as p from {_COUNTS}) group by kg, kind""")(lambda p: S.entropies(M.property_counts(p), ["kg", "kind"]))
query("property_top10", f"""select kg, kind, {r6("sum(n) filter (r <= 10) / sum(n)")} as top_share from (select *, row_number() over (partition by kg, kind order by n desc) as r from {_COUNTS}) group by kg, kind""")(lambda p: S.concentration(M.property_counts(p), ["kg", "kind"]))
query("property_long_tail", f"""select kg, kind, {r6("avg((100 * n < t)::int)")} as long_tail_share from (select *, sum(n) over (partition by kg, kind) as t from {_COUNTS}) group by kg, kind""")(lambda p: S.long_tail_share(M.property_counts(p), ["kg", "kind"]))
query("property_distribution", f"""
select kg, kind, count(*) as n_properties, {r6("sum(n) filter (r <= 10) / sum(n)")} as top_share, {r6("avg((100 * n < t)::int)")} as long_tail_share, {r6("-sum(n / t * log2(n / t))")} as entropy, {r6("case when count(*) > 1 then -sum(n / t * log2(n / t)) / log2(count(*)) else 0 end")} as entropy_norm
from (select *, sum(n) over (partition by kg, kind) as t, row_number() over (partition by kg, kind order by n desc) as r from {_COUNTS}) group by kg, kind""")(M.property_distribution)
query("long_tail_curve", f"""select kg, k::bigint as k, {r6("avg((total_degree <= k)::int)")} as share_le_k from deg, (select unnest([0, 1, 2, 3, 5, 10, 20, 50]) as k) group by kg, k""")(M.long_tail)
query("facts_per_entity", f"""select kg, {r6("avg(d + a)")} as mean_facts_per_entity, {r6("avg((d + a = 0)::int)")} as share_no_information from facts group by kg""")(M.facts_per_entity)

_COVER = "(select kg, attribute, count(distinct head) / any_value(n) as coverage from attr join (select kg, count(*) as n from ents group by kg) using (kg) group by kg, attribute)"
query("property_coverage", f"""select kg, attribute, {r6("coverage")} as coverage from {_COVER}""")(M.property_coverage)
query("attr_completeness", f"""
select kg, {r6("heads / n")} as share_entities_with_attribute, {r6("triples / n")} as mean_attr_per_entity, {r6("pairs / n")} as mean_distinct_attr_per_entity, {r6("mc")} as mean_coverage, {r6("med")} as median_coverage, {r6("mx")} as max_coverage, n10 as n_covering_10pct
from (select kg, count(*) as n from ents group by kg) join (select kg, count(distinct head) as heads, count(*) as triples, count(distinct (head, attribute)) as pairs from attr group by kg) using (kg)
join (select kg, avg(coverage) as mc, quantile_cont(coverage, 0.5) as med, max(coverage) as mx, count(*) filter (coverage > 0.1) as n10 from {_COVER} group by kg) using (kg)""")(M.attribute_completeness)

_DT = f"""case when literal = '' then 'empty' when literal like '"%"@en' then 'langString' when literal like '%^^<%>' then regexp_replace(regexp_replace(literal, '>$', ''), '^.*[#/]', '') when regexp_matches(trim(literal, '"'), '^[+-]*([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then 'numeric' else 'string' end"""
query("datatype_mix", f"""
select kg, {r6("avg((t in ('string', 'langString'))::int)")} as share_text, {r6("avg((t in ('numeric', 'integer', 'double', 'float') or contains(t, 'nonNegativeInteger'))::int)")} as share_numeric, {r6("avg((contains(lower(t), 'date'))::int)")} as share_date, {r6("avg(length(literal))")} as mean_literal_length
from (select kg, literal, {_DT} as t from attr) group by kg""")(M.datatype_mix)

_TYPES = "(select kg, head, tail from rel where relation = 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type')"
query("type_counts", f"""select kg, tail as type, n from (select kg, tail, count(*) as n, row_number() over (partition by kg order by count(*) desc, tail) as r from {_TYPES} group by kg, tail) where r <= 50""")(M.type_counts)
query("type_distribution", f"""
select kg, nt as n_type_triples, nd as n_distinct_types, {r6("h / n")} as share_entities_typed, {r6("e")} as type_entropy_norm from (select kg, count(*) as n from ents group by kg)
join (select kg, count(*) as nt, count(distinct tail) as nd, count(distinct head) as h from {_TYPES} group by kg) using (kg)
join (select kg, case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 0 end as e from (select kg, tail, count(*) / sum(count(*)) over (partition by kg) as p from {_TYPES} group by kg, tail) group by kg) using (kg)""")(M.type_distribution)

_NS = "case when contains(item, '#') then regexp_extract(item, '^(.*#)', 1) when contains(item, '/') then regexp_extract(item, '^(.*/)', 1) else item end"
_VOCAB = f"""v0 as (select distinct kg, 'relation' as kind, relation as item from rel union select kg, 'attribute', attribute from attr), props as (select distinct kg, 'property' as kind, item from v0),
vocab as (select * from v0 union select * from props union select distinct kg, 'property_namespace', {_NS} from props union select distinct kg, 'entity_namespace', {_NS} from (select kg, entity as item from ents) union select distinct kg, 'type', tail from {_TYPES}),
sides as (select kind, item, max((kg = 'kg1')::int) as a, max((kg = 'kg2')::int) as b from vocab group by kind, item)"""
query("schema_heterogeneity", f"""
, {_VOCAB} select kind, sum(a)::bigint as n_kg1, sum(b)::bigint as n_kg2, sum(a * b)::bigint as n_shared, {r6("sum(a * b) / count(*)")} as jaccard, {r6("least(sum(a), sum(b)) / greatest(sum(a), sum(b))")} as size_ratio from sides group by kind""")(M.schema_heterogeneity)
query("type_jaccard", f""", {_VOCAB} select sum(a * b)::bigint as n_shared, {r6("sum(a * b) / count(*)")} as jaccard from sides where kind = 'type'""")(lambda p: M.overlap(M.vocabularies(p), ["kind"]).where("kind = 'type'").select("n_shared", "jaccard"))
query("shared_properties", f""", {_VOCAB} select kind, item as property from (select *, row_number() over (partition by kind order by item) as r from sides where a * b = 1 and kind in ('relation', 'attribute')) where r <= 50""")(M.shared_properties)

query("alignment_metrics", f"""
, fan as (select *, count(*) over (partition by e1) as f1, count(*) over (partition by e2) as f2 from gold), m as (select kg, count(*) as n, avg(total_degree) as mean from deg group by kg)
select count(*) as n_alignments, (select count(*) from align where e2 = '') as n_unmatched, max(f1) as max_fanout_kg1, max(f2) as max_fanout_kg2, {r6("avg((f1 = 1 and f2 = 1)::int)")} as bijective_share,
  {r6("count(distinct e1) / (select n from m where kg = 'kg1')")} as coverage_kg1, {r6("count(distinct e2) / (select n from m where kg = 'kg2')")} as coverage_kg2, {r6("log10((select n from m where kg = 'kg1')::double * (select n from m where kg = 'kg2'))")} as candidate_space_log10,
  {r6("(select avg(d1) from gd)")} as aligned_mean_degree_kg1, {r6("(select avg(d2) from gd)")} as aligned_mean_degree_kg2, {r6("(select avg(d1) from gd) / (select mean from m where kg = 'kg1')")} as degree_bias_kg1, {r6("(select avg(d2) from gd) / (select mean from m where kg = 'kg2')")} as degree_bias_kg2 from fan""")(M.alignment_metrics)
query("alignment_fanout", """select 'kg1' as side, f as fanout, count(*) as n from (select count(*) as f from gold group by e1) group by f union all select 'kg2', f, count(*) from (select count(*) as f from gold group by e2) group by f""")(M.alignment_fanout)
query("alignment_splits", """select split, count(*) filter (e2 <> '') as n_matched, count(*) filter (e2 = '') as n_unmatched from align group by split""")(M.alignment_splits)
query("degree_correlation", f"""
, r as (select *, {", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r_{c}" for c in ("d1", "d2", "a1", "a2"))} from gd)
select {r6("corr(d1, d2)")} as degree_pearson, {r6("corr(r_d1, r_d2)")} as degree_spearman, {r6("corr(r_a1, r_a2)")} as attr_count_spearman, {r6("avg(abs(d1 - d2))")} as mean_abs_degree_diff, {r6("avg((d1 = 0)::int)")} as share_isolated_kg1, {r6("avg((d2 = 0)::int)")} as share_isolated_kg2, {r6("avg((a1 = 0 and a2 = 0)::int)")} as share_no_attr_both from r""")(M.degree_correlation)

VALUES = """vals as (select distinct kg, entity, value from (select kg, head as entity, trim(regexp_replace(lower(strip_accents(case when starts_with(literal, '"') then regexp_extract(literal, '^"(.*)"', 1) else literal end)), '\\s+', ' ', 'g')) as value from attr) where value <> '')"""
query("literal_overlap", f"""
, {VALUES}, n1 as (select e1, e2, count(value) as n1 from gold left join vals on kg = 'kg1' and entity = e1 group by e1, e2), n2 as (select e1, e2, count(value) as n2 from gold left join vals on kg = 'kg2' and entity = e2 group by e1, e2),
sh as (select e1, e2, count(*) as shared from gold join vals x on x.kg = 'kg1' and x.entity = e1 join vals y on y.kg = 'kg2' and y.entity = e2 and x.value = y.value group by e1, e2)
select e1, e2, coalesce(shared, 0) as shared, case when n1 > 0 and n2 > 0 then {r6("coalesce(shared, 0) / (n1 + n2 - coalesce(shared, 0))")} else 0.0 end as literal_jaccard, case when n1 > 0 and n2 > 0 then {r6("coalesce(shared, 0) / least(n1, n2)")} else 0.0 end as literal_containment
from n1 join n2 using (e1, e2) left join sh using (e1, e2)""")(M.literal_overlap)

query("density", f""", e as (select distinct kg, least(head, tail) as a, greatest(head, tail) as b from rel where head <> tail)
select kg, n_nodes, n_edges, {r6("2 * n_edges / (n_nodes::double * (n_nodes - 1))")} as density from (select kg, count(*) as n_nodes from ents group by kg) join (select kg, count(*) as n_edges from e group by kg) using (kg)""")(G.density)
query("clustering", f""", e as (select distinct kg, least(head, tail) as a, greatest(head, tail) as b from rel where head <> tail),
both_ways as (select kg, a, b from e union all select kg, b, a from e), dg as (select kg, a as node, count(*) as d from both_ways group by kg, a),
tri as (select x.kg, x.a as n1, x.b as n2, y.b as n3 from e x join e y on x.kg = y.kg and x.b = y.a join e z on z.kg = x.kg and z.a = x.a and z.b = y.b),
per as (select kg, node, count(*) as t from (select kg, unnest([n1, n2, n3]) as node from tri) group by kg, node)
select kg, coalesce(t, 0) as n_triangles, {r6("coalesce(c, 0)")} as avg_clustering from (select kg, count(*) as n from ents group by kg) left join
(select kg, (sum(t) / 3)::bigint as t, sum(2 * t / (d * (d - 1))) / (select count(*) from ents en where en.kg = per.kg) as c from per join dg using (kg, node) group by kg) using (kg)""")(G.clustering)

query("alignment_shares", f"""
, f1 as (select count(*) as f from gold group by e1), f2 as (select count(*) as f from gold group by e2), n as (select kg, count(*) as n from ents group by kg)
select (select {r6("avg((f > 1)::int)")} from f1) as ambiguity_1_to_n, (select {r6("avg((f > 1)::int)")} from f2) as ambiguity_n_to_1, {r6("1 - (select count(*) from f1) / (select n from n where kg = 'kg1')")} as unaligned_share_kg1,
  {r6("1 - (select count(*) from f2) / (select n from n where kg = 'kg2')")} as unaligned_share_kg2, {r6("(select count(*) from align where e2 = '') / (select n from n where kg = 'kg1')")} as non_match_share_kg1""")(M.alignment_shares)
query("split_sizes", "select split, count(*) as n from align where e2 <> '' group by split")(M.split_sizes)
query("aligned_shares", f"""select count(*) as n_pairs_evaluated, {r6("avg((d1 = 0 or d2 = 0)::int)")} as share_pairs_one_side_isolated, {r6("avg((d1 = 0 and d2 = 0)::int)")} as share_pairs_both_isolated, {r6("avg((a1 = 0 or a2 = 0)::int)")} as share_pairs_one_side_no_attr from gd""")(M.aligned_shares)


def describe_sql(source: str, keys: str) -> str:
    """SQL of S.describe over a relation with the keys and x."""
    by = f"partition by {keys}"
    return f"""select {keys}, count(*) as n, {r6("avg(x)")} as mean, {r6("quantile_cont(x, 0.5)")} as median, {r6("stddev_pop(x)")} as std, min(x)::double as min, max(x)::double as max, {", ".join(r6(f"quantile_cont(x, {q / 100})") + f" as p{q}" for q in (25, 75, 95, 99))},
{r6("coalesce(case when count(*) > 2 and stddev_pop(x) > 0 then skewness(x) end, 0)")} as skew, {r6("coalesce(case when count(*) > 3 and stddev_pop(x) > 0 then kurtosis(x) end, 0)")} as kurtosis,
{r6("case when sum(x) = 0 then 0 else greatest(0, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)) end")} as gini from (select *, row_number() over ({by} order by x) as i from (select {keys}, x::double as x from {source})) group by {keys}"""


_GAP = "(select 'abs_degree_diff' as of, abs(d1 - d2) as x from gd)"
query("degree_differences", describe_sql(_GAP, "of"))(M.degree_differences)
query("property_frequencies", describe_sql(f"(select kg, kind, n as x from {_COUNTS})", "kg, kind"))(M.property_frequencies)
_OVERLAP = f"""{VALUES}, n1 as (select e1, e2, count(value) as n1 from gold left join vals on kg = 'kg1' and entity = e1 group by e1, e2), n2 as (select e1, e2, count(value) as n2 from gold left join vals on kg = 'kg2' and entity = e2 group by e1, e2),
sh as (select e1, e2, count(*) as shared from gold join vals x on x.kg = 'kg1' and x.entity = e1 join vals y on y.kg = 'kg2' and y.entity = e2 and x.value = y.value group by e1, e2),
ov as (select coalesce(shared, 0) as s, n1, n2 from n1 join n2 using (e1, e2) left join sh using (e1, e2))"""
query("literal_means", f""", {_OVERLAP} select {r6("avg(case when n1 > 0 and n2 > 0 then s / (n1 + n2 - s) else 0 end)")} as "literal_value_jaccard.mean", {r6("avg(case when n1 > 0 and n2 > 0 then s / least(n1, n2) else 0 end)")} as "literal_value_containment.mean", {r6("avg((s = 0)::int)")} as share_pairs_no_shared_literal from ov""")(M.literal_means)

#: lab: the least node reached after at most 16 steps along edges, which is the component of every node of these graphs; lcc: the largest component.
COMPONENTS = """ne as (select distinct kg, head as x, tail as y from rel union select distinct kg, tail, head from rel union select kg, entity, entity from ents),
steps(kg, node, l, i) as (select kg, entity, entity, 0 from ents union all select ne.kg, ne.x, min(l), i + 1 from steps join ne on ne.kg = steps.kg and ne.y = steps.node where i < 16 group by ne.kg, ne.x, i),
lab as (select kg, node, l as component from steps where i = 16), csize as (select kg, component, count(*) as size from lab group by all),
lcc as (select kg, node as entity from lab join (select kg, component from (select *, row_number() over (partition by kg order by size desc, component) as r from csize) where r = 1) using (kg, component))"""
query("components", f", {COMPONENTS} select * from lab")(G.pair_components)
query("component_sizes", f", {COMPONENTS} select kg, r as rank, size as component_size from (select *, row_number() over (partition by kg order by size desc, component) as r from csize) where r <= 20")(lambda p: G.component_table(G.pair_components(p)))
_CC = """cc as (select kg, count(*) as n_components, max(size) as size_largest_cc, sum(size) as n, count(*) filter (size = 1) as single from csize group by kg)"""
query("connectivity", f"""
, {COMPONENTS}, {_CC}, e as (select distinct kg, least(head, tail) as a, greatest(head, tail) as b from rel where head <> tail), ew as (select kg, a, b from e union all select kg, b, a from e), dg as (select kg, a as node, count(*) as d from ew group by kg, a),
tri as (select x.kg, x.a as n1, x.b as n2, y.b as n3 from e x join e y on x.kg = y.kg and x.b = y.a join e z on z.kg = x.kg and z.a = x.a and z.b = y.b),
per as (select kg, node, count(*) as t from (select kg, unnest([n1, n2, n3]) as node from tri) group by kg, node), cl as (select kg, sum(2 * t / (d * (d - 1))) as c from per join dg using (kg, node) group by kg), m as (select kg, count(*) as m from e group by kg)
select kg, n_components, size_largest_cc, {r6("size_largest_cc / n")} as share_largest_cc, {r6("single / n_components")} as share_singleton_cc, {r6("2 * m / (n::double * (n - 1))")} as density, {r6("coalesce(c, 0) / n")} as avg_clustering from cc join m using (kg) left join cl using (kg)""")(G.connectivity)
_REACH = """t as (select d1 > 0 as x, d2 > 0 as y, e1 in (select entity from lcc where kg = 'kg1') as u, e2 in (select entity from lcc where kg = 'kg2') as v from gd)"""
query("reachability", f"""
, {COMPONENTS}, {_REACH} select unnest(['edge_kg1', 'edge_kg2', 'lcc_kg1', 'lcc_kg2', 'both_with_edge', 'both_in_lcc']) as criterion,
unnest([{r6("avg(x::int)")}, {r6("avg(y::int)")}, {r6("avg(u::int)")}, {r6("avg(v::int)")}, {r6("avg((x and y)::int)")}, {r6("avg((u and v)::int)")}]) as share from t""")(M.reachability)
query("entity_ordinals", "select kg, entity, row_number() over (partition by kg order by entity) - 1 as i from ents")(lambda p: p.ordinals())

# ---------------------------------------------------------------- keys over both graphs, and the tables of all datasets

_PAIRED = [
    ("degree_distribution", "pair.min_median_total_degree", "select min(m) from (select median(total_degree) as m from deg group by kg)"),
    ("degree_distribution", "pair.max_share_isolated", "select max(m) from (select avg((total_degree = 0)::int) as m from deg group by kg)"),
    ("degree_distribution", "pair.mean_total_degree", "select avg(m) from (select avg(total_degree) as m from deg group by kg)"),
    ("degree_distribution", "pair.mean_degree_gini", "select avg(g) from (select greatest(0, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)) as g from (select kg, total_degree::double as x, row_number() over (partition by kg order by total_degree) as i from deg) group by kg)"),
    ("property_distribution", "pair.mean_rel_entropy_norm", "select avg(h) from (select -sum(p * log2(p)) / log2(count(*)) as h from (select kg, count(*) / sum(count(*)) over (partition by kg) as p from rel group by kg, relation) group by kg)"),
    ("connectivity", "pair.min_share_largest_cc", "select min(size_largest_cc / n) from cc"),
    ("attribute_completeness", "pair.min_share_entities_with_attribute", "select min(h / n) from nh"),
    ("attribute_completeness", "pair.mean_attr_per_entity", "select avg(t / n) from nh"),
    ("attribute_completeness", "pair.mean_share_literals_text", f"select avg(s) from (select avg(({_DT} in ('string', 'langString'))::int) as s from attr group by kg)"),
]
_NH = "nh as (select kg, n, h, t from (select kg, count(*) as n from ents group by kg) join (select kg, count(distinct head) as h, count(*) as t from attr group by kg) using (kg))"


@query("pair_scalars", f", {COMPONENTS}, {_CC}, {_NH} " + " union all ".join(f"select '{m}' as metric, '{k}' as key, {r6('(' + sql + ')')} as value" for m, k, sql in _PAIRED))
def pair_scalars(p):
    return H.paired_scalars(p, M.PAIRED)


_SIZES = "nr as (select kg, count(*) as n_rel_triples, count(distinct relation) as n_relations from rel group by kg), na as (select kg, count(*) as n_attr_triples, count(distinct attribute) as n_attributes, count(distinct literal) as n_literals from attr group by kg), nn as (select kg, count(*) as n_entities from ents group by kg), bs as (select * from nn join nr using (kg) join na using (kg))"
_BASIC = [*((c, c) for c in ("n_entities", "n_relations", "n_attributes", "n_literals", "n_rel_triples", "n_attr_triples")), ("attr_to_rel_ratio", "n_attr_triples / n_rel_triples"), ("rel_triples_per_entity", "n_rel_triples / n_entities"), ("attr_triples_per_entity", "n_attr_triples / n_entities")]
_ONE = {
    "n_alignments": "select count(*) from gold", "alignment_ratio": "(select count(*) from gold) / (select min(n_entities) from nn)", "n_entities_total": "select count(*) from ents",
    "n_triples_total": "(select count(*) from rel) + (select count(*) from attr)", "size_asymmetry": "select (max(n_rel_triples) - min(n_rel_triples)) / max(n_rel_triples) from nr",
}


@query("comparison_scalars", f", {_SIZES} " + " union all ".join([*(f"select 'tables' as dataset, 'basic_stats' as metric, kg || '.{k}' as key, {r6(v)} as value from bs" for k, v in _BASIC), *(f"select 'tables', 'basic_stats', '{k}', {r6(f'({v})')}" for k, v in _ONE.items())]))
def comparison_scalars(p):
    return M.scalars(p, "basic_stats")


_RANKED = "rk as (select *, rank() over (order by d1) + (count(*) over (partition by d1) - 1) / 2.0 as r1, rank() over (order by d2) + (count(*) over (partition by d2) - 1) / 2.0 as r2 from gd)"
_FAN = "fan as (select *, count(*) over (partition by e1) as f1, count(*) over (partition by e2) as f2 from gold)"
_HEAD = {
    **{f"basic_stats.kg{i}.{c}": f"select {c} from bs where kg = 'kg{i}'" for c in ("n_entities", "n_rel_triples", "n_attr_triples") for i in (1, 2)},
    "basic_stats.n_alignments": _ONE["n_alignments"], "basic_stats.size_asymmetry": _ONE["size_asymmetry"],
    **{f"degree_distribution.kg{i}.total.mean": f"select avg(total_degree) from deg where kg = 'kg{i}'" for i in (1, 2)},
    **{f"degree_distribution.kg{i}.share_isolated": f"select avg((total_degree = 0)::int) from deg where kg = 'kg{i}'" for i in (1, 2)},
    **{f"connectivity.kg{i}.share_largest_cc": f"select size_largest_cc / n from cc where kg = 'kg{i}'" for i in (1, 2)},
    **{f"attribute_completeness.kg{i}.share_entities_with_attribute": f"select h / n from nh where kg = 'kg{i}'" for i in (1, 2)},
    "schema_heterogeneity.property.jaccard": "select sum(a * b) / count(*) from sides where kind = 'property'", "aligned_consistency.degree_spearman": "select corr(r1, r2) from rk",
    "alignment_metrics.bijective_share": "select avg((f1 = 1 and f2 = 1)::int) from fan", "alignment_reachability.both_in_lcc.share": "select avg((u and v)::int) from t",
}


@query("headline", f", {COMPONENTS}, {_CC}, {_NH}, {_SIZES}, {_RANKED}, {_FAN}, {_REACH}, {_VOCAB} select 'tables' as dataset, " + ", ".join(f'{r6(f"({v})")} as "{k}"' for k, v in _HEAD.items()))
def headline(p):
    out = H.headline_scalars(p)
    # only the columns of the table, so that the pivot is over few names
    return R.headline(R.comparison(out.where(F.concat_ws(".", "metric", "key").isin(*R.HEADLINE))))
