"""Queries of reports across datasets, over score tables derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import reports as R
from .base import query, r6

# scores by (dataset, matcher): nations as datasets, order priorities as matchers
_SCORES = """sc as (select n_name as dataset, o_orderpriority as matcher, round(avg((o_orderstatus = 'F')::int), 9) as f1 from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey group by all),
me as (select n_name as dataset, round(avg(c_acctbal), 6) as "m.balance", count(*)::double as "m.customers", (count(*) filter (c_mktsegment = 'BUILDING') / count(*))::double as "m.building" from customer join nation on n_nationkey = c_nationkey group by all)"""


def scores_and_metrics(spark, sf_dir):
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer", "nation")}
    c = t["customer"].join(F.broadcast(t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))
    scores = t["orders"].join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("dataset"), F.col("o_orderpriority").alias("matcher")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 9).alias("f1"))
    metrics = c.groupBy(F.col("n_name").alias("dataset")).agg(F.round(F.avg("c_acctbal"), 6).alias("m.balance"), F.count("*").cast("double").alias("m.customers"), F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("m.building"))
    return scores, metrics


COLUMNS = ["m.balance", "m.customers", "m.building"]


def merged(spark, sf_dir):
    return R.merge_scores(*scores_and_metrics(spark, sf_dir))


_MERGED = f'select matcher, dataset, {r6("f1")} as f1, {r6(chr(34) + "m.balance" + chr(34))} as "m.balance", "m.customers", {r6(chr(34) + "m.building" + chr(34))} as "m.building" from sc left join me using (dataset)'
query("metric_score_merge", f"with {_SCORES} {_MERGED}", kg=False)(merged)


@query("f1_matrix", f"with {_SCORES} select dataset, matcher, round(f1, 4) as f1 from sc", kg=False)
def f1_matrix(spark, sf_dir):
    wide = R.score_matrix(scores_and_metrics(spark, sf_dir)[0])
    names = [c for c in wide.columns if c != "dataset"]
    return wide.select("dataset", F.explode(F.array(*(F.struct(F.lit(n).alias("matcher"), F.col(f"`{n}`").alias("f1")) for n in names))).alias("c")).select("dataset", "c.matcher", "c.f1").where("f1 is not null")


_LONG = f"""{_SCORES}, lo as (select matcher, unnest(['m.balance', 'm.customers', 'm.building']) as metric, unnest(["m.balance", "m.customers", "m.building"]) as x, f1 as y from sc join me using (dataset)),
rk as (select *, rank() over (partition by matcher, metric order by x) + (count(*) over (partition by matcher, metric, x) - 1) / 2.0 as rx, rank() over (partition by matcher, metric order by y) + (count(*) over (partition by matcher, metric, y) - 1) / 2.0 as ry from lo),
rho as (select matcher, metric, corr(rx, ry) as rho, count(*) as n from rk group by all having count(*) >= 4 and count(distinct x) >= 3)"""
query("spearman_matrix", f"with {_LONG} select matcher, metric, {r6('rho')} as spearman_rho, n as n_datasets from rho", kg=False)(lambda s, d: R.spearman(merged(s, d), COLUMNS))
# the two-sided p of a correlation in closed form: with sin = |rho| and cos = sqrt(1 - rho^2), a finite sum for odd and for even degrees of freedom
_SUM = lambda first, term: f"list_sum(list_transform(range(0, greatest(0, {first})), lambda j: {term}))"
_PVAL = f"""case when abs(rho) >= 1 then 0 when (n - 2) % 2 = 1 then 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * coalesce({_SUM("(n - 3) // 2", "exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(1 - rho * rho, j + 0.5)")}, 0))
  else 1 - abs(rho) * coalesce({_SUM("(n - 2) // 2", "exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(1 - rho * rho, j)")}, 0) end"""
query("correlate", f"""with {_LONG}, r12 as (select matcher, metric, round(rho, 12) as rho, n from rho), pv as (select *, {_PVAL} as p, count(*) over () as n_tests from r12), pr as (select *, row_number() over (order by p, matcher, metric) as r from pv),
co as (select *, least(1, p * n_tests) as bonf, least(1, min(p * n_tests / r) over (order by r desc)) as fdr from pr)
select matcher, metric, {r6('rho')} as spearman_rho, {r6('p')} as p_value, n as n_datasets, {r6('abs(rho)')} as abs_rho, n_tests, {r6('bonf')} as p_bonferroni, {r6('fdr')} as p_fdr, bonf <= 0.05 as survives_bonferroni, fdr <= 0.05 as survives_fdr from co""", kg=False)(lambda s, d: R.correlate(merged(s, d), COLUMNS))


def _cells(wide, keys, name, value):
    """A pivoted table as (keys, name, value), without empty cells."""
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias(name), F.col(f"`{n}`").alias(value)) for n in names))).alias("c")).select(*keys, f"c.{name}", f"c.{value}").where(f"{value} is not null")


query("rho_matrix", f"with {_LONG} select matcher, metric, {r6('rho')} as spearman_rho from rho", kg=False)(lambda s, d: _cells(R.rho_matrix(R.spearman(merged(s, d), COLUMNS)), ["matcher"], "metric", "spearman_rho"))


@query("top_drivers", f"with {_LONG} select * from (select matcher, metric, {r6('rho')} as spearman_rho, n as n_datasets, {r6('abs(rho)')} as abs_rho, row_number() over (partition by matcher order by round(abs(rho), 12) desc, metric) as rank from rho) where rank <= 2", kg=False)
def top_drivers(spark, sf_dir):
    return R.top_drivers(R.spearman(merged(spark, sf_dir), COLUMNS).withColumn("abs_rho", F.abs("spearman_rho")), 2)


_P = "p as (select 'm' as matcher, p_brand as metric, avg(p_size) / (1000 * pi()) as p_value from part group by p_brand)"
query("p_adjust_bh", f"""with {_P}, r as (select *, count(*) over () as n_tests, row_number() over (order by p_value, matcher, metric) as r from p)
select matcher, metric, {r6("p_value")} as p_value, n_tests, {r6("least(1, p_value * n_tests)")} as p_bonferroni, {r6("least(1, min(p_value * n_tests / r) over (order by r desc))")} as p_fdr, least(1, p_value * n_tests) <= 0.05 as survives_bonferroni, least(1, min(p_value * n_tests / r) over (order by r desc)) <= 0.05 as survives_fdr from r""", kg=False)(
    lambda s, d: R.adjust_p_values(s.read.parquet(f"{d}/part.parquet").groupBy(F.lit("m").alias("matcher"), F.col("p_brand").alias("metric")).agg((F.avg("p_size") / (1000 * F.pi())).alias("p_value")))
)

# folds and factors: line numbers as folds, flags as matchers
_FOLDS = "fo as (select l_linenumber as fold, l_linestatus as dataset, l_returnflag as matcher, avg(l_discount) as f1, avg(l_tax) as precision from lineitem group by all), fv as (select dataset, matcher, avg(f1) as f1_mean, stddev_samp(f1) as f1_std, min(f1) as f1_min, max(f1) as f1_max, avg(precision) as precision_mean, stddev_samp(precision) as precision_std, count(*) as n_folds from fo group by all)"


def folds(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.groupBy(F.col("l_linenumber").alias("fold"), F.col("l_linestatus").alias("dataset"), F.col("l_returnflag").alias("matcher")).agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("precision"))


query("fold_variance", f"with {_FOLDS} select dataset, matcher, {', '.join(r6(c) + ' as ' + c for c in ('f1_mean', 'f1_std', 'f1_min', 'f1_max', 'precision_mean', 'precision_std'))}, n_folds from fv", kg=False)(lambda s, d: E.fold_variance(folds(s, d)))
query("fold_spread", f"with {_FOLDS} select matcher, {r6('stddev_samp(f1_mean)')} as spread_across_datasets, count(*) as n_datasets, {r6('avg(f1_std)')} as mean_fold_std from fv group by matcher", kg=False)(lambda s, d: E.spread(E.fold_variance(folds(s, d))))

_FACTORS = """fa as (select case when l_linestatus = 'O' then 'EN_FR' else 'D_W' end as pair, case when l_linenumber % 2 = 0 then '15K' else '100K' end as scale, case when l_quantity < 25 then 'V1' else 'V2' end as density, l_returnflag as matcher, avg(l_discount) as f1 from lineitem group by all)"""


def factor_scores(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.concat_ws("_", F.when(F.col("l_linestatus") == "O", "EN_FR").otherwise("D_W"), F.when(F.col("l_linenumber") % 2 == 0, "15K").otherwise("100K"), F.when(F.col("l_quantity") < 25, "V1").otherwise("V2"))
    return R.annotate(t.groupBy(name.alias("dataset"), F.col("l_returnflag").alias("matcher")).agg(F.avg("l_discount").alias("f1")))


query("contrast_density", f"""with {_FACTORS} select matcher, round(avg(a.f1), 3) + 0.0 as f1_low, round(avg(b.f1), 3) + 0.0 as f1_high, round(avg(b.f1 - a.f1), 3) + 0.0 as delta, count(*) as n_pairs from fa a join fa b using (pair, scale, matcher) where a.density = 'V1' and b.density = 'V2' group by matcher""", kg=False)(lambda s, d: R.contrast(factor_scores(s, d), "density", "V1", "V2"))


@query("f1_by_pair", f"""with {_FACTORS} select pair, matcher, round(avg(f1), 3) as f1 from fa group by all""", kg=False)
def f1_by_pair(spark, sf_dir):
    wide = R.f1_by_pair(factor_scores(spark, sf_dir))
    names = [c for c in wide.columns if c != "pair"]
    return wide.select("pair", F.explode(F.array(*(F.struct(F.lit(n).alias("matcher"), F.col(n).alias("f1")) for n in names))).alias("c")).select("pair", "c.matcher", "c.f1").where("f1 is not null")


@query("equivalence_check", """, a as (select 'n_ents.' || kg as metric, count(*)::double as v from ents group by kg union all select 'n_rel.' || kg, count(*)::double from rel group by kg) select metric, v as value_1, case when metric like 'n_ents%' then v else v + 1 end as value_2, case when metric like 'n_ents%' then 0.0::double else 1.0::double end as abs_diff, metric like 'n_ents%' or v >= 1e6 as match from a""")
def equivalence_check(p):
    ents = p.entities().groupBy("kg").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("n_ents."), "kg").alias("metric"), "value")
    rel = p.rel.groupBy("kg").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("n_rel."), "kg").alias("metric"), "value")
    one = ents.union(rel)
    two = p.degrees().groupBy("kg").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("n_ents."), "kg").alias("metric"), "value").union(rel.select("metric", F.col("value") + 1))
    return R.equivalence(one, two)

# sweeps of several datasets: flags as matchers, line numbers as thresholds
_SWEEPS = "sw as (select l_returnflag as matcher, l_linestatus as dataset, l_linenumber / 10.0::double as threshold, avg(l_discount) as f1 from lineitem group by all), tm as (select matcher, threshold, avg(f1) as f1 from sw group by all)"


def sweeps(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("matcher"), F.col("l_linestatus").alias("dataset"), (F.col("l_linenumber") / F.lit(10.0)).alias("threshold")).agg(F.avg("l_discount").alias("f1"))


query("threshold_means", f"with {_SWEEPS} select matcher, threshold, {r6('f1')} as f1 from tm", kg=False)(lambda s, d: E.threshold_means(sweeps(s, d)))
query("threshold_choices", f"with {_SWEEPS} select matcher, threshold, {r6('f1')} as f1 from (select *, row_number() over (partition by matcher order by round(f1, 9) desc, threshold) as r from tm) where r = 1", kg=False)(lambda s, d: E.threshold_choice(E.threshold_means(sweeps(s, d)), ["matcher"]))
