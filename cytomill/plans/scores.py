"""Counting errors, method comparisons and corpus roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.operators import inference as inf
from cytomill.operators import masks as mk
from cytomill.operators import results as rs
from cytomill.operators.ordered import join_on, quantiles, top_k
from cytomill.plans.regions import RUNOV, pairs
from cytomill.plans.registry import Tables, query, r, rnd, scorr, z_tail
from cytomill.plans.shapes import PRED, TRUTH, runs

COUNTS = """cnt_ as (select c_custkey as image, n_name as dataset, c_mktsegment as model, coalesce(n, 0)::double as gt, coalesce(n, 0)::double + c_custkey % 5 - 2 as pred from customer join nation on n_nationkey = c_nationkey
   left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey)"""


def counts(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("double").alias("gt"))
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(n, "c_custkey", "left").fillna(0.0, ["gt"])
    return c.select(F.col("c_custkey").alias("image"), F.col("n_name").alias("dataset"), F.col("c_mktsegment").alias("model"), "gt", (F.col("gt") + F.col("c_custkey") % 5 - 2).alias("pred"))


METRICS = ["mae", "rmse", "r2", "r", "mpe", "error_std", "ci95"]
ERR = lambda keys: f"""select {keys}, count(*) as n_images, avg(abs(pred - gt)) as mae, sqrt(avg(pow(pred - gt, 2))) as rmse, case when var_pop(gt) * count(*) <= 1e-12 then 0 else 1 - avg(pow(pred - gt, 2)) / var_pop(gt) end as r2,
   case when count(*) < 3 then 0 else coalesce({scorr('gt', 'pred')}, 0) end as r, coalesce(avg(case when gt <> 0 then (pred - gt) / gt * 100 end), 0) as mpe, coalesce(stddev_samp(pred - gt), 0) as error_std,
   coalesce(1.96 * stddev_samp(pred - gt) / sqrt(count(*)), 0) as ci95 from cnt_ group by {keys}"""
OUT = ", ".join(f"{r(m)} as {m}" for m in METRICS)


def rounded(df: DataFrame, keys, columns=METRICS) -> DataFrame:
    return df.select(*keys, *[rnd(c).alias(c) for c in columns])


@query("a30_counting_errors", f"with {COUNTS}, m as ({ERR('model, dataset')}) select model, dataset, n_images, {OUT} from m")
def _(t):
    return rounded(rs.counting_errors(counts(t), ["model", "dataset"]), ["model", "dataset", "n_images"])


@query("a31_error_std_ci", f"with {COUNTS}, m as ({ERR('dataset')}) select dataset, n_images, {r('error_std')} as error_std, {r('ci95')} as ci95 from m")
def _(t):
    return rounded(rs.counting_errors(counts(t), ["dataset"]), ["dataset", "n_images"], ["error_std", "ci95"])


@query("a32_weighted_overall", f"with {COUNTS}, m as ({ERR('model, dataset')}) select model, sum(n_images)::bigint as n_images, " + ", ".join(f"{r(f'sum({c} * n_images) / sum(n_images)')} as {c}" for c in ("mae", "rmse", "mpe")) + " from m group by 1")
def _(t):
    m = rs.counting_errors(counts(t), ["model", "dataset"])
    return rounded(rs.weighted_overall(m, ["model"], ["mae", "rmse", "mpe"]), ["model", "n_images"], ["mae", "rmse", "mpe"])


@query("a32_pooled_rollup", f"with {COUNTS} select coalesce(model, 'all') as model, coalesce(dataset, 'all') as dataset, count(*) as n, {r('stddev_samp(pred - gt)')} as error_std from cnt_ group by rollup (model, dataset)")
def _(t):
    d = counts(t).withColumn("e", F.col("pred") - F.col("gt")).rollup("model", "dataset").agg(F.count(F.lit(1)).alias("n"), rnd(F.stddev_samp("e")).alias("error_std"))
    return d.fillna("all", ["model", "dataset"])


BEST = f"with {COUNTS}, m0 as ({ERR('model, dataset')}), m as (select model, dataset, round(mae, 6) as mae, round(r2, 6) as r2 from m0) "


@query("a33_best_marks", BEST + "select dataset, arg_min(model, (mae, model)) as best_mae, arg_min(model, (-r2, model)) as best_r2 from m group by 1")
def _(t):
    m = rs.counting_errors(counts(t), ["model", "dataset"]).select("model", "dataset", F.round("mae", 6).alias("mae"), F.round("r2", 6).alias("r2"))
    return rs.best_rows(m, ["dataset"], "model", ["mae"], ["r2"])


@query("s14_metric_sheet", f"with {COUNTS}, m as ({ERR('model, dataset')}), l as (select dataset, model, unnest(['mae', 'rmse']) as metric, unnest([mae, rmse]) as value from m) select dataset, metric, "
       + ", ".join(f"{r(f'max(case when model = {q!r} then value end)')} as {q}" for q in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from l group by 1, 2")
def _(t):
    m = rs.counting_errors(counts(t), ["model", "dataset"])
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    s = rs.metric_sheet(rs.long_metrics(m, ["dataset", "model"], ["mae", "rmse"]), ["dataset", "metric"], "model", names)
    return s.select("dataset", "metric", *[rnd(c).alias(c) for c in names])


@query("a35_data_count", "select coalesce(n_name, 'all') as dataset, count(*) as n_rows, sum(o_orderkey)::bigint as o_orderkey from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by rollup (n_name)")
def _(t):
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).withColumnRenamed("n_name", "dataset")
    return rs.corpus_rollup(j, ["dataset"], ["o_orderkey"])


@query("a36_diameters", f"with {TRUTH}, a as (select image_id, count(*) as area from pt group by image_id, label) select image_id, {r('quantile_cont(sqrt(area), 0.5) * 2 / sqrt(pi())')} as diameter, {r('quantile_cont(area::double, 0.25) / quantile_cont(area::double, 0.75)')} as size_ratio from a group by 1")
def _(t):
    a = mk.areas(runs(t)).withColumn("s", F.sqrt("area"))
    d = join_on(quantiles(a, ["image_id"], "s", {"m": 0.5}), quantiles(a, ["image_id"], "area", {"q1": 0.25, "q3": 0.75}), ["image_id"])
    return d.select("image_id", rnd(F.col("m") * 2 / F.sqrt(F.pi())).alias("diameter"), rnd(F.col("q1") / F.col("q3")).alias("size_ratio"))


@query("a36_radius_histogram", f"with {TRUTH}, a as (select image_id, sqrt(count(*) / pi()) as rad from pt group by image_id, label), b as (select image_id, greatest(0, least(9, floor((rad - 0) / 0.8)))::bigint as bin, count(*) as n from a group by 1, 2) select image_id, bin, {r('n / sum(n) over (partition by image_id)')} as share from b")
def _(t):
    h = rs.equal_width_histogram(mk.areas(runs(t)), ["image_id"], F.sqrt(F.col("area") / F.pi()), (0.0, 8.0), 10)
    return h.withColumn("share", rnd("share"))


# --- method comparison: order prices by status are three methods scored on every customer ----------

SC = """sc as (select c_nationkey as dataset, o_custkey as image, o_orderstatus as method, avg(o_totalprice) / 500000 as score from orders join customer on c_custkey = o_custkey group by 1, 2, 3)"""


def scores(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy(F.col("c_nationkey").alias("dataset"), F.col("o_custkey").alias("image"), F.col("o_orderstatus").alias("method")).agg((F.avg("o_totalprice") / 500000).alias("score"))


@query("a62_grid_search_best", "select l_linenumber, l_returnflag, round(avg(l_discount), 9) as mean_score from lineitem group by 1, 2 order by 3 desc, 1, 2 limit 1")
def _(t):
    return rs.grid_best(t.lineitem.select("l_linenumber", "l_returnflag", "l_discount"), ["l_linenumber", "l_returnflag"], "l_discount")


@query("a63_method_means", f"select lang as modality, source as method, {r('avg(n_chars)')} as mean_score, count(n_chars) as n from documents group by 1, 2")
def _(t):
    return rs.method_means(t.documents.withColumnsRenamed({"lang": "modality", "source": "method"}), ["modality", "method"], "n_chars").withColumn("mean_score", rnd("mean_score"))


@query("a64_relative_gain", f"with {SC}, w as (select dataset, avg(score) filter (method = 'F') as f, avg(score) filter (method = 'O') as o, avg(score) filter (method = 'P') as p from sc group by 1) select m as method, count(*) as n_datasets, {r('avg((v - f) / f * 100)')} as gain from (select f, unnest(['O', 'P']) as m, unnest([o, p]) as v from w where f is not null and o is not null and p is not null and f <> 0) group by 1")
def _(t):
    return rs.relative_gain(scores(t), "dataset", "method", "score", ["F", "O", "P"], "F").withColumn("gain", rnd("gain"))


def paired(t: Tables) -> DataFrame:
    s = scores(t)
    a, b = s.withColumnsRenamed({"method": "a", "score": "sa"}), s.withColumnsRenamed({"method": "b", "score": "sb"})
    return a.join(b, ["dataset", "image"]).where("a <> b").withColumn("diff", F.round(F.col("sa") - F.col("sb"), 9))


SR = SC + """, d0 as (select x.dataset, x.method as a, y.method as b, round(x.score - y.score, 9) as diff from sc x join sc y on x.dataset = y.dataset and x.image = y.image and x.method <> y.method), d as (select * from d0 where diff <> 0),
 k as (select *, rank() over (partition by dataset, a, b order by abs(diff)) + (count(*) over (partition by dataset, a, b, abs(diff)) - 1) / 2 as rk from d)"""


# ranks, ties and the tie-corrected normal tail of each pair of methods
SRP = SR + f""", tie as (select dataset, a, b, sum(c * c * c - c) as ties from (select dataset, a, b, count(*) as c from d group by dataset, a, b, abs(diff)) group by 1, 2, 3),
 w0 as (select dataset, a, b, count(*) as n, sum(case when diff > 0 then rk else 0 end) as w_plus, sum(case when diff < 0 then rk else 0 end) as w_minus from k group by 1, 2, 3),
 w1 as (select *, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) as z from w0 join tie using (dataset, a, b)),
 sr as (select *, {z_tail('z')} as p from w1)"""


@query("a65_signed_rank", f"with {SRP} select dataset, a, b, n, w_plus, w_minus, {r('p')} as p from sr")
def _(t):
    return inf.signed_rank(paired(t), ["dataset", "a", "b"], "diff").select("dataset", "a", "b", "n", "w_plus", "w_minus", rnd("p").alias("p"))


@query("a65_win_matrix", f"""with {SRP}, td as (select dataset, a, b, sum(diff) as total from d0 group by 1, 2, 3)
   select a, b, count(*) filter (p < 0.2 and total > 0) as wins, count(*) filter (p < 0.2 and total < 0) as losses, count(*) filter (not (p < 0.2) or total = 0) as ties from sr join td using (dataset, a, b) group by 1, 2""")
def _(t):
    p = paired(t)
    tests = inf.signed_rank(p, ["dataset", "a", "b"], "diff")
    total = p.groupBy("dataset", "a", "b").agg(F.sum("diff").alias("total_diff"))
    return rs.win_matrix(join_on(tests, total, ["dataset", "a", "b"]), 0.2)


@query("a77_paired_difference", f"with {SRP}, m as (select dataset, avg(diff) as m, count(*) as n from d0 where a = 'F' and b = 'O' group by 1) select dataset, {r('m')} as mean_diff, m.n, {r('coalesce(p, 1)')} as p from m left join (select dataset, p from sr where a = 'F' and b = 'O') using (dataset)")
def _(t):
    d = paired(t).where("a = 'F' and b = 'O'")
    m = d.groupBy("dataset").agg(rnd(F.avg("diff")).alias("mean_diff"), F.count(F.lit(1)).alias("n"))
    p = inf.signed_rank(d, ["dataset"], "diff").select("dataset", "p")
    return m.join(p, "dataset", "left").withColumn("p", rnd(F.coalesce("p", F.lit(1.0))))


@query("w03_average_ranks", f"with {SC}, m as (select dataset, method, round(avg(score), 9) as score from sc group by 1, 2), q as (select method, row_number() over (partition by dataset order by score desc, method) as k from m), a as (select method, avg(k) as mr, count(*) as n from q group by 1) select method, {r('mr')} as mean_rank, n as n_datasets, row_number() over (order by mr, method) as final_rank from a")
def _(t):
    m = scores(t).groupBy("dataset", "method").agg(F.round(F.avg("score"), 9).alias("score"))
    return rs.average_ranks_by_method(m, "dataset", "method", "score").withColumn("mean_rank", rnd("mean_rank"))


@query("a66_time_per_object", f"select event_type as method, {r('sum(value) / sum(user_id)')} as ratio from events group by 1")
def _(t):
    return rs.ratio_of_sums(t.events, ["event_type"], "value", "user_id").select(F.col("event_type").alias("method"), rnd("ratio").alias("ratio"))


@query("a67_model_advantage", f"with {RUNOV}, x as (select image_id, a_label as label, max(iou) as ia from iou where area_a >= 25 group by 1, 2), y as (select image_id, b_label as label, max(iou) as ib from iou group by 1, 2) select image_id, label, {r('ia')} as iou_a, {r('ib')} as iou_b, {r('ia - ib')} as advantage from x join y using (image_id, label)")
def _(t):
    p = pairs(t)
    x = p.where("area_a >= 25").groupBy("image_id", F.col("a_label").alias("label")).agg(F.max("iou").alias("ia"))
    y = p.groupBy("image_id", F.col("b_label").alias("label")).agg(F.max("iou").alias("ib"))
    return x.join(y, ["image_id", "label"]).select("image_id", "label", rnd("ia").alias("iou_a"), rnd("ib").alias("iou_b"), rnd(F.col("ia") - F.col("ib")).alias("advantage"))


@query("a71_summary_rows", f"with m as (select n_name as name, avg(c_acctbal) as ap from customer join nation on n_nationkey = c_nationkey group by 1) select name, {r('ap')} as ap from m union all select 'mean', {r('avg(ap)')} from m union all select 'std', {r('stddev_samp(ap)')} from m")
def _(t):
    m = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.avg("c_acctbal").alias("ap"))
    two = m.agg(F.avg("ap").alias("mean"), F.stddev_samp("ap").alias("std")).unpivot([], ["mean", "std"], "name", "ap")
    return m.unionByName(two).select("name", rnd("ap").alias("ap"))


@query("a76_binned_performance", f"with e as (select quantile_cont(l_quantity, 1 / 3.0) as e1, quantile_cont(l_quantity, 2 / 3.0) as e2 from lineitem) select (case when l_quantity <= e1 then 0 when l_quantity <= e2 then 1 else 2 end)::bigint as bin, count(*) as n, {r('avg(l_discount)')} as mean_score, {r('avg((l_discount = 0)::int)')} as miss_rate from lineitem, e group by 1")
def _(t):
    e = quantiles(t.lineitem, [], "l_quantity", {"e1": 1 / 3.0, "e2": 2 / 3.0})
    b = rs.binned_performance(t.lineitem, "l_quantity", "l_discount", e)
    return b.withColumn("mean_score", rnd("mean_score")).withColumn("miss_rate", rnd("miss_rate"))


@query("a76_line_fit", f"select l_returnflag, count(*) as n, {r(scorr('l_quantity', 'l_extendedprice'))} as r, {r('regr_slope(l_extendedprice, l_quantity)', 4)} as slope, {r('regr_intercept(l_extendedprice, l_quantity)', 3)} as intercept from lineitem group by 1")
def _(t):
    f = rs.line_fit(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return f.select("l_returnflag", "n", rnd("r").alias("r"), rnd("slope", 4).alias("slope"), rnd("intercept", 3).alias("intercept"))


@query("a78_corpus_rollup", "select coalesce(lang, 'all') as lang, coalesce(source, 'all') as source, count(*) as n_rows, sum(n_chars)::bigint as n_chars from documents group by rollup (lang, source)")
def _(t):
    return rs.corpus_rollup(t.documents, ["lang", "source"], ["n_chars"])


@query("a81_runtimes", f"select event_type as model, user_id % 7 as device, min(value) as best, {r('avg(value)')} as mean from events group by 1, 2")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 7).alias("device")).agg(F.min("value").alias("best"), rnd(F.avg("value")).alias("mean"))


@query("a82_repeated_runs", f"select l_linenumber::bigint as iteration, {r('avg(l_discount)')} as mean_score, count(distinct l_suppkey) as n_runs from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_linenumber").cast("long").alias("iteration")).agg(rnd(F.avg("l_discount")).alias("mean_score"), F.countDistinct("l_suppkey").alias("n_runs"))


@query("k01_worst_images", f"with {SC}, w as (select image, round(score, 9) as s from sc where method = 'O' order by 2, 1 limit 15) select count(*) as n, {r('avg(s)')} as mean, {r('stddev_samp(s)')} as std from w")
def _(t):
    w = scores(t).where("method = 'O'").select("image", F.round("score", 9).alias("s")).orderBy("s", "image").limit(15)
    return w.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("s")).alias("mean"), rnd(F.stddev_samp("s")).alias("std"))


@query("k04_best_images", f"with {SC} select image, method, {r('score')} as score from sc order by round(score, 9) desc, image, method limit 25")
def _(t):
    s = scores(t).withColumn("o", F.round("score", 9)).orderBy(F.desc("o"), "image", "method").limit(25)
    return s.select("image", "method", rnd("score").alias("score"))


@query("s27_first_last_result", "select l_suppkey, arg_min(l_extendedprice, l_orderkey * 10000000 + l_partkey * 100 + l_linenumber) as first_score, arg_max(l_extendedprice, l_orderkey * 10000000 + l_partkey * 100 + l_linenumber) as last_score, count(*) as n from lineitem group by 1")
def _(t):
    d = t.lineitem.withColumn("step", F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 100 + F.col("l_linenumber"))
    return rs.first_last(d, ["l_suppkey"], "step", "l_extendedprice")


@query("u01_union_batches", "select 'a' as batch, count(*) as n, sum(o_totalprice is null) as missing from (select o_totalprice from orders) group by 1 union all select 'b', count(*), count(*) from lineitem".replace("sum(o_totalprice is null)", "count(*) - count(o_totalprice)"))
def _(t):
    a = t.orders.select(F.lit("a").alias("batch"), "o_totalprice")
    b = t.lineitem.select(F.lit("b").alias("batch"), "l_quantity")
    return a.unionByName(b, allowMissingColumns=True).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("o_totalprice")).alias("missing"))


@query("u06_dedup", "select distinct l_returnflag, l_linestatus, l_suppkey from lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_suppkey").dropDuplicates()
