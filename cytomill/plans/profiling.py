"""Morphological profiling on the driver tables.

A line item is a cell with four numeric features; the plate is return flag + line status, the
field is the supplier, the compound its nation, the mode of action its region. AFRICA is control.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.operators import inference as inf
from cytomill.operators import gram as gm
from cytomill.operators import profiles as pr
from cytomill.functions.scalar import first_match
from cytomill.operators.pixels import merge_tile_features
from cytomill.operators.ordered import attach, join_on, top_k
from cytomill.session import cut
from cytomill.plans.registry import Tables, query, r, rnd, scorr, t_tail

FEATURES = ["quantity", "price", "reduction", "charge"]
CONTROL = "AFRICA"


def cells(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("plate"), F.col("l_suppkey").alias("field"),
                             F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
                             (F.col("l_extendedprice") * F.col("l_discount")).alias("reduction"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("charge"))


def treatments(t: Tables) -> DataFrame:
    """field -> compound, moa, dose. Joins are small dimension lookups Catalyst sizes itself."""
    return (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("field"), F.col("n_name").alias("compound"), F.col("r_name").alias("moa"),
                F.floor((F.col("s_acctbal") + 1000) / 2500).cast("double").alias("dose"))
    )


def field_values(t: Tables) -> DataFrame:
    """(plate, field, n_cells, compound, moa, dose, is_control, feature, value) at field level."""
    prof = pr.field_profiles(cells(t), ["plate", "field"], FEATURES)
    vals = pr.profile_values(prof, ["plate", "field", "n_cells"])
    return cut(join_on(vals, treatments(t), ["field"]).withColumn("is_control", F.col("moa") == CONTROL))


def z_values(t: Tables) -> DataFrame:
    """The field table is a stage output (checkpointed once), so the steps after it do not redo the cells."""
    return pr.robust_z(field_values(t), "plate", "is_control", ["field"])


LONG = """cells as (
  select l_returnflag || l_linestatus as plate, l_suppkey as field, unnest(['quantity','price','reduction','charge']) as feature,
         unnest([l_quantity, l_extendedprice, l_extendedprice * l_discount, l_extendedprice * (1 + l_tax)]) as value from lineitem),
treat as (select s_suppkey as field, n_name as compound, r_name as moa, floor((s_acctbal + 1000) / 2500) as dose
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
prof as (select plate, field, feature, count(*) as n_cells, quantile_cont(value, 0.5) as median, mad(value) as mad
  from cells group by all having count(*) >= 5)"""
VALS = LONG + """,
vals as (select plate, field, n_cells, compound, moa, dose, moa = 'AFRICA' as is_control, feature || '_' || k as feature,
   case when k = 'median' then median else mad end as value
  from prof join treat using (field), (select unnest(['median', 'mad']) as k) kinds)"""
Z = VALS + """,
nc as (select plate, count(distinct field) filter (is_control) as n from vals group by plate),
na as (select count(*) as n from (select distinct plate, field from vals where is_control)),
refs as (
  select nc.plate, feature, quantile_cont(value, 0.5) as med, mad(value) as mad, stddev_pop(value) as sd
  from nc, na, vals where case when nc.n >= 5 then vals.plate = nc.plate and is_control when na.n >= 5 then is_control else true end group by all),
zs as (select vals.*, (value - med) / (case when mad < 1e-10 then sd + 1e-10 else mad end) as z from vals join refs using (plate, feature))"""


@query("a13_field_profiles", f"with {LONG} select plate, field, n_cells, feature, {r('median')} as median, {r('mad')} as mad from prof")
def _(t):
    p = pr.field_profiles(cells(t), ["plate", "field"], FEATURES)
    return p.select("plate", "field", "n_cells", "feature", rnd("median").alias("median"), rnd("mad").alias("mad"))


@query("a14_robust_zscore", f"with {Z} select plate, field, feature, {r('z')} as z from zs")
def _(t):
    return z_values(t).select("plate", "field", "feature", rnd("z").alias("z"))


@query("a15_treatment_profiles", f"""with {Z} select compound, dose, feature, {r('avg(z)')} as value, count(distinct (plate, field)) as n_fields,
  cast(sum(n_cells) as bigint) as n_cells_total, min(moa) as moa from zs group by compound, dose, feature""")
def _(t):
    z = z_values(t)
    return z.groupBy("compound", "dose", "feature").agg(
        rnd(F.avg("z")).alias("value"), F.countDistinct("plate", "field").alias("n_fields"), F.sum("n_cells").alias("n_cells_total"), F.min("moa").alias("moa")
    )


@query("a16_treatment_summary", """select l_suppkey as field, count(*) as n_images, count(distinct (l_orderkey, l_linenumber)) as n_wells,
  count(distinct l_returnflag || l_linestatus) as n_plates, min(l_returnflag) as l_returnflag from lineitem group by 1""")
def _(t):
    c = t.lineitem.withColumn("plate", F.concat("l_returnflag", "l_linestatus")).withColumnRenamed("l_suppkey", "field")
    return pr.treatment_summary(c, ["field"], ["l_orderkey", "l_linenumber"], "plate", ["l_returnflag"])


@query("a17_class_distribution", """select r_name as moa, count(distinct n_name) as n_compounds, count(*) as n_fields from supplier
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""")
def _(t):
    return pr.class_distribution(treatments(t), "moa", "compound")


@query("p08_feature_columns", """select column_name as feature from (describe select * from lineitem) where column_type in ('DOUBLE','BIGINT','INTEGER')
  and column_name not in ('l_orderkey','l_partkey','l_suppkey','l_linenumber')""")
def _(t):
    cols = pr.feature_columns(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return t.lineitem.select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature")).distinct()


@query("p12_stable_features", f"""with {Z} select feature, {r('avg((z is null)::int)')} as missing, {r('var_pop(coalesce(z, 0))')} as variance from zs
  group by feature having avg((z is null)::int) < 0.5 and var_pop(coalesce(z, 0)) > 0.01""")
def _(t):
    s = pr.stable_features(z_values(t), "z")
    return s.select("feature", rnd("missing").alias("missing"), rnd("variance").alias("variance"))


@query("m03_feature_correlations", "with x as (select " + ", ".join(f"corr(a.{a}, a.{b}) as c_{i}_{j}" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j)
       + " from (select l_quantity as quantity, l_extendedprice as price, l_extendedprice * l_discount as reduction, l_extendedprice * (1 + l_tax) as charge from lineitem) a) " + " union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'c_{i}_{j}')} as r from x" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j))
def _(t):
    return pr.feature_correlations(cells(t), FEATURES).select("a", "b", rnd("r").alias("r"))


#: 500 features of each embedding: entries, products with an entry further on, and scaled or shifted near copies.
WIDE = [(f"f{k}_{i}", k, i) for k in range(8) for i in range(1, 65)][:500]
WIDE_SQL = "select vec_id, " + ", ".join(
    [f"embedding[{i}]::double as f0_{i}", f"embedding[{i}]::double * embedding[{i % 64 + 1}]::double as f1_{i}", f"embedding[{i}]::double * 3 + embedding[{i % 64 + 1}]::double * 0.5 as f2_{i}",
     f"embedding[{i}]::double * embedding[{i}]::double as f3_{i}", f"abs(embedding[{i}]::double) as f4_{i}", f"embedding[{i}]::double * 2 - embedding[{(i + 6) % 64 + 1}]::double as f5_{i}",
     f"embedding[{i}]::double * embedding[{(i + 10) % 64 + 1}]::double as f6_{i}", f"embedding[{i}]::double * 5 + 1 as f7_{i}"][k] for _, k, i in WIDE
) + " from embeddings"
SELECTED = f"""wide as ({WIDE_SQL}), lg as (unpivot wide on columns(* exclude vec_id) into name feature value v), nm as (select unnest({[n for n, _, _ in WIDE]}) as feature, unnest(range(0, {len(WIDE)})) as i),
 ct as materialized (select vec_id, i, feature, v - avg(v) over (partition by feature) as c from lg join nm using (feature)), vr as materialized (select i, feature, sum(c * c) as ss, avg(c * c) as variance from ct group by 1, 2),
 cr as (select a.i as i, b.i as j, sum(a.c * b.c) as s from ct a join ct b on a.vec_id = b.vec_id and a.i < b.i group by 1, 2), ov as materialized (select cr.i, cr.j, p.ss < q.ss as lower_i from cr join vr p on p.i = cr.i join vr q on q.i = cr.j where abs(s / sqrt(p.ss * q.ss)) > 0.95),
 nb as materialized (select nm.i, coalesce(list(struct_pack(j := j, l := lower_i)) filter (j is not null), []) as js from nm left join ov on ov.i = nm.i group by 1),
 st as (select 0 as i, []::bigint[] as gone union all select st.i + 1, case when list_contains(gone, st.i) then gone else list_concat(list_concat(gone, list_transform(list_filter(js, lambda x: not x.l and not list_contains(gone, x.j)), lambda x: x.j)),
   case when len(list_filter(js, lambda x: x.l and not list_contains(gone, x.j))) > 0 then [st.i::bigint] else []::bigint[] end) end from st join nb on nb.i = st.i)"""


def wide_features(t: Tables) -> DataFrame:
    e = lambda i: F.col("embedding")[(i - 1) % 64].cast("double")
    made = lambda k, i: [lambda: e(i), lambda: e(i) * e(i + 1), lambda: e(i) * 3 + e(i + 1) * 0.5, lambda: e(i) * e(i), lambda: F.abs(e(i)),
                         lambda: e(i) * 2 - e(i + 7), lambda: e(i) * e(i + 11), lambda: e(i) * 5 + 1][k]()
    return t.embeddings.select("vec_id", *[made(k, i).alias(n) for n, k, i in WIDE])


@query("m03_uncorrelated_features", f"with recursive {SELECTED} select feature, {r('variance')} as variance from vr, (select gone from st order by i desc limit 1) where not list_contains(gone, vr.i)")
def _(t):
    kept = gm.select_uncorrelated(wide_features(t), [n for n, _, _ in WIDE])
    return kept.select("feature", rnd("variance").alias("variance"))


@query("m03_correlated_pairs", f"with recursive {SELECTED} select nm.feature as a, o.feature as b from ov join nm on nm.i = ov.i join nm o on o.i = ov.j")
def _(t):
    return gm.correlated_pairs(wide_features(t), [n for n, _, _ in WIDE], 0.95).select("a", "b")


@query("j10_unified_table", """select l_orderkey, l_linenumber, l_suppkey, case when l_tax is null or c is null or lower(c) in ('', 'dmso') then 'DMSO' else c end as compound,
  case when c is null or lower(c) in ('', 'dmso') then 'DMSO' else coalesce(nullif(m, ''), 'unknown') end as moa,
  case when c is null or lower(c) in ('', 'dmso') then 0.0 else d end as concentration, (c is null or lower(c) in ('', 'dmso')) as is_control
  from lineitem left join (select s_suppkey, case when s_acctbal < 0 then 'dmso' when s_acctbal < 500 then null else s_name end as c,
    case when s_acctbal > 8000 then '' else 'class' || s_nationkey end as m, s_acctbal as d from supplier) on s_suppkey = l_suppkey""")
def _(t):
    meta = t.supplier.select(
        F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") < 0, F.lit("dmso")).when(F.col("s_acctbal") < 500, None).otherwise(F.col("s_name")).alias("compound"),
        F.when(F.col("s_acctbal") > 8000, F.lit("")).otherwise(F.concat(F.lit("class"), F.col("s_nationkey").cast("string"))).alias("moa"), F.col("s_acctbal").alias("concentration"),
    )
    return pr.unified_fields(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), meta, ["l_suppkey"])


@query("j11_treatment_lookup", """with last as (select o_custkey, arg_max(o_orderpriority, o_orderkey) as p, arg_max(o_totalprice, o_orderkey) as v from orders group by 1)
  select c_custkey, c_nationkey, coalesce(p, 'unknown') as priority, coalesce(v, -1.0) as price from customer left join last on c_custkey = o_custkey""")
def _(t):
    table = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    return pr.join_treatments(t.customer.select("c_custkey", "c_nationkey"), table, ["c_custkey"], "o_orderkey", {"priority": F.lit("unknown"), "price": F.lit(-1.0)})


@query("a74_class_heatmap", f"with {Z} select moa, feature, {r('avg(z)')} as value, count(distinct field) as n from zs group by 1, 2 having count(distinct field) >= 2")
def _(t):
    h = pr.class_heatmap(z_values(t), "moa", ["field"])
    return h.select("moa", "feature", rnd("value").alias("value"), "n")


DEV = Z + """, dev as (select compound, feature, m - c as deviation from (select compound, feature, avg(z) as m from zs group by 1, 2)
   join (select feature, avg(z) as c from zs where is_control group by 1) using (feature)), size as (select compound, avg(abs(deviation)) as s from dev group by 1)"""


@query("a75_compound_deviation", f"with {DEV} select compound, feature, {r('deviation')} as deviation, {r('s')} as mean_abs_deviation from dev join size using (compound)")
def _(t):
    d = pr.compound_deviation(z_values(t), "compound", "is_control")
    return d.select("compound", "feature", rnd("deviation").alias("deviation"), rnd("mean_abs_deviation").alias("mean_abs_deviation"))


@query("a79_completeness", """with e as (select s_suppkey as field, l as plate from supplier, (select distinct l_returnflag || l_linestatus as l from lineitem)),
  f as (select distinct l_returnflag || l_linestatus as plate, l_suppkey as field from lineitem where l_quantity > 49 and l_discount > 0.08)
  select plate, ne as n_expected, coalesce(nf, 0) as n_found, coalesce(nf, 0) >= ne as complete from (select plate, count(distinct field) as ne from e group by 1)
  full join (select plate, count(distinct field) as nf from f group by 1) using (plate)""")
def _(t):
    plates = cells(t).agg(F.collect_set("plate").alias("plates"))
    expected = t.supplier.select(F.col("s_suppkey").alias("field")).transform(attach, plates).select("field", F.explode("plates").alias("plate"))
    found = cells(t).where((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.08))
    return pr.expected_vs_found(expected, found, ["plate"], ["field"])


# --- tests against controls and between classes ------------------------------------------------

MOM = VALS + """, mom as (select compound, moa, is_control, feature, value from vals)"""
PVC = MOM + """, a as (select compound, feature, count(*) as n, avg(value) as m, var_samp(value) as v from mom where not is_control group by 1, 2),
 b as (select feature, count(*) as n, avg(value) as m, var_samp(value) as v from mom where is_control group by 1),
 raw as (select compound, feature, a.n as n_a, b.n as n_b, a.m - b.m as diff, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) as t,
   pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) as dof,
   (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) as cohens_d from a join b using (feature)),
 tests as (select *, """ + t_tail("t", "dof") + " as p from raw)"


def control_tests(t: Tables) -> DataFrame:
    return inf.versus_control(field_values(t), "compound", F.col("is_control"))


def _test_cols(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n_a", "n_b", rnd("diff").alias("diff"), rnd("t").alias("t"), rnd("dof", 4).alias("dof"), rnd("cohens_d").alias("cohens_d"), rnd("p").alias("p"))


TEST_COLS = f"n_a, n_b, {r('diff')} as diff, {r('t')} as t, {r('dof', 4)} as dof, {r('cohens_d')} as cohens_d, {r('p')} as p"


@query("a46_welch_vs_control", f"with {PVC} select compound, feature, {TEST_COLS} from tests")
def _(t):
    return _test_cols(control_tests(t), "compound", "feature")


SCORE = PVC + """, nf as (select compound, count(*) as f from tests group by 1), score as (select compound, any_value(f) as n_features, count(*) filter (p < 0.05 / f) as n_significant,
   count(*) filter (p < 0.05 / f) / any_value(f) as score, max(abs(cohens_d)) as max_abs_d, avg(abs(cohens_d)) as mean_abs_d from tests join nf using (compound) group by 1)"""


@query("a47_perturbation_scores", f"with {SCORE} select compound, n_features, n_significant, {r('score')} as score, {r('max_abs_d')} as max_abs_d, {r('mean_abs_d')} as mean_abs_d from score")
def _(t):
    s = inf.perturbation_scores(control_tests(t), "compound")
    return s.select("compound", "n_features", "n_significant", rnd("score").alias("score"), rnd("max_abs_d").alias("max_abs_d"), rnd("mean_abs_d").alias("mean_abs_d"))


@query("k02_top_perturbed", f"with {SCORE} select compound, {r('max_abs_d')} as max_abs_d from score order by {r('max_abs_d')} desc, compound limit 20")
def _(t):
    s = inf.perturbation_scores(control_tests(t), "compound").select("compound", rnd("max_abs_d").alias("max_abs_d"))
    return s.orderBy(F.desc("max_abs_d"), "compound").limit(20)


@query("a50_active_by_class", f"""with {SCORE} select moa, count(*) as n_active, {r('avg(score)')} as mean_score from score join (select distinct compound, moa from treat) using (compound)
  where mean_abs_d > 0.05 group by 1""")
def _(t):
    s = inf.perturbation_scores(control_tests(t), "compound").where(F.col("mean_abs_d") > 0.05)
    classes = treatments(t).select("compound", "moa").distinct()
    return s.join(classes, "compound").groupBy("moa").agg(F.count(F.lit(1)).alias("n_active"), rnd(F.avg("score")).alias("mean_score"))


def otsu_sql(source: str, value: str, keys: str = "") -> str:
    """CTEs `thr(keys, threshold)` from a relation with column `value`."""
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    return f"""vc as (select {k}{value} as v, count(*) as n from {source} where {value} is not null group by all),
 pre as (select {k}v, sum(n) over w as ln, sum(n * v) over w as ls, sum(n * v * v) over w as lq, sum(n) over ({part}) as tn, sum(n * v) over ({part}) as ts,
   sum(n * v * v) over ({part}) as tq, lag(v) over ({part} order by v) as pv from vc window w as ({part} order by v rows between unbounded preceding and 1 preceding)),
 cand as (select {k}(v + pv) / 2 as threshold, round((lq - ls * ls / ln) + ((tq - lq) - (ts - ls) * (ts - ls) / (tn - ln)), 9) as sse, v from pre where ln > 0),
 thr as (select {k}arg_min(threshold, (sse, v)) as threshold from cand {'group by ' + keys if keys else ''})"""


@query("w04_otsu_threshold", f"with {otsu_sql('lineitem', 'l_quantity', 'l_returnflag')} select l_returnflag, {r('threshold')} as threshold from thr")
def _(t):
    return inf.otsu(t.lineitem, ["l_returnflag"], "l_quantity").select("l_returnflag", rnd("threshold").alias("threshold"))


@query("p11_active_treatments", f"with {SCORE}, {otsu_sql('score', 'mean_abs_d')} select compound, {r('mean_abs_d')} as mean_abs_d from score, thr where mean_abs_d > threshold")
def _(t):
    s = inf.perturbation_scores(control_tests(t), "compound")
    cut = inf.otsu(s, [], "mean_abs_d")
    return s.transform(attach, cut).where(F.col("mean_abs_d") > F.col("threshold")).select("compound", rnd("mean_abs_d").alias("mean_abs_d"))


CVR = VALS + """, mom as (select moa, feature, value from vals),
 raw as (select x.moa, x.feature, x.n as n_a, (select count(*) from mom y where y.feature = x.feature and y.moa <> x.moa) as n_b, x.m as m1, x.v as v1,
   (select avg(value) from mom y where y.feature = x.feature and y.moa <> x.moa) as m2, (select var_samp(value) from mom y where y.feature = x.feature and y.moa <> x.moa) as v2
   from (select moa, feature, count(*) as n, avg(value) as m, var_samp(value) as v from mom group by 1, 2) x),
 cvr0 as (select moa, feature, n_a, n_b, m1 - m2 as diff, (m1 - m2) / sqrt(v1 / n_a + v2 / n_b) as t,
   pow(v1 / n_a + v2 / n_b, 2) / (pow(v1 / n_a, 2) / (n_a - 1) + pow(v2 / n_b, 2) / (n_b - 1)) as dof,
   (m1 - m2) / sqrt(((n_a - 1) * v1 + (n_b - 1) * v2) / (n_a + n_b - 2)) as cohens_d from raw),
 cvr as (select *, """ + t_tail("t", "dof") + " as p from cvr0)"


@query("a51_class_vs_rest", f"with {CVR} select moa, feature, {TEST_COLS}, p < 0.05 / 8 as significant from cvr")
def _(t):
    d = inf.bonferroni(inf.class_versus_rest(field_values(t), "moa"), ["moa"])
    return _test_cols(d, "moa", "feature", "significant")


@query("a51_class_vs_control", f"with {MOM.replace('as mom_', '')}, a as (select moa, feature, count(*) as n, avg(value) as m, var_samp(value) as v from mom where not is_control group by 1, 2),"
       " b as (select feature, count(*) as n, avg(value) as m, var_samp(value) as v from mom where is_control group by 1),"
       " c0 as (select moa, feature, a.n as n_a, b.n as n_b, a.m - b.m as diff, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) as t,"
       " pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) as dof,"
       " (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) as cohens_d from a join b using (feature)),"
       f" c1 as (select *, {t_tail('t', 'dof')} as p from c0) select moa, feature, {TEST_COLS} from c1")
def _(t):
    return _test_cols(inf.versus_control(field_values(t), "moa", F.col("is_control")), "moa", "feature")


def _biomarkers(t: Tables) -> DataFrame:
    vals = field_values(t)
    rest = inf.class_versus_rest(vals, "moa").withColumn("rest_sig", F.col("p") < 0.5)
    ctrl = inf.versus_control(vals, "moa", F.col("is_control")).select("moa", "feature", (F.col("p") < 0.5).alias("ctrl_sig"))
    return rest.join(ctrl, ["moa", "feature"]).withColumn("biomarker", F.col("rest_sig") & F.col("ctrl_sig"))


BIOM = CVR + """, b as (select feature, count(*) as n, avg(value) as m, var_samp(value) as v from vals where is_control group by 1),
 a as (select moa, feature, count(*) as n, avg(value) as m, var_samp(value) as v from vals where not is_control group by 1, 2),
 c0 as (select moa, feature, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) as t2, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) as dof2
   from a join b using (feature)), c1 as (select moa, feature, """ + t_tail("t2", "dof2") + """ as p2 from c0),
 biom as (select moa, feature, cohens_d, p < 0.5 and p2 < 0.5 as biomarker from cvr join c1 using (moa, feature))"""


@query("a52_biomarker_features", f"""with {BIOM} select moa, feature, {r('cohens_d')} as cohens_d, biomarker, row_number() over (partition by moa order by {r('abs(cohens_d)')} desc, feature) as rank
  from biom qualify rank <= 3""")
def _(t):
    b = _biomarkers(t).select("moa", "feature", rnd("cohens_d").alias("cohens_d"), "biomarker", rnd(F.abs("cohens_d")).alias("a"))
    return top_k(b, ["moa"], [F.desc("a"), F.col("feature")], 3).drop("a").withColumn("rank", F.col("rank").cast("long"))


@query("u02_biomarker_intersection", f"with {BIOM} select moa, feature from biom where biomarker")
def _(t):
    vals = field_values(t)
    rest = inf.class_versus_rest(vals, "moa").where(F.col("p") < 0.5).select("moa", "feature")
    ctrl = inf.versus_control(vals, "moa", F.col("is_control")).where(F.col("p") < 0.5).select("moa", "feature")
    return rest.intersect(ctrl)


@query("a48_dose_response", f"""with {VALS}, med as (select compound, feature, dose, quantile_cont(value, 0.5) as m from vals where not is_control group by all),
  rk as (select compound, feature, rank() over (partition by compound, feature order by dose) + (count(*) over (partition by compound, feature, dose) - 1) / 2 as rx,
    rank() over (partition by compound, feature order by m) + (count(*) over (partition by compound, feature, m) - 1) / 2 as ry from med),
  s as (select compound, feature, count(*) as n_doses, coalesce({scorr('rx', 'ry')}, 0) as rho from rk group by 1, 2 having count(*) >= 3),
  p as (select *, case when abs(rho) >= 1 - 1e-12 then 0 else {t_tail('(rho * sqrt((n_doses - 2) / (1 - rho * rho)))', '(n_doses - 2)')} end as p from s)
  select compound, feature, n_doses, {r('rho')} as rho, {r('p')} as p, abs(rho) > 0.7 and p < 0.05 as monotone from p""")
def _(t):
    d = inf.dose_response(field_values(t).where(~F.col("is_control")), ["compound", "feature"], "dose")
    return d.select("compound", "feature", "n_doses", rnd("rho").alias("rho"), rnd("p").alias("p"), "monotone")


@query("j13_tests_with_effect", f"with {PVC} select compound, feature, {r('t')} as t, {r('cohens_d')} as cohens_d from raw")
def _(t):
    """Test and effect size come from the same aggregation, so the merge needs no join."""
    return control_tests(t).select("compound", "feature", rnd("t").alias("t"), rnd("cohens_d").alias("cohens_d"))


CATS = [("price", "Intensity"), ("quantity", "AreaShape"), ("charge", "Texture")]


@query("f05_feature_category", f"with {VALS} select distinct feature, case when contains(feature, 'price') then 'Intensity' when contains(feature, 'quantity') then 'AreaShape' when contains(feature, 'charge') then 'Texture' else 'Other' end as category from vals")
def _(t):
    return field_values(t).select("feature", first_match(F.col("feature"), CATS, "Other").alias("category")).distinct()


@query("m11_mergeable_mean", f"select l_suppkey, count(*) as area, {r('avg(l_quantity)')} as quantity, {r('avg(l_discount)')} as discount from lineitem group by 1")
def _(t):
    part = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("area"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    m = merge_tile_features(part, ["l_suppkey"], "area", ["quantity", "discount"])
    return m.select("l_suppkey", "area", rnd("quantity").alias("quantity"), rnd("discount").alias("discount"))
