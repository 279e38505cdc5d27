"""Cell-by-gene analytics: expression from line items x part brands, spatial statistics on the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.operators import expression as ex
from cytomill.operators import inference as inf
from cytomill.operators import masks as mk
from cytomill.operators import matching as mt
from cytomill.operators import overlap as ov
from cytomill.operators import spatial as sp
from cytomill.operators.ordered import attach, join_on
from cytomill.plans.regions import CLIP, RUNOV, SIDE, assigned, pairs
from cytomill.plans.registry import Tables, query, r, rnd, scorr, t_tail, z_tail
from cytomill.plans.shapes import runs

# marker sets used by the typing and signature queries
MARKERS = {
    "Alveolar": ["Brand#1", "Brand#2", "Brand#3"],
    "Immune": ["Brand#4", "Brand#5"],
    "Stromal": ["Brand#6", "Brand#7", "Brand#8", "Brand#99"],
    "Tumor": ["Brand#2", "Brand#9"],
    "Empty": ["Brand#98"],
}
MK_SQL = "mk as (select * from (values " + ", ".join(f"('{s}', '{g}')" for s, gs in MARKERS.items() for g in gs) + ") m(set, gene)), types as (select * from (values " + ", ".join(
    f"('{s}', {i})" for i, s in enumerate(MARKERS)) + ") t(set, o))"


def marker_table(t: Tables) -> DataFrame:
    """(set, gene) from a literal map, as an expression: no driver-side rows."""
    m = F.create_map(*[x for s, gs in MARKERS.items() for x in (F.lit(s), F.array(*[F.lit(g) for g in gs]))])
    return t.spark.range(1).select(F.explode(m).alias("set", "genes")).select("set", F.explode("genes").alias("gene"))


def expr(t: Tables) -> DataFrame:
    """(cell_id = order, gene = brand, cnt)."""
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")
    ).agg(F.count(F.lit(1)).alias("cnt"))


def genes(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("gene")).distinct()


EXPR = """ex as (select l_orderkey as cell_id, p_brand as gene, count(*) as cnt from lineitem join part on l_partkey = p_partkey group by 1, 2), gs as (select distinct p_brand as gene from part),
 cl as (select o_orderkey as cell_id, o_orderstatus as grp, o_orderpriority as region, o_totalprice as price from orders)"""


def cells(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("group"), F.col("o_orderpriority").alias("region"), F.col("o_totalprice").alias("price"))


@query("a18_build_expression", f"with {CLIP} select image_id * 1000 + label as cell_id, s_name as gene, count(*) as cnt from asg join supplier on s_suppkey = l_suppkey where label <> 0 group by 1, 2")
def _(t):
    a = assigned(t).withColumn("cell_id", F.when(F.col("label") == 0, 0).otherwise(F.col("image_id") * 1000 + F.col("label")))
    a = a.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("gene")), "l_suppkey")
    return ex.count_expression(a, t.supplier.select(F.col("s_name").alias("gene")))


@query("j05_rekey_expression", f"with {EXPR} select o_custkey as label, gene, sum(cnt)::bigint as cnt from ex join orders on o_orderkey = cell_id where o_custkey <> 0 group by 1, 2")
def _(t):
    return ex.rekey_expression(expr(t), t.orders.select(F.col("o_orderkey").alias("cell_id"), F.col("o_custkey").alias("label")), "cell_id", "label")


@query("a21_gene_detection", f"""with {EXPR}, per as (select grp, cell_id, count(*) as g, sum(cnt)::double as c from ex join cl using (cell_id) group by 1, 2)
   select grp as group_name, count(*) as n_cells, {r('avg(g)')} as mean_genes, {r('avg(c)')} as mean_transcripts, quantile_cont(g::double, 0.5) as median_genes, quantile_cont(c, 0.5) as median_transcripts from per group by 1""")
def _(t):
    d = ex.gene_detection(expr(t).join(cells(t), "cell_id").withColumnRenamed("group", "group_name"), ["group_name"])
    return d.withColumn("mean_genes", rnd("mean_genes")).withColumn("mean_transcripts", rnd("mean_transcripts"))


SCORED = EXPR + ", " + MK_SQL + """, kn as (select set, gene from mk where gene in (select gene from gs)), sz as (select set, count(*) as size from kn group by 1),
 sc as (select cell_id, set, o, coalesce((select sum(cnt) from ex join kn using (gene) where ex.cell_id = cl.cell_id and kn.set = types.set), 0) / coalesce((select size from sz where sz.set = types.set), 1) as score from cl, types),
 zs as (select *, coalesce((score - avg(score) over w) / nullif(stddev_pop(score) over w, 0), 0) as z from sc window w as (partition by cell_id))"""


@query("a44_score_cell_types", f"with {SCORED} select cell_id, arg_max(set, (score, -o)) as cell_type, {r('max(z)', 5)} as max_zscore from zs group by 1")
def _(t):
    s = ex.score_cell_types(expr(t), marker_table(t), genes(t), cells(t), list(MARKERS))
    return s.withColumn("max_zscore", rnd("max_zscore", 5))


@query("w06_within_group_zscore", f"with {SCORED} select o, count(*) as n, {r('avg(z)', 5)} as mean_z, {r('sum(z * z)', 4)} as sum_z2 from zs group by 1")
def _(t):
    from pyspark.sql import Window as W
    full = cells(t).select("cell_id").withColumn("set", F.explode(F.array(*[F.lit(n) for n in MARKERS])))
    known = marker_table(t).join(genes(t), "gene", "left_semi")
    size = known.groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    s = expr(t).join(known, "gene").groupBy("cell_id", "set").agg(F.sum("cnt").alias("s")).join(size, "set")
    full = full.join(s, ["cell_id", "set"], "left").withColumn("score", F.coalesce(F.col("s") / F.col("size"), F.lit(0.0)))
    w = W.partitionBy("cell_id")
    z = F.coalesce((F.col("score") - F.avg("score").over(w)) / F.nullif(F.stddev_pop("score").over(w), F.lit(0.0)), F.lit(0.0))
    o = F.element_at(F.create_map(*[x for i, n in enumerate(MARKERS) for x in (F.lit(n), F.lit(i))]), F.col("set"))
    return full.withColumn("z", z).groupBy(o.alias("o")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("z"), 5).alias("mean_z"), rnd(F.sum(F.col("z") * F.col("z")), 4).alias("sum_z2"))


@query("a43_signature_scores", f"with {SCORED}, st as (select set, avg(score) as m, stddev_samp(score) as sd from sc group by 1) select cell_id, set, {r('score')} as score, {r('coalesce((score - m) / nullif(sd, 0), 0)')} as zscore from sc join st using (set)")
def _(t):
    s = ex.signature_scores(expr(t), marker_table(t), genes(t), cells(t), list(MARKERS))
    return s.select("cell_id", "set", rnd("score").alias("score"), rnd("zscore").alias("zscore"))


DE = EXPR + """, full_ as (select gene, cell_id, grp, coalesce(cnt, 0)::double as x from gs cross join (select * from cl where grp in ('F', 'O')) c left join ex using (gene, cell_id)),
 rk as (select gene, grp, x, rank() over (partition by gene order by x) + (count(*) over (partition by gene, x) - 1) / 2 as rnk, count(*) over (partition by gene, x) as tie from full_),
 u0 as (select gene, count(*) filter (grp = 'F') as na, count(*) filter (grp = 'O') as nb, sum(rnk) filter (grp = 'F') as ra, sum(tie::double * tie - 1) as ties, avg(x) filter (grp = 'F') as mean_a, avg(x) filter (grp = 'O') as mean_b,
   avg((x > 0)::int) filter (grp = 'F') as pct_a, avg((x > 0)::int) filter (grp = 'O') as pct_b, var_samp(x) filter (grp = 'F') as va, var_samp(x) filter (grp = 'O') as vb from rk group by 1),
 u1 as (select *, ra - na * (na + 1) / 2 as u, (greatest(ra - na * (na + 1) / 2, na * nb - (ra - na * (na + 1) / 2)) - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1.0)))) as z from u0),
 u2 as (select *, case when z > 0 then least(""" + z_tail("z") + """, 1) else 1 end as p, log2((mean_a + 1e-6) / (mean_b + 1e-6)) as log2fc from u1),
 de as (select *, least(p * count(*) over () / row_number() over (order by p, gene), 1) as p_adj from u2)"""
DE_COLS = ", ".join(f"{r(c)} as {c}" for c in ("mean_a", "mean_b", "pct_a", "pct_b", "log2fc"))


def de(t: Tables, method: str = "rank") -> DataFrame:
    return ex.differential_expression(expr(t), cells(t), "F", "O", genes(t), method=method)


@query("a41_differential_expression", f"with {DE} select gene, {DE_COLS}, u as stat, {r('z')} as z, {r('p')} as p_value, {r('p_adj')} as p_value_adj from de")
def _(t):
    d = de(t)
    return d.select("gene", *[rnd(c).alias(c) for c in ("mean_a", "mean_b", "pct_a", "pct_b", "log2fc")], "stat", rnd("z").alias("z"), rnd("p_value").alias("p_value"), rnd("p_value_adj").alias("p_value_adj"))


DT = DE + """, t0 as (select gene, (mean_a - mean_b) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) as t, (na + nb - 2)::double as dof from u0)"""


@query("a41_differential_expression_t", f"with {DT} select gene, {r('t', 5)} as stat, {r(t_tail('t', 'dof'))} as p_value from t0")
def _(t):
    return de(t, "t").select("gene", rnd("stat", 5).alias("stat"), rnd("p_value").alias("p_value"))


@query("w02_bh_monotone", f"with {DE}, m as (select gene, p, least(p * count(*) over () / row_number() over (order by p, gene), 1) as raw, row_number() over (order by p, gene) as k from u2) select gene, {r('min(raw) over (order by k desc)')} as p_adj from m")
def _(t):
    d = de(t).select("gene", "p_value")
    return inf.bh_adjust(d, [], "p_value", "gene", "p_adj", monotone=True).select("gene", rnd("p_adj").alias("p_adj"))


@query("k12_volcano_labels", f"with {DE} select gene, case when p_adj < 0.9 and log2fc > 0 then 'up' when p_adj < 0.9 and log2fc < 0 then 'down' else 'ns' end as direction, {r('p_adj')} as p_value_adj from de order by {r('p_adj')}, gene limit 10")
def _(t):
    d = de(t).select("gene", F.when((F.col("p_value_adj") < 0.9) & (F.col("log2fc") > 0), "up").when((F.col("p_value_adj") < 0.9) & (F.col("log2fc") < 0), "down").otherwise("ns").alias("direction"), rnd("p_value_adj").alias("p_value_adj"))
    return d.orderBy("p_value_adj", "gene").limit(10)


@query("w05_average_ranks", """select l_returnflag, l_quantity, count(*) as n, min(rk) + (count(*) - 1) / 2 as rank, any_value(tot) as n_group from (select l_returnflag, l_quantity, rank() over (partition by l_returnflag order by l_quantity) as rk,
   count(*) over (partition by l_returnflag) as tot from lineitem) group by 1, 2""")
def _(t):
    from cytomill.operators.ordered import average_ranks
    return average_ranks(t.lineitem, ["l_returnflag"], "l_quantity")


@query("a42_correlate_with_morphology", f"""with {EXPR}, f as (select gene, cell_id, coalesce(cnt, 0) as x, price as y from gs cross join cl left join ex using (gene, cell_id)),
   q as (select gene, rank() over (partition by gene order by x) + (count(*) over (partition by gene, x) - 1) / 2 as rx, rank() over (partition by gene order by y) + (count(*) over (partition by gene, y) - 1) / 2 as ry from f),
   s as (select gene, count(*)::double as n, {scorr('rx', 'ry')} as rho from q group by 1)
   select gene, n, {r('rho')} as rho, {r(t_tail('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)'))} as p_value from s""")
def _(t):
    s = ex.spearman_with_feature(expr(t), cells(t).select("cell_id", F.col("price").alias("value")))
    return s.select("gene", "n", rnd("rho").alias("rho"), rnd("p_value").alias("p_value"))


@query("a40_regional_means", f"with {EXPR}, n as (select region, count(*) as n_cells from cl group by 1 having count(*) >= 5) select region, gene, any_value(n_cells) as n_cells, {r('sum(cnt) / any_value(n_cells)')} as mean, {r('count(*) / any_value(n_cells)')} as pct from ex join cl using (cell_id) join n using (region) group by 1, 2")
def _(t):
    return ex.regional_means(expr(t), cells(t), genes(t)).select("region", "gene", "n_cells", rnd("mean").alias("mean"), rnd("pct").alias("pct"))


NORM = EXPR + ", nrm as (select cell_id, gene, cnt, ln(1 + cnt * 1e4 / sum(cnt) over (partition by cell_id)) as value from ex), disp as (select gene, sum(value) / n as mean, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1) as variance from nrm, (select count(*)::double as n from cl) group by gene, n)"


@query("m04_normalize_log", f"with {NORM} select cell_id, gene, cnt, {r('value')} as value from nrm")
def _(t):
    return ex.normalize_log(expr(t)).select("cell_id", "gene", "cnt", rnd("value").alias("value"))


def _dispersion(t: Tables) -> DataFrame:
    return ex.gene_dispersion(ex.normalize_log(expr(t)), cells(t).agg(F.count(F.lit(1)).alias("n")))


@query("m05_highly_variable", f"""with {NORM}, b as (select gene, mean, variance / mean as d, coalesce(least(floor((mean - min(mean) over ()) / nullif((max(mean) over () - min(mean) over ()) / 5, 0)), 4), 0)::bigint as bin from disp where mean > 0),
   z as (select gene, bin, {r('mean')} as mean, round(coalesce((d - avg(d) over (partition by bin)) / nullif(stddev_samp(d) over (partition by bin), 0), 0), 5) as dispersion_z from b) select * from z order by dispersion_z desc, gene limit 10""")
def _(t):
    h = ex.highly_variable(_dispersion(t), 10, bins=5)
    return h.select("gene", "bin", rnd("mean").alias("mean"), F.round("dispersion_z", 5).alias("dispersion_z"))


@query("a73_marker_means", f"with {EXPR}, n as (select region, count(*) as n from cl group by 1) select region as cell_type, gene, {r('sum(cnt) / any_value(n)')} as mean from ex join cl using (cell_id) join n using (region) group by 1, 2")
def _(t):
    return ex.marker_means(expr(t), cells(t).withColumnRenamed("region", "cell_type")).withColumn("mean", rnd("mean"))


@query("a73_typing_agreement", f"with a as (select doc_id, quality as k from labels) select count(*) as n_cells, {r('avg((k = toxic)::int)')} as agreement from a join labels using (doc_id)")
def _(t):
    a = t.labels.select("doc_id", F.col("quality").alias("kind"))
    b = t.labels.select("doc_id", F.col("toxic").alias("kind"))
    return ex.agreement(a, b, "doc_id", "kind").withColumn("agreement", rnd("agreement"))


@query("k05_heatmap_genes", f"with {EXPR}, s as (select gene, round(sqrt((sum(cnt * cnt) - sum(cnt) * sum(cnt) / n) / (n - 1)), 6) as std from ex, (select count(*)::double as n from cl) group by gene, n), top as (select * from s order by std desc, gene limit 5) select cell_id, gene, {r('ln(1 + cnt)')} as value from ex join top using (gene)")
def _(t):
    top = ex.top_genes_by_spread(expr(t), cells(t).agg(F.count(F.lit(1)).alias("n")), 5)
    return expr(t).join(F.broadcast(top.select("gene")), "gene").select("cell_id", "gene", rnd(F.log1p("cnt")).alias("value"))


@query("u04_marker_overlap", f"with {EXPR}, {MK_SQL}, top as (select gene from ex group by 1 order by sum(cnt) desc, gene limit 10) select set, count(top.gene) as n_overlap from mk left join top using (gene) group by 1")
def _(t):
    top = expr(t).groupBy("gene").agg(F.sum("cnt").alias("s")).orderBy(F.desc("s"), "gene").limit(10).select("gene", F.lit(1).alias("hit"))
    return marker_table(t).join(top, "gene", "left").groupBy("set").agg(F.count("hit").alias("n_overlap"))


@query("a72_data_exploration", f"with {EXPR} select gene, sum(cnt)::bigint as total, {r('count(*) / (select count(*) from cl)')} as detection_rate from ex group by 1 order by total desc, gene limit 20")
def _(t):
    n = cells(t).agg(F.count(F.lit(1)).alias("n"))
    g = expr(t).groupBy("gene").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("k")).transform(attach, n)
    return g.select("gene", "total", rnd(F.col("k") / F.col("n")).alias("detection_rate")).orderBy(F.desc("total"), "gene").limit(20)


@query("a72_sparsity", f"with {EXPR} select count(*) as n_entries, {r('1 - count(*) / ((select count(*) from cl)::double * (select count(*) from gs))')} as sparsity from ex")
def _(t):
    n = cells(t).agg(F.count(F.lit(1)).alias("n")).transform(attach, genes(t).agg(F.count(F.lit(1)).alias("g")))
    return expr(t).agg(F.count(F.lit(1)).alias("n_entries")).transform(attach, n).select("n_entries", rnd(1 - F.col("n_entries") / (F.col("n").cast("double") * F.col("g"))).alias("sparsity"))


# --- spatial: embeddings as cells, first two components as coordinates ---------------------------

PT = """pt_ as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, label from embeddings),
 ed as (select a.id as src, b.id as dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist from pt_ a join pt_ b on a.id <> b.id
   qualify row_number() over (partition by a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) <= 6),
 sx as (select vec_id as cell_id, 'g' || i as gene, floor(greatest(embedding[i] * 20, 0))::bigint as cnt from embeddings, (select unnest(range(3, 65)) as i) where floor(greatest(embedding[i] * 20, 0)) > 0)"""


def spots(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def spot_expr(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("cell_id"), F.posexplode(F.expr("slice(embedding, 3, size(embedding) - 2)")).alias("i", "v"))
    c = F.floor(F.greatest(F.col("v") * 20, F.lit(0.0)))
    return e.select("cell_id", F.concat(F.lit("g"), (F.col("i") + 3).cast("string")).alias("gene"), c.cast("long").alias("cnt")).where("cnt > 0")


@query("j14_knn_graph", f"with {PT} select src, dst, {r('dist')} as dist from ed")
def _(t):
    return sp.knn_edges(spots(t), 6).withColumn("dist", rnd("dist"))


MORAN = PT + """, n as (select count(*)::double as n from pt_), w as (select count(*)::double as w from ed), s2 as (select sum(c * c)::double as s2 from (select count(*) as c from ed group by src)),
 full_ as (select gene, id, coalesce(cnt, 0)::double as x from (select distinct gene from sx) cross join pt_ left join sx on sx.cell_id = pt_.id and sx.gene = gene_.gene),
 z as (select gene, id, x - avg(x) over (partition by gene) as z from full_),
 mo as (select gene, sum(z * z) as zz, sum(z * z * z * z) as z4 from z group by 1), cr as (select a.gene, sum(a.z * b.z) as c from ed join z a on a.id = src join z b on b.id = dst and b.gene = a.gene group by 1),
 mi as (select gene, n * c / (w * zz) as i, -1 / (n - 1) as e, (n * ((n * n - 3 * n + 3) * w - n * s2 + 3 * w * w) - (z4 / n) / ((zz / n) * (zz / n)) * ((n * n - n) * w - 2 * n * s2 + 6 * w * w)) / ((n - 1) * (n - 2) * (n - 3) * w * w) - 1 / ((n - 1) * (n - 1)) as v
   from mo join cr using (gene), n, w, s2)""".replace("(select distinct gene from sx) cross join", "(select distinct gene from sx) gene_ cross join").replace("select gene, id, coalesce", "select gene_.gene, id, coalesce")


def moran(t: Tables) -> DataFrame:
    return sp.morans_i(spot_expr(t), sp.knn_edges(spots(t), 6), spots(t))


@query("a37_morans_i", f"with {MORAN} select gene, {r('i')} as morans_i, {r('e')} as expected_i, {r('v', 9)} as variance, {r('case when v <= 0 then 0 else (i - e) / sqrt(v) end', 5)} as z_score from mi")
def _(t):
    return moran(t).select("gene", rnd("morans_i").alias("morans_i"), rnd("expected_i").alias("expected_i"), rnd("variance", 9).alias("variance"), rnd("z_score", 5).alias("z_score"))


@query("a39_spatially_variable", f"with {MORAN}, q as (select gene, i, case when v <= 0 then 0 else (i - e) / sqrt(v) end as z from mi) select gene, {r('i')} as morans_i, {r(z_tail('z'))} as p_value from q where {z_tail('z')} < 0.05")
def _(t):
    return sp.spatially_variable(moran(t)).select("gene", rnd("morans_i").alias("morans_i"), rnd("p_value").alias("p_value"))


@query("a38_getis_ord", f"""with {PT}, v as (select id, label::double as value from pt_), nb as (select src, dst from ed union all select id, id from pt_), g as (select count(*)::double as n, avg(value) as m, var_pop(value) as s2 from v),
   l as (select src, sum(value) as s, count(*)::double as wi from nb join v on v.id = dst group by 1) select src as id, {r('(s - m * wi) / sqrt(s2 * (n * wi - wi * wi) / (n - 1))')} as gi_star from l, g""")
def _(t):
    return sp.getis_ord(spots(t).select("id", F.col("label").alias("value")), sp.knn_edges(spots(t), 6)).withColumn("gi_star", rnd("gi_star"))


def _spot_de(t: Tables) -> DataFrame:
    groups = t.embeddings.select(F.col("vec_id").alias("cell_id"), F.when(F.col("label") < 5, "A").otherwise("B").alias("group"))
    e = spot_expr(t)
    return ex.differential_expression(e, groups, "A", "B", e.select("gene").distinct())


@query("a45_surrogate_biomarkers")
def _(t):
    return ex.surrogate_biomarkers(_spot_de(t), moran(t), 10).select("gene", "log2fc", "p_value_adj", "morans_i", "significance_score", "biomarker_score")


@query("j12_de_with_moran")
def _(t):
    return _spot_de(t).join(moran(t).select("gene", "morans_i"), "gene", "left").fillna(0.0, ["morans_i"])


CONT = RUNOV + """, nbt as (select a.*, (select count(*) from (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx) where exists (select 1 from pt b where b.image_id = a.image_id and b.y = a.y + d.dy and b.x = a.x + d.dx and b.label = a.label)) as s4 from pt a),
 nbp as (select a.*, (select count(*) from (values (1, 0), (-1, 0), (0, 1), (0, -1)) d(dy, dx) where exists (select 1 from pp b where b.image_id = a.image_id and b.y = a.y + d.dy and b.x = a.x + d.dx and b.label = a.label)) as s4 from pp a),
 ma as (select image_id, a_label, b_label from iou where iou >= 0.5), ca as (select ma.*, y, x from ma join nbt on nbt.image_id = ma.image_id and nbt.label = a_label and s4 < 4), cb as (select ma.*, y, x from ma join nbp on nbp.image_id = ma.image_id and nbp.label = b_label and s4 < 4),
 dd as (select image_id, a_label, b_label, d, 0 as dir from (select ca.image_id, ca.a_label, ca.b_label, ca.y, ca.x, min(sqrt((ca.y - cb.y) ** 2 + (ca.x - cb.x) ** 2)) as d from ca join cb using (image_id, a_label, b_label) group by all)
   union all select image_id, a_label, b_label, d, 1 from (select cb.image_id, cb.a_label, cb.b_label, cb.y, cb.x, min(sqrt((ca.y - cb.y) ** 2 + (ca.x - cb.x) ** 2)) as d from ca join cb using (image_id, a_label, b_label) group by all))"""


def contours(t: Tables) -> DataFrame:
    m = mt.strict_matches(pairs(t), [0.5]).select("image_id", "a_label", "b_label")

    def side(method: str, label: str) -> DataFrame:
        px = mk.outline_pixels(mk.run_pixels(runs(t, method))).withColumnRenamed("label", label)
        j = px.join(m, ["image_id", label])
        return j.select("image_id", "a_label", "b_label", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("y") * SIDE + F.col("x")).alias("id"))

    return sp.contour_distances(side("truth", "a_label"), side("pred", "b_label"), ["image_id", "a_label", "b_label"])


@query("j15_contour_distance", f"with {CONT} select image_id, a_label, b_label, {r('avg(d)')} as average from dd group by 1, 2, 3")
def _(t):
    return contours(t).select("image_id", "a_label", "b_label", rnd("average").alias("average"))


@query("j16_hausdorff", f"with {CONT} select image_id, a_label, b_label, {r('max(d)')} as hausdorff from dd group by 1, 2, 3")
def _(t):
    return contours(t).select("image_id", "a_label", "b_label", rnd("hausdorff").alias("hausdorff"))


@query("j24_segment_lookup", f"with {CLIP} select l_orderkey, l_linenumber, coalesce(o_custkey, 0) as track from asg left join orders on label = o_orderkey and label <> 0")
def _(t):
    look = t.orders.where("o_orderkey <> 0").select(F.col("o_orderkey").alias("label"), "o_custkey")
    return assigned(t).join(look, "label", "left").select("l_orderkey", "l_linenumber", F.coalesce("o_custkey", F.lit(0)).cast("long").alias("track"))


@query("j28_rank_inputs", f"with {EXPR} select gene, count(*) as n from ex join cl using (cell_id) group by 1 having count(*) >= 10")
def _(t):
    return expr(t).join(cells(t).select("cell_id"), "cell_id").groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
