"""Clustering evaluation and learning steps: embeddings with labels, suppliers with classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.operators import clusters as cl
from cytomill.operators import expression as ex
from cytomill.operators import forest as fo
from cytomill.operators import inference as inf
from cytomill.plans.profiling import CVR, field_values
from cytomill.session import cut
from cytomill.plans.registry import Tables, query, r, rnd
from cytomill.plans.transcriptomics import cells, expr, genes, marker_table, spots

# rows: line items; cluster = line number, class = return flag, group = ship status
LAB = "lab as (select l_linestatus as grp, l_linenumber::bigint as cluster, l_returnflag as class, l_suppkey from lineitem)"
CT = LAB + ", c as (select grp, cluster, class, count(*) as n from lab group by 1, 2, 3)"


def labelled(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_linestatus").alias("grp"), F.col("l_linenumber").cast("long").alias("cluster"), F.col("l_returnflag").alias("class"), "l_suppkey")


@query("a54_clustering_scores", f"""with {CT}, t as (select grp, sum(n)::double as t from c group by 1), a as (select grp, cluster, sum(n)::double as a, max(n)::double as top from c group by 1, 2), b as (select grp, class, sum(n)::double as b from c group by 1, 2),
   s as (select t.grp, t, (select sum(a * ln(a / t)) from a where a.grp = t.grp) / -t as ha, (select sum(b * ln(b / t)) from b where b.grp = t.grp) / -t as hb, (select sum(n * ln(n / t)) from c where c.grp = t.grp) / -t as hab,
     (select sum(a * (a - 1) / 2) from a where a.grp = t.grp) as pa, (select sum(b * (b - 1) / 2) from b where b.grp = t.grp) as pb, (select sum(n * (n - 1) / 2) from c where c.grp = t.grp) as pc, (select sum(top) from a where a.grp = t.grp) as top from t)
   select grp, t::bigint as n, {r('(ha + hb - hab) / ((ha + hb) / 2)')} as nmi, {r('(pc - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2))')} as ari, {r('top / t')} as purity from s""")
def _(t):
    s = cl.agreement_scores(cl.contingency(labelled(t), ["grp"], "cluster", "class"), ["grp"])
    return s.select("grp", "n", rnd("nmi").alias("nmi"), rnd("ari").alias("ari"), rnd("purity").alias("purity"))


@query("a55_matched_accuracy", f"""with {CT}, f as (select k.grp, k.cluster, q.class, coalesce(c.n, 0) as n from (select distinct grp, cluster from c) k cross join (select distinct class from c) q left join c using (grp, cluster, class))
   select x.grp, max(x.n + y.n + z.n) / (select sum(n) from c where c.grp = x.grp) as accuracy from f x join f y on y.grp = x.grp and y.cluster <> x.cluster join f z on z.grp = x.grp and z.cluster <> x.cluster and z.cluster <> y.cluster
   where x.class = 'A' and y.class = 'N' and z.class = 'R' group by x.grp""")
def _(t):
    return cl.matched_accuracy(cl.contingency(labelled(t), ["grp"], "cluster", "class"), ["grp"])


@query("a56_bootstrap_nmi")
def _(t):
    b = cl.bootstrap_counts(labelled(t), "cluster", "class", 1000)
    return cl.normal_interval(cl.agreement_scores(b, ["replicate"]), "nmi", cl.agreement_scores(cl.contingency(labelled(t), [], "cluster", "class"), []))


@query("a56_bootstrap_accuracy")
def _(t):
    b = cl.bootstrap_counts(labelled(t), "cluster", "class", 1000)
    whole = cl.contingency(labelled(t).withColumn("all", F.lit(0)), ["all"], "cluster", "class")
    return cl.normal_interval(cl.matched_accuracy(b, ["replicate"]), "accuracy", cl.matched_accuracy(whole, ["all"]))


@query("a57_enriched_clusters", f"""with {LAB}, c as (select cluster, class, count(*) as n from lab group by 1, 2), k as (select cluster, class, n, sum(n) over (partition by cluster)::bigint as ct from c qualify row_number() over (partition by cluster order by n desc, class) = 1)
   select cluster, class, n as k, {r('n / ct')} as share from k""")
def _(t):
    e = inf.enrichment(cl.contingency(labelled(t), [], "cluster", "class"), "cluster", "class")
    return e.select("cluster", "class", "k", rnd("share").alias("share"))


LOGC = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


@query("a57_enrichment_p", f"""with {LAB}, c as (select cluster, class, count(*) as n, sum(count(*)) over (partition by cluster)::bigint as ct, sum(count(*)) over (partition by class)::bigint as cc, sum(count(*)) over ()::bigint as t from lab group by 1, 2),
   k as (select * from c qualify row_number() over (partition by cluster order by n desc, class) = 1)
   select cluster, class, n as k, {r('least(1, list_sum(list_transform(range(n, least(ct, cc) + 1), lambda i: exp(' + LOGC('cc', 'i') + ' + ' + LOGC('(t - cc)', '(ct - i)') + ' - ' + LOGC('t', 'ct') + '))))', 5)} as p from k""")
def _(t):
    e = inf.enrichment(cl.contingency(labelled(t), [], "cluster", "class"), "cluster", "class")
    return e.select("cluster", "class", "k", rnd("p", 5).alias("p"))


@query("a58_majority_vote", f"with {LAB}, c as (select l_suppkey, cluster, count(*) as n from lab group by 1, 2) select l_suppkey, arg_max(cluster, (n, -cluster)) as cluster, sum(n)::bigint as n_fields, max(n) as n_agree from c group by 1")
def _(t):
    return cl.majority_cluster(labelled(t), ["l_suppkey"], "cluster")


SIL = """e as (select vec_id, label as c, embedding::double[] as v, list_sum(list_transform(embedding, lambda z: z::double * z::double)) as q from embeddings), x as (select vec_id, c, unnest(v) as v, generate_subscripts(v, 1) as i from e),
 m as (select c, i, avg(v) as m from x group by 1, 2), s as (select c, count(*)::double as n, avg(q) as mq from e group by 1), dot as (select vec_id, m.c as c2, sum(x.v * m.m) as d from x join m using (i) group by 1, 2),
 d as (select e.vec_id, e.c, c2, q - 2 * d + mq as dist, s.n from e join dot using (vec_id) join s on s.c = c2),
 ab as (select vec_id, sum(case when c = c2 then dist * n / (n - 1) end) as a, min(case when c <> c2 then dist end) as b from d group by 1)"""


@query("a59_silhouette", f"with {SIL} select {r('avg((b - a) / greatest(a, b))')} as silhouette from ab")
def _(t):
    return cl.silhouette_squared(t.embeddings, "embedding", "label").select(rnd("silhouette").alias("silhouette"))


@query("a60_mean_embedding", f"with x as (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) select label, i, {r('avg(v)')} as value from x group by 1, 2")
def _(t):
    m = cl.mean_vectors(t.embeddings, ["label"], "embedding")
    return m.select(F.col("label"), F.col("i").cast("long").alias("i"), rnd("value").alias("value"))


@query("a61_plate_summary", f"with p as (select l_returnflag as model, l_linestatus as plate, avg(l_quantity) as m from lineitem group by 1, 2) select model, {r('avg(m)')} as mean, {r('stddev_pop(m)')} as std from p group by 1")
def _(t):
    p = t.lineitem.groupBy(F.col("l_returnflag").alias("model"), "l_linestatus").agg(F.avg("l_quantity").alias("m"))
    return p.groupBy("model").agg(rnd(F.avg("m")).alias("mean"), rnd(F.stddev_pop("m")).alias("std"))


@query("m01_pca")
def _(t):
    out, _ = cl.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 50)
    return out.select("vec_id", "pc")


@query("m02_field_clustering")
def _(t):
    out, _ = cl.pca(t.embeddings.select("vec_id", "embedding", "label"), "embedding", 50)
    return cl.kmeans(out, "pc", 10).select("vec_id", "label", "cluster")


@query("m02_clustering_quality")
def _(t):
    out, _ = cl.pca(t.embeddings.select("vec_id", "embedding", F.col("label").cast("string").alias("label")), "embedding", 50)
    return cl.agreement_scores(cl.contingency(cl.kmeans(out, "pc", 10), [], "cluster", "label"), [])


@query("m06_cluster_and_annotate")
def _(t):
    """Normalise, keep variable genes, PCA + k-means per cell, markers per cluster, best marker set."""
    norm = cut(ex.normalize_log(expr(t)))
    top = ex.highly_variable(ex.gene_dispersion(norm, cells(t).agg(F.count(F.lit(1)).alias("n"))), 200, bins=20).select("gene")
    names = genes(t).join(top, "gene", "left_semi")
    order = [x["gene"] for x in names.orderBy("gene").collect()]  # at most 200 gene names
    wide = norm.join(F.broadcast(names), "gene").groupBy("cell_id").pivot("gene", order).agg(F.first("value")).fillna(0.0)
    got = cut(cl.kmeans_columns(cut(wide), order, 4).select("cell_id", "cluster"))
    tests = cut(ex.one_vs_rest_markers(expr(t).join(got.select("cell_id"), "cell_id", "left_semi"), got, genes(t)))
    from cytomill.operators.ordered import top_k
    best = top_k(tests.where("p_adj < 0.05"), ["cluster"], [F.col("p_adj"), F.col("gene")], 10)
    hits = best.join(marker_table(t), "gene").groupBy("cluster", "set").agg(F.count(F.lit(1)).alias("n"))
    pick = hits.groupBy("cluster").agg(F.max_by("set", F.struct("n", "set")).alias("cell_type"))
    size = got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"))
    return size.join(pick, "cluster", "left").fillna("Unknown", ["cell_type"])


@query("m07_phenotype_levels")
def _(t):
    """Two levels: coarse k-means on field features, then one k-means per coarse class, scored by class."""
    vals = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v"))
    coarse = cl.kmeans(vals, "v", 2).withColumnRenamed("cluster", "coarse")
    fine = [cl.kmeans(coarse.where(F.col("coarse") == c), "v", k).select("vec_id", "coarse", "cluster", "label") for c, k in ((0, 6), (1, 12))]
    both = fine[0].unionByName(fine[1])
    table = cl.contingency(both.withColumn("class", F.col("label").cast("string")), ["coarse"], "cluster", "class")
    return cl.matched_accuracy(table, ["coarse"])


@query("m08_object_classifier")
def _(t):
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    c = t.lineitem.select(*features, (F.col("l_extendedprice") > 50000).cast("double").alias("y"))
    return fo.forest_confusion(c, features, "y", trees=200, depth=10, seed=1)


@query("j19_project_prediction", "select l_orderkey, l_linenumber, coalesce(quality + 1, 0)::bigint as class from lineitem left join labels on doc_id = l_partkey")
def _(t):
    pred = t.labels.select(F.col("doc_id").alias("l_partkey"), (F.col("quality") + 1).alias("k"))
    return t.lineitem.join(pred, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("k", F.lit(0)).cast("long").alias("class"))


@query("j26_label_transfer", """with a as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, label from embeddings), n as (select a.id as src, b.label, row_number() over (partition by a.id order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) as k
   from a join a b on a.label >= 5 and b.label < 5), v as (select src, label, count(*) as c from n where k <= 5 group by 1, 2) select src as id, arg_max(label, (c, -label)) as label from v group by 1""")
def _(t):
    s = spots(t)
    return cl.knn_labels(s.where("label < 5"), s.where("label >= 5"), 5)


CONS = """v0 as (select l_suppkey as unit, s_nationkey % 5 as klass, ['q', 'p', 'd', 't'] as f, [avg(l_quantity), avg(l_extendedprice) / 1000, avg(l_discount) * 500, avg(l_tax) * 700] as v from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
 v1 as (select unit, klass, unnest(f) as f, unnest(v) as v from v0), z as (select unit, klass, f, (v - avg(v) over (partition by unit)) / stddev_pop(v) over (partition by unit) / 2 as z from v1),
 pr as (select a.klass as ka, b.klass as kb, sum(a.z * b.z) as c from z a join z b on a.f = b.f and a.unit < b.unit group by a.unit, b.unit, 1, 2)"""


def supplier_profiles(t: Tables) -> DataFrame:
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("unit")).agg(F.avg("l_quantity").alias("q"), (F.avg("l_extendedprice") / 1000).alias("p"), (F.avg("l_discount") * 500).alias("d"), (F.avg("l_tax") * 700).alias("t"))
    p = p.join(t.supplier.select(F.col("s_suppkey").alias("unit"), (F.col("s_nationkey") % 5).alias("klass")), "unit")
    return p.unpivot(["unit", "klass"], ["q", "p", "d", "t"], "feature", "value")


@query("a49_class_consistency", f"""with {CONS}, s as (select count(*) filter (ka = kb) as ni, count(*) filter (ka <> kb) as ne, avg(c) filter (ka = kb) as im, stddev_pop(c) filter (ka = kb) as isd, avg(c) filter (ka <> kb) as em, stddev_pop(c) filter (ka <> kb) as esd from pr)
   select (select count(*) from v0) as n_treatments, ni as n_intra, ne as n_inter, {r('im')} as intra_mean, {r('isd', 5)} as intra_std, {r('em')} as inter_mean, {r('esd', 5)} as inter_std, {r('im - em')} as separation, {r('(im - em) / sqrt((isd * isd + esd * esd) / 2)', 5)} as effect_size from s""")
def _(t):
    c = cl.class_consistency(supplier_profiles(t), "unit", "klass")
    return c.select("n_treatments", "n_intra", "n_inter", *[rnd(k, 5 if k in ("intra_std", "inter_std", "effect_size") else 6).alias(k) for k in ("intra_mean", "intra_std", "inter_mean", "inter_std", "separation", "effect_size")])


@query("j27_class_cohesion", f"with {CONS} select ka::bigint as klass, count(*) as n_pairs, {r('avg(c)')} as mean_correlation from pr where ka = kb group by 1")
def _(t):
    c = cl.class_cohesion(supplier_profiles(t), "unit", "klass")
    return c.select(F.col("klass").cast("long").alias("klass"), "n_pairs", rnd("mean_correlation").alias("mean_correlation"))


@query("a80_embedding_drift", f"""with e as (select vec_id, label, embedding::double[] as a, list_transform(embedding::double[], lambda v, i: v + case when i % 3 = 0 then 0.05 else 0 end) as b from embeddings)
   select x.label, {r('sqrt(avg(pow(list_cosine_similarity(x.a, y.a) - list_cosine_similarity(x.b, y.b), 2)))', 5)} as rmse from e x join e y on x.label = y.label group by 1""")
def _(t):
    e = t.embeddings.select("label", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    e = e.withColumn("b", F.transform("a", lambda v, i: v + F.when((i + 1) % 3 == 0, 0.05).otherwise(0.0)))
    return cl.gram_drift(e, ["label"], "a", "b").select("label", rnd("rmse", 5).alias("rmse"))


@query("k03_top_features", f"with {CVR} select moa, feature, {r('cohens_d')} as cohens_d from cvr qualify row_number() over (partition by moa order by {r('abs(cohens_d)')} desc, feature) <= 2")
def _(t):
    c = inf.class_versus_rest(field_values(t), "moa").select("moa", "feature", rnd("cohens_d").alias("cohens_d"))
    return cl.top_per_class(c, "moa", "cohens_d", "feature", 2).drop("rank")


@query("a53_category_summary", f"""with {CVR}, c as (select moa, case when contains(feature, 'price') then 'Intensity' when contains(feature, 'quantity') then 'AreaShape' when contains(feature, 'charge') then 'Texture' else 'Other' end as k from cvr where p < 0.5)
   select moa, count(*) filter (k = 'AreaShape') as AreaShape, count(*) filter (k = 'Intensity') as Intensity, count(*) filter (k = 'Texture') as Texture, count(*) filter (k = 'Other') as Other from c group by 1""")
def _(t):
    from cytomill.functions.scalar import first_match
    c = inf.class_versus_rest(field_values(t), "moa").where("p < 0.5")
    k = first_match(F.col("feature"), [("price", "Intensity"), ("quantity", "AreaShape"), ("charge", "Texture")], "Other")
    return c.withColumn("k", k).groupBy("moa").pivot("k", ["AreaShape", "Intensity", "Texture", "Other"]).count().fillna(0)


@query("a70_phenotype_scores", f"""with p as (select 'l' || o_orderstatus as level, o_orderpriority as truth, case when o_totalprice > 100000 then o_orderpriority else '1-URGENT' end as pred from orders), t as (select level, truth as k, count(*) as nt, count(*) filter (truth = pred) as tp from p group by 1, 2),
   q as (select level, pred as k, count(*) as np from p group by 1, 2) select level, sum(nt)::bigint as n_valid, sum(tp)::bigint as n_correct, {r('sum(tp) / sum(nt)')} as accuracy, {r('avg(2 * tp / (nt + coalesce(np, 0)))')} as macro_f1 from t left join q using (level, k) group by 1""")
def _(t):
    p = t.orders.select(F.concat(F.lit("l"), "o_orderstatus").alias("level"), F.col("o_orderpriority").alias("truth"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).otherwise("1-URGENT").alias("pred"))
    s = cl.phenotype_scores(p, "level", "truth", "pred")
    return s.withColumn("accuracy", rnd("accuracy")).withColumn("macro_f1", rnd("macro_f1"))


OVR = """ex as (select l_orderkey as cell_id, p_brand as gene, count(*) as cnt from lineitem join part on l_partkey = p_partkey group by 1, 2), cl as (select o_orderkey as cell_id, o_orderpriority as cluster from orders),
 f as (select gene, cell_id, cluster, coalesce(cnt, 0) as x from (select distinct p_brand as gene from part) g cross join cl left join ex using (gene, cell_id)),
 k as (select gene, cluster, rank() over (partition by gene order by x) + (count(*) over (partition by gene, x) - 1) / 2 as rk from f)"""


@query("m06_one_vs_rest_markers", f"with {OVR} select cluster, gene, count(*) as n_a, sum(rk) - count(*) * (count(*) + 1) / 2 as u from k group by 1, 2")
def _(t):
    c = cells(t).select("cell_id", F.col("region").alias("cluster"))
    return ex.one_vs_rest_markers(expr(t), c, genes(t)).select("cluster", "gene", "n_a", "u")
