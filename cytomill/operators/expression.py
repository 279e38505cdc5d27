"""Cell-by-gene triplets (cell, gene, cnt) with implicit zeros: counting, typing, scoring, testing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.functions import tails
from cytomill.functions.scalar import log2_fold_change, neg_log10
from cytomill.operators import inference as inf
from cytomill.operators.ordered import attach, average_ranks, join_on, running_sums, top_k
from cytomill.session import cut


def count_expression(assigned: DataFrame, panel: DataFrame | None, cell: str = "cell_id", gene: str = "gene", n: Column | None = None) -> DataFrame:
    """Transcripts per cell and known gene; label 0 (unassigned) and empty cells vanish."""
    a = assigned.where(F.col(cell) != 0)
    if panel is not None:
        a = a.join(panel.select(gene).distinct(), gene, "left_semi")
    return a.groupBy(cell, gene).agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("cnt"))


def rekey_expression(expr: DataFrame, mapping: DataFrame, cell: str, label: str, gene: str = "gene") -> DataFrame:
    """Sums triplets of all cells that map to one label; unmapped (0) cells drop out."""
    m = mapping.where(F.col(label) != 0).select(cell, label)
    return expr.join(m, cell).groupBy(label, gene).agg(F.sum("cnt").alias("cnt"))


def gene_detection(expr: DataFrame, by: Sequence[str], cell: str = "cell_id") -> DataFrame:
    """Mean and median genes and transcripts per cell."""
    from cytomill.operators.ordered import median_mad_columns

    per = cut(expr.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("genes"), F.sum("cnt").alias("transcripts")))
    mean = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("genes").alias("mean_genes"), F.avg("transcripts").alias("mean_transcripts"))
    med = median_mad_columns(per, list(by), ["genes", "transcripts"])
    wide = med.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"median_{c}") for c in ("genes", "transcripts")])
    return join_on(mean, wide, by)


def _set_scores(expr: DataFrame, sets: DataFrame, genes: DataFrame, cell: str, gene: str) -> DataFrame:
    """Non-zero (cell, set, score): mean over the set's genes that exist in the panel."""
    known = sets.join(genes.select(gene).distinct(), gene, "left_semi")
    size = known.groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    return (
        expr.join(known, gene).groupBy(cell, "set").agg(F.sum("cnt").alias("s")).join(size, "set")
        .select(cell, "set", (F.col("s") / F.col("size")).alias("score"))
    )


def score_cell_types(expr: DataFrame, markers: DataFrame, genes: DataFrame, cells: DataFrame, types: Sequence[str], cell: str = "cell_id", gene: str = "gene") -> DataFrame:
    """Best type per cell by mean marker count, as z over the types (population std; no spread gives 0).

    Types without a marker count as 0; they are never materialised: mean and spread come from
    the non-zero scores and the number of types. The first type wins ties.
    """
    t = len(types)
    order = F.element_at(F.create_map(*[x for i, n in enumerate(types) for x in (F.lit(n), F.lit(i))]), F.col("set"))
    s = _set_scores(expr, markers, genes, cell, gene).where("score <> 0")
    per = s.groupBy(cell).agg(
        F.sum("score").alias("s1"), F.sum(F.col("score") * F.col("score")).alias("s2"),
        F.max_by("set", F.struct("score", -order)).alias("best"), F.max("score").alias("top"),
    )
    j = cells.select(cell).distinct().join(per, cell, "left").fillna(0.0, ["s1", "s2", "top"])
    mean = F.col("s1") / t
    sd = F.sqrt(F.greatest(F.col("s2") / t - mean * mean, F.lit(0.0)))
    return j.select(
        cell, F.coalesce("best", F.lit(types[0])).alias("cell_type"),
        F.coalesce((F.col("top") - mean) / F.when(sd > 1e-9, sd), F.lit(0.0)).alias("max_zscore"),
    )


def signature_scores(expr: DataFrame, signatures: DataFrame, genes: DataFrame, cells: DataFrame, names: Sequence[str], cell: str = "cell_id", gene: str = "gene") -> DataFrame:
    """Score and z (sample std over all cells, 0 without spread) per cell and signature."""
    s = _set_scores(expr, signatures, genes, cell, gene)
    full = cells.select(cell).distinct().withColumn("set", F.explode(F.array(*[F.lit(n) for n in names])))
    full = full.join(s, [cell, "set"], "left").fillna(0.0, ["score"])
    m = full.groupBy("set").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"))
    z = (F.col("score") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd"))
    return full.join(F.broadcast(m), "set").select(cell, "set", "score", F.coalesce(z, F.lit(0.0)).alias("zscore"))


def differential_expression(
    expr: DataFrame, groups: DataFrame, a: str, b: str, genes: DataFrame, cell: str = "cell_id", gene: str = "gene", group: str = "group", method: str = "rank"
) -> DataFrame:
    """Group a against b per gene: means, share expressing, log2 fold change, test, adjusted p.

    Cells are counted per (gene, count, group) and the zero cells enter as one more count, so no
    dense matrix exists. Fewer than 3 cells on a side fails.
    """
    side = groups.where(F.col(group).isin(a, b)).select(cell, (F.col(group) == a).cast("long").alias("ina"))
    size = side.agg(F.sum("ina").alias("na"), F.sum(1 - F.col("ina")).alias("nb"))
    size = size.withColumn("__ok", F.assert_true((F.col("na") >= 3) & (F.col("nb") >= 3), F.lit("need at least 3 cells per group"))).where(F.col("__ok").isNull()).drop("__ok")
    v = expr.where("cnt <> 0").join(side, cell).groupBy(gene, F.col("cnt").cast("double").alias("v")).agg(
        F.sum("ina").alias("ca"), F.sum(1 - F.col("ina")).alias("cb")
    )
    v = cut(v)  # (gene, count) table: the cells are read once
    nz = v.groupBy(gene).agg(
        F.sum("ca").alias("za"), F.sum("cb").alias("zb"), F.sum(F.col("v") * F.col("ca")).alias("sa"), F.sum(F.col("v") * F.col("cb")).alias("sb"),
        F.sum(F.col("v") * F.col("v") * F.col("ca")).alias("qa"), F.sum(F.col("v") * F.col("v") * F.col("cb")).alias("qb"),
    )
    g = genes.select(gene).distinct().join(nz, gene, "left").fillna(0).fillna(0.0).transform(attach, size)
    stats = g.select(
        gene, "na", "nb", (F.col("sa") / F.col("na")).alias("mean_a"), (F.col("sb") / F.col("nb")).alias("mean_b"),
        (F.col("za") / F.col("na")).alias("pct_a"), (F.col("zb") / F.col("nb")).alias("pct_b"),
        (F.col("qa") - F.col("sa") * F.col("sa") / F.col("na")).alias("m2a"), (F.col("qb") - F.col("sb") * F.col("sb") / F.col("nb")).alias("m2b"),
    ).withColumn("log2fc", log2_fold_change(F.col("mean_a"), F.col("mean_b")))
    if method == "rank":
        zero = g.select(gene, F.lit(0.0).alias("v"), (F.col("na") - F.col("za")).alias("ca"), (F.col("nb") - F.col("zb")).alias("cb"))
        test = inf.rank_sum(v.unionByName(zero), [gene], "v", "ca", "cb").select(gene, F.col("u").alias("stat"), "z", F.col("p").alias("p_value"))
    else:
        x = {"n": F.col("na"), "mean": F.col("mean_a"), "m2": F.col("m2a")}
        y = {"n": F.col("nb"), "mean": F.col("mean_b"), "m2": F.col("m2b")}
        t, dof = inf.student(x, y)
        test = stats.select(gene, t.alias("stat"), dof.alias("dof")).withColumn("z", F.col("stat")).withColumn(
            "p_value", F.coalesce(tails.student_two_sided("stat", "dof"), F.lit(1.0))
        ).drop("dof")
    out = stats.drop("na", "nb", "m2a", "m2b").join(test, gene)
    return inf.bh_adjust(out, [], "p_value", gene, "p_value_adj")


def surrogate_biomarkers(de: DataFrame, moran: DataFrame, n: int, gene: str = "gene") -> DataFrame:
    """Top genes by -log10(adjusted p) * |log2fc| * (1 + |I|), signed by direction."""
    j = de.join(moran.select(gene, "morans_i"), gene, "left").fillna(0.0, ["morans_i"])
    score = neg_log10(F.col("p_value_adj")) * F.abs("log2fc") * (1 + F.abs("morans_i"))
    j = j.withColumn("significance_score", score).withColumn("biomarker_score", F.col("significance_score") * F.signum("log2fc"))
    return j.orderBy(F.desc("significance_score"), gene).limit(n)


def spearman_with_feature(expr: DataFrame, feature: DataFrame, cell: str = "cell_id", gene: str = "gene", value: str = "value", min_cells: int = 10) -> DataFrame:
    """Rank correlation of each expressed gene with one per-cell feature over all cells that have it.

    Zero cells share one rank, so sums over them come from totals.
    """
    from cytomill.operators.ordered import with_average_rank

    fr = with_average_rank(feature.select(cell, value), [], value, "ry").select(cell, "ry")
    tot = fr.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("ry").alias("sy"), F.sum(F.col("ry") * F.col("ry")).alias("syy"))
    e = expr.where("cnt <> 0").join(fr, cell)
    nz = e.groupBy(gene).agg(F.count(F.lit(1)).alias("nnz"))
    ranks = average_ranks(e, [gene], "cnt").select(gene, "cnt", "rank", "n")
    j = join_on(e, ranks.drop("n"), [gene, "cnt"]).join(nz, gene).transform(attach, tot)
    n0 = F.col("n") - F.col("nnz")
    rx = F.col("rank") + n0
    s = j.groupBy(gene).agg(
        F.first("n").alias("n"), F.first("nnz").alias("nnz"), F.first("sy").alias("sy"), F.first("syy").alias("syy"),
        F.sum(rx * F.col("ry")).alias("pxy"), F.sum("ry").alias("py"), F.sum(rx * rx).alias("pxx"),
    ).where(F.col("n") >= min_cells)
    n0 = F.col("n") - F.col("nnz")
    r0 = (n0 + 1) / 2
    sx = F.col("n") * (F.col("n") + 1) / 2
    sxy = F.col("pxy") + r0 * (F.col("sy") - F.col("py"))
    sxx = F.col("pxx") + n0 * r0 * r0
    cov = sxy - sx * F.col("sy") / F.col("n")
    den = F.sqrt((sxx - sx * sx / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")))
    s = s.select(gene, "n", F.coalesce(cov / F.nullif(den, F.lit(0.0)), F.lit(0.0)).alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(0.0)), F.lit(0.0)))
    return s.withColumn("p_value", F.coalesce(tails.student_two_sided(t, F.col("n") - 2), F.lit(0.0)))


def regional_means(expr: DataFrame, regions: DataFrame, genes: DataFrame, cell: str = "cell_id", gene: str = "gene", region: str = "region", min_cells: int = 5) -> DataFrame:
    """Mean count and share expressing per region and gene over all cells of the region, zeros included."""
    size = regions.groupBy(region).agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= min_cells)
    s = expr.join(regions.select(cell, region), cell).groupBy(region, gene).agg(F.sum("cnt").alias("s"), F.sum((F.col("cnt") > 0).cast("long")).alias("k"))
    return join_on(s, size, [region]).select(region, gene, "n_cells", (F.col("s") / F.col("n_cells")).alias("mean"), (F.col("k") / F.col("n_cells")).alias("pct"))


def normalize_log(expr: DataFrame, target: float = 1e4, cell: str = "cell_id") -> DataFrame:
    """log1p of counts scaled to a fixed total per cell."""
    total = expr.groupBy(cell).agg(F.sum("cnt").alias("__t"))
    return expr.join(total, cell).withColumn("value", F.log1p(F.col("cnt") * target / F.col("__t"))).drop("__t")


def gene_dispersion(expr: DataFrame, n_cells: DataFrame, gene: str = "gene", value: str = "value") -> DataFrame:
    """Mean, sample variance and dispersion (variance / mean) per gene, zeros included; `n_cells` has one row n."""
    v = F.col(value).cast("double")
    s = expr.groupBy(gene).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q")).transform(attach, n_cells)
    n = F.col("n").cast("double")
    var = (F.col("q") - F.col("s") * F.col("s") / n) / F.nullif(n - 1, F.lit(0.0))
    return s.select(gene, (F.col("s") / n).alias("mean"), var.alias("variance")).withColumn("dispersion", F.col("variance") / F.nullif("mean", F.lit(0.0)))


def highly_variable(dispersion: DataFrame, n_top: int, bins: int = 20, gene: str = "gene") -> DataFrame:
    """Genes with the largest dispersion z inside their mean-expression bin."""
    d = dispersion.where(F.col("mean") > 0)
    ext = d.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    b = F.least(F.floor((F.col("mean") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(bins - 1))
    d = d.transform(attach, ext).withColumn("bin", F.coalesce(b, F.lit(0)).cast("long")).drop("lo", "hi")
    m = d.groupBy("bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("sd"))
    z = F.coalesce((F.col("dispersion") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd")), F.lit(0.0))
    d = d.join(m, "bin").select(gene, "mean", "dispersion", "bin", F.round(z, 9).alias("dispersion_z"))
    return top_k(d, [], [F.desc("dispersion_z"), F.col(gene)], n_top)


def marker_means(expr: DataFrame, types: DataFrame, cell: str = "cell_id", gene: str = "gene", kind: str = "cell_type") -> DataFrame:
    size = types.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    s = expr.join(types.select(cell, kind), cell).groupBy(kind, gene).agg(F.sum("cnt").alias("s"))
    return join_on(s, size, [kind]).select(kind, gene, (F.col("s") / F.col("n")).alias("mean"))


def agreement(a: DataFrame, b: DataFrame, cell: str, kind: str) -> DataFrame:
    """Share of common cells with the same label."""
    j = a.select(cell, F.col(kind).alias("ka")).join(b.select(cell, F.col(kind).alias("kb")), cell)
    return j.agg(F.count(F.lit(1)).alias("n_cells"), F.avg((F.col("ka") == F.col("kb")).cast("double")).alias("agreement"))


def top_genes_by_spread(expr: DataFrame, n_cells: DataFrame, n: int, gene: str = "gene") -> DataFrame:
    """Genes with the largest standard deviation over cells, zeros included."""
    d = gene_dispersion(expr, n_cells, gene, "cnt").select(gene, F.round(F.sqrt(F.greatest("variance", F.lit(0.0))), 9).alias("std"))
    return d.orderBy(F.desc("std"), gene).limit(n)


def one_vs_rest_markers(expr: DataFrame, clusters: DataFrame, genes: DataFrame, cell: str = "cell_id", gene: str = "gene", cluster: str = "cluster") -> DataFrame:
    """Rank-sum of every cluster against all other cells per gene, in one pass over the counts.

    A value's rank does not depend on the split, so values are ranked once per gene; a cluster's rank
    sum adds its expressing cells to its zero cells, which all share the lowest rank.
    """
    size = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("nc"))
    labels = size.agg(F.collect_list(F.struct(cluster, "nc")).alias("__cl"), F.sum("nc").alias("nt"))  # one entry per cluster
    v = expr.where("cnt <> 0").join(clusters.select(cell, cluster), cell).groupBy(cluster, gene, F.col("cnt").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    v = cut(v)
    allv = v.groupBy(gene, "v").agg(F.sum("c").alias("ct"))
    nnz = genes.select(gene).distinct().join(allv.groupBy(gene).agg(F.sum("ct").alias("k")), gene, "left").fillna(0, ["k"])
    zero = nnz.transform(attach, labels).select(gene, F.lit(0.0).alias("v"), (F.col("nt") - F.col("k")).alias("ct"))
    ranked = running_sums(allv.unionByName(zero).where("ct > 0"), [gene], "v", {"__before": "ct"})
    ranked = ranked.select(gene, "v", "ct", (F.col("__before") + (F.col("ct") + 1) / 2).alias("rank"))
    t = F.col("ct").cast("double")
    ties = ranked.groupBy(gene).agg(F.sum(t * t * t - t).alias("ties"), F.max(F.when(F.col("v") == 0, F.col("rank"))).alias("r0"))
    part = v.join(ranked.select(gene, "v", "rank"), [gene, "v"]).groupBy(cluster, gene).agg(F.sum(F.col("rank") * F.col("c")).alias("r"), F.sum("c").alias("k"))
    full = ties.transform(attach, labels).select(gene, "ties", "r0", "nt", F.inline("__cl")).join(part, [cluster, gene], "left").fillna(0.0, ["r", "r0"]).fillna(0, ["k"])
    na, nb = F.col("nc").cast("double"), (F.col("nt") - F.col("nc")).cast("double")
    n = na + nb
    u = F.col("r") + F.col("r0") * (F.col("nc") - F.col("k")) - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.coalesce((F.greatest(u, na * nb - u) - na * nb / 2 - 0.5) / F.nullif(sd, F.lit(0.0)), F.lit(0.0))
    test = full.select(cluster, gene, F.col("nc").alias("n_a"), (F.col("nt") - F.col("nc")).alias("n_b"), u.alias("u"), z.alias("z"))
    p = F.least(F.when(F.col("z") > 0, tails.normal_two_sided("z")).otherwise(F.lit(1.0)), F.lit(1.0))
    return inf.bh_adjust(test.withColumn("p", p), [cluster], "p", gene)
