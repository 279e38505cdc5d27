"""Sources, sinks and listings: round trips of the driver tables through each format, and path tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cytomill.operators import blocks as bl
from cytomill.operators import masks as mk
from cytomill.operators import volume as vo
from cytomill.plans.registry import Tables, query, r, rnd
from cytomill.plans.shapes import EDGE, TRUTH, runs
from cytomill.plans.volumes import GID, block_pixels, diamonds
from cytomill.sources import manifest as mf
from cytomill.sources import readers as rd
from cytomill.sources import sinks as sk
from cytomill.streaming.incremental import scratch


@query("s01_transcripts", "select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity >= 20")
def _(t):
    return rd.read_transcripts(t.spark, f"{t.folder}/lineitem.parquet", None, 20.0, "l_quantity").select("l_orderkey", "l_partkey", "l_quantity")


@query("s02_cells_csv", "select s_suppkey::varchar as cell_id, s_acctbal as cell_area from supplier")
def _(t):
    p = scratch(t.spark, "cells")
    t.supplier.select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("cell_area")).write.csv(p, header=True, compression="gzip")
    return rd.read_cells(t.spark, p, "cell_id string, cell_area double", 8)


@query("s03_boundaries", "with d as (select p_partkey as cell_id, (p_partkey * 37 % 250)::double as cx, (p_partkey * 11 % 250)::double as cy, p_size / 4.0 as s from part) select cell_id, unnest([cx + s, cx, cx - s, cx]) as vertex_x, unnest([cy, cy + s, cy, cy - s]) as vertex_y from d")
def _(t):
    p = scratch(t.spark, "bounds")
    diamonds(t).select("cell_id", F.col("x").alias("vertex_x"), F.col("y").alias("vertex_y"), "ord").write.parquet(p)
    return rd.read_boundaries(t.spark, p)


@query("s04_csc_matrix", "select l_suppkey as col, l_partkey as row, l_quantity as value from lineitem")
def _(t):
    from cytomill.operators.ordered import ordinal
    d = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_shipdate")
    key = F.col("l_suppkey").cast("double")
    d = d.withColumn("k", key).withColumn("u", F.xxhash64(*d.columns)).withColumn("one", F.lit(1))
    from pyspark.sql import Window as W
    within = d.withColumn("j", F.row_number().over(W.partitionBy("l_suppkey").orderBy("u")) - 1)
    n = d.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    from cytomill.operators.ordered import running_sums
    ptr = running_sums(n, [], "l_suppkey", {"start": "n"}).select(F.col("l_suppkey").alias("col"), "start", (F.col("start") + F.col("n")).alias("stop"))
    ent = within.join(ptr, F.col("l_suppkey") == F.col("col")).select((F.col("start") + F.col("j")).alias("pos"), F.col("l_partkey").alias("row"), F.col("l_quantity").alias("value"))
    return rd.expand_csc(ptr, ent)


@query("s05_write_expression", "select l_returnflag as method, l_suppkey as cell_id, count(*) as cnt from lineitem group by 1, 2")
def _(t):
    p = scratch(t.spark, "expr")
    sk.write_expression(t.lineitem.groupBy(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("cell_id")).agg(F.count(F.lit(1)).alias("cnt")), p, "method")
    return t.spark.read.parquet(p).select("method", "cell_id", "cnt")


@query("s06_gene_panel", "select distinct p_brand as gene from part")
def _(t):
    p = scratch(t.spark, "panel")
    one = t.part.select(F.col("p_brand").alias("name")).distinct().agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.struct(F.struct("name").alias("data")).alias("type"))).alias("targets")).alias("payload"))).alias("value"))
    one.write.text(p)
    return rd.read_gene_panel(t.spark, p)


@query("s07_metadata", "select count(*) as n_cells, min(s_name) as first from supplier")
def _(t):
    p = scratch(t.spark, "meta")
    t.supplier.agg(F.count(F.lit(1)).alias("n_cells"), F.min("s_name").alias("first")).write.json(p)
    schema = "n_cells bigint, first string"
    return rd.read_metadata(t.spark, p, schema).unionByName(rd.read_metadata(t.spark, p + "-absent", schema))


@query("s08_load_all", "select n_name, count(*) as n from nation join supplier on s_nationkey = n_nationkey group by 1")
def _(t):
    rd.register_views({"nation": t.nation, "supplier": t.supplier}, "all_")
    return t.spark.sql("select n_name, count(*) as n from all_nation join all_supplier on s_nationkey = n_nationkey group by 1")


@query("s09_field_table", "select s_nationkey::varchar as plate, (s_suppkey % 9)::int as site, case when s_acctbal < 0 then '' else s_name end as compound from supplier")
def _(t):
    p = scratch(t.spark, "fl")
    t.supplier.select(F.concat(F.lit("  "), F.col("s_nationkey").cast("string")).alias("plate"), F.concat(F.lit("s"), (F.col("s_suppkey") % 9).cast("string")).alias("site"), F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("compound")).write.csv(p, header=True)
    return rd.read_field_table(t.spark, p, ["plate", "site", "compound"])


@query("s10_feature_files", "select l_returnflag as plate, l_orderkey as cell_id, l_quantity as area from lineitem where l_returnflag in ('A', 'N')")
def _(t):
    p = scratch(t.spark, "feat")
    t.lineitem.select(F.col("l_returnflag").alias("plate"), F.col("l_orderkey").alias("cell_id"), F.col("l_quantity").alias("area")).write.partitionBy("plate").csv(p, header=True)
    return rd.read_feature_files(t.spark, [f"{p}/plate=A", f"{p}/plate=N", f"{p}/plate=ZZ"], "cell_id long, area double")


@query("s11_truth_counts", "select 'img' || c_custkey as file, case when c_custkey % 3 = 0 then c_nationkey::double else (c_nationkey + c_custkey) / 2 end as gt from customer")
def _(t):
    p = scratch(t.spark, "counts")
    t.customer.select(F.concat(F.lit("img"), F.col("c_custkey").cast("string")).alias("file"), F.col("c_nationkey").alias("count1"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("count2")).write.csv(p, header=True, sep="\t")
    return rd.read_counts(t.spark, p, 2)


@query("s12_per_image_rows", "select c_custkey as image, c_acctbal as pred_count from customer")
def _(t):
    p = scratch(t.spark, "rows")
    d = t.customer.select(F.col("c_custkey").alias("image"), F.col("c_acctbal").alias("pred_count"), "c_nationkey")
    sk.write_rows(d.where("c_nationkey < 10").drop("c_nationkey"), p)
    sk.write_rows(d.where("c_nationkey >= 10").drop("c_nationkey"), p, append=True)
    return t.spark.read.csv(p, schema="image bigint, pred_count double", header=True)


@query("s13_read_back", "select c_custkey as image, c_acctbal as pred_count from customer")
def _(t):
    p = scratch(t.spark, "back")
    sk.write_rows(t.customer.select(F.col("c_custkey").alias("image"), F.col("c_acctbal").alias("pred_count")), p)
    assert rd.read_table_or_none(t.spark, p + "-absent", "image bigint") is None
    return rd.read_table_or_none(t.spark, p, "image bigint, pred_count double")


# --- listings: one image per document, masks for the short ones ----------------------------------

FILES = """ff as (select '/data/' || source || '-' || lang || '/img' || doc_id || '.tif' as path, doc_id, n_chars from documents union all select '/data/' || source || '-' || lang || '/img' || doc_id || '_mask.tif', doc_id, n_chars from documents where n_chars < 3000
  union all select '/data/' || source || '-' || lang || '/img' || doc_id || '_mask_flows.tif', doc_id, n_chars from documents where n_chars < 1500)"""


def files(t: Tables, mask: str = "_mask") -> DataFrame:
    base = F.concat(F.lit("/data/"), "source", F.lit("-"), "lang", F.lit("/img"), F.col("doc_id").cast("string"))
    d = t.documents.select(base.alias("b"), "n_chars")
    parts = [d.select(F.concat("b", F.lit(".tif")).alias("path")), d.where("n_chars < 3000").select(F.concat("b", F.lit(mask + ".tif")).alias("path")), d.where("n_chars < 1500").select(F.concat("b", F.lit(mask + "_flows.tif")).alias("path"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("s15_image_files", f"with {FILES} select path, row_number() over (order by split_part(path, '/', 3), doc_id) as k from (select distinct path, doc_id from ff where path not like '%\\_mask.tif' escape '\\' and path not like '%\\_flows.tif' escape '\\') where true".replace("row_number() over (order by split_part(path, '/', 3), doc_id) as k", "lpad(length(doc_id::varchar)::varchar, 10, '0') || doc_id as key"))
def _(t):
    i = mf.image_files(files(t).union(files(t)), "_mask")
    return i.select("path", F.regexp_extract(mf.natural_key(F.col("stem")), "img(.*)$", 1).alias("key"))


@query("s16_label_files", """select '/data/' || source || '-' || lang || '/img' || doc_id || '.tif' as path, case when n_chars < 3000 then '/data/' || source || '-' || lang || '/img' || doc_id || '_mask.tif' else '' end as label_path from documents""")
def _(t):
    f = files(t)
    j = mf.label_files(mf.image_files(f, "_mask"), f, "_mask")
    return j.select("path", F.coalesce("label_path", F.lit("")).alias("label_path"))


@query("s17_mask_and_flow", "select '/data/' || source || '-' || lang || '/img' || doc_id || '.tif' as path from documents where n_chars < 1500")
def _(t):
    return mf.with_mask_and_flow(files(t)).select("path")


@query("s18_study_pairs", "select source as study, source || '-' || lang as leaf, 'img' || doc_id as stem from documents where n_chars < 3000 and source in ('src1', 'src2', 'src5')")
def _(t):
    f = mf.describe(files(t))
    images = f.where(~F.contains("stem", F.lit("_mask"))).select("path")
    masks = f.where(F.endswith("stem", F.lit("_mask"))).select(F.regexp_replace("path", "^/data", "/masks").alias("path"))
    return mf.study_pairs(images, masks, ["src1", "src2", "src5"]).select("study", "leaf", "stem")


@query("s19_pair_by_order", "select lang, 'tile' || lpad(doc_id::varchar, 9, '0') || '.png' as image_path, 'mask' || lpad(doc_id::varchar, 9, '0') || '.json' as mask_path from documents")
def _(t):
    n = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    return mf.pair_by_order(t.documents.select("lang", F.concat(F.lit("tile"), n, F.lit(".png")).alias("path")), t.documents.select("lang", F.concat(F.lit("mask"), n, F.lit(".json")).alias("path")), ["lang"])


POLY = "v as (select p_partkey as doc, unnest([0, 1, 2])::bigint as ord, unnest([p_size, p_size + 10, p_size])::double as x, unnest([5, 9, 20])::double as y from part)"


@query("s20_polygon_json", f"with {POLY} select doc, 1::bigint as label, ord, x, y, 64 as height, 48 as width from v")
def _(t):
    s = F.col("p_size").cast("double")
    pts = [(s, F.lit(5.0)), (s + 10, F.lit(9.0)), (s, F.lit(20.0))]
    one = F.to_json(F.struct(F.lit(64).alias("imageHeight"), F.lit(48).alias("imageWidth"), F.array(F.struct(F.array(*[F.array(x, y) for x, y in pts]).alias("points"))).alias("shapes")))
    path = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts])
    two = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit(64).alias("height"), F.lit(48).alias("width"))).alias("slots")).alias("item"), F.array(F.struct(F.struct(F.array(path, path).alias("paths")).alias("polygon"))).alias("annotations")))
    docs = t.part.select(F.col("p_partkey").alias("doc"), F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two).alias("json"))
    return rd.polygon_vertices(docs, ["doc"])


@query("s21_coco_annotations", "select p_name || '-' || p_partkey as file_name, p_partkey as annotation_id, p_size::double as first from part where p_size <= 40")
def _(t):
    img = F.struct(F.col("p_partkey").alias("id"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("file_name"))
    ann = F.struct(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("image_id"), F.array(F.array(F.col("p_size").cast("double"), F.lit(1.0))).alias("segmentation"))
    # ids restart in every document: here they count the parts of a brand
    nth = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))
    img = img.withField("id", F.col("k"))
    ann = ann.withField("image_id", F.col("k"))
    docs = t.part.withColumn("k", nth).groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(img).alias("images"), F.collect_list(ann).alias("annotations"))).alias("json"))
    there = t.part.where("p_size <= 40").select(F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("file_name"))
    return rd.coco_annotations(docs, there, ["p_brand"]).select("file_name", "annotation_id", F.col("points")[0].alias("first"))


@query("s22_profiles", "select s_suppkey, s_acctbal from supplier")
def _(t):
    p = scratch(t.spark, "prof")
    t.supplier.select("s_suppkey", "s_acctbal").write.parquet(p)
    return rd.require_table(t.spark, p)


@query("s23_named_results", "select s_nationkey, count(*) as n from supplier group by 1 union all select -1, count(*) from supplier")
def _(t):
    p = scratch(t.spark, "res")
    sk.write_named({"per_class": t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")), "total": t.supplier.agg(F.count(F.lit(1)).alias("n"))}, p, {"per_class": "s_nationkey"})
    a = t.spark.read.parquet(f"{p}/per_class").select("s_nationkey", "n")
    return a.unionByName(t.spark.read.parquet(f"{p}/total").select(F.lit(-1).alias("s_nationkey"), "n"))


@query("s24_outline_text", "with d as (select (p_partkey * 37 % 250) as cx, (p_partkey * 11 % 250) as cy, p_size / 4.0 as s from part) select trunc(cx + s)::int || ',' || cy || ',' || cx || ',' || trunc(cy + s)::int || ',' || trunc(cx - s)::int || ',' || cy || ',' || cx || ',' || trunc(cy - s)::int as line from d")
def _(t):
    p = scratch(t.spark, "outl")
    pts = diamonds(t).groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))), lambda s: F.struct(s.x.alias("x"), s.y.alias("y"))).alias("points"))
    sk.write_outlines(sk.outline_lines(pts, ["cell_id"]), p)
    return t.spark.read.text(p).withColumnRenamed("value", "line")


@query("s25_block_index", "select l_linenumber::bigint as bz, l_suppkey % 7 as by, l_partkey % 11 as bx, count(*) as n from lineitem group by 1, 2, 3")
def _(t):
    n = F.format_string("/vol/img_Z%03dY%03dX%03d.tif", F.col("l_linenumber"), F.col("l_suppkey") % 7, F.col("l_partkey") % 11)
    return rd.block_index(t.lineitem.select(n.alias("path"))).groupBy("bz", "by", "bx").agg(F.count(F.lit(1)).alias("n"))


@query("s26_plate_files", "select s_suppkey, unnest(['DNA', 'ER']) as channel, unnest([s_name, s_name || 'x']) || '.TIF' as raw, lower(unnest([s_name, s_name || 'x'])) || '_w' || unnest([1, 2]) || '.tif' as name from supplier")
def _(t):
    f = t.supplier.select("s_suppkey", F.concat("s_name", F.lit(".TIF")).alias("C1"), F.concat("s_name", F.lit("x.TIF")).alias("C2"), F.lit("").alias("C3"))
    return mf.plate_files(f, ["s_suppkey"], ["C1", "C2", "C3"], {"C1": "DNA", "C2": "ER", "C3": "RNA"})


@query("j25_locate_image", "select 'IMG' || doc_id || (case when doc_id % 2 = 0 then '.TIF' else '' end) as file, '/data/' || source || '-' || lang || '/img' || doc_id || '.tif' as path from documents")
def _(t):
    names = t.documents.select(F.concat(F.lit("IMG"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".TIF").otherwise("")).alias("file"))
    return mf.locate(names, files(t))


@query("p13_split_subset", "select l_returnflag || '_' || l_linestatus || '_' || l_suppkey as name, count(*) as n from lineitem where l_linestatus in ('O') group by 1")
def _(t):
    n = t.lineitem.select(F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string")).alias("name"))
    return mf.split_subset(n, 1, ["O"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("p14_channel_rules", """select l_returnflag as study, l_linenumber - 1 as page, floor((l_linenumber - 1) / floor(8 / case l_returnflag when 'A' then 4 when 'N' then 2 else 8 end))::bigint as channel, count(*) as n from lineitem
  where floor((l_linenumber - 1) / floor(8 / case l_returnflag when 'A' then 4 when 'N' then 2 else 8 end)) in (0, 2) group by 1, 2, 3""")
def _(t):
    rules = t.lineitem.select(F.col("l_returnflag").alias("study")).distinct().withColumn("keep", F.array(F.lit(0), F.lit(2))).withColumn("n_channels", F.when(F.col("study") == "A", 4).when(F.col("study") == "N", 2).otherwise(8))
    pages = t.lineitem.select(F.col("l_returnflag").alias("study"), (F.col("l_linenumber") - 1).alias("page"), F.lit(8).alias("n_pages"))
    return mf.keep_channels(pages, rules).groupBy("study", "page", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("p18_field_ready", """with h as (select user_id, event_type from events where event_type <> 'error' group by 1, 2), q as (select unnest(['click', 'view', 'signup', 'purchase']) as c), u as (select distinct user_id from h where event_type in ('click', 'view', 'signup', 'purchase'))
  select user_id, (select string_agg(c, ',' order by c) from q where c not in (select event_type from h where h.user_id = u.user_id)) is null as ready, coalesce((select string_agg(c, ',' order by c) from q where c not in (select event_type from h where h.user_id = u.user_id)), '') as missing from u""")
def _(t):
    f = mf.ready_fields(t.events, ["user_id"], "event_type", ["click", "view", "signup", "purchase"])
    return f.withColumn("missing", F.array_join("missing", ","))


# --- block hooks ------------------------------------------------------------------------------------


@query("m09_map_blocks", f"with {TRUTH} select image_id, y // 64 as by, x // 64 as bx, count(*) * 2 as n from pt group by 1, 2, 3")
def _(t):
    import pandas as pd

    def doubled(pdf, crop, factor):
        return pdf.assign(v=factor)

    def total(pdf, crop):
        return pd.DataFrame([{**crop, "n": int(pdf["v"].sum())}])

    px = mk.run_pixels(runs(t)).select("image_id", F.floor(F.col("y") / 64).alias("by"), F.floor(F.col("x") / 64).alias("bx"), "label")
    return bl.map_blocks(px, ["image_id", "by", "bx"], [(doubled, {"factor": 2}), (total, {})], "image_id long, by long, bx long, n long")


@query("m10_block_outputs", f"with {GID} select 'ids' as kind, count(distinct gid) as n from bp union all select 'boxes', count(distinct gid) from bp union all select 'faces', count(*) from (select distinct a.gid as g1, b.gid as g2 from bp a join bp b on a.image_id = b.image_id and ((b.y = a.y + 1 and b.x = a.x and b.y % 24 = 0) or (b.x = a.x + 1 and b.y = a.y and b.x % 24 = 0)))")
def _(t):
    o = bl.block_outputs(block_pixels(t), 24)
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in o.items()]
    return out[0].union(out[1]).union(out[2])
