"""Column functions over names, numbers, JSON and paths of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomill.functions import scalar as sc
from cytomill.functions.tails import normal_two_sided, student_two_sided
from cytomill.plans.registry import Tables, query, r, rnd, t_tail, z_tail

NAMES = "nm as (select l_orderkey, l_linenumber, chr((97 + l_partkey % 16)::int) || lpad((l_suppkey % 24)::varchar, 2, '0') || '_s' || (l_orderkey % 9) || '_w' || l_linenumber || '.tif' as name from lineitem)"


def names(t: Tables) -> DataFrame:
    n = F.concat(F.char((97 + F.col("l_partkey") % 16).cast("int")), F.lpad((F.col("l_suppkey") % 24).cast("string"), 2, "0"), F.lit("_s"), (F.col("l_orderkey") % 9).cast("string"), F.lit("_w"), F.col("l_linenumber").cast("string"), F.lit(".tif"))
    return t.lineitem.select("l_orderkey", "l_linenumber", n.alias("name"))


@query("f01_well_site", f"with {NAMES} select name, upper(regexp_extract(name, '^([A-Pa-p]\\d{{2}})_s(\\d+)_w\\d+', 1)) as well, regexp_extract(name, '^([A-Pa-p]\\d{{2}})_s(\\d+)_w\\d+', 2)::bigint as site, count(*) as n from nm group by 1, 2, 3")
def _(t):
    return names(t).groupBy("name", sc.well_of(F.col("name")).alias("well"), sc.site_of(F.col("name")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


@query("f02_field_key", f"with {NAMES} select regexp_extract(name, '^(.+?)_w\\d+', 1) as field, count(*) as n from nm group by 1")
def _(t):
    return names(t).groupBy(sc.field_key(F.col("name")).alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query("f03_channel_path", "select distinct 'B' || lpad((l_suppkey % 24)::varchar, 2, '0') || '_s' || l_linenumber || '_w' || (l_partkey % 5 + 1) || '.tif' as path from lineitem")
def _(t):
    well = F.concat(F.lit("B"), F.lpad((F.col("l_suppkey") % 24).cast("string"), 2, "0"))
    return t.lineitem.select(sc.channel_path(well, F.col("l_linenumber"), F.col("l_partkey") % 5 + 1).alias("path")).distinct()


@query("f04_platform_split", "select case when starts_with(p_name, 'small') then 'small' when starts_with(p_name, 'red') then 'red' end as platform, case when starts_with(p_name, 'small') then substr(p_name, 6) when starts_with(p_name, 'red') then substr(p_name, 4) else p_name end as cancer, count(*) as n from part group by 1, 2")
def _(t):
    head, rest = sc.prefix_split(F.col("p_name"), ["small", "red"])
    return t.part.groupBy(head.alias("platform"), rest.alias("cancer")).agg(F.count(F.lit(1)).alias("n"))


@query("f06_stem_and_study", "select split_part(p_name, ' ', 1) as study, regexp_replace(p_name, 'ring$', '') as stem, count(*) as n from part group by 1, 2")
def _(t):
    return t.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("study"), sc.strip_suffix(F.col("p_name"), "ring").alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query("f07_control_labels", "select c_mktsegment, coalesce(lower(case when c_acctbal < 0 then 'Dmso' when c_acctbal > 9000 then null else c_mktsegment end) = 'dmso', false) as is_control, count(*) as n from customer group by 1, 2")
def _(t):
    c = F.when(F.col("c_acctbal") < 0, F.lit("Dmso")).when(F.col("c_acctbal") > 9000, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return t.customer.groupBy("c_mktsegment", sc.is_control(c).alias("is_control")).agg(F.count(F.lit(1)).alias("n"))


@query("f08_shape_ratios", f"select p_partkey, {r('least(4 * pi() * p_size / (p_retailprice / 50 * (p_retailprice / 50)), 1)')} as circularity, {r('2 * sqrt(p_size / pi())')} as diameter from part")
def _(t):
    return t.part.select("p_partkey", rnd(sc.circularity(F.col("p_size"), F.col("p_retailprice") / 50)).alias("circularity"), rnd(sc.equivalent_diameter(F.col("p_size"))).alias("diameter"))


@query("f09_polygon_perimeter", f"select p_partkey, {r('4 * sqrt(2.0) * p_size')} as perimeter from part")
def _(t):
    s = F.col("p_size").cast("double")
    pts = F.array(*[F.struct((s * x).alias("x"), (s * y).alias("y")) for x, y in ((1, 0), (0, 1), (-1, 0), (-0.5, -0.5), (0, -1))])
    return t.part.select("p_partkey", rnd(sc.closed_perimeter(pts)).alias("perimeter"))


@query("f10_log_transforms", f"select o_orderkey, {r('log2((o_totalprice + 1e-6) / (1000 + 1e-6))')} as lfc, {r('-log10(1 / o_totalprice + 1e-100)')} as nlp, {r('ln(1 + o_totalprice)')} as l1p, {r('asinh(o_totalprice)')} as ash, sign(o_totalprice - 100000)::bigint as sgn from orders")
def _(t):
    v = F.col("o_totalprice")
    return t.orders.select("o_orderkey", rnd(sc.log2_fold_change(v, F.lit(1000.0))).alias("lfc"), rnd(sc.neg_log10(1 / v)).alias("nlp"), rnd(F.log1p(v)).alias("l1p"), rnd(F.asinh(v)).alias("ash"), F.signum(v - 100000).cast("long").alias("sgn"))


@query("f11_clip", "select s_suppkey, least(greatest(s_acctbal, 0.0), 5000.0) as v from supplier")
def _(t):
    return t.supplier.select("s_suppkey", sc.clip(F.col("s_acctbal"), 0.0, 5000.0).alias("v"))


@query("f12_durations", "select event_id, hour(ts) * 60 + minute(ts) as seconds, printf('%02d:%02d:%02d', user_id // 3600, user_id // 60 % 60, user_id % 60) as clock from events")
def _(t):
    return t.events.select("event_id", sc.stopwatch_seconds(F.hour("ts"), F.minute("ts")).cast("long").alias("seconds"), sc.clock(F.col("user_id")).alias("clock"))


@query("f13_parameter_grid", "select r_name, round((0.3 + i * 0.1)::double, 3) as v, round((0.5 + j * 0.25)::double, 3) as w from region, (select unnest(range(0, 5)) as i), (select unnest(range(0, 3)) as j)")
def _(t):
    g = t.region.select("r_name", F.explode(sc.grid_values(0.3, 0.7, 0.1)).alias("v"))
    return g.select("r_name", "v", F.explode(sc.grid_values(0.5, 1.0, 0.25)).alias("w"))


@query("f15_explode_maps", "select l_returnflag, unnest(['quantity', 'price']) as k, unnest([sum(l_quantity), round(sum(l_extendedprice), 2)]) as v from lineitem group by 1")
def _(t):
    g = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p"))
    return g.select("l_returnflag", F.explode(F.create_map(F.lit("quantity"), "q", F.lit("price"), "p")).alias("k", "v"))


@query("f15_map_from_entries", "select r_name, string_agg(n_name, ',' order by n_nationkey) as children from nation join region on r_regionkey = n_regionkey group by 1")
def _(t):
    j = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    m = j.groupBy("r_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("m"))
    return m.select("r_name", F.array_join(F.map_values("m"), ",").alias("children"))


@query("f16_content_hash", "select doc_id, sha1(text) as digest from documents".replace("sha1(text)", "sha256(text)"))
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("f17_grow_box", "select p_partkey, greatest(p_size - 5, 0)::bigint as lo, least(p_size + 10, 40)::bigint as hi from part")
def _(t):
    lo, hi = sc.grow_box(F.col("p_size"), F.col("p_size") + 5, 5, F.lit(40))
    return t.part.select("p_partkey", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


@query("f18_probability_tails", f"select s_suppkey, {r(z_tail('(s_acctbal / 4000)'))} as normal, {r(t_tail('(s_acctbal / 4000)', '(s_nationkey + 1)::double'))} as student from supplier")
def _(t):
    z = F.col("s_acctbal") / 4000
    return t.supplier.select("s_suppkey", rnd(normal_two_sided(z)).alias("normal"), rnd(student_two_sided(z, (F.col("s_nationkey") + 1).cast("double"))).alias("student"))


@query("f19_json_fields", "select event_id, (props ->> '$.k')::bigint as k from events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").k.alias("k"))
