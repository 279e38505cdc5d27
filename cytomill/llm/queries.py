"""The runnable query of each operator with production parameters, and the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomill.llm import align, decontaminate, neardup, packing, pieces, quality, rules, secrets, substrings, toxicity, urls, warc, whitening
from cytomill.session import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

URL_RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_versions(table(spark, folder, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = secrets.spans_text(F.col("spans"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  select row_id, {rank} as rank, '{kind}' as kind, i,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as s,
    length(hits[i]) as n, length(parts[i]) as kept, {least} as least
  from (select row_id, regexp_split_to_array(txt, '{quoted}') as gaps, regexp_extract_all(txt, '{quoted}') as hits,
               regexp_extract_all(txt, '{quoted}', {group}) as parts from d where regexp_matches(txt, '{quoted}')),
    lateral (select unnest(range(1, len(hits) + 1)) as i)"""


ORACLES["op3_secret_scan"] = f"""
with d as (select row_number() over () as row_id, doc_id, coalesce(text, '') as txt from documents),
spans as ({' union all '.join(_sql_spans(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(secrets.RULES))}),
joined as (
  select row_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, rank) as spans
  from spans where kept >= least group by row_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join joined using (row_id)"""


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = {r: f"(host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}')" for r in _BY_LENGTH}
# the tables declare no aliases (no canonical or refresh links), so a url that no rule fits is allowed
ORACLES["op7_url_filter"] = f"""
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages)
select page_id, host, path,
  case {' '.join(f"when {_FITS[r]} then '{r[1] + r[2]}'" for r in _BY_LENGTH)} end as rule,
  case {' '.join(f"when {_FITS[r]} then '{r[0]}'" for r in _BY_LENGTH)} else 'allow' end as verdict
from p"""


@query
def op9_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    archives = cut(warc.write_archives(table(spark, folder, "pages")))
    return warc.read_archives(archives).select(
        warc.page_key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_key("refers_to").alias("refers_to")
    )


ORACLES["op9_warc_archive"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as newest from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> newest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> newest then newest end as refers_to
from q"""


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    h = F.col("hits")
    covered = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return decontaminate.with_hits(docs, table(spark, folder, "benchmark")).select(
        "doc_id", h["n_words"].alias("n_words"), covered.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"),
    )


_ALNUM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op10_decontaminate"] = f"""
with d as (select row_number() over () as row_id, doc_id, {_ALNUM} as w from documents),
items as (select item_id, {_ALNUM} as w from benchmark where text is not null and item_id is not null),
phrases as (
  select distinct item_id, least(len(w), 10) as m, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') as phrase
  from items, lateral (select unnest(range(1, greatest(1, len(w) - 9) + 1)) as i) where len(w) > 0),
lengths as (select distinct m from phrases),
windows as (
  select row_id, i, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') as phrase
  from d, lengths, lateral (select unnest(range(1, len(w) - m + 2)) as i) where len(w) >= m),
occurs as (select row_id, i, m, item_id from windows join phrases using (m, phrase)),
covered as (select row_id, count(distinct p) as n_hit from (select row_id, unnest(range(i, i + m)) as p from occurs) group by row_id),
listed as (select row_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct row_id, cast(item_id as varchar) as item from occurs) group by row_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (row_id) left join listed using (row_id)"""


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    measured = cut(docs.select("doc_id", rules.measures(F.col("text")).alias("measures")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rules.judge(measured, rules.fit(measured)).select("doc_id", *[F.col(f"measures.{c}") for c in names], "verdict.base_failed", "verdict.kept", "verdict.probability")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = toxicity.train(docs, labels, ~held_out)
    s = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    _, _, model = quality.train(docs)
    s = docs.select("doc_id", quality.score(F.col("text"), model).alias("score"))
    return s.withColumn("kept", F.col("score") >= 0.5)


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rest = substrings.remove_repeats(table(spark, folder, "documents"))
    return rest.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op8_substring_dedup"] = r"""
with d as (select row_number() over () as row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select row_id, i, list_aggregate(w[i:i + 34], 'string_agg', ' ') as words
  from d, lateral (select unnest(range(1, len(w) - 33)) as i) where len(w) >= 35),
repeated as (select words from windows group by words having count(*) > 1),
gone as (select row_id, list(distinct p) as ps from (select row_id, unnest(range(i, i + 35)) as p from windows join repeated using (words)) group by row_id),
kept as (
  select row_id, string_agg(word, ' ' order by p) as kept
  from (select row_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) anti join (select row_id, unnest(ps) as p from gone) using (row_id, p)
  group by row_id)
select doc_id, len(w) as n_words, coalesce(len(ps), 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join gone using (row_id) left join kept using (row_id)"""


@query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    c = neardup.classes(table(spark, folder, "documents"))
    return c.select(F.col("key").alias("doc_id"), "class_id", F.col("key").eqNullSafe(F.col("class_id")).alias("kept"))


#: The public model file; a parameter of this module, not part of the repository.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op6_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = pieces.Pieces(PIECE_MODEL)
    d = table(spark, folder, "documents").select("doc_id", pieces.encode_checked(spark, F.col("doc_id"), F.col("text"), vocabulary).alias("sample"))
    ids = F.col("sample.ids")
    return d.select("doc_id", F.size(ids).cast("long").alias("n_pieces"), F.xxhash64(ids).alias("ids_hash"), "sample.lossless")


#: Public tokenizer files; parameters of this module as well.
BYTE_FILE, WORD_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/word_bpe_49k.json"


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    grid = table(spark, folder, "embeddings").select("vec_id", whitening.on_grid(F.col("embedding")).alias("x"))
    return whitening.transform(grid, whitening.fit(grid))


@query
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.align(spark, table(spark, folder, "documents"), align.read_tokenizers(BYTE_FILE, PIECE_MODEL))


@query
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, folder, "documents"), WORD_FILE)
