"""Secret scans over a ledger of content-addressed blobs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.session import scratch_path


class Rule(NamedTuple):
    """A kind of secret: matches are leftmost and non-overlapping; those whose `group` is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


#: Kinds, patterns and lengths as asked for.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
RULE_VERSION = "1"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def blob_of(text: Column) -> Column:
    """Content address: SHA-256 of the UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points.

    The pieces between the matches and the matches alternate, so a match starts after all pieces and matches before it.
    """
    pattern = F.lit(rule.pattern)
    # a long maximal run of one class starts where the same run of at least `least` characters starts
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.transform(F.split(text, rule.pattern, -1), F.length)
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # running (start, end) without recomputing sums: fold over match numbers
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + F.length(m["match"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(m["group"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    rows = F.zip_with(F.zip_with(matches, kept, lambda m, g: F.struct(m.alias("match"), g.alias("group"))), F.slice(sizes, 1, F.size(matches)),
                      lambda m, s: F.struct(m["match"].alias("match"), m["group"].alias("group"), s.alias("gap")))
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans by start, then rule order. Texts without a match of a rule skip its span arithmetic."""
    none = F.array().cast(SPAN)
    found = []
    for rank, rule in enumerate(rules):
        # the run rules need one pass to see that no run is long enough
        test = f"{rule.pattern[:-1]}{{{rule.least},}}" if rule.kind == "hex" else rule.pattern
        found.append(F.when(text.rlike(test), _spans(text, rule, rank)).otherwise(none))
    return F.array_sort(F.concat(*found))


def read_ledger(spark, ledger: str) -> DataFrame:
    """(blob, rule_version, spans): one row per scanned pair; a pair written twice by a repeated job counts once."""
    return spark.read.schema(f"blob string, rule_version string, spans {SPAN}").parquet(ledger)


def scan_versions(
    versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: str | None = None,
    rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(path, blob, spans) for every version, with the columns named in `carry`.

    `ledger` is a Parquet folder in a shared store; None starts a new one in the scratch folder. Each distinct blob that the
    ledger does not hold under `rule_version` is scanned once, whatever the number of paths and versions that have it, and
    appended in one write: if the job fails, the ledger has either all new rows or none. Findings then go to all
    paths by blob; copies of one blob are only counted together before the shuffle, and adaptive execution splits their join.

    Null texts count as empty and have no spans. Repeated rows stay. An empty table gives an empty result and adds nothing. Columns
    other than the named ones are not read, and carried ones may bear any name but `blob` and `spans`.
    """
    spark = versions.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    v = versions.select(F.col(path).alias("__path"), F.coalesce(F.col(text), F.lit("")).alias("__text"), *[F.col(c) for c in carry])
    v = v.withColumn("blob", blob_of(F.col("__text")))
    # an append of nothing makes the folder, so the first run has no case of its own
    spark.createDataFrame([], f"blob string, rule_version string, spans {SPAN}").write.mode("append").parquet(ledger)
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    unseen = v.groupBy("blob").agg(F.first("__text").alias("__text")).join(seen, "blob", "left_anti")
    new = unseen.select("blob", F.lit(rule_version).alias("rule_version"), find_spans(F.col("__text"), rules).alias("spans"))
    new.write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).where(F.size("spans") > 0)
    found = found.groupBy("blob").agg(F.first("spans").alias("spans"))
    out = v.join(found, "blob", "left")
    return out.select(F.col("__path").alias(path), *[c for c in carry if c != path], "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by `mark`; overlapping and touching spans share one."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = s["start"] - acc["at"]
        fresh = (gap > 0) | (acc["at"] == 0)
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(gap, F.lit(0))), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(spans, begin, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
