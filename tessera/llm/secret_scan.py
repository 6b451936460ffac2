"""Secret scans with an incremental ledger of blobs.

Every version of a document is addressed by the digest of its text (its blob). The ledger lists the blobs that each
version of the rules has been run over, with the spans found. A scan runs the rules over unseen pairs of blob and rule
version only, appends them to the ledger, and joins the spans back to every path that ever held the blob.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import content_digest, texts
from tessera.storage import Workspace, exists

#: covered: how far the spans before this one reach, or 0. A redaction keeps what lies between there and the start.
SPANS = "array<struct<start:int,rule:int,kind:string,end:int,covered:int>>"
LEDGER_SCHEMA = f"digest binary, rule_version string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


#: The three base rules. ``+`` and a later check of the length, where a failing match uses up its text;
#: the other two match maximal runs or nothing, so that the length can stand in the pattern.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """Of each match of one rule: its number, the lengths of the text before it and of itself, and whether it is long enough."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("match"))

    def one(pair, at):
        kept = F.length(F.regexp_extract(pair["match"], rule.pattern, rule.group)) >= rule.least
        return F.struct(F.lit(number).alias("rule"), F.lit(rule.kind).alias("kind"), at.alias("nth"), F.length(pair["gap"]).alias("gap"), F.length(pair["match"]).alias("match"), kept.alias("kept"))

    none = F.array().cast("array<struct<rule:int,kind:string,nth:int,gap:int,match:int,kept:boolean>>")
    return F.when(text.rlike(rule.pattern), F.transform(F.filter(pairs, lambda pair: pair["match"].isNotNull()), one)).otherwise(none)


def secret_spans(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(digest, spans) of blobs (digest, text): spans of all rules by start, then in the order of the rules.

    Positions are code points, ends exclusive. The texts between matches and the matches give every position as a running sum
    over the matches of one blob, so the work grows with the text and its matches, however many there are.
    """
    matches = blobs.select("digest", F.explode_outer(F.flatten(F.array(*(_matches(F.col("text"), r, i) for i, r in enumerate(rules))))).alias("m")).select("digest", "m.*")
    upto = Window.partitionBy("digest", "rule").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("match")).over(upto).cast("int")
    spans = matches.withColumn("end", end).withColumn("start", F.col("end") - F.col("match")).withColumn("reach", F.when(F.col("kept"), F.col("end")))
    before = Window.partitionBy("digest").orderBy("start", "rule").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("covered", F.coalesce(F.max("reach").over(before), F.lit(0)))
    span = F.when(F.col("kept"), F.struct("start", "rule", "kind", "end", "covered"))
    return spans.groupBy("digest").agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))


def _has_match(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule matches, also by a match that is too short. Most texts have none, and need not be moved."""
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).rlike(r.pattern) for r in rules], F.lit(False))


def ledger(spark, ledger_path: str, version: str) -> DataFrame | None:
    if not exists(spark, ledger_path):
        return None
    return spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", True).parquet(ledger_path).where(F.col("rule_version") == version)


def scan(versions: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row of versions; spans is an empty array where nothing was found.

    versions: one row for each version of a path; other columns are ignored. A null text is an empty one. Rows with the
    same text share one scan, also with rows of earlier calls on the same ``ledger_path``. Repeated rows and null ids are
    returned as they come. An empty table gives an empty result, and an empty batch in the ledger.
    """
    spark = versions.sparkSession
    work = Workspace(spark, "secret-scan")
    ledger_path = ledger_path or work.new_path("ledger")
    version = rules_version(rules)
    keyed = texts(versions, id_col, text_col).withColumn("digest", content_digest(F.col("text")))
    # texts without a match go into the ledger by their digests alone
    blobs = keyed.select("digest", F.when(_has_match(F.col("text"), rules), F.col("text")).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    seen = ledger(spark, ledger_path, version)
    unseen = blobs if seen is None else blobs.join(seen.select("digest").distinct(), "digest", "left_anti")
    secret_spans(unseen, rules).select("digest", F.lit(version).alias("rule_version"), "spans").write.mode("overwrite").parquet(f"{ledger_path}/{uuid.uuid4().hex}")
    found = ledger(spark, ledger_path, version).where(F.size("spans") > 0).select("digest", "spans")
    if seen is not None:  # two jobs may have scanned one blob; both found the same
        found = found.dropDuplicates(["digest"])
    return keyed.select("doc_id", "digest").join(found, "digest", "left").select("doc_id", F.coalesce("spans", F.lit([]).cast(SPANS)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


#: Characters of the blocks in which a redaction reads a text.
BLOCK = 1024


def blocks_of(text: Column) -> Column:
    """A text in blocks of BLOCK characters, so that a piece of it is reached without going through all that lies before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def redact(text: Column, blocks: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with every span replaced by the mask; spans that overlap are replaced by one. blocks: a column of blocks_of(text)."""

    def piece(start, end):
        first = F.floor(start / BLOCK).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(some, start - first * BLOCK + 1, end - start)).otherwise("")

    kept = F.filter(spans, lambda s: s["start"] >= s["covered"])
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    out = F.concat(F.array_join(F.transform(kept, lambda s: F.concat(piece(s["covered"], s["start"]), F.lit(mask))), ""), piece(end, F.length(text)))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def redacted(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES, text_col: str = "text", chars_col: str = "n_chars", mask: str = "[secret]") -> DataFrame:
    """docs with every secret in a text masked; all rows and columns stay, and ``chars_col`` follows the new text.

    Null and empty texts stay as they are, repeated rows are masked alike, and an empty table stays empty. The ledger says which blobs hold secrets; rows that a
    rule matches are joined to it by digest, the others pass unchanged and are not shuffled.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "redacted")
    ledger_path = ledger_path or work.new_path("ledger")
    scan(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")), ledger_path, rules)
    found = ledger(spark, ledger_path, rules_version(rules)).where(F.size("spans") > 0).select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans")).dropDuplicates(["__digest"])
    has = _has_match(F.col(text_col), rules)
    keyed = docs.where(has).withColumn("__digest", content_digest(F.coalesce(F.col(text_col), F.lit(""))))
    joined = keyed.join(found, "__digest", "left").withColumn("__blocks", F.when(F.col("__spans").isNotNull(), blocks_of(F.col(text_col))))
    joined = joined.withColumn("__text", F.when(F.col("__spans").isNotNull(), redact(F.col(text_col), F.col("__blocks"), F.col("__spans"), mask)).otherwise(F.col(text_col)))
    out = {text_col: F.col("__text")}
    if chars_col in docs.columns:
        out[chars_col] = F.when(F.col("__spans").isNotNull(), F.length("__text").cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return docs.where(~has).unionByName(joined.select(*(out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns)))
