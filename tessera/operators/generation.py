"""Answer generation around a pluggable model: context, citations, grading, corrective retrieval, judging."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import json_array, json_object

#: Phrases that mark an answer as a refusal.
REFUSALS = ("资料中没有", "没有相关信息", "无法回答", "资料不足")


def build_context(hits: DataFrame, max_chars: int = 600) -> DataFrame:
    """hits (query_id, rank, source_id, title, text) -> (query_id, context, sources): numbered blocks, and what each number stands for."""
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("source_id")), F.lit("\n"), F.left(F.coalesce("text", F.lit("")), F.lit(max_chars)))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), block.alias("block"), "source_id"))).alias("rows"))
    return rows.select("query_id", F.array_join("rows.block", "\n\n").alias("context"), F.transform("rows", lambda r: F.struct(r["n"].alias("n"), r["source_id"].alias("source_id"))).alias("sources"))


def citation_metrics(answers: DataFrame, refusals: tuple[str, ...] = REFUSALS) -> DataFrame:
    """answers (query_id, answer, sources array<struct<n, source_id>>, expected array<string>) -> one row of citation metrics.

    gold_cited is null if no expected source was retrieved; without a citation validity and precision are 0.
    """
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))
    rows = answers.withColumn("cited", cited).withColumn("known", F.transform("sources", lambda s: s["n"].cast("int")))
    rows = rows.withColumn("valid", F.filter("cited", lambda n: F.array_contains("known", n)))
    rows = rows.withColumn("cited_sources", F.array_distinct(F.transform(F.filter("sources", lambda s: F.array_contains("valid", s["n"].cast("int"))), lambda s: s["source_id"])))
    right = F.size(F.array_intersect("cited_sources", "expected"))
    retrieved = F.arrays_overlap(F.transform("sources", lambda s: s["source_id"]), "expected")
    abstained = F.greatest(*(F.contains("answer", F.lit(m)) for m in refusals))
    return rows.select(
        "query_id", F.size("cited").alias("n_citations"),
        F.when(F.size("cited") > 0, F.size("valid") / F.size("cited")).otherwise(0.0).alias("citation_valid"),
        F.when(F.size("cited_sources") > 0, right / F.size("cited_sources")).otherwise(0.0).alias("citation_precision"),
        F.when(retrieved, (right > 0).cast("double")).alias("gold_cited"), retrieved.alias("retrieved_gold"), abstained.alias("abstained"), (abstained == ~retrieved).alias("abstain_correct"),
    )


def grades(replies: DataFrame, k: int = 5) -> DataFrame:
    """replies (query_id, reply) -> (query_id, scores): a model's JSON list of {i, score}, clamped to 0..1; a missing one is 0."""
    rows = json_array(F.col("reply"), "struct<i:int,score:double>")
    score = lambda i: F.coalesce(F.try_element_at(F.transform(F.filter(rows, lambda r: r["i"] == i), lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["score"]))), F.lit(-1)), F.lit(0.0))
    return replies.select("query_id", F.array(*(score(i) for i in range(k))).alias("scores"))


def corrective_decision(top: Column, rewritten_top: Column, high: float = 0.6, low: float = 0.3) -> Column:
    """proceed, refined or abstain, from the best score before and (null: none) after a rewrite."""
    after = F.coalesce(rewritten_top, F.lit(-1.0))
    return F.when(top >= high, "proceed").when(top < low, F.when(after >= low, "refined").otherwise("abstain")).when(after > top, "refined").otherwise("proceed")


def corrective_summary(rows: DataFrame) -> DataFrame:
    """One row of counts and rates from (query_id, base_hit, final_hit, decision)."""
    hit, refused = F.col("base_hit"), F.col("decision") == "abstain"
    refined = F.col("decision") == "refined"
    counted = rows.agg(
        F.count("*").alias("n"), F.count_if(hit).alias("retrieved_ok"), F.count_if(~hit).alias("should_abstain"), F.count_if(~hit & refused).alias("correct_abstain"),
        F.count_if(hit & refused).alias("false_abstain"), F.count_if(~hit & refined & F.col("final_hit")).alias("recovered"), F.count_if(refined).alias("refined_total"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counted.select("*", rate("correct_abstain", "should_abstain").alias("abstain_recall"), rate("false_abstain", "retrieved_ok").alias("false_abstain_rate"))


def judge_means(replies: DataFrame) -> DataFrame:
    """(n, n_parsed, faithfulness, relevance): means over the judge's replies that are JSON objects."""
    o = json_object(F.col("reply"), "faithfulness double, relevance double")
    rows = replies.select(o.alias("o")).withColumn("ok", F.col("o").isNotNull() & (F.col("o.faithfulness").isNotNull() | F.col("o.relevance").isNotNull()))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("ok"), F.coalesce(f"o.{c}", F.lit(0.0)))), F.lit(0.0)).alias(c)
    return rows.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_parsed"), mean("faithfulness"), mean("relevance"))


def cacheable(answer: Column, refusals: tuple[str, ...] = REFUSALS) -> Column:
    """An answer that is present and no refusal."""
    return (F.coalesce(answer, F.lit("")) != "") & ~F.greatest(*(F.contains(F.coalesce(answer, F.lit("")), F.lit(m)) for m in refusals))


class RetryableError(Exception):
    """A failure of a model's service that may pass: too many requests, a server's error, a network's."""


class ChatClient:
    """Routes roles to models and retries, around ``send(model, messages, **options) -> (text, usage)``."""

    def __init__(self, send: Callable, roles: dict[str, str] | None = None, default: str = "default", retries: int = 2, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep):
        self.send, self.roles, self.default, self.retries, self.pause, self.sleep = send, roles or {}, default, retries, pause, sleep

    def chat(self, messages: list[dict[str, str]], role: str = "generate", **options) -> dict:
        model = self.roles.get(role, self.default)
        for attempt in range(self.retries + 1):
            try:
                text, usage = self.send(model, messages, **options)
                return {"text": text, "usage": usage, "model": model, "alias": role}
            except RetryableError:
                if attempt == self.retries:
                    raise
                self.sleep(self.pause * 2**attempt)
        raise AssertionError


def visible(deltas: Iterator[str]) -> Iterator[str]:
    """A stream of text without its <think> blocks, also where a tag is cut between two deltas or both tags lie in one."""
    held, inside = "", False
    for delta in deltas:
        held += delta
        while True:
            tag = "</think>" if inside else "<think>"
            at = held.find(tag)
            if at >= 0:
                if not inside and at:
                    yield held[:at]
                held, inside = held[at + len(tag) :], not inside
                continue
            keep = next((n for n in range(min(len(tag) - 1, len(held)), 0, -1) if tag.startswith(held[-n:])), 0)
            if not inside and len(held) > keep:
                yield held[: len(held) - keep]
            held = held[len(held) - keep :]
            break
    if held and not inside:
        yield held


def event_deltas(lines: Iterable[str | bytes]) -> Iterator[str]:
    """The pieces of text in server-sent events of a chat service, to be passed to ``visible``. An event is its data lines up to a blank
    one; other fields, comments and events that are no JSON object with a piece are passed over; [DONE] ends the stream."""
    data: list[str] = []

    def piece() -> str:
        try:
            found = json.loads("\n".join(data))["choices"][0]["delta"]["content"]
        except (ValueError, LookupError, TypeError):
            return ""
        return found if isinstance(found, str) else ""

    for raw in lines:
        line = (raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw).rstrip("\r\n")
        if line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))
            if data == ["[DONE]"]:
                return
        elif not line and data:
            if text := piece():
                yield text
            data = []
    if data and (text := piece()):
        yield text
