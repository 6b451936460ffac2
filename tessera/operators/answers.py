"""Answers of a passed-in model: prompts are made as columns, the model runs over batches of them, replies come back as a column.

A model is given as a function without arguments that makes it, once a task: ``make() -> answer(system, user, images) -> text``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.functions.text import json_object
from tessera.operators.generation import corrective_decision
from tessera.storage import Workspace

Make = Callable[[], Callable[[str, str, list[str]], str]]
#: The prompts' texts.
ASKED, GIVEN, FACTS, TOPICS = "问题：", "【资料】", "【关系事实】", "【各社区主题摘要】"
BY_CONTEXT, BY_FACTS, BY_TOPICS = "请只依据以上资料（含图片）回答，并在关键结论后标注引用编号。", "请据此回答。", "请综合回答。"
ENTITIES, RELATIONS, NO_FACTS, NO_SUMMARY, COMMUNITY = "实体：", "关系：", "知识图中没找到相关实体/关系。", "（摘要失败）", "社区"


def figure_images(hits: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, images): the first distinct images of each query's figure hits (query_id, rank, modality, image_path)."""
    first = hits.where((F.col("modality") == "figure") & (F.coalesce("image_path", F.lit("")) != "")).groupBy("query_id", "image_path").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "image_path")
    kept = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    return kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "image_path"))), lambda x: x["image_path"]).alias("images"))


def context_prompts(questions: DataFrame, contexts: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(query_id, user, images) of questions (query_id, question) and contexts (query_id, context); a question without hits has an
    empty context, images (query_id, images) are optional."""
    rows = questions.select("query_id", "question").join(contexts.select("query_id", "context"), "query_id", "left")
    rows = rows.join(images, "query_id", "left") if images is not None else rows.withColumn("images", F.lit(None).cast("array<string>"))
    user = F.concat(F.lit(ASKED), "question", F.lit(f"\n\n{GIVEN}\n"), F.coalesce("context", F.lit("")), F.lit(f"\n\n{BY_CONTEXT}"))
    return rows.select("query_id", user.alias("user"), F.coalesce("images", F.array().cast("array<string>")).alias("images"))


def answered(prompts: DataFrame, make: Make, system: str = "", out: str = "answer") -> DataFrame:
    """prompts (..., user, images) with the model's text, null where it fails, and images_used. A request that fails with images is
    made again without them; what goes wrong with one row doesn't touch the others."""
    schema = StructType([*prompts.drop("images").schema, StructField(out, StringType()), StructField("images_used", ArrayType(StringType()))])

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in batches:
            texts, used = [], []
            for user, images in zip(rows["user"], rows["images"], strict=True):
                text = None
                for tried in ([*images], []) if len(images) else ([],):
                    try:
                        text = model(system, user, tried)
                    except Exception:  # noqa: BLE001, whatever a model's service raises
                        continue
                    break
                texts.append(text)
                used.append(tried if text is not None else [])
            yield rows.drop(columns="images").assign(**{out: texts, "images_used": used})

    return prompts.mapInPandas(over, schema)


def fact_line(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat(F.lit("("), head, F.lit(") --"), relation, F.lit("--> ("), tail, F.lit(")"))


def graph_answers(questions: DataFrame, facts: DataFrame, make: Make, system: str = "") -> DataFrame:
    """(query_id, answer, n_facts, papers): questions (query_id, question) answered by their facts (query_id, hop, head, relation, tail,
    paper). A question without facts has the fixed answer, and no request."""
    line = F.struct("hop", fact_line(F.col("head"), F.col("relation"), F.col("tail")).alias("line"))
    papers = F.array_sort(F.collect_set(F.nullif(F.col("paper"), F.lit(""))))
    per = facts.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), papers.alias("papers"))
    known = questions.select("query_id", "question").join(per, "query_id")
    user = F.concat(F.lit(ASKED), "question", F.lit(f"\n\n{FACTS}\n"), F.array_join("lines.line", "\n"), F.lit(f"\n\n{BY_FACTS}"))
    prompts = known.select("query_id", "papers", F.size("lines").alias("n_facts"), user.alias("user"), F.array().cast("array<string>").alias("images"))
    done = answered(prompts, make, system).select("query_id", "answer", "n_facts", "papers")
    none = questions.join(per.select("query_id"), "query_id", "left_anti").select("query_id", F.lit(NO_FACTS).alias("answer"), F.lit(0).alias("n_facts"), F.array().cast("array<string>").alias("papers"))
    return done.unionByName(none)


def community_summaries(members: DataFrame, facts: DataFrame, make: Make, system: str = "", most_members: int = 25, most_facts: int = 30) -> DataFrame:
    """(community, size, name, summary): the map step. members (name, community), facts (community, head, relation, tail); a prompt takes
    the first of them by name. A reply that isn't JSON gives the number as name and the fixed summary."""

    def first(rows: DataFrame, value: Column, most: int, name: str) -> DataFrame:
        cut = rows.select("community", value.alias("v")).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("community").orderBy("v"))).where(F.col("nth") <= most)
        return cut.groupBy("community").agg(F.array_sort(F.collect_list("v")).alias(name))

    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    lines = first(facts, fact_line(F.col("head"), F.col("relation"), F.col("tail")), most_facts, "lines")
    rows = sizes.join(first(members, F.col("name"), most_members, "names"), "community").join(lines, "community", "left")
    user = F.concat(F.lit(ENTITIES), F.array_join("names", "、"), F.lit(f"\n{RELATIONS}\n"), F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"))
    replied = answered(rows.select("community", "size", user.alias("user"), F.array().cast("array<string>").alias("images")), make, system, "reply")
    o = json_object(F.coalesce("reply", F.lit("")), "name string, summary string")
    named = F.coalesce(o["name"], F.concat(F.lit(COMMUNITY), F.col("community").cast("string")))
    return replied.select("community", "size", named.alias("name"), F.coalesce(o["summary"], F.lit(NO_SUMMARY)).alias("summary"))


def global_answers(questions: DataFrame, summaries: DataFrame, make: Make, system: str = "") -> DataFrame:
    """(query_id, answer): the reduce step. Every question is asked over the summaries of all communities, which are as many as the
    graph has communities and make one prompt."""
    block = F.concat(F.lit(f"[{COMMUNITY}"), F.col("community").cast("string"), F.lit("] "), "name", F.lit("："), "summary", F.lit("（含 "), F.col("size").cast("string"), F.lit(" 个实体）"))
    whole = Workspace(questions.sparkSession, "global").save(summaries.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", block.alias("b")))), lambda x: x["b"]), "\n").alias("blocks")))
    user = F.concat(F.lit(ASKED), "question", F.lit(f"\n\n{TOPICS}\n"), "blocks", F.lit(f"\n\n{BY_TOPICS}"))
    prompts = questions.crossJoin(F.broadcast(whole)).select("query_id", user.alias("user"), F.array().cast("array<string>").alias("images"))
    return answered(prompts, make, system).select("query_id", "answer")


def corrective_retrieval(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], grade: Callable[[DataFrame, DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], high: float = 0.6, low: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(hits, decisions): hits (query_id, chunk_id, rank, ...) that a corrected search goes on with, and (query_id, decision, top_score,
    rewrite). questions (query_id, question); retrieve gives their hits, grade (questions, hits) -> (query_id, top) their best grade,
    rewrite (query_id, question) -> (query_id, rewrite). Only questions below ``high`` are written anew and searched again, those whose
    rewrite is the question itself aren't. An abstained question has no hits."""
    work = Workspace(questions.sparkSession, "corrective")
    hits = work.save(retrieve(questions), "hits")
    graded = questions.select("query_id", "question").join(grade(questions, hits).select("query_id", F.col("top").alias("before")), "query_id", "left")
    graded = work.save(graded.withColumn("before", F.coalesce("before", F.lit(0.0))), "graded")
    weak = graded.where(F.col("before") < high).select("query_id", "question")
    again = weak.join(rewrite(weak), "query_id").where((F.coalesce("rewrite", F.lit("")) != "") & (F.col("rewrite") != F.col("question")))
    again = work.save(again.select("query_id", F.col("rewrite").alias("question")), "rewritten")
    hits2 = work.save(retrieve(again), "hits-again")
    after = grade(again, hits2).select("query_id", F.col("top").alias("after"))
    rows = graded.join(again.select("query_id", F.col("question").alias("rewrite"), F.lit(True).alias("tried")), "query_id", "left").join(after, "query_id", "left")
    rows = rows.withColumn("after", F.when(F.col("tried"), F.coalesce("after", F.lit(0.0))))
    decided = rows.withColumn("decision", corrective_decision(F.col("before"), F.col("after"), high, low))
    refined = F.col("decision") == "refined"
    decided = work.save(decided.select("query_id", "decision", F.when(refined, F.col("after")).otherwise(F.col("before")).alias("top_score"), F.when(refined, F.col("rewrite")).alias("rewrite")), "decisions")
    kept = hits.join(decided.where("decision = 'proceed'").select("query_id"), "query_id", "left_semi")
    return kept.unionByName(hits2.join(decided.where("decision = 'refined'").select("query_id"), "query_id", "left_semi")), decided


def judged(prompts: DataFrame, make: Make, system: str = "", tries: int = 2) -> DataFrame:
    """(query_id, reply, tried): a judge's replies to prompts (query_id, user). Where a reply is no JSON object with a score, only that
    prompt is sent again, up to ``tries`` times in all; its last reply stays. ``judge_means`` takes the result. query_id is a key of prompts."""
    work = Workspace(prompts.sparkSession, "judged")
    asked, done = prompts.select("query_id", "user", F.array().cast("array<string>").alias("images")), []
    score = json_object(F.coalesce("reply", F.lit("")), "faithfulness double, relevance double")
    told = F.coalesce(score["faithfulness"], score["relevance"]).isNotNull()
    for n in range(1, tries + 1):
        replied = work.save(answered(asked, make, system, "reply").select("query_id", "user", "reply", F.lit(n).alias("tried"), told.alias("told")), f"try-{n}")
        done.append(replied if n == tries else replied.where("told"))
        asked = replied.where("not told").select("query_id", "user", F.array().cast("array<string>").alias("images"))
    return reduce(DataFrame.unionByName, done).select("query_id", "reply", "tried")
