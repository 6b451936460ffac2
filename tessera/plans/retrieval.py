"""The retrieval pipeline over a batch of queries: two channels, fusion, candidate cut, reranking, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import answers, bm25
from tessera.operators.evaluation import long, mean_metrics, rank_metrics
from tessera.operators.generation import REFUSALS, build_context
from tessera.operators.ranking import best_of, fuse, top_k
from tessera.operators.rerank import rerank
from tessera.plans.config import DEFAULTS, grid, with_settings
from tessera.storage import Workspace


def retrieve(queries: DataFrame, chunks: DataFrame, lexical: list[DataFrame], dense: list[DataFrame], config: dict = DEFAULTS, scorer: Callable | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, score): final hits from the channels' hits (query_id, chunk_id, rank, score).

    chunks (chunk_id, text) are joined to the cut candidates only. A filter on chunks belongs before the channels.
    """
    r, rr = config["retrieval"], config["rerank"]
    if r["hybrid"]:
        every = fuse([("vector", h, r["vector_weight"]) for h in dense] + [("bm25", h, r["bm25_weight"]) for h in lexical], r["rrf_k"])
        every = every.select("query_id", "chunk_id", "score", *(c for c in ("vector_rank", "bm25_rank") if c in every.columns))
        ties = tuple(F.col(c).asc_nulls_last() for c in ("vector_rank", "bm25_rank") if c in every.columns)
    else:
        every, ties = best_of(dense), ()
    candidates = top_k(every, r["candidate_k"], ties=(*ties, "chunk_id")).where(F.col("rank") <= (rr["input_k"] or r["candidate_k"])).drop("rank")
    if rr["mode"] == "none":
        return top_k(candidates, min(rr["top_k"], r["top_k"]), ties=(*ties, "chunk_id")).select("query_id", "chunk_id", "rank", "score")
    rows = candidates.join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "question"), "query_id")
    return rerank(rows, rr["mode"], rr["weight"], min(rr["top_k"], r["top_k"]), scorer).select("query_id", "chunk_id", "rank", "score")


def ask(
    questions: DataFrame, search: Callable[[DataFrame], DataFrame], chunks: DataFrame, make: answers.Make, system: str = "", rewrite: Callable[[DataFrame], DataFrame] | None = None,
    correct: dict | None = None, images: int = 3, max_chars: int = 600,
) -> DataFrame:
    """(query_id, decision, answer, images_used, sources): questions (query_id, question, ...) answered over what a search finds.

    search takes (query_id, question) and gives hits (query_id, chunk_id, rank); chunks (chunk_id, source_id, title, text, and modality and
    image_path for figures) are joined to the hits only. rewrite makes the searched questions (query_id, question) of
    all columns of questions, such as earlier turns; a question that it leaves out is searched as it is. correct holds the arguments of
    ``corrective_retrieval`` besides: with it an abstained question gets a refusal, and no request; without it decision is null.
    A question without hits is asked with an empty context. answer is null where the model fails. query_id is a key.
    """
    work = Workspace(questions.sparkSession, "ask")
    asked = questions.select("query_id", "question")
    searched = asked
    if rewrite is not None:
        new = rewrite(questions).select("query_id", F.col("question").alias("new"))
        searched = work.save(asked.join(new, "query_id", "left").select("query_id", F.coalesce(F.nullif("new", F.lit("")), "question").alias("question")), "searched")
    if correct is None:
        hits, decided = work.save(search(searched), "hits"), asked.select("query_id", F.lit(None).cast("string").alias("decision"))
    else:
        hits, decided = answers.corrective_retrieval(searched, search, **correct)
    found = work.save(hits.select("query_id", "chunk_id", "rank").join(chunks, "chunk_id"), "found")
    contexts = work.save(build_context(found, max_chars), "contexts")
    shown = answers.figure_images(found, images) if {"modality", "image_path"} <= set(found.columns) else None
    refused = decided.where("decision = 'abstain'").select("query_id")
    prompts = answers.context_prompts(asked.join(refused, "query_id", "left_anti"), contexts, shown)
    replied = work.save(answers.answered(prompts, make, system).select("query_id", "answer", "images_used"), "answers")
    replied = replied.unionByName(refused.select("query_id", F.lit(REFUSALS[0]).alias("answer"), F.array().cast("array<string>").alias("images_used")))
    return replied.join(decided.select("query_id", "decision"), "query_id").join(contexts.select("query_id", "sources"), "query_id", "left").select("query_id", "decision", "answer", "images_used", "sources")


def evaluate_stages(stages: dict[str, DataFrame], gold: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(stage, metric, mean, n) of ranked lists (query_id, chunk_id, rank). sources (chunk_id, source_id) says which
    document a chunk is of; without it chunks are documents."""
    rows = []
    for name, hits in stages.items():
        of = hits.join(sources, "chunk_id") if sources is not None else hits.withColumn("source_id", F.col("chunk_id"))
        rows.append(long(rank_metrics(of, gold), name))
    return mean_metrics(reduce(DataFrame.unionByName, rows))


def sweep(base: dict, vary: dict[str, list], run: Callable[[dict], DataFrame]) -> DataFrame:
    """The metric tables of run(config) for every combination of settings, with the combination in column ``label``."""
    tables = []
    for combination in grid(vary):
        settings = [f"{k}={v}" for k, v in combination.items()]
        tables.append(run(with_settings(base, settings)).withColumn("label", F.lit(",".join(settings))))
    return reduce(DataFrame.unionByName, tables)


def build_index(chunks: DataFrame) -> bm25.Index:
    return bm25.build(chunks)
