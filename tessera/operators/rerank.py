"""Reranking of candidates (query_id, chunk_id, score, question, text)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators.bm25 import candidate_scores
from tessera.operators.ranking import minmax, top_k


def overlap_score(question, text):
    """Distinct query tokens that the text has, as a share of the distinct query tokens."""
    q, t = F.array_distinct(tokenize(question)), tokenize(text)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, mode: str = "none", weight: float = 0.45, k: int = 5, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, score, base_score, rerank_score): the k best after mixing the scaled scores.

    mode: none, bm25 (over each query's candidates), overlap, or cross_encoder with ``scorer``, a function over batches
    of questions and texts that stands for a model.
    """
    if mode == "none":
        plain = candidates.withColumn("base_score", F.col("score")).withColumn("rerank_score", F.lit(None).cast("double"))
        return top_k(plain, k).select("query_id", "chunk_id", "rank", "score", "base_score", "rerank_score")
    if mode == "bm25":
        inner = minmax(candidate_scores(candidates), "raw", "rerank_score")
        scored = candidates.join(inner.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"], "left").fillna(0.0, ["rerank_score"])
    elif mode in ("overlap", "keyword"):
        scored = minmax(candidates.withColumn("raw", overlap_score(F.col("question"), F.col("text"))), "raw", "rerank_score")
    elif mode == "cross_encoder":
        if scorer is None:
            raise ValueError("cross_encoder needs a scorer")
        scored = minmax(candidates.withColumn("raw", F.pandas_udf(scorer, "double")("question", "text")), "raw", "rerank_score")
    else:
        raise ValueError(f"unknown rerank mode: {mode}")
    mixed = minmax(scored, "score", "base_score").withColumn("score", (1 - weight) * F.col("base_score") + weight * F.col("rerank_score"))
    return top_k(mixed, k).select("query_id", "chunk_id", "rank", "score", "base_score", "rerank_score")
