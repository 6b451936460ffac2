"""Where models come in: registries of functions over batches, loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import fuse
from tessera.operators.vectors import hash_embed, search

#: name -> load() -> embed(list of texts) -> matrix. ``load`` runs on the worker.
EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}


def register_embedder(name: str, load: Callable) -> None:
    EMBEDDERS[name] = load


def embed(docs: DataFrame, id_col: str, text_col: str, provider: str = "hash", dimension: int = 768, normalise: bool = True) -> DataFrame:
    """(id, embedding) by the hashed n-grams or a registered embedder; null texts are embedded as empty ones."""
    if provider == "hash":
        return hash_embed(docs, id_col, text_col, dimension)
    load = EMBEDDERS[provider]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            m = np.asarray(model(pdf["text"].fillna("").tolist()), np.float64).reshape(len(pdf), -1)
            if normalise:
                norms = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(norms == 0, 1, norms)
            yield pd.DataFrame({"id": pdf["id"], "embedding": list(m)})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>")


def figure_search(captions: DataFrame, images: DataFrame, asked_captions: DataFrame, asked_images: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """Hits of captions, of images, and of both fused with weight one over lists of 2k. Tables are (vec_id, embedding) and
    (query_id, embedding); a figure has one vec_id in both."""
    by_caption, by_image = search(captions, asked_captions, 2 * k), search(images, asked_images, 2 * k)
    return {"caption": by_caption, "image": by_image, "fused": fuse([("caption", by_caption, 1.0), ("image", by_image, 1.0)])}


def name_hits(hits: DataFrame, names: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hit): whether one of a query's first k hits has a name that contains the part wanted.
    names: chunk_id, name; wanted: query_id, part."""
    found = hits.where(F.col("rank") <= k).join(names, "chunk_id").join(wanted, "query_id")
    return wanted.select("query_id").join(found.groupBy("query_id").agg(F.max(F.contains("name", "part")).alias("hit")), "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def trace_summary(spans: DataFrame, usage: DataFrame) -> DataFrame:
    """(trace_id, total_ms, stages, usage): spans (trace_id, name, ms) summed by name, and tokens by model."""
    by_name = spans.groupBy("trace_id", "name").agg(F.sum("ms").alias("ms"))
    stages = by_name.groupBy("trace_id").agg(F.sum("ms").alias("total_ms"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "ms")))).alias("stages"))
    by_model = usage.groupBy("trace_id", "model").agg(F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))
    tokens = by_model.groupBy("trace_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", F.struct("prompt", "completion").alias("u"))))).alias("usage"))
    return stages.join(tokens, "trace_id", "left")
