"""Token counts through a digest cache.

A text's digest and the tokenizer's version are the key of a stored count. Counting joins the digests of a corpus to the
cache, encodes each distinct text that the cache lacks once, appends those counts, and joins the counts back to all
documents. The cache is a Parquet folder of append-only batches.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import content_digest, map_arrow, texts
from tessera.llm.tokens import encoder, tokenizer_version
from tessera.storage import Workspace, exists

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def _counts(path: str, version: str):
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(ids) // 4 for ids in encoder(path).encode(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    return count


def cached_counts(spark, cache_path: str, version: str) -> DataFrame | None:
    """The counts of one tokenizer version, each digest once, or None if nothing has been stored yet."""
    if not exists(spark, cache_path):
        return None
    stored = spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", True).parquet(cache_path)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    docs: any table with an id and a text; other columns are ignored. A null or empty text has 0 bytes and 0 tokens.
    Repeated rows and repeated ids are all returned; their texts are encoded once. A null id is kept as it is. An empty
    table gives an empty result. A text of any length is encoded whole; special strings in it count as the library
    counts them by default. ``cache_path``: a folder kept between calls; without it a fresh one is used.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "token-counts")
    cache_path = cache_path or work.new_path("cache")
    version = tokenizer_version(tokenizer_path)
    keyed = texts(docs, id_col, text_col).withColumn("digest", content_digest(F.col("text")))
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    known = cached_counts(spark, cache_path, version)
    misses = distinct if known is None else distinct.join(known, "digest", "left_anti")
    map_arrow(misses, _counts(tokenizer_path, version), CACHE_SCHEMA).write.mode("overwrite").parquet(f"{cache_path}/{uuid.uuid4().hex}")
    if known is None:  # the batch just written holds each digest once
        stored = spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", True).parquet(cache_path).select("digest", "n_tokens")
    else:
        stored = cached_counts(spark, cache_path, version)
    rows = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return rows.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
