"""Vector search: exact top-k of a stated query set against all rows, in blocks of queries.

Each task multiplies its rows with a block of query vectors and keeps the k best of every query, so that k rows a task
and query reach the shuffle. Scores are similarities: the cosine, the inner product, or minus the squared distance.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip
from tessera.operators.ranking import DIGITS, top_k
from tessera.storage import spread

#: Query vectors held in a task at once, and scores computed at once, so that a task's memory grows with neither queries nor rows.
BLOCK, SCORES_AT_ONCE = 1024, 1 << 19
HITS = "query_id long, chunk_id long, score double"


def _blocks(queries: DataFrame, id_col: str, vector_col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vectors = [], []
    for row in queries.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == BLOCK:
            yield np.array(ids), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.array(vectors, np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def _best(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The k best rows of all batches for each query vector of q."""
    held_ids, held = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
    step = max(k, SCORES_AT_ONCE // len(ids))
    for batch in (whole.slice(at, step) for whole in batches for at in range(0, len(whole), step)):
        m = batch.column("v").flatten().to_numpy().reshape(len(batch), -1)
        chunk = batch.column("chunk_id").to_numpy()
        if metric == "cosine":
            s = q @ _unit(m).T
        elif metric == "ip":
            s = q @ m.T
        else:
            s = -((q**2).sum(1)[:, None] - 2 * q @ m.T + (m**2).sum(1)[None, :])
        held_ids, held = np.concatenate([held_ids, np.broadcast_to(chunk, s.shape)], axis=1), np.concatenate([held, s], axis=1)
        order = np.lexsort((held_ids, -np.floor(held * 10**DIGITS + 0.5)), axis=1)[:, :k]
        held_ids, held = np.take_along_axis(held_ids, order, 1), np.take_along_axis(held, order, 1)
    n = held.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(held_ids.reshape(-1)), pa.array(held.reshape(-1))], ["query_id", "chunk_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, rank, score): the k best rows for each query, ties by chunk_id. metric: cosine, ip or l2.

    Null vectors are left out. The query set is streamed to the driver in blocks and never held whole.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("chunk_id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and chunk_id is not null")
    every = None
    for ids, q in _blocks(queries.where(F.col(query_vector).isNotNull()), query_id, query_vector):

        def best(batches, ids=ids, q=_unit(q) if metric == "cosine" else q):
            return _best(batches, ids, q, k, metric)

        one = rows.mapInArrow(best, HITS)
        every = one if every is None else every.unionByName(one)
    if every is None:
        every = vectors.sparkSession.createDataFrame([], HITS)
    return top_k(every, k).select("query_id", "chunk_id", "rank", "score")


#: Words and n-grams whose buckets a worker remembers.
REMEMBERED = 1 << 18


class _Buckets:
    """The buckets of a word's n-grams. Words are padded with a space on both sides; a padded word no longer than n gives itself
    once, at the first n that reaches it."""

    def __init__(self, dimension: int, shortest: int, longest: int):
        self.dimension, self.lengths = dimension, range(shortest, longest + 1)
        self.words: dict[str, np.ndarray] = {}
        self.grams: dict[str, int] = {}

    def bucket(self, gram: str) -> int:
        if (found := self.grams.get(gram)) is None:
            if len(self.grams) >= REMEMBERED:
                self.grams.clear()
            found = self.grams[gram] = int(hashlib.md5(gram.encode(), usedforsecurity=False).hexdigest()[:8], 16) % self.dimension
        return found

    def of(self, word: str) -> np.ndarray:
        if (found := self.words.get(word)) is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            p = f" {word} "
            lengths = [n for n in self.lengths if len(p) >= n or n == self.lengths[0]]
            found = self.words[word] = np.array([self.bucket(p[i : i + n]) for n in lengths for i in range(max(1, len(p) - n + 1))], np.int64)
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, n-grams in each) of a text, by bucket."""
        held = Counter(w for w in text.split(" ") if w)
        found = [self.of(w) for w in held]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        times = np.repeat(np.fromiter(held.values(), np.float64, len(held)), [len(f) for f in found])
        every = np.concatenate(found)
        if self.dimension > 1 << 16:
            buckets, place = np.unique(every, return_inverse=True)
            return buckets, np.bincount(place, times)
        n = np.bincount(every, times, self.dimension)
        buckets = np.nonzero(n)[0]
        return buckets, n[buckets]


def _hashed(docs: DataFrame, id_col: str, text_col: str, dimension: int, shortest: int, longest: int, dense: bool) -> DataFrame:
    """One narrow pass: texts are cleaned by Spark, and hashed in Arrow batches."""
    clean = F.regexp_replace(F.lower(strip(F.coalesce("text", F.lit("")))), r"\s+", " ")
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", clean.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        buckets = _Buckets(dimension, shortest, longest)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                found = [buckets.counts(t) for t in part.column("text").to_pylist()]
                row = np.repeat(np.arange(len(found)), [len(b) for b, _ in found])
                bucket = np.concatenate([b for b, _ in found]).astype(np.int64)
                value = np.concatenate([n / np.sqrt((n * n).sum()) for _, n in found])
                if dense:
                    m = np.zeros((len(found), dimension))
                    m[row, bucket] = value
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dimension, pa.int32()), pa.array(m.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([part.column("id"), flat], ["id", "embedding"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(bucket, pa.int32()), pa.array(value)], ["id", "bucket", "value"])

    return rows.mapInArrow(run, f"id {kind}, " + ("embedding array<double>" if dense else "bucket int, value double"))


def hash_features(docs: DataFrame, id_col: str, text_col: str, dimension: int = 768, shortest: int = 2, longest: int = 4) -> DataFrame:
    """(id, bucket, value), a row for each bucket that isn't empty: character n-grams within words, hashed to buckets and scaled to unit
    length. The bucket is taken from the first eight hexadecimal digits of the md5, which other engines compute alike. Each row of
    docs is embedded for itself, without a shuffle."""
    return _hashed(docs, id_col, text_col, dimension, shortest, longest, False)


def hash_embed(docs: DataFrame, id_col: str, text_col: str, dimension: int = 768) -> DataFrame:
    """(id, embedding): hash_features() as dense vectors; texts without a word have zeros only."""
    return _hashed(docs, id_col, text_col, dimension, 2, 4, True)


def cache_lookup(cache: DataFrame, queries: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, score, hit): the most similar cached entry of each query, a hit from the threshold on."""
    best = search(cache, queries, 1, "cosine", id_col, vector_col)
    return best.select("query_id", "chunk_id", "score", (F.col("score") >= threshold).alias("hit"))


def cache_put(cache: DataFrame, new: DataFrame, capacity: int = 5000) -> DataFrame:
    """The cache with new entries, first in, first out, at most ``capacity`` of them by their column ts."""
    return cache.unionByName(new).orderBy(F.col("ts").desc()).limit(capacity)


def cache_statistics(lookups: DataFrame) -> DataFrame:
    """One row: lookups, hits, hit_rate, ms_saved of lookups (hit, lookup_ms, answer_ms); a hit saves what the answer took beyond the
    lookup. A missing time counts as 0, no lookups give a rate of 0."""
    ms = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    hits = F.count_if(F.col("hit"))
    saved = F.sum(F.when(F.col("hit"), F.greatest(ms("answer_ms") - ms("lookup_ms"), F.lit(0.0))))
    return lookups.agg(F.count("*").alias("lookups"), hits.alias("hits"), F.coalesce(hits / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("hit_rate"), F.coalesce(saved, F.lit(0.0)).alias("ms_saved"))
