"""Stored vectors in lists, and searches that read only the lists they ask for.

A store is a Parquet table with one folder for each list. Lists are either those of a metadata column, so that a search with a filter on
it prunes folders before anything is scored and is exact within the filter; or they are the cells of centroids, fitted on a sample of
bounded size while every row is assigned, so that a search of the nearest few cells is approximate, with exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import DIGITS, top_k
from tessera.storage import Workspace

#: Vectors that centroids are fitted on, rounds of fitting, and query vectors that a task holds at once.
SAMPLE, ROUNDS, BLOCK = 20_000, 12, 1024
HITS = "query_id long, chunk_id long, score double"


@dataclass
class Store:
    rows: DataFrame  # chunk_id, v (unit length), list: a partition column
    centroids: np.ndarray | None = None  # of list 0, 1, ...


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def fit_centroids(sample: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """n directions, by the rounds of spherical k-means over the sample; a cell that loses all its vectors starts again at one of the sample."""
    rng = np.random.default_rng(seed)
    sample = _unit(sample)
    centroids = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        cell = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        empty = np.bincount(cell, minlength=len(centroids)) == 0
        sums[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        centroids = _unit(sums)
    return centroids


def _vectors(df: DataFrame, id_col: str, vector_col: str, *more) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
    return df.select(F.col(id_col).cast("long").alias("chunk_id"), unit.alias("v"), *more).where("v is not null and chunk_id is not null")


def _written(rows: DataFrame, path: str) -> DataFrame:
    """A folder for each list; a large list is written by several tasks, small ones share one."""
    rows.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def store_by(vectors: DataFrame, column: str, path: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> Store:
    """Vectors in lists by a metadata column, as text; null vectors and ids are left out, null metadata is a list of its own."""
    path = path or Workspace(vectors.sparkSession, "vector-store").new_path("lists")
    return Store(_written(_vectors(vectors, id_col, vector_col, F.col(column).cast("string").alias("list")), path))


def store_by_cells(vectors: DataFrame, cells: int, path: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> Store:
    """Vectors in the lists of their nearest of ``cells`` centroids. The centroids come from the SAMPLE vectors whose hashed ids are
    least; every vector is assigned. An empty table gives a store without lists."""
    spark = vectors.sparkSession
    rows = _vectors(vectors, id_col, vector_col)
    drawn = rows.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(SAMPLE).select("v").toPandas()
    centroids = fit_centroids(np.stack(drawn["v"].to_numpy()), cells, seed=seed) if len(drawn) else np.zeros((1, 1))

    def cell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in parts:
            yield pd.Series((np.stack(v.to_numpy()) @ centroids.T).argmax(axis=1) if len(v) else [], dtype=int).astype(str)

    cell.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}  # names are not resolved in this scope
    path = path or Workspace(spark, "vector-store").new_path("cells")
    return Store(_written(rows.withColumn("list", F.pandas_udf(cell, "string")("v")), path), centroids)


def _blocks(queries: DataFrame, query_id: str, vector_col: str, list_col: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    rows = queries.select(F.col(query_id).cast("long"), F.col(vector_col).cast("array<double>"), F.col(list_col).cast("string") if list_col else F.lit(None))
    held = []
    for row in rows.where(F.col(vector_col).isNotNull()).toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            yield np.array([r[0] for r in held]), _unit(np.array([r[1] for r in held])), [r[2] for r in held]
            held = []
    if held:
        yield np.array([r[0] for r in held]), _unit(np.array([r[1] for r in held])), [r[2] for r in held]


def _best(ids: np.ndarray, q: np.ndarray, asked: dict[str | None, np.ndarray], k: int):
    """Scores each list's rows with the queries that ask for it, and keeps each query's k best."""

    def run(batches):
        held = {}  # query -> (scores, ids)
        for batch in batches:
            lists = np.array(batch.column("list").to_pylist(), object)
            column = batch.column("v")
            m, chunks = column.flatten().to_numpy().reshape(len(column), -1), batch.column("chunk_id").to_numpy()
            for name in set(lists):
                own = np.nonzero([x == name for x in lists])[0]
                for at, scores in zip(asked.get(name, ()), q[asked.get(name, np.zeros(0, int))] @ m[own].T, strict=True):
                    old_s, old_c = held.get(at, (np.zeros(0), np.zeros(0, np.int64)))
                    s, c = np.concatenate([old_s, scores]), np.concatenate([old_c, chunks[own]])
                    order = np.lexsort((c, -np.floor(s * 10**DIGITS + 0.5)))[:k]
                    held[at] = s[order], c[order]
        for at, (s, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], len(s))), pa.array(c), pa.array(s)], ["query_id", "chunk_id", "score"])

    return run


def lists_of(store: Store, q: np.ndarray, probes: int) -> list[list[str]]:
    """The names of the ``probes`` nearest cells of each query."""
    near = np.argsort(-(q @ store.centroids.T), axis=1, kind="stable")[:, :probes]
    return [[str(c) for c in row] for row in near]


def asked_rows(store: Store, names: set[str | None]) -> DataFrame:
    """The store's rows in these lists; others' folders are not read."""
    some = F.col("list").isin([n for n in names if n is not None])
    return store.rows.where(some | F.col("list").isNull() if None in names else some)


def search(store: Store, queries: DataFrame, k: int, probes: int = 8, list_col: str | None = None, query_id: str = "query_id", query_vector: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, rank, score): the k best rows by cosine, ties by chunk_id, for each query: in the list that its column
    ``list_col`` names, exactly, or in its ``probes`` nearest cells. Queries go to the driver in blocks of BLOCK; null ones have no hits."""
    every = None
    for ids, q, wanted in _blocks(queries, query_id, query_vector, list_col):
        of = [[w] for w in wanted] if list_col else lists_of(store, q, probes)
        asked: dict[str | None, list[int]] = {}
        for i, names in enumerate(of):
            for name in names:
                asked.setdefault(name, []).append(i)
        rows = asked_rows(store, set(asked)).select("chunk_id", "v", "list")
        found = rows.mapInArrow(_best(ids, q, {n: np.array(i) for n, i in asked.items()}, k), HITS)
        every = found if every is None else every.unionByName(found)
    if every is None:
        every = store.rows.sparkSession.createDataFrame([], HITS)
    return top_k(every, k).select("query_id", "chunk_id", "rank", "score")


#: Rows of one tile, pivots that tiles are told apart by.
TILE, PIVOTS = 2048, 16


def _forest(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that connect what pairs of a and b at the threshold connect, no more than there are rows."""
    near = a @ b.T >= threshold
    links, new_a, new_b = [], np.ones(len(a), bool), np.ones(len(b), bool)
    for start in np.nonzero(near.any(axis=1))[0]:
        if not new_a[start]:
            continue
        new_a[start], open_ = False, [start]
        while open_:
            i = open_.pop()
            for j in np.nonzero(near[i] & new_b)[0]:
                new_b[j] = False
                links.append((a_ids[i], b_ids[j]))
                more = np.nonzero(near[:, j] & new_a)[0]
                new_a[more] = False
                links += [(a_ids[x], b_ids[j]) for x in more]
                open_ += more.tolist()
    return links


def similar_links(vectors: DataFrame, threshold: float, work: Workspace, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(src, dst): links that have the connected components of all pairs of distinct vectors whose cosine reaches the threshold.

    Vectors are told apart by their angles to pivots, of which a sample of PIVOTS is drawn: a tile holds up to about TILE vectors with
    one nearest pivot and like angles to the first. Two tiles are compared unless the angles to some pivot put them further apart than
    the threshold allows, and each comparison gives a spanning forest of its links. All work is a join of tiles; the driver sees
    the pivots only.
    """
    rows = work.save(_vectors(vectors, id_col, vector_col), "unit")
    pivots = np.array([r[0] for r in rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(PIVOTS).select("v").collect()])
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "src long, dst long")
    wide = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def measured(batches):
        for batch in batches:
            column = batch.column("v")
            m = column.flatten().to_numpy().reshape(len(column), -1)
            angles = np.arccos(np.clip(m @ pivots.T, -1, 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * len(pivots), pa.int32()), pa.array(angles.reshape(-1)))
            ring = pa.array(np.floor(angles[:, 0] / wide).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), column, flat, pa.array(angles.argmin(axis=1)), ring], ["chunk_id", "v", "angles", "pivot", "ring"])

    placed = work.save(rows.mapInArrow(measured, "chunk_id long, v array<double>, angles array<double>, pivot long, ring long"), "measured")
    pieces = placed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / TILE).alias("pieces"))
    tiled = placed.join(pieces, ["pivot", "ring"]).withColumn("piece", F.pmod(F.xxhash64("chunk_id"), F.col("pieces")))
    ends = [f(F.get("angles", F.lit(j))).alias(f"{n}{j}") for j in range(len(pivots)) for f, n in ((F.min, "low"), (F.max, "high"))]
    tiles = tiled.groupBy("pivot", "ring", "piece").agg(F.collect_list(F.struct("chunk_id", "v")).alias("rows"), *ends)
    tiles = work.save(tiles.withColumn("tile", F.xxhash64("pivot", "ring", "piece")), "tiles")
    # a ring is as wide as the threshold's angle: only tiles of one ring or of neighbouring ones can have links
    bounds = tiles.drop("rows", "pivot", "piece")
    a = bounds.select(*(F.col(c).alias(f"a_{c}") for c in bounds.columns), F.explode(F.array("ring", F.col("ring") + 1)).alias("met"))
    b = bounds.select(*(F.col(c).alias(f"b_{c}") for c in bounds.columns)).withColumn("met", F.col("b_ring"))
    apart = F.greatest(*(F.greatest(F.col(f"a_low{j}") - F.col(f"b_high{j}"), F.col(f"b_low{j}") - F.col(f"a_high{j}")) for j in range(len(pivots))), F.lit(0.0))
    pairs = a.join(b, "met").where(((F.col("a_ring") < F.col("b_ring")) | (F.col("a_tile") <= F.col("b_tile"))) & (apart <= wide)).select("a_tile", "b_tile")
    pairs = work.save(pairs, "tile-pairs")
    side = lambda n: tiles.select(F.col("tile").alias(f"{n}_tile"), F.col("rows.chunk_id").alias(f"{n}_ids"), F.flatten("rows.v").alias(f"{n}_v"))

    def linked(batches):
        for batch in batches:
            for k in range(len(batch)):
                (a_ids, a_v), (b_ids, b_v) = ((batch.column(f"{n}_ids")[k].values.to_numpy(), batch.column(f"{n}_v")[k].values.to_numpy()) for n in "ab")
                found = _forest(a_ids, a_v.reshape(len(a_ids), -1), b_ids, b_v.reshape(len(b_ids), -1), threshold)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["src", "dst"])

    compared = pairs.join(side("a"), "a_tile").join(side("b"), "b_tile").select("a_ids", "a_v", "b_ids", "b_v")
    return work.save(compared.mapInArrow(linked, "src long, dst long").where("src <> dst"), "links")
