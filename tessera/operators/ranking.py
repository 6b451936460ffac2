"""Top-k, ranks, normalisation and fusion of ranked lists, over a batch of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import Workspace

#: Digits at which scores tie, so that the order of a float sum doesn't decide a rank.
DIGITS = 9


def rounded(score: Column, digits: int = DIGITS) -> Column:
    return F.floor(score * 10**digits + 0.5) / 10**digits


def top_k(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), score: str = "score", ties: tuple = ("chunk_id",), rank: str = "rank") -> DataFrame:
    """The k best rows of each key with their 1-based rank; ties go by the tie columns. Ranks are cut before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(rounded(F.col(score)).desc(), *ties)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def minmax(df: DataFrame, score: str, out: str, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """out: score scaled to 0..1 within each key; 1 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(rounded(high) == rounded(low), F.lit(1.0)).otherwise((F.col(score) - low) / (high - low)))


def fuse(lists: list[tuple[str, DataFrame, float]], rrf_k: float = 60.0) -> DataFrame:
    """Weighted reciprocal rank fusion of lists (channel, hits (query_id, chunk_id, rank, score), weight).

    Several lists may belong to one channel; a chunk's score and rank in a channel are those of the channel's last list
    that has it. One aggregation does what a full outer join of all lists would.
    """
    rows = [h.select("query_id", "chunk_id", "rank", F.col("score").cast("double").alias("score"), F.lit(channel).alias("channel"), F.lit(i).alias("list_no"), F.lit(float(weight)).alias("weight")) for i, (channel, h, weight) in enumerate(lists)]
    every = reduce(DataFrame.unionByName, rows)
    of = lambda channel, what: F.max_by(F.when(F.col("channel") == channel, F.col(what)), F.when(F.col("channel") == channel, F.col("list_no")))
    channels = list(dict.fromkeys(c for c, _, _ in lists))
    extra = [of(c, what).alias(f"{c}_{what}") for c in channels for what in ("score", "rank")]
    return every.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") / (F.lit(float(rrf_k)) + F.col("rank"))).alias("score"), *extra)


def best_of(lists: list[DataFrame]) -> DataFrame:
    """Each chunk with its best score over all lists."""
    return reduce(DataFrame.unionByName, [h.select("query_id", "chunk_id", "score") for h in lists]).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def dedupe_sources(hits: DataFrame) -> DataFrame:
    """(query_id, source_id, rank): a ranked list of chunks as one of documents, each at its first place."""
    first = hits.groupBy("query_id", "source_id").agg(F.min("rank").alias("first"))
    return first.select("query_id", "source_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("rank"))


def stratified(df: DataFrame, stratum: str, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """About n rows: each stratum gives max(1, round(n * its share)) of its rows, in a seeded hash order, cut to n.

    Hashes are spread evenly, so a stratum's first rows lie in its first slices of hashes: only slices that begin within the quota are
    put in order, each for itself, and the place of a row is its place in the slice behind the rows of the slices before.
    Rows of a null stratum are left out.
    """
    work = Workspace(df.sparkSession, "stratified")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.where(F.col(stratum).isNotNull()).withColumn("__order", order).withColumn("__slice", F.left("__order", F.lit(3)))
    sizes = work.save(hashed.groupBy(stratum, "__slice").agg(F.count("*").alias("__m")), "slices")
    own, upto = Window.partitionBy(stratum), Window.partitionBy(stratum).orderBy("__slice")  # 4096 slices at most
    total = sizes.agg(F.sum("__m").alias("__total"))
    quota = F.greatest(F.lit(1), F.rint(F.lit(float(n)) * F.sum("__m").over(own) / F.col("__total"))).cast("int")
    needed = sizes.crossJoin(F.broadcast(total)).select(stratum, "__slice", quota.alias("__quota"), (F.sum("__m").over(upto) - F.col("__m")).alias("__before"))
    needed = work.save(needed.where("__before < __quota"), "needed")
    nth = F.row_number().over(Window.partitionBy(stratum, "__slice").orderBy("__order", key)) + F.col("__before")
    kept = hashed.join(needed, [stratum, "__slice"]).withColumn("__nth", nth).where("__nth <= __quota")
    return kept.orderBy("__order", key).limit(n).select(*df.columns)


def seeded_order(df: DataFrame, seed: int = 0, key: str = "id") -> DataFrame:
    """df with each row's place, from 1, in a seeded random order that other engines compute alike: by the md5 of seed and key.

    Rows are dealt by the first digits of the md5, which are spread evenly; a row's place is its place among those with the
    same digits, behind the rows of all lower ones.
    """
    hashed = df.withColumn("__order", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("__slice", F.left("__order", F.lit(3)))
    sizes = hashed.groupBy("__slice").agg(F.count("*").alias("__n"))
    before = sizes.select("__slice", (F.sum("__n").over(Window.orderBy("__slice")) - F.col("__n")).alias("__before"))  # 4096 rows at most
    nth = F.row_number().over(Window.partitionBy("__slice").orderBy("__order", key))
    return hashed.withColumn("__nth", nth).join(before, "__slice").withColumn("place", F.col("__before") + F.col("__nth")).select(*df.columns, "place")
