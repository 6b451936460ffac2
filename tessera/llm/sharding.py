"""A uniform shuffle of a table into shards of exact sizes.

Rows come in partitions, as they lie in the files. Each partition permutes its rows at random and hands each shard the
next so many of them; how many is drawn beforehand, from the distribution that a shuffle of all rows would have: the counts of
one partition are multivariate hypergeometric in the room that is left in the shards. Each shard permutes what it gets
once more, by random keys: a slice of the keys is one task, and slices follow each other.

The first permutation is written with the rows, so that a task that runs again finds the same ranks, and all that follows depends on
the stored ranks alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches
from tessera.storage import Workspace

#: Rows and bytes of one partition that are permuted as one, and rows of a shard that are put in order by one task.
PART_ROWS, PART_BYTES, SLICE_ROWS = 1 << 20, 128 << 20, 1 << 17
PLACED = "part long, nth long"


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most, larger ones first."""
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)


def communication_matrix(counts: Iterable[int], shards: int, seed: int) -> Iterator[np.ndarray]:
    """For each partition's count of rows, how many of them go to each shard. Every row sums to its count, all rows
    together to shard_sizes()."""
    counts = list(counts)
    room, rng = shard_sizes(sum(counts), shards), np.random.default_rng(seed)
    for n in counts:
        # shard after shard, each count given those before: numpy's joint draw is limited to 1e9 rows in all
        drawn, left, rest = np.zeros(shards, np.int64), n, int(room.sum())
        for k in range(shards):
            rest -= int(room[k])
            drawn[k] = _hypergeometric(rng, int(room[k]), rest, left)
            left -= int(drawn[k])
        room = room - drawn
        yield drawn


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without return from good + bad are good. numpy takes up to 1e9 of each; for larger urns the
    distribution is made from the ratios of its neighbouring terms, twelve standard deviations to both sides of the mean."""
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    low, high, size = max(0, n - bad), min(n, good), good + bad
    mean = n * (good / size)
    wide = 12 * np.sqrt(mean * (bad / size) * ((size - n) / (size - 1))) + 12
    k = np.arange(max(low, int(mean - wide)), min(high, int(mean + wide)) + 1, dtype=np.float64)
    ratios = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratios)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(len(k) - 1, int(np.searchsorted(upto, rng.random() * upto[-1], side="right")))])


def _permuted(seed: int):
    """Adds to each row its part, a stretch of one partition, and its rank in a random order of the part."""

    def run(batches):
        task = TaskContext.get().partitionId()
        held, rows, size, stretch = [], 0, 0, 0

        def part(table: pa.Table, stretch: int):
            number = (task << 24) + stretch
            order = np.random.default_rng([seed, task, stretch]).permutation(len(table))
            full = table.append_column("part", pa.array(np.full(len(table), number, np.int64))).append_column("nth", pa.array(order.astype(np.int64)))
            return full.to_batches()

        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if rows >= PART_ROWS or size >= PART_BYTES:
                yield from part(pa.Table.from_batches(held), stretch)
                held, rows, size, stretch = [], 0, 0, stretch + 1
        if rows:
            yield from part(pa.Table.from_batches(held), stretch)

    return run


def uniform_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """rows with shard (0 .. shards - 1) and slot (gapless from 0 in each shard): a uniform random order of all rows, cut into
    shards whose counts differ by one at most.

    Rows are told apart by where they lie, not by what they hold: repeated rows and nulls are dealt out like any others, and no
    key is hot. The same files, read in the same splits, give the same order for a seed. Columns named part, nth, upto, shard, slot, slice, key,
    before or in_slice must not be in ``rows``. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "shards")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = work.save(rows.mapInArrow(_permuted(seed), f"{kept}, {PLACED}"), "permuted")
    # a number for each part comes to the driver, not rows
    counts = [(r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").toLocalIterator()]
    matrix = communication_matrix((n for _, n in counts), shards, seed)
    upto = [(part, np.cumsum(drawn).tolist()) for (part, _), drawn in zip(counts, matrix, strict=True)]
    total = sum(n for _, n in counts)
    slices = 1 << max(0, -(-total // (shards * SLICE_ROWS)) - 1).bit_length()
    bounds = spark.createDataFrame(upto, "part long, upto array<long>")
    key = F.xxhash64(F.lit(seed), F.col("part"), F.col("nth"))
    sent = placed.join(bounds, "part").withColumn("shard", F.size(F.filter("upto", lambda c: c <= F.col("nth"))).cast("int")).withColumn("key", key)
    # keys are spread evenly: their first bits are slices of like size, in the order of the keys
    sent = sent.drop("upto").withColumn("slice", F.shiftrightunsigned("key", 40).bitwiseAND(F.lit((1 << 24) - 1)) * F.lit(slices) / F.lit(1 << 24)).withColumn("slice", F.floor("slice").cast("int"))
    sizes = work.save(sent.groupBy("shard", "slice").agg(F.count("*").alias("n")), "sizes")
    before = sizes.select("shard", "slice", (F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "slice").orderBy("key", "part", "nth")
    ranked = sent.withColumn("in_slice", F.row_number().over(order) - 1).join(before, ["shard", "slice"])
    return ranked.select(*(F.col(f"`{c}`") for c in rows.columns), "shard", (F.col("before") + F.col("in_slice")).alias("slot"))


def document_shards(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document; texts stay where they are. A null text has a size of 1 and the
    crc of nothing; a null doc_id is kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return uniform_shards(keys, shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Writes docs as Parquet, one folder a shard, rows in the order of their slots within a file; files of a folder follow each
    other by slot."""
    placed = uniform_shards(docs, shards, seed).withColumn("file", F.floor(F.col("slot") / SLICE_ROWS))
    placed.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot").drop("file").write.mode("overwrite").option("maxRecordsPerFile", SLICE_ROWS).partitionBy("shard").parquet(path)
