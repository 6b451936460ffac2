"""Sinks: chunk tables, vector collections with upsert, append-only logs, graphs, and rendered reports."""

from __future__ import annotations

import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import exists, remove


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


class Collection:
    """A named vector collection: a log of versions, each a Parquet table of the rows that one upsert brought.

    An upsert writes its own rows only, whatever the collection holds; reading takes each row from the last version that has its
    key. compact() writes one version of what is read, so that reads have few versions to look through. A version is complete before
    the log names it, so a job that dies leaves the collection as it was.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def versions(self) -> list[str]:
        """Tables from the last reset on, oldest first."""
        if not exists(self.spark, f"{self.path}/log"):
            return []
        log = self.spark.read.schema("seq long, version string, reset boolean").parquet(f"{self.path}/log").orderBy("seq").collect()
        first = max((i for i, r in enumerate(log) if r["reset"]), default=0)
        return [r["version"] for r in log[first:]]

    def read(self) -> DataFrame | None:
        """The rows, or None if there was no upsert yet."""
        found, later = None, None
        for version in reversed(self.versions()):
            rows = self.spark.read.parquet(version)
            keys = rows.select(self.key)
            kept = rows if later is None else rows.join(later, self.key, "left_anti")
            found = kept if found is None else found.unionByName(kept, allowMissingColumns=True)
            later = keys if later is None else later.unionByName(keys)
        return found

    def upsert(self, rows: DataFrame, reset: bool = False, name: str | None = None) -> None:
        """Rows replace those with the same key; with ``reset`` they replace all. An upsert with a ``name`` that the log has already does
        nothing, and one that died before the log had it is written again in its place."""
        version = f"{self.path}/versions/{name or uuid.uuid4().hex}"
        seq = 0
        if exists(self.spark, f"{self.path}/log"):
            log = self.spark.read.parquet(f"{self.path}/log")
            if name and not log.where(F.col("version") == version).isEmpty():
                return
            seq = log.agg(F.max("seq")).first()[0] + 1
        rows.write.mode("overwrite").parquet(version)
        self._log(seq, version, reset)

    def _log(self, seq: int, version: str, reset: bool) -> None:
        self.spark.createDataFrame([(seq, version, reset)], "seq long, version string, reset boolean").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def compact(self) -> None:
        """One version instead of many. Tables that the log no longer needs stay until drop(), for readers that still have them."""
        if len(self.versions()) > 1:
            self.upsert(self.read(), reset=True)

    def drop(self) -> None:
        remove(self.spark, self.path)

    def count(self) -> int:
        rows = self.read()
        return rows.count() if rows is not None else 0


def append_log(rows: DataFrame, path: str) -> None:
    """Run, generation and trace logs: JSON lines that are only added to."""
    rows.write.mode("append").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def markdown_table(df: DataFrame, longest: int = 1000) -> str:
    """A report's rows as a pipe table; a report is short, and more than ``longest`` rows are refused."""
    rows = df.limit(longest + 1).collect()
    if len(rows) > longest:
        raise ValueError(f"more than {longest} rows are no report")
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join(f"| {' | '.join(map(cell, r))} |" for r in (df.columns, ["---"] * len(df.columns), *rows)) + "\n"


def query_set_yaml(manual: DataFrame, made: DataFrame) -> str:
    """A query set (query_id, question, expected, note) in YAML, hand-written queries first. For sets that people read; larger ones are
    written by write_query_set()."""
    rows = [*manual.orderBy("query_id").toLocalIterator(), *made.orderBy("query_id").toLocalIterator()]
    return yaml.safe_dump([{"id": r["query_id"], "question": r["question"], "expected_source_ids": list(r["expected"]), "note": r["note"]} for r in rows], allow_unicode=True, sort_keys=False)


def write_query_set(manual: DataFrame, made: DataFrame, path: str) -> None:
    """The same set as text files of YAML entries, written by executors: hand-written queries in the first files, each file in the order of
    query_id. The files one behind the other are one YAML list."""
    entry = lambda r: yaml.safe_dump([{"id": r[0], "question": r[1], "expected_source_ids": list(r[2] or []), "note": r[3]}], allow_unicode=True, sort_keys=False).rstrip("\n")

    @F.udf("string")
    def rendered(query_id, question, expected, note):
        return entry((query_id, question, expected, note))

    of = lambda rows, place: rows.select(F.lit(place).alias("place"), "query_id", "question", "expected", "note")
    ordered = of(manual, 0).unionByName(of(made, 1)).repartitionByRange("place", "query_id").sortWithinPartitions("place", "query_id")
    ordered.select(rendered("query_id", "question", "expected", "note")).write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A dump of vectors with their metadata: (vec_id, embedding, ...), embeddings as float arrays."""
    vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """What write_chunks() wrote."""
    return spark.read.parquet(path)
