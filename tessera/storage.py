"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, so a lost executor costs a re-read of a file and
never a recomputation of the plan. The folder is taken from the session; only a local session without one (a test) gets its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a session on one machine gets a local folder of its own,
    and any other is an error: its executors don't see the driver's folders."""
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the whole cluster shares")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return base.rstrip("/")


def share_code(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, unless they have it on their path already."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def spread(df: DataFrame) -> DataFrame:
    """df with a task for every core: where a small table lies in fewer splits than that, its rows are dealt out; a larger one is left as
    it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SCOPES: list[list[Workspace]] = []


@contextmanager
def cleared() -> Iterator[None]:
    """Removes the workspaces that were made inside, at the end: what is still needed then must have been saved elsewhere."""
    made: list[Workspace] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
        for work in made:
            remove(work.spark, work.path)


#: Settings under which a task of a saved table reads or gets little, as rows of two numbers are ten times their compressed size in memory.
_FINE = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.files.maxPartitionBytes": "16m"}
#: Rows of a shuffle for which there is one more partition.
ROWS_A_PARTITION = 1 << 20


@contextmanager
def fine_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables of about ``rows`` narrow rows that are saved inside are made by tasks of bounded size; the session's settings come back."""
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PARTITION))
    settings = _FINE | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Workspace:
    """A fresh subfolder of the shared folder, for the tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        share_code(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        self._n = 0
        if _SCOPES:
            _SCOPES[-1].append(self)

    def new_path(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write df and return the table that reads it back."""
        path = self.new_path(name)
        df.write.mode("overwrite").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._tessera_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that save() made and that nothing reads any more."""
        for df in tables:
            if path := getattr(df, "_tessera_path", None):
                remove(self.spark, path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)
