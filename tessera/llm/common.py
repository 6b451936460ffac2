"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import Workspace, share_code

#: Bytes of one Arrow batch, so that very long texts don't add up in a worker.
ARROW_BATCH_BYTES = 48 << 20
ARROW_BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def content_digest(text: Column) -> Column:
    """32 bytes that stand for a text."""
    return F.unhex(F.sha2(text, 256))


#: Rows of the larger side of a join for which one copy of a row of the other side is made.
ROWS_A_COPY = 256


def join_dealt(many: DataFrame, one: DataFrame, key: str, by: list[str], work: Workspace, counted: DataFrame | None = None, rows_a_copy: int = ROWS_A_COPY) -> DataFrame:
    """many joined with one, which has each key once, on ``key``. A row of one that meets many rows is copied, and its
    partners are dealt out to the copies by their columns ``by``, so that no task gets all of a hot key's. counted: a table
    with the keys of many, where many itself is dear to make twice."""
    copies = F.ceil(F.count("*") / rows_a_copy).cast("int")
    hot = work.save((many if counted is None else counted).groupBy(key).agg(copies.alias("copies")).where("copies > 1"), "hot")
    dealt = many.join(hot, key, "left").withColumn("copy", F.pmod(F.xxhash64(*by), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    spread = one.join(hot, key, "left").select(F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), *one.columns)
    return dealt.join(spread, [key, "copy"]).drop("copy")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches. A batch is made when the plan runs, so the bounds stay set."""
    share_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over batches of bounded size; function gets one batch and returns one, or several in turn."""
    bound_batches(df.sparkSession)

    def over(batches):
        for batch in batches:
            made = function(batch)
            if isinstance(made, pa.RecordBatch):
                yield made
            else:
                yield from made

    return df.mapInArrow(over, schema)
