"""Table functions for SQL: ``SELECT ... FROM docs, LATERAL fixed_chunks(body, 360, 80)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.storage import share_code

#: name -> (class with eval, schema of its rows)
TABLE_FUNCTIONS: dict[str, tuple[type, str]] = {}
BLANKS = " \t\n\x0b\x0c\r 　"


def table_function(name: str, schema: str) -> Callable[[type], type]:
    """Registers a class whose ``eval`` yields rows, under the name that SQL calls it by."""

    def keep(cls: type) -> type:
        TABLE_FUNCTIONS[name] = (cls, schema)
        return cls

    return keep


@table_function("fixed_chunks", "chunk_index int, piece string")
class FixedChunks:
    """Windows of ``size`` characters that share ``overlap``, stripped, blank ones left out; null and empty texts have none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        size = max(20, size)
        step, place, end = size - max(0, min(overlap, size - 1)), 0, len(text or "")
        for start in range(0, end, step):
            if piece := text[start : start + size].strip(BLANKS):
                yield place, piece
                place += 1
            if start + size >= end:
                return


@table_function("words_of", "place int, word string")
class WordsOf:
    """The words between white space, with their places."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())


def register_all(spark: SparkSession) -> list[str]:
    """Makes every table function known to a session's SQL; rows go in Arrow batches."""
    share_code(spark)
    for name, (cls, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=schema, useArrow=True))
    return list(TABLE_FUNCTIONS)
