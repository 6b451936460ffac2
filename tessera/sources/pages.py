"""Pages of documents in files, by a parser that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: What a parser gives for each page: number, modality, content, number of images.
Page = tuple[int, str, str | None, int]
PAGES = "file string, page long, modality string, content string, n_images int, error string"


def read_pages(spark: SparkSession, path: str, make: Callable[[], Callable[[str, bytes], Iterable[Page]]], glob: str = "*") -> DataFrame:
    """(file, page, modality, content, n_images, error): the pages of all files below ``path`` whose names fit ``glob``.

    Spark lists and reads the files, from any file system that it knows, and deals them to tasks by their bytes. make is called once
    a task and gives ``parse(file, bytes)``. Pages leave one by one. A file that fails has one more row with the error and no page, behind
    the pages read before; it stops no other. An empty file has no page: Spark does not read it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")
    columns = ["file", "page", "modality", "content", "n_images", "error"]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse, rows = make(), []
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    for page, modality, content, images in parse(file, raw):
                        rows.append((file, page, modality, content, images, None))
                        if len(rows) == 256:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except Exception as e:  # noqa: BLE001, whatever a parser raises
                    rows.append((file, None, None, None, None, f"{type(e).__name__}: {e}"))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(over, PAGES)
