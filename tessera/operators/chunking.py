"""Documents into chunks: one document becomes n rows, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import cache_key, clean_text, join_overlap, strip
from tessera.storage import Workspace

SMALLEST = 20
RESERVED = ("source_id", "title", "chunk_index")


def _sizes(size: int, overlap: int) -> tuple[int, int]:
    size = max(SMALLEST, size)
    return size, max(0, min(overlap, size - 1))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of windows of ``size`` characters that share ``overlap``; the last one reaches the end. Blank ones are dropped.

    A text is cut into steps first, so that a window is put together from the few steps that it goes over, and not looked up
    from the beginning of the text.
    """
    size, overlap = _sizes(size, overlap)
    step = size - overlap
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def window(parts, i):
        whole = F.array_join(F.slice(parts, i + 1, F.lit(-(-size // step))), "")
        return strip(F.left(whole, F.lit(size)))

    # a fold over one value gives the steps a name, so that they are cut once
    windows = F.aggregate(
        F.array(F.lit(0)), F.struct(steps.alias("parts"), F.array().cast("array<string>").alias("out")),
        lambda seen, _: F.struct(seen["parts"].alias("parts"), F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")), lambda i: window(seen["parts"], i)).alias("out")),
        lambda seen: seen["out"],
    )
    return F.when(F.length(text) > 0, F.filter(windows, lambda w: w != "")).otherwise(F.array().cast("array<string>"))


def paragraph_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of chunks: paragraphs are gathered up to ``size`` characters; a chunk begins with the last ``overlap``
    characters of the one before; a longer paragraph is cut into windows of its own."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("held"))

    def closed(seen):
        return F.when(seen["held"] != "", F.concat(seen["done"], F.array(strip(seen["held"])))).otherwise(seen["done"])

    def add(seen, p):
        joined = F.when(seen["held"] == "", p).otherwise(F.concat(seen["held"], F.lit("\n\n"), p))
        tail = strip(F.right(seen["held"], F.lit(overlap))) if overlap else F.lit("")
        carried = F.when(tail != "", strip(F.concat(tail, F.lit("\n\n"), p))).otherwise(p)
        long = F.struct(F.concat(closed(seen), fixed_windows(p, size, overlap)).alias("done"), F.lit("").alias("held"))
        fits = F.struct(seen["done"].alias("done"), joined.alias("held"))
        full = F.struct(closed(seen).alias("done"), carried.alias("held"))
        return F.when(F.length(p) > size, long).when(F.length(joined) <= size, fits).otherwise(full)

    return F.aggregate(paragraphs, start, add, closed)


def make_chunks(docs: DataFrame, strategy: str = "paragraph", size: int = 360, overlap: int = 80, prepend_title: bool = False) -> DataFrame:
    """docs (doc_id, title, content[, tags, metadata]) -> (chunk_id, source_id, chunk_index, title, text[, tags, metadata]).

    Without ``prepend_title`` the title is the first paragraph; with it, the first line of every chunk.
    """
    title = F.coalesce(F.col("title"), F.col("doc_id").cast("string"))
    content = F.coalesce(F.col("content"), F.lit(""))
    body = clean_text(content if prepend_title else F.concat(title, F.lit("\n\n"), content))
    pieces = (fixed_windows if strategy == "fixed" else paragraph_chunks)(F.col("__body"), size, overlap)
    kept = [c for c in ("tags", "metadata") if c in docs.columns]
    rows = docs.select(F.col("doc_id").cast("string").alias("source_id"), title.alias("title"), *kept, body.alias("__body"))
    rows = rows.select("source_id", "title", *kept, F.posexplode(pieces).alias("chunk_index", "piece"))
    text = F.concat("title", F.lit("\n"), "piece") if prepend_title else F.col("piece")
    return rows.select(F.format_string("%s::chunk_%03d", "source_id", "chunk_index").alias("chunk_id"), "source_id", "chunk_index", "title", text.alias("text"), *kept)


def contextual_prefix(chunks: DataFrame, describe, cached: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """chunks with a sentence of context before the text of each document's first chunks, or of all of them.

    ``describe``: column function (title, text) -> sentence, a stand-in for a model. cached (key, sentence) is looked up
    first, so that only misses are described.
    """
    keyed = chunks.withColumn("key", cache_key(F.col("source_id"), F.col("text")))
    keyed = keyed.join(cached.select("key", F.col("sentence").alias("known")), "key", "left") if cached is not None else keyed.withColumn("known", F.lit(None).cast("string"))
    sentence = F.coalesce("known", describe(F.col("title"), F.col("text")))
    told = F.concat(sentence, F.lit("\n"), F.col("text"))
    return keyed.withColumn("text", told if first is None else F.when(F.col("chunk_index") < first, told).otherwise(F.col("text"))).drop("key", "known")


def parent_documents(hits: DataFrame, chunks: DataFrame, max_parents: int | None = 5, max_chars: int | None = 4000, overlap: int = 200) -> DataFrame:
    """hits (query_id, rank, source_id), chunks -> (query_id, parent_rank, source_id, text): the whole documents behind
    the hits, in the order of their first hit, overlaps written once. max_parents, max_chars: what a prompt has room for; None: all
    of a query's documents, or all of a text. overlap: what chunks share at most; in a text that repeats itself more would fit."""
    from pyspark.sql import Window

    first = hits.groupBy("query_id", "source_id").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "source_id")
    ranked = first.withColumn("parent_rank", F.row_number().over(order))
    parents = Workspace(hits.sparkSession, "parents").save(ranked if max_parents is None else ranked.where(F.col("parent_rank") <= max_parents))
    wanted = chunks.join(parents.select("source_id").distinct(), "source_id", "left_semi")
    whole = wanted.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"))
    text = join_overlap(F.col("parts.text"), most=overlap)
    texts = whole.select("source_id", (text if max_chars is None else F.left(text, F.lit(max_chars))).alias("text"))
    return parents.join(texts, "source_id").select("query_id", "parent_rank", "source_id", "text")
