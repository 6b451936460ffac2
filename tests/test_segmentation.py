"""Segmentation against all cuts of short texts; table functions against the column expressions."""

import itertools
import math
import random
import re

from pyspark.sql import functions as F

from tessera.functions.table_functions import register_all
from tessera.operators import chunking, segmentation


def all_cuts(text, words):
    """The best of all ways to cut a text, with the longer word first among equals."""
    total = sum(words.values())
    found = []
    for marks in itertools.product((0, 1), repeat=max(0, len(text) - 1)):
        parts, start = [], 0
        for i, m in enumerate((*marks, 1), 1):
            if m:
                parts.append(text[start:i])
                start = i
        if all(p in words or len(p) == 1 for p in parts):
            found.append((round(sum(math.log(words.get(p, 1)) - math.log(total) for p in parts), 9), [len(p) for p in parts], parts))
    return max(found)[2] if text else []


def test_best_path_against_all_cuts():
    rng = random.Random(1)
    for _ in range(300):
        words = {"".join(rng.choices("天地人x", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(rng.randint(1, 12))}
        text = "".join(rng.choices("天地人。x", k=rng.randint(0, 9)))
        want = all_cuts(text, words)
        joined = []
        for p in want:  # loose letters next to each other are one word
            if p == "x" and "x" not in words and joined and joined[-1][1]:
                joined[-1] = (joined[-1][0] + p, True)
            else:
                joined.append((p, p == "x" and "x" not in words))
        assert segmentation.Segmenter(words.items()).cut(text) == [p for p, _ in joined]


def test_segmented_table(spark):
    words = spark.createDataFrame([("头痛", 5), ("发热", 4), ("怎么", 9), ("办", 3)], "word string, n long")
    rows = spark.createDataFrame([(1, "头痛发热怎么办？"), (2, None), (3, ""), (4, "CT 怎么"), (5, "怎么")], "query_id int, question string")
    found = segmentation.segmented(rows, words)
    assert {r.id: r.words for r in found.collect()} == {1: ["头痛", "发热", "怎么", "办", "？"], 2: [], 3: [], 4: ["CT", "怎么"], 5: ["怎么"]}
    kept = found.join(rows, F.col("id") == F.col("query_id")).select("id", segmentation.without_stop_words(F.col("words"), F.col("question")).alias("k"))
    assert {r.id: r.k for r in kept.collect()} == {1: "头痛 发热 办", 2: None, 3: "", 4: "CT", 5: "怎么"}
    assert segmentation.segmented(rows, words.limit(0)).where("id = 5").first().words == ["怎", "么"]


def test_registered_query_loses_nothing(spark, sf):
    import __spark_entry__ as entry

    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.query_id: r.keywords for r in entry.queries()["segmented_items"](spark, sf).collect()}
    words = {r.word: r.n for r in segmentation.corpus_words(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    segmenter = segmentation.Segmenter(words.items())
    bare = {i: re.sub(r"\s+", "", t) for i, t in items.items()}
    assert {i: k.replace(" ", "") for i, k in got.items()} == {i: re.sub(segmentation.PUNCTUATION, "", t) for i, t in bare.items()}
    # the path found is no worse than the words that the item was written with
    cost = lambda parts: sum(math.log(words.get(p.lower(), 1)) - segmenter.total for p in parts)
    for i, t in items.items():
        own = [p for w in t.split() for p in re.findall(r"[^\W_]+|.", w)]
        if all(p.lower() in words or len(p) == 1 for p in own):
            assert cost(segmenter.cut(bare[i])) >= cost(own) - 1e-9


def test_table_function_is_the_column_expression(spark):
    assert "fixed_chunks" in register_all(spark)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "short", "x" * 100, "a " * 99, " \n" * 60, "é日" * 77, "b" * 20])], "id int, t string")
    for size, overlap in ((20, 5), (50, 49), (5, 30), (100, 0)):
        want = {r.id: r.w for r in rows.select("id", chunking.fixed_windows(F.col("t"), size, overlap).alias("w")).collect()}
        got = {}
        for r in spark.sql(f"SELECT id, chunk_index, piece FROM {{rows}}, LATERAL fixed_chunks(t, {size}, {overlap})", rows=rows).collect():
            got.setdefault(r.id, {})[r.chunk_index] = r.piece
        assert {i: [p[k] for k in range(len(p))] for i, p in got.items()} == {i: w for i, w in want.items() if w}
    assert spark.sql("SELECT count(*) AS n FROM words_of('a b  c')").first().n == 3
