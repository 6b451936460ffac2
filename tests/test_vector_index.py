"""Stored indexes against brute force: recall, filters, pruned folders; links of tiles against all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, vector_index, vectors
from tessera.operators.components import connected_components
from tessera.storage import Workspace


@pytest.fixture(scope="module")
def rows(spark):
    """Vectors around forty directions, copies, a label, and null, zero and odd rows."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 16))
    m = middles[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    m[100:140] = m[99]
    data = [(i, [float(x) for x in v], f"l{i % 7}" if i % 11 else None) for i, v in enumerate(m)]
    data += [(5000, None, "l1"), (None, [1.0] * 16, "l1"), (5001, [0.0] * 16, "l2")]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label string").repartition(6).cache()


def hits(df):
    return {(r.query_id, r.chunk_id) for r in df.collect()}


def folders(df):
    return {r[0].split("list=")[1].split("/")[0] for r in df.select(F.input_file_name()).distinct().collect()}


def pruned(df):
    """Whether the scan has a filter on its folders."""
    return re.search(r"PartitionFilters: \[[^\]]*list", df._jdf.queryExecution().executedPlan().toString()) is not None


def test_recall_and_files_read(spark, rows, tmp_path):
    asked = rows.where("vec_id % 30 = 0").selectExpr("vec_id AS query_id", "embedding")
    store = vector_index.store_by_cells(rows, 32, f"file://{tmp_path}/cells")
    assert store.rows.count() == 3001
    exact = hits(vectors.search(rows, asked, 10))
    assert len(hits(vector_index.search(store, asked, 10, 6)) & exact) >= 0.9 * len(exact)
    assert hits(vector_index.search(store, asked, 10, 32)) == exact
    one = vector_index.lists_of(store, store.centroids[:1], 3)[0]
    read = vector_index.asked_rows(store, set(one))
    assert folders(read) == set(one) and len(folders(store.rows)) >= 30
    assert pruned(read) and not pruned(store.rows)


def test_recall_of_the_registered_index(spark, sf):
    import __spark_entry__ as entry

    every = entry.queries()
    exact, got = hits(every["vector_topk_cosine"](spark, sf)), hits(every["ivf_topk"](spark, sf))
    assert len(got & exact) >= 0.9 * len(exact)


def test_filter_is_exact_and_prunes(spark, rows, tmp_path):
    store = vector_index.store_by(rows, "label", f"file://{tmp_path}/labels")
    asked = rows.where("vec_id in (2, 30, 33)").selectExpr("vec_id AS query_id", "embedding", "label")
    got = vector_index.search(store, asked, 5, list_col="label").collect()
    for q in (2, 30, 33):
        label = f"l{q % 7}" if q % 11 else None
        own = rows.where("label <=> " + (f"'{label}'" if label else "null"))
        want = vectors.search(own, asked.where(f"query_id = {q}"), 5).orderBy("rank").collect()
        assert [(r.chunk_id, round(r.score, 9)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(r.chunk_id, round(r.score, 9)) for r in want]
    assert folders(vector_index.asked_rows(store, {"l3"})) == {"l3"} and pruned(vector_index.asked_rows(store, {"l3", None}))
    assert vector_index.search(store, asked.limit(0), 5, list_col="label").count() == 0
    assert vector_index.search(store, spark.createDataFrame([(1, [1.0] * 16, "none")], "query_id long, embedding array<double>, label string"), 5, list_col="label").count() == 0


def test_empty_store(spark, rows):
    store = vector_index.store_by_cells(rows.limit(0), 4)
    assert store.rows.count() == 0


@pytest.mark.parametrize("threshold", [0.95, 0.6])
def test_links_of_tiles_have_the_components_of_all_pairs(spark, rows, monkeypatch, threshold):
    monkeypatch.setattr(vector_index, "TILE", 100)
    some = rows.where("vec_id < 900")
    found = connected_components(vector_index.similar_links(some, threshold, Workspace(spark, "links")))
    got = {r.node: r.component for r in found.collect()}
    data = sorted((r.vec_id, r.embedding) for r in some.collect())
    m = np.array([v for _, v in data], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near, label = m @ m.T >= threshold, np.arange(len(m))
    for _ in range(len(m)):
        after = np.where(near, label[None, :], len(m)).min(axis=1)
        if (after == label).all():
            break
        label = after
    assert all(got.get(i, i) == label[i] for i in range(len(m)))


def test_merging_of_odd_names(spark):
    names = spark.createDataFrame([("b", [1.0, 0.0]), ("aa", [1.0, 0.05]), ("c", None), ("d", None), ("z", [0.0, 0.0])], "name string, embedding array<double>")
    assert {r.name: r.canonical for r in graph.merge_similar(names, 0.9).collect()} == {"b": "b", "aa": "b", "c": "c", "d": "d", "z": "z"}
    assert graph.merge_similar(names.limit(0), 0.9).count() == 0
