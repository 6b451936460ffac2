import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, vectors
from tessera.operators import evaluation as ev
from tessera.operators.ranking import fuse, stratified, top_k
from tessera.operators.rerank import rerank
from tessera.plans.config import DEFAULTS, grid, load, with_settings
from tessera.plans.retrieval import retrieve, sweep

HITS = "query_id int, chunk_id string, rank int, score double"


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("a", "cat dog"), ("b", "cat fox"), ("c", "cat owl owl"), ("d", None)], "chunk_id string, text string")
    index = bm25.build(chunks)
    got = {r.chunk_id: r.score for r in bm25.scores(index, spark.createDataFrame([(1, "owl cat owl")], "query_id int, question string")).collect()}
    idf = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in {"cat": 3, "dog": 1, "fox": 1, "owl": 1}.items()}
    mean = sum(idf.values()) / 4
    idf["cat"] = 0.25 * mean  # in more than half of the chunks
    avg = 7 / 4
    part = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got.keys() == {"a", "b", "c"}
    assert math.isclose(got["c"], 2 * part("owl", 2, 3) + part("cat", 1, 3)) and math.isclose(got["a"], part("cat", 1, 2))
    plain = {r.chunk_id: r.raw for r in bm25.search(index, spark.createDataFrame([(1, "owl cat owl")], "query_id int, question string"), 2, fallback=True).collect()}
    assert math.isclose(plain["c"], 2 * (1 + math.log(3)) + 1 + math.log(2)) and len(plain) == 2
    assert bm25.search(index, spark.createDataFrame([(1, "none")], "query_id int, question string"), 5).count() == 0


def test_fusion_with_ties_and_gaps(spark):
    v = spark.createDataFrame([(1, "x", 1, 0.9), (1, "y", 2, 0.8)], HITS)
    b = spark.createDataFrame([(1, "z", 1, 3.0), (1, "x", 2, 2.0)], HITS)
    rows = {r.chunk_id: r for r in fuse([("vector", v, 0.5), ("bm25", b, 0.5)], 60).collect()}
    assert math.isclose(rows["x"].score, 0.5 / 61 + 0.5 / 62) and rows["y"].bm25_rank is None and rows["z"].vector_score is None
    tied = top_k(spark.createDataFrame([(1, c, 0, 1.0) for c in "cab"], HITS).drop("rank"), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in tied] == ["a", "b"]


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8)).astype("float32")
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>").repartition(5)
    asked = rows.where("vec_id < 4").withColumnRenamed("vec_id", "query_id")
    m = m.astype(float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for metric, s in (("cosine", unit[:4] @ unit.T), ("ip", m[:4] @ m.T), ("l2", -((m[:4, None] - m[None]) ** 2).sum(-1))):
        got = vectors.search(rows, asked, 5, metric).orderBy("query_id", "rank").collect()
        assert [r.chunk_id for r in got] == np.argsort(-s, axis=1, kind="stable")[:, :5].reshape(-1).tolist()
        assert np.allclose([r.score for r in got], np.sort(-s, axis=1)[:, :5].reshape(-1) * -1)
    assert vectors.search(rows, asked.limit(0), 5).count() == 0


def test_hash_embedding(spark):
    rows = spark.createDataFrame([(1, "ab ab c"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r.embedding for r in vectors.hash_embed(rows, "id", "t", 64).collect()}
    assert math.isclose(sum(x * x for x in got[1]), 1.0) and not any(got[2]) and not any(got[3])
    counts = vectors.hash_features(rows, "id", "t", 10**9).count()
    assert counts == len({" a", "ab", "b ", " ab", "ab ", " ab "} | {" c", "c ", " c "})


def test_cache(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0, 1.0])], "query_id long, embedding array<double>")
    got = {r.query_id: (r.chunk_id, r.hit) for r in vectors.cache_lookup(rows, asked).collect()}
    assert got == {7: (1, True), 8: (1, False)}
    stamped = rows.withColumn("ts", F.col("vec_id"))
    assert [r.vec_id for r in vectors.cache_put(stamped, stamped.withColumn("ts", F.lit(9)).withColumn("vec_id", F.lit(3)).limit(1), 2).collect()] == [3, 2]


def test_rerank_modes(spark):
    rows = spark.createDataFrame([(1, "a", 0.2, "red fox", "a red fox"), (1, "b", 0.9, "red fox", "blue"), (1, "c", 0.5, "red fox", "fox fox")], "query_id int, chunk_id string, score double, question string, text string")
    order = lambda **kw: [r.chunk_id for r in rerank(rows, **kw).orderBy("rank").collect()]
    assert order(mode="none", k=2) == ["b", "c"]
    assert order(mode="overlap", weight=1.0) == ["a", "c", "b"]
    assert order(mode="cross_encoder", weight=1.0, scorer=lambda q, t: pd.Series(t.str.len().astype(float))) == ["a", "c", "b"]
    assert len(order(mode="bm25")) == 3


def test_pipeline_and_sweep(spark):
    chunks = spark.createDataFrame([(c, f"text {c}") for c in "xyz"], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "text z")], "query_id int, question string")
    v = spark.createDataFrame([(1, "x", 1, 0.9), (1, "y", 2, 0.8)], HITS)
    b = spark.createDataFrame([(1, "z", 1, 1.0), (1, "y", 2, 0.5)], HITS)
    run = lambda config: retrieve(queries, chunks, [b], [v], config)
    assert [r.chunk_id for r in run(DEFAULTS).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [r.chunk_id for r in run(with_settings(DEFAULTS, ["retrieval.hybrid=false"])).orderBy("rank").collect()] == ["x", "y"]
    assert run(with_settings(DEFAULTS, ["rerank.mode=overlap", "rerank.weight=1.0", "rerank.top_k=1"])).first().chunk_id == "z"
    rows = sweep(DEFAULTS, {"rerank.top_k": [1, 2], "retrieval.rrf_k": [10]}, run).collect()
    assert sorted(r.label for r in rows) == ["rerank.top_k=1,retrieval.rrf_k=10"] + ["rerank.top_k=2,retrieval.rrf_k=10"] * 2
    assert len(grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    assert load("rerank: {mode: bm25}", ["a.b=null", "a.c=2.5"])["a"] == {"b": None, "c": 2.5}


def slow_metrics(ranked, expected, ks):
    ranked = list(dict.fromkeys(ranked))
    first = next((i for i, s in enumerate(ranked, 1) if s in expected), None)
    out = [first, 1 / first if first else 0.0]
    for k in ks:
        right = [i for i, s in enumerate(ranked[:k], 1) if s in expected]
        ideal = sum(1 / math.log2(i + 1) for i in range(1, min(len(expected), k) + 1))
        out += [float(bool(right)), len(right) / len(expected), sum(1 / math.log2(i + 1) for i in right) / ideal]
    return out


def test_metrics(spark):
    lists = {1: ("abacd", "cz"), 2: ("xyz", "q"), 3: ("", "a"), 4: ("abcdefghijkl", "kl")}
    hits = spark.createDataFrame([(q, i, s) for q, (ranked, _) in lists.items() for i, s in enumerate(ranked, 1)], "query_id int, rank int, source_id string")
    gold = spark.createDataFrame([(q, s) for q, (_, e) in lists.items() for s in e], "query_id int, source_id string")
    for r in ev.rank_metrics(hits, gold).collect():
        want = slow_metrics(*lists[r.query_id], ev.KS)
        assert r.first_rank == want[0] and np.allclose(list(r)[2:], want[1:])
    means = {(r.metric): r["mean"] for r in ev.mean_metrics(ev.long(ev.rank_metrics(hits, gold), "s")).collect()}
    assert math.isclose(means["mrr"], (1 / 3 + 1 / 11) / 4)


def test_significance(spark):
    d = [0.5, -0.25, 1.0, 0.0]
    rows = spark.createDataFrame([("m", x) for x in d], "metric string, diff double")
    got = ev.exact_permutation(rows, ("metric",)).first()
    flips = [sum(s * x for s, x in zip(signs, d, strict=True)) for signs in itertools.product((1, -1), repeat=4)]
    assert got.n == 4 and math.isclose(got.p_value, sum(abs(f) >= 1.25 - 1e-9 for f in flips) / 16)
    many = [float(x) for x in ([1, -1, 2, 0, 3] * 5)]  # more than can be enumerated: by the sums' distribution
    counts = {0: 1}
    for x in many:
        after = {}
        for s, n in counts.items():
            after[s + x], after[s - x] = after.get(s + x, 0) + n, after.get(s - x, 0) + n * (x != 0)
            if x == 0:
                after[s] = 2 * n
        counts = after
    assert math.isclose(ev.exact_p(np.array(many)), sum(n for s, n in counts.items() if abs(s) >= sum(many)) / 2 ** len(many))
    a = spark.createDataFrame([(q, "m", v) for q, v in ((1, 1.0), (2, 0.0), (3, 1.0))], "query_id int, metric string, value double")
    b = spark.createDataFrame([(q, "m", v) for q, v in ((1, 0.0), (2, 0.0), (4, 1.0))], "query_id int, metric string, value double")
    c = ev.compare(a, b).first()
    assert (c.n, c.wins, c.ties, c.losses) == (2, 1, 1, 0) and ev.flips(a, b).count() == 1
    p = ev.permutation_test(a, b, 500).first()
    assert (p.mean_diff, p.p_value) == (0.5, 1.0)  # either sign is as far from 0
    same = ev.permutation_test(a, a, 500).first()
    assert (same.mean_diff, same.p_value) == (0.0, 1.0)
    x = spark.createDataFrame([(q, "m", float(q % 3)) for q in range(12)], "query_id int, metric string, value double")
    far, exact = ev.permutation_test(x, x.withColumn("value", F.lit(0.0)), 20_000).first(), ev.exact_p(np.array([float(q % 3) for q in range(12)]))
    assert abs(far.p_value - exact) < 0.01
    ci = ev.bootstrap(a.withColumn("stage", F.lit("s")), ("stage", "metric"), 200).first()
    assert math.isclose(ci["mean"], 2 / 3) and ci.low <= ci["mean"] <= ci.high


def test_percentiles_and_cost(spark):
    rows = spark.createDataFrame([("k", float(i), i) for i in range(6)] + [("k", None, 9)], "k string, v double, ts int")
    assert ev.nearest_rank_percentile(rows, ("k",), "v", 50).first()["p50"] == 2.0  # 2.5 goes to the even index
    skewed = [("a", 1.0)] * 700 + [("a", float(i % 97)) for i in range(3000)] + [("b", float(i * i)) for i in range(2001)]
    frame = spark.createDataFrame(skewed, "k string, v double")
    for p in (0, 1, 50, 90, 99.9, 100):
        got = {r.k: r[1] for r in ev.nearest_rank_percentile(frame, ("k",), "v", p).collect()}
        for k in "ab":
            v = sorted(x for y, x in skewed if y == k)
            assert got[k] == v[round(p / 100 * (len(v) - 1))]
    assert ev.recent_percentile(rows, ("k",), "v", "ts", 50, recent=4).first()["p50"] == 4.0
    usage = spark.createDataFrame([("t", "m", 1_000_000, 500_000), ("t", "x", 0, 1_000_000)], "trace_id string, model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, prompt_price double, completion_price double")
    assert ev.token_cost(usage, prices, (1.0, 3.0)).first().cost == 7.0


def test_strata(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "id int, s string")
    got = stratified(rows, "s", 10).collect()
    assert len(got) == 10 and sum(r.s == "b" for r in got) == 1


def test_registered_resamples_are_the_default(spark, sf):
    from tessera.catalog import retrieval

    values = retrieval.long(retrieval.metrics_of(spark, sf, retrieval.lexical(spark, sf)), "bm25_only")
    want = ev.bootstrap(values, ("stage", "metric"), 10_000)
    assert sorted(retrieval.bootstrap_ci(spark, sf).collect()) == sorted(want.collect())


def test_exact_p_of_real_differences():
    """Against all sign flips at 16, and in halves beyond what can be listed."""
    rng = np.random.default_rng(3)
    for d in (rng.normal(size=16), rng.choice([0.0, 1 / 3, -0.5, 1.0], 14), np.zeros(3), rng.integers(-9, 9, 15) / 10):
        whole = np.rint(d * 1e9).astype(np.int64)
        sums = np.array(list(itertools.product((1, -1), repeat=len(d))), np.int64) @ whole
        assert math.isclose(ev.exact_p(d), (np.abs(sums) >= abs(whole.sum())).mean(), abs_tol=1e-12)
    assert 0 < ev.exact_p(rng.normal(size=40)) <= 1
    assert 0 < ev.exact_p(rng.integers(-50, 50, 2000) / 100) <= 1
    with pytest.raises(ev.NotExact):
        ev.exact_p(rng.normal(size=60))
