"""Uniform shards: exact counts, gapless slots, no row lost, and orders that look drawn at random."""

import zlib
from collections import Counter

import numpy as np

from tessera.llm import queries, sharding


def check(rows, docs, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(shards))
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_whole_table(spark, sf, texts):
    rows = queries.op12_sharding(spark, sf).collect()
    check(rows, list(texts.items()), 16)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_odd_and_empty(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for shards in (1, 4, 50):
        check(sharding.document_shards(odd, shards).collect(), docs, shards)
    assert sharding.document_shards(empty, 16).count() == 0


def test_slices_and_parts(spark, make, monkeypatch):
    """Many parts and slices, and a text that half of the rows hold."""
    docs = [(i % 700, "hot" if i % 2 else f"t{i}") for i in range(4000)]
    monkeypatch.setattr(sharding, "SLICE_ROWS", 64)
    monkeypatch.setattr(sharding, "PART_ROWS", 100)
    rows = sharding.document_shards(make(docs).repartition(7), 6).collect()
    check(rows, docs, 6)


def test_same_files_give_the_same_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    runs = [sorted(map(tuple, sharding.document_shards(docs, 16, seed).collect())) for seed in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]


def test_orders_are_uniform(spark, make):
    """Over many seeds each row comes to each shard equally often, and two rows share a shard as often as chance has it."""
    docs = make([(i, f"t{i}") for i in range(12)]).coalesce(2)
    counts, together, runs = np.zeros((12, 3)), 0, 60
    for seed in range(runs):
        at = {r["doc_id"]: r["shard"] for r in sharding.document_shards(docs, 3, seed).collect()}
        for d, s in at.items():
            counts[d, s] += 1
        together += sum(at[a] == at[b] for a in range(12) for b in range(a))
    assert ((counts - runs / 3) ** 2 / (runs / 3)).sum() < 24 + 4 * np.sqrt(48)  # chi-square with 24 degrees of freedom
    assert abs(together - runs * 66 * 3 / 11) < 1e-9  # sizes are exact, so this number is too


def test_matrix_has_the_law_of_a_shuffle():
    """Counts of the first part are those of a shuffle of all rows, by their mean and spread; sums are exact."""
    drawn = np.array([next(iter(sharding.communication_matrix([30, 50, 20], 4, seed))) for seed in range(4000)])
    assert (drawn.sum(axis=1) == 30).all()
    assert np.abs(drawn.mean(axis=0) - 7.5).max() < 0.15
    assert np.abs(drawn.var(axis=0) - 30 * 0.25 * 0.75 * 70 / 99).max() < 0.35
    for counts in ([], [0, 0], [5, 0, 7, 1], [100_000] * 30):
        rows = list(sharding.communication_matrix(counts, 16, 0))
        assert [int(r.sum()) for r in rows] == counts
        assert np.array_equal(np.sum(rows, axis=0) if rows else np.zeros(16), sharding.shard_sizes(sum(counts), 16))


def test_urns_above_a_thousand_million():
    rng = np.random.default_rng(0)
    good, bad, n = 3_000_000_000, 9_000_000_000, 1_000_000
    drawn = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(400)])
    assert abs(drawn.mean() - 250_000) < 100 and 380 < drawn.std() < 490
    assert sharding._hypergeometric(rng, good, 0, 5) == 5 and sharding._hypergeometric(rng, 0, good, 5) == 0


def test_written_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {k: docs.count() // 4 for k in range(4)}
