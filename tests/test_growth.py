"""What tasks hold, and what shuffles move, must not grow faster than the tables; equal places must give equal sums."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import block_index, bm25, evalset, vectors
from tessera.operators.evaluation import compare, long, rank_metrics
from tessera.operators.components import connected_components
from tessera.storage import fine_tasks
from tessera.streaming import stateful


def test_runs_with_equal_places_tie_whatever_the_order_of_rows(spark):
    ranks = [1, 2, 4, 5, 7, 8, 9, 10]
    gold = spark.createDataFrame([(q, s) for q in range(40) for s in range(8)], "query_id long, source_id long")
    orders = [p for p, _ in zip(itertools.permutations(range(8)), range(40 * 997))][::997]
    run = lambda dealt: spark.createDataFrame([(q, r, s) for q in range(40) for r, s in zip(ranks, dealt(q))], "query_id long, rank int, source_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # rows are then added up in the order of their sources
    try:
        a, b = (long(rank_metrics(run(d), gold, dedupe=False), "run").select("query_id", "metric", "value") for d in (lambda q: range(8), lambda q: orders[q]))
        rows = compare(a, b).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 13 and all((r.wins, r.ties, r.losses) == (0, 40, 0) for r in rows)


def shuffled_rows(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_postings_are_made_without_a_shuffle(spark):
    texts = [(i, " ".join(f"w{(i * k) % 701}" for k in range(i % 300))) for i in range(400)] + [(1000, None), (1001, "b a b")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(4)
    before = shuffled_rows(spark)
    index = bm25.build(chunks)
    moved = shuffled_rows(spark) - before
    n = index.postings.count()
    assert moved < n / 4, (moved, n)
    assert sorted(tuple(r) for r in index.postings.where("chunk_id >= 1000").collect()) == [("a", 1001, 1, 3), ("b", 1001, 2, 3)]
    assert index.stats.first().n == 402


def test_a_lexical_search_shuffles_the_best_only(spark):
    """Every chunk has every token: 40 queries over 3,000 chunks are 120,000 scores."""
    chunks = spark.createDataFrame([(i, f"apple berry cherry own{i} " + "date " * (i % 97)) for i in range(3000)], "chunk_id long, text string").repartition(4)
    queries = spark.createDataFrame([(q, "apple date " + "berry " * q) for q in range(40)], "query_id long, question string")
    index = bm25.build(chunks)
    before = shuffled_rows(spark)
    for fallback in (True, False):
        got = bm25.search(index, queries, 5, fallback=fallback).collect()
        assert len(got) == 200
    assert shuffled_rows(spark) - before < 12_000
    top = sorted((r.rank, r.chunk_id) for r in bm25.search(index, queries, 5, fallback=True).collect() if r.query_id == 3)
    assert top == [(n + 1, 96 + 97 * n) for n in range(5)]


def test_blocks_are_made_and_searched_without_a_shuffle_of_postings(spark):
    """Every chunk has every token: 12,000 postings, and 120,000 scores of 40 queries."""
    chunks = spark.createDataFrame([(i, "apple berry cherry " + "date " * (1 + i % 97)) for i in range(3000)] + [(i, f"other{i % 9}") for i in range(4000, 8000)], "chunk_id long, text string").repartition(4)
    queries = spark.createDataFrame([(q, "apple date " + "berry " * q) for q in range(40)], "query_id long, question string")
    index = bm25.build(chunks)
    before = shuffled_rows(spark)
    got = block_index.search(block_index.build(index), queries, 5).collect()
    assert shuffled_rows(spark) - before < 6000
    place = lambda rows: sorted((r.query_id, r.rank, r.chunk_id, round(r.raw, 9)) for r in rows)
    assert len(got) == 200 and place(got) == place(bm25.search(index, queries, 5).collect())


def test_a_vector_search_holds_little(spark):
    rng = np.random.default_rng(0)
    q, rows = rng.normal(size=(1024, 8)), rng.normal(size=(20_000, 8))
    v = pa.ListArray.from_arrays(pa.array(np.arange(20_001) * 8, pa.int32()), pa.array(rows.reshape(-1)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), v], ["chunk_id", "v"])
    tracemalloc.start()
    got = list(vectors._best(iter([batch]), np.arange(1024), q, 3, "ip"))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    want = np.argsort(-(q @ rows.T), axis=1, kind="stable")[:, :3]
    assert got.column("chunk_id").to_numpy().reshape(1024, 3).tolist() == want.tolist()


def test_components_are_made_by_more_tasks_as_edges_grow(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n) for n in names]
    with fine_tasks(spark, 50 << 20):
        assert int(spark.conf.get(names[0])) == 50
    assert [spark.conf.get(n) for n in names] == before
    got = connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 7), (9, 8)], "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8)]
    assert [spark.conf.get(n) for n in names] == before


def test_sets_of_questions_go_by_numbers(spark, monkeypatch):
    kinds = []
    made = evalset._Alike.__init__

    def init(self, sets, work):
        made(self, sets, work)
        kinds.extend(t.schema["key"].dataType.simpleString() for t in (self.small, self.large, self.sets))

    monkeypatch.setattr(evalset._Alike, "__init__", init)
    asked = [(9, "how is the weather today"), (10, "how is the weather todays"), (2, "what does it cost to fly"), (3, "short"), (11, "what does it cost to fly")]
    questions = spark.createDataFrame([(i, q, "name_led", "") for i, q in asked], "id long, question string, style string, name string").repartition(3)
    got = {r.id: r.drop_reason for r in evalset.checked(questions).collect()}
    assert got == {9: None, 10: "like:9", 2: None, 3: "length", 11: "like:2"}
    assert kinds == ["bigint"] * 3


def test_a_trace_is_one_value_of_state():
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        registerTimer = deleteTimer = lambda self, at: calls.append("timer")

        def getValueState(self, name, schema):
            return Value()

    class Times:
        getCurrentWatermarkInMs = lambda self: 100

    quiet = stateful._Quiet(10)
    quiet.init(Handle())
    rows = [{"name": f"n{i % 7}", "ms": 1.0, "at": 100 + i} for i in range(50)] + [{"name": "x", "ms": 2.0, "at": 99}]
    late = list(quiet.handleInputRows(("t",), iter(rows), Times()))
    assert calls == ["get", "timer", "update"] and [(r.name, r.ms, r.last, r.late) for r in late] == [("x", 2.0, 99, True)]
    assert sum(quiet.held.held[2]) == 50 and quiet.held.held[3] == 149
