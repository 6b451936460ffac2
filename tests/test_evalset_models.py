import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import evalset, models


def test_checks_are_greedy_and_ordered(spark):
    rows = [(1, "what causes a headache", "name_led", "flu"), (2, "what causes a headache now", "name_led", "flu"), (3, "short", "name_led", "flu"), (4, "is the flu dangerous", "colloquial", "flu"), (5, "how is gout treated today", "exam_treat", None)]
    got = {r.id: r.drop_reason for r in evalset.checked(spark.createDataFrame(rows, "id int, question string, style string, name string")).collect()}
    assert got == {1: None, 2: "like:1", 3: "length", 4: "name", 5: None}


def test_generation_uses_the_cache(spark):
    sample = spark.createDataFrame([(1, "a", "name_led"), (2, "b", "colloquial"), (3, "", "colloquial")], "id int, content string, style string")
    cache = spark.createDataFrame([(1, "name_led", "old"), (9, "name_led", "unused")], "id int, style string, question string")
    got = {r.id: r.question for r in evalset.generate(sample, cache, lambda c, s: F.when(c != "", F.concat(c, F.lit("?"))).otherwise("")).collect()}
    assert got == {1: "old", 2: "b?"}
    checked = spark.createDataFrame([(1, None), (2, "length"), (3, None)], "id int, drop_reason string")
    verdicts = spark.createDataFrame([(1, True), (2, True), (3, False)], "id int, keep boolean")
    assert [r.id for r in evalset.passed(checked, verdicts).collect()] == [1]


def test_registered_embedder(spark):
    models.register_embedder("lengths", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    got = {r.id: r.embedding for r in models.embed(rows, "id", "t", "lengths").collect()}
    assert np.allclose(got[1], np.array([3, 1]) / np.sqrt(10)) and got[2] == [0.0, 1.0]
    assert len(models.embed(rows, "id", "t", dimension=16).first().embedding) == 16


def test_traces(spark):
    spans = spark.createDataFrame([("t", "a", 2.0), ("t", "a", 3.0), ("t", "b", 1.0), ("u", "a", 4.0)], "trace_id string, name string, ms double")
    usage = spark.createDataFrame([("t", "m", 5, 6), ("t", "m", 1, 1)], "trace_id string, model string, prompt_tokens int, completion_tokens int")
    got = {r.trace_id: r for r in models.trace_summary(spans, usage).collect()}
    assert got["t"].total_ms == 6.0 and got["t"].stages == {"a": 5.0, "b": 1.0} and got["t"].usage["m"].prompt == 6 and got["u"].usage is None


def greedy(rows):
    """The loop that checked() must agree with: each question against those kept before it."""
    kept, out = [], []
    for i, question, style, name in rows:
        letters = "".join(c for c in question if c.isalnum() or c == "_")
        pairs = {letters[k : k + 2] for k in range(len(letters) - 1)}
        reason = "length" if not 10 <= len(question) <= 60 else "name" if style in evalset.HIDDEN_NAME and name and name in question else None
        if reason is None and pairs:
            reason = next((f"like:{j}" for other, j in kept if 10 * len(pairs & other) > 8 * min(len(pairs), len(other))), None)
            if reason is None:
                kept.append((pairs, i))
        out.append((i, reason))
    return out


def questions_of(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé病", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 and rows:  # an earlier question with a word more, less or changed
            parts = rng.choice(rows)[1].split(" ")
            parts[rng.randrange(len(parts))] = rng.choice([*words, ""])
            text = " ".join(parts)
        elif kind < 0.5:
            text = f"how is the case number {rng.randrange(500)} treated"
        elif kind < 0.53:
            text = rng.choice(["??????? aa ???", "............", "? a ? b ? c ?", "aaaaaaaaaaaa"])
        else:
            text = " ".join(rng.choices(words, k=rng.randint(1, 9)))
        rows.append((i, text, rng.choice(evalset.STYLES), rng.choice([None, "", words[0]])))
    return rows


def test_question_check_equals_the_loop(spark, monkeypatch):
    schema = "id int, question string, style string, name string"
    for n, candidates in ((5000, evalset.CANDIDATES), (600, 1)):  # few allowed candidates: leaders go first
        monkeypatch.setattr(evalset, "CANDIDATES", candidates)
        rows = questions_of(n, n)
        got = evalset.checked(spark.createDataFrame(rows, schema).repartition(5)).collect()
        assert sorted((r.id, r.drop_reason) for r in got) == greedy(rows)
    odd = [(None, None, None, None), (1, "", "x", "y"), (2, "é" * 12, "x", None), (2, "é" * 12, "x", None), (3, "é" * 13, "x", None)]
    got = sorted((str(r.id), str(r.drop_reason)) for r in evalset.checked(spark.createDataFrame(odd, schema)).collect())
    assert got == [("1", "length"), ("2", "None"), ("2", "like:2"), ("3", "like:2"), ("None", "length")]
    assert evalset.checked(spark.createDataFrame([], schema)).count() == 0
