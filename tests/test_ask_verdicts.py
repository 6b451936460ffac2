"""Briefs, verdicts in batches, runs by label, and asking as one operator."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, evalset
from tessera.plans.retrieval import ask


def test_briefs(spark):
    rows = spark.createDataFrame([("t", "a\n【描述】 b\nc " + "d" * 300, "x"), (None, None, None), ("t", "no description", "")], "name string, content string, exams string")
    got = rows.select(T.document_brief(F.col("name"), F.col("content"), 5).alias("d"), T.record_brief(F.col("name"), {"exams": F.col("exams")}, F.col("content")).alias("r"),
                      T.record_brief(F.col("name"), {}, F.col("content"), False).alias("bare")).collect()
    assert [r.d for r in got] == ["标题：t\n摘要：a\n【描述", "标题：\n摘要：", "标题：t\n摘要：no de"]
    assert got[0].r == "疾病名称：t\n检查项目：x\n描述节选：b c " + "d" * 191 and got[1].r == "疾病名称：" and got[2].r == "疾病名称：t"
    assert got[2].bare == ""


def judge(path):
    """Keeps even questions; tells nothing on 7, twice and last no on 8; the prompt with 3 is answered badly the first time; writes down how many each prompt has."""

    def make():
        def model(system, user, images):
            told = re.findall(r"### 第(\d+)题\n问题：(\d*)\n对应记录：\n", user)
            with open(path, "a") as f:
                f.write(f"{len(told)} {','.join(q for _, q in told)}\n")
            if "3" in [q for _, q in told] and sum(" 3" in line or ",3" in line for line in open(path)) == 1:
                return "sorry"
            some = [{"index": j, "keep": int(q or 0) % 2 == 0, "reason": "r" * 100} for j, q in told if q != "7"]
            some += [{"index": int(j), "keep": False} for j, q in told if q == "8"] + [{"index": 99, "keep": True}, {"index": "x", "keep": True}, {"keep": True}]
            return "so: " + json.dumps(some)

        return model

    return make


def test_verdicts_in_batches(spark, tmp_path):
    log = str(tmp_path / "asked")
    questions = spark.createDataFrame([(i, str(i), f"b{i}", "x") for i in range(12)] + [(12, None, None, None)], "id int, question string, brief string, keep string").coalesce(1)
    cache = spark.createDataFrame([(0, False, "old")], "id int, keep boolean, reason string")
    got = {r.id: (r.keep, r.reason) for r in evalset.verdicts(questions, cache, judge(log)).collect()}
    assert got.pop(0) == (False, "old") and got.pop(8) == (False, "") and got.pop(12) == (True, "r" * 80)
    assert got == {i: (i % 2 == 0, "r" * 80) for i in (1, 2, 3, 4, 5, 6, 9, 10, 11)}
    sizes = [int(line.split()[0]) for line in open(log)]
    assert max(sizes) == 5 and sum(sizes) - 5 in (12, 10)  # one prompt was sent again
    assert evalset.verdicts(questions.limit(0), cache.limit(0), judge(log)).count() == 0


def test_a_model_that_never_tells(spark):
    questions = spark.createDataFrame([(1, "q", "b")], "id int, question string, brief string")
    assert evalset.verdicts(questions, questions.limit(0).selectExpr("id", "true AS keep", "'' AS reason"), lambda: lambda s, u, i: "no").count() == 0


def test_runs_by_label(spark):
    rows = [(1, "a", "e", "h", 1, "m", 0.0), (2, "a", "e", "h", 1, "m", 1.0), (2, "a", "e", "h", 2, "m", None), (1, "b", "e", "h", 1, "m", 0.5), (1, "b", "e", "h", 2, "m", 0.0)]
    rows += [(1, "c", "other", "h", 1, "m", 1.0), (1, "d", "e", "h", 1, "m", 1.0), (1, "d", "e", "flat", 2, "m", 1.0)]
    values = spark.createDataFrame(rows, "seq int, label string, eval_set string, stage string, query_id int, metric string, value double")
    assert evaluation.compare_labels(values, "a", "b", "h", "m").collect() == [("m", 2, 0.5, 0.25, 1, 1, 0)]
    for wrong, says in ((("a", "none", "h", "m"), "no run"), (("a", "c", "h", "m"), "different query sets"), (("a", "d", "h", "m"), "1 of 2 queries"), (("a", "b", "h", "n"), r"no metric 'n', but \['m'\]"), (("a", "b", "x", "m"), "2 of 2 queries")):
        with pytest.raises(ValueError, match=says):
            evaluation.compare_labels(values, *wrong)


def reader():
    def model(system, user, images):
        if "broken" in user:
            raise RuntimeError
        return f"{len(images)}|{user}"

    return model


def test_ask(spark):
    questions = spark.createDataFrame([(1, "it", "alpha"), (2, "beta", None), (3, "nothing", None), (4, "broken beta", None)], "query_id int, question string, earlier string")
    chunks = spark.createDataFrame([("c1", "s1", "A", "alpha text", "figure", "p.png"), ("c2", "s2", "", "beta text", "text", None)], "chunk_id string, source_id string, title string, text string, modality string, image_path string")

    def search(q):
        return q.join(chunks.select("chunk_id", F.substring_index("text", " ", 1).alias("word")), F.contains("question", "word")).select("query_id", "chunk_id", F.lit(1).alias("rank"))

    def with_earlier(q):
        return q.where("earlier is not null").select("query_id", F.concat_ws(" ", "earlier", "question").alias("question"))

    got = {r.query_id: r for r in ask(questions, search, chunks, reader, rewrite=with_earlier).collect()}
    assert got[1].answer.startswith("1|问题：it\n\n【资料】\n[1] A\nalpha text\n\n") and [tuple(s) for s in got[1].sources] == [(1, "s1")] and got[1].images_used == ["p.png"]
    assert got[2].answer.startswith("0|问题：beta\n\n【资料】\n[1] s2\nbeta text") and got[2].decision is None
    assert got[3].sources is None and "【资料】\n\n\n" in got[3].answer and got[4].answer is None

    def grade(q, hits):
        return hits.groupBy("query_id").agg(F.lit(0.9).alias("top"))

    correct = {"grade": grade, "rewrite": lambda q: q.select("query_id", F.when(F.col("query_id") == 1, "alpha").otherwise(F.col("question")).alias("rewrite"))}
    got = {r.query_id: r for r in ask(questions, search, chunks, reader, correct=correct).collect()}
    assert {k: r.decision for k, r in got.items()} == {1: "refined", 2: "proceed", 3: "abstain", 4: "proceed"}
    assert got[3].answer == "资料中没有" and got[3].images_used == [] and got[1].answer.startswith("1|问题：it")
    assert ask(questions.limit(0), search, chunks, reader).count() == 0
