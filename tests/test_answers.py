from pyspark.sql import functions as F

from tessera.operators import answers


def echo():
    def model(system, user, images):
        if "bad" in images:
            raise ValueError
        if "fail" in user:
            raise RuntimeError
        return f"{system}{len(images)}:{user}"

    return model


def test_prompts_images_and_failures(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "fail")], "query_id int, question string")
    contexts = spark.createDataFrame([(1, "c1"), (3, "c3")], "query_id int, context string")
    hits = spark.createDataFrame([(1, 1, "figure", "y"), (1, 2, "text", "z"), (1, 3, "figure", "y"), (1, 4, "figure", "x"), (2, 1, "figure", "bad"), (2, 2, "figure", None)], "query_id int, rank int, modality string, image_path string")
    images = answers.figure_images(hits, 2)
    assert {r.query_id: r.images for r in images.collect()} == {1: ["y", "x"], 2: ["bad"]}
    got = {r.query_id: r for r in answers.answered(answers.context_prompts(questions, contexts, images), echo, "s").collect()}
    assert got[1].answer == f"s2:问题：a\n\n【资料】\nc1\n\n{answers.BY_CONTEXT}" and got[1].images_used == ["y", "x"]
    assert got[2].answer == f"s0:问题：b\n\n【资料】\n\n\n{answers.BY_CONTEXT}" and got[2].images_used == []
    assert got[3].answer is None


def test_graph_and_communities(spark):
    questions = spark.createDataFrame([(1, "q"), (2, "none")], "query_id int, question string")
    facts = spark.createDataFrame([(1, 2, "b", "r", "c", "p2"), (1, 1, "a", "r", "b", "p1")], "query_id int, hop int, head string, relation string, tail string, paper string")
    got = {r.query_id: r for r in answers.graph_answers(questions, facts, echo).collect()}
    assert got[1].answer.endswith("【关系事实】\n(a) --r--> (b)\n(b) --r--> (c)\n\n请据此回答。") and (got[1].n_facts, got[1].papers) == (2, ["p1", "p2"])
    assert got[2].answer == answers.NO_FACTS and got[2].n_facts == 0
    members = spark.createDataFrame([("a", 1), ("b", 1), ("z", 2)], "name string, community int")
    inside = spark.createDataFrame([(1, "a", "r", "b")], "community int, head string, relation string, tail string")
    summaries = answers.community_summaries(members, inside, lambda: lambda s, u, i: 'x {"name": "N", "summary": "' + str(len(u)) + '"}' if "a、b" in u else "no json")
    assert sorted((r.community, r.size, r.name) for r in summaries.collect()) == [(1, 2, "N"), (2, 1, "社区2")]
    answer = answers.global_answers(questions, summaries, echo).where("query_id = 1").first().answer
    assert "[社区1] N：" in answer and "[社区2] 社区2：（摘要失败）（含 1 个实体）" in answer


def test_corrective_retrieval(spark):
    questions = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "hopeless"), (4, "middling"), (5, "same")], "query_id int, question string")
    scores = {"good": 0.9, "bad": 0.1, "bad!": 0.5, "hopeless": 0.1, "hopeless!": 0.2, "middling": 0.4, "middling!": 0.35, "same": 0.4}
    table = spark.createDataFrame([*scores.items()], "question string, top double")
    retrieve = lambda q: q.select("query_id", F.col("question").alias("chunk_id"), F.lit(1).alias("rank"))
    grade = lambda q, h: q.join(table, "question").select("query_id", "top")
    rewrite = lambda q: q.select("query_id", F.when(F.col("question") == "same", "same").otherwise(F.concat("question", F.lit("!"))).alias("rewrite"))
    hits, decisions = answers.corrective_retrieval(questions, retrieve, grade, rewrite)
    assert {r.query_id: (r.decision, r.top_score, r.rewrite) for r in decisions.collect()} == {1: ("proceed", 0.9, None), 2: ("refined", 0.5, "bad!"), 3: ("abstain", 0.1, None), 4: ("proceed", 0.4, None), 5: ("proceed", 0.4, None)}
    assert {r.query_id: r.chunk_id for r in hits.collect()} == {1: "good", 2: "bad!", 4: "middling", 5: "same"}
