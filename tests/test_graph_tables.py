import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import communities, generation, graph, tables
from tessera.operators.components import connected_components

TRIPLES = "source_id string, head string, head_type string, relation string, tail string, tail_type string"
ROWS = [
    ("p1_p0001", "CLIP", "模型", "uses", "Image Encoder", "方法"), ("p1_p0002", "clip-ViT-B-32", "模型", "uses", "image encoder", "方法"), ("p2_p1", "GNN", "模型", "solves", "Task", "任务"),
    ("p2_p2", "图神经网络", "模型", "uses", "CLIP", "模型"), ("p2_p3", "作者", "人物", "wrote", "CLIP", "模型"), ("p2_p4", "GNN", "模型", "from", "MIT", "机构"), ("p3", "Task", "任务", "is", "Task", "任务"),
]


@pytest.fixture(scope="module")
def parts(spark):
    kept = graph.keep_research(spark.createDataFrame(ROWS, TRIPLES))
    return graph.build_graph(kept, graph.canonical_names(kept, graph.alias_table(spark)))


def test_build(spark, parts):
    nodes, edges = parts
    assert {r.name: r.papers for r in nodes.collect()} == {"CLIP": ["p1", "p2"], "Image Encoder": ["p1"], "GNN": ["p2"], "Task": ["p2", "p3"]}
    assert edges.count() == 5  # parallel edges stay
    assert {r.name: r.degree for r in graph.degrees(edges).collect()} == {"CLIP": 3, "Image Encoder": 2, "GNN": 2, "Task": 3}
    assert {r.name: r.n_papers for r in graph.bridges(edges).collect()} == {"CLIP": 2, "Task": 2}


def test_untyped_triples_and_parsing(spark):
    untyped = spark.createDataFrame([("s", "a", None, "r", "b", None), ("s", "我们", None, "r", "b", None)], TRIPLES)
    assert graph.keep_research(untyped).count() == 1
    replies = spark.createDataFrame([("s", 'ok: [{"head":"a","relation":"r","tail":"b"},{"head":"","relation":"r","tail":"b"}]'), ("t", "broken [")], "source_id string, reply string")
    assert [(r.source_id, r.head, r.tail) for r in graph.parse_triples(replies).collect()] == [("s", "a", "b")]


def test_linking_and_facts(spark, parts):
    nodes, edges = parts
    asked = spark.createDataFrame([(1, "How does clip-vit-b-32 use an image-encoder?"), (2, "nothing")], "query_id int, question string")
    linked = graph.link_entities(asked, nodes, graph.alias_table(spark))
    assert [(r.name, r.place) for r in linked.orderBy("place").collect()] == [("Image Encoder", 1), ("CLIP", 2)]
    start = spark.createDataFrame([(1, "Image Encoder")], "query_id int, name string")
    facts = graph.gather_facts(edges, start, 2).orderBy("hop", "head").collect()
    assert [(f.hop, f.head, f.relation, f.tail, f.paper) for f in facts] == [(1, "CLIP", "uses", "Image Encoder", "p1"), (2, "GNN", "uses", "CLIP", "p2")]


def test_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d"), ("x", "y"), ("z", "z")]
    edges = spark.createDataFrame([(a, "r", b, "p") for a, b in pairs], "head string, relation string, tail string, paper string")
    members = communities.communities(edges)
    assert sorted((r.community, r.name) for r in members.collect()) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e"), ("d", "f"), ("x", "x"), ("x", "y")]
    assert graph.community_facts(edges, members).count() == 7


def test_components_and_merging(spark):
    rows = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (1, 2), (2, 1), (None, 3), (900, 139)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {**{i: 100 for i in [*range(100, 141), 900]}, 7: 7, 1: 1, 2: 1}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    names = spark.createDataFrame([("net", [1.0, 0.0]), ("network", [0.99, 0.05]), ("tree", [0.0, 1.0])], "name string, embedding array<double>")
    assert {r.name: r.canonical for r in graph.merge_similar(names, 0.9).collect()} == {"net": "net", "network": "net", "tree": "tree"}


def test_grids(spark):
    assert tables.html_grid('<table><tr><th>a</th><th colspan="2">b</th></tr><tr><td rowspan=2>c</td><td>d</td><td>e</td></tr><tr><td>f</td></tr></table>') == [["a", "b", "b"], ["c", "d", "e"], ["c", "f", ""]]
    assert tables.html_grid("<tr></tr>") == [] and tables.html_grid(None) == []
    assert tables.html_grid('<td rowspan="2">a<td>&lt;b<tr><td>c<tr>') == [["a", "<b"], ["a", "c"]]
    assert tables.html_grid("<tr><td rowspan=3>a</td></tr>") == [["a"], ["a"], ["a"]]
    md = spark.createDataFrame([("x\n| a | b |\n|---|:-:|\n| 1 | |\n",), (None,)], "t string")
    assert [r.g for r in md.select(tables.markdown_cells(F.col("t")).alias("g")).collect()] == [[["a", "b"], ["1", ""]], []]
    tex = r"\begin{tabular}{|l|l|}\hline \multicolumn{2}{c}{h} \\ \multirow{2}{*}{v} & \(10^{9}/\mathrm{L}\) \\ & \begin{tabular}{l}x \\ y\end{tabular} \\ \end{tabular}"
    assert tables.latex_grids(tex) == [[["h", ""], ["v", "10^9/L"], ["v", "xy"]]]
    boxes = [(10, 10, 10, "a"), (100, 12, 10, "b"), (12, 30, 10, "c"), (14, 31, 10, "d"), (104, 30, 10, "e")]
    frame = spark.createDataFrame([(1, *map(float, b[:3]), b[3]) for b in boxes], "page int, x double, y double, height double, text string")
    assert sorted((r.row, r.column, r.text) for r in tables.box_cells(frame).collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c d"), (1, 1, "e")]
    assert tables.box_cells(frame.limit(0)).count() == 0
    assert tables.plain_math(r"\(10^{9}/\mathrm{L}\) \downarrow a_{1} x_y 5\%") == "10^9/L↓a1x_y5%"


HEAD = ["检验大类", "项目", "结果", "单位", "参考范围", "提示"]


def test_rows_over_pages_and_heads(spark):
    def rows(grids, robust=True):
        frame = spark.createDataFrame([("t", k, g) for k, g in enumerate(grids)], "table_id string, grid_no int, cells array<array<string>>")
        return tables.grid_rows(frame, robust).orderBy("row_no").collect()

    grids = [[HEAD, ["血", "葡萄糖", "8.5 mmol/L", "", "3.9-6.1 mmol/L", "↑"], ["", "钾", "4", "mmol/L", "3-5", ""]], [], [["", "钠", "140", "mmol/L", None, ""]]]
    got = rows(grids)
    assert [r["category"] for r in got] == ["血"] * 3 and (got[0]["result"], got[0]["unit"], got[0]["ref_range"]) == ("8.5", "mmol/L", "3.9-6.1")
    assert [r.row_no for r in got] == [0, 1, 2] and got[2].ref_range == ""
    assert [r["item"] for r in rows(grids[:1], robust=False)] == ["葡萄糖", "钾"]
    two = [["检验大类", "项目", "结果信息", "结果信息", "参考信息", "参考信息"], ["", "", "测定值", "单位", "参考范围", "异常提示"], ["a", "b", "1", "u", "0-2", ""]]
    assert rows([two])[0].asDict() == {"table_id": "t", "row_no": 0, "category": "a", "item": "b", "result": "1", "unit": "u", "ref_range": "0-2", "flag": ""}
    assert [r.item for r in rows([[["a", "b"], ["c", "d"]]], robust=False)] == ["d"]


def test_scores(spark):
    assert tables.norm("10⁹／Ｌ 3–5 µ") == "10^9/L3-5μ"
    truth = [{"item": "葡萄糖", "result": "5"}, {"item": "血清钾", "result": "4"}]
    got = tables.table_score(truth, [{"item": "血清钾(K)", "result": "4"}, {"item": "葡萄糖", "result": "5"}], ["item", "result"])
    assert got == {"n_rows": 2, "row_acc": 0.5, "field_em": {"item": 0.5, "result": 1.0}, "field_em_mean": 0.75}
    assert tables.text_hit(truth, [[["葡萄", "糖5"]]], ["item", "result"]) == 0.5
    html = lambda *rows: "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows)
    pages = spark.createDataFrame([("t", 2, html(["甲", "乙", "2", "u", "", ""])), ("t", 1, html(HEAD, ["甲", "乙", "1", "u", "", ""]))], "table_id string, page int, content string")
    found = tables.rows_of(pages, lambda c: [tables.html_grid(c)])
    assert [(r.row_no, r.result) for r in found.orderBy("row_no").collect()] == [(0, "1"), (1, "2")]
    scored = tables.score_tables(found.withColumn("result", F.lit("1")), found, ("item", "result")).first()
    assert (scored.n_rows, scored.row_acc, scored.field_em) == (2, 0.5, {"item": 1.0, "result": 0.5})
    pairs = spark.createDataFrame([("葡萄糖", "葡萄酒"), ("a", "a"), ("", "x")], "a string, b string")
    assert [r.s for r in pairs.select(tables.bigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [tables.similarity(*p) for p in (("葡萄糖", "葡萄酒"), ("a", "a"), ("", "x"))]


def test_citations_grades_decisions(spark):
    schema = "query_id int, answer string, sources array<struct<n:int,source_id:string>>, expected array<string>"
    rows = [(1, "x [1][2][9]", [(1, "a"), (2, "b")], ["a"]), (2, "none", [(1, "a")], ["z"]), (3, "资料不足", [(1, "a")], ["a"])]
    got = {r.query_id: r for r in generation.citation_metrics(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].n_citations, round(got[1].citation_valid, 3), got[1].citation_precision, got[1].gold_cited) == (3, 0.667, 0.5, 1.0)
    assert (got[2].citation_valid, got[2].gold_cited, got[2].abstain_correct) == (0.0, None, False) and (got[3].abstained, got[3].gold_cited, got[3].abstain_correct) == (True, 0.0, False)
    replies = spark.createDataFrame([(1, 'so [{"i":0,"score":1.5},{"i":2,"score":0.4}]'), (2, "no")], "query_id int, reply string")
    assert {r.query_id: r.scores for r in generation.grades(replies, 3).collect()} == {1: [1.0, 0.0, 0.4], 2: [0.0] * 3}
    cases = [(0.6, None, "proceed"), (0.2, None, "abstain"), (0.2, 0.3, "refined"), (0.2, 0.29, "abstain"), (0.4, 0.4, "proceed"), (0.4, 0.41, "refined"), (0.3, None, "proceed")]
    frame = spark.createDataFrame(cases, "a double, b double, want string")
    assert frame.where(generation.corrective_decision(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    judged = generation.judge_means(spark.createDataFrame([('{"faithfulness": 4, "relevance": 5}',), ("bad",), ('{"faithfulness": 2}',)], "reply string")).first()
    assert tuple(judged) == (3, 2, 3.0, 2.5)
    kept = spark.createDataFrame([("ok",), ("",), (None,), ("资料不足。",)], "a string").where(generation.cacheable(F.col("a"))).count()
    assert kept == 1


def test_client_and_stream():
    calls, pauses = [], []

    def send(model, messages, **options):
        calls.append(model)
        if len(calls) < 3:
            raise generation.RetryableError
        return "hi", {}

    assert generation.ChatClient(send, {"judge": "big"}, sleep=pauses.append).chat([], "judge")["text"] == "hi"
    assert calls == ["big"] * 3 and pauses == [2.0, 4.0]
    with pytest.raises(generation.RetryableError):
        generation.ChatClient(lambda *a, **k: (_ for _ in ()).throw(generation.RetryableError()), sleep=lambda s: None).chat([])
    assert "".join(generation.visible(iter(["a<thi", "nk>b</think>c", "<think>d</think>e<", "f<think>open"]))) == "ace<f"
    assert time.monotonic() > 0


def test_context(spark):
    rows = spark.createDataFrame([(1, 2, "b", "", "text b"), (1, 1, "a", "A", "0123456789")], "query_id int, rank int, source_id string, title string, text string")
    got = generation.build_context(rows, 5).first()
    assert got.context == "[1] A\n01234\n\n[2] b\ntext " and [tuple(s) for s in got.sources] == [(1, "a"), (2, "b")]
