import json

import pytest
import yaml
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tessera.sources import files, sinks
from tessera.storage import Workspace, exists, shared_dir
from tessera.streaming import events, logs


def test_jsonl_and_text_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","title":"t","tags":["x"],"content":"c"}\n\n', "utf-8")
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"id":\n', "utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    folder = tmp_path / "texts" / "deep"
    folder.mkdir(parents=True)
    for name, raw in {"One Two.md": "﻿hello".encode(), "三.txt": "中文".encode("gb18030"), "README.md": b"no", "empty.txt": b" \n", "x.bin": b"no", "broken.txt": b"ab\xff"}.items():
        (folder / name).write_bytes(raw)
    assert {r.id: r.content for r in files.read_text_files(spark, str(tmp_path / "texts")).collect()} == {"one_two": "hello", "三": "中文", "broken": "ab�"}
    assert files.decoded(None) is None


def test_structured(spark, tmp_path):
    record = {"疾病名称": " 感冒 ", "描述": "d", "就诊科室": "内科、儿科", "症状": "发热;咳嗽", "患病概率": "", "分类": "x"}
    (tmp_path / "d.json").write_text(json.dumps([{"描述": "no name"}, record], ensure_ascii=False), "utf-8")
    docs = files.STRUCTURED["diseases"](spark, str(tmp_path / "d.json"), 0).collect()
    assert [(d.id, d.title, d.tags) for d in docs] == [("disease_00001", "感冒", ["disease", "内科", "儿科"])]
    assert docs[0].content == "疾病名称：感冒\n就诊科室：内科、儿科\n\n【描述】\nd\n\n【症状】\n发热、咳嗽"
    assert docs[0].metadata["symptoms"] == "发热、咳嗽"
    assert files.read_records(spark, str(tmp_path / "d.json"), 1).count() == 1


def test_query_sets(spark):
    text = "- id: q1\n  question: a?\n  expected_source_ids: [d1, d2]\n  note: n\n- id: q2\n  question: b?\n"
    queries = files.read_query_set(spark, text)
    assert files.find_query(queries, "q1").first().expected == ["d1", "d2"]
    with pytest.raises(KeyError, match="q1, q2"):
        files.find_query(queries, "q9")
    again = files.read_query_set(spark, sinks.query_set_yaml(queries.where("query_id = 'q2'"), queries.where("query_id = 'q1'")))
    assert [r.query_id for r in again.collect()] == ["q2", "q1"]


def test_pages_and_figures(spark):
    pages = spark.createDataFrame([("My File", 1, "text", "x" * 40), ("My File", 2, "text", "short"), ("My File", 2, "table", "| a |"), ("My File", 3, "figure", " ")], "file string, page int, modality string, content string")
    assert sorted(r.id for r in files.page_documents(pages).collect()) == ["pdf_my_file_p0001", "pdf_my_file_p0002_table"]
    counts = spark.createDataFrame([("a", 1, 2), ("a", 2, 5), ("a", 3, 5), ("b", 1, 0), ("c", 1, 1)], "file string, page int, n_images int")
    assert [(r.file, r.page) for r in files.figure_pages(counts, 2, 3).collect()] == [("a", 2), ("a", 3), ("c", 1)]
    chunk = [("d", 1, "second", {"modality": "figure", "image_path": "i"}), ("d", 0, "first", {"modality": "figure", "image_path": "i"}), ("d", 2, "t", {"modality": "text"})]
    assert [tuple(r) for r in files.figures(spark.createDataFrame(chunk, "source_id string, chunk_index int, text string, metadata map<string,string>")).collect()] == [("i", "d", "first")]
    grids = spark.createDataFrame([([["a", "b"], ["1\n2"], [None, "3", "4"]],), ([["a", "b"]],), ([["a", ""], ["", "b"]],)], "g array<array<string>>")
    assert [r[0] for r in grids.select(files.table_markdown(F.col("g"))).collect()] == ["| a | b |\n| --- | --- |\n| 1 2 |  |\n|  | 3 |\n", None, None]


def test_collections_and_logs(spark, tmp_path):
    c = sinks.Collection(spark, f"file://{tmp_path}/c")
    rows = lambda *p: spark.createDataFrame(p, "chunk_id string, v int")
    assert c.read() is None and c.count() == 0
    c.upsert(rows(("a", 1), ("b", 1)))
    c.upsert(rows(("b", 2), ("c", 2)))
    assert {r.chunk_id: r.v for r in c.read().collect()} == {"a": 1, "b": 2, "c": 2}
    assert len(c.versions()) == 2 and c.spark.read.parquet(c.versions()[1]).count() == 2  # an upsert writes its own rows only
    c.compact()
    assert len(c.versions()) == 1 and {r.chunk_id: r.v for r in c.read().collect()} == {"a": 1, "b": 2, "c": 2}
    c.upsert(rows(("a", 7)), name="seven")
    c.upsert(rows(("a", 8)), name="seven")
    assert {r.chunk_id: r.v for r in c.read().collect()} == {"a": 7, "b": 2, "c": 2}
    c.upsert(rows(("z", 9)), reset=True)
    assert c.count() == 1
    c.drop()
    assert c.count() == 0
    for seq in (1, 2):
        sinks.append_log(spark.createDataFrame([("l", "e", seq)], "label string, eval_set string, seq int"), f"file://{tmp_path}/log")
    assert files.latest_runs(spark.read.json(f"file://{tmp_path}/log")).first().seq == 2
    assert sinks.markdown_table(spark.createDataFrame([("a", 0.5)], "name string, mean double")) == "| name | mean |\n| --- | --- |\n| a | 0.500 |\n"
    sinks.write_graph(rows(("n", 1)), rows(("e", 1)), f"file://{tmp_path}/g")
    assert [df.count() for df in sinks.read_graph(spark, f"file://{tmp_path}/g")] == [1, 1]


def test_written_sets_and_dumps(spark, tmp_path):
    query = lambda *p: spark.createDataFrame(p, "query_id string, question string, expected array<string>, note string")
    manual, made = query(("m2", "b: c", ["x"], None), ("m1", "a", [], "n")), query(*((f"q{i:03d}", f"question {i}\n- x", ["d", "é"], "") for i in range(50)))
    sinks.write_query_set(manual, made, f"file://{tmp_path}/set")
    text = "\n".join(r.value for f in sorted((tmp_path / "set").glob("part-*")) for r in spark.read.text(f"file://{f}").collect())
    assert yaml.safe_load(text) == yaml.safe_load(sinks.query_set_yaml(manual, made))
    sinks.write_vectors(spark.createDataFrame([(1, [0.5, 1.0], "m")], "vec_id long, embedding array<double>, meta string"), f"file://{tmp_path}/v")
    assert tuple(sinks.read_vectors(spark, f"file://{tmp_path}/v").first()) == (1, [0.5, 1.0], "m")
    chunks = spark.createDataFrame([("a::chunk_000", "t")], "chunk_id string, text string")
    sinks.write_chunks(chunks, f"file://{tmp_path}/chunks")
    assert sinks.read_chunks(spark, f"file://{tmp_path}/chunks").collect() == chunks.collect()


def test_log_stream_survives_a_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    schema = "chunk_id string, v int, seq int"
    put = lambda n, *p: spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    c = sinks.Collection(spark, f"file://{tmp_path}/keyed")
    put(0, ("a", 1, 1), ("b", 1, 2), ("a", 2, 3), (None, 0, 4))
    run = lambda: logs.into_collection(stream(), c, "seq", f"file://{tmp_path}/ck").awaitTermination(120)
    assert run() and {r.chunk_id: r.v for r in c.read().collect()} == {"a": 2, "b": 1}
    put(1, ("b", 5, 5), ("d", 6, 6))
    with monkeypatch.context() as m:  # dies when the rows are written and the log doesn't name them yet
        m.setattr(sinks.Collection, "_log", lambda *_: 1 / 0)
        with pytest.raises(StreamingQueryException):
            run()
    assert {r.chunk_id: r.v for r in c.read().collect()} == {"a": 2, "b": 1}
    original = sinks.Collection._log

    def logged_then_dead(self, *args):
        original(self, *args)
        raise RuntimeError("dead")

    with monkeypatch.context() as m:  # dies when the log names them and the batch isn't committed yet
        m.setattr(sinks.Collection, "_log", logged_then_dead)
        with pytest.raises(StreamingQueryException):
            run()
    for _ in range(2):
        assert run() and {r.chunk_id: r.v for r in c.read().collect()} == {"a": 2, "b": 5, "d": 6} and len(c.versions()) == 2


def test_workspace(spark):
    work = Workspace(spark, "t")
    saved = work.save(spark.range(3).toDF("id"))
    assert saved.count() == 3 and work.path.startswith(shared_dir(spark))
    work.drop(saved)
    assert not exists(spark, saved._tessera_path)


def test_windows_of_a_stream_are_those_of_the_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(1).sortWithinPartitions("ts").write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/e")
    for name, function in (("tumbling", events.tumbling), ("sessions", events.sessions), ("sliding", events.sliding)):
        query = function(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        closed, every = spark.table(name), function(rows)
        assert 0 < closed.count() <= every.count() and closed.select(every.columns[:2] + ["n"]).exceptAll(every.select(every.columns[:2] + ["n"])).count() == 0
