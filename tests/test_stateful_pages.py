import json

from pyspark.sql import functions as F

from tessera.operators import answers, evaluation, generation
from tessera.sources import pages
from tessera.streaming import stateful


def in_files(spark, rows, path, n):
    """rows as n files in the order of ts, read one a micro-batch."""
    ordered = rows.orderBy("ts").toPandas()
    step = -(-len(ordered) // n)
    for k in range(n):
        spark.createDataFrame(ordered.iloc[k * step : (k + 1) * step], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_running_percentile_is_that_of_the_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    stream = stateful.running_percentile(in_files(spark, rows, f"file://{tmp_path}/in", 3), "event_type", "value", "ts", "event_id", 95, 40)
    got = stateful.run_to_table(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", "update")
    assert got.select("batch").distinct().count() == 3
    last = {r.key: r.value for r in got.groupBy("key").agg(F.max_by("value", "batch").alias("value")).collect()}
    want = evaluation.recent_percentile(rows.withColumn("at", F.struct("ts", "event_id")), ("event_type",), "value", "at", 95, 40)
    assert last == {r.event_type: r.p95 for r in want.collect()} and len(last) > 2


def test_trace_totals_end_when_quiet_and_late_rows_stand_apart(spark, tmp_path):
    schema = "trace string, name string, ms double, ts timestamp"
    at = lambda rows: spark.createDataFrame(rows, "trace string, name string, ms double, s long").selectExpr("trace", "name", "ms", "timestamp_seconds(s) as ts")
    parts = [
        [("a", "x", 1.0, 1000), ("a", "y", 2.0, 1001), ("b", "x", 5.0, 1002), (None, "x", 1.0, 1000), ("c", None, 1.0, 1000)],
        [("a", "x", 3.0, 1030), ("d", "x", 7.0, 2000)],
        [("b", "x", 9.0, 1003), ("e", "z", 1.0, 5000)],  # b is closed by now
    ]
    path = f"file://{tmp_path}/in"
    run = lambda: stateful.run_to_table(
        stateful.trace_totals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "trace", "name", "ms", "ts", 60_000, "10 seconds"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    )
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for part in parts:  # each run goes on where the last one stopped
        at(part).coalesce(1).write.mode("append").parquet(path)
        got = run()
    rows = {(r.trace_id, r.name, r.ms, r.n, r.late) for r in got.collect()}
    assert rows == {("a", "x", 4.0, 2, False), ("a", "y", 2.0, 1, False), ("b", "x", 5.0, 1, False), ("b", "x", 9.0, 1, True), ("d", "x", 7.0, 1, False)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_pages_of_files_by_a_parser(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one\ftwo")
    (tmp_path / "deep" / "b.txt").write_bytes(b"three\f!")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "d.bin").write_bytes(b"no")

    def make():
        def parse(file, raw):
            for k, page in enumerate(raw.decode().split("\f")):
                if page == "!":
                    raise ValueError("broken page")
                yield k + 1, "text", page, 0

        return parse

    got = pages.read_pages(spark, f"file://{tmp_path}", make, "*.txt").collect()
    assert sorted((r.file[-5:], r.page or 0, r.content or "", r.error) for r in got) == [("a.txt", 1, "one", None), ("a.txt", 2, "two", None), ("b.txt", 0, "", "ValueError: broken page"), ("b.txt", 1, "three", None)]


def test_server_sent_events():
    part = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    lines = [": alive", "event: x", part("<thi"), "", part("nk>no</think>yes").encode(), b"", "data: {broken", "", 'data: {"choices": []}', "", part(None), "", 'data: {"choices": [{"delta":', 'data: {"content": "!"}}]}', "", "data: [DONE]", "", part("after"), ""]
    assert "".join(generation.visible(generation.event_deltas(lines))) == "yes!"
    assert [*generation.event_deltas([part("end")])] == ["end"] and [*generation.event_deltas([])] == []


def test_a_judge_is_asked_again_where_its_reply_is_none(spark):
    def make():
        asked = {}

        def judge(system, user, images):
            asked[user] = asked.get(user, 0) + 1
            return '{"faithfulness": 1, "relevance": 0.5}' if user == "good" else "no JSON"

        return judge

    prompts = spark.createDataFrame([("1", "good"), ("2", "bad")], "query_id string, user string")
    got = answers.judged(prompts, make, tries=3)
    assert {r.query_id: (r.tried, r.reply.startswith("{")) for r in got.collect()} == {"1": (1, True), "2": (3, False)}
    assert generation.judge_means(got).collect()[0].n_parsed == 1
