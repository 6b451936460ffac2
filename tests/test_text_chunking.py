import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.catalog import QUERIES
from tessera.functions import text as T
from tessera.operators import chunking, rewriting


def one(spark, expression, **columns):
    names = list(columns)
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {'array<string>' if isinstance(columns[n], list) else 'string'}" for n in names))
    return row.select(expression).first()[0]


def test_tokens_and_cleaning(spark):
    assert one(spark, T.tokenize(F.col("t")), t="苯中毒 RAG v1.2") == ["苯", "中", "毒", "rag", "v1.2"]
    assert one(spark, T.clean_text(F.col("t")), t=" a\r\nb\t c\n\n\n\nd \n") == "a\nb c\n\nd"
    assert one(spark, T.stable_id(F.col("t")), t="Dir\\A B!.md") == "dir_a_b_md"
    assert one(spark, T.stable_id(F.col("t")), t="!!") == "doc"
    assert one(spark, T.split_list(F.col("t")), t=" a，b;; c、") == ["a", "b", "c"]
    assert one(spark, T.norm_key(F.col("t")), t=" CLIP-ViT B：32 (x)") == "clipvitb32x"
    assert one(spark, T.paper_of(F.col("t")), t="doc_p0012_fig") == "doc"
    assert one(spark, T.strip_think(F.col("t")), t="<think>x</think>a<think>open") == "a"
    assert one(spark, T.snippet(F.col("t"), 10), t="abc  def\nghi jkl") == "abc def..."


def test_units_json_overlap(spark):
    assert tuple(one(spark, T.value_and_unit(F.col("v"), F.col("u")), v="8.5 mmol/L", u="")) == ("8.5", "mmol/L")
    assert tuple(one(spark, T.value_and_unit(F.col("v"), F.col("u")), v="<3", u="")) == ("<3", "")
    assert one(spark, T.without_unit(F.col("r"), F.col("u")), r="3.9-6.1 mmol/L", u="mmol/L") == "3.9-6.1"
    assert one(spark, T.json_object(F.col("t"), "a int")["a"], t='Here: ```{"a": 3}``` ok') == 3
    assert [r[0] for r in one(spark, T.json_array(F.col("t"), "struct<a:int>"), t='x [{"a":1},{"a":2}] y')] == [1, 2]
    assert one(spark, T.json_array(F.col("t"), "struct<a:int>"), t='x [{"a":1}, {"a"') == []
    assert one(spark, T.overlap(T.bigrams(F.col("a")), T.bigrams(F.col("b"))), a="abcd", b="bcx") == 0.5
    assert one(spark, T.join_overlap(F.col("p")), p=["0123456789abcdef", "456789abcdefXYZ", "new"]) == "0123456789abcdefXYZ\nnew"


def slow_windows(text, size, overlap):
    size = max(20, size)
    overlap, out, at = max(0, min(overlap, size - 1)), [], 0
    while at < len(text):
        out.append(text[at : at + size].strip())
        if at + size >= len(text):
            break
        at += size - overlap
    return [x for x in out if x]


def slow_paragraphs(text, size, overlap):
    out, held = [], ""
    for p in [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]:
        if len(p) > size:
            out += [held.strip()] * bool(held) + slow_windows(p, size, overlap)
            held = ""
        elif len(held and f"{held}\n\n{p}" or p) <= size:
            held = f"{held}\n\n{p}" if held else p
        else:
            out.append(held.strip())
            tail = held[-overlap:].strip() if overlap else ""
            held = f"{tail}\n\n{p}".strip() if tail else p
    return out + [held.strip()] * bool(held)


TEXT = st.text(st.sampled_from("ab c\n"), max_size=120)


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=25), st.sampled_from([(20, 0), (30, 7), (45, 44)]))
def test_windows_and_paragraphs(spark, texts, sizes):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", chunking.fixed_windows(F.col("t"), *sizes).alias("w"), chunking.paragraph_chunks(F.col("t"), *sizes).alias("p")).orderBy("i").collect()
    assert [r.w for r in got] == [slow_windows(t, *sizes) for t in texts]
    assert [r.p for r in got] == [slow_paragraphs(t, *sizes) for t in texts]


def test_titles(spark):
    docs = spark.createDataFrame([("d", "Title", "x" * 50), ("e", None, None)], "doc_id string, title string, content string")
    assert [(r.chunk_id, r.text) for r in chunking.make_chunks(docs.limit(1), "paragraph", 40, 10).orderBy("chunk_index").collect()][:2] == [("d::chunk_000", "Title"), ("d::chunk_001", "x" * 40)]
    titled = chunking.make_chunks(docs.limit(1), "fixed", 40, 10, True).orderBy("chunk_index").collect()
    assert [r.text for r in titled] == ["Title\n" + "x" * 40, "Title\n" + "x" * 20]
    assert chunking.make_chunks(docs.where("doc_id = 'e'")).first().text == "e"


def test_context_cache_and_parents(spark):
    chunks = spark.createDataFrame([("d::0", "d", 0, "T", "first part of d 123456"), ("d::1", "d", 1, "T", "part of d 123456 ends"), ("e::0", "e", 0, "U", "other")], "chunk_id string, source_id string, chunk_index int, title string, text string")
    cached = chunks.where("chunk_id = 'd::1'").select(T.cache_key(F.col("source_id"), F.col("text")).alias("key"), F.lit("known").alias("sentence"))
    got = {r.chunk_id: r.text for r in chunking.contextual_prefix(chunks, lambda t, x: F.concat(F.lit("of "), t), cached, first=2).collect()}
    assert got == {"d::0": "of T\nfirst part of d 123456", "d::1": "known\npart of d 123456 ends", "e::0": "of U\nother"}
    hits = spark.createDataFrame([("q", 2, "d"), ("q", 1, "e"), ("q", 3, "e")], "query_id string, rank int, source_id string")
    rows = chunking.parent_documents(hits, chunks).orderBy("parent_rank").collect()
    assert [(r.source_id, r.text) for r in rows] == [("e", "other"), ("d", "first part of d 123456 ends")]


def test_all_parents_as_a_whole(spark, tmp_path):
    line = "the same line of a text that says it again and again\n"
    texts = [(i, f"apple {i} " + (line * 100 if i == 3 else " ".join(f"w{k * k % 977}" for k in range(i * 200)))) for i in range(12)] + [(12, None)] + [(i, f"other{i}") for i in range(13, 50)]
    spark.createDataFrame([(i, "en", f"src{i}", t) for i, t in texts], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an apple")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["parent_documents"](spark, str(tmp_path)).orderBy("parent_rank").collect()
    assert [r.parent_rank for r in rows] == list(range(1, 11)) and sum(len(r.text) > 4000 for r in rows) >= 5
    assert all(r.text == f"src{r.source_id}\n\n{texts[int(r.source_id)][1].strip()}" for r in rows) and "3" in {r.source_id for r in rows}


def test_rewriting(spark):
    assert one(spark, rewriting.add_terms(F.col("q")), q="拉肚子和心脏不舒服，胸闷") == "拉肚子和心脏不舒服，胸闷 腹泻 心悸"
    assert one(spark, rewriting.keywords(F.col("q")), q="请问，高血压会不会头痛？") == "高血压 头痛"
    assert one(spark, rewriting.keywords(F.col("q")), q="的吗") == "的吗"
    queries = spark.createDataFrame([(1, "拉肚子 吗")], "query_id int, question string")
    model = lambda q: F.concat(F.lit("- one\n\n · two\n"), q)
    specs = rewriting.retrieval_queries(queries, rules=True, nlp=True, mode="multi", model=model, variants=2).orderBy("spec_no").collect()
    assert [(s.vector_text, s.bm25_text) for s in specs] == [("拉肚子 吗 腹泻", "拉肚子 腹泻"), ("one", "one"), ("two", "two")]
    hyde = rewriting.retrieval_queries(queries, mode="hyde", model=lambda q: F.lit("answer")).first()
    assert (hyde.vector_text, hyde.bm25_text) == ("answer", "拉肚子 吗")


def test_bigrams_of_long_and_odd_texts(spark):
    for text in ("", "a", "aa", "é🙂é🙂", "\n\n", None):
        want = None if text is None else {text[i : i + 2] for i in range(len(text) - 1)} or set(text)
        got = one(spark, T.bigrams(F.col("a")), a=text)
        assert (got or set()) == (want or set()) if got is None or want is None else set(got) == want and len(got) == len(want)
    long = "".join(chr(97 + i * i % 26) for i in range(1_000_000))  # quadratic work would take hours
    assert one(spark, F.size(T.bigrams(F.col("a"))), a=long) == len({long[i : i + 2] for i in range(len(long) - 1)})
