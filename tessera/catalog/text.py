"""Queries: chunking, text functions, query rewriting, generation metrics."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tessera.catalog.retrieval import BM25_SQL, TOKEN_SQL, chunks, lexical, lexical_sql, r6, read, six
from tessera.functions import text as T
from tessera.functions.table_functions import register_all
from tessera.operators import chunking, evaluation, evalset, generation, rewriting, segmentation
from tessera.operators.ranking import rounded
from tessera.plans.retrieval import ask
from tessera.storage import spread


def chunked(strategy, prepend):
    """Chunks of every document, whose title is its source."""

    def query(spark, sf_dir):
        docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
        return chunking.make_chunks(docs, strategy, 360, 80, prepend).select("chunk_id", "source_id", "chunk_index", "text")

    return query


def contextual_chunks(spark, sf_dir):
    """A sentence of context (a stand-in for a model's) before the first three chunks of each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    made = chunking.make_chunks(docs, "fixed", 360, 80, True)
    return chunking.contextual_prefix(made, lambda title, text: F.concat(F.lit("From "), title, F.lit(".")), first=3).select("chunk_id", F.md5("text").alias("digest"))


def parent_documents(spark, sf_dir):
    """All the documents behind the ten best chunks of each item, put together again as a whole from their chunks."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    made = chunking.make_chunks(docs, "fixed", 360, 80, False)
    hits = lexical(spark, sf_dir, 10).select("query_id", "rank", F.col("chunk_id").cast("string").alias("source_id"))
    return chunking.parent_documents(hits, made, None, None, 80).select("query_id", "parent_rank", "source_id", "text")


def chunk_lateral(spark, sf_dir):
    """chunk_fixed again, by the registered table function in SQL."""
    register_all(spark)
    title = F.coalesce(F.col("source"), F.col("doc_id").cast("string"))
    body = T.clean_text(F.concat(title, F.lit("\n\n"), F.coalesce("text", F.lit(""))))
    docs = spread(read(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("source_id"), body.alias("body"))
    return spark.sql("SELECT format_string('%s::chunk_%03d', source_id, chunk_index) AS chunk_id, source_id, chunk_index, piece AS text FROM {docs}, LATERAL fixed_chunks(body, 360, 80)", docs=docs)


def segmented_items(spark, sf_dir):
    """Benchmark items written without spaces, cut into words again by the words of the documents."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace("text", r"\s+", "").alias("question"))
    found = segmentation.segmented(items, segmentation.corpus_words(read(spark, sf_dir, "documents")))
    return found.join(items, F.col("id") == F.col("query_id")).select("query_id", segmentation.without_stop_words(F.col("words"), F.col("question")).alias("keywords"))


def text_functions(spark, sf_dir):
    """The scalar functions over every document."""
    t = F.col("text")
    return spread(read(spark, sf_dir, "documents")).select(
        "doc_id", F.size(T.tokenize(t)).alias("n_tokens"), F.md5(T.clean_text(t)).alias("cleaned"), T.snippet(t, 80).alias("snippet"),
        T.stable_id(F.concat("source", F.lit("/"), t)).alias("slug"), T.cache_key(F.col("doc_id"), t).alias("key"),
        F.size(T.split_list(t)).alias("n_parts"), F.size(T.bigrams(t)).alias("n_bigrams"),
    )


def query_rules(spark, sf_dir):
    """Every conversation turn with the terms that the rule layer adds, under a small table of synonyms."""
    synonyms = {"the": "article det", "is": "verb", "and": "junction det"}
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", rewriting.add_terms(F.col("text"), synonyms).alias("text"))


def keyword_queries(spark, sf_dir):
    """Every benchmark item without punctuation and stop words."""
    return read(spark, sf_dir, "benchmark").select("item_id", rewriting.keywords(F.col("text"), ["the", "and", "that"]).alias("keywords"))


def history_block(spark, sf_dir):
    return rewriting.history_block(read(spark, sf_dir, "conversations"))


def verbalize(spark, sf_dir):
    """Parts as headed paragraphs."""
    fields = [("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.col("p_size").cast("string"))]
    return read(spark, sf_dir, "part").select("p_partkey", T.verbalize(F.col("p_name"), fields).alias("content"))


def json_fields(spark, sf_dir):
    """The JSON object in every event's properties, with prose around it."""
    reply = F.concat(F.lit("Here: "), "props", F.lit(" done"))
    return read(spark, sf_dir, "events").select("event_id", T.json_object(reply, "k int")["k"].alias("k"), T.strip_think(F.concat(F.lit("<think>x</think> "), "event_type")).alias("type"))


def values_and_units(spark, sf_dir):
    """Results with units behind them, made of part sizes."""
    cell = F.concat(F.col("p_size").cast("string"), F.lit(" mmol/L"))
    ref = F.concat(F.lit("1-"), F.col("p_size").cast("string"), F.lit(" mmol/L"))
    split = T.value_and_unit(cell, F.lit(""))
    return read(spark, sf_dir, "part").select("p_partkey", split["value"].alias("value"), split["unit"].alias("unit"), T.without_unit(ref, split["unit"]).alias("ref_range"))


def context_blocks(spark, sf_dir):
    """Numbered context of each item's five best documents."""
    hits = lexical(spark, sf_dir, 5).join(chunks(spark, sf_dir), "chunk_id").select("query_id", "rank", F.col("chunk_id").cast("string").alias("source_id"), F.lit("").alias("title"), "text")
    return generation.build_context(hits, 600).select("query_id", "context", F.size("sources").alias("n_sources"))


def citation_metrics(spark, sf_dir):
    """Answers made of customers: three sources, citations of the balance's digits, one expected source."""
    c = read(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    sources = F.array(*(F.struct(F.lit(i).alias("n"), ((n + i) % 4).cast("string").alias("source_id")) for i in (1, 2, 3)))
    answer = F.concat(F.lit("It is ["), (n % 5).cast("string"), F.lit("] and ["), (n % 3 + 1).cast("string"), F.lit("]"), F.when(n % 7 == 0, "，资料不足").otherwise(""))
    rows = c.select(n.alias("query_id"), answer.alias("answer"), sources.alias("sources"), F.array((n % 6).cast("string")).alias("expected"))
    m = generation.citation_metrics(rows)
    return m.select("query_id", "n_citations", six("citation_valid"), six("citation_precision"), "gold_cited", "retrieved_gold", "abstained", "abstain_correct")


def crag_confusion(spark, sf_dir):
    """Counts of corrective decisions, with scores made of events."""
    e = read(spark, sf_dir, "events")
    top, after = F.pmod(F.col("event_id") * 7, F.lit(100)) / 100, F.when(F.col("event_id") % 3 > 0, F.pmod(F.col("event_id") * 13, F.lit(100)) / 100)
    rows = e.select((F.col("user_id") % 2 == 0).alias("base_hit"), (F.col("event_id") % 5 == 0).alias("final_hit"), generation.corrective_decision(top, after).alias("decision"))
    return generation.corrective_summary(rows).withColumn("abstain_recall", six("abstain_recall")).withColumn("false_abstain_rate", six("false_abstain_rate"))


def judge_means(spark, sf_dir):
    """Means of a judge's replies, of which every fifth is broken."""
    reply = F.when(F.col("event_id") % 5 == 0, "no json").otherwise(F.concat(F.lit('{"faithfulness": '), (F.col("event_id") % 6).cast("string"), F.lit(', "relevance": '), (F.col("event_id") % 4).cast("string"), F.lit("}")))
    m = generation.judge_means(read(spark, sf_dir, "events").select(reply.alias("reply")))
    return m.select("n", "n_parsed", six("faithfulness"), six("relevance"))


def token_cost(spark, sf_dir):
    """Cost of each user's events, with a price for every type but one."""
    usage = read(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 300).alias("completion_tokens"))
    prices = read(spark, sf_dir, "events").select(F.col("event_type").alias("model")).distinct().where("model <> 'click'").select("model", F.length("model").cast("double").alias("prompt_price"), F.lit(2.0).alias("completion_price"))
    return evaluation.token_cost(usage, prices, (1.0, 4.0)).select("trace_id", "prompt_tokens", "completion_tokens", rounded(F.col("cost")).alias("cost"))


def briefs(spark, sf_dir):
    """Every document as the brief of a document, and as that of a record whose description is its text."""
    t = F.coalesce("text", F.lit(""))
    record = T.record_brief(F.col("doc_id").cast("string"), {"department": F.col("source"), "symptoms": F.lit("")}, F.concat(F.lit("x\n\n【描述】"), t))
    return read(spark, sf_dir, "documents").select("doc_id", T.document_brief(F.col("source"), t).alias("document"), record.alias("record"))


def judge_of_lengths():
    """A stand-in for a model that judges questions: it keeps those of an even length."""

    def model(system, user, images):
        told = re.findall(r"### 第(\d+)题\n问题：(.*)\n对应记录：\n", user)
        return "Verdicts: " + json.dumps([{"index": int(j), "keep": len(q) % 2 == 0, "reason": f"{len(q)}"} for j, q in told])

    return model


def question_verdicts(spark, sf_dir):
    """Verdicts on a question made of every document, of which every third has one in the cache already."""
    docs = read(spark, sf_dir, "documents")
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), T.snippet(t, 60).alias("question"), T.document_brief(F.col("source"), t).alias("brief"))
    cache = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit(True).alias("keep"), F.lit("known").alias("reason"))
    return evalset.verdicts(rows, cache, judge_of_lengths).select(F.col("id").alias("doc_id"), "keep", "reason")


def reader_of_lengths():
    """A stand-in for a model that answers: it tells how long the prompt is, and cites its first source."""
    return lambda system, user, images: f"{len(user)} [1]"


def ask_items(spark, sf_dir):
    """Every benchmark item asked over its five best documents."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    source = chunks(spark, sf_dir).select("chunk_id", F.col("chunk_id").cast("string").alias("source_id"), F.lit("").alias("title"), "text")
    told = ask(items, lambda q: lexical(spark, sf_dir, 5), source, reader_of_lengths)
    return told.select("query_id", "answer", F.transform("sources", lambda s: s["source_id"])[0].alias("first_source"), F.size("sources").alias("n_sources"))


def labelled_compare(spark, sf_dir):
    """The last runs of two labels compared; their logged values are made of orders."""
    o = read(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("query_id"), "o_custkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("label")).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    value = F.pmod(F.col("o_custkey") * F.when(F.col("label") == "a", 3).otherwise(5) + F.col("query_id") * F.col("seq"), F.lit(11)).cast("double")
    values = runs.select("seq", "label", F.lit("items").alias("eval_set"), F.lit("hybrid_rerank").alias("stage"), "query_id", F.lit("recall@5").alias("metric"), value.alias("value"))
    return evaluation.compare_labels(values, "a", "b").withColumn("mean_a", six("mean_a")).withColumn("mean_b", six("mean_b"))


_WINDOWS = "list_filter(list_transform(range(0, greatest(0, ceil((length({t}) - 360) / 280.0)::INT) + 1), lambda i: trim(substr({t}, i * 280 + 1, 360), ' ' || chr(10) || chr(9))), lambda w: w <> '')"
_CLEAN = "trim(regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"


def _chunk_sql(body: str, pieces: str, text: str = "p[i]") -> str:
    return f"""WITH b AS (SELECT doc_id, source, {_CLEAN.format(t=body)} AS t FROM documents), c AS (SELECT doc_id, source, {pieces} AS p FROM b)
SELECT doc_id || '::chunk_' || lpad((i - 1)::VARCHAR, greatest(3, length((i - 1)::VARCHAR))::INT, '0') AS chunk_id, doc_id::VARCHAR AS source_id, (i - 1)::INT AS chunk_index, {text} AS text FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM c)"""


_TITLED = "source || chr(10) || chr(10) || text"
_BODY = "substr(t, length(source) + 3)"
_PARAGRAPHS = f"CASE WHEN length({_BODY}) > 360 THEN list_prepend(source, {_WINDOWS.format(t=_BODY)}) WHEN length(t) <= 360 THEN [t] ELSE [source, source || chr(10) || chr(10) || {_BODY}] END"
_SLUG = "regexp_replace(regexp_replace(replace(lower(source || '/' || text), '\\', '/'), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '_', 'g'), '^_+|_+$', '', 'g')"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _snippet(limit: int) -> str:
    return f"CASE WHEN length({_FLAT}) > {limit} THEN rtrim({_FLAT}[1:{limit - 3}]) || '...' ELSE {_FLAT} END"


QUERIES = {
    "chunk_fixed": chunked("fixed", False),
    "chunk_lateral": chunk_lateral,
    "segmented_items": segmented_items,
    "chunk_paragraph": chunked("paragraph", False),
    "chunk_title": chunked("fixed", True),
    "contextual_chunks": contextual_chunks,
    "parent_documents": parent_documents,
    "text_functions": text_functions,
    "query_rules": query_rules,
    "keyword_queries": keyword_queries,
    "history_block": history_block,
    "verbalize": verbalize,
    "json_fields": json_fields,
    "values_and_units": values_and_units,
    "context_blocks": context_blocks,
    "citation_metrics": citation_metrics,
    "crag_confusion": crag_confusion,
    "judge_means": judge_means,
    "token_cost": token_cost,
    "briefs": briefs,
    "question_verdicts": question_verdicts,
    "ask_items": ask_items,
    "labelled_compare": labelled_compare,
}
_FIXED = _chunk_sql(_TITLED, _WINDOWS.format(t="t"))
_TITLE = _chunk_sql("text", _WINDOWS.format(t="t"), "source || chr(10) || p[i]")
ORACLE_SQL = {
    "chunk_fixed": _FIXED,
    "chunk_lateral": _FIXED,
    "chunk_paragraph": _chunk_sql(_TITLED, _PARAGRAPHS),
    "chunk_title": _TITLE,
    "contextual_chunks": f"SELECT chunk_id, md5(CASE WHEN chunk_index < 3 THEN 'From ' || source || '.' || chr(10) || c.text ELSE c.text END) AS digest FROM ({_TITLE}) c JOIN documents d ON d.doc_id::VARCHAR = c.source_id",
    "briefs": """SELECT doc_id, '标题：' || source || chr(10) || '摘要：' || coalesce(text, '')[1:300] AS document, concat_ws(chr(10), '疾病名称：' || doc_id, '就诊科室：' || source,
  '描述节选：' || replace(trim(coalesce(text, '')[1:196], ' ' || chr(10) || chr(9)), chr(10), ' ')) AS record FROM documents""",
    "question_verdicts": f"""SELECT doc_id, doc_id % 3 = 0 OR n % 2 = 0 AS keep, CASE WHEN doc_id % 3 = 0 THEN 'known' ELSE n::VARCHAR END AS reason
FROM (SELECT doc_id, length({_snippet(60)}) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""",
    "ask_items": f"""WITH {BM25_SQL}, {lexical_sql(5)}, c AS (SELECT query_id, string_agg('[' || rank || '] ' || chunk_id || chr(10) || text[1:600], chr(10) || chr(10) ORDER BY rank) AS context,
  arg_min(chunk_id, rank)::VARCHAR AS first_source, count(*)::INT AS n_sources FROM lex JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT item_id AS query_id, length('问题：' || text || chr(10) || chr(10) || '【资料】' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || '请只依据以上资料（含图片）回答，并在关键结论后标注引用编号。') || ' [1]' AS answer,
  first_source, n_sources FROM benchmark LEFT JOIN c ON query_id = item_id""",
    "labelled_compare": f"""SELECT 'recall@5' AS metric, count(*) AS n, {r6('avg(x)')} AS mean_a, {r6('avg(y)')} AS mean_b, count(*) FILTER (WHERE x > y) AS wins, count(*) FILTER (WHERE x = y) AS ties,
  count(*) FILTER (WHERE x < y) AS losses FROM (SELECT (o_custkey * 3 + o_orderkey * 2) % 11 AS x, (o_custkey * 5 + o_orderkey * 2) % 11 AS y FROM orders)""",
    "text_functions": f"""SELECT doc_id, len(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS n_tokens, md5({_CLEAN.format(t='text')}) AS cleaned, {_snippet(80)} AS snippet,
  coalesce(nullif({_SLUG}, ''), 'doc')[1:120] AS slug, doc_id || ':' || md5(text)[1:12] AS key, len(list_filter(list_transform(regexp_split_to_array(text, '[,，、;；]+'), lambda x: trim(x)), lambda x: x <> '')) AS n_parts,
  len(list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)))) AS n_bigrams FROM documents""",
    "query_rules": """SELECT conv_id, turn, CASE WHEN len(e) > 0 THEN text || ' ' || array_to_string(e, ' ') ELSE text END AS text FROM (SELECT *, list_filter(
  list_concat(list_concat(CASE WHEN contains(text, 'the') THEN ['article', 'det'] ELSE [] END, CASE WHEN contains(text, 'is') THEN ['verb'] ELSE [] END),
  CASE WHEN contains(text, 'and') THEN CASE WHEN contains(text, 'the') THEN ['junction'] ELSE ['junction', 'det'] END ELSE [] END), lambda t: NOT contains(text, t)) AS e FROM conversations)""",
    "keyword_queries": "SELECT item_id, CASE WHEN k <> '' THEN k ELSE text END AS keywords FROM (SELECT item_id, text, trim(regexp_replace(replace(replace(replace(regexp_replace(text, '[，。？！、；：,.?!;:\\s]+', ' ', 'g'), 'that', ' '), 'and', ' '), 'the', ' '), '\\s+', ' ', 'g')) AS k FROM benchmark)",
    "history_block": "SELECT conv_id, '对话历史：' || chr(10) || string_agg(text, chr(10) ORDER BY turn, text) || chr(10) || chr(10) AS history FROM conversations GROUP BY conv_id",
    "verbalize": "SELECT p_partkey, concat_ws(chr(10) || chr(10), p_name, 'brand: ' || p_brand, 'type: ' || p_type, 'size: ' || p_size) AS content FROM part",
    "json_fields": "SELECT event_id, (props->>'k')::INT AS k, event_type AS type FROM events",
    "values_and_units": "SELECT p_partkey, p_size::VARCHAR AS value, 'mmol/L' AS unit, '1-' || p_size AS ref_range FROM part",
    "context_blocks": f"WITH {BM25_SQL}, {lexical_sql(5)} SELECT query_id, string_agg('[' || rank || '] ' || chunk_id || chr(10) || text[1:600], chr(10) || chr(10) ORDER BY rank) AS context, count(*)::INT AS n_sources FROM lex JOIN documents ON doc_id = chunk_id GROUP BY query_id",
    "citation_metrics": f"""WITH r AS (SELECT c_custkey AS n, [c_custkey % 5, c_custkey % 3 + 1] AS cited, c_custkey % 7 = 0 AS abstained, (c_custkey % 6) AS e FROM customer),
v AS (SELECT *, list_filter(cited, lambda x: x BETWEEN 1 AND 3) AS valid, list_transform([1, 2, 3], lambda i: (n + i) % 4) AS src FROM r),
s AS (SELECT *, list_distinct(list_transform(valid, lambda i: (n + i) % 4)) AS cs FROM v)
SELECT n AS query_id, 2 AS n_citations, {r6('len(valid) / 2.0')} AS citation_valid, CASE WHEN len(cs) > 0 THEN {r6('list_contains(cs, e)::INT / len(cs)::DOUBLE')} ELSE 0.0 END AS citation_precision,
  CASE WHEN list_contains(src, e) THEN list_contains(cs, e)::INT::DOUBLE END AS gold_cited, list_contains(src, e) AS retrieved_gold, abstained, abstained = (NOT list_contains(src, e)) AS abstain_correct FROM s""",
    "crag_confusion": f"""WITH e AS (SELECT user_id % 2 = 0 AS b, event_id % 5 = 0 AS f, (event_id * 7) % 100 / 100.0::DOUBLE AS t, CASE WHEN event_id % 3 > 0 THEN (event_id * 13) % 100 / 100.0::DOUBLE ELSE -1 END AS a FROM events),
d AS (SELECT *, CASE WHEN t >= 0.6 THEN 'proceed' WHEN t < 0.3 THEN CASE WHEN a >= 0.3 THEN 'refined' ELSE 'abstain' END WHEN a > t THEN 'refined' ELSE 'proceed' END AS d FROM e),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE b) AS retrieved_ok, count(*) FILTER (WHERE NOT b) AS should_abstain, count(*) FILTER (WHERE NOT b AND d = 'abstain') AS correct_abstain,
  count(*) FILTER (WHERE b AND d = 'abstain') AS false_abstain, count(*) FILTER (WHERE NOT b AND d = 'refined' AND f) AS recovered, count(*) FILTER (WHERE d = 'refined') AS refined_total FROM d)
SELECT *, {r6('correct_abstain / should_abstain')} AS abstain_recall, {r6('false_abstain / retrieved_ok')} AS false_abstain_rate FROM c""",
    "judge_means": f"SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 5 <> 0) AS n_parsed, {r6('avg(event_id % 6) FILTER (WHERE event_id % 5 <> 0)')} AS faithfulness, {r6('avg(event_id % 4) FILTER (WHERE event_id % 5 <> 0)')} AS relevance FROM events",
    "token_cost": """SELECT user_id AS trace_id, sum(event_id % 1000)::BIGINT AS prompt_tokens, sum(event_id % 300)::BIGINT AS completion_tokens,
  floor(sum((event_id % 1000) * (CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE length(event_type) END) + (event_id % 300) * (CASE WHEN event_type = 'click' THEN 4.0::DOUBLE ELSE 2.0 END)) / 1e6 * 1e9 + 0.5) / 1e9 AS cost FROM events GROUP BY user_id""",
}
