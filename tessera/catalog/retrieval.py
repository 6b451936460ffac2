"""Queries: lexical and dense search, fusion, reranking, evaluation. Documents are the corpus, benchmark items the
questions, and a document that holds an item verbatim is its gold."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import block_index, bm25, vector_index, vectors
from tessera.operators.evaluation import bootstrap, compare, leaderboard, long, mean_metrics, permutation_test, rank_metrics
from tessera.operators.ranking import best_of, fuse, rounded, stratified, top_k
from tessera.operators.rerank import rerank
from tessera.plans import retrieval as plans
from tessera.plans.config import DEFAULTS, with_settings
from tessera.storage import Workspace, share_code


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


#: Words of an item that a document is first looked up by.
GRAM = 4


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, source_id): the documents that hold a question verbatim.

    A document that does has the question's inner words in one run: the first GRAM of these (or all, if they are fewer) are
    joined as a key with the runs of the documents, and what meets is then held against the whole question.
    """
    asked = questions(spark, sf_dir).withColumn("words", F.split("question", " "))
    inner = asked.withColumn("inner", F.slice("words", 2, F.least(F.greatest(F.size("words") - 2, F.lit(0)), F.lit(GRAM)))).withColumn("n", F.size("inner"))
    work = Workspace(spark, "gold")
    keyed = work.save(inner.select("query_id", "question", "n", F.xxhash64("inner").alias("key")), "questions")
    lengths = keyed.agg(F.array_sort(F.collect_set("n")).alias("lengths"))  # of 0..GRAM
    words = F.split("text", " ")
    runs = F.flatten(F.transform("lengths", lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, n)))).otherwise(F.array(F.xxhash64(F.slice("words", 1, 0))))))
    docs = chunks(spark, sf_dir).crossJoin(F.broadcast(lengths)).withColumn("words", words)
    met = docs.select("chunk_id", F.explode(F.array_distinct(runs)).alias("key")).join(keyed.select("key", "query_id", "question"), "key").select("chunk_id", "query_id", "question")
    met = work.save(met, "met")  # few: then their texts alone are looked up, and not all texts moved
    held = met.join(chunks(spark, sf_dir), "chunk_id").where(F.contains("text", "question"))
    return work.save(held.select("query_id", F.col("chunk_id").alias("source_id")), "gold")


def index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.build(chunks(spark, sf_dir))


def lexical(spark: SparkSession, sf_dir: str, k: int = 10, of: bm25.Index | None = None) -> DataFrame:
    """The k best documents of each question, as a stored table."""
    return Workspace(spark, "lexical").save(bm25.search(of or index(spark, sf_dir), questions(spark, sf_dir), k), "hits")


def dense(spark: SparkSession, sf_dir: str, k: int = 12, metric: str = "cosine") -> DataFrame:
    """The vector channel of the fusion queries: the vector with an item's number asks for its neighbours."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.join(questions(spark, sf_dir).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.search(rows, asked, k, metric)


def six(name: str):
    return rounded(F.col(name), 6).alias(name)


def bm25_topk(spark, sf_dir):
    """The ten best documents of each benchmark item."""
    return lexical(spark, sf_dir).select("query_id", "chunk_id", "rank", six("raw"), six("score"))


def bm25_fallback_topk(spark, sf_dir):
    found = bm25.search(bm25.build(chunks(spark, sf_dir)), questions(spark, sf_dir), 10, fallback=True)
    return found.select("query_id", "chunk_id", "rank", six("raw"), six("score"))


def bm25_block_topk(spark, sf_dir):
    """The ten best documents of each benchmark item, by an index of blocks that skips what can't be among them."""
    found = block_index.search(block_index.build(index(spark, sf_dir)), questions(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", "rank", six("raw"), six("score"))


def metrics_of(spark, sf_dir, hits):
    return rank_metrics(hits.withColumn("source_id", F.col("chunk_id")), gold(spark, sf_dir))


def rank_metrics_query(spark, sf_dir):
    m = metrics_of(spark, sf_dir, lexical(spark, sf_dir))
    return m.select("query_id", "first_rank", *(rounded(F.col(f"`{c}`"), 6).alias(c.replace("@", "_")) for c in m.columns[2:]))


def bm25_eval(spark, sf_dir):
    """Mean metrics of the lexical channel."""
    return mean_metrics(long(metrics_of(spark, sf_dir, lexical(spark, sf_dir)), "bm25_only")).select("stage", "metric", six("mean"), "n")


def vector_topk(metric):
    def query(spark, sf_dir):
        rows = read(spark, sf_dir, "embeddings")
        asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
        return vectors.search(rows, asked, 10, metric).select("query_id", "chunk_id", "rank", six("score"))

    return query


def _asked(rows):
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


#: Cells of the registered index, and how many of them a query reads.
CELLS, PROBES = 32, 24


def ivf_topk(spark, sf_dir):
    """The ten nearest of every hundredth vector, in a stored index of 32 cells of which a query reads 24."""
    rows = read(spark, sf_dir, "embeddings")
    return vector_index.search(vector_index.store_by_cells(rows, CELLS), _asked(rows), 10, PROBES).select("query_id", "chunk_id", "rank", six("score"))


def ivf_all_cells(spark, sf_dir):
    """The same with all cells read, which is exact."""
    rows = read(spark, sf_dir, "embeddings")
    return vector_index.search(vector_index.store_by_cells(rows, CELLS), _asked(rows), 10, CELLS).select("query_id", "chunk_id", "rank", six("score"))


def filtered_topk(spark, sf_dir):
    """The ten nearest among the vectors with the query's own label, from a store by label."""
    rows = read(spark, sf_dir, "embeddings")
    return vector_index.search(vector_index.store_by(rows, "label"), _asked(rows), 10, list_col="label").select("query_id", "chunk_id", "rank", six("score"))


def semantic_cache_lookup(spark, sf_dir):
    """Every hundredth vector asks a cache of all others."""
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.cache_lookup(rows.where("vec_id % 100 <> 0"), asked, 0.9).select("query_id", "chunk_id", six("score"), "hit")


def hash_embed(spark, sf_dir):
    """Hashed character n-grams of every document."""
    return vectors.hash_features(read(spark, sf_dir, "documents"), "doc_id", "text").select("id", "bucket", six("value"))


def rrf_fusion(spark, sf_dir):
    both = fuse([("vector", dense(spark, sf_dir), 0.7), ("bm25", lexical(spark, sf_dir, 12), 0.3)])
    return both.select("query_id", "chunk_id", rounded(F.col("score")).alias("score"), "vector_rank", "bm25_rank", six("vector_score"), six("bm25_score"))


def vector_only_best(spark, sf_dir):
    """Each row's best score over two dense lists."""
    return best_of([dense(spark, sf_dir), dense(spark, sf_dir, 6, "ip")]).select("query_id", "chunk_id", six("score"))


def candidates(spark, sf_dir):
    hits = lexical(spark, sf_dir, 12).select("query_id", "chunk_id", F.col("raw").alias("score"))
    return hits.join(chunks(spark, sf_dir), "chunk_id").join(questions(spark, sf_dir), "query_id")


def reranked(mode):
    def query(spark, sf_dir):
        return rerank(candidates(spark, sf_dir), mode, 0.45, 5).select("query_id", "chunk_id", "rank", six("score"), six("base_score"), six("rerank_score"))

    return query


def hybrid(spark, sf_dir, settings=("rerank.mode=overlap",), channels=None):
    config = with_settings(DEFAULTS, list(settings))
    k = config["retrieval"]["candidate_k"]
    by_words, by_vectors = channels or (lexical(spark, sf_dir, k), dense(spark, sf_dir, k))
    return plans.retrieve(questions(spark, sf_dir), chunks(spark, sf_dir), [by_words], [by_vectors], config)


def hybrid_pipeline(spark, sf_dir):
    """Both channels, fused, cut, and reranked by word overlap."""
    return hybrid(spark, sf_dir).select("query_id", "chunk_id", "rank", six("score"))


def stages(spark, sf_dir):
    """The hits of four stages, over the same two channels."""
    by_words, by_vectors = lexical(spark, sf_dir, 12), Workspace(spark, "dense").save(dense(spark, sf_dir), "hits")
    return {
        "bm25_only": by_words,
        "vector_only": by_vectors,
        "hybrid": hybrid(spark, sf_dir, ("rerank.mode=none",), (by_words, by_vectors)),
        "hybrid_rerank": hybrid(spark, sf_dir, channels=(by_words, by_vectors)),
    }


def stage_comparison(spark, sf_dir):
    """Mean metrics of four stages."""
    return plans.evaluate_stages(stages(spark, sf_dir), gold(spark, sf_dir)).select("stage", "metric", six("mean"), "n")


def _two_runs(spark, sf_dir):
    """The values (query_id, metric, value) of two lexical runs over one index."""
    shared, right = index(spark, sf_dir), gold(spark, sf_dir)
    work = Workspace(spark, "runs")

    def values(fallback):
        hits = bm25.search(shared, questions(spark, sf_dir), 10, fallback=fallback).withColumn("source_id", F.col("chunk_id"))
        return work.save(long(rank_metrics(hits, right), "run").select("query_id", "metric", "value"), "values")

    return values(False), values(True)


def run_compare(spark, sf_dir):
    """Two lexical runs on their common queries: wins, ties and losses by metric."""
    return compare(*_two_runs(spark, sf_dir)).select("metric", "n", six("mean_a"), six("mean_b"), "wins", "ties", "losses")


def run_permutation(spark, sf_dir):
    """Seeded sign-flip test of the same two runs."""
    return permutation_test(*_two_runs(spark, sf_dir))


def bootstrap_ci(spark, sf_dir):
    values = long(metrics_of(spark, sf_dir, lexical(spark, sf_dir)), "bm25_only")
    return bootstrap(values)


def leaderboard_query(spark, sf_dir):
    """Runs made of events (one run a user, its type the label, its id the order), best mean first."""
    e = read(spark, sf_dir, "events")
    runs = e.select(F.col("event_type").alias("label"), (F.col("user_id") % 5).cast("string").alias("eval_set"), F.col("event_id").alias("seq"), F.lit("hybrid_rerank").alias("stage"), F.lit("recall@5").alias("metric"), F.col("value").alias("mean"))
    return leaderboard(runs).select("eval_set", "place", "label", "seq", six("mean"))


def stratified_sample(spark, sf_dir):
    """A hundred documents, each source with its share, at least one; the styles are dealt in turn."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return stratified(docs, "source", 100).select("id", "source")


TOKEN_SQL = r"[\x{4e00}-\x{9fff}]|[a-zA-Z0-9_./:+-]+"
BM25_SQL = f"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN_SQL}')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id, count(t) AS dl FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf0 AS (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
idf AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
q AS (SELECT query_id, t, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS t FROM benchmark) GROUP BY ALL),
okapi AS (SELECT query_id, doc_id AS chunk_id, sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM q JOIN tf USING (t) JOIN idf USING (t) JOIN dl USING (doc_id), st GROUP BY ALL),
plain AS (SELECT query_id, doc_id AS chunk_id, sum((1 + ln(1 + tf)) * qtf) AS s FROM q JOIN tf USING (t) GROUP BY ALL)"""


def lexical_sql(k: int, name: str = "lex", scores: str = "okapi") -> str:
    return f"""{name}0 AS (SELECT query_id, chunk_id, s AS raw, row_number() OVER (PARTITION BY query_id ORDER BY floor(s * 1e9 + 0.5) / 1e9 DESC, chunk_id) AS rank FROM {scores} WHERE s > 0 QUALIFY rank <= {k}),
{name} AS (SELECT *, CASE WHEN max(raw) OVER w - min(raw) OVER w < 1e-9 THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS score FROM {name}0 WINDOW w AS (PARTITION BY query_id))"""


def r6(x: str) -> str:
    return f"floor({x} * 1e6 + 0.5) / 1e6"


def dense_sql(k: int, name: str, metric: str = "cosine", asked: str = "vec_id IN (SELECT item_id FROM benchmark)", rows: str = "true") -> str:
    of = {"cosine": "list_cosine_similarity(a.e, b.e)", "ip": "list_inner_product(a.e, b.e)", "l2": "-pow(list_distance(a.e, b.e), 2)"}[metric]
    return f"""{name}v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
{name} AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {of} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY floor({of} * 1e9 + 0.5) / 1e9 DESC, b.vec_id) AS rank
  FROM (SELECT * FROM {name}v WHERE {asked}) a, (SELECT * FROM {name}v WHERE {rows}) b QUALIFY rank <= {k})"""


GOLD_SQL = "gold AS (SELECT item_id AS query_id, doc_id AS source_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def metrics_sql(hits: str, name: str = "m") -> str:
    columns = ["query_id", "min(rank) AS first_rank", "coalesce(1.0 / min(rank), 0.0) AS mrr"]
    for k in (1, 3, 5, 10):
        columns += [
            f"(count(*) FILTER (WHERE rank <= {k}) > 0)::DOUBLE AS hit_{k}", f"count(DISTINCT source_id) FILTER (WHERE rank <= {k}) / any_value(n) AS recall_{k}",
            f"coalesce(sum(1.0 / log2(rank + 1)) FILTER (WHERE rank <= {k}), 0.0) / list_sum(list_transform(range(1, least(any_value(n), {k}) + 1), lambda i: 1.0 / log2(i + 1))) AS ndcg_{k}",
        ]
    return f"""{name} AS (SELECT {', '.join(columns)} FROM (SELECT g.query_id, n, rank, source_id FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) g
  LEFT JOIN (SELECT h.query_id, h.rank, h.chunk_id AS source_id FROM {hits} h JOIN gold ON gold.query_id = h.query_id AND gold.source_id = h.chunk_id) USING (query_id)) GROUP BY query_id)"""


METRICS = ["mrr"] + [f"{m}_{k}" for k in (1, 3, 5, 10) for m in ("hit", "recall", "ndcg")]


def means_sql(stage: str, name: str = "m") -> str:
    return " UNION ALL ".join(f"SELECT '{stage}' AS stage, '{m.replace('_', '@')}' AS metric, {r6(f'avg({m})')} AS mean, count(*) AS n FROM {name}" for m in METRICS)


HYBRID_SQL = f"""{BM25_SQL}, {lexical_sql(12)}, {dense_sql(12, 'den')},
fused AS (SELECT query_id, chunk_id, sum(w / (60.0 + rank)) AS score, max(rank) FILTER (WHERE w = 0.7) AS vector_rank, max(rank) FILTER (WHERE w = 0.3) AS bm25_rank,
    max(s) FILTER (WHERE w = 0.7) AS vector_score, max(s) FILTER (WHERE w = 0.3) AS bm25_score
  FROM (SELECT query_id, chunk_id, rank, score AS s, 0.7::DOUBLE AS w FROM den UNION ALL SELECT query_id, chunk_id, rank, score, 0.3::DOUBLE FROM lex) GROUP BY query_id, chunk_id),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS rank FROM fused QUALIFY rank <= 12)"""


def rerank_sql(source: str, raw: str, name: str) -> str:
    """Min-max of both scores within a query, mixed, the five best."""
    mm = lambda x: f"CASE WHEN max({x}) OVER w - min({x}) OVER w < 1e-9 THEN 1.0 ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"
    return f"""{name}1 AS (SELECT query_id, chunk_id, {mm('score')} AS base_score, {raw if raw == 'rerank_score' else mm(raw)} AS rerank_score FROM {source} WINDOW w AS (PARTITION BY query_id)),
{name} AS (SELECT *, 0.55 * base_score + 0.45 * rerank_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY floor((0.55 * base_score + 0.45 * rerank_score) * 1e9 + 0.5) / 1e9 DESC, chunk_id) AS rank FROM {name}1 QUALIFY rank <= 5)"""


def overlap_sql(source: str, name: str) -> str:
    t = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '{TOKEN_SQL}'))"
    return f"{name} AS (SELECT s.query_id, s.chunk_id, s.score, len(list_intersect({t('b.text')}, {t('d.text')})) / len({t('b.text')}) AS raw FROM {source} s JOIN documents d ON d.doc_id = s.chunk_id JOIN benchmark b ON b.item_id = s.query_id)"


CAND_SQL = f"{BM25_SQL}, {lexical_sql(12)}, cand AS (SELECT query_id, chunk_id, raw AS score FROM lex)"
INNER_SQL = f"""ct AS (SELECT query_id, chunk_id, t, tf FROM cand JOIN tf ON tf.doc_id = cand.chunk_id),
cl AS (SELECT query_id, chunk_id, dl FROM cand JOIN dl ON dl.doc_id = cand.chunk_id), cs AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM cl GROUP BY 1),
cidf0 AS (SELECT query_id, t, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM ct JOIN cs USING (query_id) GROUP BY ALL),
cidf AS (SELECT query_id, t, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY query_id) ELSE idf END AS idf FROM cidf0),
inn AS (SELECT query_id, chunk_id, sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM q JOIN ct USING (query_id, t) JOIN cidf USING (query_id, t) JOIN cl USING (query_id, chunk_id) JOIN cs USING (query_id) GROUP BY ALL HAVING raw > 0),
innn AS (SELECT query_id, chunk_id, CASE WHEN max(raw) OVER w - min(raw) OVER w < 1e-9 THEN 1.0 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS rs FROM inn WINDOW w AS (PARTITION BY query_id)),
both_ AS (SELECT c.query_id, c.chunk_id, c.score, coalesce(rs, 0.0) AS rerank_score FROM cand c LEFT JOIN innn USING (query_id, chunk_id))"""

QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_block_topk": bm25_block_topk,
    "bm25_fallback_topk": bm25_fallback_topk,
    "bm25_eval": bm25_eval,
    "rank_metrics": rank_metrics_query,
    "vector_topk_cosine": vector_topk("cosine"),
    "vector_topk_l2": vector_topk("l2"),
    "vector_topk_ip": vector_topk("ip"),
    "ivf_topk": ivf_topk,
    "ivf_all_cells": ivf_all_cells,
    "filtered_topk": filtered_topk,
    "semantic_cache_lookup": semantic_cache_lookup,
    "hash_embed": hash_embed,
    "rrf_fusion": rrf_fusion,
    "vector_only_best": vector_only_best,
    "rerank_none": reranked("none"),
    "rerank_bm25": reranked("bm25"),
    "rerank_overlap": reranked("overlap"),
    "hybrid_pipeline": hybrid_pipeline,
    "stage_comparison": stage_comparison,
    "run_compare": run_compare,
    "run_permutation": run_permutation,
    "bootstrap_ci": bootstrap_ci,
    "leaderboard": leaderboard_query,
    "stratified_sample": stratified_sample,
}

_TOPK = "SELECT query_id, chunk_id, rank, " + r6("raw") + " AS raw, " + r6("score") + " AS score FROM lex"
_RERANKED = f"SELECT query_id, chunk_id, rank, {r6('score')} AS score, {r6('base_score')} AS base_score, {r6('rerank_score')} AS rerank_score FROM"
_M6 = ", ".join(f"{r6(m)} AS {m}" for m in METRICS)
_QUERY_VECTORS = "vec_id % 100 = 0"


def _vector_sql(metric: str) -> str:
    return f"WITH {dense_sql(10, 'den', metric, _QUERY_VECTORS)} SELECT query_id, chunk_id, rank, {r6('score')} AS score FROM den"


_COMPARE = " UNION ALL ".join(f"SELECT '{m.replace('_', '@')}' AS metric, count(*) AS n, {r6(f'avg(a.{m})')} AS mean_a, {r6(f'avg(b.{m})')} AS mean_b, count(*) FILTER (WHERE a.{m} > b.{m}) AS wins, count(*) FILTER (WHERE a.{m} = b.{m}) AS ties, count(*) FILTER (WHERE a.{m} < b.{m}) AS losses FROM ma a JOIN mb b USING (query_id)" for m in METRICS)
ORACLE_SQL = {
    "bm25_topk": f"WITH {BM25_SQL}, {lexical_sql(10)} {_TOPK}",
    "bm25_block_topk": f"WITH {BM25_SQL}, {lexical_sql(10)} {_TOPK}",
    "bm25_fallback_topk": f"WITH {BM25_SQL}, {lexical_sql(10, scores='plain')} {_TOPK}",
    "bm25_eval": f"WITH {BM25_SQL}, {lexical_sql(10)}, {GOLD_SQL}, {metrics_sql('lex')} {means_sql('bm25_only')}",
    "rank_metrics": f"WITH {BM25_SQL}, {lexical_sql(10)}, {GOLD_SQL}, {metrics_sql('lex')} SELECT query_id, first_rank, {_M6} FROM m",
    "vector_topk_cosine": _vector_sql("cosine"),
    "vector_topk_l2": _vector_sql("l2"),
    "vector_topk_ip": _vector_sql("ip"),
    "ivf_all_cells": _vector_sql("cosine"),
    "filtered_topk": f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b USING (label) WHERE a.vec_id % 100 = 0)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, chunk_id) AS rank, {r6('score')} AS score FROM s QUALIFY rank <= 10""",
    "semantic_cache_lookup": f"WITH {dense_sql(1, 'den', 'cosine', _QUERY_VECTORS, 'vec_id % 100 <> 0')} SELECT query_id, chunk_id, {r6('score')} AS score, score >= 0.9 AS hit FROM den",
    "hash_embed": f"""WITH w AS (SELECT doc_id AS id, ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM documents),
g AS (SELECT id, unnest(list_concat(CASE WHEN true THEN list_transform(range(1, greatest(length(w) - 1, 1) + 1), lambda i: substr(w, i, 2)) END,
  CASE WHEN length(w) >= 3 THEN list_transform(range(1, greatest(length(w) - 2, 1) + 1), lambda i: substr(w, i, 3)) ELSE [] END,
  CASE WHEN length(w) >= 4 THEN list_transform(range(1, greatest(length(w) - 3, 1) + 1), lambda i: substr(w, i, 4)) ELSE [] END)) AS g FROM w),
c AS (SELECT id, (('0x' || md5(g)[1:8])::BIGINT % 768)::INT AS bucket, count(*) AS n FROM g GROUP BY ALL)
SELECT id, bucket, {r6('n / sqrt(sum(n * n) OVER (PARTITION BY id))')} AS value FROM c""",
    "rrf_fusion": f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, floor(score * 1e9 + 0.5) / 1e9 AS score, vector_rank, bm25_rank, {r6('vector_score')} AS vector_score, {r6('bm25_score')} AS bm25_score FROM fused",
    "vector_only_best": f"WITH {dense_sql(12, 'da')}, {dense_sql(6, 'db', 'ip')} SELECT query_id, chunk_id, {r6('max(score)')} AS score FROM (SELECT query_id, chunk_id, score FROM da UNION ALL SELECT query_id, chunk_id, score FROM db) GROUP BY ALL",
    "rerank_none": f"WITH {CAND_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, chunk_id) AS rank FROM cand QUALIFY rank <= 5) SELECT query_id, chunk_id, rank, {r6('score')} AS score, {r6('score')} AS base_score, NULL::DOUBLE AS rerank_score FROM rk",
    "rerank_bm25": f"WITH {CAND_SQL}, {INNER_SQL}, {rerank_sql('both_', 'rerank_score', 'rk')} {_RERANKED} rk",
    "rerank_overlap": f"WITH {CAND_SQL}, {overlap_sql('cand', 'ov')}, {rerank_sql('ov', 'raw', 'rk')} {_RERANKED} rk",
    "hybrid_pipeline": f"WITH {HYBRID_SQL}, {overlap_sql('cut', 'ov')}, {rerank_sql('ov', 'raw', 'rk')} SELECT query_id, chunk_id, rank, {r6('score')} AS score FROM rk",
    "stage_comparison": f"WITH {HYBRID_SQL}, {overlap_sql('cut', 'ov')}, {rerank_sql('ov', 'raw', 'rk')}, cut5 AS (SELECT * FROM cut WHERE rank <= 5), {GOLD_SQL}, {metrics_sql('lex', 'm1')}, {metrics_sql('den', 'm2')}, {metrics_sql('cut5', 'm3')}, {metrics_sql('rk', 'm4')} "
    + " UNION ALL ".join(means_sql(s, f"m{i}") for i, s in enumerate(("bm25_only", "vector_only", "hybrid", "hybrid_rerank"), 1)),
    "run_compare": f"WITH {BM25_SQL}, {lexical_sql(10, 'la')}, {lexical_sql(10, 'lb', 'plain')}, {GOLD_SQL}, {metrics_sql('la', 'ma')}, {metrics_sql('lb', 'mb')} {_COMPARE}",
    "leaderboard": f"""WITH r AS (SELECT event_type AS label, (user_id % 5)::VARCHAR AS eval_set, event_id AS seq, value AS mean FROM events), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY label, eval_set ORDER BY seq DESC) = 1)
SELECT eval_set, row_number() OVER (PARTITION BY eval_set ORDER BY mean DESC, label) AS place, label, seq, {r6('mean')} AS mean FROM l""",
    "stratified_sample": """WITH c AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY source), q AS (SELECT source, greatest(1, round_even(100.0 * n / total, 0))::INT AS quota FROM c),
r AS (SELECT doc_id AS id, source, md5('0:' || doc_id) AS o, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS nth FROM documents)
SELECT id, source FROM r JOIN q USING (source) WHERE nth <= quota ORDER BY o, id LIMIT 100""",
}
