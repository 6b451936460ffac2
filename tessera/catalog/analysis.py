"""Queries: percentiles, exact tests, the graph operators, event windows, sources. Triples are made of orders: a customer
ordered by priority and status, in the paper of its nation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.catalog.retrieval import dense_sql, r6, read, six
from tessera.operators import communities as partition
from tessera.operators import evalset, evaluation, graph, models, tables
from tessera.operators.components import connected_components
from tessera.sources import files
from tessera.sources.pages import read_pages
from tessera.storage import Workspace
from tessera.streaming import events as windows
from tessera.streaming import stateful


def triples(spark, sf_dir):
    """(source_id, head, relation, tail) with three kinds of edges and spellings that differ in case and hyphens."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment")))
    of_customer = c.select(F.concat(F.lit("n"), "c_nationkey", F.lit("_p"), F.col("c_custkey")).alias("source_id"), name.alias("head"), F.lit("in").alias("relation"), F.concat(F.lit("N-"), "c_nationkey").alias("tail"))
    of_nation = n.select(F.concat(F.lit("n"), "n_nationkey", F.lit("_p0")).alias("source_id"), F.concat(F.lit("n "), "n_nationkey").alias("head"), F.lit("part of").alias("relation"), F.concat(F.lit("R-"), "n_regionkey").alias("tail"))
    of_region = r.select(F.lit("world").alias("source_id"), F.concat(F.lit("R-"), "r_regionkey").alias("head"), F.lit("named").alias("relation"), F.col("r_name").alias("tail"))
    return of_customer.unionByName(of_nation).unionByName(of_region)


def the_graph(spark, sf_dir):
    t = triples(spark, sf_dir)
    return graph.build_graph(t, graph.canonical_names(t))


def entity_canonical(spark, sf_dir):
    return graph.canonical_names(triples(spark, sf_dir))


def graph_nodes(spark, sf_dir):
    nodes, _ = the_graph(spark, sf_dir)
    return nodes.select("name", F.array_join("papers", ",").alias("papers"))


def degree_topk(spark, sf_dir):
    """The ten entities with most edges."""
    return graph.degrees(the_graph(spark, sf_dir)[1]).orderBy(F.col("degree").desc(), "name").limit(10)


def bridge_entities(spark, sf_dir):
    return graph.bridges(the_graph(spark, sf_dir)[1])


def hub_neighbours(spark, sf_dir):
    """The relations of the entity with most edges."""
    return graph.hub_neighbours(the_graph(spark, sf_dir)[1])


def entity_linking(spark, sf_dir):
    """Nodes named in questions about every nation."""
    nodes, _ = the_graph(spark, sf_dir)
    asked = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Which parts of N-"), "n_nationkey", F.lit(" are in R-"), "n_regionkey", F.lit("?")).alias("question"))
    return graph.link_entities(asked, nodes).select("query_id", "name", "place")


def khop_facts(spark, sf_dir):
    """Facts within two steps of each region."""
    _, edges = the_graph(spark, sf_dir)
    start = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("R-"), "r_regionkey").alias("name"))
    return graph.gather_facts(edges, start, 2)


def order_edges(spark, sf_dir):
    """Orders and suppliers as nodes of two kinds, linked by line items."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


def components(spark, sf_dir):
    return connected_components(order_edges(spark, sf_dir))


def communities(spark, sf_dir):
    """Communities of the graph of triples."""
    return partition.communities(the_graph(spark, sf_dir)[1])


def community_facts(spark, sf_dir):
    """The facts within each of these communities."""
    _, edges = the_graph(spark, sf_dir)
    members = Workspace(spark, "members").save(partition.communities(edges), "members")
    return graph.community_facts(edges, members)


def _by_nation(spark, sf_dir):
    """Names of the graph of triples by their nation, the partition that its edges come from."""
    t = triples(spark, sf_dir)
    names = graph.canonical_names(t)
    _, edges = graph.build_graph(t, names)
    return edges, edges.select(F.explode(F.array("head", "tail")).alias("name"), "paper").groupBy("name").agg(F.min("paper").alias("community"))


def partition_modularity(spark, sf_dir):
    """Modularity of the partition by first paper."""
    return partition.modularity(*_by_nation(spark, sf_dir)).select("n_edges", "n_inside", "n_communities", six("modularity"))


def partition_facts(spark, sf_dir):
    """The facts within each part of the same partition."""
    return graph.community_facts(*_by_nation(spark, sf_dir))


def similar_names(spark, sf_dir):
    """Every vector's group at a cosine of 0.9 or more."""
    rows = read(spark, sf_dir, "embeddings").select(F.format_string("v%05d", "vec_id").alias("name"), "embedding")
    return graph.merge_similar(rows, 0.9)


def percentile_rank(spark, sf_dir):
    """Nearest-rank percentiles of event values by type."""
    e = read(spark, sf_dir, "events")
    p50, p90 = (evaluation.nearest_rank_percentile(e, ("event_type",), "value", p) for p in (50, 90))
    return p50.join(p90, "event_type").select("event_type", six("p50"), six("p90"))


def recent_percentile(spark, sf_dir):
    """Of the last thousand events of each type."""
    e = read(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return evaluation.recent_percentile(e, ("event_type",), "value", "at", 95).select("event_type", six("p95"))


def event_stream(spark, sf_dir):
    path = f"{sf_dir}/events.parque[t]"  # a pattern, as a stream takes a plain path for a folder
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(path)


def stream_recent_percentile(spark, sf_dir):
    """Of the last thousand events of each type, held as the state of a stream."""
    work = Workspace(spark, "stream-percentile")
    running = stateful.running_percentile(event_stream(spark, sf_dir), "event_type", "value", "ts", "event_id", 95, 1000)
    batches = stateful.run_to_table(running, work.new_path("batches"), work.new_path("checkpoint"), "update")
    return batches.groupBy("key").agg(F.max_by("value", "batch").alias("value")).select(F.col("key").alias("event_type"), six("value").alias("p95"))


def stream_trace_totals(spark, sf_dir):
    """Sums by user, day and type of event, of the days that are over for a user: an hour without an event, behind the watermark."""
    work = Workspace(spark, "stream-traces")
    traced = event_stream(spark, sf_dir).withColumn("trace", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")))
    totals = stateful.trace_totals(traced, "trace", "event_type", "value", "ts", 3_600_000, "10 minutes")
    done = stateful.run_to_table(totals, work.new_path("batches"), work.new_path("checkpoint"))
    return done.where("not late").select("trace_id", F.col("name").alias("event_type"), "n", six("ms").alias("value"))


def _line_pages():
    """A parser of files with a page a line."""

    def parse(file, raw):
        for line in raw.decode("utf-8").splitlines():
            page = json.loads(line)
            yield page["page_id"], "text", page.get("html"), 0

    return parse


def parsed_pages(spark, sf_dir):
    """Every page, read back from files that hold up to 500 of them, through a parser."""
    path = Workspace(spark, "page-files").new_path("files")
    read(spark, sf_dir, "pages").select(F.to_json(F.struct("page_id", "html"))).write.option("maxRecordsPerFile", 500).text(path)
    got = read_pages(spark, path, _line_pages, "*.txt")
    return got.select(F.col("page").alias("page_id"), F.length("content").cast("long").alias("n_chars"), "error")


def exact_permutation(spark, sf_dir):
    """All sign flips of the discount differences within each order."""
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.round(F.col("l_discount") * 100).cast("int") - F.round(F.col("l_tax") * 100).cast("int")).cast("double").alias("diff"))
    return evaluation.exact_permutation(d, ("l_orderkey",)).select("l_orderkey", "n", six("mean_diff"), six("p_value"))


def events_tumbling(spark, sf_dir):
    return windows.tumbling(read(spark, sf_dir, "events")).select("window_start", "event_type", "n", six("value"))


def events_sliding(spark, sf_dir):
    return windows.sliding(read(spark, sf_dir, "events")).select("window_start", "event_type", "n", six("value"))


def events_session(spark, sf_dir):
    return windows.sessions(read(spark, sf_dir, "events"))


def corpus_inspection(spark, sf_dir):
    """Rows and characters of two sources in one corpus."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("content"))
    return files.inspect(files.corpus(("documents", docs), ("benchmark", items)))


def figure_budget(spark, sf_dir):
    """Parts as files, suppliers' line items as pages with images: three pages a file, a hundred in all."""
    pages = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("file"), (F.col("l_suppkey") % 40).alias("page")).agg(F.count("*").alias("n_images"))
    return files.figure_pages(pages, 3, 100).select("file", "page", "n_images")


def fill_down(spark, sf_dir):
    """Event types that only every fifth event has, filled down within a user."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise("").alias("category"))
    return tables.fill_down(e, "user_id", "event_id", "category")


def latest_runs(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("user_id").alias("eval_set"), F.col("event_id").alias("seq"), "value")
    return files.latest_runs(e).select("label", "eval_set", "seq", six("value"))


def styled_sample(spark, sf_dir):
    """A hundred documents by source, with styles dealt in turn."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return evalset.styled_sample(docs, "source", 100).select("id", "source", "style")


def keyword_sample(spark, sf_dir):
    """Twenty documents for each of three keywords in the source's name."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_id"))
    return evalset.keyword_sample(docs, ["SRC11", "src1", "src2"], 20).select("chunk_id", "source_id", "keyword", "nth")


def question_check(spark, sf_dir):
    """The first clause of each document and benchmark item as a question, checked for length, names and likeness."""
    texts = read(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("id"), "text").unionByName(read(spark, sf_dir, "benchmark").select((F.col("item_id") * 2 + 1).alias("id"), "text"))
    style = F.element_at(F.array(*(F.lit(s) for s in evalset.STYLES)), (F.col("id") % 4 + 1).cast("int"))
    return evalset.checked(texts.select("id", F.substring_index("text", ".", 1).alias("question"), style.alias("style"), F.lit("the").alias("name")))


def _figures(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    turned = rows.select("vec_id", F.reverse("embedding").alias("embedding"))
    asked = lambda df: df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return models.figure_search(rows, turned, asked(rows), asked(turned), 5)


def figure_fusion(spark, sf_dir):
    """Vectors as captions and their reverses as images, fused with weight one."""
    return _figures(spark, sf_dir)["fused"].select("query_id", "chunk_id", F.floor(F.col("score") * 1e9 + 0.5).alias("score"), "caption_rank", "image_rank")


def figure_hits(spark, sf_dir):
    """Whether one of the first five captions has the query's label."""
    rows = read(spark, sf_dir, "embeddings")
    names = rows.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("fig_"), "label", F.lit("_")).alias("name"))
    wanted = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("_"), "label", F.lit("_")).alias("part"))
    return models.name_hits(_figures(spark, sf_dir)["caption"].where(F.col("chunk_id") != F.col("query_id")), names, wanted)


def trace_summary(spark, sf_dir):
    """Events as spans of users' traces."""
    e = read(spark, sf_dir, "events").withColumn("trace_id", F.col("user_id"))
    spans = e.select("trace_id", F.col("event_type").alias("name"), (F.col("event_id") % 97).alias("ms"))
    usage = e.select("trace_id", F.col("event_type").alias("model"), (F.col("event_id") % 10).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"))
    t = models.trace_summary(spans, usage)
    return t.select("trace_id", "total_ms", F.size("stages").alias("n_stages"), F.coalesce(F.try_element_at("usage", F.lit("click"))["prompt"], F.lit(0)).alias("click_prompt"))


QUERIES = {
    "styled_sample": styled_sample,
    "keyword_sample": keyword_sample,
    "question_check": question_check,
    "figure_fusion": figure_fusion,
    "figure_hits": figure_hits,
    "trace_summary": trace_summary,
    "entity_canonical": entity_canonical,
    "graph_nodes": graph_nodes,
    "degree_topk": degree_topk,
    "bridge_entities": bridge_entities,
    "hub_neighbours": hub_neighbours,
    "entity_linking": entity_linking,
    "khop_facts": khop_facts,
    "connected_components": components,
    "community": communities,
    "community_facts": community_facts,
    "partition_modularity": partition_modularity,
    "partition_facts": partition_facts,
    "similar_names": similar_names,
    "percentile_rank": percentile_rank,
    "recent_percentile": recent_percentile,
    "stream_recent_percentile": stream_recent_percentile,
    "stream_trace_totals": stream_trace_totals,
    "parsed_pages": parsed_pages,
    "exact_permutation": exact_permutation,
    "events_tumbling": events_tumbling,
    "events_sliding": events_sliding,
    "events_session": events_session,
    "corpus_inspection": corpus_inspection,
    "figure_budget": figure_budget,
    "fill_down": fill_down,
    "latest_runs": latest_runs,
}

_TRIPLES = """t AS (SELECT 'n' || c_nationkey || '_p' || c_custkey AS source_id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE ' ' || lower(c_mktsegment) END AS head, 'in' AS relation, 'N-' || c_nationkey AS tail FROM customer
  UNION ALL SELECT 'n' || n_nationkey || '_p0', 'n ' || n_nationkey, 'part of', 'R-' || n_regionkey FROM nation UNION ALL SELECT 'world', 'R-' || r_regionkey, 'named', r_name FROM region),
ends AS (SELECT head AS surface, source_id, head AS h, tail AS tl, 0 AS e FROM t UNION ALL SELECT tail, source_id, head, tail, 1 FROM t),
cnt AS (SELECT surface, count(*) AS n, min({'s': source_id, 'h': h, 't': tl, 'e': e}) AS f, regexp_replace(lower(trim(surface)), '[\\s\\-_:：,.()（）]+', '', 'g') AS key FROM ends GROUP BY surface),
best AS (SELECT key, surface AS canonical FROM cnt QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, f) = 1),
names AS (SELECT surface, canonical FROM cnt JOIN best USING (key))"""
_GRAPH = _TRIPLES + """,
edges AS (SELECT a.canonical AS head, relation, b.canonical AS tail, regexp_replace(source_id, '_p\\d+.*$', '') AS paper FROM t JOIN names a ON a.surface = t.head JOIN names b ON b.surface = t.tail),
node AS (SELECT head AS name, paper FROM edges UNION ALL SELECT tail, paper FROM edges)"""
_PARTITION = "part AS (SELECT name, min(paper) AS community FROM node GROUP BY name)"
_QUESTION_SQL = """WITH RECURSIVE g AS MATERIALIZED (SELECT doc_id * 2 AS id, text FROM documents UNION ALL SELECT item_id * 2 + 1, text FROM benchmark),
q AS MATERIALIZED (SELECT id, question, style, 'the' AS name, CASE WHEN length(question) NOT BETWEEN 10 AND 60 THEN 'length' WHEN style IN ('symptom_led', 'colloquial') AND contains(question, 'the') THEN 'name' END AS reason,
    regexp_replace(question, '[^\\p{L}\\p{N}_]+', '', 'g') AS k
  FROM (SELECT id, string_split(text, '.')[1] AS question, ['name_led', 'symptom_led', 'colloquial', 'exam_treat'][(id % 4 + 1)::INT] AS style FROM g)),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS j, id, list_distinct(list_transform(range(1, length(k)), lambda x: substr(k, x, 2))) AS s FROM q WHERE reason IS NULL AND length(k) >= 2),
near AS (SELECT b.j, list(a.j) AS near FROM p a JOIN p b ON a.j < b.j AND 10 * len(list_intersect(a.s, b.s)) > 8 * least(len(a.s), len(b.s)) GROUP BY b.j),
n AS MATERIALIZED (SELECT p.j, coalesce(near, []) AS near FROM p LEFT JOIN near USING (j)),
r(j, kept, hit) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL
  SELECT n.j, CASE WHEN len(list_intersect(n.near, r.kept)) = 0 THEN list_append(r.kept, n.j) ELSE r.kept END, list_min(list_intersect(n.near, r.kept)) FROM r JOIN n ON n.j = r.j + 1)
SELECT q.id, q.question, q.style, q.name, coalesce(q.reason, 'like:' || h.id) AS drop_reason FROM q LEFT JOIN p ON p.id = q.id LEFT JOIN r ON r.j = p.j LEFT JOIN p h ON h.j = r.hit"""
_ASKED = "vec_id % 100 = 0"
_TURNED = dense_sql(10, "img", "cosine", _ASKED).replace("embedding::DOUBLE[] AS e", "list_reverse(embedding)::DOUBLE[] AS e")
ORACLE_SQL = {
    "styled_sample": """WITH c AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY source), q AS (SELECT source, greatest(1, round_even(100.0 * n / total, 0))::INT AS quota FROM c),
r AS (SELECT doc_id AS id, source, md5('0:' || doc_id) AS o, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS nth FROM documents),
s AS (SELECT id, source, o FROM r JOIN q USING (source) WHERE nth <= quota ORDER BY o, id LIMIT 100)
SELECT id, source, ['name_led', 'symptom_led', 'colloquial', 'exam_treat'][(row_number() OVER (ORDER BY o, id) - 1) % 4 + 1] AS style FROM s""",
    "keyword_sample": """WITH k AS (SELECT doc_id AS chunk_id, source AS source_id, CASE WHEN contains(source, 'src11') THEN 'SRC11' WHEN contains(source, 'src1') THEN 'src1' WHEN contains(source, 'src2') THEN 'src2' END AS keyword FROM documents)
SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY source_id, chunk_id) AS nth FROM k WHERE keyword IS NOT NULL QUALIFY nth <= 20""",
    "figure_fusion": f"""WITH {dense_sql(10, 'cap', 'cosine', _ASKED)}, {_TURNED}
SELECT query_id, chunk_id, floor(sum(1.0::DOUBLE / (60 + rank)) * 1e9 + 0.5)::BIGINT AS score, max(rank) FILTER (WHERE c) AS caption_rank, max(rank) FILTER (WHERE NOT c) AS image_rank
FROM (SELECT query_id, chunk_id, rank, true AS c FROM cap UNION ALL SELECT query_id, chunk_id, rank, false FROM img) GROUP BY ALL""",
    "figure_hits": f"""WITH {dense_sql(10, 'cap', 'cosine', _ASKED)}
SELECT w.vec_id AS query_id, coalesce(bool_or(contains('fig_' || f.label || '_', '_' || w.label || '_')), false) AS hit FROM embeddings w LEFT JOIN cap ON cap.query_id = w.vec_id AND cap.chunk_id <> w.vec_id AND cap.rank <= 5
LEFT JOIN embeddings f ON f.vec_id = cap.chunk_id WHERE w.vec_id % 100 = 0 GROUP BY w.vec_id""",
    "trace_summary": "SELECT user_id AS trace_id, sum(event_id % 97)::BIGINT AS total_ms, count(DISTINCT event_type)::INT AS n_stages, coalesce(sum(event_id % 10) FILTER (WHERE event_type = 'click'), 0)::BIGINT AS click_prompt FROM events GROUP BY user_id",
    "entity_canonical": f"WITH {_TRIPLES} SELECT surface, canonical FROM names",
    "graph_nodes": f"WITH {_GRAPH} SELECT name, string_agg(DISTINCT paper, ',' ORDER BY paper) AS papers FROM node GROUP BY name",
    "degree_topk": f"WITH {_GRAPH} SELECT name, count(*) AS degree FROM node GROUP BY name ORDER BY degree DESC, name LIMIT 10",
    "bridge_entities": f"WITH {_GRAPH} SELECT name, count(DISTINCT paper) AS n_papers FROM node GROUP BY name HAVING n_papers > 1",
    "hub_neighbours": f"""WITH {_GRAPH}, h AS (SELECT name AS hub FROM node GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)
SELECT DISTINCT * FROM (SELECT hub, 'out' AS direction, relation, tail AS name FROM edges JOIN h ON hub = head UNION ALL SELECT hub, 'in', relation, head FROM edges JOIN h ON hub = tail)""",
    "connected_components": """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_orderkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem),
both_ AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM both_ GROUP BY a UNION
  SELECT n.b, min(n.c) FROM (SELECT both_.b, cc.component AS c FROM cc JOIN both_ ON both_.a = cc.node) n JOIN recurring.cc r ON r.node = n.b WHERE n.c < r.component GROUP BY n.b)
SELECT node, component FROM cc""",
    "entity_linking": f"""WITH {_GRAPH}, k AS (SELECT DISTINCT name, regexp_replace(lower(trim(name)), '[\\s\\-_:：,.()（）]+', '', 'g') AS key FROM node),
a AS (SELECT n_nationkey AS query_id, regexp_replace(lower('Which parts of N-' || n_nationkey || ' are in R-' || n_regionkey || '?'), '[\\s\\-_:：,.()（）]+', '', 'g') AS q FROM nation)
SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name) AS place FROM a JOIN k ON contains(q, key) WHERE length(key) >= 2""",
    "khop_facts": f"""WITH {_GRAPH}, s AS (SELECT r_regionkey AS query_id, 'R-' || r_regionkey AS name FROM region),
f1 AS (SELECT query_id, 1 AS hop, head, relation, tail, paper FROM edges JOIN s ON name IN (head, tail)),
s2 AS (SELECT query_id, head AS name FROM f1 UNION SELECT query_id, tail FROM f1 EXCEPT SELECT * FROM s),
f2 AS (SELECT query_id, 2 AS hop, head, relation, tail, paper FROM edges JOIN s2 ON name IN (head, tail))
SELECT query_id, min(hop)::INT AS hop, head, relation, tail, arg_min(paper, {{'h': hop, 'p': paper}}) AS paper FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY query_id, head, relation, tail""",
    "partition_modularity": f"""WITH {_GRAPH}, {_PARTITION}, e AS (SELECT DISTINCT least(head, tail) AS a, greatest(head, tail) AS b FROM edges WHERE head <> tail),
x AS (SELECT x.community AS x, y.community AS y FROM e JOIN part x ON x.name = a JOIN part y ON y.name = b), d AS (SELECT c, count(*) AS d FROM (SELECT x AS c FROM x UNION ALL SELECT y FROM x) GROUP BY c)
SELECT count(*) AS n_edges, count(*) FILTER (WHERE x = y) AS n_inside, (SELECT count(*) FROM d) AS n_communities,
  floor((count(*) FILTER (WHERE x = y) / count(*) - (SELECT sum(d::DOUBLE * d) FROM d) / (4.0 * count(*) * count(*))) * 1e6 + 0.5) / 1e6 AS modularity FROM x""",
    "partition_facts": f"""WITH {_GRAPH}, {_PARTITION} SELECT x.community, head, relation, tail FROM edges JOIN part x ON x.name = head JOIN part y ON y.name = tail WHERE head <> tail AND x.community = y.community""",
    "question_check": _QUESTION_SQL,
    "similar_names": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id = b.vec_id OR list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT x, y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x)
SELECT printf('v%05d', x) AS name, printf('v%05d', min(y)) AS canonical FROM reach GROUP BY x""",
    "percentile_rank": f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, {r6('max(value) FILTER (WHERE i = round_even(0.5 * (n - 1), 0))')} AS p50, {r6('max(value) FILTER (WHERE i = round_even(0.9 * (n - 1), 0))')} AS p90 FROM r GROUP BY event_type""",
    "recent_percentile": f"""WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC, value) <= 1000),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM l)
SELECT event_type, {r6('value')} AS p95 FROM r WHERE i = least(floor(0.95 * n), n - 1)""",
    "stream_recent_percentile": f"""WITH l AS (SELECT * FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC, value) <= 1000),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM l)
SELECT event_type, {r6('value')} AS p95 FROM r WHERE i = least(floor(0.95 * n), n - 1)""",
    "stream_trace_totals": f"""WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS trace_id, event_type, value, epoch_ms(ts) AS t_ms FROM events),
t AS (SELECT trace_id FROM e GROUP BY trace_id HAVING max(t_ms) + 3600000 <= (SELECT max(t_ms) - 600000 FROM e))
SELECT trace_id, event_type, count(*) AS n, {r6('sum(value)')} AS value FROM e JOIN t USING (trace_id) GROUP BY ALL""",
    "parsed_pages": "SELECT page_id, length(html) AS n_chars, NULL::VARCHAR AS error FROM pages",
    "exact_permutation": f"""WITH d AS (SELECT l_orderkey, list(round(l_discount * 100)::INT - round(l_tax * 100)::INT) AS d FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey, d, unnest(range(0, (1 << len(d)))) AS mask FROM d),
s AS (SELECT l_orderkey, len(d) AS n, list_sum(d) AS total, list_sum(list_transform(d, lambda x, i: CASE WHEN (mask >> (i - 1)) & 1 = 1 THEN -x ELSE x END)) AS s FROM m)
SELECT l_orderkey, n::INT AS n, {r6('total / n::DOUBLE')} AS mean_diff, {r6('avg((abs(s) >= abs(total))::INT)')} AS p_value FROM s GROUP BY l_orderkey, n, total""",
    "events_tumbling": f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, {r6('sum(value)')} AS value FROM events GROUP BY ALL",
    "events_sliding": f"SELECT w AS window_start, event_type, count(*) AS n, {r6('sum(value)')} AS value FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - unnest([0, 1, 2, 3]) * INTERVAL 15 MINUTE AS w FROM events) GROUP BY ALL",
    "events_session": """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s.s""",
    "corpus_inspection": "SELECT 'documents' AS source, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents UNION ALL SELECT 'benchmark', count(*), sum(length(text))::BIGINT FROM benchmark",
    "figure_budget": """WITH p AS (SELECT l_partkey % 50 AS file, l_suppkey % 40 AS page, count(*) AS n_images FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n_images DESC, page) AS nth FROM p QUALIFY nth <= 3) SELECT file, page, n_images FROM r ORDER BY file, nth LIMIT 100""",
    "fill_down": "SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS category FROM events",
    "latest_runs": f"SELECT event_type AS label, user_id AS eval_set, event_id AS seq, {r6('value')} AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1",
}
