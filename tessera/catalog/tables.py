"""Queries: extracted tables and smaller operators. Tables are made of parts, one or two rows each, as HTML, LaTeX, Markdown or boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog.retrieval import BM25_SQL, GOLD_SQL, METRICS, gold, lexical, lexical_sql, metrics_sql, r6, read, six
from tessera.operators import evaluation, graph, ranking, tables, vectors
from tessera.operators.ranking import rounded
from tessera.sources import files

HEAD = ("检验大类", "项目", "结果", "单位", "参考范围", "提示")


def _grid_rows(grids, cells):
    """(p_partkey, r, c, text) of grids, one a part."""
    rows = grids.select("p_partkey", F.posexplode(cells).alias("r", "row"))
    return rows.select("p_partkey", "r", F.posexplode("row").alias("c", "text"))


def html_cells(spark, sf_dir):
    """Cells of tables with spans in both directions and a character reference."""
    read_grids = F.pandas_udf(lambda pages: pages.map(tables.html_grid), "array<array<string>>")
    page = F.concat(
        F.lit("<html><table><tr><th>head<th colspan='2'>A &amp; B</th></tr><tr><td rowspan=2>"), "p_name", F.lit("</td><td> "), "p_brand",
        F.lit(" </td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr><tr><td><b>"), "p_type", F.lit("</b></td></tr></table></html>"),
    )
    return _grid_rows(read(spark, sf_dir, "part").select("p_partkey", page.alias("page")), read_grids("page"))


def latex_cells(spark, sf_dir):
    """Cells of a tabular with a spanning head, a cell over two rows, and mathematics."""
    read_grids = F.pandas_udf(lambda pages: pages.map(lambda p: tables.latex_grids(p)[0]), "array<array<string>>")
    page = F.concat(
        F.lit(r"\begin{tabular}{|l|l|}\hline \multicolumn{2}{c}{\text{head}} \\ \multirow{2}{*}{"), F.col("p_size").cast("string"), F.lit(r"} & \(10^{"),
        F.col("p_partkey").cast("string"), F.lit(r"}/\mathrm{L}\) \uparrow \\ & \begin{tabular}{l}a_{1} \\ "), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(r"\end{tabular} \\ \hline \end{tabular}"),
    )
    return _grid_rows(read(spark, sf_dir, "part").select("p_partkey", page.alias("page")), read_grids("page"))


def markdown_cells(spark, sf_dir):
    """Cells of pipe tables between other lines."""
    page = F.concat(F.lit("Parts:\n| name | brand |\n|:---|---|\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |\nend"))
    return _grid_rows(read(spark, sf_dir, "part").select("p_partkey", page.alias("page")), tables.markdown_cells(F.col("page")))


def box_cells(spark, sf_dir):
    """Cells of boxes: two rows that are a little uneven, two columns, and a cell of two boxes."""
    at = lambda x, y, text: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(10.0).alias("height"), text.cast("string").alias("text"))
    boxes = F.array(at(104, 12, F.col("p_brand")), at(10, 10, F.col("p_name")), at(14, 33, F.col("p_type")), at(12, 30, F.lit("type")), at(100, 31, F.col("p_size")))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(boxes).alias("b")).select("p_partkey", "b.*")
    return tables.box_cells(rows, keys=("p_partkey",)).select("p_partkey", F.col("row").alias("r"), F.col("column").alias("c"), "text")


def _lab(spark, sf_dir):
    """Two grids a part: a head with a row, and a row on the next page, without a head and a category."""
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    first = F.array(F.array(*map(F.lit, HEAD)), F.array(F.col("p_brand"), F.col("p_name"), F.concat(size, F.lit(" mmol/L")), F.lit(""), F.concat(F.lit("1-"), size, F.lit(" mmol/L")), F.lit("↑")))
    second = F.array(F.array(F.lit(""), F.col("p_type"), size, F.lit("g"), F.lit("0-9"), F.lit("")))
    both = F.array(F.struct(F.lit(0).alias("grid_no"), first.alias("cells")), F.struct(F.lit(1).alias("grid_no"), second.alias("cells")))
    return p.select(F.col("p_partkey").cast("string").alias("table_id"), F.explode(both).alias("g")).select("table_id", "g.*")


def lab_rows(spark, sf_dir):
    """Rows of two-page tables: heads, inherited heads, fill-down, units."""
    return tables.grid_rows(_lab(spark, sf_dir))


def table_scores(spark, sf_dir):
    """Scores of tables whose second row has a wrong result in every third table."""
    truth = tables.grid_rows(_lab(spark, sf_dir))
    wrong = (F.col("row_no") == 1) & (F.col("table_id").cast("int") % 3 == 0)
    found = truth.withColumn("result", F.when(wrong, F.concat("result", F.lit("0"))).otherwise(F.col("result"))).withColumn("row_no", 1 - F.col("row_no"))
    s = tables.score_tables(truth, found, ("item", "result", "unit"))
    return s.select("table_id", "n_rows", six("row_acc"), six("field_em_mean"), rounded(s["field_em"]["result"], 6).alias("result_em"))


def table_norm(spark, sf_dir):
    """Names with raised digits, wide letters, dashes and white space, in the form in which cells are compared."""
    return read(spark, sf_dir, "part").select("p_partkey", tables.norm_column(F.concat("p_name", F.lit(" 10⁹／Ｌ 3–5~µ "), "p_type")).alias("text"))


def bigram_similarity(spark, sf_dir):
    """Likeness of every part's name and type."""
    return read(spark, sf_dir, "part").select("p_partkey", rounded(tables.bigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


def chunk_level_metrics(spark, sf_dir):
    """Rank metrics of chunks: every hit stands for two chunks of its document."""
    hits = lexical(spark, sf_dir, 5).select("query_id", F.explode(F.array(F.col("rank") * 2 - 1, F.col("rank") * 2)).alias("rank"), F.col("chunk_id").alias("source_id"))
    m = evaluation.rank_metrics(hits, gold(spark, sf_dir), dedupe=False)
    return m.select("query_id", "first_rank", *(rounded(F.col(f"`{c}`"), 6).alias(c.replace("@", "_")) for c in m.columns[2:]))


def graph_counts(spark, sf_dir):
    """Numbers of triples, entities, relations and chunks."""
    from tessera.catalog.analysis import triples

    return graph.counts(triples(spark, sf_dir))


def cache_statistics(spark, sf_dir):
    """Lookups of a cache, made of events: a hit every third, with the time of the answer that it saved."""
    e = read(spark, sf_dir, "events")
    lookups = e.select((F.col("event_id") % 3 == 0).alias("hit"), (F.col("event_id") % 50).cast("double").alias("lookup_ms"), (F.col("event_id") % 4000).cast("double").alias("answer_ms"))
    s = vectors.cache_statistics(lookups)
    return s.select("lookups", "hits", six("hit_rate"), six("ms_saved"))


def random_order(spark, sf_dir):
    """A seeded order of all documents."""
    return ranking.seeded_order(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), seed=7).select("id", "place")


def research_filter(spark, sf_dir):
    """Triples made of parts, without stop entities and unknown types."""
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        k.cast("string").alias("source_id"), F.col("p_name").alias("head"), F.when(k % 3 == 0, "模型").when(k % 3 == 1, "数据集").otherwise("unknown").alias("head_type"), F.lit("is").alias("relation"),
        F.when(k % 5 == 0, "本文").otherwise(F.col("p_brand")).alias("tail"), F.when(k % 2 == 0, "任务").alias("tail_type"),
    )
    return graph.keep_research(rows).select("source_id", "head", "tail")


def triples_in_replies(spark, sf_dir):
    """Complete triples in a model's replies, made of parts."""
    triple = F.concat(F.lit('{"head": "'), "p_name", F.lit('", "head_type": "", "relation": "of", "tail": "'), "p_brand", F.lit('", "tail_type": "t"}'))
    reply = F.concat(F.lit("Here: ["), triple, F.lit(', {"head": "", "relation": "r", "tail": "x"}, '), triple, F.lit("] done"))
    return graph.parse_triples(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), reply.alias("reply")))


def figure_scan(spark, sf_dir):
    """Images of parts in orders' chunks, each with its first caption."""
    line = read(spark, sf_dir, "lineitem")
    metadata = F.create_map(F.lit("modality"), F.when(F.col("l_quantity") > 25, "figure").otherwise("text"), F.lit("image_path"), F.concat(F.lit("img_"), F.col("l_partkey").cast("string")))
    chunks = line.select(metadata.alias("metadata"), F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_linenumber").alias("chunk_index"), F.concat_ws("-", F.lit("figure"), "l_orderkey", "l_linenumber").alias("text"))
    return files.figures(chunks)


def page_documents(spark, sf_dir):
    """Events as parsed pages of their users' files: short texts and empty tables are left out."""
    n = F.col("event_id")
    pages = read(spark, sf_dir, "events").select(F.concat(F.lit("File "), F.col("user_id").cast("string")).alias("file"), n.cast("int").alias("page"), F.when(n % 3 == 0, "table").otherwise("text").alias("modality"), F.concat(F.lit(" "), F.repeat(F.lit("x"), (n % 60).cast("int"))).alias("content"))
    return files.page_documents(pages).select("id", "title", "content")


def table_markdown(spark, sf_dir):
    """Parts as pipe tables, some of which are too empty to be one."""
    brand = F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand"))
    grid = F.array(F.array("p_name", brand), F.array("p_type", F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", files.table_markdown(grid).alias("markdown"))


QUERIES = {
    "research_filter": research_filter,
    "triples_in_replies": triples_in_replies,
    "figure_scan": figure_scan,
    "page_documents": page_documents,
    "table_markdown": table_markdown,
    "html_cells": html_cells,
    "latex_cells": latex_cells,
    "markdown_cells": markdown_cells,
    "box_cells": box_cells,
    "lab_rows": lab_rows,
    "table_scores": table_scores,
    "table_norm": table_norm,
    "bigram_similarity": bigram_similarity,
    "chunk_level_metrics": chunk_level_metrics,
    "graph_counts": graph_counts,
    "cache_statistics": cache_statistics,
    "random_order": random_order,
}


def _cells_sql(*rows: tuple[str, ...]) -> str:
    cells = [f"({r}, {c}, {text})" for r, row in enumerate(rows) for c, text in enumerate(row)]
    return "SELECT p_partkey, x.r, x.c, x.text FROM part, LATERAL (SELECT * FROM (VALUES " + ", ".join(cells) + ") v(r, c, text)) x"


_BRAND = "regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')"
_PAIRS = "list_distinct(list_transform(range(1, greatest(length({x}), 2)), lambda i: substr({x}, i, 2)))"
_M6 = ", ".join(f"{r6(m)} AS {m}" for m in METRICS)
_TWICE = "twice AS (SELECT query_id, chunk_id, unnest([rank * 2 - 1, rank * 2]) AS rank FROM lex)"
ORACLE_SQL = {
    "research_filter": "SELECT p_partkey::VARCHAR AS source_id, p_name AS head, p_brand AS tail FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 5 <> 0",
    "triples_in_replies": "SELECT p_partkey AS source_id, p_name AS head, '' AS head_type, 'of' AS relation, p_brand AS tail, 't' AS tail_type FROM part, range(2)",
    "figure_scan": """SELECT 'img_' || l_partkey AS image_path, l_orderkey::VARCHAR AS source_id, 'figure-' || l_orderkey || '-' || l_linenumber AS caption FROM lineitem WHERE l_quantity > 25
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey::VARCHAR, l_linenumber) = 1""",
    "page_documents": """SELECT 'pdf_file_' || user_id || '_p' || lpad(event_id::VARCHAR, greatest(4, length(event_id::VARCHAR))::INT, '0') || CASE WHEN event_id % 3 = 0 THEN '_table' ELSE '' END AS id, 'File ' || user_id AS title, ' ' || repeat('x', event_id % 60) AS content
  FROM events WHERE CASE WHEN event_id % 3 = 0 THEN event_id % 60 > 0 ELSE event_id % 60 >= 30 END""",
    "table_markdown": "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN '| ' || p_name || ' | ' || p_brand || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_type || ' | ' || p_size || ' |' || chr(10) END AS markdown FROM part",
    "html_cells": _cells_sql(("'head'", "'A & B'", "'A & B'"), ("p_name", "p_brand", "p_size::VARCHAR"), ("p_name", "p_type", "''")),
    "latex_cells": _cells_sql(("'head'", "''"), ("p_size::VARCHAR", "'10^' || p_partkey || '/L↑'"), ("p_size::VARCHAR", f"'a1' || {_BRAND}")),
    "markdown_cells": _cells_sql(("'name'", "'brand'"), ("p_name", "p_brand")),
    "box_cells": _cells_sql(("p_name", "p_brand"), ("'type ' || p_type", "p_size::VARCHAR")),
    "lab_rows": "SELECT p_partkey::VARCHAR AS table_id, 0 AS row_no, p_brand AS category, p_name AS item, p_size::VARCHAR AS result, 'mmol/L' AS unit, '1-' || p_size AS ref_range, '↑' AS flag FROM part UNION ALL SELECT p_partkey::VARCHAR, 1, p_brand, p_type, p_size::VARCHAR, 'g', '0-9', '' FROM part",
    "table_scores": f"SELECT p_partkey::VARCHAR AS table_id, 2 AS n_rows, CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS row_acc, CASE WHEN p_partkey % 3 = 0 THEN {r6('5 / 6.0')} ELSE 1.0 END AS field_em_mean, CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS result_em FROM part",
    "table_norm": "SELECT p_partkey, regexp_replace(p_name || '10^9/L3-5-μ' || p_type, '\\s', '', 'g') AS text FROM part",
    "bigram_similarity": f"SELECT p_partkey, {r6('len(list_intersect(a, b)) / least(len(a), len(b))')} AS similarity FROM (SELECT p_partkey, {_PAIRS.format(x='p_name')} AS a, {_PAIRS.format(x='p_type')} AS b FROM part)",
    "chunk_level_metrics": f"WITH {BM25_SQL}, {lexical_sql(5)}, {GOLD_SQL}, {_TWICE}, {metrics_sql('twice')} SELECT query_id, first_rank, {_M6} FROM m",
    "graph_counts": """WITH t AS (SELECT 'n' || c_nationkey || '_p' || c_custkey AS s, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE ' ' || lower(c_mktsegment) END AS h, 'in' AS r, 'N-' || c_nationkey AS t FROM customer
  UNION ALL SELECT 'n' || n_nationkey || '_p0', 'n ' || n_nationkey, 'part of', 'R-' || n_regionkey FROM nation UNION ALL SELECT 'world', 'R-' || r_regionkey, 'named', r_name FROM region)
SELECT count(*) AS n_triples, (SELECT count(DISTINCT e) FROM (SELECT h AS e FROM t UNION ALL SELECT t FROM t)) AS n_entities, count(DISTINCT r) AS n_relations, count(DISTINCT s) AS n_chunks FROM t""",
    "cache_statistics": f"SELECT count(*) AS lookups, count(*) FILTER (WHERE event_id % 3 = 0) AS hits, {r6('count(*) FILTER (WHERE event_id % 3 = 0) / count(*)')} AS hit_rate, {r6('sum(greatest(event_id % 4000 - event_id % 50, 0)::DOUBLE) FILTER (WHERE event_id % 3 = 0)')} AS ms_saved FROM events",
    "random_order": "SELECT doc_id AS id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS place FROM documents",
}
