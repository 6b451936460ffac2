"""The queries of this subpackage, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversations, decontaminate, html_text, lexical, packing, passages, quality, secret_scan, sharding, simhash, token_counts, token_file, url_filter
from tessera.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, best fit first."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), window=4096, end_id=2)


#: The rules of op3_url_filters.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and the verdict of every page's url, aliases included."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over three-word shingles, and its component at two differing bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by a ledger of blobs."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secret_scan.spans_text(F.col("spans"))
    base = secret_scan.spans_text(F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE_RULES])))
    return found.select("doc_id", *(count(r.kind) for r in secret_scan.BASE_RULES), F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as directly addressable codes and read back."""
    return token_file.token_file(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a document holds a benchmark item, with at most a tenth of its characters edited."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"), with_counts=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat across documents."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, by a digest cache."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation, after seeded damage."""
    return conversations.audit(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, in a uniform random order."""
    placed = sharding.document_shards(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


_SPANS_SQL = """
SELECT doc_id, '{kind}' AS kind, {rank} AS k, a, a + length(m[i]) AS b FROM (
  SELECT doc_id, m, i, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS a FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{pattern}')))
WHERE length(regexp_extract(m[i], '{pattern}', {group})) >= {least}"""


def _op5_sql() -> str:
    spans = " UNION ALL ".join(_SPANS_SQL.format(kind=r.kind, rank=i, pattern=r.pattern.replace("'", "''"), group=r.group, least=r.least) for i, r in enumerate(secret_scan.BASE_RULES))
    return f"""WITH s AS ({spans}), d AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(d.spans, '')) AS base_sha256, coalesce(d.spans, '') AS spans FROM documents LEFT JOIN d USING (doc_id)"""


_STOP_SQL = ", ".join(f"'{w.decode()}'" for w in sorted(quality.STOP_WORDS))
_OP8_SQL = rf"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) AS r(k) GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    len(regexp_extract_all(regexp_replace(t, '[^A-Za-z\x{{80}}-\x{{10FFFF}}\x20\x09-\x0D]', '', 'g'), '[^\x20\x09-\x0D]+')) AS n_letter_words,
    len(list_filter(regexp_extract_all(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?"''()\[\]]', '', 'g'), '[^\x20\x09-\x0D]+'), lambda x: x IN ({_STOP_SQL}))) AS n_stop_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_upper > 3 * word_chars
    OR 10 * n_letter_words < 8 * n_words OR 50 * n_stop_words < n_words) AS kept FROM b"""


def _op3_sql() -> str:
    host = "translate(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
    node = f"CASE WHEN contains({{u}}, '://') THEN {host} || {path} || regexp_extract({{u}}, '^[^?#]*(\\?[^#]*)', 1) END".replace("\\\\", "\\")
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '{'/' + r.partition('/')[2]}')" for v, r in URL_RULES)
    quoted = lambda x: x.replace("'", "''")
    href = " || ".join(f"regexp_extract(regexp_extract(html, '{quoted(url_filter.CANONICAL)}', 0), '{quoted(url_filter.HREF)}', {k})" for k in (1, 2, 3))
    refresh = f"regexp_extract(regexp_extract(html, '{quoted(url_filter.REFRESH)}', 0), '{quoted(url_filter.REFRESH_URL)}', 1)"
    fit = "(SELECT {w} FROM rules WHERE ({h} = rh OR ends_with({h}, '.' || rh)) AND starts_with({p}, rp))"
    own = fit.format(w="max_by(verdict, length(rule))", h=host.format(u="url"), p=path.format(u="url"))
    return f"""WITH RECURSIVE rules(verdict, rule, rh, rp) AS (VALUES {rules}),
found AS (SELECT url, replace(trim(link), '&amp;', '&') AS link FROM (SELECT url, unnest([{href}, {refresh}]) AS link FROM pages) WHERE link <> ''),
edges AS (SELECT DISTINCT url AS a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
  WHEN starts_with(link, '//') THEN regexp_extract(url, '^(?s:(.*?))://', 1) || ':' || link
  WHEN starts_with(link, '/') THEN regexp_extract(url, '^(?s:(.*?))://', 1) || '://' || {host.format(u="url")} || link END AS b FROM found),
ends AS (SELECT {node.format(u="url")} AS node, {own} AS own FROM (SELECT a AS url FROM edges WHERE b IS NOT NULL UNION SELECT b FROM edges WHERE b IS NOT NULL)),
pairs AS (SELECT {node.format(u="a")} AS x, {node.format(u="b")} AS y FROM edges WHERE b IS NOT NULL),
near AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach(x, y) AS (SELECT x, x FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x),
spread AS (SELECT x AS node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS spread FROM reach JOIN ends ON ends.node = reach.y GROUP BY x),
p AS (SELECT page_id, coalesce({host.format(u="url")}, '') AS host, coalesce({path.format(u="url")}, '') AS path, {node.format(u="url")} AS node FROM pages),
q AS (SELECT *, {fit.format(w="max_by(rule, length(rule))", h="host", p="path")} AS rule, {fit.format(w="max_by(verdict, length(rule))", h="host", p="path")} AS own FROM p)
SELECT page_id, host, path, rule, coalesce(own, spread, 'allow') AS verdict FROM q LEFT JOIN spread USING (node)"""


def _op13_sql() -> str:
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({terms}) AS t FROM benchmark)),
d AS (SELECT doc_id, row_number() OVER () AS row, {terms} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
tf AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t),
scored AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * tf.n * s.n) // s.l))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN weights USING (t), s GROUP BY item_id, row, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10"""


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_packing": op2_packing,
    "op3_url_filters": op3_url_filters,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_token_file": op6_token_file,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_turn_repair": op11_turn_repair,
    "op12_sharding": op12_sharding,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL = {
    "op3_url_filters": _op3_sql(),
    "op5_secret_scans": _op5_sql(),
    "op8_quality_rules": _OP8_SQL,
    "op13_ranked_search": _op13_sql(),
}
