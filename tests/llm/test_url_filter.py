import duckdb

from tessera.llm.queries import ORACLE_SQL, URL_RULES
from tessera.llm.url_filter import decoded, judge_urls, resolved

CANONICAL, REFRESH = '<LINK href="{}" rel="canonical">', "<meta http-equiv=refresh content=\"0; url='{}'\">"
PAGES = [
    (1, "https://a.example.com/en/5", ""),  # blocked by its own rule
    (2, "http://x.info/1", CANONICAL.format("https://a.example.com/en/5")),  # alias of a blocked url
    (3, "http://y.info/2#f", REFRESH.format("http://x.info/1")),  # alias of an alias
    (4, "http://EXAMPLE.com/en/77", CANONICAL.format("http://x.info/9")),  # allowed by its own rule
    (5, "http://x.info/9", CANONICAL.format("/8")),
    (6, "http://x.info/8", CANONICAL.format("http://q.net/en/1")),
    (7, "http://example.net/de/8", ""),
    (8, "http://net/de/", ""),
    (9, "http://notnet/de/", ""),
    (10, "http://b.org/es/q?x", CANONICAL.format("//c.info/p?a=1&amp;b=2")),  # a block spreads
    (11, "http://c.info/p?a=1&b=2#z", None),
    (12, None, CANONICAL.format("http://b.org/es/")),
    (13, "no scheme", "<link rel=canonical href=http://b.org/es/>"),
    (14, "http://com/en/", ""),
    (15, "http://x.info/1", ""),
    (15, "http://x.info/1", ""),
    (None, "http://h.com", ""),
    (17, "http://m.info/1", CANONICAL.format("http://d.com/en/2")),  # an allow and a block: the allow goes first
    (18, "http://m.info/1", CANONICAL.format("http://e.example.com/en/7x")),
]
SCHEMA = "page_id long, url string, html string"


def test_against_sql_and_by_hand(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    got = sorted(map(tuple, judge_urls(pages, URL_RULES).collect()), key=str)
    con = duckdb.connect()
    con.register("frame", pages.toPandas().astype({"page_id": "Int64"}))
    con.execute("CREATE VIEW pages AS SELECT page_id::BIGINT AS page_id, url, html FROM frame")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE_SQL['op3_url_filters']})").fetchall()
    assert got == sorted(want, key=str)
    by = {r[0]: r for r in got}
    assert [by[i][4] for i in range(1, 19) if i != 16] == ["block", "block", "block", "allow", "allow", "allow", "block", "allow", "allow", "block", "block", "allow", "allow", "block", "block", "allow", "allow"]
    assert by[7][3] == "example.net/de/8" and by[8][3] == "net/de/" and by[9][3] is None and by[4][1:3] == ("example.com", "/en/77")


def test_table_of_redirects_and_empty(spark):
    pages = spark.createDataFrame(PAGES[:3], SCHEMA)
    redirects = spark.createDataFrame([("http://z.info/", "http://y.info/2"), (None, "http://a"), ("http://b", None)], "from_url string, to_url string")
    extra = spark.createDataFrame([(20, "https://z.info/", "")], SCHEMA)
    got = {r.page_id: r.verdict for r in judge_urls(pages.unionByName(extra), URL_RULES, redirects).collect()}
    assert got[20] == "block"
    assert judge_urls(spark.createDataFrame([], SCHEMA), URL_RULES).count() == 0


def test_references_are_resolved(spark):
    """The examples of the standard for resolving references, and a few of hosts and queries."""
    base = "http://a/b/c/d;p?q"
    cases = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q",
        "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g",
        "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "http://x/y/../z": "http://x/z", "mailto:a@b": None,
    }
    rows = spark.createDataFrame([(k, base, v) for k, v in cases.items()] + [("x", "http://h", "http://h/x"), ("x", "no", None)], "link string, base string, want string")
    from pyspark.sql import functions as F

    assert [tuple(r) for r in rows.where(~resolved(F.col("link"), F.col("base")).eqNullSafe(F.col("want"))).collect()] == []
    texts = spark.createDataFrame([(" http:&#x2f;&#47;a&sol;b?x=1&amp;y&lt \n", "http://a/b?x=1&y&lt"), ("a&#xD800;&#0;&#9999999;&bogus;", "a&#xD800;&#0;&#9999999;&bogus;"), ("&#x1F600;&amp", "\U0001f600&")], "link string, want string")
    assert [tuple(r) for r in texts.where(decoded(F.col("link")) != F.col("want")).collect()] == []


def test_relative_and_hidden_links(spark):
    pages = [
        (1, "http://b.org/es/2.html", ""), (2, "http://q.info/a/1.html", '<!-- <link rel=canonical href="http://e.example.com/en/7"> --><link rel="canonical" href="&#x2f;&#x2f;b.org/x/../es/2.html">'),
        (3, "http://q.info/a/b/3.html", '<link rel="alternate" href="/en"><link href="../1.html" rel="nofollow canonical">'), (4, "http://q.info/a/4.html", '<base href="http://b.org/es/"><link rel=canonical href=2.html>'),
        (5, "http://q.info/5", '<link rel=canonical href=/6><link rel=canonical href=/7>'), (6, "http://q.info/7", '<meta http-equiv="refresh" content="0;url=a/1.html">'),
        (7, "http://q.info/8", '<script>"<link rel=canonical href=http://b.org/es/2.html>"</script>'),
    ]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(pages, SCHEMA), URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow"}


def test_many_rules_against_brute_force(spark):
    import random

    rng = random.Random(1)
    hosts = [f"{rng.choice('abc')}{k}.{rng.choice(['com', 'x.net'])}" for k in range(300)]
    rules = [(rng.choice(["allow", "block"]), f"{rng.choice([*hosts, 'com', 'net'])}/{'/'.join(str(rng.randrange(30)) for _ in range(rng.randrange(4)))}") for _ in range(20_000)] + [("block", "zz")]
    rules = list({r: v for v, r in rules}.items())
    urls = [(k, f"http://{rng.choice(['', 'w.', 'w.v.'])}{rng.choice([*hosts, 'zz', 'yzz'])}/{'/'.join(str(rng.randrange(30)) for _ in range(rng.randrange(5)))}", None) for k in range(400)] + [(None, None, None)] * 2
    table = spark.createDataFrame([(v, r) for r, v in rules], "verdict string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(urls, SCHEMA), table).collect()}
    for k, url, _ in urls[:-2]:
        host, _, path = url[7:].partition("/")
        fits = [(len(r), len(r.partition("/")[0]), r, v) for r, v in rules if ("." + host).endswith("." + r.partition("/")[0]) and ("/" + path).startswith("".join(r.partition("/")[1:]))]
        assert got[k] == (max(fits)[2:] if fits else (None, "allow"))
    assert got[None] == (None, "allow")


def test_redirects_within_noscript(spark):
    pages = [(1, "http://q.info/1", '<noscript><meta http-equiv="refresh" content="0;url=http://b.org/es/1"></noscript>'), (2, "http://q.info/2", "<noscript>no link</noscript>")]
    assert {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(pages, SCHEMA), URL_RULES).collect()} == {1: "block", 2: "allow"}


def test_many_linked_pages_against_brute_force(spark):
    """5000 pages, most of them linked in chains and stars, a third of them with one url."""
    import random

    rng = random.Random(9)
    urls = [f"http://s{rng.randrange(900)}.{rng.choice(['info', 'info', 'info', 'com', 'net', 'org', 'example.com'])}/{rng.choice(['en', 'de', 'es', 'x'])}/{rng.randrange(90)}" for _ in range(3000)]
    pages, edges = [], []
    for k in range(5000):
        url, html = "http://hot.info/index?id=7" if k % 3 == 0 else rng.choice(urls), ""
        if rng.random() < 0.25:
            to = rng.choice(urls)
            html = rng.choice([CANONICAL, REFRESH]).format(to if rng.random() < 0.7 else to[5:])
            edges.append((url, to))
        pages.append((k, url, html))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    node = lambda u: u.partition("://")[2]
    for a, b in edges:
        parent[root(node(a))] = root(node(b))

    def rule(n):
        host, _, path = n.partition("/")
        fits = [(len(r), r, v) for v, r in URL_RULES if ("." + host).endswith("." + r.partition("/")[0]) and ("/" + path.partition("?")[0]).startswith("/" + r.partition("/")[2])]
        return max(fits)[1:] if fits else (None, None)

    spread = {}
    for n in list(parent):
        if rule(n)[1]:
            spread.setdefault(root(n), set()).add(rule(n)[1])
    want = {}
    for k, url, _ in pages:
        r, v = rule(node(url))
        others = spread.get(root(node(url)), set())
        want[k] = (r, v or ("allow" if "allow" in others or not others else "block"))
    df = spark.createDataFrame(pages, SCHEMA)
    assert {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, URL_RULES).collect()} == want
    assert len({v for _, v in want.values()}) == 2


def test_expressions_stay_small(spark, sf):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", "http://b")], "link string, base string")
    plan = rows.select(resolved(decoded(F.col("link")), F.col("base")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000
