"""URL filters with redirect equivalence.

A rule names a host, with its subdomains, and the beginning of a path. Where no rule fits a page's url, the page takes
the decision of its aliases: the urls that canonical links, refresh redirects or a table of redirects connect it with,
found as connected components. An explicit allow among them takes precedence over a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.operators.components import connected_components
from tessera.storage import Workspace

ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """(host, folder, rest, rule, verdict) of rules (verdict, rule): folder is the rule's path up to its last slash, rest what
    follows. A rule that is given with both verdicts allows. Null rules are left out."""
    given = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "verdict string, rule string")
    once = given.where("rule is not null").groupBy("rule").agg(F.max(F.col("verdict") == ALLOW).alias("allows"))
    path = F.regexp_extract("rule", r"^(?s:[^/]*)(/.*)?$", 1)
    folder = F.regexp_extract(path, r"^(?s:.*/)?", 0)
    named = once.select(F.substring_index("rule", "/", 1).alias("host"), folder.alias("folder"), "rule", F.when(F.col("allows"), ALLOW).otherwise(BLOCK).alias("verdict"), path.alias("path"))
    return named.select("host", "folder", F.col("path").substr(F.length("folder") + 1, F.length("path")).alias("rest"), "rule", "verdict")


def fitting_rules(urls: DataFrame, rules: DataFrame, work: Workspace) -> DataFrame:
    """(host, path, own): the longest rule that fits each distinct host and path, as a struct (rule, verdict); those that no
    rule fits have no row. rules: a rule_table().

    A rule that fits has one of the host's suffixes as its host, one of the path's folders as its folder, and the beginning of
    what follows as its rest. Hosts and folders are joined as keys with the lengths that rests under them have, then rests.
    """
    depth = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.size(F.split("folder", "/"))).alias("folders")).first()
    lengths = work.save(rules.groupBy("host", "folder").agg(F.collect_set(F.length("rest")).alias("lengths")), "lengths")
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    n_labels = F.least(F.size(labels), F.lit(depth["labels"] or 1))
    n_parts = F.least(F.size(parts) - 1, F.lit(depth["folders"] or 0))
    suffixes = F.transform(F.sequence(F.lit(1), n_labels), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    folders = F.transform(F.sequence(F.lit(0), n_parts), lambda n: F.when(n > 0, F.concat(F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(1))), "/"), F.lit("/"))).otherwise(""))
    keyed = urls.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("s"), folders.alias("folders"))
    keyed = keyed.select("host", "path", "s", F.explode("folders").alias("f"))
    under = lengths.select(F.col("host").alias("s"), F.col("folder").alias("f"), "lengths")
    rest = F.col("path").substr(F.length("f") + 1, F.length("path"))
    cut = keyed.join(under, ["s", "f"]).select("host", "path", "s", "f", rest.alias("tail"), F.explode("lengths").alias("n")).where("n <= length(tail)")
    cut = cut.select("host", "path", "s", "f", F.expr("substr(tail, 1, n)").alias("r"))
    fits = cut.join(rules.select(F.col("host").alias("s"), F.col("folder").alias("f"), F.col("rest").alias("r"), "rule", "verdict"), ["s", "f", "r"])
    longest = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("s"))).alias("own")
    return fits.groupBy("host", "path").agg(longest)


def node_of(url: Column) -> Column:
    """What counts as one url among aliases: host, path and query, without scheme and fragment. Null without ://."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), path_of(url), query))


#: Fixed value: the parts of a reference; groups: scheme with colon, authority with slashes, path, query with mark.
REFERENCE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def without_dots(path: Column) -> Column:
    """A path with its segments . and .. resolved."""

    def step(kept, part):
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    def of(p):
        joined = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
        return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.concat(joined, F.when(p.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(p)

    return let(path, of)


def _parts(url: Column) -> Column:
    return F.struct(*(F.regexp_extract(url, REFERENCE, k).alias(name) for k, name in enumerate(("scheme", "authority", "path", "query"), 1)))


def resolved(link: Column, base: Column) -> Column:
    """A reference as an absolute url, by the rules for resolving it against base. Null if base has no ://, or for a link whose
    scheme takes no host (mailto, javascript). Parts are named once, so that the expression stays small."""

    def of(r, b):
        own, alone = r["authority"] != "", (r["authority"] == "") & (r["path"] == "")
        folder = F.when(b["path"] == "", F.lit("/")).otherwise(F.regexp_extract(b["path"], r"^(?s:.*/)?", 0))
        path = F.when(alone, b["path"]).otherwise(without_dots(F.when(own | r["path"].startswith("/"), r["path"]).otherwise(F.concat(folder, r["path"]))))
        query = F.when(alone & (r["query"] == ""), b["query"]).otherwise(r["query"])
        whole = F.concat(F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]), F.when(own, r["authority"]).otherwise(b["authority"]), path, query)
        return F.when(F.when(r["scheme"] != "", own).otherwise(b["known"]), whole)

    known = F.coalesce(F.contains(base, F.lit("://")), F.lit(False))
    return let(_parts(link), lambda r: let(let(_parts(F.coalesce(base, F.lit(""))), lambda b: b.withField("known", known)), lambda b: of(r, b)))


#: Names of character references that a url may be written with.
NAMES = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "colon": ":", "period": ".", "quest": "?", "num": "#", "equals": "=", "lowbar": "_", "percnt": "%", "commat": "@", "excl": "!", "dollar": "$", "lpar": "(", "rpar": ")", "ast": "*", "plus": "+", "comma": ",", "semi": ";", "Hat": "^", "grave": "`", "bsol": "\\", "nbsp": "\u00a0", "Tab": "\t", "NewLine": "\n"}
_CHARACTER = r"&(?:#[xX][0-9a-fA-F]{1,6};?|#[0-9]{1,7};?|[A-Za-z]+;|amp)"


def decoded(link: Column) -> Column:
    """A link with its character references replaced, white space around it removed, and tabs and line breaks left out. Numbers that are no character stay."""
    names = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))

    def one(found):
        digits = F.regexp_extract(found, r"^&#([xX]?)([0-9a-fA-F]+)", 2)
        code = F.conv(digits, 16, 10).cast("long")
        code = F.when(found.rlike("^&#[xX]"), code).otherwise(digits.cast("long"))
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(found.startswith("&#"), F.when(valid, character).otherwise(found)).otherwise(F.coalesce(names[F.regexp_extract(found, "[A-Za-z]+", 0)], found))

    def whole(x):
        pieces = F.arrays_zip(F.split(x, _CHARACTER, -1).alias("gap"), F.regexp_extract_all(x, F.lit(_CHARACTER), F.lit(0)).alias("found"))
        replaced = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(one(p["found"]), F.lit("")))), "")
        return F.regexp_replace(F.when(F.contains(x, F.lit("&")), replaced).otherwise(x), r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", "")

    return let(link, whole)


#: What holds no tags of the page; the tags of canonical links, refreshes and bases; where each has its target.
NO_TAGS = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\z)"
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?i)\burl\s*=\s*['"]?([^"'>\s]+)"""
BASE = r"(?i)<base\b[^>]*\bhref\b[^>]*>"


def _href(tag: Column) -> Column:
    return F.concat(*(F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)))


def links_of(pages: DataFrame, work: Workspace) -> DataFrame | None:
    """(from_url, to_url): all canonical links and refresh redirects in the html of pages (url, html), comments and scripts
    left out, resolved against the page's base; None if there are none. What stands in the tags is written first, for the few pages
    that have any; only then are references decoded and resolved."""
    with_links = pages.where(F.col("html").rlike(CANONICAL) | F.col("html").rlike(REFRESH))
    seen = with_links.select("url", F.regexp_replace("html", NO_TAGS, "").alias("html"))
    canonical = F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(0)), _href)
    refresh = F.transform(F.regexp_extract_all("html", F.lit(REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1))
    base = let(F.regexp_extract("html", BASE, 0), _href)
    found = work.save(seen.select("url", base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("link")).where("link <> ''").distinct(), "tags")
    if found.isEmpty():
        return None
    read = work.save(found.select("url", decoded(F.col("base")).alias("base"), decoded(F.col("link")).alias("link")).where("link <> ''"), "decoded")
    against = work.save(read.select("url", "link", F.when(F.col("base") != "", resolved(F.col("base"), F.col("url"))).otherwise(F.col("url")).alias("base")), "bases")
    return against.select(F.col("url").alias("from_url"), resolved(F.col("link"), F.col("base")).alias("to_url")).where("to_url is not null")


def judge_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    rules: (verdict, rule), any number of them. The longest rule that fits gives the verdict; of equally long ones that with
    the longer host. Without one, a page is allowed if an alias has an explicit allow, else blocked if an alias has a block,
    else allowed. redirects (from_url, to_url) adds edges to those in the html.
    A null url, or one without ://, has an empty host and path, fits no rule, has no alias and is allowed. A null html has no
    links. Repeated rows are returned as often as they come; other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "url-filter")
    table = work.save(rule_table(spark, rules), "rules")
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), (F.col(html_col) if html_col else F.lit(None).cast("string")).alias("html"))
    found = [f for f in [links_of(page.select("url", "html"), work) if html_col else None] if f is not None]
    if redirects is not None:
        found.append(redirects.select("from_url", "to_url"))
    urls = page.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    # written first, so that the join has plain exchanges, and a host and path that very many pages have can be split
    judged = urls.join(work.save(fitting_rules(urls, table, work), "fitting"), ["host", "path"], "left")
    edges = work.save(reduce(DataFrame.unionByName, found).distinct(), "links") if found else None
    if edges is None or edges.isEmpty():  # nothing has an alias
        return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", F.lit(ALLOW)).alias("verdict"))
    ends = edges.select("from_url").unionByName(edges.select(F.col("to_url").alias("from_url"))).distinct()
    ends = ends.select(host_of(F.col("from_url")).alias("host"), path_of(F.col("from_url")).alias("path"), node_of(F.col("from_url")).alias("node")).where("node is not null")
    own = F.col("own.verdict")
    nodes = ends.join(work.save(fitting_rules(ends, table, work), "fitting"), ["host", "path"]).groupBy("node").agg(F.max(own == ALLOW).alias("allow"), F.max(own == BLOCK).alias("block"))
    component = connected_components(edges.select(node_of(F.col("from_url")).alias("src"), node_of(F.col("to_url")).alias("dst")), work)
    decided = component.join(nodes, "node").groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    decided = decided.select("component", F.when(F.col("allow"), ALLOW).when(F.col("block"), BLOCK).alias("spread")).where("spread is not null")
    spread = work.save(component.join(work.save(decided, "decided"), "component").select("node", "spread"), "spread")
    out = judged.join(spread, "node", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit(ALLOW)).alias("verdict"))
