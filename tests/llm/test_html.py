import re

from tessera.llm.html_text import extract, main_text

LONG = "The cat of the house is on the mat and it was with the dog. " * 5


def test_article_only(spark):
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <!-- <p>{LONG}</p> --><script>var x = "</p><p>no</p>";</script><article class="post"><header><h1>A &amp; B</h1></header><p>One
    two<br>three &lt;4&gt;</p><aside>side</aside><div class="adContainer"><p>{LONG}</p></div><form><p>name</p></form><p>Be.</p>
    <section id="comments"><p>{LONG}</p></section><p>x <a href=q>link</a> y z</p></article><div class="cookie-notice">{LONG}</div><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "A & B\nOne two three <4>\nBe.\nx link y z"


def test_density_rules_without_an_article():
    page = f'<div id=menu><a href=1>One</a></div><div><h2>Head</h2><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><p><a href=x>More</a> <a href=y>And more</a></p><p>© 2020</p>'
    assert main_text(page).split("\n") == ["Head", LONG.strip(), "Short one.", LONG.strip()]


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, None, None), (None, "u", ""), (2, "v", "<p"), (2, "v", "<p"), (3, "w", "<article>" + "<b>x " * 50_000), (4, "z", "</div></p><article><p>ok")]
    got = extract(spark.createDataFrame([(*r, None, None) for r in rows], schema)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "u", 0), (1, "", 0), (2, "v", 0), (2, "v", 0), (3, "w", 99_999), (4, "z", 2)]
    assert all(len(r.text) == r.n_chars for r in got)
    assert extract(spark.createDataFrame([], schema)).count() == 0


def test_all_pages_of_the_table(spark, sf):
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert main_text(r.html) == "\n".join(b for b in blocks if b)


def test_class_names_that_speak_of_the_layout():
    for page in (f'<article class="post has-comments"><p>{LONG}</p></article>', f'<div class="content has-sidebar"><p>{LONG}</p></div>', f'<div class="layout-no-sidebar"><article><p>{LONG}</p></article></div>'):
        assert main_text(page) == LONG.strip()
    assert main_text(f'<article><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article>') == LONG.strip()


def test_other_languages_and_copyright():
    chinese = "\u8fd9\u662f\u4e00\u4e2a\u6d4b\u8bd5\u3002" * 20
    assert main_text(f"<div><a href=/>\u9996\u9875</a></div><div><p>{chinese}</p><p>\u77ed\u53e5\u3002</p></div>") == f"{chinese}\n\u77ed\u53e5\u3002"
    russian = "\u042d\u0442\u043e \u0434\u043b\u0438\u043d\u043d\u044b\u0439 \u0442\u0435\u043a\u0441\u0442 \u043e \u0447\u0451\u043c. " * 12
    assert main_text(f"<div>{russian}</div>") == russian.strip()
    assert main_text(f"<div><p>{LONG}\u00a9 here</p></div>") == f"{LONG}\u00a9 here"


def test_densities_decide_inside_an_article():
    page = f"<article><p>{LONG}</p><p><a href=1>{LONG}</a></p><p>Short.</p><p>{LONG}</p></article>"
    assert main_text(page) == f"{LONG.strip()}\nShort.\n{LONG.strip()}"


def test_hostile_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<a" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<head>" * 50_000, '<p title="' * 50_000, "<b><i>" * 50_000 + "</b></i>" * 50_000, '<div class="share-price">x' * 50_000, "<h3>Comments</h3><p>x" * 50_000):
        main_text(page)
    assert time.perf_counter() - began < 20


def test_pages_without_container_tags(spark, sf):
    """With article, nav and footer renamed to div, nearly all blocks get the label that the containers gave them."""
    right = total = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        want = main_text(r.html).split("\n")
        got = main_text(re.sub("<(/?)(article|nav|footer)\\b", r"<\1div", r.html)).split("\n")
        total += len(set(want) | set(got))
        right += len(set(want) & set(got))
    assert right / total >= 0.95


def test_names_that_are_about_the_subject_or_the_layout():
    for name in ("wrapper sidebar-right", "legal-news", "search-engines", "notice-period", "related-work", "share-price", "ad-hoc", "social-policy", "discussion"):
        for page in (f'<div class="{name}"><h1>Head</h1><p>{LONG}</p></div>', f'<div id="{name.split()[-1]}"><article><h1>Head</h1><p>{LONG}</p></article></div>'):
            assert main_text(page) == f"Head\n{LONG.strip()}", page
    page = f'<article><p>{LONG}</p><section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section><div class="social-history"><p>A smoker.</p></div></article>'
    assert main_text(page) == f"{LONG.strip()}\nDiscussion\n{LONG.strip()}\nA smoker."


def test_names_that_hold_beside_other_text():
    for name in ("sidebar-right", "cookie-policy", "comment-body", "adSlot", "newsletter-cta", "related-posts", "notice", "comments", "ad-728"):
        for page in (f'<article><p>{LONG}</p></article><div class="{name}"><p>{LONG}</p></div>', f'<div class="{name}"><p>{LONG}</p></div><div><p>{LONG}</p></div>'):
            assert main_text(page) == LONG.strip(), page
    links = "<a href=1>Some other story of the day</a> " * 5
    assert main_text(f'<article><p>{LONG}</p><div class="share-price"><p>{links}</p></div></article>') == LONG.strip()
    assert main_text(f'<div class="page-widget-area"><div class="sidebar-left"><p>{LONG}</p></div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div>').startswith("Head")


def test_comments_of_readers_without_names():
    comments = f"<section><h3>3 comments</h3><ol><li><p>{LONG}</p></li><li><h4>Ann</h4><p>{LONG}</p></li></ol></section>"
    for page in (f"<article><h1>Head</h1><p>{LONG}</p></article>{comments}<footer>x</footer>", f"<div><h1>Head</h1><p>{LONG}</p>{comments}</div>", f"<article><h1>Head</h1><p>{LONG}</p>{comments}</article>"):
        assert main_text(page) == f"Head\n{LONG.strip()}"
    assert main_text(f"<article><h2>Comments on the treaty</h2><p>{LONG}</p></article>") == f"Comments on the treaty\n{LONG.strip()}"
    assert main_text(f"<h3>Comments</h3><article><p>{LONG}</p></article>") == LONG.strip()


def test_pages_without_names_and_containers(spark, sf):
    """Neither class names, ids and roles nor container tags: the densities and the neighbours alone."""
    right = total = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        want = main_text(r.html).split("\n")
        bare = re.sub(r"\s(?:class|id|role|itemprop)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", r.html)
        got = main_text(re.sub(r"<(/?)(article|main|nav|footer|header|aside|section|form)\b", r"<\1div", bare)).split("\n")
        total += len(set(want) | set(got))
        right += len(set(want) & set(got))
    assert right / total >= 0.9, right / total
