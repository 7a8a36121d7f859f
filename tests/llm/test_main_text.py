"""Main text against the article by hand, repeated substrings against all windows of a host."""

from __future__ import annotations

import random
import time

import pytest

from mercata.llm import main_text

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, **more):
    out = main_text.extract(spark.createDataFrame(rows, SCHEMA), **more).collect()
    return {r.page_id: (r.text, r.n_removed) for r in out}


def test_marked_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="main content">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li>B</ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use</div>
    <aside>Side</aside><div class='ad'>Buy</div><form><p>Mail</p><input value="x>y"></form>
    <article><header><h1>Head&shy;line &amp; more</h1></header><p><b>One&nbsp; two
    three<br>four<p>a &lt; b &amp;lt; c &am<p></p><ul><li>x<li>y</ul><p>Th<i>i</i>s <script>document.write("<p>")</script>is<div class="share social">Share</div>
    <section id="comments"><article><p>First!</p></article></section><p>End</article>
    <div class="comments"><p>Nice</p></div><footer>&copy; Site</footer></body>"""
    assert main_text.page_text(page, {}, 8)[0].split("\n") == [
        "Head\xadline & more", "One two three four", "a < b &lt; c &am", "x", "y", "This is", "End",
    ]
    for html in (None, "", "<", "<p", "</p></div>", "<!--", "<script>x", "&#0;"):
        main_text.page_text(html, {}, 8)
    assert main_text.page_text("plain <b>text</b> 1 < 2", {}, 8)[0] == "plain text 1 < 2"


def test_time_grows_with_the_page():
    for odd in ("<div>" * 30_000 + "</section>" * 30_000, '<a title="' * 30_000, "<!-" * 30_000, "<p>x" * 30_000, "<script>" * 30_000, "&amp" * 30_000):
        began = time.time()
        main_text.blocks(odd)
        assert time.time() - began < 5


def unmarked(spark, rows, depth):
    """What each page should keep: tokens of no window that another page of the host has (all pages are single-run)."""
    where = {}
    for _, host, html in rows:
        words = html.split()
        for i in range(len(words) - depth + 1):
            where.setdefault((host, tuple(words[i : i + depth])), set()).add(html)
    out = {}
    for page, host, html in rows:
        words = html.split()
        gone = set()
        for i in range(len(words) - depth + 1):
            if len(where[host, tuple(words[i : i + depth])]) > 1:
                gone |= set(range(i, i + depth))
        out[page] = (" ".join(w for i, w in enumerate(words) if i not in gone), len(gone))
    return out


@pytest.mark.parametrize("parts", [1, 9])
def test_repeats_of_a_host_go_and_unique_runs_stay(spark, parts):
    rnd = random.Random(parts)
    menu, notice = "home about news contact shop help", "we use cookies to make this site work"
    rows = []
    for page in range(60):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30))]
        body = " ".join([menu] * (page % 3 > 0) + words + [notice] * (page % 4 > 0))
        rows.append((page, f"h{0 if page < 40 else page % 3}.org", body))
    rows += [(100, "h0.org", rows[1][2]), (101, "h0.org", rows[1][2])]  # copies are one page
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = texts(spark, [(p, f"http://{h}/{p}", x) for p, h, x in rows], min_tokens=5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == unmarked(spark, rows, 5)


def test_an_article_keeps_what_other_pages_repeat(spark):
    quote = "to be or not to be that is the question whether"
    page = "<body><div>menu of the site with many many entries in it</div><article><p>{}</p><p>{}</p></article><div>unique {}</div></body>"
    got = texts(spark, [(i, "https://user@Host.org:80/x", page.format(quote, i, i)) for i in range(5)])
    assert got == {i: (f"{quote}\n{i}\nunique {i}", 10) for i in range(5)}


def test_odd_rows_columns_and_empty_tables(spark):
    rows = [(1, None, None), (1, None, None), (None, "no url", "<p>x"), (3, "http://a/b", ""), (4, "http://a/c", "<p>" + "long word " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS text", "7 AS host", "8 AS `a.b`", "9 AS run", "1 AS _repeats_")
    out = main_text.extract(df)
    assert out.columns == ["page_id", "url", "html", "host", "a.b", "run", "_repeats_", "text", "n_removed"]
    got = sorted(((r.page_id, r.text, r.host, r["a.b"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "", 7, 8), (1, "", 7, 8), (None, "x", 7, 8), (3, "", 7, 8), (4, ("long word " * 50_000).strip(), 7, 8)], key=str)
    assert main_text.extract(df.limit(0)).collect() == []
