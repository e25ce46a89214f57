import pytest

from markscope.llm.html_blocks import page_blocks
from markscope.llm.html_extract import extract, fit

from llm.conftest import SF


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("plain  text", ["plain text"]), ("<p>a<b>b</b>\n c<p>d", ["ab c", "d"]),
    ("<script>x<y</script><p>&amp;&#65;&nbsp;z", ["&A z"]), ("<!-- <p>no</p> --><p>yes", ["yes"]),
    ("<div>a<br>b</div>", ["a", "b"]), ("<p>open <a href='>'>link</a> end", ["open link end"]),
    ("<style>p{}", []), ("<![CDATA[1 < 2]]>", ["1 < 2"]),
])
def test_blocks(page, want):
    assert [b.text for b in page_blocks(page)] == want


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>x</title><body><article><p>a<p>b</article>", ["a", "b"]),
    ("<head><meta charset=x><link href=y><title>x</title><p>a", ["a"]), ("<head><title>x</title><b>a</b>", ["a"]),
    ("<head><title>x <b>y</b></title><body>a", ["a"]), ("<head><script>x</script><style>y</style></head>a", ["a"]),
])
def test_head_without_end_tag(page, want):
    assert [b.text for b in page_blocks(page)] == want


@pytest.mark.parametrize("page, want", [
    ("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>f", [("a", 2), ("b", 2), ("c", 4), ("d", 2), ("e", 2), ("f", 0)]),
    ("<table><tr class=ad><td>x<td>y<tr><td>z</table>", [("x", 4), ("y", 4), ("z", 3)]),
    ("<dl><dt>a<dd>b<dt>c</dl>", [("a", 2), ("b", 2), ("c", 2)]),
    ("<a href=http://x/>link</a> t", [("link t", 0)]), ("<div/>a</div>b", [("a", 1), ("b", 0)]),
    ("a < b <3 <p>c <", [("a < b <3", 0), ("c <", 1)]), ("<p title=\"a>b\">c", [("c", 1)]),
    # a quote that is never closed is no quote
    ("<p title='x>y", [("y", 1)]), ("<p>a<b title=\"x>y</b>z", [("ayz", 1)]),
])
def test_implied_ends_and_broken_tags(page, want):
    got = [(b.text, len(b.path)) for b in page_blocks(page)]
    assert got == want


def test_time_in_proportion():
    import time
    for unit in ("<li>x", "<a title=\"x ", "<a '\"", "<!x ", "<", "<p class='", "<td>x", "</a", "<a b='\" c=\"'", "&#"):
        start = time.process_time()
        page_blocks(unit * 100_000)
        assert time.process_time() - start < 20, unit


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = fit(pages)
    body = "".join(f"<p>The river rose again on day {i}, and people watched it.</p>" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "<nav><a href='/'>Home</a></nav>"), (4, f"<html><body><article>{body}</article></body></html>"),
            (5, "<html><body><article><p>The river rose.</p><p>People watched it.</p></article><footer>All rights reserved</footer>"),
            (5, "<html><body><article><p>The river rose.</p><p>People watched it.</p></article><footer>All rights reserved</footer>")]
    odd = spark.createDataFrame([(i, h, 1, 2) for i, h in rows], "page_id long, html string, n_chars int, text int")
    got = extract(odd, model, ["page_id"]).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == by[2].text == "" and by[3].text == ""
    assert by[4].n_main == 20000
    assert by[5].text == "The river rose. People watched it." and by[5].n_chars == len(by[5].text)
    assert extract(odd.where("false"), model, ["page_id"]).count() == 0
    untrained = extract(odd, fit(odd.where("false")), ["page_id"])
    assert untrained.count() == 6


def test_articles_of_all_pages(spark):
    """Against the blocks inside ``article``; the names in the markup do not decide."""
    from pyspark.sql import functions as F
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    model = fit(pages)
    want = {r.page_id: " ".join(b.text for b in page_blocks(r.html) if "article" in b.path) for r in pages.collect()}
    got = {r.page_id: r.text for r in extract(pages, model, ["page_id"]).collect()}
    assert len(got) == len(want) and sum(got[i] == t for i, t in want.items()) >= 0.98 * len(want)
    bare = pages.withColumn("html", F.regexp_replace("html", """\\s(?:class|id|role)\\s*=\\s*("[^"]*"|'[^']*'|[^\\s"'>]+)""", ""))
    got = {r.page_id: r.text for r in extract(bare, model, ["page_id"]).collect()}
    assert sum(got[i] == t for i, t in want.items()) >= 0.98 * len(want)
