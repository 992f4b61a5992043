"""WARC archives and main-text extraction."""

import random

import brute
from pyspark.sql import functions as F

from stockroom.llm import html_extract as H
from stockroom.llm import warc


def _pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumn("captured", F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))) \
             .withColumn("archive", F.lit(1)).withColumn("payload", F.lit("x"))


PAGES = [(1, "http://www.A.com/x?q=1", "<p>é</p>\r\n\r\nWARC/1.0\r\n"), (2, "http://a.com/", None), (3, None, ""),
         (4, "http://b.org/two\r\nlines: x", "same"), (9, "http://b.org/z", "same"), (5, "http://b.org/z", "same"),
         (6, "not a url [", "x" * 200_000), (7, "", "🙂")]


def test_archives_read_back(spark, tmp_path):
    pages = _pages(spark, PAGES)
    path = warc.write_archives(pages.repartition(3), f"file://{tmp_path}/w")
    rows = warc.read_archives(spark, path, payloads=True).collect()
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    want = sorted(brute.warc([(p, h) for p, _, h in PAGES]))
    assert got == want
    text = {p: (h or "").encode() for p, _, h in PAGES}
    assert all(bytes(r["payload"]) == text[r["page_id"]] for r in rows if r["record_type"] == "response")
    assert all(r["payload"] is None for r in rows if r["record_type"] == "revisit")


def test_least_bytes_and_null_ids(spark, tmp_path):
    pages = _pages(spark, [*PAGES, (None, "http://c.com", "same"), (9, "http://b.org/z", "same")])
    path = warc.write_archives(pages, f"file://{tmp_path}/w", least_bytes=100)
    assert warc.read_archives(spark, path).filter("record_type = 'revisit'").count() == 0
    path = warc.write_archives(pages, f"file://{tmp_path}/v")
    rows = warc.read_archives(spark, path).filter("payload_bytes = 4 AND payload_digest = '" + brute.digest32(b"same") + "'").collect()
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in rows)
    assert got == [(-1, "revisit", 9), (4, "revisit", 9), (5, "revisit", 9), (9, "response", None), (9, "response", None)]


def test_index_is_globally_ordered(spark):
    rng = random.Random(9)
    pages = _pages(spark, [(i, f"http://h{rng.randint(0, 5)}.com/{rng.randint(0, 9)}", f"t{i % 70}") for i in range(300)])
    out = warc.capture_history(pages.repartition(5)).withColumn("part", F.spark_partition_id()).collect()
    keys = [(r["url_key"], r["captured"]) for r in out]
    assert len(keys) == 300 and keys == sorted(keys)


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(10)
    for k in range(0, 12):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_no_pages(spark):
    empty = _pages(spark, []).limit(0)
    assert warc.capture_history(empty).count() == 0
    assert H.main_text(empty).count() == 0


def _page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>{body}</body></html>"


def test_wrapper_without_article_element():
    pages = [_page(f"""<header class="site-header"><a href=/>My Site</a></header><div class="cookie-notice">We use cookies {i}</div>
<div id="menu"><a href=a>A{i}</a> <a href=b>B</a></div>
<div id="content" class="main-content with-sidebar"><h1>Title {i} &amp; more</h1><p>First   para {i}<br>line&nbsp;x<p>Second <b>bold</b>
<a href=x>link</a>.<div class="share-box">Share this</div><ul><li>item {i}<li>two</ul></div>
<div class="sidebar"><ul><li><a href=q>Related {i}</a></ul></div><section id="comments"><article class="comment"><p>Nice {i}</p></article></section>
<form>Mail <p>Subscribe {i}</p></form><div>Copyright, constant</div><footer>foot {i}</footer>""") for i in range(8)]
    want = "Title 3 & more\nFirst para 3 line x\nSecond bold link.\nitem 3\ntwo"
    assert H.texts_of_group(pages)[3] == want


def test_article_keeps_shared_paragraphs_and_drops_boxes():
    pages = [_page(f"""<nav>m{i}</nav><main><article><header><h1>T {i}</h1></header><p>A {i}</p><p>Shared paragraph</p>
<div class="ad">ad {i}</div><div>Constant box</div><aside>x</aside><p>last {i}</article>
<section class=comments><article>c {i}</article></section></main><footer>f</footer>""") for i in range(6)]
    assert H.texts_of_group(pages)[0] == "T 0\nA 0\nShared paragraph\nlast 0"


def _plain(i):
    return _page(f"<div id=top>Constant top</div><div id=content><h1>Title {i}</h1><p>First {i}<p>Second {i}</div><div>Copyright</div>")


def test_copies_keep_their_text_without_article_element():
    one = _page("<div><h1>Copied</h1><p>Its only text</div>")
    assert H.texts_of_group([one] * 6) == ["Copied\nIts only text"] * 6
    # copies whose menus differ are copies too
    menus = [one.replace("<body>", f"<body><nav>Menu {i}</nav>") for i in range(6)]
    assert H.texts_of_group(menus) == ["Copied\nIts only text"] * 6
    # and so are copies among other pages, few or most of the group
    for others in (1, 8):
        got = H.texts_of_group([*[one] * 6, *[_plain(i) for i in range(others)], *menus])
        assert got[:6] == got[-6:] == ["Copied\nIts only text"] * 6
    # the template of the other pages is found as without copies
    want = [f"Title {i}\nFirst {i}\nSecond {i}" for i in range(8)]
    assert H.texts_of_group([_plain(i) for i in range(8)]) == want
    assert H.texts_of_group([*[_plain(3)] * 30, *[_plain(i) for i in range(8)]])[30:] == want
    # copies alone don't make a template, however many
    assert "Copyright" in H.texts_of_group([_plain(0), _plain(1), *[_plain(2)] * 30])[0]


def test_copies_keep_their_text_in_article_boxes():
    one = _page("<nav>n</nav><article><div class=body><h1>Copied</h1><p>Its only text</div><div>Box</div></article>")
    other = [_page(f"<nav>n</nav><article><div class=body><h1>T {i}</h1><p>x {i}</div><div>Box</div></article>") for i in range(6)]
    assert H.texts_of_group([one] * 6) == ["Copied\nIts only text\nBox"] * 6
    assert H.texts_of_group([*[one] * 6, *other])[:7] == ["Copied\nIts only text"] * 6 + ["T 0\nx 0"]


def test_article_keeps_boxes_of_shared_prose():
    pages = [_page(f"""<article><h1>T {i}</h1><div class=body><div><p>Shared paragraph</div></div><div>Constant box</div>
<div><ul><li><a href=a>Share</a><li><a href=b>Print</a></ul></div></article>""") for i in range(6)]
    assert H.texts_of_group(pages)[0] == "T 0\nShared paragraph"


def test_simple_tree_matching_counts_pairs():
    def tree(label, *children):
        x = H.Outline(label, None)
        x.children = list(children)
        return x
    a = tree("div", tree("p"), tree("ul", tree("li"), tree("li")), tree("b"))
    b = tree("div", tree("ul", tree("li")), tree("p"), tree("b"))
    assert H.match(a, b, {}) == 4  # div, ul, li, b
    assert H.match(a, tree("p"), {}) == 0


def test_odd_markup():
    cases = {"": "", "plain text": "plain text", "<p>a<p>b": "a\nb", "<<>< a < b &lt; &#233;": "<<>< a < b < é",
             "<article>un<b>closed": "unclosed", "<p>a<!-- unclosed <p>b": "a", "x<script>y": "x",
             "<p title=\"a>b\">q</p>": "q", "<div hidden>h</div>v": "v", "<table><tr><td>a<td>b</table>": "a\nb",
             "<div>" * 3000 + "deep" + "</div>" * 3000: "deep", "<ul><li><a href=x>only links</a></ul>text": "text"}
    for page, want in cases.items():
        assert H.texts_of_group([page]) == [want], page[:60]


def test_main_text_of_every_row(spark):
    rows = [(i, f"http://h{i % 3}.com/{i}", _page(f"<nav>n</nav><article><h1>T{i}</h1><p>x {i}</article>")) for i in range(200)]
    rows += [(None, None, None), (5, "http://h2.com/5", rows[5][2]), (900, "nonsense", "<p>a")]
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["text"]) for r in H.main_text(_pages(spark, rows)).collect())
    want = sorted([(i, f"T{i}\nx {i}") for i in range(200)] + [(-1, ""), (5, "T5\nx 5"), (900, "a")])
    assert got == want


def test_article_text_of_the_small_table(spark):
    """Every page of the test table: the article's blocks, cut out by a pattern."""
    import html
    import re
    from stockroom.llm.queries import queries
    got = {r["page_id"]: r for r in queries()["op8_html_extract"](spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split())
                  for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)
