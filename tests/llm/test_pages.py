"""WARC bundles and page text."""

import base64
import hashlib

from augmill.llm import html_text, warc
from augmill.llm.common import shared_path


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, key string")


def test_round_trip_revisits_and_seeks(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, None), (3, "u", ""), (4, "http://b", "<p>x</p>"), (5, "v\r\nEvil: 1", "é\r\n\r\nWARC/1.1 " * 40_000),
            (None, "w", "<p>x</p>"), (6, "r", "rep"), (6, "r", "rep")]
    path = shared_path(spark, "test-warc")
    warc.write_bundles(pages(spark, rows), path)
    got = warc.read_records(spark, path).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), len((h or "").encode()), digest(h)) for i, _, h in rows)
    kind = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kind == {1: ("revisit", 4), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None),
                    None: ("response", None), 6: ("response", None)}
    content = {r.name: bytes(r.content) for r in spark.read.parquet(path).collect()}
    for r in warc.read_index(spark, path).collect():
        head, block = warc.read_record(content[r.name], r.frame, r.offset)
        assert head["WARC-Record-ID"] == r.record_id
        assert r.page_id == 6 or warc.record_index(content[r.name])[r.record_id] == (r.frame, r.offset, r.length)
        assert head["WARC-Type"] == "revisit" or f"sha1:{base64.b32encode(hashlib.sha1(block.partition(b'\r\n\r\n')[2]).digest()).decode()}" == head["WARC-Payload-Digest"]
    empty = shared_path(spark, "test-warc")
    warc.write_bundles(pages(spark, []), empty)
    assert warc.read_records(spark, empty).count() == 0


def test_small_payloads_stay_responses(spark):
    path = shared_path(spark, "test-warc")
    warc.write_bundles(pages(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]), path, min_revisit_bytes=5)
    assert {r.page_id: r.refers_to for r in warc.read_records(spark, path).collect()} == {1: None, 2: None, 3: 4, 4: None}


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies, ok? Yes, really, and a long text.</div><nav><a href=/x>Menu</a></nav>
<div class="content"><h2>Title</h2><p>First   paragraph, with words &amp; marks; more of it,<br>and more.<p>Short.
<ul><li>One, item.<li>Two, item</ul><p>Second long paragraph, it goes on, and on, and on.</p></div>
<div id="sidebar"><p>Side, stuff, here, there.</p></div><section class="comments"><p>Nice article, thanks! I liked it, a lot.</p></section>
<form><p>Sign up, now.</p></form><footer>(c)</footer></body></html>"""


def test_nothing_but_boilerplate_is_dropped():
    prose = lambda n, w: "".join(f"<p>{w} {k}, a sentence; and some more words, it goes on, here.</p>" for k in range(n))
    has = lambda html, *words: [w in html_text.extract(html)[0] for w in words]
    nested = f"<body><nav>Menu</nav><article><h1>Head</h1><section>{prose(6, 'one')}</section><section>{prose(4, 'two')}</section></article></body>"
    assert has(nested, "Head", "one 5", "two 3", "Menu") == [True, True, True, False]
    assert has(nested.replace("article", "div"), "Head", "one 5", "two 3", "Menu") == [True, True, True, False]
    items = "".join(f"<li>item {k}, which is long; it has words, marks, and more.</li>" for k in range(9))
    assert has(f"<article><h1>Head</h1><p>Lead, a sentence.</p><ul>{items}</ul><p>End, another.</p></article>", "Head", "Lead", "item 8", "End") == [True] * 4
    side = f"<div class=sidebar>{prose(1, 'side')}</div>"
    for tag in ('div class="layout with-sidebar"', "form action=x", 'form class="login" method=post'):
        page = f"<body><{tag}><h1>Head</h1>{prose(8, 'text')}{side}</{tag.split()[0]}><footer>(c)</footer></body>"
        assert has(page, "Head", "text 7", "side", "(c)") == [True, True, False, False]
    # long comments under a short article are comments still
    assert has(f"<body><article>{prose(2, 'text')}</article><div class=comments>{prose(9, 'reply')}</div></body>", "text 1", "reply") == [True, False]


def test_article_without_boilerplate(spark):
    text = ("Title\n\nFirst paragraph, with words & marks; more of it, and more.\n\nShort.\n\nOne, item.\n\nTwo, item\n\n"
            "Second long paragraph, it goes on, and on, and on.")
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>only</p>"), (None, "x", "bare text, no tags"), (5, "y", "<script>x</script>"),
            (6, "z", "<article>" + "<p>" + "long, " * 50_000 + "</article>"), (7, "q", '<a href="unclosed>x</a><p>y</p>')]
    got = {r.page_id: r for r in html_text.extract_pages(pages(spark, rows)).collect()}
    assert got[1].text == text and got[1].n_chars == len(text)
    assert [got[k].text for k in (2, 3, 4, 5)] == ["", "", "only", ""] and got[None].text == "bare text, no tags"
    assert got[6].n_chars == 300_000 - 1
    assert html_text.extract_pages(pages(spark, [])).count() == 0
