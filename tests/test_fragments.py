"""Pages made safe: what runs, loads or leads astray is gone, whatever the way it is written."""

import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions.links import classified, web_address
from gleanery.operators.fragments import LOADING, REMOVED, Fragment, label_of, previewed

WEB = 'target="_blank" rel="noopener noreferrer" referrerpolicy="no-referrer"'
CASES = {
    "<p>one<p>two": "<p>one</p><p>two</p>",
    "<ul><li>a<li>b<ul><li>c</ul></ul>": "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>",
    "<dl><dt>a<dd>b<dt>c</dl>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>",
    "<table><tr><td>a<td>b<tr><td>c</table>d": "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>d",
    "a<script>x='</p>'</script >b": "ab",
    "a<SCRIPT/x>1</sCrIpT\n>b": "ab",
    "a<style>p{}</style><textarea><b></textarea>b": "ab",
    "<p onclick=x() style='a' class=k id='1'>t</p>": '<p class="k" id="1">t</p>',
    "<img src=x onerror=y>after": "after",
    "<object><p>a</div><object>b</object></object>c": "c",
    "<form><p>a</p></form>b": "b",
    "<div><form>a</div>b": "<div></div>b",
    "<video>a": "",
    "<!-- a --><b>c<!-->d</b>": "<b>cd</b>",
    "<!DOCTYPE html><html><head><title>T</title><meta charset=x></head><body> x</body></html>": " x",
    "<p>x</b>y</i></p></p>": "<p>xy</p>",
    "1 < 2 &amp; 3 &lt;b&gt;": "1 &lt; 2 &amp; 3 &lt;b&gt;",
    "a<br>b<hr/>c": "a<br>b<hr>c",
    "<a href=' #top '>x</a>": '<a href="#top">x</a>',
    "<a href='/rel' target=x>x</a>": '<a aria-disabled="true">x</a>',
    "<a href='java\nscript:x'>x</a>": '<a aria-disabled="true">x</a>',
    "<a href='jav&#x61;script&colon;x'>x</a>": '<a aria-disabled="true">x</a>',
    "<a>x<a>y": '<a aria-disabled="true">x</a><a aria-disabled="true">y</a>',
    "<a class=k href='HTTP://EX.org:80/a/../b?x=1&copy=2&amp;y=3'>x</a>": f'<a class="k" href="http://ex.org/b?x=1&amp;copy=2&amp;y=3" {WEB}>x</a>',
    "<svg><use xlink:href='#a'></use></svg>": "<svg><use></use></svg>",
    "<x\"y>a</x\"y>b": "b",
    "<p title=\"a<b>&quot;\">t": '<p title="a&lt;b&gt;&quot;">t</p>',
    "<p title=\"never closed>t<script>": "",
    "<xmp><script>a</script></xmp>": "&lt;script&gt;a&lt;/script&gt;",
    "<plaintext><b>": "&lt;b&gt;",
    "<area href=javascript:x><svg><use href='#a'></use></svg>": '<area><svg><use href="#a"></use></svg>',
    "": "",
}


@pytest.mark.parametrize("html", CASES)
def test_fragments(html):
    assert Fragment(html).safe == CASES[html]


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, dict(attrs)))
        if tag not in ("area", "br", "col", "hr", "wbr"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag


PIECES = st.sampled_from(["<p>", "<a href='http://x.y/?q'", "<a href=javascript:x>", "<script>", "</script>", "<!--", "-->", "<object>", "</object>", "<form>", "</div>", "<div onload=x", ">", '"', "'", "<td>", "<table>", "</table>", "&lt;", "<", "=", "on", " style=x ", "<img src=x ", "<textarea>", "</textarea", "text", "<li>", "</", "<svg/onload=x>", "<b", "<plaintext>", "\0", "<title>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_nothing_unsafe_is_left(html):
    safe = Fragment(html).safe
    reader = Reader()
    reader.feed(safe)
    reader.close()
    assert not reader.open
    for tag, attributes in reader.found:
        assert tag not in REMOVED and not any(n.startswith("on") or n == "style" or n in LOADING for n in attributes)
        assert re.match("https?://|#", attributes.get("href", "#"))
    assert Fragment(safe).safe == safe


def test_large_pages_take_linear_time():
    for piece in ("<a ", "<!--", "<b>", "<div><object><b></div>", "</x>", "<p title='", "&", "<textarea>", "<table><td></p>"):
        began = time.perf_counter()
        Fragment(piece * 40_000)
        assert time.perf_counter() - began < 20


def test_links(spark):
    html = "<a href='https://b.org'> one\n two </a><a href=https://b.org/>again</a><a href='#x'>no</a><a href='http://a.org/&auml;'><img></a><form><a href=http://c.org>in <script>s</script>a form</a></form>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<a href=http://c.org>" + "\U0001f600" * 150)], "id int, html string").select("id", previewed(F.col("html")).alias("p")).collect()
    found = {r.id: r.p and [tuple(x) for x in r.p.links] for r in rows}
    assert found[1] == [("https://b.org/", "one two"), ("http://a.org/%C3%A4", "http://a.org/%C3%A4"), ("http://c.org/", "in sa form")]
    assert found[2] is None and found[3] == [] and found[4] == [("http://c.org/", "\U0001f600" * 100)]
    assert label_of(["x" * 199, "\U0001f600"], "") == "x" * 199


def test_addresses():
    cases = {
        "http://a.b": "http://a.b/", "https:a.b/c": "https://a.b/c", "http:\\\\a\\b": "http://a/b", "http://A.B:443/%2e%2E/x/./y/..": "http://a.b:443/x/", "https://a:443?q=' '#f `": "https://a/?q=%27%20%27#f%20%60", "http://u:p@h/": "http://u:p@h/",
        "http://bücher.example/ä b": "http://xn--bcher-kva.example/%C3%A4%20b", "http://": None, "http://a:99999/": None, "http://a b/": None, "ftp://a/": None, "//a/b": None, "a": None, "http://[::1]:80/": "http://[::1]/",
    }
    assert {k: web_address(k) for k in cases} == cases
    assert classified("#a b") == ("blocked", None) and classified(None) == ("blocked", None) and classified("mailto:x@y") == ("blocked", None)


def test_query_of_safe_fragments(spark):
    import pandas as pd

    from gleanery.plans.catalogue import queries

    folder = "/root/testdata/sf0.001"
    pages = pd.read_parquet(f"{folder}/pages.parquet")
    found = {r.page_id: (r.safe, r.links) for r in queries()["safe_fragments"](spark, folder).collect()}
    assert set(found) == set(pages.page_id)
    for page in pages.itertuples():
        host = re.match("https?://[^/?#]*", page.url)[0]
        made = Fragment(page.html.replace('href="/', f'href="{host}/'))
        safe, links = found[page.page_id]
        assert safe == made.safe and links == len(made.links) == len(set(re.findall('href="/([^"]*)', page.html)))
        assert "track(" not in safe and "margin" not in safe and safe.startswith("<nav>") and safe.endswith("</footer>")


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_safe_body_stays_as_it_is(html):
    """Within a body, where the preview puts it; alone, white space and titles that come first would count to the head."""
    safe = Fragment(html).safe
    assert Fragment(f"<body>{safe}</body>").safe == safe


def test_head_ends_at_a_removed_element():
    assert Fragment("<img src=x ><title>t</title>").safe == "<title>t</title>" and Fragment("<title>t</title>").safe == ""
    assert Fragment("<img src=x <p> style=x ").safe == " style=x " and Fragment(" style=x ").safe == "style=x "
