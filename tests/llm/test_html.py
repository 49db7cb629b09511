import random
import time
from html.parser import HTMLParser

import pytest

from cardweave.llm.html import UNSEEN, VOID, extract, extract_pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>One<p>Two<br>lines", "One\n\nTwo\nlines"),
        ("<title>No</title><body>a <b>b</b>c\n d</body>", "a bc d"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>after", "- a\n- b\n  3. x\n  4. y\n- c\n\nafter"),
        ("<table><tr><td>a<td>long cell<tr><th>bbb<td>c</table>", "a    long cell\nbbb  c"),
        ("<table><caption>T</caption><tr><td colspan=2>wide one<td>z<tr><td>1<td>2<td>3</table>", "T\nwide one  z\n1  2  3"),
        ("<pre>\n a  b\n  c</pre><p>x", " a  b\n  c\n\nx"),
        ("<div hidden>no</div><div style='DISPLAY : none'>no<p>no</div><span style='visibility:hidden'>no</span>yes", "yes"),
        ("<script>var t='</p>';if(a<b)x()</script>a&amp;b &lt;i&gt; &eacute;", "a&b <i> é"),
        ("<!-- no <p> -->x<![CDATA[y]]>", "xy"),
        ("</p>x</div></b>y", "xy"),
        ("<h1>T</h1><div>a</div><div>b</div><p>c", "T\n\na\nb\n\nc"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("a < b <p title='>'>c", "a < b\n\nc"),
        ("<p><b>x<br><p>y", "x\n\ny"),
        ("<table><tr><td rowspan=2>ab<td>c<td>d<tr><td>e<td>f<tr><td>g<td>h<td>i</table>", "ab  c  d\n    e  f\ng   h  i"),
        ("<table><tr><td>a<td rowspan=3>bb<td>c<tr><td>d<td>e<tr><td colspan=3>f</table>", "a  bb  c\nd      e\nf"),
        ("<table><tr><td>" + "x" * 90 + "<td>b<tr><td>c<td>d</table>", "x" * 90 + "  b\n" + "c" + " " * 91 + "d"),
        ("<select><option>a<option>b</select><object>o</object><svg><title>no</title><text>t</text></svg><math><mi>m</mi></math>", "a\nb\notm"),
        ("<table><tr><td><span>a<span>b</div></div>c</td></tr></table>d", "abc\n\nd"),
        ("<div", ""), ("", ""), (None, ""), ("<p>unclosed <a href='x", "unclosed"),
    ],
)
def test_layout(page, text):
    assert extract(page) == text


class Visible(HTMLParser):
    """All shown words in order, by another parser, for pages that close what they hide."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if self.hidden or tag in UNSEEN or any(k == "hidden" or (k == "style" and "display:none" in (v or "")) for k, v in attrs):
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_query_shows_the_words_that_another_parser_finds(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    got = extract_pages(pages).collect()
    assert len(got) == pages.count()
    squeeze = lambda s: "".join(s.split())
    for r in got:
        v = Visible()
        v.feed(raw[r["id"]])
        v.close()
        want = squeeze("".join(v.words))
        have = squeeze(r.text)
        if "<li>" in raw[r["id"]]:
            want, have = want.replace("-", ""), have.replace("-", "")
        assert have == want


def test_garbage_never_fails():
    rnd = random.Random(8)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<b", ">", "'", '"', "<!--", "-->", "text ", "&amp", "&#x0;", "<script>", "</script>", "<pre>", "</pre>", "<style", "<td colspan=99999>", "<select><option>a", "</select>", "<head>", "<body>", "</body>", "<svg><p>"]
    for _ in range(1500):
        extract("".join(rnd.choices(bits, k=rnd.randrange(1, 40))))
    assert extract("<div>" * 50000 + "deep") == "deep"
    assert extract("<p>" + "word " * 50000).count("word") == 50000
    extract("<" * 20000)
    extract('<a b="' * 3000)
    extract("<ul><li>" * 3000 + "x")


def grown(make, n):
    """Output and seconds of a page of twice the size, against one of n."""
    out = []
    for k in (n, 2 * n):
        start = time.perf_counter()
        text = extract(make(k))
        out.append((len(text), time.perf_counter() - start))
    (a, s), (b, t) = out
    return b / max(a, 1), t / max(s, 0.05)


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<ul><li>x" * n,
        lambda n: "<blockquote>q" * n,
        lambda n: "<div><table><td>" + "<span>" * n + "</div>" * n + "end",
        lambda n: "<table>" + "<tr><td>a<td rowspan=65534>b" * n + "</table>",
        lambda n: "<table><tr>" + "<td rowspan=65534>b" * n + "<tr><td>x" * n + "</table>",
        lambda n: "<table><tr><td>" + "w" * 8 * n + "<td>b" + "<tr><td>c<td>d" * n + "</table>",
        lambda n: "<table>" + "<tr><td colspan=1000 rowspan=9>a" * n + "</table>",
        lambda n: "<li>x<p>" * n,
        lambda n: "<" + "a" * 8 * n,
        lambda n: "<a" * 4 * n,
        lambda n: "<a b='" * n,
    ],
)
def test_time_and_output_are_linear(make):
    size, seconds = grown(make, 6000)
    assert size < 2.5 and seconds < 3.5


def test_clashing_names(spark):
    rows = [(1, "<p>a", "x", "x", "x"), (2, None, None, "y", "y")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, html string, id string, text string, url string")).collect()
    assert sorted((r["id"], r.text) for r in got) == [(1, "a"), (2, "")]


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, None, "<p>b"), (3, "", "")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, text string, html string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "a"), (1, "a"), (2, ""), (None, "b"), (3, "")]))
    assert extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0
