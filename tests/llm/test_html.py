import random

import pytest

from sumfold.llm import html


@pytest.mark.parametrize(
    "page,text",
    [
        (None, None), ("", ""), ("plain & simple", "plain & simple"), ("<p>one<p>two", "one\n\ntwo"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=3><li>x</li><li>y</ol>", "3. x\n4. y"), ("a<br>b", "a\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a <b> b </b> c", "a b c"),
        ("<head><title>t</title></head><body>x<script>if (a<b) '</p>'</script>y<style>p{}</style>", "xy"), ("<p hidden>a</p><p style='display: none'>b</p><p>c</p><input type=hidden value=d>", "c"),
        ("<table><tr><th>name<th>n<tr><td>apple<td>1<tr><td>fig<td>22</table>", "name   n\napple  1\nfig    22"), ("<pre>a\n  b</pre>", "a\n  b"), ("&lt;b&gt; &amp; &eacute; &#8364;", "<b> & é €"),
        ("<!-- x --><p>y<!-- z -->", "y"), ("a < b <", "a < b <"), ("<a href='x>y'>link</a>", "link"), ("<a href=\"x>link</a><p>z", "link\n\nz"), ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"), ("<table><tr><td colspan=2>a long title<td>z<tr><td>b<td>c<td>d</table>", "a long title  z\nb  c          d"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"), ("<table><tr><td colspan=900>a<td>b<tr><td>c</table>", "a  b\nc"), ("<ol start=--5><li>x</ol>", "1. x"), ("<ol start=-2><li>x<li>y</ol>", "-2. x\n-1. y"),
        ("İ" * 10 + "<script>x</script>after", "İ" * 10 + "after"), ("İ<style>p</STYLE >a<title>t</title>b", "İab"), ("a<script>'</scripts>'</script>b", "ab"), (f"&#{'9' * 5000};&#{'0' * 5000}65;", "\ufffdA"),
        (f"<ol start={'9' * 5000}><li>x</ol><table><tr><td colspan={'9' * 5000}>y</table>", "1. x\n\ny"),
        ("<h1>T</h1>body<h2>U</h2>", "T\n\nbody\n\nU"), ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na  b"), ("<select><option>no</select>yes", "yes"), ("<p>unfinished <b", "unfinished"),
    ],
)
def test_rendering(page, text):
    assert html.extract(page) == text


def test_deep_nesting_and_long_pages():
    assert html.extract("<div>" * 20_000 + "x") == "x"
    assert html.extract("<b>" * 5000 + "y" + "</b>" * 5000) == "y"
    assert html.extract("<p>word " * 20_000).count("word") == 20_000


@pytest.mark.parametrize("opened", ["<ul><li>", "<table><tr><td>", "<ol><li><table><tr><td>", "<div>", "<p><b>", "<dl><dd>", "<blockquote>"])
def test_no_depth_is_too_deep(opened):
    assert html.extract(opened * 20_000 + "end").split()[-1] == "end"
    assert html.extract(opened * 5000 + "x" + "</i>" * 20_000 + " y").split()[-2:] == ["x", "y"]


@pytest.mark.parametrize("tag", sorted(html.RAW))
def test_raw_elements_end_where_they_end(tag):
    assert html.extract("İ" * 10 + f"<{tag}>q</{tag.upper()}> after").endswith("after")


def block(rng, depth):
    """A random part of a page as (html, lines, spaced): the lines are found from the structure, not from the html."""
    words = lambda: " ".join(rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(rng.randint(1, 4)))
    kind = rng.choice(["p", "div", "h2", "ul", "ol", "table", "pre"] if depth else ["p", "div", "h2"])
    if kind in ("p", "h2"):
        s = words()
        return f"<{kind}>{s}" + (f"</{kind}>" if kind == "h2" or rng.random() < 0.5 else ""), [s], True
    if kind == "pre":
        rows = [" " * rng.randint(0, 3) + words() for _ in range(rng.randint(1, 3))]
        return "<pre>" + "\n".join(rows) + "</pre>", rows, True
    if kind == "div":
        if not depth or rng.random() < 0.4:
            s = words()
            return f"<div>{s}</div>", [s], False
        inner = [block(rng, depth - 1) for _ in range(rng.randint(1, 3))]
        return "<div>" + "".join(h for h, _, _ in inner) + "</div>", joined(inner), "inner"
    if kind in ("ul", "ol"):
        items, lines = [], []
        for i in range(rng.randint(1, 3)):
            inner = [block(rng, depth - 1) for _ in range(rng.randint(1, 2))]
            items.append("<li>" + "".join(h for h, _, _ in inner))
            got = [s for s in joined(inner) if s]
            lead = "- " if kind == "ul" else f"{i + 1}. "
            lines += [lead + got[0], *(" " * len(lead) + s for s in got[1:])]
        return f"<{kind}>" + "".join(items) + f"</{kind}>", lines, True
    rows = [[block(rng, depth - 1) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{h}</td>" for h, _, _ in row) for row in rows) + "</table>"
    wide = [max((len(s) for row in rows if j < len(row) for s in joined([row[j]])), default=0) for j in range(3)]
    lines = []
    for row in rows:
        cells = [joined([c]) for c in row]
        for i in range(max(map(len, cells))):
            lines.append("  ".join((c[i] if i < len(c) else "").ljust(wide[j]) for j, c in enumerate(cells)).rstrip())
    return page, lines, True


def joined(parts):
    out, due = [], False
    for _, lines, spaced in parts:
        if out and (due or spaced is True):
            out.append("")
        out += lines
        due = spaced is True
    return out


def test_random_pages_equal_an_independent_rendering():
    rng = random.Random(4)
    for _ in range(400):
        parts = [block(rng, 3) for _ in range(rng.randint(1, 4))]
        page = "".join(h for h, _, _ in parts)
        squeezed = lambda lines: [s for s in lines if s]
        assert squeezed(html.extract(page).split("\n")) == squeezed(joined(parts)), page


def test_all_visible_words_are_kept():
    words = [f"w{i}" for i in range(300)]
    tags = ["p", "div", "li", "td", "span", "b", "h2", "section", "tr", "table", "ul", "blockquote"]
    page = "".join(f"<{tags[i % len(tags)]}>{w} " for i, w in enumerate(words))
    assert sorted(html.extract(page).replace("- ", "").split()) == sorted(words)


def test_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "old"), (1, "u", "<p>a", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    assert [r.text for r in html.extracted(pages).orderBy("page_id").collect()] == ["a", "a", None]
    assert html.extracted(pages.limit(0)).collect() == []
