"""HTML extraction: layout by example, and all visible words against the standard library's parser."""

import re
from html.parser import HTMLParser

import pytest

from seqscan.llm import html

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<p>a  \n b</p>c<b>d</b> e": "a b\n\ncd e",
    "<div>a</div><div>b<br>c</div>": "a\nb\nc",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>f": "- a\n- b\n  3. c\n  4. d\n- e\n\nf",
    "<ul><li><p>a</p><p>b</p></li><li></li></ul>": "- a\n\n  b",
    "<table><tr><th>name<th>n<tr><td>x<td>100<tr><td>longer</table>z": "name   | n\nx      | 100\nlonger\n\nz",
    "<table><td>a<br>b<td><table><td>in</table></table>": "a | in\nb",
    "<blockquote>a<br>b</blockquote>": "> a\n> b",
    "<pre>a  b\n c</pre>": "a  b\n c",
    "a<script>var t='</p>';x</script>b<style>p{}</style>": "ab",
    "<p hidden>a</p><p style='color:red; display:none'>b</p><span style='visibility: hidden'>c</span>d": "d",
    "<!-- x > y --><head><title>t</title></head><body>b</body>": "b",
    "<head><title>t</title><p>shown": "shown",
    "&lt;a&gt; &amp;&nbsp;&copy; &middot;": "<a> &\xa0© ·",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "</b></p>x</div>": "x",
    '<a title="a > b">t</a><a title=don\'t>u</a>': "tu",
    "<select><option>a<option>b</select>": "a\nb",
    "<textarea>a &lt; b</textarea><input type=hidden value=q>": "a < b",
    "<script>never ended": "",
    "<dl><dt>t<dd>d</dl>": "t\nd",
    "<table><tr><td rowspan=2>r<td>x<tr><td>y</table>": "r | x\n  | y",
    "<table><tr><td colspan=2>wide head<td>z<tr><td>a<td>b<td>c</table>": "wide head | z\na | b     | c",
    "<table><tr><td rowspan=0>r<td>1<tr><td>2<tr><td colspan=x>3</table>": "r | 1\n  | 2\n  | 3",
    "<table><tr><td>漢字<td>a<tr><td>abc<td>b</table>": "漢字 | a\nabc  | b",
    "<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>d": "b\nd",
    "<details><summary>s</summary>hidden</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "<div style='white-space: pre'>a  b\n c</div><pre style='white-space:normal'>a  b</pre>": "a  b\n c\n\na b",
    "<b>a<p>c</b>d</p>e": "a\n\ncd\n\ne",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert html.render(page) == CASES[page]


def test_deep_and_long():
    assert html.render("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert html.render("<p>word " * 20000).count("word") == 20000
    assert html.render("<ul><li>" * 500 + "x").endswith("- x")


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.depth -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.depth:
            self.words.append(data)


def test_all_visible_words_of_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html.op1(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        letters = lambda t: re.sub(r"[\s|-]|\d+\. ", "", t)
        assert letters(got[r.page_id]) == letters("".join(plain.words)), r.page_id
    assert len(got) == pages.count()


def test_odd_tables(spark):
    rows = [(1, None, "t"), (None, "<p>x", "t"), (2, "<p>x", "t"), (2, "<p>x", "t"), (3, "", "t")]
    docs = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html.op1(docs).collect()) == [("1", "", 0), ("2", "x", 1), ("2", "x", 1), ("3", "", 0), ("None", "x", 1)]
    assert html.op1(docs.limit(0)).collect() == []


def test_long_pages_in_linear_time():
    import time

    pages = {
        "spans to the end": "<tr><td rowspan=0>a" * 50_000,
        "spans aside": "<tr><td rowspan=9>a<td>b" * 40_000,
        "ends behind spans": "<div><table><tr><td>" + "<span>" * 80_000 + "</div>" * 80_000,
        "ends of blocks": "<table><tr><td><div>" + "<b>" * 150_000 + "</div>" * 80_000 + "</b>" * 10_000,
        "one wide cell": "<tr><td>" + "w" * 5000 + "<tr><td>" * 60_000 + "x<td>y" * 60_000,
    }
    for name, rows in pages.items():
        began = time.perf_counter()
        text = html.render(f"<table>{rows}</table>" if rows.startswith("<tr") else rows)
        assert time.perf_counter() - began < 20, name
        assert len(text) < 20 * len(rows), name


def test_tables_of_holes_are_told_without_columns():
    text = html.render("<table>" + "<tr><td rowspan=0>a" * 300 + "<tr><td>b<td>c</table>")
    assert text.splitlines() == ["a"] * 300 + ["b | c"]
    assert html.render("<table><tr><td rowspan=0>a<td>b<tr><td>cc</table>") == "a | b\n  | cc"


@pytest.mark.parametrize("head", ["<td>" + "w" * 5000 + "<td>z", "<td rowspan=0>h" * 40, "<td rowspan=0>h" * 400, "<td>" + "<td>".join(["w" * 50] * 200)])
@pytest.mark.parametrize("row", ["<td>a<td>bb", "<td colspan=3>c<td>d<br>e", "<td>" * 90 + "f"])
def test_layout_does_not_depend_on_how_many_rows_there_are(head, row):
    few, *more = (html.render("<table><tr>" + head + ("<tr>" + row) * n + "</table>").splitlines() for n in (2, 20, 2000))
    for n, lines in zip((20, 2000), more, strict=True):
        assert lines == few[:1] + few[1:] * (n // 2)


def test_lines_run_over_and_far_cells_move():
    assert html.render(f"<table><tr><td>{'w' * 90}<td><td>x<tr><td>abc<td>d<td>y</table>") == "w" * 90 + " |  | x\nabc | d | y"
    assert html.render(f"<table><tr>{'<td rowspan=0>h' * 200}<td>i<tr><td>ab<tr><td>c<td>d<tr><td>e<td>f</table>").splitlines()[1:] == ["ab", "c  | d", "e  | f"]


def test_cells_are_placed_as_slot_by_slot():
    import random

    def plain(rows):
        taken, out = {}, []
        for r, row in enumerate(rows):
            here, at, down = {}, 0, []
            for text, (wide, high) in row:
                while taken.get(at, 0) > r:
                    at += 1
                here[at] = (text, wide)
                down += [(c, r + (high or 1000)) for c in range(at, at + wide)]
                at += wide
            for c, last in down:
                taken[c] = max(taken.get(c, 0), last)
            out.append(here)
        return out

    pick = random.Random(1)
    for _ in range(3000):
        rows = [[("x", (pick.choice([1, 1, 1, 2, 7]), pick.choice([1, 1, 0, 2, 3, 9]))) for _ in range(pick.randint(0, 5))] for _ in range(pick.randint(1, 12))]
        assert html.placed(rows) == plain(rows)


def test_tables_take_room_by_their_text():
    import time

    n = 20_000
    tables = {
        "spans of all lengths": "<tr>" + "".join(f"<td rowspan={i * 7919 % n + 1}>h" for i in range(n)) + "<tr><td>x<td>y" * n,
        "wide and long spans": "<tr>" + "<td colspan=1000 rowspan=0>a" * n + "<tr><td>b<td>c" * n,
        "many cells and lines": "<tr>" + "<td>x" * n + "<td>" + "<br>y" * n,
        "overlaps": "<tr><td>a<td rowspan=7>b<td>c<td rowspan=0>d<tr><td colspan=1000 rowspan=3>e" * (n // 4),
        "wide columns": "<tr>" + "<td>".join(["w" * 60] * 2000) + "<tr><td colspan=1000>a<td>b" * n,
    }
    for name, rows in tables.items():
        began = time.perf_counter()
        text = html.render(f"<table>{rows}</table>")
        assert time.perf_counter() - began < 20, name
        assert len(text) < 20 * len(rows), name
