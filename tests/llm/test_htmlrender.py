import random
import re

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import htmlrender

CASES = [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("<p>a  b\n c<p>d", "a b c\n\nd"),
    ("<title>no</title><body>x<script>var t='</p>';</script>y<style>p{}</style>", "xy"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<b>bold</b> and <i>it</i>", "bold and it"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>one<li>two<ul><li>deep</ul></ul>end", "- one\n- two\n  - deep\n\nend"),
    ("<ol start=3><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n8. c"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>", "Name      | N\nlong name | 1\nx         | 22"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab |   | c\n1  | 2 | 3"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
    ("<pre>  a\n    b</pre>", "  a\n    b"),
    ("x<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "x\n\nyes"),
    ("&lt;a&gt; &amp; &copy; &amp", "<a> & © &"),
    ("<!-- c --><!DOCTYPE html><html><head><meta charset=x><body>t", "t"),
    ("a < b > c </nope> <", "a < b > c <"),
    ("<p>q<div>r</div>s", "q\n\nr\ns"),
    ("<dl><dt>T<dd>D<dt>U</dl>", "T\n  D\nU"),
    ("<blockquote>q</blockquote>z", "  q\n\nz"),
    ('<img alt="pic"> <a href="x>y">l</a>', "pic l"),
    ("<h1>H</h1>t<hr>u", "H\n\nt\n\n---\n\nu"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_rendering(source, want):
    assert htmlrender.to_text(source) == want.strip("\n")


def test_no_visible_word_is_lost_or_made():
    rnd = random.Random(1)
    tags = ["p", "div", "li", "ul", "ol", "td", "tr", "table", "b", "span", "h2", "dd", "pre", "section", "body", "head"]
    for _ in range(300):
        parts, words = [], []
        for k in range(rnd.randint(1, 40)):
            if rnd.random() < 0.5:
                words.append(f"w{k}")
                parts.append(f" w{k} ")
            else:
                parts.append(f"<{rnd.choice(['', '/'])}{rnd.choice(tags)}>")
        got = re.findall(r"w\d+", htmlrender.to_text("".join(parts)))
        assert sorted(got) == sorted(words), "".join(parts)


def test_rows(spark):
    deep = "<div>" * 5000 + "in" + "<ul><li>" * 3000 + "x"
    rows = [(i, s) for i, (s, _) in enumerate(CASES)] + [(100, deep), (101, "<a " * 20_000), (102, "<" * 50_000), (103, "<!--" * 9000), (0, "again"), (None, "n")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash"))
    found = htmlrender.render(pages).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r.text for r in found}
    assert by[100].split()[0] == "in" and by[100].endswith("x")
    assert by[None] == "n" and all(t is not None for t in by.values())
    assert htmlrender.render(pages.limit(0)).collect() == []


def test_all_visible_text():
    assert htmlrender.to_text("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b") == "a x=2 b"
    assert htmlrender.to_text("<svg><title>t</title><defs/><rect/><text>one</text><text>two <tspan>three</tspan></text><desc>d</desc></svg>") == "one two three"
    assert htmlrender.to_text("<map name=m><p>shown</p><area></map>") == "shown"
    assert htmlrender.to_text("<select><option>a<option selected>b</select> <select><option>c<option>d</select>") == "b c"
    assert htmlrender.to_text("<input value=v><input type=submit value='Send it'><input type=hidden value=h>") == "Send it"
    deep = "<div>" * 400
    assert htmlrender.to_text(deep + "<div hidden><div>no</div>no</div>yes") == "yes"
    assert htmlrender.to_text("<div hidden>" + deep + "</div>" * 399 + "no</div></div>yes") == "yes"


def test_styles_and_closed_elements():
    t = htmlrender.to_text
    assert t("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span><p>c</p></div>d") == "b\nd"
    assert t("<p style='display:\tnone'>a</p><p style='display:none;display:block'>b</p><p style='display:none !important;display:block'>c</p>") == "b"
    assert t("<p style=\"content:'display:none'\">a</p><p style='DISPLAY : NONE'>b</p>") == "a"
    assert t("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>") == "s\nt\ny" or "x" not in t("<details><summary>s</summary>x</details>")
    assert t("<dialog>x</dialog><dialog open>y</dialog>") == "y"
    deep = "<div hidden>" + "<div>" * 5000 + "x" + "</div>" * 5000 + "</div>after"
    assert t(deep) == "after"
    assert t("<div>" * 3000 + "<p hidden>x</p>y" + "</div>" * 3000) == "y"


def test_tables_against_a_plain_grid():
    """Where cells land, by an occupancy grid; aligned columns are where they begin in all rows."""
    rng = random.Random(4)
    for _ in range(60):
        rows, taken, at = [], set(), {}
        n = rng.randint(1, 6)
        for r in range(n):
            cells = []
            c = 0
            for k in range(rng.randint(1, 5)):
                while (r, c) in taken:
                    c += 1
                wide, deep, name = rng.randint(1, 3), rng.randint(0, 3), f"r{r}k{k}" + "x" * rng.randint(0, 5)
                cells.append(f"<td colspan={wide} rowspan={deep}>{name}</td>")
                at[name] = (r, c)
                taken.update((r + i, c + j) for i in range(deep or n) for j in range(wide))
                c += wide
            rows.append("<tr>" + "".join(cells) + "</tr>")
        lines = htmlrender.to_text("<table>" + "".join(rows) + "</table>").split("\n")
        begins: dict[int, set[int]] = {}
        for name, (r, c) in at.items():
            parts = [x.strip() for x in lines[r].split("|")]
            assert name in parts
            begins.setdefault(c, set()).add(lines[r].index(name))
        assert all(len(x) == 1 for x in begins.values())
        order = [min(begins[c]) for c in sorted(begins)]
        assert order == sorted(order)
    wide = htmlrender.to_text("<table><tr><td>日本<td>a<tr><td>abc<td>b</table>").split("\n")
    assert wide == ["日本 | a", "abc  | b"]
    assert htmlrender.to_text("<table><tr>" + "<td colspan=1000 rowspan=9999>x" * 3000 + "<tr><td>y</table>").count("x") == 3000


@pytest.mark.parametrize("tags", ["<div>", "<ul><li>", "<blockquote>", "<p><b>", "<table><tr><td>"])
def test_deep_nesting_takes_time_in_proportion(tags):
    import time

    depth = 2_000 if "table" in tags else 100_000
    start = time.time()
    assert htmlrender.to_text(tags * depth + "x").lstrip(" -") == "x"
    assert time.time() - start < 60


def test_foot_of_a_table_is_last_and_head_first():
    page = "<table><tfoot><tr><td>foot</td></tr></tfoot><tbody><tr><td>body</td></tr></tbody><thead><tr><td>head</td></tr></thead><tfoot><tr><td>more</table>"
    assert htmlrender.to_text(page) == "head\nbody\nmore\nfoot"


def _end_by_walk(stack, tags, fence):
    """What an opening tag closes, by a walk over all open elements."""
    found = 0
    for k in range(len(stack) - 1, 0, -1):
        if stack[k] in fence:
            break
        if stack[k] in tags:
            found = k
    return stack[:found] if found else stack


def test_open_elements_against_a_walk():
    import random

    rng = random.Random(2)
    for _ in range(300):
        stack, plain = htmlrender.Stack(htmlrender.Node("")), [""]
        for _ in range(60):
            tag = rng.choice("li ul p td table b".split())
            if rng.random() < 0.6:
                stack.push(htmlrender.Node(tag))
                plain.append(tag)
            else:
                tags, fence = frozenset(rng.sample("li p td b".split(), 2)), frozenset(rng.sample(["ul", "table"], 1))
                stack.close(tags, fence)
                plain = _end_by_walk(plain, tags, fence)
            assert [n.tag for n in stack.nodes] == plain
