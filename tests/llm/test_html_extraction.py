"""Main text of hand-made pages and of the table's, and templates counted by brute force."""

import re

import duckdb
import pytest

from imgcurate.llm.html_extraction import _signed, candidates, extract, hash_subtrees, main_text, parse, templates_of, walk

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a  b\n c<p>d<br>e": "a b c\nd e",
    "<nav>menu</nav><article><h1>T</h1><p>x&nbsp;y</p><div class='ad'>buy</div></article><p>out</p>": "T\nx y",
    "<article><p>one<script>if (a < b) '</p>'; </script> two</p><style>p{}</style></article>": "one two",
    "<main><header>h</header><section><p>body</p></section><footer>f</footer></main>": "body",
    "<article><p>a</p><div id='comments'><p>reader</p></div><form>f</form><aside>s</aside></article>": "a",
    "<ul><li>one<li>two</ul>": "one\ntwo",
    "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
    "<article><p>x</b></div></p> tail": "x\ntail",
    "<article><p>&#x41;&lt;b&gt;&eacute;&bogus; a < b</p></article>": "A<b>é&bogus; a < b",
    "<!-- <article>no</article> --><p>yes</p>": "yes",
    "<p hidden>no</p><p style='display: none'>no</p><p role='navigation'>no</p><p>yes</p>": "yes",
    "<article><p>t<!-- open comment": "t",
    "<article><p a='>'>t</p": "t",
    "<article><header><h1>Title of story</h1><nav>n</nav></header><p>text</p></article><header><h1>Site</h1></header>": "Title of story\ntext",
    "<article><section class='related-work'><p>work</p></section><p id='comment'>remark</p><div class='related-posts'>x</div></article>": "work\nremark",
    "<article><div class='comment-list'>c</div><ul class='share buttons'><li>a</ul><p>t</p></article>": "t",
    "<article><a href=/2>Teaser</a></article><div><p>The story itself, which is told at length outside.</p></div>": "Teaser\nThe story itself, which is told at length outside.",
    "<main><p>t</p></main><div>much more text than the main element has</div>": "t",
    "<article><div class=ad>a</div></article><p>x</p>": "x",
    "<article><textarea>no</textarea><p>a</article><article><p>b</article>": "a\nb",
}


@pytest.mark.parametrize("html", list(CASES))
def test_cases(html):
    assert main_text(html) == CASES[html]


def test_deep_nesting():
    assert main_text("<div>" * 50_000 + "x") == "x"


def test_pages_hold_documents(spark):
    """Below its heading, a page's text is that of a document."""
    folder = "/root/testdata/sf0.01"
    flat = lambda t: re.sub(r"\s+", " ", t).strip()
    known = {flat(t) for (t,) in duckdb.sql(f"select text from '{folder}/documents.parquet'").fetchall()}
    pages = extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    assert len(pages) == 250
    assert all(flat(r.text.partition("\n")[2]) in known for r in pages)


def bare(i, host="a.example"):
    return (i, f"http://{host}/{i}", f"<body><div><b>Site</b> top</div><div class=x><p>own text {i}</p></div><p>same line</p><div>bottom {i % 2}</div></body>", "t")


SCHEMA = "page_id long, url string, html string, host string"


def test_templates_go(spark):
    rows = [bare(i) for i in range(10)] + [bare(i, "b.example") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.url, r.text) for r in extract(df).collect()}
    want = {(u, f"own text {i}") for i, u, _, _ in rows[:10]}
    want |= {(u, f"Site top\nown text {i}\nsame line\nbottom {i % 2}") for i, u, _, _ in rows[10:]}
    assert got == want
    # The counts from the sources of the pages: the same markup is the same subtree.
    marks = re.compile(r"<div><b>Site</b> top</div>|<b>Site</b>|<div class=x>.*?</div>|<p>.*?</p>|<div>bottom .</div>")
    counts = {}
    for _, u, h, _ in rows:
        for c in set(marks.findall(h)):
            counts[u.split("/")[2], c] = counts.get((u.split("/")[2], c), 0) + 1
    pages = {"a.example": 10, "b.example": 4}
    want = {k for k, n in counts.items() if n >= 5 and n >= 0.2 * pages[k[0]]}
    ids = {c: candidates(c)[0] for _, c in want}
    outer = {(h, _hash_of(c)) for h, c in want}
    got = {(r.host, r.subtree) for r in templates_of(df.drop("host")).collect()}
    assert outer <= got and {h for h, _ in got} == {"a.example"}
    assert got == {(h, x) for h, c in want for x in ids[c]}


def _hash_of(markup):
    root = parse(markup)[0]
    hash_subtrees(walk(root, True))
    return _signed(root.children[0].hash)


def boxed(i, text, box="<div class='box9'><p>Buy our plan today</p></div>"):
    return (i, f"http://a.example/{i}", f"<nav>n</nav><main><h1>Head {text}</h1><p>{text} is what this page tells of, at some length.</p>{box}</main>", None)


def test_boxes_inside_main_elements(spark):
    """A box that many different articles have goes; one that only copies of one article have stays; so does a shared paragraph."""
    body = lambda t: f"Head {t}\n{t} is what this page tells of, at some length."
    df = spark.createDataFrame([boxed(i, f"story {i}") for i in range(12)], SCHEMA)
    assert {r.page_id: r.text for r in extract(df).collect()} == {i: body(f"story {i}") for i in range(12)}
    copies = spark.createDataFrame([boxed(i, "one story") for i in range(12)], SCHEMA)
    assert {r.text for r in extract(copies).collect()} == {body("one story") + "\nBuy our plan today"}
    shared = spark.createDataFrame([boxed(i, f"story {i}", "<p>Buy our plan today</p>") for i in range(12)], SCHEMA)
    assert {r.text for r in extract(shared).collect()} == {body(f"story {i}") + "\nBuy our plan today" for i in range(12)}
    # A body that is most of its article stays, under whatever heads.
    long = "<div>" + "the body of the text " * 20 + "</div>"
    bodies = spark.createDataFrame([boxed(i, f"story {i}", long) for i in range(12)], SCHEMA)
    assert all("the body" in r.text for r in extract(bodies).collect())


def test_copies_of_an_article_stay(spark):
    df = spark.createDataFrame([(i, "http://a.example/", "<nav>n</nav><article><p>text</article>", None) for i in range(30)], SCHEMA)
    assert {r.text for r in extract(df).collect()} == {"text"}


def test_edges(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, "not a url", "", "h"), (2, None, "<p>x", None), (3, "http://h/", "<p>" + "w " * 500_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = extract(df)
    assert out.columns == [*df.columns, "text"]
    assert sorted(len(r.text) for r in out.collect()) == [0, 0, 0, 1, 999_999]
    assert extract(df.limit(0)).count() == 0
