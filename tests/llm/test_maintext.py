"""Main text: the pages' articles, structure, both passes, odd pages."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from reliefgrid.llm import maintext
from reliefgrid.llm.blocks import blocks
from reliefgrid.llm.blocks import Block
from reliefgrid.llm.queries import QUERIES
from reliefgrid.runtime import local_table

STOP = frozenset("this is the of and it in that are with us all to a".split())
LONG = "This is the long text of the story and it is told in the usual words that are with us all of the time. " * 3


def main_text(page):
    return maintext.main_text(page, STOP)


@pytest.mark.parametrize("element", ["article", "div"])
def test_articles_with_and_without_their_element(spark, element):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    if element == "article":
        got = {r.page_id: r for r in QUERIES["op8_main_text"](spark, sf).collect()}
    else:
        plain = F.regexp_replace("html", r"(</?)article\\b", "$1div")
        got = {r.page_id: r for r in maintext.main_texts(pages.withColumn("html", plain)).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html or "", re.S)
        inner = re.sub(r"</?(?:p|h1)>|<br>", " ", re.sub(r"</?b>", "", m[1])) if m else ""
        want = " ".join(html.unescape(inner).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_structure():
    page = f"""<!DOCTYPE html><html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
    <div class="cookie-notice">We use cookies</div><main><header><h1>Title &amp; more&nbsp;here</h1></header>
    <p>One<b>two</b> <i>three</i><br>four &lt;b&gt;</p><p>Short.<p>Last <a href="x>y">link</a> text
    <div class="ad">Buy this</div><form><p>Mail?</p><input></form><section id="comments"><p>{LONG}</p></section></main>
    <aside><p>{LONG}</p></aside><script>var a = "<p>no</p>";</script><style>p {{}}</style><!-- <p>no</p> --><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == "Title & more here Onetwo three four <b> Short. Last link text"


def test_two_passes_without_structure():
    page = f"<div><a href='/'>Home</a> <a href='/b'>News</a></div><div>{LONG}</div><div>Short one.</div><div>{LONG}</div><div>Imprint</div><div>© 2020</div>"
    assert main_text(page) == f"{LONG.strip()} Short one. {LONG.strip()}"
    g, b, s, n = maintext.GOOD, maintext.BAD, maintext.SHORT_BLOCK, maintext.NEAR
    flat = lambda labels: maintext.second_pass([Block("x", 0, "p", (), (1, k + 2)) for k in range(len(labels))], labels)
    assert flat([s, g, s, s, s, b, s]) == [g, g, g, b, b, b, b]
    assert flat([b, n, g]) == [b, g, g] and flat([s, s]) == [g, g] and flat([s, b]) == [g, b] and flat([]) == []


def test_second_pass_by_definition():
    """Every undecided block against all decided ones."""
    rnd = random.Random(4)
    g, b, s, n = maintext.GOOD, maintext.BAD, maintext.SHORT_BLOCK, maintext.NEAR
    for _ in range(400):
        found, path, new = [], [0], 1
        for _ in range(rnd.randint(1, 14)):
            path = path[: rnd.randint(1, len(path))]
            for _ in range(rnd.randint(0, 2)):
                path = [*path, new]
                new += 1
            found.append(Block("x", 0, "p", (), tuple(path)))
        labels = [rnd.choice([g, b, s, n]) for _ in found]
        shared = lambda i, j: next((k for k, (x, y) in enumerate(zip(found[i].nodes, found[j].nodes)) if x != y), min(len(found[i].nodes), len(found[j].nodes)))
        want = []
        for i, v in enumerate(labels):
            if v in (g, b):
                want.append(v)
            elif g not in labels:
                want.append(g)
            else:
                at = [(-shared(i, j), abs(i - j), labels[j]) for j in range(len(found)) if labels[j] in (g, b)]
                near = {x[2] for x in at if x[:2] == min(at)[:2]}
                want.append(near.pop() if len(near) == 1 else (g if v == n else b))
        assert maintext.second_pass(found, labels) == want


def test_first_pass_by_definition():
    def label(text, links=0, path=(("div", ""),), stop=STOP):
        return maintext.first_pass(Block(text, links, path[-1][0], path), stop)

    g, b, s, n = maintext.GOOD, maintext.BAD, maintext.SHORT_BLOCK, maintext.NEAR
    words, none = "this is the story of it ", "blau grau rot gelb "
    assert [label(words * k) for k in (1, 4, 10)] == [s, n, g] and [label(none * k) for k in (1, 5, 20)] == [s, s, s]
    assert label(none * 20, stop=None) == g and label(words * 10, links=90) == b and label(words * 10, links=60) == g
    inside = (("article", ""), ("ul", ""), ("li", ""))
    assert label(words, links=20, path=inside) == s and label(words, links=20, path=inside[1:]) == b
    for out in (("nav", ""), ("div", "cookie-bar x"), ("header", ""), ("div", "comments")):
        assert label(words * 10, path=(out, ("p", ""))) == b
    social = (("article", ""), ("section", "social history"))
    assert label(words * 4, path=social) == g and label("Share this", path=social) == b and label(words * 10, path=(("article", ""), ("div", "ad"))) == b


def test_pages_without_article_elements():
    short = ["Three men went out.", "They came to a river.", "Nobody saw them again."]
    bar = "<nav><a href=/>Home</a></nav>"
    assert main_text(f"{bar}<div>{''.join(f'<p>{x}</p>' for x in short)}</div><footer>us</footer>") == " ".join(short)
    prose = "他们在河边走了很久，天色渐渐暗下来，远处的山像一道墙。" * 16
    assert main_text(f"{bar}<div><p>{prose}</p></div><div class='ad'>{LONG}</div>") == prose
    linked = f"<article><p>{LONG}</p><ul><li><a href='/a'>First source</a></li><li><a href='/b'>Second source</a></li></ul><p>{LONG}</p></article>"
    assert main_text(bar + linked) == f"{LONG.strip()} First source Second source {LONG.strip()}"
    assert main_text(f"<article><section class='social history'><p>{LONG}</p></section></article>") == LONG.strip()


def test_stop_words_are_learned(spark):
    rows = [(k, "u", f"<p>der die w{k}</p><script>var nur;</script>" if k % 2 else f"<div class='dies'>le la v{k} &nbsp;", 0) for k in range(200)]
    pages = local_table(spark, rows, "page_id long, url string, html string, text long").repartition(3)
    assert maintext.stop_words(pages, share=0.1) == {"der", "die", "le", "la", "w", "v"}
    assert maintext.stop_words(pages.limit(0)) == frozenset()


def test_odd_pages(spark):
    assert main_text(None) == main_text("") == main_text("<p>") == "" and main_text("plain") == "plain"
    assert main_text("<article>open <p>x &#233; &bogus; <") == "open x é &bogus; <"
    assert main_text("<article><script>never closed <p>a</p>") == ""
    assert [x.text for x in blocks("a<p>b</p>c<![CDATA[<d>]]>")] == ["a", "b", "c<d>"]
    deep = "<div>" * 3000 + "<article>" + "x " * 200000
    assert len(main_text(deep)) == 399999
    rows = [(1, "u", "<article>a</article>", 1), (1, "u", "<article>a</article>", 1), (None, None, None, None)]
    pages = local_table(spark, rows, "page_id long, url string, html string, text long")
    assert [tuple(r) for r in maintext.main_texts(pages).collect()] == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert maintext.main_texts(pages.limit(0)).count() == 0


def test_pages_are_read_once_for_stop_words(spark):
    """Each page is split into words in one job; the pages with words are counted in it."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(page):
        read.add(1)
        return page

    rows = [(1, "<p>one two</p><script>three</script>"), (2, "<p>Two, three!"), (3, "<p>two four"), (4, "<p></p>"), (5, None)] * 2
    pages = local_table(spark, rows, "page_id long, html string").withColumn("html", seen.asNondeterministic()("html"))
    assert maintext.stop_words(pages, share=0.5) == {"two"} and read.value == len(rows)
    assert maintext.stop_words(pages.filter("page_id > 3")) == frozenset()
