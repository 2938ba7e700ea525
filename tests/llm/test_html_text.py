import html
import random
import re
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from seedsift.llm import html_text as h
from tests.conftest import DATA

SCHEMA = "page_id long, url string, html string"


def read(source):
    return h.main_text(source, h.trained())


def article_by_patterns(source):
    """The article of the tables' one layout, by patterns instead of a parser."""
    inner = source[source.index("<article>") + 9 : source.rindex("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ")))
    return "\n".join(b for b in blocks if b)


def test_query_equals_patterns(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = h.op12_html_text(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        want = article_by_patterns(rows[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, want, len(want))


P = "Some words of a paragraph that is long enough to look like one, with a full stop."
BOILERPLATE = {
    "menu": "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News of the day</a></li></ul></nav>",
    "menu by class": "<div class='main-menu'><a href=/>Home</a> <a href=/b>News</a></div>",
    "header": "<header><div><a href=/>Our Site</a></div><p>All the news that fit, every single day of the year.</p></header>",
    "footer": "<footer><p>Copyright by us, all rights reserved, do not copy any of this anywhere.</p></footer>",
    "sidebar": "<aside><h3>Popular</h3><p>A long teaser of another text that many have read this week already.</p></aside>",
    "sidebar by class": "<div id='sidebar'><h3>Popular</h3><p>A long teaser of another text that many have read this week.</p></div>",
    "cookie notice": "<div class='cookie-notice'><p>We use cookies to make this page better, please accept them all now.</p><button>Yes</button></div>",
    "advert": "<div class='ad-slot'><p>Buy this thing today, it is cheaper than ever before, and it is good.</p></div>",
    "form": "<form action=/s><label>Your name</label><input name=q><select><option>One</option><option>Two</option></select><textarea>Say it</textarea></form>",
    "script": "<script>if (a < b && '</p>') { document.write('<p>not text</p>') }</script>",
    "style": "<style>p > a { color: red }</style>",
    "comment": "<!-- <p>not text either</p> -->",
    "hidden": "<div style='display: none'><p>Nobody sees this line of words here.</p></div>",
    "reader comments": "<section id='comments'><h2>3 comments</h2><article class='c'><p>First! I have so much to say about this text that I go on and on and on.</p></article></section>",
    "newsletter": "<div class='newsletterSignup'><p>Get our letter every week, no spam, we promise.</p></div>",
    "related": "<div class='related-posts'><ul><li><a href=/x>Another text</a></li></ul></div>",
}


@pytest.mark.parametrize("frame", ["<article><h1>Title</h1>{}</article>", "<main><h1>Title</h1>{}</main>", "<div id=content><h1>Title</h1>{}</div>"])
@pytest.mark.parametrize("kind", BOILERPLATE)
def test_boilerplate_before_inside_and_after(kind, frame):
    b = BOILERPLATE[kind]
    want = f"Title\n{P}\n{P}\nEnd."
    body = f"<p>{P}</p>{{}}<p>{P}</p><p>End.</p>"
    if kind == "header" and "article" in frame:
        b = ""  # an article's own header is its head
    for page in (b + frame.format(body.format("")), frame.format(body.format(b)), frame.format(body.format("")) + b, b + frame.format(body.format(b)) + b):
        assert read(f"<!DOCTYPE html><html><head><title>T &amp; t</title></head><body>{page}</body></html>") == want


def test_blocks_white_space_and_references():
    page = "<article><h1> A &lt;b&gt;\n title </h1><p>one<b> two</b>three&nbsp;&#8212;&amp;amp;<br>four\n\n five</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><p>caf&eacute &bogus; 1 < 2 & 3 <p></p><blockquote>q</blockquote>tail</article>"
    assert read(page).split("\n") == ["A <b> title", "one twothree —&amp; four five", "x", "y", "1", "2", "café &bogus; 1 < 2 & 3", "q", "tail"]


def test_unclosed_and_odd_markup():
    assert read("<article><p><b>One.<p>Two <i>three</p><div>Four</article><footer>No") == "One.\nTwo three\nFour"
    assert read("<p class=ad>Advert words<p>Text of the page that stays here for good.") == "Text of the page that stays here for good."
    assert read("<article title='a > b' data-x=\"</article>\" hidden2><p a=b/c>Text</p></article>") == "Text"
    assert read("<article><p>a<!---->b<!-- x -- > c --><![CDATA[d]]></ >e<?php f ?></p></article>") == "abe"
    assert read("<ARTICLE><P>Upper</P><SCRIPT>no</SCRIPT><p>x</ARTICLE>") == "Upper\nx"
    assert read("plain text\n only") == "plain text only"
    assert read("<article><p>a <!-- never closed <p>b") == "a"
    assert read("<article><p>a</p><script>never closed <p>b") == "a"
    assert read("<div class='layout with-sidebar'><article><p>Only words here.</p></article></div>") == "Only words here."
    assert read(f"<div class='page has-sidebar no-comments'><article><p>{P}</p></article><div class='sidebar'>No</div></div><div>After it all.</div>") == P
    assert read(None) == read("") == read("<p> </p>") == read("<nav>Menu only</nav>") == ""


def test_page_without_names_takes_the_best_region():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(9))
    page = f"<body><ul>{links}</ul><div><h2>Head</h2><p>{P}</p><p>{P}</p></div><ul>{links}</ul></body>"
    assert read(page) == f"Head\n{P}\n{P}"


def test_many_cut_elements_do_not_part_a_short_title_from_its_text():
    between = "".join(BOILERPLATE[k] for k in ("script", "style", "advert", "form", "cookie notice", "menu", "newsletter")) * 3
    for frame in ("<article><h1>Title</h1>{}<p>Text.</p></article>", "<main><h1>Title</h1>{}<p>Text.</p></main>"):
        assert read(frame.format(between)) == "Title\nText."
    assert read(f"<body><h1>Title</h1>{between}<p>{P}</p></body>") == f"Title\n{P}"


def test_best_region_equals_all_regions():
    rng = random.Random(2)
    for _ in range(500):
        items = [(-rng.choice([0, 1, 2, 5]), rng.choice([-3, -1, 1, 2, 4])) for _ in range(rng.randint(0, 9))]
        first, last = h.best_region(items)
        best, found = 0, []
        for i in range(len(items)):
            for j, total in enumerate(accumulate([items[i][1], *(g + o for g, o in items[i + 1 :])]), i):
                if total > best:
                    best, found = total, []
                if total == best and total > 0:
                    found.append((i, -j))
        got = items[first][1] + sum(g + o for g, o in items[first + 1 : last + 1]) if last >= 0 else 0
        assert got == best and (last < 0) == (not found)


def test_weights_come_from_the_labelled_pages():
    w = h.trained()
    assert w.words["word inside"] > 0 > w.words["word beside"] and w.words["word plain"] > 0
    assert all(x < 0 for x in w.tags.values()) and w.tags["nav beside"] < w.tags["p inside"]
    assert {"nav", "script", ".ad", ".comments"} <= w.cuts and not {"p", "div", "h1", "section", "header@article"} & w.cuts
    own = h.fit(["<div class=keep>[[ a b c d ]]</div><div class=drop>x y</div>"])
    assert own.cuts == {".drop"} and h.main_text("<div class=drop>no</div><div>yes it is</div>", own) == "yes it is"


def test_rows_nulls_repeats_and_clashes(spark):
    rows = [(1, "u", "<article><p>a</p></article>"), (1, "u", "<article><p>a</p></article>"), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = sorted((tuple(r) for r in h.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert h.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("part", ["<p>word", "<b>", "</b>", "<", "<a href=\"", "<li><b>", "&amp", "<!--", "<div class='x y z'>w</div>", "<ul><li>x", "' \"="])
def test_long_pages_take_linear_time(part):
    import time

    source = "<article><p>text</p>" + part * (1_000_000 // len(part)) + "</article>"
    began = time.time()
    read(source)
    assert time.time() - began < 20
