"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, with weights from labelled
pages; one linear scan finds the contiguous region with the highest score, and its words are the text. What a
page has inside its region but not as content (scripts, forms, adverts and the like) is cut before: an element
is cut if its tag, or a word of its class, id or role, stands in the labelled pages on elements without content
only. The labelled pages are layouts of this module (LAYOUTS), in which double brackets mark the content; other
ones can be given to fit().

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
in page order by one line feed; inline tags join, a line break is white space. Tags that were never closed end
as browsers end them. On ties the earlier, longer region stays.

Null and empty html, and pages without words outside cut elements: empty text. Repeated rows are read one by
one. Very long pages take time and memory in proportion. Only page_id, url and html are read, so other columns
cannot clash. No pages: no rows.
"""

from __future__ import annotations

import functools
import html as references
import math
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame

from seedsift.llm.common import map_batches, table

#: Element names of the HTML standard by how they are laid out or parsed.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i iframe img input ins kbd label map mark meter noscript object output picture progress q"
    " ruby rb rp rt s samp script select small source span strike strong style sub sup svg template textarea time tt u var video audio canvas wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An open element of the key's name ends where one of the value's names starts.
ENDED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr tbody", "td": "td th tr tbody", "th": "td th tr tbody", "option": "option optgroup"}
_ENDS = {name: frozenset(k for k, v in ENDED_BY.items() if name in v.split()) for name in " ".join(ENDED_BY.values()).split()}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
_WORDS = re.compile(r"[a-z]+")
_NAMED = ("class", "id", "role")
#: Names that say whether something is there, not what an element is: `has-sidebar`, `no-comments`.
_MODIFIERS = ("has", "have", "with", "without", "no", "not", "is", "hide", "show")


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from a place on, and the place after the tag."""
    found, n = {}, len(html)
    while at < n:
        m = _ATTRIBUTE.match(html, at)
        if m is None:  # white space, slashes and the closing bracket, or the end
            stop = html.find(">", at)
            return found, n if stop < 0 else stop + 1
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        at = m.end()
    return found, n


class Run(NamedTuple):
    """A text between tags that are not cut, and what stands before it since the last one."""

    text: str
    tags: list
    new_block: bool
    space: bool
    linked: bool
    where: str
    elements: tuple


class _Page:
    """Open elements while a page is read."""

    def __init__(self, cuts: frozenset[str], record: bool):
        self.cuts, self.record = cuts, record
        self.names: list[str] = []
        self.features: list[tuple[str, ...]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that are not inline
        self.cut_from: int | None = None

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def push(self, name: str, attributes: dict[str, str]) -> None:
        features = self._features(name, attributes)
        if self.cut_from is None and not self.cuts.isdisjoint(features):
            self.cut_from = len(self.names)
        self.places.setdefault(name, []).append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append(name)
        if self.record:
            self.features.append(features)

    def pop_to(self, place: int) -> None:
        while len(self.names) > place:
            self.places[self.names.pop()].pop()
            if self.record:
                self.features.pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()
        if self.cut_from is not None and self.cut_from >= place:
            self.cut_from = None

    def _features(self, name: str, attributes: dict[str, str]) -> tuple[str, ...]:
        """The tag, and whether it stands in an article; words of its names unless it is the page's own frame; whether it is hidden."""
        place = "@article" if self.places.get("article") else ""
        out = [name + place]
        if not attributes:
            return tuple(out)
        if name not in ("html", "body", "main", "article"):
            for key in _NAMED:
                if key in attributes:
                    spelled = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", attributes[key])
                    for each in spelled.lower().split():
                        found = _WORDS.findall(each)
                        out.extend(f".{w}" for w in found if found[0] not in _MODIFIERS)
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
            out.append("!hidden")
        return tuple(out)

    def opened(self, name: str) -> None:
        """Ends what the start of an element ends."""
        floor = max(self.last("table"), self.last("button"))
        if name in ENDS_P and self.last("p") > floor:
            self.pop_to(self.last("p"))
        if name in _ENDS and self.blocks:
            top = self.blocks[-1]
            if self.names[top] == "p" and len(self.blocks) > 1:
                top = self.blocks[-2]
            if self.names[top] in _ENDS[name]:
                self.pop_to(top)
                if name in ("tr", "tbody") and self.blocks and self.names[self.blocks[-1]] in _ENDS[name]:
                    self.pop_to(self.blocks[-1])

    def closed(self, name: str) -> None:
        place = self.last(name)
        if place >= 0 and (name not in INLINE or not self.blocks or place > self.blocks[-1]):
            self.pop_to(place)


def parse(html: str, cuts: frozenset[str] = frozenset(), record: bool = False) -> list[Run]:
    """The page's texts outside cut elements, each with the tags before it; with record also the features of the elements around."""
    page, runs, lower = _Page(cuts, record), [], None
    tags: list = []
    new_block = space = False
    articles = mains = 0
    at, n = 0, len(html)

    def inside() -> tuple[bool, bool]:
        return bool(page.places.get("article")), bool(page.places.get("main"))

    def text(raw: str) -> None:
        nonlocal tags, new_block, space
        if page.cut_from is not None or not raw:
            return
        said = references.unescape(raw) if "&" in raw else raw
        if not said.strip():
            space = space or bool(said)
            return
        elements = tuple(page.features) if record else ()
        runs.append(Run(said, tags, new_block, space, bool(page.places.get("a")), inside(), elements))
        tags, new_block, space = [], False, False

    while at < n:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        follows = html[start + 1 : start + 2]
        if not (follows.isascii() and follows.isalpha() or follows and follows in "/!?"):
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        if follows in "!?":
            if html.startswith("<!--", start):
                stop, size = html.find("-->", start + 2), 3  # <!--> is a comment, too
            elif html.startswith("<![CDATA[", start):
                stop, size = html.find("]]>", start), 3
            else:
                stop, size = html.find(">", start), 1
            at = n if stop < 0 else stop + size
            continue
        closing = follows == "/"
        m = _NAME.match(html, start + 1 + closing)
        if m is None:  # </ and no name: to the next bracket, like a comment
            stop = html.find(">", start)
            at = n if stop < 0 else stop + 1
            continue
        name = m[0].lower()
        attributes, at = _attributes(html, m.end())
        before = page.cut_from
        if closing:
            page.closed(name)
            around = inside()
        else:
            page.opened(name)
            around = inside()
            if name not in VOID:
                page.push(name, attributes)
        if before is None or page.cut_from is None or page.cut_from < before:
            tags.append((name, around))
        if name == "br":
            space = True
        elif name not in INLINE:
            new_block = True
        if not closing and page.cut_from is None:
            articles += name == "article"
            mains += name == "main"
        if not closing and name in RAW:
            lower = html.lower() if lower is None else lower
            lower = lower if len(lower) == n else html  # letters whose lower case is longer
            stop = lower.find(f"</{name}", at)
            stop = n if stop < 0 else stop
            text(html[at:stop])
            at = stop
    # in the article, or in the main part where no element is an article; or beside it; or on a page that names neither
    which = 0 if articles else 1 if mains else None
    where = (lambda _: "plain") if which is None else lambda x: "inside" if x[which] else "beside"
    return [r._replace(where=where(r.where), tags=[f"{name} {where(around)}" for name, around in r.tags]) for r in runs]


def word_key(run: Run) -> str:
    """What the weight of a run's words depends on."""
    return f"{'link' if run.linked else 'word'} {run.where}"


class Weights(NamedTuple):
    words: dict[str, float]
    tags: dict[str, float]
    cuts: frozenset[str]


#: A tag's score is below zero, a tag that the labelled pages do not have counts as UNSEEN; a word's is bounded, so that none outweighs a page.
LEAST, UNSEEN, MOST = -0.01, -0.5, 5.0


def fit(pages: Iterable[str]) -> Weights:
    """Weights as log odds of standing in the content, counted over labelled pages; double brackets mark the content."""
    pages = list(pages)
    around: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for page in pages:
        for run, marked in _marked(parse(page, record=True)):
            for features in run.elements:
                for f in features:
                    around[any(marked)][f] += 1
    cuts = frozenset(f for f in around[False] if not around[True][f])
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for page in pages:
        marked = _marked(parse(page, cuts))
        content = [i for i, (_, m) in enumerate(marked) if any(m)]
        for i, (run, m) in enumerate(marked):
            within = bool(content) and content[0] < i <= content[-1]
            tags[within].update(run.tags)
            for flag in m:
                words[flag][word_key(run)] += 1

    def odds(c: dict[bool, Counter], key: str) -> float:
        return math.log((c[True][key] + 0.5) / (c[False][key] + 0.5))

    return Weights(
        {k: max(-MOST, min(MOST, odds(words, k))) for k in {*words[True], *words[False]}},
        {k: min(LEAST, odds(tags, k)) for k in {*tags[True], *tags[False]}},
        cuts,
    )


def _marked(runs: list[Run]) -> list[tuple[Run, list[bool]]]:
    """Each run with a flag for each of its words: whether it stands between the marks."""
    out, inside, before = [], False, []
    for run in runs:
        before = before + run.tags
        flags = []
        for w in run.text.split():
            if w in ("[[", "]]"):
                inside = w == "[["
            else:
                flags.append(inside)
        if flags:
            out.append((run._replace(tags=before), flags))
            before = []
    return out


def best_region(scores: Iterable[tuple[float, float]]) -> tuple[int, int]:
    """First and last of the contiguous items with the highest sum, from (score of what stands before, own score); (0, -1) if none is above zero."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for i, (gap, own) in enumerate(scores):
        if total + gap < 0 or total <= 0:
            total, start = 0.0, i
        else:
            total += gap
        total += own
        if total > best or (total == best and best > 0 and start == found[0]):
            best, found = total, (start, i)
    return found


def main_text(html: str | None, weights: Weights) -> str:
    """The text of a page. Where nothing is left, names of classes mean something else here, and only tags cut."""
    for cuts in (weights.cuts, frozenset(c for c in weights.cuts if c[0] != ".")):
        runs = parse(html or "", cuts)
        scores = ((sum(weights.tags.get(t, UNSEEN) for t in r.tags), weights.words.get(word_key(r), 0.0) * len(r.text.split())) for r in runs)
        first, last = best_region(scores)
        if last >= 0:
            break
    blocks: list[list[str]] = []
    for i, run in enumerate(runs[first : last + 1]):
        if i == 0 or run.new_block:
            blocks.append([])
        elif run.space:
            blocks[-1].append(" ")
        blocks[-1].append(run.text)
    return "\n".join(" ".join("".join(b).split()) for b in blocks)


#: What the text of a page may be made of, and what may stand in its midst without being text: ~9 stands for nine words.
_TEXT = """<p>~60 <a>~2</a> ~5 <b>~2</b> <i>~1</i> <em>~1</em> <strong>~1</strong> <u>~1</u> <code>~1</code> <span>~3</span> <small>~2</small> <sup>~1</sup> <sub>~1</sub> <q>~4</q>
<abbr>~1</abbr> <cite>~2</cite> <kbd>~1</kbd> <mark>~1</mark> <time>~1</time> <del>~1</del> <ins>~1</ins> <font>~1</font><br>~9</p><center>~2</center><p>~30</p><figure><img><figcaption>~8</figcaption></figure>
<ul><li>~9</li><li><a>~4</a></li><li><p>~5</p></li></ul><ol><li>~9</li></ol><dl><dt>~1</dt><dd>~9</dd></dl><blockquote><p>~20</p></blockquote><pre>~12</pre>
<table><caption>~2</caption><thead><tr><th>~1</th></tr></thead><tbody><tr><td>~2</td><td>~2</td></tr></tbody></table><h2>~3</h2><h3>~3</h3><div><p>~40</p></div><section><h4>~2</h4><p>~30</p></section>
<h5>~2</h5><h6>~2</h6><p>~25</p><details><summary>~2</summary><p>~9</p></details><address>~3</address>"""
_AMID = """<div class="ad ads advert adverts advertisement advertising adbox adslot adsbygoogle leaderboard sponsor sponsored sponsors promo promos promotion">~25</div><aside>~20</aside><div hidden>~5</div><template>~3</template><noscript>~8</noscript>
<script>~9</script><style>~4</style><iframe>~3</iframe><svg><title>~2</title><text>~1</text></svg><canvas>~2</canvas><object>~2</object><audio>~2</audio><video>~2</video>
<nav class="toc breadcrumb breadcrumbs menu menus navbar topnav mainnav subnav sidenav navigation pager pagination"><a>~1</a> <a>~1</a></nav><ul id="nav" class="menu"><li><a>~1</a></li></ul>
<form role="search"><fieldset><legend>~1</legend><label>~1</label><input><select><option>~1</option></select><textarea>~2</textarea><button>~1</button></fieldset></form>
<div class="share sharing social">~6 <a>~1</a> <a>~1</a></div><div class="newsletter subscribe signup login popup modal overlay">~9</div>
<div class="cookie cookies consent gdpr notice notices notification banner toast" role="alert dialog">~18 <button>~1</button></div><section class="related recommended recommendations teasers"><h2>~4</h2><p>~12</p></section>
<section class="comments comment commentlist commentform disqus discussion replies" id="respond"><h3>~2</h3><div><p>~40</p><p>~30</p></div></section><div class="sidebar widget" role="complementary"><h3>~2</h3><ul><li><a>~4</a></li></ul></div>
<footer class="footer copyright legal" role="contentinfo"><p>~12 <a>~1</a></p></footer>"""
_HEAD = "<head><title>~6</title><style>~4</style><script>~9</script></head>"
_TOP = """<header class="masthead"><a>~2</a><nav role="navigation"><ul><li><a>~1</a></li><li><a>~1</a></li><li><a>~1</a></li><li><a>~1</a></li></ul></nav></header><div class="header">~3</div>"""

#: Labelled layouts; double brackets mark the content.
LAYOUTS = (
    # an article with everything around and inside that is not its text
    f"""<html>{_HEAD}<body>{_TOP}{_AMID}<main><article class="post entry"><header><h1>[[ ~7</h1><p class="byline author">~3</p></header>{_TEXT} ]]{_AMID}[[ <p>~60</p>{_TEXT} ]]</article>
    {_AMID}</main><section><p>~12</p></section></body></html>""",
    # an article between a menu, a plain line and a footer
    f"""{_HEAD}<body><nav><ul><li><a>~1</a></li><li><a>~1</a></li><li><a>~1</a></li></ul></nav><div class="ad">~9</div><article><h1>[[ ~6</h1><p><b>~9<br><p>~80</p><p>~50</p><p>~1</p> ]]</article>
    <div><p>~9</p></div><footer>~9</footer></body>""",
    # no article: a main part
    f"""<body>{_TOP}{_AMID}<main><h1>[[ ~5</h1>{_TEXT} ]]{_AMID}[[ <p>~60 <a>~2</a></p> ]]</main>{_AMID}<div><a>~2</a></div></body>""",
    # neither: parts with names
    f"""<body>{_TOP}<div id="wrapper"><div id="content" class="post body text main story article"><h1>[[ ~6</h1>{_TEXT} ]]{_AMID}[[ <p>~50</p>{_TEXT} ]]</div></div>{_AMID}</body>""",
    # neither: a plain page with lists of links without names
    """<body><ul><li><a>~1</a></li><li><a>~1</a></li><li><a>~1</a></li><li><a>~1</a></li></ul><table><tr><td><a>~2</a></td><td><a>~2</a></td></tr></table><div><div><h1>[[ ~5</h1><p>~60</p><p>~50</p><h2>~3</h2><p>~70</p><div>~40</div> ]]</div></div>
    <div><a>~2</a> <a>~2</a> <a>~2</a></div><div><a>~3</a></div><hr></body>""",
    # text alone
    "[[ ~40 ]]",
)


@functools.lru_cache(maxsize=1)
def trained() -> Weights:
    """The weights of the module's own layouts."""
    return fit(re.sub(r"~(\d+)", lambda m: " ".join(["word"] * int(m[1])), x) for x in LAYOUTS)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, main text and its code points for every row of (page_id, url, html)."""

    def run(ids, urls, sources):
        texts = [main_text(s, weights or trained()) for s in sources]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages, ["page_id", "url", "html"], run, "page_id long, url string, text string, n_chars long", rows=128)


def op12_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
