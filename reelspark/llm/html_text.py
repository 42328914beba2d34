"""Main text of web pages by consensus on a container path for each host.

Every page is cut into blocks below containers, without menus, headers, footers,
sidebars, adverts, notices, forms, scripts and comments. A page votes for the
generalised tag-and-class path of the container that holds its prose: an article or
main with most of it, else the deepest element with all of it. Votes
are counted by host in Spark, and each page is extracted anew from the containers on
its host's winning path, or from its own best container where it has none there.

Cases: a null or empty page has an empty text. A page without a host votes among
those without. Ties between paths go to the larger share of prose, then to the
alphabet. Unclosed and stray tags, unclosed comments and quotes are read to their
end. Long and deeply nested pages are read whole, in time and memory linear in their
length. Repeated rows each get a row and a vote. An empty table gives an empty result. Extra columns pass through `keep` only; one that bears the
name of a result column comes back with "_input" appended.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, kept_names, materialise, small_or_none, table
from .url_rules import host_and_path

#: Elements that begin and end a block (fixed values).
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that can be a page's main container.
CONTAINERS = {"article", "body", "div", "main", "section", "td"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
DROPPED = set("aside button canvas datalist dialog footer form head header iframe input menu nav noscript object script search select style svg template textarea title".split())
#: Words of a class or id that mark what is not the article.
DROPPED_WORDS = set("ad adbox ads adsbygoogle adsense adslot advert advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Names of which these are the first word say what an element has or lacks, not what it is.
MODIFIERS = {"has", "with", "no", "without", "is", "not"}
#: Words of an element that is not the article even if it holds most of the page's prose.
NEVER = set("ad adbox ads adsbygoogle adsense adslot advert advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr menu nav navbar navigation pager pagination reply respond".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"}
#: Words that leave such a mark as it is, as in related-posts; any other word, as in related-work, makes the name say something else.
FURNITURE = set("area articles bar block body bottom box button buttons card col column container content desktop extra fixed float form global google group holder icon icons inline inner item items left link links list lower main mobile module more new news next our outer page panel post posts prev primary region right row secondary section site slot small sticky stories sub text this title top trail unit upper us user view widgets wrap wrapper zone".split())
OWN_HEADER = {"article", "post", "entry", "content", "story"}
#: Whose descendants' headers hold the article's title.
HOLDS_HEADER = OWN_HEADER - {"content"}
#: Between the steps of a path; a step has no blank.
STEP = " > "
#: An element of the key closes an open one of the value (fixed values of HTML).
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}

_MARK = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|[/!?a-zA-Z])""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def marks(name: str) -> set[str]:
    """The words of a class or id that mark what is not the article, if all its words belong to such names; else none."""
    words = [w.lower() for w in _WORDS.findall(name) if len(w) > 1]
    if words[:1] and words[0] in MODIFIERS or set(words) - DROPPED_WORDS - FURNITURE:
        return set()
    return set(words) & DROPPED_WORDS


class _Open(NamedTuple):
    """An open element."""

    tag: str
    element: int  #: The innermost block element.
    gone: bool  #: Dropped for its tag, role or attributes.
    mark: int  #: The innermost element that is marked by its words; 0: none.
    linked: bool
    titled: bool  #: Headers hold titles.
    main: bool  #: In an article or main.
    heading: bool


class _Prose(NamedTuple):
    """Characters outside links that stand directly in a marked element, or in none."""

    all: int
    main: int
    heading: int


class Page:
    """Elements (parent, tag, last step of the path, depth) and blocks (element, text, characters inside links) of a page.

    An element marked by a word that holds more than half of the prose is the article after
    all, unless prose in an article or main, or under a heading, stands outside of it.
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.step, self.depth = [-1], [""], [""], [0]
        self.blocks: list[tuple[int, str, int]] = []
        #: Pieces of the block that is read: mark, text, linked; and the blocks read.
        self._pieces: list[tuple[int, str, bool]] = []
        self._read_blocks: list[tuple[int, list[tuple[int, str, bool]]]] = []
        #: Of the page itself and of each marked element: the marked one around it, prose, whether it is never the article.
        self._around, self._prose, self._never = [-1], [_Prose(0, 0, 0)], [False]
        self._stack = [_Open("", 0, False, 0, False, False, False, False)]
        self._held: dict[str, int] = {}  # open elements by tag
        self._read(html)
        shown = self._shown()
        for element, pieces in self._read_blocks:
            seen = [(t, linked) for mark, t, linked in pieces if shown[mark]]
            text = " ".join(unescape("".join(t for t, _ in seen)).split())
            if text:
                self.blocks.append((element, text, len(" ".join(unescape("".join(t for t, linked in seen if linked)).split()))))

    def _shown(self) -> list[bool]:
        """Whether what stands directly in each marked element is part of the page's text."""
        n = len(self._around)
        held, inner = [p.all for p in self._prose], [[] for _ in range(n)]
        for m in range(n - 1, 0, -1):  # an outer one comes before an inner one
            held[self._around[m]] += held[m]
            inner[self._around[m]].append(m)
        shown, outside = [True] + [False] * (n - 1), self._prose[0]
        at = 0
        while not (outside.main or outside.heading and outside.all > outside.heading):
            most = max(inner[at], key=held.__getitem__, default=0)
            if not most or 2 * held[most] <= held[0] or self._never[most]:
                break
            shown[most] = True
            outside, at = _Prose(*map(sum, zip(outside, self._prose[most]))), most
        return shown

    def _end_block(self) -> None:
        if self._pieces:
            self._read_blocks.append((self._stack[-1].element, self._pieces))
            self._pieces = []

    def _add(self, text: str) -> None:
        top = self._stack[-1]
        if text and not top.gone:
            self._pieces.append((top.mark, text, top.linked))
            n = 0 if top.linked else len(" ".join(text.split()))
            if n:
                prose = self._prose[top.mark]
                self._prose[top.mark] = _Prose(prose.all + n, prose.main + n * (top.main and not top.heading), prose.heading + n * top.heading)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self._close("p", BLOCKS - {"p"})
        if tag in IMPLIED:
            for old in IMPLIED[tag]:
                self._close(old, {"ul", "ol", "table", "dl", "select"})
        top = self._stack[-1]
        known = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        names = f"{known.get('class', '')} {known.get('id', '')}".split()
        element, gone, mark = top.element, top.gone, top.mark
        heading = re.fullmatch("h[1-6]", tag) is not None
        if not gone and tag not in ("html", "body", "main"):
            told = known.get("class", "").split() if heading else names  # a heading's id is made from the title
            inside = top.titled or any(n.lower() in OWN_HEADER for n in names)
            marked = set().union(*map(marks, told)) - ({"header"} if inside else set())
            gone = bool(tag in DROPPED and not (tag == "header" and inside) or known.get("role", "").lower() in ROLES or known.get("aria-hidden") == "true" or "hidden" in known or "display:none" in known.get("style", "").replace(" ", "").lower())
            if marked and not gone:
                self._around.append(mark)
                self._prose.append(_Prose(0, 0, 0))
                self._never.append(bool(marked & NEVER))
                mark = len(self._around) - 1
        titled = top.titled or tag == "article" or any(n.lower() in HOLDS_HEADER for n in names)
        if tag in BLOCKS:
            self._end_block()
            self.parent.append(element)
            self.tag.append(tag)
            self.step.append(".".join([tag, *sorted(re.sub("[0-9]+", "#", n) for n in names)]))
            self.depth.append(self.depth[element] + 1)
            element = len(self.step) - 1
        elif tag == "br":
            self._add(" ")
        if tag not in VOID:
            self._stack.append(_Open(tag, element, gone, mark, top.linked or tag == "a", titled, top.main or tag in ("article", "main"), top.heading or heading))
            self._held[tag] = self._held.get(tag, 0) + 1

    def _close(self, tag: str, scope: set[str]) -> None:
        """Closes the innermost open element of that tag, with all inside it, unless a tag of scope stands between."""
        if not self._held.get(tag):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                if any(x[0] in BLOCKS for x in self._stack[i:]):
                    self._end_block()
                for x in self._stack[i:]:
                    self._held[x[0]] -= 1
                del self._stack[i:]
                return
            if self._stack[i][0] in scope:
                return

    def _read(self, html: str) -> None:
        at, lower = 0, None
        while m := _MARK.search(html, at):
            self._add(html[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = html.find("-->", at)
                at = len(html) if end < 0 else end + 3
            elif m[2] is None:  # a declaration, or a tag without an end
                end = html.find(">", at)
                at = len(html) if end < 0 else end + 1
            elif m[1]:
                tag = m[2].lower()
                self._close(tag, set() if tag in BLOCKS else BLOCKS)
            else:
                tag = m[2].lower()
                if tag in RAW and not m[3].endswith("/"):
                    lower = lower or html.lower()
                    end = lower.find(f"</{tag}", at)
                    at = len(html) if end < 0 else end
                    self._open(tag, " hidden")
                else:
                    self._open(tag, m[3])
        self._add(html[at:])
        self._end_block()

    def best(self) -> tuple[int, float]:
        """The container of the page's prose, and its share: the outermost article, else main, that holds at least 70 %, or the deepest container that holds all of it."""
        held, total = [0] * len(self.step), 0
        for element, text, linked in self.blocks:
            held[element] += max(0, len(text) - linked)
            total += max(0, len(text) - linked)
        for i in range(len(held) - 1, 0, -1):  # a parent comes before its children
            held[self.parent[i]] += held[i]
        if not total:
            return 0, 0.0
        for tag in ("article", "main"):
            named = [i for i, n in enumerate(held) if self.tag[i] == tag and 10 * n >= 7 * total]
            if named:
                return named[0], held[named[0]] / total
        best = max((i for i, n in enumerate(held) if n == total and (i == 0 or self.tag[i] in CONTAINERS)), key=lambda i: (self.depth[i], -i))
        return best, 1.0

    def path(self, element: int) -> str:
        """The generalised tags and classes from the root to an element; digits in names are one and the same."""
        steps = []
        while element > 0:
            steps.append(self.step[element])
            element = self.parent[element]
        return STEP.join(reversed(steps))

    def on(self, path: str) -> set[int]:
        """The elements on that path."""
        steps, met, found = path.split(STEP), [True] + [False] * (len(self.step) - 1), set()
        for i in range(1, len(self.step)):
            met[i] = met[self.parent[i]] and self.depth[i] <= len(steps) and self.step[i] == steps[self.depth[i] - 1]
            if met[i] and self.depth[i] == len(steps):
                found.add(i)
        return found

    def text(self, path: str | None) -> str:
        """The blocks inside the containers on that path, or inside the best one."""
        wanted = path and self.on(path) or {self.best()[0]}
        inside = [False] * len(self.step)
        for i in range(len(self.step)):
            inside[i] = i in wanted or (self.parent[i] >= 0 and inside[self.parent[i]])
        return "\n\n".join(t for e, t, _ in self.blocks if inside[e])


def extract(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url", broadcast_rows: int = 50_000) -> DataFrame:
    """keep and text for every row of pages. Winning paths are broadcast if they are of at most broadcast_rows hosts, else joined."""
    host = host_and_path(F.col(url))[0]
    bounded_batches(pages.sparkSession)

    def votes(batches):
        for batch in batches:
            rows = []
            for h, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(body)
                best, share = page.best()
                if best:
                    rows.append((h, page.path(best), share))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["host", "path", "share"])

    counted = pages.select(host.alias("host"), F.col(html).alias("html")).where("html IS NOT NULL").mapInArrow(votes, "host string, path string, share double").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("share"), 6).alias("share"))
    winners = materialise(counted.groupBy("host").agg(F.max(F.struct("n", "share", "path")).alias("best")).select(F.col("host").alias("w_host"), F.col("best.path").alias("w_path")), "paths")

    def texts(batches):
        for batch in batches:
            found = [Page(body).text(path) if body else "" for body, path in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, pa.string())], [*[f"k{i}" for i in range(len(keep))], "text"])

    given = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), F.col(html).alias("html")).join(small_or_none(winners, broadcast_rows), F.col("host") == F.col("w_host"), "left").drop("host", "w_host")
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema.fields[: len(keep)]))
    done = given.mapInArrow(texts, f"{kinds}, text string")
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept_names(keep, ("text",)))], "text")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op4_html_text": op4_html_text}
