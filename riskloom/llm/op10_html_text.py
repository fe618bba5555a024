"""HTML extraction by the maximum-scoring subsequence.

A page becomes a sequence of words and tags.  Words score positive by the
element that holds them, tags score negative; one linear scan finds the
contiguous region with the largest sum, the main text.  The weights are learned
from labelled pages: pages whose author marked the content with <article>,
<main> or itemprop="articleBody".  For each class of word (its innermost
boilerplate container, link or block element) and each tag (with its boilerplate
container), counts inside and outside the mark give

    word weight = P(inside | class)              in (0, 1)
    tag weight  = -TAG_COST * (0.05 + P(outside | tag))

with additive smoothing towards prior weights, so a page without marks, or a
corpus without any, is still scored.  At most TRAIN_PAGES labelled pages
(smallest hash of page_id) are counted; extraction reads every whole page.
Boilerplate inside a mark, which is left out anyway, costs nothing in the scan,
and a region that touches a mark is widened to all of it.

Inside the region, boilerplate containers (menus, headers and footers outside
the article, sidebars, notices, adverts, forms, scripts, styles, reader
comments) are left out.  Layout words count as whole class tokens (``sidebar``,
``site-footer``; not ``has-sidebar``).  A content mark ends the boilerplate around
it, and a container that holds a mark, or most of the words of a page (or of the
mark around it) with no marked text elsewhere, is no boilerplate, unless it is named
for reader comments; boilerplate opened inside a mark stays out.  Blocks end at block elements; <br> is white space.
Character references are decoded, white space inside a block becomes one
space, blocks are joined by one line feed.

Defined cases: null or empty html, or a page without words, gives an empty text
with n_chars 0.  Broken markup (unclosed or stray tags, truncated pages) is
read as far as it goes: an end tag closes the nearest open element of its name
or is ignored.  Very long pages are read whole.  Ties between regions go to the
first.  Repeated rows give repeated results.  Empty tables give no rows.  Only
page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import common as C

TRAIN_PAGES = 2000
TAG_COST = 4.0
SMOOTH = 20.0

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody "
                  "td tfoot th thead title tr ul".split())
NOT_TEXT = frozenset("script style textarea title noscript xmp iframe head template svg math object canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside form button select menu dialog label input".split())
#: Words of class and id attributes that name boilerplate.
NAMES = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb "
                  "breadcrumbs sidebar side aside widget footer foot header masthead notice cookie cookies consent gdpr alert popup modal "
                  "overlay comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe "
                  "subscription signup login search tags pagination pager toolbar".split())
#: Words that may stand beside them in a compound token, as in site-footer or comment-list.
PARTS = frozenset("area bar block body bottom box button buttons column container form icons inner item items link links list main media "
                  "posts primary secondary section site top wrap wrapper".split())
HEADS = frozenset("header head masthead".split())
COMMENTS = frozenset("comment comments respond reply replies disqus".split())
_CONTENT = frozenset(("article", "main"))
_CLOSES_P = BLOCK - {"body", "html", "head", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "title", "legend"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
                    r"|<[!?/][^>]*>|<(?:[a-zA-Z/!?][^>]*)\Z", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[-_]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("open", name, attributes) and ("close", name, "") in page order."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at:m.start()]
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or m[6] or ""
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            yield "close", name, ""


def _named(attributes: str) -> frozenset[str]:
    """The layout words of whole class, id, role and itemprop tokens."""
    found: set[str] = set()
    for a, b, c in _ATTR.findall(attributes):
        for token in (a or b or c).lower().split():
            parts = {x for x in _PART.split(token) if x and not x[0].isdigit()}
            if parts <= NAMES | PARTS:
                found |= parts & NAMES
    return frozenset(found)


class Page:
    """The word runs and tags of a page in order.

    ``events``: (class, words, block) for a word run, (tag, 0, -1) for a tag;
    ``inside``: whether it lies in marked content; ``kept``: whether it is text
    outside of boilerplate.  ``text``: the characters of each run; ``mark_of``:
    the outermost content mark around each event (0: none).
    """

    def __init__(self, page: str):
        self.events: list[tuple[str, int, int]] = []
        self.inside: list[bool] = []
        self.kept: list[bool] = []
        self.text: list[str] = []
        # Of each element: parent, own boilerplate class or "", whether it is a content mark, the mark around it (0: none),
        # whether it holds reader comments, its words outside of links.
        self._up, self._own, self._mark, self._within, self._talk, self._words = [0], [""], [False], [0], [False], [0]
        self._at: list[int] = []                        # element of each event
        stack: list[tuple[str, int, bool, bool]] = []   # name, element, whether hidden, whether in a link
        block = 0
        for kind, name, rest in tokens(page):
            if kind == "text":
                self._run(rest, stack, block)
                continue
            if name == "br":
                self._add(" ", stack, block)
                continue
            if name in BLOCK:
                block += 1
            if kind == "open":
                if name in _CLOSES_P:
                    self._close("p", stack, {"button", "table", "td"})
                elif name in ("li", "td", "th", "tr", "option", "dt", "dd"):
                    self._close(name, stack, {"ul", "ol", "table", "select", "dl"})
                self._tag(name, stack)
                if name not in VOID and not rest.rstrip().endswith("/"):
                    self._open(name, rest, stack)
            else:
                self._close(name, stack, set())
                self._tag(name, stack)
        self._resolve()

    def _open(self, name: str, rest: str, stack: list) -> None:
        up = stack[-1][1] if stack else 0
        within = up if self._mark[up] else self._within[up]
        names = _named(rest) if rest and name not in ("body", "html") else frozenset()
        if within:
            names -= HEADS
        body = "articlebody" in rest.lower()
        talk = bool(names) and names <= COMMENTS
        marked = body or name in _CONTENT and not (name == "article" and talk)
        if name in NOT_TEXT:
            group = "hidden"
        elif marked:
            group = ""
        elif name in BOILERPLATE or name == "header" and not within:
            group = name
        else:
            group = "named" if names else ""
        stack.append((name, len(self._up), group == "hidden" or bool(stack) and stack[-1][2], name == "a" or bool(stack) and stack[-1][3]))
        for column, value in ((self._up, up), (self._own, group), (self._mark, marked), (self._within, within), (self._talk, talk),
                              (self._words, 0)):
            column.append(value)

    @staticmethod
    def _close(name: str, stack: list, limit: set) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            if stack[k][0] in limit:
                return

    def _tag(self, name: str, stack: list) -> None:
        at = stack[-1][1] if stack else 0
        if name == "header" and (self._mark[at] or self._within[at]):
            name = "div"                                # the heading of the content, not of the site
        self.events.append((name if name in BLOCK else "inline", 0, -1))
        self.text.append("")
        self._at.append(at)

    def _run(self, raw: str, stack: list, block: int) -> None:
        self._add(entities.unescape(raw), stack, block)

    def _add(self, text: str, stack: list, block: int) -> None:
        _, at, hidden, link = stack[-1] if stack else ("", 0, False, False)
        if hidden:
            return
        words = len(text.split())
        if not link:
            self._words[at] += words
        self.events.append((next((s[0] for s in reversed(stack) if s[0] in BLOCK or s[0] == "a"), "none"), words, block))
        self.text.append(text)
        self._at.append(at)

    def _resolve(self) -> None:
        """Decide what is boilerplate, now that the words and marks of every element are known."""
        up, own, mark, within, words = self._up, self._own, self._mark, self._within, self._words
        holds, marked = [False] * len(up), [0] * len(up)   # whether it holds a mark, words of it in marked content
        for k in range(len(up) - 1, 0, -1):
            if mark[k]:
                marked[k] = words[k]
            words[up[k]] += words[k]
            marked[up[k]] += marked[k]
            holds[up[k]] |= holds[k] or mark[k]
        group = [""] * len(up)
        for k in range(1, len(up)):
            g = own[k]
            if g == "hidden" or group[up[k]] == "hidden":
                group[k] = "hidden"
                continue
            if g and within[k]:
                if g == "form" and holds[k] or 2 * words[k] > words[within[k]] and not self._talk[k]:
                    g = ""
            elif g and (holds[k] or 2 * words[k] > words[0] and not marked[0] and not self._talk[k]):
                g = ""
            group[k] = g or ("" if mark[k] and not within[k] else group[up[k]])
        top = [0] * len(up)                                # the outermost mark that is no boilerplate itself
        for k in range(1, len(up)):
            top[k] = top[up[k]] or (k if mark[k] and not group[k] else 0)
        self.mark_of = [top[at] for at in self._at]
        for k, (name, words_, block) in enumerate(self.events):
            g, at = group[self._at[k]], self._at[k]
            inside = bool(mark[at] or within[at])
            if g and top[at]:
                self.events[k] = ("", 0, block)            # left out of the content: neither words nor tags count
            elif block < 0:
                self.events[k] = (f"<{g}:{name}>" if g else f"<{name}>", 0, -1)
            elif g:
                self.events[k] = (g, words_, block)
            self.inside.append(inside)
            self.kept.append(block >= 0 and not g)

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """First event and end of the contiguous region with the largest sum (linear scan)."""
        best, total, start, where = 0.0, 0.0, 0, (0, 0)
        for i, (name, words, _) in enumerate(self.events):
            total += words * weights.get(name, WORD_PRIOR) if words else (weights.get(name, TAG_PRIOR) if name[:1] == "<" else 0.0)
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, where = total, (start, i + 1)
        return where

    def widened(self, i: int, j: int) -> tuple[int, int]:
        """The region and all of every content mark that it touches."""
        touched = {m for m in self.mark_of[i:j] if m}
        if touched:
            at = [k for k, m in enumerate(self.mark_of) if m in touched]
            i, j = min(i, at[0]), max(j, at[-1] + 1)
        return i, j

    def extract(self, weights: dict[str, float]) -> str:
        i, j = self.widened(*self.region(weights))
        blocks: list[list[str]] = []
        last = None
        for k in range(i, j):
            if self.kept[k]:
                if self.events[k][2] != last:
                    blocks.append([])
                    last = self.events[k][2]
                blocks[-1].append(self.text[k])
        texts = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(t for t in texts if t)


WORD_PRIOR, TAG_PRIOR = 0.6, -0.3
#: Prior weights of word classes and tags, for pages unlike any labelled one.
PRIOR = {"nav": 0.01, "footer": 0.01, "aside": 0.01, "form": 0.01, "button": 0.01, "select": 0.01, "menu": 0.01, "dialog": 0.01,
         "label": 0.01, "input": 0.01, "header": 0.02, "named": 0.01, "a": 0.2, "li": 0.4, "p": 0.95, "h1": 0.8, "body": 0.5, "none": 0.4,
         "<nav>": -4.0, "<footer>": -4.0, "<aside>": -3.0, "<header>": -3.0, "<form>": -3.0, "<p>": -0.2, "<inline>": -0.2}


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights of word classes and tags from labelled pages; the prior ones where there is none."""
    def count(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}
            for text in b.column("html").to_pylist():
                page = Page(text or "")
                if any(page.inside):
                    for (name, words, _), inside in zip(page.events, page.inside):
                        if name:
                            seen.setdefault(name, [0, 0])[inside] += words if name[0] != "<" else 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()),
                                              pa.array([v[0] for v in seen.values()], pa.int64())], names=["name", "inside", "outside"])

    marked = F.col("html").rlike(r"(?i)<article[\s>]|<main[\s>]|articlebody")
    sample = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).where(marked) \
        .select(F.xxhash64("page_id").alias("h"), "page_id")
    ids = sample.orderBy("h", "page_id").limit(TRAIN_PAGES).select("page_id").distinct()    # at most TRAIN_PAGES rows
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")) \
        .join(F.broadcast(ids), "page_id", "left_semi").select("html").mapInArrow(count, "name string, inside long, outside long") \
        .groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()   # as many rows as HTML elements
    weights = dict(PRIOR)
    for r in rows:
        if r["name"][0] == "<":
            prior = min(1.0, max(0.0, -PRIOR.get(r["name"], TAG_PRIOR) / TAG_COST - 0.05))
            weights[r["name"]] = -TAG_COST * (0.05 + (r["o"] + SMOOTH * prior) / (r["i"] + r["o"] + SMOOTH))
        elif r["i"] + r["o"]:
            weights[r["name"]] = (r["i"] + SMOOTH * PRIOR.get(r["name"], WORD_PRIOR)) / (r["i"] + r["o"] + SMOOTH)
    return weights


def html_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    C.prepare(pages.sparkSession)
    if weights is None:
        weights = learn(pages)

    def run(batches):
        for b in batches:
            texts = [Page(h).extract(weights) if h else "" for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(C.load(spark, sf_dir, "pages"))
