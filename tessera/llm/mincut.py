"""Operator 6 — main text of web pages by minimum-cut labelling.

A page is cut into blocks at its block-level tags.  A linear classifier gives each block's log odds of being
content: from its own text (length, sentence marks, share of links), from the containers around it (tags, roles,
words of class and id), and from what the words of class and id have been seen with.  Those last weights are
learnt without labels: over all pages, grouped aggregation counts how often a word stands around blocks that HTML's
own elements mark as boilerplate (``nav``, ``footer``, ``aside`` ...) and around running text in ``article`` or ``main``.

The costs of calling a block one or the other are capacities to the source and the sink.  Blocks that follow each
other, or follow each other inside one container, are joined by smoothness edges: strong between blocks under the
same evidence, weak across a container that speaks for itself, weaker the further apart they lie in the tree.  The
minimum cut, by max-flow, is the labelling of least total cost; the source side is content.  So a short line among
paragraphs is kept and a long one in a notice is not, whatever each says alone.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by a line feed in page order.

Defined results: null, empty and text-free pages give an empty text; broken markup is read on (a tag
that isn't closed ends with its container, a stray end tag is ignored, a "<" that starts no tag is text); repeated
rows each have their result; null ids and urls pass through; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
WORD = re.compile(r"[a-z]+")
OPEN = re.compile(r"<(?:/?[A-Za-z]|[!?])[^<>]*\Z")
# fixed values: HTML's block-level and empty elements
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption button".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
TAG_ODDS = {"nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "menu": -7.0, "dialog": -7.0, "button": -7.0, "search": -7.0, "fieldset": -4.0, "head": -14.0, "article": 2.5, "main": 1.5}
ROLE_ODDS = {"navigation": -7.0, "banner": -7.0, "contentinfo": -7.0, "complementary": -7.0, "search": -7.0, "alert": -7.0, "dialog": -7.0, "alertdialog": -7.0, "menu": -7.0, "menubar": -7.0, "form": -7.0, "main": 1.5, "article": 2.5}
#: Words of class and id that name boilerplate wherever they stand, and those that may also name a part of an article.
STRONG = frozenset(
    "nav navbar navigation menu menus submenu masthead topbar footer sidebar ad ads adv advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promoted promotion banner banners cookie cookies consent gdpr popup overlay modal newsletter subscribe subscription signup login register sharing social comment comments commentlist respond replies disqus breadcrumb breadcrumbs recommended recommendations teaser teasers toolbar pagination pager".split()
)
DOUBTFUL = frozenset("header bottom side rail aside notice notices alert dialog share reply discussion related widget widgets form search copyright legal disclaimer paywall skip tags toc".split())
GOOD_WORDS = frozenset("article main content post entry story text body prose".split())
BAD, DOUBT, GOOD = -6.5, -4.0, 1.0
#: Smoothness between neighbours under the same evidence, and across; what a learnt word counts at most.
SAME, ACROSS, LEARNT = 1.2, 0.25, 2.0
#: Words on fewer pages than this say nothing; of the others the most frequent so many are kept.
LEAST_PAGES, KEPT_WORDS = 20, 20_000
ARTICLE = frozenset(("article", "main"))
MARKED = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "search"))


class Box:
    """A container: its tag, its parent, how deep it lies, what speaks against and for what it holds, and the words around it."""

    __slots__ = ("tag", "parent", "depth", "bad", "good", "words", "owner", "article")

    def __init__(self, tag: str, parent: "Box | None", attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.article = tag in ARTICLE or bool(parent and parent.article)
        words: set[str] = set()
        own = [TAG_ODDS.get(tag, 0.0)]
        if tag == "header" and not self.article:
            own.append(-7.0)
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                if m[5]:
                    own.append(-14.0)
                    continue
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id") and tag not in ("body", "html"):
                    words.update(WORD.findall(value))
                elif name == "role":
                    own.append(ROLE_ODDS.get(value, 0.0))
                elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    own.append(-14.0)
        if words & STRONG:
            own.append(BAD)
        elif words & DOUBTFUL:
            own.append(DOUBT if not self.article else -1.0)
        elif words & GOOD_WORDS:
            own.append(GOOD)
        self.bad = min(*own, parent.bad if parent else 0.0, 0.0)
        self.good = max(*own, parent.good if parent else 0.0, 0.0)
        self.words = frozenset(words) | parent.words if parent else frozenset(words)
        self.owner = self if any(own) or parent is None else parent.owner  # the nearest container that says something


def _inside(box: "Box | None", tag: str) -> bool:
    while box:
        if box.tag == tag:
            return True
        box = box.parent
    return False


def blocks_of(page: str) -> list[tuple[str, float, Box]]:
    """(text, share of it in links, innermost container) of each block that has text."""
    out: list[tuple[str, float, Box]] = []
    box = Box("", None, "")
    parts: list[str] = []
    linked, links = 0, 0

    def flush():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append((text, min(1.0, linked / len(text)), box))
        parts, linked = [], 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            parts.append(raw)
            if links:
                linked += len(raw.strip())
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1]:
                flush() if m[1].lower() == "title" else parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m[2] else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if m[2]:
                found = box
                while found and found.tag != tag:
                    found = found.parent
                if found and found.parent is not None:
                    box = found.parent
            elif tag not in EMPTY:
                while box.parent is not None and tag in CLOSES.get(box.tag, ()):
                    box = box.parent
                box = Box(tag, box, m[4])
            if tag not in ("li", "p"):
                links = 0
    parts.append(OPEN.sub("", page[at:]))  # a tag that the page's end cuts off
    flush()
    return out


def text_odds(text: str, links: float, box: Box) -> float:
    """What a block's own text says: running text is long, has sentence marks and few links."""
    marks = sum(text.count(c) for c in ".,;:!?")
    own = -1.2 + min(len(text) / 120, 2.0) + min(marks, 3) * 0.4 - 4.0 * links
    if box.tag in ("h1", "h2", "h3", "h4", "p", "blockquote", "pre", "math"):
        own += 0.8
    return max(-3.0, min(2.5, own))


def log_odds(text: str, links: float, box: Box, learnt: dict[str, float]) -> float:
    """The classifier: the text, the containers, and the learnt words around it (the strongest each way)."""
    told = [learnt[w] for w in box.words if w in learnt] if learnt else []
    return text_odds(text, links, box) + box.bad + box.good + min(0.0, *told, 0.0) + max(0.0, *told, 0.0)


def edges_of(boxes: list[Box]) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the next, and with the one before it inside the same parent."""
    out, last = [], {}
    for i, box in enumerate(boxes):
        if i:
            a, b = boxes[i - 1], box
            same = a.owner is b.owner
            steps = 0
            while a is not b:
                if a.depth >= b.depth:
                    a = a.parent
                else:
                    b = b.parent
                steps += 1
            out.append((i - 1, i, (SAME if same else ACROSS) / max(1.0, steps / 2)))
        parent = id(box.parent)
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, ACROSS))
        last[parent] = i
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut (the side that the source still reaches)."""
    n = len(source)
    left = [a - b for a, b in zip(source, sink)]  # what is left of the terminal capacities after the direct paths
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    eps = 1e-12
    for start in range(n):
        while left[start] > eps:
            came, queue, goal = {start: -1}, [start], -1
            for node in queue:
                for to, w in room[node].items():
                    if w > eps and to not in came:
                        came[to] = node
                        if left[to] < -eps:
                            goal = to
                            break
                        queue.append(to)
                if goal >= 0:
                    break
            if goal < 0:
                break
            push, node = min(left[start], -left[goal]), goal
            while came[node] >= 0:
                push, node = min(push, room[came[node]][node]), came[node]
            node = goal
            while came[node] >= 0:
                room[came[node]][node] -= push
                room[node][came[node]] += push
                node = came[node]
            left[start] -= push
            left[goal] += push
    side = [x > eps for x in left]
    queue = [i for i in range(n) if side[i]]
    for node in queue:
        for to, w in room[node].items():
            if w > eps and not side[to]:
                side[to] = True
                queue.append(to)
    return side


def labelled(page: str | None, learnt: dict[str, float]) -> list[tuple[str, float, bool]]:
    """(text, log odds, whether the cut calls it content) of each block."""
    blocks = blocks_of(page or "")
    odds = [log_odds(*b, learnt) for b in blocks]
    # calling a content block boilerplate cuts its edge from the source, and the other way round
    source = [math.log1p(math.exp(z)) for z in odds]
    sink = [math.log1p(math.exp(-z)) for z in odds]
    side = minimum_cut(source, sink, edges_of([b[2] for b in blocks]))
    return [(b[0], z, keep) for b, z, keep in zip(blocks, odds, side)]


def main_text(page: str | None, learnt: dict[str, float] | None = None) -> str:
    return "\n".join(text for text, _, keep in labelled(page, learnt or {}) if keep)


def _seen(batches):
    """How many pages have a word around running text of an article, and around what HTML marks as boilerplate; '' counts pages with either."""
    good, bad = Counter(), Counter()

    def flush():
        words = list(good.keys() | bad.keys())
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([good[w] for w in words], pa.int64()), pa.array([bad[w] for w in words], pa.int64())], ["word", "good", "bad"])
        good.clear()
        bad.clear()
        return out

    for b in batches:
        for page in b.column(0).to_pylist():
            near, marked = set(), set()
            for text, links, box in blocks_of(page or ""):
                if box.bad <= -7.0 and _inside_any(box, MARKED):
                    marked |= box.words | {""}
                elif box.article and box.bad > DOUBT and text_odds(text, links, box) > 1.0:
                    near |= box.words | {""}
            good.update(near)
            bad.update(marked)
            if len(good) + len(bad) > 200_000:
                yield flush()
    yield flush()


def _inside_any(box: "Box | None", tags: frozenset[str]) -> bool:
    while box:
        if box.tag in tags:
            return True
        box = box.parent
    return False


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Words of class and id -> log odds of content, from all pages; words on fewer than ``LEAST_PAGES`` and all but ``KEPT_WORDS`` are left out."""
    seen = pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(tidy(_seen), "word string, good long, bad long")
    counts = seen.groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    total = counts.where("word = ''").first()
    if not total or not total.good or not total.bad:
        return {}
    often = counts.where((F.col("word") != "") & (F.col("good") + F.col("bad") >= LEAST_PAGES)).orderBy(F.desc(F.col("good") + F.col("bad")), "word").limit(KEPT_WORDS)
    odds = {r.word: math.log((r.good + 0.5) / (total.good + 1)) - math.log((r.bad + 0.5) / (total.bad + 1)) for r in often.collect()}
    return {w: max(-LEARNT, min(LEARNT, 0.5 * z)) for w, z in odds.items()}


def _extract(shared):
    def run(batches):
        learnt = shared.value
        for b in batches:
            texts = [main_text(x, learnt) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", learnt: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; the words' weights are learnt from ``pages`` unless given."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(learn(rows) if learnt is None else learnt)
    return rows.mapInArrow(tidy(_extract(shared)), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
