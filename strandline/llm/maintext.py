"""Main text of web pages by consensus of their hosts.

Every page scores its containers: text outside links counts for the container that holds it, and half as much for
the one around that.  A container is known by its generalised path, the tags and classes from the root with digits left
out (a digest of them, so that deep nesting stays linear).  The pages of a host vote on paths with the shares of their
scores; each page is then read again and gives the text of the article around the winning path: below the nearest
article or main, or else the lowest container with nearly all of its text.  A page without that container uses its
own best path, and one with as much text elsewhere gives both.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import materialise
from .common import slices, small

CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr th blockquote pre figure "
                                "figcaption hr address summary details caption fieldset".split())
# Elements that never hold main text, and class, id or role words that say the same.
DROPPED = frozenset("nav header footer aside form button select head menu dialog iframe object svg canvas video audio "
                    "noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LABELS = frozenset("label legend".split())
#: Parts of names that say where or how an element stands, not what it holds.
LAYOUT = frozenset("a area bar block body bottom box btn button buttons card center col column container content desktop "
                   "entry form group icon icons inline inner item items left link links list main mobile mid "
                   "module outer page panel post posts right row section site slot title top ul unit wrap wrapper".split())
#: Share of a page's text outside links that a container needs to stand for the page.
NEARLY_ALL = 0.9
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|"
    r"notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|nav|navbar|"
    r"navigation|menu|breadcrumbs?|pagination|pager|sidebar|widget|footer|header|masthead|topbar|toolbar|comments?|"
    r"replies|disqus|share|sharing|social|related|recommended|complementary|contentinfo|search)(?:$|[\s_-]|\d)")
_HEADER = re.compile("(?<![a-z])header(?![a-z])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_REST = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


def _step(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "", c) for c in attributes.get("class", "").lower().split()} - {""})
    return ".".join([tag, *classes])


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(text)} if text.strip() else {}


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", text, "") in page order.

    Comments, declarations and the content of raw elements are skipped.
    """
    at, n, quotes = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        close = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + close)
        if not name:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        rest = _REST.match(page, name.end()) if quotes else None
        if rest:
            end = rest.end()
        else:                                       # a quote that never closes: no tag needs to be searched to the end again
            quotes = False
            end = page.find(">", name.end()) + 1 or n
        tag = name.group().lower()
        if close:
            yield "close", tag, ""
        else:
            inside = page[name.end():end - 1]
            yield "open", tag, inside
            if tag in RAW and not inside.endswith("/"):
                stop = re.compile(f"</{tag}", re.I).search(page, end)
                end = stop.start() if stop else n
        at = end


class Page:
    """Blocks of a page and its container paths, each path a number above that of the path around it.

    ``keys`` name a path alike on all pages: a digest of its last step and of the key around it.
    """

    def __init__(self):
        self.ups, self.steps, self.keys, self.depths = [0], [""], [""], [0]
        self._known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, float]] = []          # path, text, share of it in links

    def child(self, up: int, step: str) -> int:
        node = self._known.get((up, step))
        if node is None:
            node = self._known[up, step] = len(self.ups)
            self.ups.append(up)
            self.steps.append(step)
            self.keys.append(hashlib.blake2b(f"{self.keys[up]}>{step}".encode(), digest_size=16).hexdigest())
            self.depths.append(self.depths[up] + 1)
        return node

    def node(self, key: str) -> int | None:
        return self.keys.index(key) if key in self.keys else None

    def upwards(self, node: int) -> list[int]:
        """The path, and those around it up to the page."""
        out = [node]
        while out[-1]:
            out.append(self.ups[out[-1]])
        return out

    def sums(self, weight: Callable[[str, float], float]) -> list[float]:
        """Sum of the blocks' weights inside every path."""
        total = [0.0] * len(self.ups)
        for node, text, linked in self.blocks:
            total[node] += weight(text, linked)
        for node in range(len(total) - 1, 0, -1):
            total[self.ups[node]] += total[node]
        return total

    def below(self, node: int) -> list[str]:
        inside = [False] * len(self.ups)
        for n in range(len(inside)):
            inside[n] = n == node or (n > 0 and inside[self.ups[n]])
        return [text for n, text, _ in self.blocks if inside[n]]


class _Block:
    __slots__ = ("node", "form", "parts", "linked")

    def __init__(self, node: int, form: int):
        self.node, self.form, self.parts, self.linked = node, form, [], 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def _unwanted(words: str, article: bool) -> bool:
    """Whether class, id or role words tell an element that is no main text.

    In an article a name does so only if all its parts are such words or words of layout: ``related-links`` does,
    ``related-work`` does not.
    """
    if not _DROPPED_WORDS.search(words):
        return False
    if not article:
        return True
    for name in words.split():
        parts = [p for p in re.split(r"[\W\d_]+", name) if p]
        if any(_DROPPED_WORDS.search(p) for p in parts) and all(p in LAYOUT or _DROPPED_WORDS.search(p) for p in parts):
            return True
    return False


def read_page(page: str) -> Page:
    """The blocks outside dropped elements, in page order.

    A form around a page's content (an article, or paragraphs with over half of the text) is no form to fill in and
    stays, without its labels.  Of an article's own header the headings stay.
    """
    found = Page()
    out: list[_Block] = []
    stack: list[tuple[str, str, int]] = []          # open elements that matter: tag, kind, path around them
    count: Counter[str] = Counter()                 # of their tags and kinds
    prose: dict[int, str] = {}                      # what the forms hold
    node = form = forms = links = 0
    heading = False
    block = _Block(0, 0)

    def done():
        nonlocal block
        if block.parts:
            out.append(block)
        block = _Block(node, form)

    for kind, what, more in events(page):
        if kind == "text":
            if not count["dropped"] and (heading or not count["titles"]):
                block.parts.append(what)
                if links:
                    block.linked += len(what.strip())
        elif kind == "open":
            if what == "br":
                block.parts.append(" ")
            if what in BLOCKS or what in DROPPED:
                done()
            if what in VOID or what in RAW:
                continue
            if what == "a":
                links += 1
                continue
            heading = what in HEADINGS or (heading and what not in BLOCKS)
            if form and not count["dropped"] and what in ("article", "main", "p"):
                prose[form] = "p" if what == "p" and prose.get(form) != "article" else "article"
            if what not in CONTAINERS and what not in DROPPED and what not in LABELS and not more.strip():
                continue                            # plain inline and text blocks need no place on the stack
            attributes = _attributes(more)
            words = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()
            own, article = "", count["article"] > 0
            bare = _HEADER.sub("", words) if article else words         # an article's own header is not the page's
            if "hidden" in attributes or attributes.get("aria-hidden") == "true" or (
                    what not in ("html", "body", "article", "main") and _unwanted(bare, article)):
                own = "dropped"
            elif what == "form" and not article and not form:
                own = "form"
            elif article and (what == "header" or (bare != words and what in CONTAINERS)):
                own = "titles"
            elif what in DROPPED or (form and what in LABELS):
                own = "dropped"
            elif what in ("article", "main"):
                own = "article"
            if what in CONTAINERS or own:
                stack.append((what, own, node))
                count["<" + what] += 1
                count[own] += 1
                if own == "form":
                    forms += 1
                    form = forms
                if not count["dropped"]:
                    node = found.child(node, _step(what, attributes))
                if what not in BLOCKS and what not in DROPPED:
                    continue
                block = _Block(node, form)
        else:
            if what == "a":
                links = max(0, links - 1)
                continue
            if what in BLOCKS or what in DROPPED:
                done()
            if what in HEADINGS:
                heading = False
            if count["<" + what]:
                while True:
                    tag, own, node = stack.pop()
                    count["<" + tag] -= 1
                    count[own] -= 1
                    if own == "form":
                        form = 0
                    if tag == what:
                        break
                links, heading = 0, False
                done()
    done()
    texts = [(b, t) for b in out if (t := b.text())]
    sizes = Counter()
    for b, t in texts:
        sizes[b.form] += len(t)
    kept = {f for f in sizes if not f or prose.get(f) == "article" or (f in prose and 2 * sizes[f] > sizes.total())}
    found.blocks = [(b.node, t, min(1.0, b.linked / max(1, len(t)))) for b, t in texts if b.form in kept]
    return found


def _outside_links(text: str, linked: float) -> float:
    return len(text) * (1 - linked)


def container_scores(page: Page) -> dict[int, float]:
    """Scores of a page's container paths, as shares of their sum."""
    scores: dict[int, float] = {}
    for node, text, linked in page.blocks:
        value = _outside_links(text, linked)
        scores[node] = scores.get(node, 0.0) + value
        if up := page.ups[node]:
            scores[up] = scores.get(up, 0.0) + 0.5 * value
    total = sum(scores.values())
    return {k: v / total for k, v in scores.items()} if total else {}


def whole_article(page: Page, node: int) -> int:
    """The container of the whole article around a path: the nearest article or main, else the lowest one that holds
    nearly all text outside links."""
    ups = page.upwards(node)
    for n in ups:
        if page.steps[n].split(".")[0] in ("article", "main"):
            return n
    value = page.sums(_outside_links)
    return next((n for n in ups if value[n] >= NEARLY_ALL * value[0]), 0)


def main_text(page: Page, key: str | None) -> str:
    """The page's text in the whole article around the path ``key``; around its own best path too if that is elsewhere and
    holds as much, around that alone if the page has nothing below ``key``."""
    wanted = None if key is None else page.node(key)
    scores = container_scores(page)
    if not scores:
        kept = page.below(whole_article(page, wanted)) if wanted is not None and page.below(wanted) else []
        return "\n".join(kept or [t for _, t, linked in page.blocks if linked < 1])
    own = whole_article(page, min(scores, key=lambda n: (-round(scores[n], 9), page.depths[n], page.keys[n])))
    if wanted is None or not page.below(wanted):
        return "\n".join(page.below(own))
    best = whole_article(page, wanted)
    size = page.sums(lambda text, linked: len(text))
    around = set(page.upwards(own))
    if best not in around and size[own] >= size[best]:
        best = next(n for n in page.upwards(best) if n in around)
    return "\n".join(page.below(best))


def text_below(found: list[tuple[tuple[str, ...], str, float]], path: str | None) -> str:
    """``main_text`` of blocks given with the steps of their paths, around a path written as ``body>div.a``."""
    page = Page()

    def place(steps):
        node = 0
        for step in steps:
            node = page.child(node, step)
        return node
    page.blocks = [(place(steps), text, linked) for steps, text, linked in found]
    return main_text(page, None if path is None else page.keys[place(path.split(">") if path else ())])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            hosts, paths, depths, shares = [], [], [], []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = read_page(text.as_py() or "")
                for node, share in container_scores(page).items():
                    hosts.append(host)
                    paths.append(page.keys[node])
                    depths.append(page.depths[node])
                    shares.append(int(share * 1e6))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(
                depths, pa.int32()), pa.array(shares, pa.int64())], ["host", "path", "depth", "share"])


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, path``: the key of the path with most votes of each host (of equals the outermost, then the least key)."""
    votes = (pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
             .mapInArrow(_votes, "host string, path string, depth int, share long")
             .groupBy("host", "path", "depth").agg(F.sum("share").alias("votes")))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "depth", "path")).alias("best")) \
        .select("host", "best.path")


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The columns of ``pages`` in a struct ``row``, with ``main_text``.

    A null or empty page has an empty text; pages without url share the host ''.  Equal pages of one host get equal
    texts.  White space is that of Unicode, so a no-break space becomes a blank.
    """
    paths = materialise(host_paths(pages, url, page), "host-paths")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
                        host_of(F.col(url)).alias("_host"))
    joined = rows.join(small(paths.select(F.col("host").alias("_host"), F.col("path").alias("_path"))), "_host", "left")

    @F.arrow_udf("string")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for htmls, wanted in batches:
            yield pa.array([main_text(read_page(h.as_py() or ""), p.as_py()) for h, p in zip(htmls, wanted)],
                           pa.string())
    return joined.withColumn("main_text", read(F.col("row")[page], F.col("_path"))).select("row", "main_text")
