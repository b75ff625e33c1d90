"""Main text of web pages: flat text blocks, classified by a small decision tree.

Tags other than inline ones end a block. A block is described by its word count and link
density, those of the blocks before and after it, and what the markup around it says.
A decision tree, grown from the labelled blocks below, tells content from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.text_arrays import small_batches
from factorloom.shipping import ship

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: elements whose content is no text of the page; those that have no end tag take the rest of the page, or only themselves
TO_THE_END = frozenset("script style textarea title".split())
DROPPED = TO_THE_END | frozenset("noscript template select svg math object iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that end by another of their kind
REPEATED = frozenset("p li dt dd td th tr option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements that frame a page, and words of class, id and role names that do
FRAME_TAGS = frozenset("nav footer header aside form menu dialog button fieldset".split())
FRAME_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog discussion disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar".split()
)
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: words that say where or how, not what
PLAIN_WORDS = frozenset("area articles bar block bottom box buttons column container global group inner item items left link links list main outer page panel posts primary right row secondary section site slot stories top unit widget widgets wrap wrapper".split())
#: elements whose class names speak of the page as a whole
WHOLE = frozenset("html body main article".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_OPENS = re.compile("</?[a-zA-Z]")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_PARTS = re.compile("[a-z]+")
_CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in DROPPED}

#: Labelled blocks of pages, a page a line: marks (f: in a frame, c: in marked content, h: a heading, .: none), words, words in links, and + for content.
LABELLED = """
f:6:6- ch:7:0+ c:38:0+ c:12:0+ fc:9:0- c:2:0+ c:51:6+ fc:3:3- f:14:0- f:3:3-
f:9:9- f:12:0- ch:4:0+ c:25:0+ fc:40:0- fc:3:0- c:1:0+ c:3:3+ c:64:0+ f:40:2- .:5:0-
f:4:4- .:3:0- ch:9:0+ ch:3:0+ c:120:9+ c:80:0+ c:6:6+ f:55:0- .:22:0- f:8:8-
c:17:0+ c:5:5+ c:4:0+ c:9:2+ f:33:0- f:2:2- .:30:30- .:2:0-
f:7:7- f:45:1- ch:2:0+ c:8:0+ c:7:0+ c:6:0+ c:8:8+ f:9:0- .:60:4-
ch:11:0+ c:200:0+ f:18:0- c:150:10+ f:25:25- c:3:0+ .:41:0- .:1:1-
f:5:5- .:12:12- c:1:0+ c:44:44+ fc:2:2- c:2:2+ c:70:0+ fch:1:0- fc:62:0- fc:17:2- fc:1:0- f:6:0- f:120:0- .:9:9-
f:30:0- f:30:15- ch:5:5+ fc:11:0- c:16:4+ fc:80:0- fh:3:0- f:48:0- f:22:0- fh:2:0- .:15:1-
.:1:1- .:1:1- .:2:2- h:6:0+ .:45:0+ .:38:2+ .:3:0+ .:52:0+ .:4:4- .:3:3- .:5:0-
.:4:4- .:2:0- h:8:0+ .:61:0+ .:5:0+ .:77:8+ .:29:0+ .:2:2- .:6:0-
.:2:0- .:1:0- .:90:0+ .:14:0+ .:83:3+ .:7:0+ .:3:3- .:3:3- .:4:0-
.:3:3- h:5:0+ .:33:0+ h:3:0+ .:41:5+ .:9:0+ .:36:0+ .:12:12- .:8:8-
.:15:15- .:11:11- .:9:9- h:7:0+ .:28:0+ .:26:1+ .:24:0+ .:20:20- .:18:17- .:3:0-
.:5:5- .:6:6- .:4:4- .:7:7- .:5:5- .:2:0- .:3:0-
.:2:2- .:38:36- .:2:0- .:44:40- .:3:3-
h:4:0+ .:57:0+ .:6:0+ .:49:0+
.:2:2- h:9:0+ .:110:2+ .:4:0+ .:130:0+ .:98:12+ .:6:6- .:1:1- .:7:0-
.:3:0- .:2:2- .:3:3- h:6:0+ .:31:0+ .:8:0+ .:35:0+ .:2:2- .:5:0-
h:10:0+ .:25:0+ .:27:3+ .:4:4- .:6:5- .:4:0- .:2:0-
f:4:4- .:2:0- h:6:0+ .:48:0+ .:10:0+ .:39:4+ f:30:0- f:5:5- f:6:0-
.:300:0+
.:47:0+
.:2:2- .:90:0+
.:3:3- .:4:0- h:6:0+ .:120:0+ .:60:5+
.:80:0+ .:65:4+
.:2:2- h:4:0+ .:44:0+ .:2:0+ .:50:0+ .:1:0+ .:37:0+ .:2:2- .:3:0-
f:7:7- c:26:16+ c:9:6+ c:40:0+ c:31:22+ f:5:0-
f:3:3- c:90:60+ c:4:3+ f:12:0- .:40:30-
f:9:9- ch:1:0+ c:2:0+ c:3:3+ c:1:1+ c:5:0+ c:4:4+ c:2:2+ c:1:0+ c:6:6+ c:3:0+ f:7:0-
f:2:2- ch:5:0+ c:1:0+ c:22:0+ c:2:0+ c:35:30+ c:1:1+ c:60:0+ c:12:12+ c:1:0+ fc:4:4- f:3:0-
ch:6:0+ c:4:0+ c:3:0+ c:2:0+ c:1:0+ c:1:0+ c:2:0+ c:2:2+ c:3:0+ c:17:17+ c:5:4+ f:44:0-
f:4:4- ch:8:8+ c:9:9+ c:1:0+ c:80:70+ c:2:1+ c:4:0+ c:1:1+ c:130:0+ c:2:0+ c:7:0+ fc:20:0- f:2:2-
f:6:0- ch:3:0+ c:14:0+ c:2:0+ c:4:0+ c:1:0+ c:3:3+ c:28:0+ c:1:0+ c:5:5+ c:2:0+ .:33:0- f:9:0-
.:3:0- .:2:0- .:1:0- .:4:0+ .:70:0+ .:4:0+ .:75:0+ .:3:0- .:2:0- .:5:0-
.:2:0- .:5:0- .:1:0- .:2:0- h:7:0+ .:58:0+ .:62:0+ .:6:0- .:3:0- .:4:0-
.:1:0- .:3:0- h:5:0+ .:88:6+ h:2:0+ .:64:0+ h:4:0+ .:93:0+ .:5:0- .:2:0-
f:6:6- c:40:0+ .:70:0- .:6:0- f:4:4-
f:5:5- .:8:0- ch:5:0+ c:61:0+ .:110:2- .:50:0- .:4:0-
.:4:0- ch:3:0+ c:20:0+ .:85:0- .:58:0- .:9:0-
f:8:8- f:21:0- h:5:0+ .:72:0+ .:3:0+ .:66:1+ fh:2:0- f:35:0- f:28:0- f:3:0-
"""
#: place: 1 in the content that a page marks, -1 in a frame or outside marked content, 0 where nothing tells
FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "place", "heading")


@dataclass
class Block:
    text: str
    words: int
    linked: float
    frame: bool
    content: bool
    named: bool  # content by the name of an element's class
    heading: bool


def parts_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, "", ""), (tag, attributes, "/" if it closes itself) or ("", tag, "") for an end tag, in order.

    One pass: a search that finds nothing is not made again, and after a tag whose quotes
    never close, quotes mean nothing.
    """
    missing: set[str] = set()
    quotes = True

    def find(what: str, at: int) -> int:
        k = -1 if what in missing else page.find(what, at)
        if k < 0:
            missing.add(what)
        return k

    def end_of_tag(at: int) -> int:
        nonlocal quotes
        if find(">", at) < 0:
            return -1
        start = at
        while quotes:
            m = _STOP.search(page, at)
            if m is None:
                quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                at = max(find(m[0], m.end()), m.start()) + 1
        return page.find(">", start)

    at, n = 0, len(page)
    while at < n:
        k = page.find("<", at)
        if k < 0:
            yield page[at:], "", ""
            return
        if k > at:
            yield page[at:k], "", ""
        m = _TAG.match(page, k)
        if m:
            closing, tag, rest, at = m[1], m[2].lower(), m[3], m.end()
        elif page.startswith("<!--", k):
            at = find("-->", k + 4)
            at = n if at < 0 else at + 3
            continue
        elif page.startswith(("<!", "<?"), k):
            cdata = page.startswith("<![CDATA[", k)
            end = find("]]>", k) if cdata else -1
            end = end + 2 if end >= 0 else find(">", k)
            if end < 0:
                yield page[k:], "", ""
                return
            at = end + 1
            continue
        else:
            end = end_of_tag(k) if _OPENS.match(page, k) else -1
            if end < 0:
                yield "<", "", ""
                at = k + 1
                continue
            closing, body = page[k + 1] == "/", page[k + 1 : end].lstrip("/")
            tag = re.match("[a-zA-Z0-9:_-]*", body)[0]
            rest, tag, at = body[len(tag) :], tag.lower(), end + 1
        if closing:
            yield "", tag, ""
        elif tag in DROPPED:
            if rest.endswith("/") and tag not in TO_THE_END:
                continue
            close = None if f"</{tag}" in missing else _CLOSES[tag].search(page, at)
            if close:
                end = find(">", close.end())
                at = n if end < 0 else end + 1
            else:
                missing.add(f"</{tag}")
                at = n if tag in TO_THE_END else at
        else:
            yield tag, rest, "/" if rest.endswith("/") else " "


def marks_of(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element frames a page, heads one, or holds content, by its class, id and role names."""
    frame = head = content = False
    for found in _NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            parts = set(_PARTS.findall(name))
            if not parts:
                continue
            framing, last = parts & FRAME_WORDS, _PARTS.findall(name)[-1]
            if framing and (parts <= FRAME_WORDS | PLAIN_WORDS or last in FRAME_WORDS and parts <= FRAME_WORDS | PLAIN_WORDS | CONTENT_WORDS):
                head |= framing <= {"header", "masthead"}
                frame |= not framing <= {"header", "masthead"}
            content |= bool(parts & CONTENT_WORDS) and parts <= CONTENT_WORDS | PLAIN_WORDS
    return frame, head, content


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order; those without text are none."""
    out: list[Block] = []
    outside = ("", False, False, False, False)
    stack = [outside]  # tag; frame, content, named and heading of it or an element around it
    opened: Counter = Counter()
    pieces: list[str] = []
    linked: list[str] = []
    in_link = False

    def end() -> None:
        words = html.unescape("".join(pieces)).split()
        if words:
            inside = len(html.unescape("".join(linked)).split())
            _, frame, content, named, heading = stack[-1]
            out.append(Block(" ".join(words), len(words), min(1.0, inside / len(words)), frame, content, named, heading))
        pieces.clear()
        linked.clear()

    for part, extra, kind in parts_of(page):
        if not kind and part:
            pieces.append(part)
            if in_link:
                linked.append(part)
            continue
        tag = part or extra
        if tag == "br":
            pieces.append(" ")
            linked.append(" ")
            continue
        if tag == "a":
            in_link = bool(part)
        if tag in INLINE:
            continue
        end()
        in_link = False
        if not part:
            if opened[tag]:
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == tag:
                        break
        elif tag not in VOID and kind != "/":
            if tag in REPEATED and stack[-1][0] == tag:
                opened[stack.pop()[0]] -= 1
            _, frame, content, named, heading = stack[-1]
            own, head, holds = marks_of(tag, extra) if "=" in extra and tag not in WHOLE else (False, False, False)
            head |= tag == "header"
            frame |= own or tag in FRAME_TAGS and tag != "header" or head and not (content or named)  # a header inside the content is the content's own
            stack.append((tag, frame, content or tag in CONTENT_TAGS, named or holds, heading or tag in HEADINGS))
            opened[tag] += 1
    end()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """FEATURES of each block. Class names mark content only where no element does."""
    marked = any(b.content and not b.frame for b in blocks)
    content = [b.content if marked else b.named for b in blocks]
    return table_of([(b.words, b.linked, b.frame, c, b.heading) for b, c in zip(blocks, content)])


def table_of(rows: list[tuple[float, float, bool, bool, bool]]) -> np.ndarray:
    """FEATURES of a page's blocks. rows: words, linked, frame, content, heading."""
    x = np.array(rows, float).reshape(-1, 5)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, x[:-1, :2]])[: len(x)], np.concatenate([x[1:, :2], edge])[-len(x) :] if len(x) else x[:, :2]
    inside, framed = x[:, 3] > x[:, 2], x[:, 2] > 0
    place = np.where(inside, 1, np.where(framed | inside.any(), -1, 0)).reshape(-1, 1)
    return np.hstack([x[:, :2], before, after, place, x[:, 4:]])


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled blocks."""
    xs, ys = [], []
    for line in LABELLED.split("\n"):
        blocks = [b[:-1].split(":") for b in line.split()]
        if blocks:
            xs.append(table_of([(int(w), int(k) / int(w), "f" in m, "c" in m, "h" in m) for m, w, k in blocks]))
            ys += [b.endswith("+") for b in line.split()]
    return np.vstack(xs), np.array(ys, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> tuple | bool:
    """A tree of (feature, limit, at most, above) by Gini impurity; leaves are the labels. Of equally good splits the first feature's first."""
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() > 0.5)
    best = (np.inf, 0, 0.0)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for limit in (values[1:] + values[:-1]) / 2:
            left = x[:, k] <= limit
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if cost < best[0] - 1e-12:
                best = (cost, k, float(limit))
    if best[0] == np.inf:
        return bool(y.mean() > 0.5)
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple | bool:
    return grow(*labelled())


def is_content(node: tuple | bool, row: np.ndarray) -> bool:
    while not isinstance(node, bool):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    model = tree()
    return "\n".join(b.text for b, row in zip(blocks, features(blocks).tolist()) if is_content(model, row))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row.

    pages: page_id, url, html; other columns are ignored. Null or empty html, and pages
    without content, give an empty text. Ids and urls are returned as they are, null or
    repeated. An empty table gives no rows. Whole pages are read, in time that grows with
    their length, and nothing in an article is dropped but what frames it.
    """
    ship(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [main_text(p) for p in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").alias("text"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
