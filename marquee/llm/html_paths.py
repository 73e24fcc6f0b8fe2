"""Main text of HTML pages by tag-path ratios.

Pages are cut into text blocks, each under a root-to-leaf tag path. Per path, text length and punctuation are summed over
its blocks and divided by their number; the ratios are fused, smoothed over neighbouring blocks and thresholded. The article is the
blocks that pass, with the short headings and paragraphs next to them; containers only say which neighbours belong together. Parts
that by their tag, role or class are page furniture (menus, adverts, forms, comments, ...) take no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_text, no_clash

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
FURNITURE_TAGS = frozenset("nav footer aside form script style noscript iframe template button select option textarea svg canvas object embed audio video dialog menu head title label input fieldset datalist output progress meter map math".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split())
FURNITURE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot adbox banner banners sponsor sponsored promo promos promotion
nav navbar navigation menu menus submenu breadcrumb breadcrumbs topbar toolbar masthead header footer foot copyright legal sidebar sidebars rail widget widgets aside
notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup signin login register paywall
share sharing social follow comment comments commentlist disqus reply replies respond discussion reactions related recommended recommendations trending popular
pagination pager tags taglist search form hidden skip""".split())
KEEP_WORDS = frozenset("article content main body post entry story text".split())
WEAK_WORDS = frozenset("header form search follow alert popular tags legal foot response respond hidden skip".split())
SECTIONS = frozenset("article main section div td body html center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre dd dt figcaption address".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"[>\"']")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
_LINE = "\n"


def _is_furniture(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is page furniture; inside: within an article or main element, whose own header stays."""
    if tag in FURNITURE_TAGS or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value)}
            found = words & FURNITURE_WORDS
            if tag in ("article", "main"):
                found &= {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "related", "promo"}
            elif inside or words & KEEP_WORDS:
                found -= WEAK_WORDS
            if found:
                return True
    return False


class Block:
    """A run of text between block boundaries: its text, path (a number), last tag, innermost container, articles and length of link text."""

    __slots__ = ("text", "path", "tag", "container", "named", "links")

    def __init__(self, text, path, tag, container, named, links):
        self.text, self.path, self.tag, self.container, self.named, self.links = text, path, tag, container, named, links


class Container:
    """A sectioning element: its parent and depth, and the articles that it lies in, itself included."""

    __slots__ = ("parent", "depth", "named")

    def __init__(self, parent, named):
        self.parent, self.depth, self.named = parent, parent.depth + 1 if parent else 0, named


class _Open:
    """An open element: its tag, whether it is furniture, the number of its path, and the innermost container."""

    __slots__ = ("tag", "bad", "path", "container")

    def __init__(self, tag, bad, path, container):
        self.tag, self.bad, self.path, self.container = tag, bad, path, container


def _tokens(page: str):
    """(text before, end tag?, tag, attributes, position after) of each tag, in time linear in the page; last the text after the last tag, with no tag.

    A quoted attribute may hold `>`; if its quote is never closed, the tag ends at the next `>` all the same. Without any `>` to
    come, what is left is text. Comments, declarations and CDATA are left out.
    """
    at, begin, end = 0, 0, len(page)
    last = page.rfind(">")
    closed = {'"': page.rfind('"'), "'": page.rfind("'")}
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        opener = page[lt + 1 : lt + 2]
        if opener in ("!", "?"):
            mark = next((m for m in ("<!--", "<![CDATA[") if page.startswith(m, lt)), None)
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(mark, ">")
            stop = page.find(close, lt + len(mark or "<!"))
            at = end if stop < 0 else stop + len(close)
            yield page[begin:lt], False, "", "", at
            begin = at
            continue
        m = _NAME.match(page, lt + 1) if lt < last else None
        if not m:
            at = lt + 1
            continue
        where = m.end()
        while (q := _TAG_END.search(page, where)) and q[0] != ">":
            if q.start() >= closed[q[0]]:
                q = None
                break
            where = page.find(q[0], q.end()) + 1
        stop = q.start() if q else page.find(">", m.end())
        if stop < 0:
            at = lt + 1
            continue
        at = stop + 1
        got = yield page[begin:lt], bool(m[1]), m[2].lower(), page[m.end() : stop], at
        if got is not None:  # the reader has gone on to a later position
            at = got
            yield None
        begin = at
    yield page[begin:], False, "", "", end


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, without furniture. Unclosed and misnested tags are closed as browsers do, roughly.

    Paths are numbered as they are met, so that deep pages take no more than their length.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    numbers: dict[tuple[int, str], int] = {}
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links = furniture = inside = in_link = 0
    root = Container(None, ())

    def place() -> tuple[int, str, Container]:
        """Path, last block tag and container of what is open now."""
        if not stack:
            return 0, "", root
        top = stack[-1]
        return top.path, tags[top.path], top.container

    tags = [""]

    def flush():
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                path, tag, container = place()
                out.append(Block(text, path, tag, container, container.named, links))
            parts, links = [], 0

    def pop():
        nonlocal furniture, inside, in_link
        top = stack.pop()
        open_tags[top.tag] -= 1
        furniture -= top.bad
        inside -= top.tag in ("article", "main")
        in_link -= top.tag == "a"

    def close_inline_run(tag: str) -> bool:
        """Pops up to an open `tag` if only inline elements lie above it."""
        k = len(stack) - 1
        while k >= 0 and stack[k].tag != tag and stack[k].tag in INLINE:
            k -= 1
        if k < 0 or stack[k].tag != tag:
            return False
        while len(stack) > k:
            pop()
        return True

    reader = _tokens(page)
    for text, closing, tag, attrs, at in reader:
        if text and not furniture:
            parts.append(text)
            if in_link:
                links += len(text.strip())
        if not tag:
            continue
        if closing:
            if tag not in INLINE and tag != "br":
                flush()
            if open_tags[tag]:
                # An inline end tag does not close blocks that were opened inside it.
                if tag in INLINE:
                    close_inline_run(tag)
                else:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
            continue
        if tag in CLOSES_P and open_tags["p"]:
            k = len(stack) - 1
            while k >= 0 and stack[k].tag in INLINE:
                k -= 1
            if k >= 0 and stack[k].tag == "p":
                flush()
                close_inline_run("p")
        for group in (("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)):
            if tag in group and stack and stack[-1].tag in group:
                flush()
                pop()
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        bad = _is_furniture(tag, attrs, inside > 0)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            reader.send(close.end() if close else len(page))
            continue
        if attrs.rstrip().endswith("/") and tag not in CLOSES_P and tag not in INLINE:
            continue
        path, _, container = place()
        if tag not in INLINE:
            number = numbers.setdefault((path, tag), len(tags))
            if number == len(tags):
                tags.append(tag)
            path = number
        if tag in SECTIONS:
            new = Container(container, ())
            new.named = (*container.named, new) if tag in ("article", "main") else container.named
            container = new
        stack.append(_Open(tag, bad, path, container))
        open_tags[tag] += 1
        furniture += bad
        inside += tag in ("article", "main")
        in_link += tag == "a"
    flush()
    return out


def path_scores(blocks: list[Block], width: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Fused score of each block's path (0 if most of the path's text is links), the same smoothed over the page, and the threshold."""
    paths = [b.path for b in blocks]
    names = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    code = np.array([names[p] for p in paths])
    size = np.array([len(b.text) for b in blocks], float)
    linked = np.minimum([b.links for b in blocks], size)
    own = size - linked
    marks = np.array([len(_PUNCTUATION.findall(b.text)) for b in blocks], float)
    count = np.bincount(code)
    length, stops = np.bincount(code, own) / count, np.bincount(code, marks) / count
    spread = np.sqrt(np.maximum(np.bincount(code, own**2) / count - length**2, 0))
    prose = 2 * np.bincount(code, linked) <= np.bincount(code, size)
    fused = (prose * np.log1p(length) * np.log1p(stops + 0.1) * (1 + np.log1p(spread)))[code]
    reach = max(1, round(2 * width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    padded = np.pad(fused, reach, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), "valid")
    return fused, smooth, 0.5 * float(smooth.std()) + 0.1 * float(smooth.mean())


def _nested(a: Block, b: Block) -> bool:
    """Whether one block lies in the innermost container of the other."""
    x, y = a.container, b.container
    while x.depth > y.depth:
        x = x.parent
    while y.depth > x.depth:
        y = y.parent
    return x is y


def _joins(block: Block, near: Block, before: bool) -> bool:
    """Whether a block that did not pass belongs to its neighbour, which did; before: it stands before the neighbour."""
    if block.named and near.named and block.named[0] is near.named[0]:
        return True
    if block.tag in HEADINGS:
        return before
    return block.tag in PROSE and _nested(block, near)


def select(blocks: list[Block]) -> np.ndarray:
    """Which blocks are the article's.

    A block passes if its path's score and the smoothed one reach the threshold. Of the others, none of which is mostly links, those
    join that stand between passing ones of the same place, and headings, short paragraphs and parts of the same article element
    next to chosen ones.
    """
    fused, smooth, least = path_scores(blocks)
    chosen = (fused > 0) & (fused >= least) & (smooth >= least)
    free = np.array([2 * b.links <= len(b.text) for b in blocks])
    sure = np.flatnonzero(chosen)
    for lo, hi in zip(sure[:-1], sure[1:], strict=True):
        if hi > lo + 1 and free[lo + 1 : hi].all() and _nested(blocks[lo], blocks[hi]):
            chosen[lo + 1 : hi] = True
    for i in range(1, len(blocks)):
        chosen[i] |= chosen[i - 1] and free[i] and _joins(blocks[i], blocks[i - 1], False)
    for i in range(len(blocks) - 2, -1, -1):
        chosen[i] |= chosen[i + 1] and free[i] and _joins(blocks[i], blocks[i + 1], True)
    return chosen


def main_text(page: str | None) -> str:
    """The article's blocks joined by newlines; empty for null, empty and furniture-only pages and for those of links alone."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    return _LINE.join(b.text for b, c in zip(blocks, select(blocks), strict=True) if c)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", extra: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, extra columns, text, n_chars) per row from the whole page; n_chars counts code points. Carried columns may not be named text or n_chars."""
    no_clash([id_col, *extra], "text", "n_chars")
    columns = [F.col(id_col), *map(F.col, extra), F.col(html_col)]
    head = df.select(*columns[:-1]).schema

    def fn(batch: pa.RecordBatch, _):
        texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        return [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head) + ", text string, n_chars long"
    return map_text(df, columns, fn, schema)
