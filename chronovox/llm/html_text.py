"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf path of block tags.  For every
path the text length and the punctuation per block are summed; both sequences are smoothed along the
page and fused by multiplication: a path's ratio, as a share of the best one.  Text times ratio, summed,
is the value of each container; containers of a good share of the best one's value are content, and so
are their like if those are mostly content.  Where a page names its article, smaller containers within
stay too.  Paths below the threshold go if they are mostly links.  Words in class and id decide where
they name what never counts (comments, adverts, menus); other words do where ratios are low.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.llm.common import batched, table

#: Share of the largest fused ratio that a content path reaches.
THRESHOLD = 0.2
#: Share of the largest value of a container that makes another one content by itself.
SURE = 0.5
#: Share of the value of containers that are alike from which the rest of them is content, too.
ALIKE = 0.8
#: Marks of punctuation, at least, in a container of the article whose class has a doubtful word.
PROSE = 3
#: Blocks on each side that a ratio is smoothed over.
RADIUS = 1

#: Elements without text for readers, elements around the article, elements that hold a
#: block of text, and elements that never close.
_SKIP = frozenset("script style noscript template iframe object svg canvas audio video math head title select option textarea button datalist".split())
_AROUND = frozenset("nav footer aside form menu dialog".split())
_BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address hr details summary center menu dialog hgroup".split()
)
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: A start tag of these closes an open element of the listed kinds.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",)}
#: Words in a container's class that mark what isn't the article (whole words of a name), and those
#: that do so only where the ratios don't speak for prose.
_MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsors sponsored promo promos comment comments commentlist disqus replies respond sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login pagination pager".split()
)
_DOUBTFUL = frozenset("discussion side header notice alert share sharing social related recommended widget search skip legal copyright promotion".split())
#: Those that also count in an id within the article, where an id may be no more than an anchor.
_MARKED_ID = frozenset("ad ads advert adverts advertisement banner sponsored comment comments commentlist disqus respond sidebar nav navbar navigation breadcrumbs footer cookie cookies consent newsletter".split())
#: Those that count on paragraphs, items, cells and inline elements.
_ADVERT = frozenset("ad ads advert adverts advertisement advertising sponsored promo".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Names of the article itself, and beginnings of names that only tell what is beside it.
_PLAIN = frozenset("article content main post entry story body page wrapper".split())
_BESIDE = frozenset("has with no without".split())
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class that names the article's own container.
_NAMED = frozenset("article content main post entry story".split())
#: Elements whose flow of blocks is selected as a whole.
_FLOWS = frozenset("html body main article section div center td th header hgroup fieldset details address".split())
#: Elements that words mark as a whole.
_CONTAINERS = frozenset("div section ul ol dl table center fieldset details figure header hgroup article address".split())
#: Elements that an article may be.
_HOLDERS = frozenset("html body main article section div td center".split())
_COMMENT = frozenset("comment comments reply replies".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，；：！？、]")


class Block:
    """A block of text: its path of tags and its innermost element, by number."""

    __slots__ = ("path", "node", "tag", "text", "linked")

    def __init__(self, path: int, node: int, tag: str):
        self.path, self.node, self.tag, self.text, self.linked = path, node, tag, [], 0


class Page:
    """A page's blocks in order, and for each element its tag, path and parent, the outermost article about
    it, whether it is within a container named as the article, and the element of doubtful class about it."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parent, self.article, self.tags, self.path = [-1], [-1], ["body"], [-1]
        self.named, self.doubt = [False], [-1]


def parse(page: str) -> Page:
    """The text blocks of a page in order, without those of skipped and marked elements.

    Open paragraphs close at the next block, list items and cells at the next of their kind; an end
    tag closes up to its element, or nothing if none is open.  One pass: what has no end tag is looked
    for once, and paths are numbers.
    """
    out = Page()
    stack: list[tuple[str, int, bool, int]] = []  # block tag, its number, whether it is away from the article, path
    paths: dict[tuple[int, str], int] = {}
    opened: dict[str, int] = defaultdict(int)
    endless: set[str] = set()
    links, away, hidden, current = 0, 0, ["", 0], None
    pos, end = 0, len(page)

    def text(s: str) -> None:
        nonlocal current
        if away or hidden[1] or not s:
            return
        if current is None:
            if s.isspace():
                return
            tag, node, _, path = stack[-1] if stack else ("", 0, False, -1)
            current = Block(path, node, tag)
            out.blocks.append(current)
        current.text.append(s)
        if links:
            current.linked += len(s.strip())

    def close(to: int) -> None:
        nonlocal current, away
        current, hidden[1] = None, 0
        while len(stack) > to:
            tag, _, gone, _ = stack.pop()
            opened[tag] -= 1
            away -= gone

    def after(name: str, what: str) -> re.Match | None:
        """The next match, or None; after a None the pattern is not looked for again."""
        if what in endless:
            return None
        found = re.compile(what, re.I).search(page, pos)
        if found is None:
            endless.add(what)
        return found

    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        slash, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if hidden[1] and name == hidden[0]:
            hidden[1] += -1 if slash else 1
            if slash:
                continue
        if slash:
            if name == "a":
                links = max(0, links - 1)
            elif opened[name] > 0:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if stack[k][0] in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "article", "main", "section", "div"):
                        break
            elif name == "p":
                current = None
            continue
        if name in _SKIP:
            if not attrs.rstrip().endswith("/"):
                stop = after(name, rf"</{name}\s*>")
                if name == "head" and stop is None:
                    stop = after(name, r"<body\b")
                    pos = stop.start() if stop else pos
                else:
                    pos = stop.end() if stop else (end if name in ("script", "style", "textarea", "title") else pos)
            continue
        if name == "br":
            text(" ")
            continue
        if name == "a":
            links = 1
        if name not in _BLOCK:
            if not hidden[1] and name not in _VOID and "=" in attrs and _is_marked(name, attrs, True):
                hidden[:] = [name, 1]
            continue
        current, hidden[1] = None, 0
        if name == "hr":
            continue
        # an open paragraph ends here; so do an open item or cell of the same list or table
        if name not in _SCOPE or any(opened[t] for t in ("p", *_HEADINGS, *_CLOSES.get(name, ()))):
            for k in range(len(stack) - 1, -1, -1):
                tag = stack[k][0]
                if tag == "p" or tag in _HEADINGS and (name in _HEADINGS or name == "p"):
                    close(k)
                    break
                if tag in _CLOSES.get(name, ()):
                    close(k)
                    continue
                if tag in _SCOPE.get(name, ()) or tag not in _CLOSES.get(name, ()) and name not in _SCOPE:
                    break
        node, up = len(out.parent), stack[-1][1] if stack else 0
        inside = out.article[up]
        gone = name in _AROUND or _is_marked(name, attrs, inside >= 0) or name == "header" and inside < 0
        if name in ("html", "body", "main"):
            gone = False
        label = name
        if attrs and name in ("div", "section", "td", "li", "article"):
            cls = _value(attrs, "class").split()
            label = f"{name}.{cls[0]}" if cls else name
        path = paths.setdefault((stack[-1][3] if stack else -1, label), len(paths))
        out.parent.append(up)
        out.tags.append(name)
        out.path.append(path)
        out.named.append(out.named[up] or name in ("article", "main") or bool(attrs) and name in ("div", "section") and _marks(_value(attrs, "class"), _NAMED, frozenset()))
        doubtful = bool(attrs) and out.doubt[up] < 0 and name in _CONTAINERS and name != "article" and (_marks(_value(attrs, "class"), _DOUBTFUL) or inside < 0 and _marks(_value(attrs, "id"), _DOUBTFUL))
        out.doubt.append(node if doubtful else out.doubt[up])
        out.article.append(inside if inside >= 0 else node if name in ("article", "main") and not gone else -1)
        stack.append((name, node, gone, path))
        opened[name] += 1
        away += gone
    for b in out.blocks:
        b.text = _SPACE.sub(" ", html.unescape("".join(b.text))).strip()
    out.blocks = [b for b in out.blocks if b.text]
    return out


def _value(attrs: str, key: str) -> str:
    return next((a or b or c for k, a, b, c in _ATTR.findall(attrs) if k.lower() == key), "")


def _marks(value: str, words: frozenset, plain: frozenset = _PLAIN) -> bool:
    """Whether one of the names in value has a marked word, and none is the article's own."""
    names = [[w.lower() for w in _WORDS.findall(n)] for n in value.split()]
    if any(len(n) == 1 and n[0] in plain for n in names):
        return False
    for n in names:
        hit = [w for w in n if w in words]
        if hit and n[0] not in _BESIDE and not (set(hit) <= {"header", "side"} and _PLAIN & set(n)):
            return True
    return False


def _is_marked(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is hidden or, by its class, id or role, not part of the article."""
    if not attrs or name in ("html", "body", "main"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and name not in _HEADINGS and value.lower() in _ROLES:
            return True
        if key not in ("class", "id") or name in _HEADINGS:
            continue
        if name == "article":
            words = _COMMENT
        elif name not in _CONTAINERS:
            words = _ADVERT
        else:
            words = _MARKED_ID if key == "id" and inside else _MARKED
        if _marks(value, words):
            return True
    return "hidden" in _ATTR.sub(" ", attrs).split()


def path_ratios(found: list[Block], radius: int = RADIUS) -> dict[int, float]:
    """Each path's fused, smoothed ratio of text and punctuation, as a share of the best path's."""
    length, punct, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in found:
        length[b.path] += max(0, len(b.text) - b.linked)
        punct[b.path] += len(_PUNCT.findall(b.text))
        count[b.path] += 1
    order = list(count)  # by first place in the page
    text_ratio = np.array([length[p] / count[p] for p in order])
    punct_ratio = np.array([punct[p] / count[p] for p in order])
    width = np.arange(-radius, radius + 1)
    kernel = np.exp(-(width**2) / max(1.0, 2 * radius**2))
    norm = np.convolve(np.ones(len(order)), kernel, "same")[: len(order)] if len(order) >= len(kernel) else None
    smooth = lambda x: np.convolve(x, kernel, "same") / norm if norm is not None else x
    # a path alone counts for itself; its neighbours only lift it
    fused = np.maximum(text_ratio, smooth(text_ratio)) * (1 + np.maximum(punct_ratio, smooth(punct_ratio)))
    total = np.array([length[p] for p in order])
    fused = np.where(total > 0, fused * np.log1p(total), 0)
    return dict(zip(order, (fused / (fused.max() or 1)).tolist(), strict=True))


def _flows(got: Page) -> list[int]:
    """The container in whose flow each block stands; a cell with text of its own belongs to what is about the table."""
    around = [0]
    for n in range(1, len(got.tags)):
        around.append(n if got.tags[n] in _FLOWS else around[got.parent[n]])
    return [around[got.parent[b.node]] if b.node and got.tags[b.node] in ("td", "th") else around[b.node] for b in got.blocks]


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, joined by an empty line; '' if there is none.

    Containers are selected by value: text times ratio of its path, summed over the blocks of its own
    flow.  The smallest element that holds nearly all of that value, within the article that the page
    names, if it does, bounds the result.  In it stay the selected containers; all others of the same
    path and parent, if the selected ones are most of these; what is within an article or a container
    of such a name; and those that hold no more than headings.  A container of doubtful name stays only
    with prose of high ratio.  A path below the threshold goes if most of its text is links.
    """
    if not page:
        return ""
    got = parse(page)
    if not got.blocks:
        return ""
    both = list(zip(got.blocks, _flows(got), strict=True))
    both = [x for x in both if got.article[x[0].node] >= 0] or both
    pool, flows = [x[0] for x in both], [x[1] for x in both]
    ratio = path_ratios(pool)
    value, prose, heads, doubt = defaultdict(float), defaultdict(float), defaultdict(lambda: True), defaultdict(lambda: [0, 0, 0])
    for b, n in zip(pool, flows, strict=True):
        own = max(0, len(b.text) - b.linked)
        value[n] += own * ratio[b.path]
        heads[n] = heads[n] and b.tag in _HEADINGS
        if got.doubt[b.node] >= 0:
            d = doubt[got.doubt[b.node]]
            d[0], d[1], d[2] = d[0] + own * (ratio[b.path] >= SURE), d[1] + len(b.text), d[2] + len(_PUNCT.findall(b.text))
    foreign = {n for n, (good, size, marks) in doubt.items() if 2 * good < size or marks < PROSE}
    gone = lambda n: got.doubt[n] in foreign
    if all(gone(b.node) for b in pool):
        return ""
    best = max(v for n, v in value.items() if not gone(n))
    chosen = {n for n, v in value.items() if v >= SURE * best and v > 0 and not gone(n)} or {n for n in value if not gone(n)}
    alike = defaultdict(lambda: [0.0, 0.0, 0])
    for n, v in value.items():
        a = alike[got.parent[n], got.path[n]]
        a[0], a[1], a[2] = a[0] + v * (n in chosen), a[1] + v, a[2] + (n in chosen)
    kind = lambda n: alike[got.parent[n], got.path[n]]
    chosen |= {n for n in value if kind(n)[2] > 1 and kind(n)[0] >= ALIKE * kind(n)[1] and not gone(n)}
    weight, held = [0.0] * len(got.parent), defaultdict(float)
    for b, n in zip(pool, flows, strict=True):
        if n in chosen:
            weight[b.node] += len(b.text)
            held[got.article[b.node]] += len(b.text)
    total = sum(held.values())
    for n in range(len(weight) - 1, 0, -1):  # a parent's number is smaller
        weight[got.parent[n]] += weight[n]
    # the innermost element that holds nearly all of the content, and not less than its article
    root = max(n for n, w in enumerate(weight) if w >= 0.9 * total)
    while got.tags[root] not in _HOLDERS:  # one paragraph may be most of an article
        root = got.parent[root]
    outer = max(held, key=lambda n: (held[n], -n))
    if outer >= 0 and held[outer] >= 0.9 * total:
        root = min(root, outer)
    # a container named as the article bounds the result, not the largest part of it
    up = root
    while up > 0 and got.named[up]:
        root, up = up, got.parent[up]
    inside = [n == root for n in range(len(weight))]
    for n in range(root + 1, len(weight)):
        inside[n] = inside[got.parent[n]]
    kept = [b for b, n in zip(pool, flows, strict=True) if inside[b.node] and not gone(b.node) and (n in chosen or got.named[n] or heads[n])]
    linked, size = defaultdict(int), defaultdict(int)
    for b in kept:
        linked[b.path] += b.linked
        size[b.path] += len(b.text)
    return "\n\n".join(b.text for b in kept if ratio[b.path] >= THRESHOLD or b.tag in _HEADINGS or 2 * linked[b.path] < size[b.path])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or empty page, and one without text outside its menus and notices, gives '' and 0; null
    page_id and url stay null; repeated rows give repeated results; other columns play no part.
    """

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = [main_text(p.as_py()) for p in batch.column(names.index("html"))]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(names.index("page_id")), "url": batch.column(names.index("url")), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return batched(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
