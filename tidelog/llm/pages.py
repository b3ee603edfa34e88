"""Main text of web pages by tag-path ratios.

A page is split into blocks, each with its root-to-leaf path of block tags and their classes. Text length
and punctuation are summed for each path and divided by its number of blocks; link text does not count.
Paths in order of first appearance are smoothed with a Gaussian, the length and punctuation ratios are fused
by their product, weighed by the evidence of the names on the path, and thresholded: paths whose own and
smoothed scores reach a share of the spread are content, and so is the path with most weighed text.

The article or main around a chosen path, or without one the parent of the best path, adds the headings,
lists and short paragraphs it holds, but no lists of links and nothing under a name or tag that speaks
against it inside. Names (comments, sidebar, advert ...), forms, page headers and articles inside articles
only lower a path's weight, so an element that holds all of a page loses nothing by its name. Menus,
footers, asides, buttons, hidden elements and the like are left out by their tag, role or attribute.

One forward pass reads a page; every step is linear in its length, however deep or broken the markup.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, table

#: A tag to its end; quotes count after an equals sign only. Group 4 is a quote that nothing closes.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(["']).*+)?+)*+)(>?)""", re.S)
ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template iframe textarea select svg title".split()}
#: What runs to the page's end if it is not closed; the others are passed over then.
OPEN_RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset("html head body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption article section header footer nav aside main form fieldset blockquote pre figure figcaption address details summary hr center button label dialog menu".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: An open element of the key closes before one of these begins.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Steps between a parent and the text that belongs to it.
FLOW = HEADINGS | frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header center".split())
CONTAINERS = frozenset(("article", "main"))
OUT_TAGS = frozenset("head nav footer aside button label dialog menu".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar alertdialog".split())
DOUBTFUL_TAGS = frozenset(("form", "fieldset"))
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|menu\w*|nav\w*|breadcrumbs?|cookies?\w*|consent|gdpr|notices?|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscribe|signup|login|share|sharing|social\w*|related|recommend\w*|comments?|commentlist|replies|reply|responses?|discuss\w*|feedback|disqus|respond|footer\w*|foot|header|masthead|topbar|toolbar|widget\w*|pagination|pager|skip|print-only)(?:$|[\s_-])",
    re.I,
)
#: Names that tell of a layout, or of an article's own header: no evidence.
LAYOUT_NAMES = re.compile(r"(?:^|(?<=\s))(?:[\w-]*[_-])?(?:(?:no|with|has|without|hide|show)[_-][\w-]+|[\w-]+[_-](?:layout|open|closed|enabled|disabled|wrapper|container)|(?:entry|post|article|content|story|page|section)[_-]+header)(?=$|\s)", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？]")

#: Weight of a path for each doubtful name, and for each doubtful tag, on it.
NAME_WEIGHT = 0.02
TAG_WEIGHT = 0.1
LEAST_WEIGHT = 1e-12
#: Characters that text under a doubtful name needs to be a page's main text.
DOUBTFUL_CHARS = 140


def doubtful_name(label: str) -> bool:
    return bool(NAMES.search(LAYOUT_NAMES.sub("", label)))


class Path:
    """A node of the tree of paths; equal steps under equal paths are one path."""

    __slots__ = ("parent", "step", "tag", "out", "weight", "own_weight", "container", "doubt", "next", "text", "dots", "blocks", "link", "order")

    def __init__(self, parent, step, tag, out, weight, own_weight, container):
        self.parent, self.step, self.tag, self.out, self.weight, self.own_weight = parent, step, tag, out, weight, own_weight
        self.container = self if container else (parent.container if parent else None)
        #: the nearest path with a doubtful name or tag, itself or around it
        self.doubt = None if parent is None else self if own_weight < parent.own_weight else parent.doubt
        self.next: dict = {}
        self.text = self.dots = self.blocks = self.link = 0
        self.order = -1


def blocks(page: str) -> list[tuple[str, Path]]:
    """``text, path`` of each block with text that is not left out, in page order; paths have their sums."""
    names: dict[str, bool] = {}
    root = Path(None, "", "", False, 1.0, 1.0, False)
    stack = [root]
    open_: dict[str, int] = {}
    unclosed: set[str] = set()
    out: list[tuple[str, Path]] = []
    buffer: list[str] = []
    links: list[str] = []
    paths = 0
    in_link = False
    end = len(page)

    def flush():
        nonlocal paths
        path = stack[-1]
        if buffer and not path.out:
            text = " ".join(_html.unescape("".join(buffer)).split())
            if text:
                linked = min(sum(map(len, links)), len(text))
                if path.order < 0:
                    path.order, paths = paths, paths + 1
                path.text += len(text) - linked
                path.link += linked
                path.dots += len(PUNCTUATION.findall(text)) if linked < len(text) else 0
                path.blocks += 1
                out.append((text, path))
        buffer.clear()
        links.clear()

    def words(a, b):
        if a < b:
            raw = page[a:b]
            buffer.append(raw)
            if in_link:
                links.append(raw)

    at = text_from = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        c = page[at + 1 : at + 2]
        if c in ("!", "?"):
            words(text_from, at)
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                stop = end if stop < 0 else stop + 3
            else:
                stop = page.find(">", at)
                stop = end if stop < 0 else stop + 1
            at = text_from = stop
            continue
        m = TAG.match(page, at)
        if not m:
            at += 1
            continue
        words(text_from, at)
        stop = m.end()
        if not m[5]:  # no end outside quotes: the first end after the open quote, if any
            stop = page.find(">", m.start(4)) if m[4] else -1
            stop = end if stop < 0 else stop + 1
        attributes = page[m.end(2) : stop]
        at = text_from = stop
        name = m[2].lower()
        closing = bool(m[1])
        if name in RAW:
            if not closing and name not in unclosed:
                close = RAW[name].search(page, at)
                if close:
                    at = text_from = close.end()
                elif name in OPEN_RAW:
                    at = text_from = end
                else:
                    unclosed.add(name)
            continue
        if name not in BLOCKS:
            if name == "a":
                in_link = not closing
            elif name in ("br", "img"):
                buffer.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            if open_.get(name):
                while True:
                    gone = stack.pop().tag
                    open_[gone] -= 1
                    if gone == name:
                        break
            continue
        if name in VOID:
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].tag, ()):
            open_[stack.pop().tag] -= 1
        parent = stack[-1]
        attrs = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attributes)} if len(attributes) > 4 else {}
        label = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        role = attrs.get("role", "").lower()
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or ("style" in attrs and bool(HIDDEN_STYLE.search(attrs["style"])))
        step = (name, label, role, hidden, attrs.get("itemprop", ""))
        path = parent.next.get(step)
        if path is None:
            is_container = name in CONTAINERS or role in CONTAINERS or step[4].lower() == "articlebody"
            weight = own = 1.0
            if label and name not in ("html", "body"):
                if label not in names:
                    names[label] = doubtful_name(label)
                if names[label]:
                    weight = own = NAME_WEIGHT
            if name in DOUBTFUL_TAGS or role == "form" or (name == "article" and parent.container is not None and parent.container.tag == "article"):
                weight, own = weight * TAG_WEIGHT, own * TAG_WEIGHT
            if name == "header" and parent.container is None:  # a page's header, or that of an article without a tag
                weight *= NAME_WEIGHT
            out_here = parent.out or name in OUT_TAGS or role in OUT_ROLES or (hidden and name not in ("html", "body"))
            path = Path(parent, step, name, out_here, max(parent.weight * weight, LEAST_WEIGHT), max(parent.own_weight * own, LEAST_WEIGHT), is_container)
            parent.next[step] = path
        stack.append(path)
        open_[name] = open_.get(name, 0) + 1
    words(text_from, end)
    flush()
    return out


def _smooth(x: list[float], reach: list[float]) -> list[float]:
    n = len(reach) - 1
    out = []
    for i in range(len(x)):
        near = [(x[i + d], reach[abs(d)]) for d in range(-n, n + 1) if 0 <= i + d < len(x)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def _inside(region: Path) -> list[Path]:
    """The paths at or under region, by one walk down from it."""
    found, todo = [], [region]
    while todo:
        p = todo.pop()
        if p.order >= 0:
            found.append(p)
        todo.extend(p.next.values())
    return found


def content_paths(found: list[tuple[str, Path]], spread: float = 0.5, width: float = 1.0) -> set[Path]:
    """The paths whose blocks are the page's main text."""
    paths = sorted({id(p): p for _, p in found}.values(), key=lambda p: p.order)
    if not paths:
        return set()
    ratio = [p.text / p.blocks for p in paths]
    dots = [p.dots / p.blocks for p in paths]
    reach = [math.exp(-(d * d) / (2 * width * width)) for d in range(3)]
    score = [a * (1 + b) * p.weight for a, b, p in zip(_smooth(ratio, reach), _smooth(dots, reach), paths, strict=True)]
    own = [a * (1 + b) * p.weight for a, b, p in zip(ratio, dots, paths, strict=True)]
    mean = sum(score) / len(score)
    limit = spread * math.sqrt(sum((s - mean) ** 2 for s in score) / len(score))
    best = max(paths, key=lambda p: (p.text * (1 + min(1, p.dots)) * p.weight, -p.order))
    if not best.text or (best.weight < 1 and best.text < DOUBTFUL_CHARS):
        return set()
    around_best, up = {None}, best
    while up is not None:
        around_best.add(up)
        up = up.parent
    chosen = {p for p, s, o in zip(paths, score, own, strict=True) if s >= limit and o >= max(limit, 1e-300) and p.dots and p.doubt in around_best} | {best}
    content = set(chosen)

    regions = {id(p.container): p.container for p in chosen if p.container is not None}
    if best.container is not None:  # other articles beside the best one's that are no mere teasers
        around = best.container
        size = sum(p.text for p in _inside(around))
        for other in around.parent.next.values():
            if other.container is other and other.weight >= around.weight and not other.out and 5 * sum(p.text for p in _inside(other)) >= size:
                regions[id(other)] = other
    above: dict[int, Path | None] = {}  # the nearest region around each container met on the way up
    for region in list(regions.values()):
        up, met = region.parent.container if region.parent else None, []
        while up is not None and id(up) not in regions and id(up) not in above:
            met.append(up)
            up = up.parent.container if up.parent else None
        up = above[id(up)] if up is not None and id(up) not in regions else up
        above |= dict.fromkeys(map(id, met), up)
        if up is not None and up.own_weight == region.own_weight:
            continue  # the one around it adds all that this one would
        for p in _inside(region):
            if p.own_weight >= region.own_weight and (p.link <= p.text or p.tag in HEADINGS):
                content.add(p)
    if best.container is None:
        near = best.parent or best
        todo = [near]
        while todo:
            q = todo.pop()
            if q.order >= 0 and q.own_weight >= near.own_weight and (q.link <= q.text or q.tag in HEADINGS) and (q.tag != "header" or near.tag != "body"):
                content.add(q)
            todo.extend(n for n in q.next.values() if n.tag in FLOW and not (n.tag == "header" and near.tag in ("body", "html", "")) or n.parent is near and n.order >= 0 and not n.next and n.own_weight >= near.own_weight and n.text >= n.link and n.tag in ("div", "section", "address", "details"))
    if not any(p.tag == "h1" for p in content):  # a title before the article
        first = min(p.order for p in content)
        content |= {p for p in paths if p.tag == "h1" and p.blocks == 1 and p.order < first and p.weight == 1}
    return content


def main_text(page: str) -> str:
    found = blocks(page)
    content = content_paths(found)
    return "\n".join(text for text, path in found if path in content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, a row for each row of pages.

    Null and empty pages, and pages without content, have an empty text. Cut-off pages give what is there, a
    tag or quote left open goes to the next ``>``. Equal rows give equal rows; null ids and urls stay null. An
    empty table gives none. A page takes time in proportion to its length, whatever its markup.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h or "") for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9(spark, sf_dir):
    return extract(dealt(table(spark, sf_dir, "pages")))


QUERIES = {"op9_page_text": op9}
SQL: dict[str, str] = {}
