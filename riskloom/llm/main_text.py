"""Operator 3: main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks of text at block-level tags. Each block has its
word count and link density and those of the blocks before and after it, and
what its enclosing elements say: whether one of them is page furniture (by tag
name, role, class or id), whether it lies in an article, whether the page has
an article, and whether it is a heading. A decision tree, fitted by Spark ML on
the small labelled table below, keeps or drops each block; the fitted tree is a
few nodes and goes to every task.

An element is furniture if it or an element around it is named so, but not by
an element that wraps the page's main text: one around a ``main``, or, where no
article is free of furniture, one around the article of most words, unless its
name is one of ``_NEVER_WRAPS`` or the page has more words outside furniture;
nor by a form with over half the words of a page without articles. Names that
only tell of furniture (has-sidebar, no-ads, comments-open) do not count.

Scripts, styles and other elements without readable text are never blocks.

Cases: null and empty pages have empty text; unclosed elements end with their
parent, and unclosed comments with the page; text outside any element is a
block; repeated rows are each extracted; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# words, link density; the same of the block before and after; furniture, in article, page has article, heading; main text?
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "in_article", "has_article", "heading")
LABELLED = [
    # an article page: article paragraphs, headings, short lines, link lists and tables inside
    (60, 0.0, 8, 0.0, 55, 0.0, 0, 1, 1, 0, 1), (55, 0.1, 60, 0.0, 70, 0.0, 0, 1, 1, 0, 1), (7, 0.0, 12, 0.9, 60, 0.0, 0, 1, 1, 1, 1),
    (3, 0.0, 60, 0.0, 70, 0.0, 0, 1, 1, 1, 1), (1, 0.0, 70, 0.0, 5, 1.0, 0, 1, 1, 0, 1), (2, 0.0, 0, 0.0, 6, 1.0, 0, 1, 1, 0, 1),
    (12, 0.5, 60, 0.0, 60, 0.0, 0, 1, 1, 0, 1), (5, 1.0, 60, 0.0, 70, 0.0, 0, 1, 1, 0, 1), (4, 1.0, 4, 1.0, 4, 1.0, 0, 1, 1, 0, 1),
    (400, 0.0, 5, 0.0, 6, 1.0, 0, 1, 1, 0, 1), (25, 0.2, 5, 1.0, 4, 1.0, 0, 1, 1, 0, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 1, 1),
    # the same page's furniture
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 1, 0, 1, 0, 0), (8, 0.0, 1, 1.0, 7, 0.0, 1, 0, 1, 0, 0),
    (45, 0.0, 5, 1.0, 60, 0.0, 1, 0, 1, 0, 0), (6, 1.0, 70, 0.0, 0, 0.0, 1, 0, 1, 0, 0), (30, 0.1, 60, 0.0, 20, 0.0, 1, 0, 1, 0, 0),
    (5, 0.0, 30, 0.0, 50, 0.0, 1, 0, 1, 1, 0), (90, 0.0, 40, 0.0, 80, 0.0, 1, 0, 1, 0, 0), (12, 0.0, 60, 0.0, 55, 0.0, 1, 1, 1, 0, 0),
    (40, 0.0, 60, 0.0, 55, 0.0, 1, 1, 1, 0, 0), (4, 1.0, 60, 0.0, 4, 1.0, 1, 1, 1, 0, 0), (3, 0.0, 55, 0.0, 20, 0.0, 1, 1, 1, 1, 0),
    (200, 0.0, 60, 0.0, 55, 0.0, 1, 1, 1, 0, 0), (35, 0.0, 0, 0.0, 4, 1.0, 1, 0, 1, 0, 0),
    # outside the article, in elements that name nothing
    (10, 0.0, 1, 1.0, 7, 0.0, 0, 0, 1, 0, 0), (30, 0.0, 60, 0.0, 6, 1.0, 0, 0, 1, 0, 0), (4, 0.0, 0, 0.0, 1, 1.0, 0, 0, 1, 1, 0),
    (2, 1.0, 6, 0.0, 60, 0.0, 0, 0, 1, 0, 0), (70, 0.0, 6, 0.0, 0, 0.0, 0, 0, 1, 0, 0),
    # pages without an article element: text blocks
    (60, 0.0, 6, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (80, 0.1, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (35, 0.0, 4, 1.0, 50, 0.0, 0, 0, 0, 0, 1),
    (24, 0.0, 5, 1.0, 5, 1.0, 0, 0, 0, 0, 1), (300, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (18, 0.0, 40, 0.0, 30, 0.1, 0, 0, 0, 0, 1),
    (6, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 45, 0.0, 70, 0.0, 0, 0, 0, 1, 1), (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1, 1),
    (9, 0.0, 55, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (12, 0.2, 60, 0.0, 45, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1, 1),
    (40, 0.2, 30, 0.1, 2, 1.0, 0, 0, 0, 0, 1), (3, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    # the same: links, short scraps between links, furniture
    (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (25, 0.9, 4, 1.0, 60, 0.0, 0, 0, 0, 0, 0),
    (12, 0.8, 60, 0.0, 5, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 1, 0), (6, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (60, 0.8, 5, 1.0, 5, 1.0, 0, 0, 0, 0, 0),
    (50, 0.0, 4, 1.0, 60, 0.0, 1, 0, 0, 0, 0), (8, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 60, 0.0, 1, 0, 0, 0, 0),
    (20, 0.1, 50, 0.0, 60, 0.0, 1, 0, 0, 0, 0), (6, 0.0, 0, 0.0, 60, 0.0, 1, 0, 0, 1, 0), (120, 0.0, 60, 0.0, 40, 0.0, 1, 0, 0, 0, 0),
]

# Possessive repeats keep this linear; a quote that is never closed stands for itself.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_NO_TEXT = {"script", "style", "noscript", "template", "svg", "math", "canvas", "object", "embed", "iframe", "video", "audio", "head", "title", "select", "textarea", "datalist"}
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
           "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FURNITURE_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "header"}
_FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "note"}
_FURNITURE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promoted|promotion|banner|nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|"
    r"sidebar|side|aside|widget|footer|foot|header|masthead|topbar|toolbar|cookie|cookies|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|share|sharing|social|related|recommended|recommendations|comment|comments|commentlist|disqus|replies|reply|respond|discussion|pagination|pager|"
    r"copyright|legal|disclaimer|skip|search|form|tags|teaser|outbrain|taboola)(?:$|[-_\s\d])", re.I)
# Names that tell of furniture elsewhere on the page, and furniture that is never laid around the page's article.
_QUALIFIED = re.compile(r"(?:(?<=[-_\s])|^)(?:has|no|with|without)[-_]\S*|\S+[-_](?:open|closed)(?=\s|$)", re.I)
_NEVER_WRAPS = re.compile(r"(?:^|[-_\s])(?:nav|footer|aside|menu|dialog|related|recommended|recommendations|teaser|comment|comments|commentlist|disqus|replies|reply|respond|discussion)(?:$|[-_\s\d])", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Element:
    __slots__ = ("tag", "parent", "silent", "named", "never_wraps", "furniture", "article", "main", "outermost", "link", "heading")

    def __init__(self, tag: str, attrs: str, parent: "_Element | None"):
        self.tag, self.parent, self.furniture = tag, parent, False
        self.silent = tag in _NO_TEXT or bool(parent and parent.silent)
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.link = tag == "a" or bool(parent and parent.link)
        self.heading = tag in _HEADING or bool(parent and parent.heading)
        self.named = tag in _FURNITURE_TAGS and not (tag == "header" and parent and parent.article)
        self.never_wraps = bool(_NEVER_WRAPS.match(tag))
        main = tag == "main"
        if attrs and tag not in ("html", "body"):
            for name, *values in _ATTR.findall(attrs):
                name, value = name.lower(), next(filter(None, values), "")
                if name == "role":
                    self.article |= value.lower() in ("main", "article")
                    main |= value.lower() == "main"
                    self.named |= value.lower() in _FURNITURE_ROLES
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.silent = True
                elif name in ("class", "id") and tag not in ("article", "main", "a") and tag not in _HEADING:
                    value = _QUALIFIED.sub("", _CAMEL.sub("-", value))
                    self.named |= bool(_FURNITURE_NAMES.search(value))
                    self.never_wraps |= bool(_NEVER_WRAPS.search(value))
        self.main = self if main else parent and parent.main
        self.outermost = (parent and parent.outermost) or (self if self.article else None)


def _around(element: "_Element") -> list["_Element"]:
    out = []
    while element := element.parent:
        out.append(element)
    return out


def _judge(elements: list["_Element"], found: list[tuple[str, int, int, "_Element"]]) -> bool:
    """Set each element's ``furniture``; whether a block lies in an article that is not furniture."""
    wraps: set[_Element] = set()

    def inherit() -> bool:
        for e in elements:  # parents come first
            e.furniture = bool(e.parent and e.parent.furniture) or e.named and e not in wraps
        return any(e.article and not e.furniture for *_, e in found)

    for main in {e.main for *_, e in found if e.main}:
        wraps.update(_around(main))
    if inherit():
        return True
    words: dict[_Element, int] = {}
    for _, n, _, e in found:
        words[e.outermost] = words.get(e.outermost, 0) + n
    articles = [e for e in words if e]
    if articles:
        around = _around(best := max(articles, key=words.get))
        if words[best] > sum(n for _, n, _, e in found if not e.furniture) and not any(e.named and e.never_wraps for e in around):
            wraps.update(around)
    else:
        inside: dict[_Element, int] = {}
        form: dict[_Element, list[_Element]] = {}
        for e in elements:
            outer = form[e.parent] if e.parent else []
            form[e] = [*outer, e] if e.tag == "form" else outer
        for _, n, _, e in found:
            for f in form[e]:
                inside[f] = inside.get(f, 0) + n
        wraps.update(f for f, n in inside.items() if 2 * n > sum(words.values()))
    return inherit()


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Flat text blocks of a page in order, with their features."""
    found: list[tuple[str, int, int, _Element]] = []
    root = _Element("#page", "", None)
    stack, elements, parts, owner = [root], [root], [], root

    def add(text: str) -> None:
        nonlocal owner
        if text and not stack[-1].silent:
            if not parts:
                owner = stack[-1]
            parts.append((entities.unescape(text), stack[-1].link))

    def flush() -> None:
        nonlocal owner
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = len(" ".join(t for t, link in parts if link).split())
            found.append((text, len(text.split()), linked, owner))
        parts.clear()

    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        add(page[pos:m.start()])
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag not in _INLINE and tag in _INLINE:
                    break
        elif tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = close.end() if close else end
            if tag not in _NO_TEXT:
                continue
        elif tag not in _VOID and not m[3].endswith("/"):
            if tag not in _INLINE and stack[-1].tag in ("p", *_HEADING) or tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
                stack.pop()
            if tag == "body":
                del stack[1:]
            stack.append(_Element(tag, m[3], stack[-1]))
            elements.append(stack[-1])
        elif tag in _VOID and tag not in _INLINE:
            flush()
    flush()
    has_article = _judge(elements, found)
    shape = [(0, 0.0), *((n, linked / n) for _, n, linked, _ in found), (0, 0.0)]
    return [(text, [*shape[i], *shape[i - 1], *shape[i + 1], e.furniture, e.article, has_article, e.heading]) for i, (text, _, _, e) in enumerate(found, 1)]


def fit_tree(spark: SparkSession, labelled: list[tuple] = LABELLED, depth: int = 6) -> tuple:
    """The fitted tree as nested (feature, threshold, left, right), leaves as 0.0 or 1.0."""
    rows = spark.createDataFrame([(float(r[-1]), Vectors.dense([float(x) for x in r[:-1]])) for r in labelled], ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(rows)

    def walk(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        split = node.split()
        return split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return walk(model._call_java("rootNode"))


def _keeps(tree, x: list[float]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if x[feature] <= threshold else right
    return tree > 0.5


def extract(pages: DataFrame, labelled: list[tuple] = LABELLED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    tree = fit_tree(pages.sparkSession, labelled)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(t for t, x in blocks(p.as_py() or "") if _keeps(tree, x)) for p in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
            .mapInArrow(read, "page_id long, url string, text string, n_chars long"))
