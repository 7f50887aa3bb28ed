"""HTML extraction by tag-path ratios.

A page is read as a sequence of blocks, each with its root-to-leaf path of block tags. For each
path the lengths and punctuation of its texts are aggregated; the ratio is text without links per
block, fused with punctuation. Ratios are smoothed over the page's sequence of blocks, and paths
whose mean score reaches ``THRESHOLD`` of the best are core paths. The article or main element
around them holds the content nodes, short ones and headings included. On a page without either,
the deepest container that all core paths share is widened: on every level above it, headings,
text and whatever is not mostly links belong to the article too. Paths through boilerplate
containers (navigation, headers and footers of the page, asides, forms, adverts, notices,
comments) never count. Names tell them: a class or role that holds a label; within an article, and
for ids everywhere, only one made of labels and words for layout. A heading's id tells nothing.

Defined results: null, empty or text-free html gives an empty text; an empty table gives no rows;
very long pages are read whole; broken or unclosed markup is read on; text without any markup is one block; repeated rows each get their row; a page's blocks
are joined in page order by one newline, repeats kept. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.25
#: Stands for a header that may be the page's or the text's.
HEADER = 2
SMOOTH = np.array([1.0, 2.0, 4.0, 2.0, 1.0]) / 10.0

RAW = frozenset("script style noscript template textarea title iframe svg object select option button annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp nobr "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose merror mtable mtr mtd".split()
)
BOILER = frozenset("nav header footer aside form menu dialog fieldset figure".split())
ARTICLE = frozenset(("article", "main"))
#: Ends an open paragraph; other tags end one of their own kind.
ENDS_P = frozenset("p div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 pre blockquote hr main address fieldset".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LABELS = (
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|side-?bar|footer|header|comments?|replies|disqus|cookies?|consent|notice|alert|"
    r"popup|modal|newsletter|subscribe|share|social|related|recommend\w*|widget|masthead|copyright|pagination|login|signup|toolbar"
)
LABEL = re.compile(rf"(?:^|[\s_-])(?:{_LABELS})(?:$|[\s_-])")
_LAYOUT = "area|articles|bar|block|bottom|box|buttons?|container|content|form|icons|inner|items|left|links|list|main|outer|page|panel|posts|right|section|site|slot|stories|top|unit|wrap|wrapper"
#: A name of labels and words for layout, one label at least: "ad", "share-buttons", but not "related-work".
WHOLE = re.compile(rf"(?:(?:{_LAYOUT})[_-]+)*(?:{_LABELS})(?:[_-]+(?:{_LABELS}|{_LAYOUT}|\d+))*")
#: Names of articles that are no article of the page: reader comments, adverts, other stories.
OTHER = re.compile(r"(?:\w+[_-])?(?:comments?|repl(?:y|ies)|responses?|disqus|ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|teasers?)(?:[_-](?:body|box|item|entry|content|inner|list|\d+))*")
#: What makes the element around it a frame of the page rather than of the article.
FRAME = frozenset(("nav", "footer", "aside"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
CLASS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")


def blocks(page: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, str, bool]]]:
    """Blocks (text, path, link characters) in page order, and paths (parent, tag, boilerplate)."""
    paths: list[tuple[int, str, bool]] = [(-1, "", False)]
    number: dict[tuple[int, str, bool], int] = {}
    stack, out, held = [0], [], []
    link_chars, in_link, at, n = 0, False, 0, len(page)
    link_depth = 0  # a link lasts until its end tag, or the end of the element it began in

    def close() -> None:
        nonlocal held, link_chars
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((text, stack[-1], link_chars))
        held, link_chars = [], 0

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0][0] != "<" or m[0] == "<":
                held.append(m[0])
                link_chars += len(m[0]) * in_link
            continue
        tag = tag.lower()
        if tag in RAW and not m[1]:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else (n if tag in ("script", "style", "textarea", "title") else at)
            continue
        if tag == "a":
            in_link, link_depth = not m[1], len(stack)
            continue
        if tag in INLINE or tag in RAW:
            continue
        if tag == "br":
            held.append("\n")
            continue
        close()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if paths[stack[i]][1] == tag:
                    del stack[i:]
                    break
            in_link = in_link and len(stack) >= link_depth
            continue
        ended = {"p"} if tag in ENDS_P else SIBLING.get(tag, set())
        top = paths[stack[-1]][1]
        if len(stack) > 1 and top in ended:
            stack.pop()
            if tag == "tr" and len(stack) > 1 and paths[stack[-1]][1] == "tr":
                stack.pop()
            in_link = in_link and len(stack) >= link_depth
        if tag in VOID:
            continue
        named = [(g[0].lower(), x.lower()) for g in CLASS.findall(m[3]) for x in g[1:] if x]
        names = " ".join(x for _, x in named)
        node = (stack[-1], tag, _boilerplate(tag, named, paths, stack[-1]))
        key = (node[0], f"{tag}.{names}", node[2])
        if key not in number:
            number[key] = len(paths)
            paths.append(node)
        stack.append(number[key])
    close()
    return out, _inherited(paths)


def _inherited(paths: list[tuple[int, str, bool]]) -> list[tuple[int, str, bool]]:
    """Paths with what they inherit: all below boilerplate is boilerplate.

    A header outside an article is the page's own if it lies in the body, in an element that also holds
    navigation, a footer or an aside, or holds navigation itself; else it belongs to the text beside it.
    """
    frames = {parent for parent, tag, _ in paths if tag in FRAME}
    with_nav = set()
    for parent, tag, _ in paths:
        while tag == "nav" and parent > 0:
            with_nav.add(parent)
            parent = paths[parent][0]
    out: list[tuple[int, str, bool]] = []
    for p, (parent, tag, own) in enumerate(paths):  # parents come before their children
        if tag == "header" and own == HEADER:
            own = parent <= 0 or paths[parent][1] in ("html", "body") or parent in frames or p in with_nav
        out.append((parent, tag, bool(own) or (parent >= 0 and out[parent][2])))
    return out


def _boilerplate(tag: str, named: list[tuple[str, str]], paths: list, parent: int) -> bool | int:
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(OTHER.fullmatch(word) for _, x in named for word in x.split())
    if tag in ("header", "figure"):  # an article's own header or figure is content
        if _in_article(paths, parent):
            return tag != "header" and _labelled(tag, named, paths, parent)
        return HEADER if tag == "header" and not _labelled(tag, [n for n in named if n[1] != "header"], paths, parent) else tag == "header"
    return tag in BOILER or _labelled(tag, named, paths, parent)


def _in_article(paths: list, parent: int) -> bool:
    while parent > 0:
        if paths[parent][1] in ARTICLE:
            return True
        parent = paths[parent][0]
    return False


def _labelled(tag: str, named: list[tuple[str, str]], paths: list, parent: int) -> bool:
    named = [(kind, x) for kind, x in named if LABEL.search(x) and not (kind == "id" and tag in HEADINGS)]
    if any(WHOLE.fullmatch(word) for _, x in named for word in x.split()):
        return True
    return any(kind != "id" for kind, _ in named) and not _in_article(paths, parent)


def main_text(page: str) -> str:
    found, paths = blocks(page)
    found = [b for b in found if not paths[b[1]][2]]
    if not found:
        return ""
    path = np.array([b[1] for b in found])
    chars = np.array([max(len(b[0]) - b[2], 0) for b in found], float)
    marks = np.array([len(PUNCTUATION.findall(b[0])) for b in found], float)
    n = np.bincount(path, minlength=len(paths))
    total, points = np.bincount(path, chars, len(paths)), np.bincount(path, marks, len(paths))
    ratio = np.divide(total, n, out=np.zeros(len(paths)), where=n > 0) * np.log1p(1.0 + points)
    series = np.convolve(np.pad(ratio[path], 2, mode="edge"), SMOOTH, "valid")
    # Fused: a path's mean smoothed score, weighted by the share of text it holds.
    score = np.bincount(path, series, len(paths)) / np.maximum(n, 1) * np.sqrt(total)
    if not score.max() > 0:
        core = np.flatnonzero(n)
    else:
        core = np.flatnonzero(score >= THRESHOLD * score.max())
    inside = _shared_container(core, paths, total, np.bincount(path, [len(b[0]) for b in found], len(paths)))
    return "\n".join(b[0] for b in found if inside[b[1]])


def _shared_container(core: np.ndarray, paths: list, plain: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Which paths lie in the container of the core paths, given each path's characters, without links and all.

    An article or main element around a core path is the container. Else it is the deepest that
    all of them share, widened by the headings and by what is not mostly links beside it and
    beside each container around it. A text's own leaf element is no container unless it is the
    page's root.
    """

    def line(p: int) -> list[int]:
        up = []
        while p >= 0:
            up.append(p)
            p = paths[p][0]
        return up[::-1]

    lines = [line(int(p)) for p in core]
    marked = [[i for i, p in enumerate(x) if paths[p][1] in ARTICLE] for x in lines]
    roots = {x[m[0]] for x, m in zip(lines, marked, strict=True) if m}
    direct: set[int] = set()  # containers of which only the text of their own is inside
    if not roots:
        shared = lines[0][:-1] or lines[0]
        for x in lines[1:]:
            depth = 0
            while depth < min(len(shared), len(x)) and shared[depth] == x[depth]:
                depth += 1
            shared = shared[:depth]
        at = shared[-1] if shared else 0
        roots = {at}
        below, plain_below = chars.copy(), plain.copy()
        children: dict[int, list[int]] = {}
        for p in range(len(paths) - 1, 0, -1):
            parent, _, boiler = paths[p]
            if not boiler:
                children.setdefault(parent, []).append(p)
                below[parent] += below[p]
                plain_below[parent] += plain_below[p]
        while (inner := at) > 0:
            at = paths[at][0]
            beside = (p for p in children.get(at, ()) if p != inner)
            roots.update(p for p in beside if paths[p][1] in HEADINGS or 2 * plain_below[p] > below[p])
            direct.update([at] if 2 * plain[at] > chars[at] else [])
    inside = np.zeros(len(paths), bool)
    for p, (parent, _, _) in enumerate(paths):  # parents come before their children
        inside[p] = p in roots or (parent >= 0 and inside[parent])
    inside[list(direct)] = True
    return inside


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                texts = [main_text(x or "") for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
