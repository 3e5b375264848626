"""Main text of web pages from flat text blocks.

A page is read as a flat sequence of text blocks: runs of text between block-level tags. Each block has its number of
words and its link density (share of words inside links), those of the blocks before and after it, and which region of the
page encloses it. A decision tree, grown from the small labelled table below by Gini impurity, says which blocks are
article text; those are joined in page order.

Everything happens where a page is read: no shuffle, memory of one page at a time.

Defined results: null or empty html gives an empty text; unclosed and stray tags, unclosed comments and cut-off tags are
read as browsers do; a character reference is decoded once; white space inside a block becomes one space; repeated rows
get equal answers; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags that end a text block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose content is never text of the page.
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas select textarea button title head".split())
#: Tags without content or end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that hold article text, and tags that never do.
MAIN_TAGS = frozenset(["article", "main"])
SIDE_TAGS = frozenset("nav footer aside form menu dialog header".split())
#: Words in class, id or role that name a side region, words that may stand beside them, and words of an article, which may stand beside some.
SIDE_WORD = re.compile(
    r"ads?|advert\w*|adsense|adsbygoogle|banners?|sponsor\w*|promo\w{0,6}|nav\w*|menus?|breadcrumbs?|footers?|headers?|masthead|sidebars?|side|aside|complementary|cookies?|consent|gdpr|notices?|"
    r"popups?|modal|newsletters?|subscribe|subscription|share|sharing|social|related\w{0,6}|recommend\w{0,6}|comments?(?:list|form|area|box)?|reply|replies|respond|disqus|discussions?|login|signup|search|toolbars?|widgets?|copyright"
)
BESIDE = re.compile(
    r"\d+(?:x\d+)?|list|box|links?|buttons?|btn|items?|posts?|block|section|container|wrap(?:per)?|bar|area|form|slot|unit|icons?|inner|outer|page|site|top|bottom|left|right|main|primary|secondary|global|local|"
    r"holder|panel|region|group|module|component|thread|stories|articles|tags?|google|fixed|sticky|mobile|desktop|js|id|col|row|small|large|text|title|heading|body"
)
MAIN_WORD = re.compile(r"article|content|main|post|entry|story|body")
BESIDE_MAIN = re.compile(r"headers?|sidebars?|side")
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:[\s/]+|=|[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)?)*+(?:>|\Z)", re.S)
#: Names of regions whose articles are no main text.
CLOSED_WORD = re.compile(r"comments?\w*|reply|replies|respond|disqus|discussions?|related\w*|popups?|modal|cookies?|consent")
#: An end tag may be left out; a new tag of the second set closes an open one of the first, up to a tag of the third.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table",)),
}
#: What an implied end never crosses, and block tags that leave an open p open.
SCOPE = frozenset("article main section body html table".split())
IN_P = frozenset("body head html title legend option select".split())
#: Silent tags that may hold their like; of the others a second one shows that the first has no end tag.
NESTED_TAGS = frozenset("svg math object canvas".split())
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+(?:x\d+)?")
SILENT = re.compile(rf"<(/?)({'|'.join(sorted(SILENT_TAGS))})(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

#: The labelled table: blocks of three of the given pages, of the same without their article tag, and of pages written by hand.
#: words, link density, words and link density before, words and link density after, region (1 article, 0 unknown, -1 side) | label.
LABELLED = """
1 1 0 0 1 1 -1 | 0
1 1 1 1 1 1 -1 | 0
1 1 1 1 8 0 -1 | 0
8 0 1 1 10 0 -1 | 0
10 0 8 0 51 0 1 | 1
51 0 10 0 8 0 1 | 1
8 0 51 0 11 0 1 | 1
11 0 8 0 36 0 1 | 1
36 0 11 0 32 0 1 | 1
32 0 36 0 52 0 1 | 1
52 0 32 0 25 0 1 | 1
25 0 52 0 11 0 1 | 1
11 0 25 0 0 0 -1 | 0
10 0 8 0 51 0 0 | 1
51 0 10 0 8 0 0 | 1
8 0 51 0 11 0 0 | 1
11 0 8 0 36 0 0 | 1
36 0 11 0 32 0 0 | 1
32 0 36 0 52 0 0 | 1
52 0 32 0 25 0 0 | 1
25 0 52 0 11 0 0 | 1
8 0 1 1 9 0 -1 | 0
9 0 8 0 12 0 1 | 1
12 0 9 0 9 0 1 | 1
9 0 12 0 39 0 1 | 1
39 0 9 0 8 0 1 | 1
8 0 39 0 20 0 1 | 1
20 0 8 0 8 0 1 | 1
8 0 20 0 8 0 1 | 1
8 0 8 0 0 0 -1 | 0
9 0 8 0 12 0 0 | 1
12 0 9 0 9 0 0 | 1
9 0 12 0 39 0 0 | 1
39 0 9 0 8 0 0 | 1
8 0 39 0 20 0 0 | 1
20 0 8 0 8 0 0 | 1
8 0 20 0 8 0 0 | 1
1 1 1 1 5 0 -1 | 0
5 0 1 1 2 0 -1 | 0
2 0 5 0 2 0 1 | 1
2 0 2 0 11 0 1 | 1
11 0 2 0 0 0 -1 | 0
2 0 5 0 2 0 0 | 1
2 0 2 0 11 0 0 | 1
1 1 1 1 2 1 -1 | 0
2 1 1 1 6 0 -1 | 0
6 0 2 1 2 1 1 | 1
2 1 6 0 1 0 1 | 1
1 0 2 1 21 0 1 | 1
21 0 1 0 12 1 1 | 1
12 1 21 0 25 0 1 | 1
25 0 12 1 2 1 1 | 1
2 1 25 0 1 1 1 | 1
1 1 2 1 3 1 1 | 1
3 1 1 1 2 0 1 | 1
2 0 3 1 48 0.19 1 | 1
48 0.19 2 0 9 0.44 1 | 1
9 0.44 48 0.19 3 0 1 | 1
3 0 9 0.44 5 1 -1 | 0
5 1 3 0 6 1 -1 | 0
6 1 5 1 9 0.11 -1 | 0
9 0.11 6 1 0 0 -1 | 0
1 1 0 0 1 1 0 | 0
1 1 1 1 1 1 0 | 0
1 1 1 1 2 1 0 | 0
2 1 1 1 7 0 0 | 0
7 0 2 1 65 0 0 | 1
65 0 7 0 40 0.05 0 | 1
40 0.05 65 0 18 0 0 | 1
18 0 40 0.05 90 0 0 | 1
90 0 18 0 33 0 0 | 1
33 0 90 0 28 0.07 0 | 1
28 0.07 33 0 70 0 0 | 1
70 0 28 0.07 6 1 0 | 1
6 1 70 0 7 1 0 | 0
7 1 6 1 5 1 0 | 0
5 1 7 1 4 0.75 0 | 0
4 0.75 5 1 3 0 0 | 0
3 0 4 0.75 0 0 0 | 0
3 0.67 0 0 2 1 0 | 0
2 1 3 0.67 3 1 0 | 0
3 1 2 1 5 0 0 | 0
5 0 3 1 22 0 0 | 1
22 0 5 0 45 0 0 | 1
45 0 22 0 16 0 0 | 1
16 0 45 0 35 0 0 | 1
35 0 16 0 10 0.7 0 | 1
10 0.7 35 0 24 0.79 0 | 0
24 0.79 10 0.7 12 1 0 | 0
12 1 24 0.79 3 1 0 | 0
3 1 12 1 5 0 0 | 0
5 0 3 1 0 0 0 | 0
30 0.07 0 0 6 0 -1 | 0
6 0 30 0.07 2 1 -1 | 0
2 1 6 0 3 1 -1 | 0
3 1 2 1 3 1 -1 | 0
3 1 3 1 14 0 -1 | 0
14 0 3 1 3 1 1 | 1
3 1 14 0 40 0 1 | 1
40 0 3 1 60 0.02 -1 | 0
60 0.02 40 0 12 0 -1 | 0
12 0 60 0.02 2 1 -1 | 0
2 1 12 0 2 1 -1 | 0
2 1 2 1 1 1 -1 | 0
1 1 2 1 14 0 -1 | 0
14 0 1 1 0 0 -1 | 0
1 0 0 0 30 0 1 | 1
30 0 1 0 0 0 1 | 1
2 0 0 0 2 1 1 | 1
2 1 2 0 1 1 1 | 1
1 1 2 1 1 1 1 | 1
1 1 1 1 2 0 1 | 1
2 0 1 1 0 0 1 | 1
12 1 0 0 0 0 1 | 1
60 0 0 0 4 1 1 | 1
4 1 60 0 0 0 1 | 1
21 0 0 0 2 1 1 | 1
2 1 21 0 25 0 1 | 1
25 0 2 1 0 0 1 | 1
1 1 0 0 2 1 0 | 0
2 1 1 1 1 1 0 | 0
1 1 2 1 3 1 0 | 0
3 1 1 1 2 1 0 | 0
2 1 3 1 4 1 0 | 0
4 1 2 1 5 0 0 | 0
5 0 4 1 6 1 0 | 0
6 1 5 0 5 1 0 | 0
5 1 6 1 7 1 0 | 0
7 1 5 1 8 1 0 | 0
8 1 7 1 6 1 0 | 0
6 1 8 1 9 0.33 0 | 0
9 0.33 6 1 11 0.73 0 | 0
11 0.73 9 0.33 9 1 0 | 0
9 1 11 0.73 12 1 0 | 0
12 1 9 1 10 1 0 | 0
10 1 12 1 2 0 0 | 0
2 0 10 1 0 0 0 | 0
4 0 0 0 3 1 0 | 0
3 1 4 0 2 1 0 | 0
2 1 3 1 6 0.67 0 | 0
6 0.67 2 1 7 0.14 0 | 0
7 0.14 6 0.67 2 1 0 | 0
2 1 7 0.14 2 1 0 | 0
2 1 2 1 2 1 0 | 0
2 1 2 1 13 0.69 0 | 0
13 0.69 2 1 3 0.33 0 | 0
3 0.33 13 0.69 8 0.75 0 | 0
8 0.75 3 0.33 0 0 0 | 0
1 1 1 1 6 0 0 | 0
6 0 1 1 4 1 0 | 0
4 1 6 0 3 1 0 | 0
3 1 4 1 4 0 0 | 0
4 0 3 1 60 0 0 | 1
60 0 4 0 70 0 0 | 1
70 0 60 0 5 1 0 | 1
5 1 70 0 5 1 0 | 0
5 1 5 1 7 0.71 0 | 0
7 0.71 5 1 0 0 0 | 0
60 0 0 0 70 0 0 | 1
70 0 60 0 0 0 0 | 1
50 0 0 0 0 0 0 | 1
16 0 0 0 0 0 0 | 1
25 0 0 0 33 0 0 | 1
33 0 25 0 19 0 0 | 1
19 0 33 0 0 0 0 | 1
2 1 1 1 80 0 0 | 0
80 0 2 1 45 0 0 | 1
45 0 80 0 30 0 0 | 1
30 0 45 0 0 0 0 | 1
35 0 0 0 55 0 0 | 1
55 0 35 0 4 0 0 | 1
4 0 55 0 0 0 0 | 0
2 1 0 0 2 1 0 | 0
2 1 2 1 1 1 0 | 0
1 1 2 1 6 0 0 | 0
6 0 1 1 42 0 0 | 1
42 0 6 0 27 0 0 | 1
27 0 42 0 3 0.67 0 | 1
3 0.67 27 0 0 0 0 | 0
1 1 1 1 90 0 0 | 0
90 0 1 1 17 0 0 | 1
17 0 90 0 3 1 0 | 1
3 1 17 0 2 1 0 | 0
2 1 3 1 0 0 0 | 0
38 0 0 0 20 0.15 0 | 1
20 0.15 38 0 2 1 0 | 1
2 1 20 0.15 2 1 0 | 0
2 1 2 1 4 0.25 0 | 0
4 0.25 2 1 0 0 0 | 0
"""


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 6):
        self.answer = bool(labels.mean() >= 0.5)
        self.split = None
        best = _gini(labels) - 1e-9
        if not depth or best <= 0:
            return
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = rows[:, f] <= cut
                score = low.mean() * _gini(labels[low]) + (~low).mean() * _gini(labels[~low])
                if score < best - 1e-12:
                    best, self.split = score, (f, float(cut))
        if self.split:
            low = rows[:, self.split[0]] <= self.split[1]
            self.low, self.high = Tree(rows[low], labels[low], depth - 1), Tree(rows[~low], labels[~low], depth - 1)

    def says(self, row: tuple) -> bool:
        node = self
        while node.split:
            node = node.low if row[node.split[0]] <= node.split[1] else node.high
        return node.answer


def _gini(labels: np.ndarray) -> float:
    p = labels.mean() if len(labels) else 0.0
    return float(2 * p * (1 - p))


def train_tree(table: str = LABELLED) -> Tree:
    pairs = [line.split("|") for line in table.strip().splitlines()]
    return Tree(np.array([[float(x) for x in a.split()] for a, _ in pairs]), np.array([int(b) for _, b in pairs]))


#: Regions: of an article's own tag, of its name, none, and side regions: one that an article or its name can end (a form), one that only an article's tag can, one that nothing ends.
TAGGED, NAMED, NOWHERE, FORM, SIDE, CLOSED = 2, 1, 0, -1, -2, -3


def _side_words(name: str) -> list[str]:
    """The side words of a class, id or role, if it has nothing but them and words that go with them."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    side = [w for w in words if SIDE_WORD.fullmatch(w)]
    rest = [w for w in words if not SIDE_WORD.fullmatch(w) and not BESIDE.fullmatch(w)]
    if any(not MAIN_WORD.fullmatch(w) for w in rest) or any(MAIN_WORD.fullmatch(w) for w in words) and any(BESIDE_MAIN.fullmatch(w) for w in side):
        return []
    return side


def _region(name: str, tag: str, above: int) -> int:
    if above == CLOSED:
        return above
    named = " ".join(a.strip("\"'") for a in ATTRIBUTE.findall(tag)).split() if "=" in tag else []
    side = [w for x in named for w in _side_words(x)]
    closed = any(CLOSED_WORD.fullmatch(w) for w in side)
    if name in MAIN_TAGS:
        return CLOSED if closed and name == "article" else TAGGED
    if name in SIDE_TAGS:
        # a header inside an article holds its title
        return above if name == "header" and above > 0 else min(above, FORM) if name == "form" else CLOSED
    if name in ("body", "html"):
        return above
    if side:
        return CLOSED if closed else min(above, SIDE)
    if NOWHERE >= above > SIDE and any(MAIN_WORD.fullmatch(w.lower()) for x in named for w in NAME_WORD.findall(x)):
        return NAMED
    return above


def _unclosed(page: str) -> set[int]:
    """Where silent tags begin that have no end tag of their own."""
    open_: dict[str, list[int]] = {}
    out: set[int] = set()
    for m in SILENT.finditer(page):
        name = m.group(2).lower()
        stack = open_.setdefault(name, [])
        if m.group(1):
            if stack:
                stack.pop()
        else:
            if stack and name not in NESTED_TAGS:
                out.add(stack.pop())
            stack.append(m.start())
    return out.union(*open_.values())


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """The text blocks of a page: text, words, link density, region (1 in the article, 0 unknown, -1 beside it)."""
    out: list[tuple[str, int, float, int]] = []
    held: list[str] = []
    words = linked = in_link = 0
    open_tags: list[tuple[str, int]] = []
    region, silent, depth, at = NOWHERE, "", 0, 0
    unclosed = _unclosed(page)

    def text(part: str) -> None:
        nonlocal words, linked
        part = html.unescape(part) if "&" in part else part
        n = len(part.split())
        words += n
        linked += n if in_link else 0
        held.append(part)

    def close() -> None:
        nonlocal words, linked
        whole = " ".join("".join(held).split())
        if whole:
            out.append((whole, words, linked / words if words else 0.0, region))
        held.clear()
        words = linked = 0

    def shut(names: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        nonlocal region
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k][0] in names:
                region = open_tags[k][1]
                del open_tags[k:]
                break
            if open_tags[k][0] in stops or open_tags[k][0] in SCOPE:
                break

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if not silent and m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m.group()
        name_match = NAME.match(tag)
        if not name_match:
            continue
        name, ends = name_match.group(1).lower(), tag[1] == "/"
        if not ends and name in ("script", "style"):
            # raw text: nothing inside is markup
            stop = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if silent:
            if name == silent and depth:
                depth += -1 if ends else not tag.endswith("/>")
                silent = silent if depth else ""
                continue
            # one without an end tag of its own ends at the next block, or with the one around it; a head where the body begins
            if depth or (name not in BLOCK_TAGS - {"option"} if silent != "head" else name != "body"):
                continue
            silent = ""
        if not ends and name in SILENT_TAGS and not tag.endswith("/>"):
            silent, depth = name, 0 if m.start() in unclosed else 1
            continue
        if name == "br":
            held.append(" ")
        elif name == "a":
            in_link = 0 if ends else 1
        if name in BLOCK_TAGS:
            close()
            in_link = 0
            if name in VOID_TAGS:
                continue
            if not ends:
                if name not in IN_P:
                    shut(("p",))
                if name in IMPLIED:
                    shut(*IMPLIED[name])
                above = region
                region = _region(name, tag, above)
                open_tags.append((name, above))
            else:
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k][0] == name:
                        region = open_tags[k][1]
                        del open_tags[k:]
                        break
    if not silent and at < len(page):
        text(page[at:])
    close()
    # where an article is tagged, what lies outside of it is beside it
    least = NAMED if any(b[3] == TAGGED for b in out) else NOWHERE
    return [(t, n, d, 1 if r > 0 else 0 if r >= least else -1) for t, n, d, r in out]


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    ends = [("", 0, 0.0, 0), *found, ("", 0, 0.0, 0)]
    kept = [b[0] for a, b, c in zip(ends, ends[1:], ends[2:]) if tree.says((b[1], b[2], a[1], a[2], c[1], c[2], b[3]))]
    return "\n\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    tree = train_tree()
    rows = pages.selectExpr("cast(page_id AS long) AS page_id", "cast(url AS string) AS url", "html")
    return rows.mapInArrow(lambda it: _extract(it, tree), "page_id long, url string, text string, n_chars long")
