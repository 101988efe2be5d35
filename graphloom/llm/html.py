"""Main text of web pages by tag-path ratios.

A page is parsed once, in time linear in its length, into blocks, each with its root-to-leaf tag path.  Text length
and punctuation are summed per path; the ratios (characters per node, marks per node, each by the path's share of the
page) are smoothed along the page and fused, and the paths above the spread of the fused values are content.  The main
text is the smallest subtree that holds the content paths' blocks: everything in it counts, short paragraphs and
headings too, but for regions announced as something else (menus, adverts, comments, ...) that the ratios did not
choose.  Announcements are weights, never verdicts: a tag, role, class or id scales its blocks' characters and marks
before the ratios are formed, and class or id names set apart the paths of grouping elements that bear them.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed

# HTML's elements by behaviour, and names by which pages mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody"
    " td textarea tfoot th thead title tr ul".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr"
    " main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
FENCES = frozenset("table ul ol dl select article section div body html".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
NOT_MAIN_TAGS = frozenset("nav header footer aside form button select input label fieldset dialog menu head template object embed applet canvas audio video map".split()) | RAW
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOT_MAIN_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adbox|banner|breadcrumbs?|byline-share|comment|comments|commentlist|consent|cookie|cookies|"
    r"disclaimer|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|pagination|pager|popup|promo|promoted|"
    r"recommended|related|replies|responses|share|sharing|sidebar|signup|skip-link|social|sponsor|sponsored|subscribe|subscription|tags|toolbar|topbar|widget|widgets|"
    r"cookiebar|cookiebanner|topnav|sidenav|subnav|navmenu|leftbar|rightbar|teaser|teasers|trending|rail|print-only|noprint)(?:$|[\s_-])",
    re.I,
)
ADVERTS = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adbox|promo|promoted|sponsor|sponsored)(?:$|[\s_-])", re.I)
OWN_PARTS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)  # an article has one of its own
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th address".split())
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
PUNCTUATION = re.compile(r"[,.;:!?…、。，！？]")
SPACE = re.compile(r"\s+")
SHOWN_RAW = frozenset("noscript template svg math".split())  # those whose content is markup
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}

# Weights of a block's characters and marks, multiplied: inside an element that announces other things by its tag or
# role, by its names, and inside an article or main element; and where the blocks of a path, ITEMS or more, nearly all stand in
# elements of their own, as comments and teasers do, not the paragraphs of one text.
MARKED, NAMED, ARTICLE, APART = 0.05, 0.25, 4.0, 0.2
ITEMS, OWN_SHARE = 5, 0.45
PLAIN, BY_NAME, BY_TAG, HIDDEN = range(4)


def _announced(tag: str, attrs: str, in_article: bool) -> tuple[int, bool]:
    """What an element says of itself, PLAIN to HIDDEN, and whether its names are those of adverts."""
    said, advert = PLAIN, False
    if tag in NOT_MAIN_TAGS and not (tag == "header" and in_article):  # an article's own heading
        said = BY_TAG
    if len(attrs) > 3:
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return HIDDEN, False
            if name == "role" and value.lower() in NOT_MAIN_ROLES:
                said = BY_TAG
            if name in ("class", "id") and tag not in ("body", "html", "main", "article"):
                value = HUMP.sub("-", value)
                if (m := NOT_MAIN_NAMES.search(value)) and not (in_article and OWN_PARTS.fullmatch(m[0])):
                    said, advert = max(said, BY_NAME), advert or bool(ADVERTS.search(value))
    return said, advert


class Page:
    """A parsed page.  Elements are numbered in page order, 0 being the page; only elements that break lines count.

    parent, end: of each element, its parent and the number after its last descendant.
    texts, at, path, region, article: of each block its text (references decoded, white space as one space, trimmed),
    element, tag path, innermost announced region and whether an article or main is around it.
    regions: of each (element, region around it, announcement, text level); the first stands for none."""

    def __init__(self, page: str) -> None:
        self.parent, self.end = [0], [0]
        self.texts: list[str] = []
        self.at: list[int] = []
        self.path: list[int] = []
        self.region: list[int] = []
        self.article: list[bool] = []
        self.regions: list[tuple[int, int, int, bool]] = [(0, 0, PLAIN, False)]
        self.paths: dict[tuple[int, str], int] = {}
        self.has_article = False
        self._parse(page)

    def _parse(self, page: str) -> None:
        # An entry: tag, element, path, region, in an article, where hidden text begins (-1: shown), nearest fence below
        stack: list[tuple[str, int, int, int, bool, int, int]] = [("", 0, 0, 0, False, -1, 0)]
        where: dict[str, list[int]] = {}  # places of open elements by tag
        text: list[str] = []
        at, size = 0, len(page)

        def flush() -> None:
            _, number, path, region, article, hidden, _ = stack[-1]
            if hidden >= 0:
                del text[hidden:]
            elif text:
                s = SPACE.sub(" ", entities.unescape("".join(text))).strip()
                text.clear()
                if s:
                    self.texts.append(s)
                    self.at.append(number)
                    self.path.append(path)
                    self.region.append(region)
                    self.article.append(article)

        def pop_to(i: int) -> None:
            while len(stack) > i:
                tag, number, _, _, _, hidden, _ = stack[-1]
                if hidden >= 0:
                    del text[hidden:]
                if tag in BLOCKS:
                    flush()
                    self.end[number] = len(self.parent)
                stack.pop()
                where[tag].pop()

        while at < size:
            m = TAG.search(page, at)
            if not m:
                text.append(page[at:])
                break
            if m.start() > at:
                text.append(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            fence = stack[-1][6]
            if m[1]:
                open_ = where.get(tag)
                if open_ and (tag in BLOCKS or open_[-1] >= fence):
                    pop_to(open_[-1])
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in BLOCKS:
                flush()
            if tag in VOID:
                continue
            if tag in ENDS_P or tag in SIBLINGS:
                lowest = len(stack)
                for t in ("p",) if tag in ENDS_P else ("p", *SIBLINGS[tag]):
                    open_ = where.get(t)
                    if open_ and open_[-1] > fence:
                        lowest = min(lowest, open_[bisect_right(open_, fence)])
                pop_to(lowest)
            if tag in RAW and tag not in SHOWN_RAW:  # its content is not markup; what the page cuts off ends with the page
                e = RAW_END[tag].search(page, at)
                at = e.end() if e else size
                continue
            _, above, path, region, article, hidden, fence = stack[-1]
            said, advert = _announced(tag, m[3], article)
            number, block = above, tag in BLOCKS
            if block:
                number = len(self.parent)
                self.parent.append(above)
                self.end.append(0)
                label = tag if said != BY_NAME or tag in TEXT_LEVEL else f"{tag}*"
                path = self.paths.setdefault((path, label), len(self.paths) + 1)
                if said in (BY_NAME, BY_TAG):
                    self.regions.append((number, region, said, tag in TEXT_LEVEL))
                    region = len(self.regions) - 1
            if hidden < 0 and (said == HIDDEN or not block and (said == BY_TAG or advert)):
                hidden = len(text)
            article = article or tag in ("article", "main")
            self.has_article = self.has_article or article
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, number, path, region, article, hidden, len(stack) if tag in FENCES else fence))
        pop_to(1)
        flush()
        self.end[0] = len(self.parent)


def _smooth(v: np.ndarray, reach: int = 2) -> np.ndarray:
    """Gaussian smoothing along the page."""
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / 1.0) ** 2)
    padded = np.pad(v, reach, mode="edge")
    return np.convolve(padded, k / k.sum(), mode="valid")


def path_ratios(at: np.ndarray, chars: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The fused ratio of each tag path, from each block's path, characters and punctuation marks (both weighted).

    A path's share of the page weighs its ratio: many long nodes with sentences in them are content.  A node's value is
    the geometric mean of its path's own and the smoothed one, so neighbours of content do not pass for it."""
    nodes, text, points = np.bincount(at), np.bincount(at, chars), np.bincount(at, marks + 1)
    length, sentences = (text / nodes * text / text.sum())[at], (points / nodes * points / points.sum())[at]
    length, sentences = np.sqrt(length * _smooth(length)), np.sqrt(sentences * _smooth(sentences))
    return np.bincount(at, length * sentences) / nodes


def content_paths(fused: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which paths are content: at or above the spread of the fused ratios along the page; the greatest always is."""
    return fused >= min(fused.max(), fused[at].std())


def _weights(p: Page) -> np.ndarray:
    """Each block's weight by what is announced around it and by whether its path's blocks stand apart."""
    per = [1.0]
    for _, around, said, _ in p.regions[1:]:
        per.append(per[around] * (NAMED if said == BY_NAME else MARKED))
    path, parent = np.array(p.path), np.array(p.parent)[np.array(p.at)]
    nodes = np.bincount(path)
    homes = np.bincount(np.unique(np.stack([path, parent]), axis=1)[0], minlength=len(nodes))
    apart = (nodes >= ITEMS) & (homes >= OWN_SHARE * nodes)
    return np.maximum(np.array(per)[p.region], 1e-6) * np.where(p.article, ARTICLE, 1.0) * np.where(apart[path], APART, 1.0)


def _dropped(p: Page, use: np.ndarray, chars: np.ndarray, marks: np.ndarray, chosen: np.ndarray, root: int) -> list[bool]:
    """Which announced regions inside ``root`` go: those of which most text is on paths that are not content, and text
    level ones (whose path their names do not set apart) that are much shorter or plainer than the content around."""
    region = np.array(p.region)[use]
    sums = np.stack([np.bincount(region, w, minlength=len(p.regions)) for w in (chars, chars * chosen, np.ones(len(use)), marks)], 1)
    for r in range(len(p.regions) - 1, 0, -1):  # an announcement inside another comes after it
        sums[p.regions[r][1]] += sums[r]
    total, on_path, nodes, points = sums.T
    plain = [k for k, i in enumerate(use.tolist()) if chosen[k] and not p.region[i]] or np.flatnonzero(chosen).tolist()
    usual, usual_marks = chars[plain].mean(), marks[plain].mean()
    out = [False]
    for r, (element, around, said, text_level) in enumerate(p.regions[1:], 1):
        inside = root < element < p.end[root]
        short = text_level and said == BY_NAME and (2 * total[r] < usual * nodes[r] or 2 * points[r] < usual_marks * nodes[r])
        out.append(out[around] or inside and (short or 2 * on_path[r] < total[r]))
    return out


def content(page: str | None) -> str:
    """The page's main text: its blocks joined by \\n; empty for null, empty or textless pages, and for pages that hold
    nothing but announced regions (without an article or main element: nothing but those announced by tag or role)."""
    if not page:
        return ""
    p = Page(page)
    use = np.arange(len(p.texts))
    if not any(r == 0 for r in p.region):
        by_tag = [False]
        for _, around, said, _ in p.regions[1:]:
            by_tag.append(by_tag[around] or said == BY_TAG)
        use = np.array([i for i, r in enumerate(p.region) if not by_tag[r] and (p.article[i] or not p.has_article)], np.int64)
    if not len(use):
        return ""
    _, at = np.unique(np.array(p.path)[use], return_inverse=True)
    chars = np.array([len(p.texts[i]) for i in use.tolist()], float)
    marks = np.array([len(PUNCTUATION.findall(p.texts[i])) for i in use.tolist()], float)
    weight = _weights(p)[use]
    chosen = content_paths(path_ratios(at, chars * weight, marks * weight), at)[at]
    main = [p.at[i] for i in use[chosen].tolist()]
    low, high = min(main), max(main)
    while low != high:  # to the smallest element around both; what is around comes first in page order
        if low > high:
            low, high = high, low
        high = p.parent[high]
    root = p.parent[low] if len(main) == 1 else low  # a single block: what stands beside it in its parent
    gone = _dropped(p, use, chars, marks, chosen, root)
    return "\n".join(p.texts[i] for i in use.tolist() if root <= p.at[i] < p.end[root] and not gone[p.region[i]])


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with ``text_col`` and n_chars, its code points; columns of these names, letter
    case aside, are replaced.  Rows and all other columns stay, nulls and repeated rows included."""
    keep = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower(), "n_chars")]
    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep) + f"`{text_col}` string, n_chars long"

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [content(h) for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, text_col, "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(run, schema)
