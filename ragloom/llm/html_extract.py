"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their root-to-leaf path of tags and classes. Of each path the
length of the text outside links and the punctuation are aggregated over its nodes; both
ratios are smoothed along the page, fused by their geometric mean, and averaged over the
path; paths whose score reaches a share of the page's mean are content. Three weights only
lower a score: names of page furniture in class, id or role; a place outside the article
elements, if those hold most of what was selected; and links.

Short blocks have no ratios of their own to speak of, so they follow their surroundings: a
gap between selected nodes of one container is closed (in an article or main element up to
its ends) where weights and links allow; a heading stays if something that it leads stays.

Defined results: null or empty html gives an empty text; html without furniture or
article elements is judged by the ratios alone; a score that equals the threshold is
enough; unclosed tags, comments and scripts are closed at the end of the page; repeated rows
are extracted alike; time is linear in the length and depth of a page; an empty table gives
no rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from math import exp, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>?|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)?)?|=)*+)>?)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_WORD = re.compile(r"[A-Za-z]+")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
_DIGITS = re.compile(r"[0-9]+")
_SPACES = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，、！？]")
_RAW_END = {}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are no page text, and the one whose contents are text without markup.
RAW = frozenset("script style textarea title noscript template iframe svg noembed noframes annotation annotation-xml".split())
PLAIN = "xmp"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr "
    "math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot munder mover munderover mfenced mstyle mspace mpadded mphantom menclose".split()
)
#: An opening tag closes an open element of these kinds first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("ul ol dl table select div section article main body html td th blockquote".split())
BARRIERS = {tag: tuple(SCOPE - like) for tag, like in CLOSES.items()}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
HOLDERS = frozenset({"article", "main"})
#: Elements of page furniture; those that may also wrap a whole page.
FURNITURE = frozenset("nav aside button select option footer menu dialog head input".split())
FORMS = frozenset({"form", "fieldset"})
#: Names (words of class, id, role) of page furniture.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer foot "
    "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "disqus respond replies reply search pagination pager toolbar widget masthead complementary contentinfo alertdialog skip".split()
)
HEADER_NAMES = NAMES | {"header", "topbar"}
#: Words beside such names that change nothing, and words that make them speak of something else.
NEUTRAL = frozenset(
    "list box section block container wrapper wrap item items bar site page top bottom left right link links post main content inner outer article entry blog body div "
    "slot unit thread prompt message policy posts panel zone group area feed".split()
)
OTHER = frozenset("has no with without overflow not is".split())
#: Weight of an element that is named as furniture and nothing else, and of what stands outside the articles.
NAMED, OUTSIDE = 0.03, 0.3
#: The smoothing's reach in nodes, the share of the mean score that selects a path, and the least
#: weight (of names and text outside links) that closes a gap.
REACH, CUT, CLOSE = 2, 0.5, 0.5


class _Node:
    __slots__ = ("tag", "path", "parent", "skip", "form", "hold", "weight", "no")

    def __init__(self, tag, path, parent, no):
        self.tag, self.path, self.parent, self.no = tag, path, parent, no
        #: in furniture, in a form, in an article or main element, weight of the names down to here
        self.skip, self.form, self.hold, self.weight = (parent.skip, parent.form, parent.hold, parent.weight) if parent else (False, False, False, 1.0)


class Block:
    """A run of text inside one block element: ``linked`` of its ``size`` characters are in links."""

    __slots__ = ("node", "text", "size", "linked")

    def __init__(self, node, text, size, linked):
        self.node, self.text, self.size, self.linked = node, text, size, linked


def _attributes(attrs: str, names: frozenset[str]) -> tuple[float, bool, str]:
    """How far class, id and role name furniture (0 to 1), whether the element is hidden, and its classes."""
    share, hidden, label = 0.0, False, ""
    for m in _ATTR.finditer(attrs):
        k, v = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and _GONE.search(v)):
            hidden = True
        elif k in ("class", "id", "role"):
            if k != "id":
                label += "." + _DIGITS.sub("0", v.strip())
            for part in v.split():
                words = _WORD.findall(part)
                hits = sum(w in names for w in words)
                if hits and not OTHER.intersection(words):
                    # what a compound names is its last word: reader comments are comments, side effects no side
                    head = next((w for w in reversed(words) if w not in NEUTRAL), "")
                    share = 1.0 if head in names else max(share, hits / (hits + sum(w not in names and w not in NEUTRAL for w in words)))
    return share, hidden, label


def parse(page: str) -> tuple[list[_Node], list[Block]]:
    """All block elements of the page, parents first, and its blocks of text in order, without
    what scripts, styles and comments hold."""
    paths: dict[tuple[int, str], int] = {}
    root = _Node("html", 0, None, 0)
    nodes, stack, blocks, buf = [root], [root], [], []
    open_at: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    link, pos = 0, 0  # depth of the stack at which a link was opened

    def flush():
        if buf:
            text = _SPACES.sub(" ", "".join(t for t, _ in buf)).strip()
            if text:
                size = sum(len(t) - t.count(" ") for t, _ in buf)
                blocks.append(Block(stack[-1], text, size, sum(len(t) - t.count(" ") for t, a in buf if a)))
            buf.clear()

    def close_to(k: int):
        nonlocal link
        flush()
        for n in stack[k:]:
            open_at[n.tag].pop()
        del stack[k:]
        if link > len(stack):
            link = 0

    def opened(tag: str, attrs: str):
        up = stack[-1]
        share, hidden, label = _attributes(attrs, NAMES if up.hold else HEADER_NAMES) if attrs else (0.0, False, "")
        n = _Node(tag, paths.setdefault((up.path, tag + label), len(paths) + 1), up, len(nodes))
        if tag not in ("html", "body", "main"):
            if tag in FURNITURE or (tag == "header" and not up.hold) or (hidden and tag != "article"):
                n.skip = True
            if share and (tag != "article" or share == 1):
                n.weight = min(n.weight, 1 - (1 - NAMED) * share)
        n.form = n.form or tag in FORMS
        n.hold = n.hold or tag in HOLDERS
        open_at[tag].append(len(stack))
        stack.append(n)
        nodes.append(n)

    while True:
        at = page.find("<", pos)
        if at != pos:
            text = page[pos : at if at >= 0 else None]
            buf.append((entities.unescape(text) if "&" in text else text, link))
        if at < 0:
            break
        m = _TAG.match(page, at)
        if not m:
            buf.append(("<", link))
            pos = at + 1
            continue
        pos = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a":
                link = 0
            elif tag not in INLINE:
                if open_at[tag]:
                    close_to(open_at[tag][-1])
                else:
                    flush()
            continue
        if tag in RAW or tag == PLAIN:
            end = _RAW_END.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)).search(page, pos)
            if tag == PLAIN:
                flush()
                buf.append((page[pos : end.start() if end else None], link))
                flush()
            pos = end.end() if end else len(page)
        elif tag == "br":
            buf.append((" ", link))
        elif tag == "a":
            link = len(stack) if "href" in m["attrs"].lower() else 0
        elif tag in VOID and tag not in INLINE:
            flush()
        elif tag not in INLINE:
            flush()
            if stack[-1].tag == "p":  # a paragraph ends where any block begins, so it is the last open element
                close_to(len(stack) - 1)
            if tag in CLOSES:  # list items and cells end at their like, up to the element around them
                limit = max((open_at[t][-1] for t in BARRIERS[tag] if open_at[t]), default=0)
                places = [open_at[t][i] for t in CLOSES[tag] if (i := bisect_right(open_at[t], limit)) < len(open_at[t])]
                if places:
                    close_to(min(places))
            opened(tag, m["attrs"])
    flush()
    return nodes, blocks


def path_scores(blocks: list[Block], weights: list[float]) -> dict[int, float]:
    """The score of each tag path: both ratios by path, smoothed along the page, fused, weighted, and
    averaged over the path's nodes."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0])
    for b in blocks:
        s = sums[b.node.path]
        s[0] += 1
        s[1] += b.size - b.linked
        s[2] += len(_PUNCT.findall(b.text)) if b.linked < b.size else 0
    ratios = [((s := sums[b.node.path])[1] / s[0], (s[2] + 0.1) / s[0]) for b in blocks]
    kernel = [exp(-(d * d) / 2) for d in range(REACH + 1)]
    total: dict[int, float] = defaultdict(float)
    for i, b in enumerate(blocks):
        length = points = mass = 0.0
        for j in range(max(0, i - REACH), min(len(blocks), i + REACH + 1)):
            k = kernel[abs(i - j)]
            length, points, mass = length + k * ratios[j][0], points + k * ratios[j][1], mass + k
        total[b.node.path] += sqrt(length * points) / mass * weights[i]
    return {p: t / sums[p][0] for p, t in total.items()}


def _kept(nodes: list[_Node], blocks: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    weights = [b.node.weight for b in blocks]
    scores = path_scores(blocks, weights)
    score = [scores[b.node.path] for b in blocks]
    least = CUT * sum(s * w for s, w in zip(score, weights)) / sum(weights)
    level = [HEADINGS.get(b.node.tag, 0) for b in blocks]
    chosen = [s >= least and not h for s, h in zip(score, level)]

    # selected text below each element, and what the articles hold of it
    below = [0] * len(nodes)
    for b, c in zip(blocks, chosen):
        below[b.node.no] += b.size if c else 0
    for n in reversed(nodes[1:]):
        below[n.parent.no] += below[n.no]
    tops = [n for n in nodes if n.tag in HOLDERS and not (n.parent and n.parent.hold)]
    in_articles = 2 * sum(below[n.no] for n in tops) > below[0]
    if in_articles:
        weights = [w if b.node.hold else w * OUTSIDE for w, b in zip(weights, blocks)]
        chosen = [c and (b.node.hold or s * OUTSIDE >= least) for c, s, b in zip(chosen, score, blocks)]
        container = [n.hold for n in nodes]
    else:  # the deepest element that holds nearly all of it
        best = nodes[0]
        for n in nodes:
            if n.parent is best and 10 * below[n.no] >= 9 * below[0] and n.tag not in ("p", "li", *HEADINGS):
                best = n
        container = [False] * len(nodes)
        for n in nodes:
            container[n.no] = n is best or (n.parent is not None and container[n.parent.no])

    # close the gaps
    seeds = [i for i, c in enumerate(chosen) if c and container[blocks[i].node.no]]
    first, last = (-1, len(blocks)) if in_articles else (seeds[0], seeds[-1]) if seeds else (0, -1)
    close = CLOSE * max((weights[i] for i in seeds), default=1)  # names around the whole container tell nothing
    able = [container[b.node.no] and w >= close for b, w in zip(blocks, weights)]
    kept = [c or (not h and a and first <= i <= last and w * (b.size - b.linked) >= close * b.size) for i, (c, h, a, w, b) in enumerate(zip(chosen, level, able, weights, blocks))]

    # headings follow what they lead: the blocks before the next heading of their level or above
    led: list[bool | None] = [None] * 7
    for i in range(len(blocks) - 1, -1, -1):
        h = level[i]
        if h:
            kept[i] = able[i] and (first <= i <= last if led[h] is None else led[h])
            led[h:] = [None] * (7 - h)
            led[1:h] = [x or kept[i] or x for x in led[1:h]]
        else:
            led = [x or kept[i] for x in led]
    return kept


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    blocks = [b for b in blocks if not b.node.skip]
    free = [b for b in blocks if not b.node.form]
    # a form around most of the page is no form to leave out
    if 2 * sum(b.size for b in free) >= sum(b.size for b in blocks):
        blocks = free
    if not blocks:
        return ""
    return "\n".join(b.text for b, k in zip(blocks, _kept(nodes, blocks)) if k)


def _extracted(batches):
    for b in batches:
        texts = [extract(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
