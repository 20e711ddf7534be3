"""Main text of web pages by two-pass block rules (operator 2).

A page is cut at block-level tags. The first pass decides blocks by link density, length and the
density of stop words; elements that hold no article (menus, headers, footers, sidebars, forms,
notices, adverts, comments, scripts, styles) decide their blocks at once. A class or an id is only a
hint of such an element: layout wrappers are named after what stands beside the article, so hints fall
where they hold most of the prose, and a marked article inside of them is read. A hint that names sections of articles too, or is
joined to a word that is no part of a layout, is a vote only: its blocks follow their neighbours, if these agree. In the second pass the
ambiguous blocks, short ones or such of middling density, take the label of the nearest decided
neighbours, those in the same element first. A marked article is evidence too: where it holds as much text as
there is good prose beside it, blocks outside of it are decided against, and prose inside of it that has few stop
words is ambiguous rather than bad, so it follows its neighbours; sentences without links are ambiguous anywhere.
On a page without any good block the longest ambiguous sentence is taken for one.
Stop words are those of four languages: blocks in other scripts, and pages where no block reaches
their level, are decided by length and links alone.

Work is one map over the pages: nothing is shuffled, and memory is bounded by the longest page.

Defined cases: a null or empty page has the empty text; unclosed, crossed and cut-off tags are
repaired as they come; repeated rows are read each for itself; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, texts

#: Elements by their role.
RAW = "script|style|noscript|template|textarea|iframe|svg|annotation-xml|annotation|canvas|object|title|select|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav aside footer form head menu dialog button label input fieldset legend figcaption header".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hold blocks rather than being one.
BOXES = frozenset("address article aside body center details dialog dir div dl fieldset footer form head header html main menu nav ol section table ul".split())
SENTENCE = tuple(".!?…\"')]”»")
HINTS = re.compile(
    r"(?:^|[\s_\-])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|widget|footer|topbar|toolbar"
    r"|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|comment-list|disqus|respond|replies"
    r"|pagination|pager|skip|copyright|disclaimer|search|tags|byline|meta)(?:$|[\s_\-\d])",
    re.IGNORECASE,
)
HEADS = re.compile(r"(?:^|[\s_\-])(?:header|masthead)(?:$|[\s_\-\d])", re.IGNORECASE)
#: Hints of elements that hold prose or articles of others; the rest of the hints name parts of a layout.
OTHERS = re.compile(
    r"(?:^|[\s_\-])(?:ads?|adverts?|advertisement|adsense|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription"
    r"|signup|login|share|sharing|social|related|recommended|comments?|comment-list|disqus|respond|replies|copyright|disclaimer)(?:$|[\s_\-\d])",
    re.IGNORECASE,
)
#: Words that say nothing of what an element holds, and hints that name sections and remarks of articles as well.
LAYOUT = frozenset(
    "area article articles author bar block blocks body bottom box btn button buttons card cards column container content count element entry footer group has header holder icon icons inline inner item items layout left link links list"
    " main mobile module outer page pages panel post posts primary right row secondary section site sticky story stories text thread title top user view widgets with wrap wrapper".split()
)
WEAK = frozenset("alert notice search social meta tags skip disclaimer overlay".split())
PARTS = re.compile(r"[\s_\-]+")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Frequent words of four languages.
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so what up its about than into them can only other"
    " de la le et les des en un une du que est pour qui dans par sur au plus ne pas se avec ce il sont aux ou mais comme nous elle leur même"
    " der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am noch wie einem über"
    " el los las y del se por con para una su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay".split()
)
#: Lengths in code points; shares of words.
SHORT, LONG, LOW_STOP, HIGH_STOP, MOST_LINKS = 70, 200, 0.10, 0.20, 0.35

#: A self-closed svg element is empty; a slash at the end of an unquoted value closes nothing.
TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<svg(?=[\s/])(?:\s++|/(?!>)|[^\s\"'>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+)*+/>|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([a-zA-Z\-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"\s+")
#: Letters of other scripts than Latin; those that stand for syllables or words count as three.
OTHER_SCRIPT = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff\uff21-\uff5a]")
WIDE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
GOOD, BAD, UNSURE = 1, -1, 0
DOUBTED, REFUSED = 1, 2


def weak(hint: str) -> bool:
    """Whether a hint is no more than a vote: a word that articles use too, or one joined to a word that is no part of a layout."""
    words = [w for w in PARTS.split(hint.lower()) if len(w) > 3 or HINTS.search(w)]
    if len(words) == 1:
        return words[0] in WEAK
    return any(w not in LAYOUT and not w.isdigit() and not HINTS.search(w) and not HEADS.search(w) for w in words)


def judged(tag: str, attrs: str, in_article: bool) -> tuple[bool, str | None]:
    """Whether an element by itself holds no article text; the class or id that hints so."""
    if tag in NEVER:
        return not (tag in ("header", "figcaption") and in_article), None
    if not attrs or tag in ("body", "html") or tag in ARTICLE:
        return False, None
    hint = None
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, None
        if name in ("class", "id") and (HINTS.search(value) or not in_article and HEADS.search(value)):
            for x in value.split():
                if hint is None and (HINTS.search(x) or HEADS.search(x)) or OTHERS.search(x) and not OTHERS.search(hint):
                    hint = x
    return False, hint


def blocks_of(page: str) -> tuple[list[tuple[str, int, int, bool, bool, int]], bool]:
    """``(text, characters in links, bar, in an article, heading, box)`` per block; whether an article is marked.

    The bar is ``REFUSED`` or ``DOUBTED`` by the elements around the block; the box is the number of the innermost element that holds blocks.
    """
    out, parts, stack, opened = [], [], [], Counter()
    linked = link_depth = barred = articles = 0
    heading = False
    box = boxes = 0
    # Articles and hinted elements as a tree: (parent, article above, hint, whether the same hint is open in that article).
    nodes: list[tuple[int, int, str | None, bool]] = [(0, 0, None, False)]
    place: list[int] = []
    node = 0
    hinted = Counter()
    at = breaks = 0

    def flush() -> None:
        nonlocal linked, breaks
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, min(linked, len(text)), REFUSED * (barred > 0), articles > 0, heading, box))
                place.append(node)
            parts.clear()
        linked = breaks = 0

    def pop() -> None:
        nonlocal link_depth, barred, articles, heading, node, box
        tag, bad, own, box = stack.pop()
        opened[tag] -= 1
        barred -= bad
        link_depth -= tag == "a"
        articles -= tag in ARTICLE
        heading = heading and tag not in HEADINGS
        if own:
            node, above, hint, _ = nodes[own]
            hinted[above, hint] -= 1

    def words(piece: str) -> None:
        nonlocal linked, breaks
        parts.append(piece)
        if not piece.isspace():
            breaks = 0
            if link_depth:
                linked += len(piece.strip())

    for m in TOKEN.finditer(page):
        if m.start() > at:
            words(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] is None and not m[0].startswith(("<!", "<?", "</")) and not m[0].endswith(">"):
                break  # a tag that the end of the page cuts off
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                flush()
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in BLOCK and opened["p"]:
            while stack[-1][0] != "p":
                pop()
            pop()
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            pop()
        elif tag == "a" and link_depth:
            while stack[-1][0] != "a":
                pop()
            pop()
        if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK and tag != "a":
            continue
        bad, hint = judged(tag, m["attrs"], articles > 0)
        own = 0
        if hint or tag in ARTICLE and not barred:
            above = node if nodes[node][2] is None else nodes[node][1]
            own = len(nodes)
            nodes.append((node, above, hint, hinted[above, hint] > 0))
            hinted[above, hint] += 1
            node = own
        stack.append((tag, bad, own, box))
        if tag in BOXES:
            boxes += 1
            box = boxes
        opened[tag] += 1
        barred += bad
        link_depth += tag == "a"
        articles += tag in ARTICLE
        heading = heading or tag in HEADINGS
    else:
        if at < len(page):
            words(page[at:])
    flush()
    if len(nodes) == 1:
        return out, False
    if not any(x[2] for x in nodes):
        return out, True
    held, marked = refused(out, place, nodes)
    return [(text, n, max(bar, held[k]), inside, head, box) for (text, n, bar, inside, head, box), k in zip(out, place, strict=True)], marked


def refused(blocks: list[tuple[str, int, int, bool, bool, int]], place: list[int], nodes: list[tuple[int, int, str | None, bool]]) -> tuple[list[int], bool]:
    """What the hints say of the blocks directly at each node, ``REFUSED``, ``DOUBTED`` or nothing; whether an article is marked.

    A hint falls where its element, or all elements of the same name together, hold most of the prose of the article or page
    around them; a name of foreign prose must also hold the first of it, as comments follow what they are about. Of
    the articles those are marked that the fewest hints speak against, and what is outside of an article does not bar it.
    """
    n = len(nodes)
    good, text, begun, foreign = [0] * n, [0] * n, [0] * n, [False] * n
    # The first prose, as a page and as an article has it: good blocks, and what an article of the page holds, or holds before long.
    in_page, in_article = [len(blocks)] * n, [len(blocks)] * n
    for k in range(1, n):
        foreign[k] = foreign[nodes[k][0]] or bool(nodes[k][2] and OTHERS.search(nodes[k][2]))
    for k, (at, block, label) in enumerate(zip(place, blocks, first_pass([(*b[:3], False, *b[4:]) for b in blocks], False), strict=True)):
        if not block[2] and block[1] <= MOST_LINKS * len(block[0]):
            text[at] += len(block[0])
            above = at if nodes[at][2] is None else nodes[at][1]
            begun[above] += 0 if block[4] else len(block[0])
            if label == GOOD:
                good[at] += len(block[0])
            if label == GOOD or above and not foreign[at]:
                in_page[at] = min(in_page[at], k)
            if label == GOOD or begun[above] >= SHORT:
                in_article[at] = min(in_article[at], k)
    alone = list(zip(good, text, strict=True))
    for k in range(n - 1, 0, -1):
        up = nodes[k][0]
        good[up] += good[k]
        text[up] += text[k]
        in_page[up] = min(in_page[up], in_page[k])
        in_article[up] = min(in_article[up], in_article[k])

    def most(above: int, hint: str, some: list[int]) -> bool:
        good_held, text_held = sum(good[k] for k in some), sum(text[k] for k in some)
        if OTHERS.search(hint):
            first = in_article if above else in_page
            return (2 * good_held > good[above] or not good[above]) and 2 * text_held > text[above] and min(first[k] for k in some) == first[above]
        # Inside an article all text counts, since short and unusual paragraphs are taken there.
        return 2 * text_held > text[above] if above else 2 * good_held > good[above]

    alike: dict[tuple[int, str], list[int]] = {}
    for k, (_, above, hint, _) in enumerate(nodes):
        if hint:
            alike.setdefault((above, hint), []).append(k)
    falls = [False] * n
    for (above, hint), members in alike.items():
        some = [k for k in members if most(above, hint, [k])]
        if not some and most(above, hint, [k for k in members if not nodes[k][3]]):
            some = members
        for k in some:
            falls[k] = True

    # Hints against an article: none, of the layout, of foreign prose.
    rank, inner = [0] * n, [0] * n
    own = {}
    for k in range(1, n):
        up, _, hint, _ = nodes[k]
        rank[k] = max(rank[up], 0 if not hint or falls[k] or weak(hint) else 2 if OTHERS.search(hint) else 1)
        inner[k] = k if hint is None else inner[up] if falls[k] else 0
        if hint is None:
            own[k] = (0, 0)
    for k, (a, b) in enumerate(alone):
        if inner[k]:
            c, d = own[inner[k]]
            own[inner[k]] = (a + c, b + d)
    # Comments and teasers may be articles with more prose than the one of the page.
    some = [k for k, x in own.items() if x[1] and rank[k] < 2] or [k for k, x in own.items() if x[1]] or list(own)
    least = min((rank[k] for k in some if own[k][0]), default=min((rank[k] for k in some), default=0))
    held = [0] * n
    for k in range(1, n):
        up, _, hint, _ = nodes[k]
        held[k] = (held[up] if rank[k] > least else 0) if hint is None else max(held[up], 0 if falls[k] else DOUBTED if weak(hint) else REFUSED)
    return held, bool(own)


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()[]«»…*#%$&|") in STOP for w in words) / max(1, len(words))


def other_script(text: str) -> bool:
    """Whether at least half of the letters are not Latin."""
    return not text.isascii() and 2 * len(OTHER_SCRIPT.findall(text)) >= max(1, sum(map(str.isalpha, text)))


def first_pass(blocks: list[tuple[str, int, int, bool, bool, int]], marked: bool) -> list[int]:
    """Labels by each block's own measures."""
    out, stops = [], {}
    for k, (text, linked, barred, inside, heading, _) in enumerate(blocks):
        if barred == REFUSED or marked and not inside or linked > MOST_LINKS * len(text):
            out.append(BAD)
            continue
        if barred:
            out.append(UNSURE)
            continue
        if not heading and other_script(text) and len(text) + 2 * len(WIDE.findall(text)) >= SHORT:
            out.append(GOOD)
        elif heading or len(text) < SHORT:
            out.append(UNSURE if inside or heading or not linked else BAD)
        else:
            stops[k] = stop_density(text)
            if stops[k] >= HIGH_STOP or stops[k] >= LOW_STOP and len(text) >= LONG:
                out.append(GOOD)
            else:
                out.append(UNSURE if inside or stops[k] >= LOW_STOP or not linked and text.endswith(SENTENCE) else BAD)
    if stops and max(stops.values()) < LOW_STOP:
        for k in stops:
            out[k] = GOOD
    return out


def holds_most(blocks: list[tuple[str, int, int, bool, bool, int]]) -> bool:
    """Whether the marked article holds at least as much text as there is good prose beside it."""
    labels = first_pass([(*b[:3], False, *b[4:]) for b in blocks], False)
    inside = sum(len(b[0]) for b in blocks if b[3] and b[2] != REFUSED and b[1] <= MOST_LINKS * len(b[0]))
    return inside >= sum(len(b[0]) for b, x in zip(blocks, labels, strict=True) if x == GOOD and not b[3])


def second_pass(blocks: list[tuple[str, int, int, bool, bool, int]], labels: list[int], marked: bool) -> list[int]:
    """Unsure blocks take the label of their nearest decided neighbours; inside an article refused ones are no neighbours.

    Neighbours in the same box go before others. A doubted block is good only between good ones, or behind or before one with none on
    the other side.
    """
    n = len(labels)
    decided = [x != UNSURE and not (marked and x == BAD and (b[2] or not b[3])) for x, b in zip(labels, blocks, strict=True)]
    before, after = [-1] * n, [-1] * n
    for near, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last, within = -1, {}
        for k in order:
            near[k] = within.get(blocks[k][5], last)
            if decided[k]:
                last = within[blocks[k][5]] = k
    for k in range(n):
        a, b = before[k], after[k]
        own = [j for j in (a, b) if j >= 0 and blocks[j][5] == blocks[k][5]]
        if len(own) == 1:  # the other side has none in the box
            before[k], after[k] = (a, -1) if own[0] == a else (-1, b)
    out = list(labels)
    for k in range(n):
        if labels[k] == UNSURE:
            a, b = before[k], after[k]
            if blocks[k][2]:
                sides = {labels[j] for j in (a, b) if j >= 0}
                out[k] = GOOD if sides == {GOOD} else BAD
            elif a < 0 and b < 0:
                out[k] = GOOD if blocks[k][3] else BAD
            elif a < 0 or b < 0 or labels[a] == labels[b]:
                out[k] = labels[max(a, b)]
            elif blocks[k][4]:
                out[k] = labels[b]  # a heading belongs to what it heads
            elif k - a != b - k:
                out[k] = labels[a if k - a < b - k else b]
            else:
                out[k] = GOOD if blocks[k][3] or stop_density(blocks[k][0]) >= LOW_STOP else BAD
    return out


def main_text(page: str) -> str:
    """The article of a page: its blocks in order, joined by line feeds."""
    blocks, marked = blocks_of(page)
    marked = marked and holds_most(blocks)
    labels = first_pass(blocks, marked)
    if not marked and GOOD not in labels:
        some = [k for k, x in enumerate(labels) if x == UNSURE and not blocks[k][2] and not blocks[k][4] and blocks[k][0].endswith(SENTENCE)]
        if some:
            labels[max(some, key=lambda k: (len(blocks[k][0]), -k))] = GOOD
    labels = second_pass(blocks, labels, marked)
    return "\n".join(b[0] for b, x in zip(blocks, labels, strict=True) if x == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""

    def run(batches):
        for batch in sliced(batches):
            out = [main_text(x.decode("utf-8", "replace")) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html", F.col("url").cast("string").alias("url")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
