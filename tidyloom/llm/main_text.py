"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. A linear classifier gives each block a probability of
being content; its costs are the capacities to the two terminals. Neighbouring blocks,
and following blocks of one parent, are joined by edges that weaken with their distance in
the document tree. The minimum cut separates content from the rest: short paragraphs stay
with their article, and a fluent sentence in a menu goes with the menu.

Scripts, styles and hidden parts never become blocks, nor do forms, but for one around the
page: one that holds an article or main element, or any if there is no content outside forms.
Character references are decoded, white space inside a block becomes one space, blocks are
joined by a line feed.

Defined cases: a null or empty page has an empty text; markup that is cut off or badly
nested is read as far as it goes; repeated rows get equal results. Columns of the input with
the names of the results are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^<>]*)>"
    r"|<[!?][^>]*>",
    re.S,
)
#: One attribute after the other, name and value; a quote that is not closed goes on to the end.
ATTRIBUTE = re.compile(r"(=?[^ \t\n\r\f/=]+)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^ \t\n\r\f\"']\S*)))?")
NAMED_BY = frozenset("class id role aria-label".split())
PART = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, never markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = RAW | frozenset("head noscript template svg math canvas object form select option button datalist audio video map dialog".split())
#: Elements that may stand in a head; anything else ends it.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Elements of other languages, where a tag may close itself.
FOREIGN = frozenset("svg math".split())
#: A tag ends in an unquoted value, of which a slash at the end is part.
UNQUOTED = re.compile(r"=\s*[^\s\"']*\Z")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br"
    .split()
)
#: What an opening element ends, if it is open in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

APART = frozenset("nav footer aside menu".split())
APART_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " copyright disqus discussion footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification"
    " pagination paywall popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social"
    " sponsor sponsored subscribe subscription tags teaser toolbar topbar widget alert complementary contentinfo navigation banners"
    .split()
)
#: Elements whose names say how a page is laid out, not what they hold.
PAGE = frozenset("html body main".split())
#: Names of what follows an article and may hold articles of its own.
AFTER_NAMES = frozenset("comment comments commentlist disqus discussion recommended related replies reply respond".split())
MAIN = frozenset("article main".split())
MAIN_NAMES = frozenset("article content entry main post story maincontent articlebody postbody".split())

# Weights of the classifier, over the logarithm of the odds.
BIAS, IN_MAIN, IN_APART, LINKED, WORDS, TEXTUAL, SENTENCE = -2.0, 3.5, -8.0, -4.0, 0.8, 0.8, 0.6
#: Capacity between blocks, and between following blocks of one parent, side by side in the tree.
NEXT, SIBLING = 1.0, 1.0
#: Capacity that counts as none.
TINY = 1e-9


class Element:
    __slots__ = ("name", "parent", "depth", "firm", "named", "apart", "main", "inner", "article", "dropped", "foreign", "form", "wide", "last")

    def __init__(self, name: str, parent: Element | None, names: set[str], hidden: bool):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        main = bool(parent and parent.main)
        self.main = main or name in MAIN or bool(names & MAIN_NAMES)
        #: Set apart by what it or an element around it is; ``named`` by its own names, which ``set_apart`` weighs.
        self.firm = self.apart = bool(parent and parent.firm) or name in APART or (name == "header" and not main)
        self.named = frozenset() if name in PAGE else APART_NAMES & names
        self.inner = bool(parent and parent.inner) or name in MAIN
        #: The outermost article element around it, or itself.
        self.article: Element | None = (parent.article if parent else None) or (self if name == "article" else None)
        self.form: Element | None = parent.form if parent else None
        self.dropped = hidden or bool(parent and parent.dropped) or name in DROPPED
        if name == "form" and not (self.inner or self.form or hidden or parent.dropped):
            # It may turn out to be around the page.
            self.form, self.dropped = self, False
        self.wide = False
        if name in MAIN and self.form and not self.dropped:
            self.form.wide = True
        self.foreign = bool(parent and parent.foreign) or name in FOREIGN
        self.last: int | None = None


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


def _marks(rest: str) -> tuple[set[str], bool]:
    """Name parts in class, id, role and label, and whether the element is hidden."""
    names, hidden, seen = set(), False, set()
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        # Of an attribute that is given twice the first counts.
        if key in seen:
            continue
        seen.add(key)
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key == "style":
            bare = "".join(value.split())
            hidden = hidden or "display:none" in bare or "visibility:hidden" in bare
        elif key in NAMED_BY:
            names.update(PART.split(value))
    return names, hidden


def blocks(page: str, forms: bool = False) -> list[Block]:
    """Text blocks of a page in order, without those of forms unless one is around the page or ``forms`` is set."""
    root = Element("", None, set(), False)
    at, made, found, pieces, linked, in_link, place = root, [], [], [], 0, False, 0

    def flush() -> None:
        nonlocal linked, in_link
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, linked, at))
        pieces.clear()
        linked, in_link = 0, False

    while True:
        token = TOKEN.search(page, place)
        raw = page[place : token.start() if token else len(page)]
        if at.name == "head" and raw.strip():
            at = at.parent
        if raw and not at.dropped:
            piece = html.unescape(raw) if "&" in raw else raw
            pieces.append(piece)
            linked += len(piece) if in_link else 0
        if token is None:
            break
        place = token.end()
        name = token["name"] or token["name2"]
        if not name:
            continue
        name, ends = name.lower(), bool(token["end"] or token["end2"])
        if name == "a":
            in_link = not ends
        if not ends and name not in HEAD:
            if at.name == "head":
                at = at.parent
            elif name == "body":
                # It ends a head with all that is left open there.
                up = at
                while up.parent is not None and up.name not in ("head", "template"):
                    up = up.parent
                if up.name == "head":
                    at = up.parent
        if name not in BLOCKS and name not in DROPPED:
            # An inline element matters only for what it hides or sets apart.
            rest = token["rest"] or token["rest2"] or ""
            if not ends and name not in VOID and rest and name != "a":
                names, hidden = _marks(rest)
                if hidden or names & APART_NAMES:
                    flush()
                    at = Element(name, at, names, hidden)
                    made.append(at)
            elif ends and at.name == name:
                flush()
                at = at.parent or root
            continue
        flush()
        if ends:
            up = at
            while up.parent is not None and up.name != name:
                up = up.parent
            if up.parent is not None:
                at = up.parent
            continue
        if name in ("br", "hr"):
            continue
        up = at
        if name in ENDS:
            while up.parent is not None and up.name not in HOLDS[name] and up.name not in ENDS[name]:
                up = up.parent
            while up.parent is not None and up.name in ENDS[name]:
                at = up = up.parent
        else:
            # A paragraph ends where a block begins.
            while up.parent is not None and up.name not in BLOCKS:
                up = up.parent
            if up.name == "p":
                at = up.parent
        rest = token["rest"] or token["rest2"] or ""
        if rest.endswith("/") and (at.foreign or name in FOREIGN) and not UNQUOTED.search(rest):
            continue
        names, hidden = _marks(rest) if rest else (set(), False)
        if name in RAW:
            close = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, place)
            place = close.end() if close else len(page)
        else:
            at = Element(name, at, names, hidden)
            made.append(at)
    flush()
    found = [b for b in found if forms or b.element.form is None or b.element.form.wide]
    set_apart(made, found)
    return found


def set_apart(made: list[Element], found: list[Block]) -> None:
    """Set apart what elements or names say, but for names of what contains the main element or article.

    The main article is one that has half the text of the longest at least, and fewest names
    around it. Articles among comments or related ones count if there is no other content.
    """
    around: set[Element] = set()

    def clear(element: Element | None) -> None:
        while element is not None and element not in around:
            around.add(element)
            element = element.parent

    def mark() -> None:
        for e in made:
            e.apart = e.firm or e.parent.apart or (bool(e.named) and e not in around)

    for e in made:
        if e.name == "main" and not e.firm and not e.dropped:
            clear(e.parent)
    mark()
    if not any(e.article is e and e.apart and not e.firm for e in made):
        return
    size: dict[Element, int] = {}
    elsewhere = 0
    for b in found:
        article = b.element.article
        if article is None:
            elsewhere += len(b.text) if odds(b) > 0 else 0
        elif not b.element.firm:
            size[article] = size.get(article, 0) + len(b.text)
    names: dict[Element, list[frozenset[str]]] = {}
    for article in size:
        up, names[article] = article, []
        while up is not None:
            if up.named and up not in around:
                names[article].append(up.named)
            up = up.parent
    first = [a for a in size if not AFTER_NAMES & frozenset().union(*names[a])]
    choice = first or ([] if elsewhere else list(size))
    longest = max([elsewhere, *(size[a] for a in choice)])
    if choice and 2 * elsewhere < longest:
        clear(min((a for a in choice if 2 * size[a] >= longest), key=lambda a: (len(names[a]), -size[a])))
        mark()


def odds(block: Block) -> float:
    """Log-odds of a block being content."""
    size = len(block.text)
    words = block.text.count(" ") + 1
    textual = block.element.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre")
    return (
        BIAS + IN_MAIN * block.element.main + IN_APART * block.element.apart + LINKED * block.linked / size
        + WORDS * math.log1p(words) + TEXTUAL * textual + SENTENCE * (block.text[-1] in ".!?…:;\"”»")
    )


def _distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness capacities between blocks."""
    out: dict[tuple[int, int], float] = {}
    for i, block in enumerate(found):
        if i:
            out[i - 1, i] = NEXT / (1 + _distance(found[i - 1].element, block.element))
        parent = block.element.parent
        if parent is not None:
            if parent.last is not None:
                out[parent.last, i] = out.get((parent.last, i), 0) + SIBLING / 2
            parent.last = i
    return out


def minimum_cut(source: list[float], sink: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; links carry both ways.

    A node whose terminal outweighs all its links is settled at once and hands its links
    to its neighbours' terminals; maximum flow decides about the rest.
    """
    n = len(source)
    source, sink = list(source), list(sink)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in links.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    side: list[bool | None] = [None] * n
    open_ = deque(range(n))
    while open_:
        i = open_.popleft()
        if side[i] is not None or abs(source[i] - sink[i]) < sum(near[i].values()):
            continue
        side[i] = source[i] > sink[i]
        for j, w in near[i].items():
            del near[j][i]
            if side[i]:
                source[j] += w
            else:
                sink[j] += w
            open_.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, with_source in zip(rest, _max_flow(rest, source, sink, near), strict=True):
            side[i] = with_source
    return [bool(s) for s in side]


def _max_flow(nodes: list[int], source: list[float], sink: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Source side of the minimum cut, by blocking flows along shortest paths.

    What both terminals of a node carry passes straight through it, so a node is left with
    either something to send or room to take, and paths run between those. A round sends all
    that shortest paths let through, to takers at any distance, and enters no dead end twice.
    """
    place = {node: p for p, node in enumerate(nodes)}
    spare = [source[node] - sink[node] for node in nodes]
    target: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in nodes]
    for p, node in enumerate(nodes):
        for other, width in near[node].items():
            q = place[other]
            if p < q:
                # Arcs 2k and 2k + 1 are the two directions of a link.
                arcs[p].append(len(target))
                arcs[q].append(len(target) + 1)
                target += (q, p)
                room += (width, width)
    while True:
        level, reached = _levels(spare, target, room, arcs)
        if not reached:
            return [depth >= 0 for depth in level]
        at = [0] * len(nodes)
        for start in [p for p, left in enumerate(spare) if left > TINY]:
            _send(start, spare, target, room, arcs, level, at)


def _levels(spare: list[float], target: list[int], room: list[float], arcs: list[list[int]]) -> tuple[list[int], bool]:
    """Distance of every node from those that can send, -1 where they do not reach, and whether one can take."""
    level = [0 if left > TINY else -1 for left in spare]
    front, depth, reached = [p for p, d in enumerate(level) if d == 0], 0, False
    while front:
        depth += 1
        following = []
        for p in front:
            for arc in arcs[p]:
                q = target[arc]
                if level[q] < 0 and room[arc] > TINY:
                    level[q] = depth
                    following.append(q)
                    reached = reached or spare[q] < -TINY
        front = following
    return level, reached


def _send(
    start: int, spare: list[float], target: list[int], room: list[float], arcs: list[list[int]], level: list[int], at: list[int]
) -> None:
    """Send from one node whatever the level graph lets through; ``at`` tells the next arc of every node."""
    path: list[int] = []
    p = start
    while spare[start] > TINY:
        if spare[p] < -TINY:
            flow = min(spare[start], -spare[p], *(room[arc] for arc in path))
            spare[start] -= flow
            spare[p] += flow
            for arc in path:
                room[arc] -= flow
                room[arc ^ 1] += flow
            # Go on from the first link that is full now.
            full = next((i for i, arc in enumerate(path) if room[arc] <= TINY), len(path))
            if full < len(path):
                p = target[path[full] ^ 1]
                del path[full:]
            continue
        own = arcs[p]
        while at[p] < len(own) and not (room[own[at[p]]] > TINY and level[target[own[at[p]]]] == level[p] + 1):
            at[p] += 1
        if at[p] < len(own):
            path.append(own[at[p]])
            p = target[path[-1]]
        elif path:
            p = target[path.pop() ^ 1]
            at[p] += 1
        else:
            return


def extract(page: str | None) -> str:
    """The blocks on the content side of the cut, one a line."""
    found = blocks(page or "")
    text = _content(found)
    if not text:
        # Without content elsewhere a form may be around the page, which then is read as if it had none.
        every = blocks(page or "", forms=True)
        text = _content(every) if len(every) > len(found) else ""
    return text


def _content(found: list[Block]) -> str:
    if not found:
        return ""
    chance = [odds(b) for b in found]
    # Costs: -log of the probability of the label, written without cancellation.
    as_rest = [math.log1p(math.exp(min(c, 500))) for c in chance]
    as_content = [math.log1p(math.exp(min(-c, 500))) for c in chance]
    kept = minimum_cut(as_rest, as_content, edges(found))
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """All columns but the page, with its text and n_chars."""
    others = [f for f in pages.schema.fields if f.name not in (page, "text", "n_chars")]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(batch.schema.get_field_index(page)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*names, "text"])

    found = pages.select(*names, page).mapInArrow(run, T.StructType([*others, T.StructField("text", T.StringType())]))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
