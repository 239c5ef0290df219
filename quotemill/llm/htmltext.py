"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks of text in page order. A linear classifier gives each block a log-odds of being content; it becomes
the capacity of an edge from the source (content) or to the sink (boilerplate). Blocks next to each other, next siblings under
one parent and next blocks of one template are joined by smoothness edges. A maximum flow gives the cheapest cut: the blocks
left on the source's side are the text. Blocks whose terminal outweighs all their edges are decided before, which changes no
minimum cut; what they border on becomes terminal capacity of the others.

Evidence against an element counts for all that it holds: in full if the element is hidden, a menu or the like. A form, or an
element with a telling name, may wrap the whole page, so its cost falls the more of the text that could be content it holds;
and <main>, role=main and articleBody inside clear all but hiding, an <article> clears forms and names if it is large enough.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"""=\s*["']|>""")
NAMED = re.compile(r"""\b(class|id|role|style|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: Fixed sets of element names: read to their end tag or the page's end; content is not shown, if they are closed; of these, blocks inside end them; blocks;
#: elements without content; elements that end open ones of a kind.
RAW = frozenset("script style noscript textarea title iframe".split())
UNSHOWN = frozenset("template svg object select datalist canvas audio video annotation annotation-xml".split())
NARROW = frozenset("svg select datalist annotation".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ENDS |= dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split(), {"p"})
#: Elements that an implied end does not reach across.
FENCES = frozenset("html body table ul ol dl div article section main aside nav form blockquote td th".split())

AGAINST_TAGS = frozenset("nav footer aside menu dialog button".split())
FORM_TAGS = frozenset("form fieldset".split())
FOR_TAGS = frozenset("article main".split())
AGAINST_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status".split())
AGAINST_NAMES = re.compile(
    r"(?:^|[-_])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|topbar|breadcrumbs?|footer|foot|masthead|site-?header|page-?header|sidebar|side|rail|aside|widgets?|related|recommend\w*"
    r"|trending|popular|share|sharing|social|follow|subscribe|subscription|newsletter|signup|sign-?in|login|register|search|form|cookies?|consent|gdpr|notice|notices|alert|announcement|disclaimer|popup|pop-?up|modal|overlay|toast"
    r"|comments?|commentlist|replies|reply|respond|disqus|discussion|copyright|legal|pagination|pager|tags?|tagcloud|toolbar|hidden|skip)(?:$|[-_\d])",
    re.I,
)
FOR_NAMES = re.compile(r"(?:^|[-_])(?:article|content|main|post|entry|story|body|text|prose)(?:$|[-_\d])", re.I)

#: Log-odds of the classifier.
BASE, PER_CHAR, MOST_CHARS, PER_SENTENCE, MOST_SENTENCES = -0.3, 0.006, 300, 0.4, 3
LINKS, HEADING, SHORT, IN_ARTICLE, FOR_NAME, AGAINST = -4.0, 0.6, -0.4, 2.4, 0.8, -9.0
#: A form or named element costs nothing from this share of what it and the text around it without such evidence hold, and all below by so much.
FREE_SHARE, FULL_SLOPE = 0.875, 4.0
#: Kinds of evidence by weight, an article within some counting as none of its own.
ARTICLE, SOFT, HARD, HIDDEN = range(4)
#: Capacities of smoothness edges; what is left of NEXT for each step beyond siblings in the tree, up to FAR; and of any edge into a wrapper.
NEXT, SIBLING, TEMPLATE = 2.5, 1.5, 0.1
FADE, FAR, ACROSS = 0.6, 8, 0.3


@dataclass
class Element:
    tag: str
    number: int
    parent: Element | None
    wrapper: int
    favour: float
    link: bool
    template: tuple
    holder: Element = None  # itself, or for inline elements the next block element around it

    def __post_init__(self) -> None:
        self.holder = self.parent.holder if self.parent and self.tag in INLINE else self


@dataclass
class Wrapper:
    """An element with evidence against what it holds, within another such (0: none), or an article within one."""

    kind: int
    outer: int
    own: int = 0  # characters that no wrapper inside holds, articles taken as none
    all: int = 0
    clean: int = 0  # characters of own and of the outer ones
    cost: float = 0.0


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    cost: float = 0.0


def tokens(html: str) -> Iterator[tuple[bool, str, str, str]]:
    """(closing, tag, attributes, text) of every tag (text empty) and run of text (tag empty). What is not text is passed once, in one direction.

    A tag that never ends, and all after it, is no token; neither are comments, declarations and the contents of raw elements.
    """
    at, end = 0, len(html)
    closed = dict.fromkeys("\"'", True)  # whether the quote may occur again
    while at < end:
        if html[at] != "<":
            stop = html.find("<", at)
            stop = end if stop < 0 else stop
            yield False, "", "", html[at:stop]
            at = stop
            continue
        if html.startswith(("<!", "<?"), at):
            close = "-->" if html.startswith("<!--", at) else "]]>" if html.startswith("<![CDATA[", at) else ">"
            stop = html.find(close, at + 2)
            at = end if stop < 0 else stop + len(close)
            continue
        closing = html.startswith("/", at + 1)
        name = NAME.match(html, at + 1 + closing)
        if not name:
            yield False, "", "", "<"
            at += 1
            continue
        stop = name.end()
        while (found := QUOTE_OR_END.search(html, stop)) and html[found.start()] != ">":
            quote = html[found.end() - 1]
            shut = html.find(quote, found.end()) if closed[quote] else -1
            closed[quote] = shut >= 0
            stop = shut + 1 if shut >= 0 else found.end()
        if found is None:
            return
        tag, attributes, at = name.group().lower(), html[name.end() : found.start()], found.end()
        if tag in RAW and not closing and not attributes.endswith("/"):
            close = RAW_END[tag].search(html, at)
            shut = html.find(">", close.end()) if close else -1
            at = shut + 1 if shut >= 0 else end
        elif tag not in RAW:
            yield closing, tag, attributes, ""


def shown(found: list[tuple[bool, str, str, str]]) -> Iterator[tuple[bool, str, str, str]]:
    """The tokens without those of elements that are not shown, nested ones included. One that is never closed hides nothing: only its tag goes.

    A drawing or a list of choices cannot hold blocks, so one that is open before a block is never closed.
    """
    opened: dict[str, list[int]] = {tag: [] for tag in UNSHOWN}
    foreign, hidden = 0, [0] * (len(found) + 1)  # where hidden ranges begin and end
    for k, (closing, tag, attributes, _) in enumerate(found):
        if tag in UNSHOWN:
            if closing and opened[tag]:
                hidden[opened[tag].pop()] += 1
                hidden[k + 1] -= 1
            elif not closing and not attributes.endswith("/"):
                opened[tag].append(k)
        elif tag == "foreignobject":
            foreign += -1 if closing else 1
        elif not closing and foreign <= 0 and "p" in ENDS.get(tag, ()):
            for t in NARROW:
                opened[t].clear()
    depth = 0
    for token, change in zip(found, hidden, strict=False):
        depth += change
        if not depth and token[1] not in UNSHOWN:
            yield token


def blocks_of(html: str) -> list[Block]:
    """The page's blocks with text, in order."""
    root = Element("", 0, None, 0, 0.0, False, ())
    wrappers = [Wrapper(ARTICLE, 0)]
    stack, blocks, current, number = [root], [], None, 0
    opened: Counter[str] = Counter()

    def shut(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    for closing, tag, attributes, text in shown(list(tokens(html))):
        if not tag:
            if text.isspace() and current is None:
                continue
            if current is None:
                current = Block(stack[-1].holder)
                blocks.append(current)
            decoded = unescape(text) if "&" in text else text
            current.parts.append(decoded)
            if stack[-1].link:
                current.linked += len(decoded.strip())
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            current = None
        if closing:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    shut(k)
                    break
                if inline and stack[k].tag not in INLINE:
                    break
            continue
        ends = ENDS.get(tag, ())
        for k in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ends) else ():
            if stack[k].tag in ends:
                shut(k)
                break
            if stack[k].tag in FENCES:
                break
        if tag in VOID or attributes.endswith("/") and inline:
            continue
        top = stack[-1]
        number += 1
        favour, name, kinds, main, named = top.favour, "", set(), tag == "main", False
        if tag in FOR_TAGS:
            favour = max(favour, IN_ARTICLE)
        elif tag in AGAINST_TAGS or tag == "header" and favour < IN_ARTICLE:
            kinds.add(HARD)
        elif tag in FORM_TAGS:
            kinds.add(SOFT)
        if attributes:
            for key, value in NAMED.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    name += " " + value
                    for token in value.split():
                        if AGAINST_NAMES.search(token):
                            named = True
                        elif FOR_NAMES.search(token):
                            favour = max(favour, FOR_NAME)
                elif key == "role":
                    if value.lower() in AGAINST_ROLES:
                        kinds.add(HARD)
                    elif value.lower() == "form":
                        kinds.add(SOFT)
                    main = main or value.lower() == "main"
                    favour = max(favour, IN_ARTICLE if value.lower() in ("main", "article") else 0.0)
                elif key == "itemprop":
                    main = main or value.lower() == "articlebody"
                    favour = max(favour, IN_ARTICLE if value.lower() == "articlebody" else 0.0)
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    kinds.add(HIDDEN)
        wrapper = top.wrapper
        if main:
            while wrapper and wrappers[wrapper].kind != HIDDEN:
                wrapper = wrappers[wrapper].outer
            kinds &= {HARD, HIDDEN}
        elif named and tag not in ("html", "body", "article"):
            kinds.add(SOFT)
        elif tag == "article" and not named and wrapper:
            kinds.add(ARTICLE)
        if kinds:
            wrappers.append(Wrapper(max(kinds), wrapper))
            wrapper = len(wrappers) - 1
        opened[tag] += 1
        stack.append(Element(tag, number, top, wrapper, favour, top.link or tag == "a", (top.template[-2:], tag, name)))
    for block in blocks:
        block.text = " ".join("".join(block.parts).split())
    blocks = [b for b in blocks if b.text]
    weigh(blocks, wrappers)
    return blocks


def weigh(blocks: list[Block], wrappers: list[Wrapper]) -> None:
    """Sets what the wrappers cost their blocks."""
    measure(blocks, wrappers)
    for w in wrappers[1:]:
        if w.kind == ARTICLE:
            outer = w.outer
            while wrappers[outer].kind == ARTICLE and outer:
                outer = wrappers[outer].outer
            if wrappers[outer].kind == SOFT and 2 * w.all >= wrappers[wrappers[outer].outer].clean:
                while outer and wrappers[outer].kind <= SOFT:
                    outer = wrappers[outer].outer
                w.outer = outer
    measure(blocks, wrappers)
    for w in wrappers[1:]:
        if w.kind == SOFT:
            share = w.all / (w.all + wrappers[w.outer].clean) if w.all else 0.0
            w.cost = AGAINST * min(1.0, max(0.0, FULL_SLOPE * (FREE_SHARE - share)))
        elif w.kind != ARTICLE:
            w.cost = AGAINST
        w.cost = min(w.cost, wrappers[w.outer].cost)
    for block in blocks:
        block.cost = wrappers[block.element.wrapper].cost


def measure(blocks: list[Block], wrappers: list[Wrapper]) -> None:
    """Sets the sizes of all wrappers; an outer one comes before those it holds."""
    holds = list(range(len(wrappers)))  # the wrapper with evidence that text directly in this one counts for
    for k, w in enumerate(wrappers):
        w.own = w.all = 0
        if k and w.kind == ARTICLE:
            holds[k] = holds[w.outer]
    for block in blocks:
        wrappers[block.element.wrapper].all += len(block.text)
        wrappers[holds[block.element.wrapper]].own += len(block.text)
    for w in reversed(wrappers[1:]):
        wrappers[w.outer].all += w.all
    wrappers[0].clean = wrappers[0].own
    for w in wrappers[1:]:
        w.clean = w.own + wrappers[w.outer].clean


def log_odds(block: Block) -> float:
    """The classifier's view of one block; positive for content."""
    text, size = block.text, len(block.text)
    sentences = min(MOST_SENTENCES, sum(text.count(c) for c in ".!?。！？"))
    odds = BASE + PER_CHAR * min(size, MOST_CHARS) + PER_SENTENCE * sentences + LINKS * min(1.0, block.linked / size) + block.element.favour
    if block.element.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        odds += HEADING
    elif size < 25 and not sentences:
        odds += SHORT
    return odds + block.cost


def distance(a: Element, b: Element) -> int:
    """Steps between two elements by way of their nearest common ancestor, at most FAR."""
    steps = 0
    while a is not b and steps < FAR:
        if a.number > b.number:  # a parent has a smaller number
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Undirected edges between next blocks of the page, by their distance in the tree, under one parent and of one template.

    Where evidence against one of the two sets in, the edge has a part of that capacity only.
    """
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple, int] = {}
    for k, block in enumerate(blocks):
        element = block.element
        if k:
            edges[k - 1, k] = NEXT * FADE ** max(0, distance(blocks[k - 1].element, element) - 2)
        for kind, key, capacity in (("sibling", element.parent and element.parent.number, SIBLING), ("template", element.template, TEMPLATE)):
            if (j := last.get((kind, key))) is not None:
                edges[j, k] = edges.get((j, k), 0.0) + capacity
            last[kind, key] = k
    return {(j, k): c * (ACROSS if blocks[j].element.wrapper != blocks[k].element.wrapper else 1.0) for (j, k), c in edges.items()}


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node lies on the source's side of a minimum cut; odds are capacities from the source, negative ones to the sink."""
    near: list[dict[int, float]] = [{} for _ in odds]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    odds = list(odds)
    side: list[bool | None] = [None] * len(odds)
    todo = deque(range(len(odds)))
    while todo:  # decided nodes are cut off, their edges become terminal capacity
        i = todo.popleft()
        if side[i] is None and abs(odds[i]) >= sum(near[i].values()):
            side[i] = odds[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                odds[j] += c if side[i] else -c
                todo.append(j)
            near[i] = {}
    left = [i for i, s in enumerate(side) if s is None]
    if left:
        for i in source_side({i: odds[i] for i in left}, {i: near[i] for i in left}):
            side[i] = True
    return [bool(s) for s in side]


def source_side(odds: dict[int, float], near: dict[int, dict[int, float]]) -> set[int]:
    """Nodes that residual capacity reaches from the source after a maximum flow.

    In each phase the residual graph is layered by steps from the source and flow is pushed along layers until none reaches the
    sink (Dinic's method), depth first without recursion, each node going on from the neighbour where it last found room.
    """
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i, own in near.items():
        room[i] = dict(own)
    for i, c in odds.items():
        if c > 0:
            room[source][i], room[i][source] = c, 0.0
        elif c < 0:
            room[i][sink], room[sink][i] = -c, 0.0
    while True:
        layer, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-9 and j not in layer:
                    layer[j] = layer[i] + 1
                    queue.append(j)
        if sink not in layer:
            return set(layer) - {source}
        onward = {i: [j for j in room[i] if layer.get(j, -1) == layer[i] + 1] for i in layer}
        place, path = dict.fromkeys(layer, 0), [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] += flow
                del path[next(k for k, (a, b) in enumerate(steps) if room[a][b] <= 1e-9) + 1 :]
                continue
            own = onward[i]
            while place[i] < len(own) and room[i][own[place[i]]] <= 1e-9:
                place[i] += 1
            if place[i] < len(own):
                path.append(own[place[i]])
            else:
                path.pop()
                if path:
                    place[path[-1]] += 1


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    kept = minimum_cut([log_odds(b) for b in blocks], smoothness(blocks))
    return " ".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) of every row.

    Needs page_id, url and html; other columns are ignored. A null html is empty and has the empty text; ids and urls may be
    null. Repeated rows stay repeated; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.record_batch({"page_id": part["page_id"], "url": part["url"], "text": pa.array([main_text(h.as_py()) for h in part["html"]], pa.string())})

    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
