"""HTML extraction with wrappers inferred from the pages of each host.

A page's token stream becomes an ordered tree of its block elements in which equal neighbours are
folded into a repeated group. Trees of one host are aligned one after the other: elements that match
are merged, elements that only one side has become optional groups, runs of equal elements become
repeated groups, and text becomes slots. The result is a union-free regular expression over blocks,
written as a tree: the host's wrapper. Every slot keeps a small summary (a few hashes of pages' contents
and of its texts, characters, characters in links) that tells template text from varying text.

Wrappers are combined inside each partition first, so a host with a third of all pages sends one
partial wrapper from each task to its merge, never its pages. Extraction reads each page against its
host's wrapper: what lies in elements named for navigation, headers, footers, sidebars, notices,
adverts, forms or comments goes (but not what holds the main container), and of the rest the main container's blocks are kept in page order.
Where a page has no main container, slots go that hold one and the same text on pages of at least
five different contents; copies of a page are one content, and inside a main container no slot goes.

Defined results: a null, empty or textless page gives '' and 0; a page whose host gives no wrapper is
read by element names alone; a url without host shares the host ''; broken markup is read to its end;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Wrappers are broadcast only where they have at most so many characters in all.
WRAPPER_CHARS = 16_000_000
#: Distinct texts that a slot's summary remembers; a partition holds so many hosts' wrappers at once.
_TEXTS, _HOSTS = 8, 2000
#: Different page contents that make a slot's one text a template; a summary remembers no more of them.
_CONTENTS = 5
#: Levels of nested blocks that a wrapper follows; below, a page is read by element names alone.
_LEVELS = 60
#: Children lists are aligned by their longest common subsequence up to so many cells, then by the next equal label within ``_NEAR``.
_CELLS, _NEAR = 250_000, 64

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)"""
    r"""|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
#: Elements whose content is no text; one that is never closed holds nothing.
_OPAQUE = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("noscript", "template", "svg", "iframe", "select", "object")}
_NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_GONE = re.compile(r"(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form menu dialog button option fieldset search audio video canvas".split())
#: Elements that an opening tag of the key ends when they are still open.
_ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
_SCOPE = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table td th ul".split())
#: What class names, ids and roles of chrome are called: the name as a whole or, of a compound, the word it ends with.
_CHROME = re.compile(
    r"ad|ads|adv|advert\w*|adsense|promo\w*|sponsor\w*|banner|cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|"
    r"subscri\w*|signup|login|share|sharing|social|related|recommend\w*|sidebar|side|rail|widget|menu|nav|navbar|navigation|topbar|breadcrumbs?|pagination|pager|comments?|"
    r"commentlist|disqus|replies|reply|respond|reactions|footer|header|masthead|toolbar|search|skip|tags|tagcloud|toc|copyright|legal|disclaimer|complementary|contentinfo"
)
#: Words after a compound's head that leave its meaning (share-buttons), and words that make a name the state of something else (has-sidebar).
_AFTER = frozenset(
    "area articles bar block body bottom box button buttons center column container content form group icon icons inner item items left link links list media "
    "news outer panel posts primary right secondary section slot stories title top unit wrap wrapper".split()
)
_STATE = frozenset("has have with no not without is hide hides show shows".split())
_WHOLE = frozenset(
    "article articlebody article-body article-content content entry entry-content main main-content maincontent post post-body post-content story story-body".split()
)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|main|content|post|entry|story|body|text)(?=$|[\s_-]|\d)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


class Block:
    """A block element: its label, its text runs in order, and its child blocks."""

    __slots__ = ("label", "name", "marks", "chrome", "hidden", "children", "items", "linked", "parent", "claim", "volume")

    def __init__(self, label: str, name: str, marks: str, chrome: str, hidden: bool, parent: Block | None) -> None:
        self.label, self.name, self.marks, self.hidden, self.parent = label, name, marks, hidden, parent
        self.chrome = "" if name in ("", "body", "html", "article", "main") else chrome
        self.children: list[Block] = []
        self.items: list[str | Block] = []  # text runs and child blocks in page order
        self.linked = 0
        self.claim = self.volume = 0  # set by _measure


@lru_cache(4096)
def _called(marks: str) -> str:
    """The word by which class names, ids and roles call an element chrome; '' where none does or one is the main container's."""
    names = [_CAMEL.sub("-", x).lower().replace("_", "-").strip("-") for x in marks.split()]
    if not _WHOLE.isdisjoint(names):
        return ""
    words = []
    for name in names:
        parts = [x for x in (re.sub(r"[0-9].*", "", y) for y in name.split("-")) if x]
        while len(parts) > 1 and parts[-1] in _AFTER:
            parts.pop()
        if parts and _STATE.isdisjoint(parts) and _CHROME.fullmatch(parts[-1]):
            words.append(parts[-1])
    return next((w for w in words if w != "header"), words[0] if words else "")


def _blank(text: str) -> str:
    return " ".join(text.split())


def parse(page: str) -> Block:
    """The tree of block elements; inline markup only adds its text, scripts and comments add nothing."""
    root = at = Block("", "", "", "", False, None)
    open_: list[str] = []  # every open element, inline ones too
    places: dict[str, list[int]] = {}  # where in it each name stands
    scopes: list[int] = []  # where in it scopes stand
    blocks: list[Block] = [root]
    run: list[str] = []
    in_link = skipped = 0
    unclosed: set[str] = set()

    def flush() -> None:
        if run:
            text = _blank(entities.unescape("".join(run)))
            run.clear()
            if text:
                at.items.append(text)

    def opened(name: str) -> None:
        nonlocal in_link, skipped
        places.setdefault(name, []).append(len(open_))
        if name in _SCOPE:
            scopes.append(len(open_))
        open_.append(name)
        if name not in BLOCKS:
            in_link += name == "a"
            skipped += name in _DROPPED

    def closed(upto: int) -> None:
        """Close the elements from a place on."""
        nonlocal at, in_link, skipped
        while len(open_) > upto:
            last = open_.pop()
            places[last].pop()
            if last in _SCOPE:
                scopes.pop()
            if last in BLOCKS:
                blocks.pop()
                at = blocks[-1]
            elif last == "a":
                in_link = max(0, in_link - 1)
            elif last in _DROPPED:
                skipped = max(0, skipped - 1)

    pos = 0
    while pos < len(page):
        m = _TOKEN.match(page, pos)
        pos = m.end()
        text = m.group("text")
        if text is not None:
            if not skipped:
                run.append(text)
                if in_link:
                    at.linked += len(text)
            continue
        if m.group("cdata") is not None:
            run.append(m.group("cdata"))
            continue
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if m.group("close"):
            if not places.get(name):
                if name == "br":
                    run.append(" ")
                continue
            if name in BLOCKS:
                flush()
            elif name in _SCOPE or (scopes and scopes[-1] > places[name][-1]):
                continue  # an inline end does not close blocks that were opened inside
            closed(places[name][-1])
            continue
        if name in _OPAQUE and name not in unclosed:
            end = _OPAQUE[name].search(page, pos)
            if end:
                pos = end.end()
                continue
            unclosed.add(name)  # nor is any later one
        if name in _VOID:
            if name == "hr":
                flush()
            run.append(" ")
            continue
        attrs = m.group("attrs")
        if name not in BLOCKS:
            if attrs.rstrip().endswith("/"):
                continue
            opened(name)
            continue
        flush()
        ends = _ENDS.get(name) or ({"p"} if name not in ("body", "html") else set())
        inner = len(scopes) - 1
        while inner >= 0 and open_[scopes[inner]] in ends:
            inner -= 1
        least = scopes[inner] if inner >= 0 else -1
        cut = [at_[bisect_right(at_, least)] for at_ in (places.get(e) for e in ends) if at_ and at_[-1] > least]
        if cut:
            closed(min(cut))
        named = " ".join(a or b or c for _, a, b, c in _NAMED.findall(attrs)) if attrs else ""
        marks = _CAMEL.sub(" ", named)
        block = Block(f"{name}.{re.sub(r'[0-9]+', '#', marks)}" if marks else name, name, marks, _called(named) if named else "", bool(attrs and _GONE.search(attrs)), at)
        at.children.append(block)
        at.items.append(block)
        blocks.append(block)
        opened(name)
        at = block
    flush()
    _spare(root)
    return root


# A wrapper node is [label, optional, repeated, hashes of page contents, hashes of texts, characters, linked characters, children].
LABEL, OPTIONAL, REPEATED, PAGES, HASHES, CHARS, LINKED, CHILDREN = range(8)


def _content(block: Block) -> int:
    """Hash of a page's text without chrome, by which copies of a page are one."""
    texts: list[str] = []
    stack: list[str | Block] = [block]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            texts.append(item)
        elif not _chrome(item, False):
            stack += reversed(item.items)
    return int.from_bytes(blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=6).digest())


def _spare(root: Block) -> None:
    """Unmark what holds the main container: an element that claims to be it and has more text than all outside of marked ones."""
    _measure(root)
    best, least = None, root.volume[0]
    stack = [(root, False)]
    while stack:
        block, marked = stack.pop()
        if block.hidden or block.name in _DROPPED or block.name == "header":
            continue
        marked = marked or bool(block.chrome)
        if marked and block.claim >= 2 and block.volume[1] > least:
            best, least = block, block.volume[1]
        stack += ((c, marked) for c in block.children)
    if best is None:
        return
    while best is not None:
        best.chrome = ""
        best = best.parent
    _measure(root)


def tree(block: Block, content: int | None = None, level: int = 0) -> list:
    """A page's own wrapper: equal neighbours folded."""
    content = _content(block) if content is None else content
    texts = [x for x in block.items if isinstance(x, str)]
    hashes = sorted({zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts})[:_TEXTS]
    below = [tree(c, content, level + 1) for c in block.children] if level < _LEVELS else []
    node = [block.label, False, False, [content], hashes, sum(map(len, texts)), block.linked, below]
    _fold(node)
    return node


def _fold(node: list) -> None:
    out: list[list] = []
    for child in node[CHILDREN]:
        if out and out[-1][LABEL] == child[LABEL]:
            out[-1] = merge(out[-1], child)
            out[-1][REPEATED] = True
        else:
            out.append(child)
    node[CHILDREN] = out


def _aligned(a: list[list], b: list[list]) -> Iterator[tuple[list | None, list | None]]:
    """Pairs of nodes with one label, in order, and what only one side has."""
    same = 0
    while same < min(len(a), len(b)) and a[same][LABEL] == b[same][LABEL]:
        same += 1
    yield from zip(a[:same], b[:same], strict=True)
    a, b = a[same:], b[same:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail][LABEL] == b[-1 - tail][LABEL]:
        tail += 1
    ends = list(zip(a[len(a) - tail :], b[len(b) - tail :], strict=True))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    yield from (_longest if len(a) * len(b) <= _CELLS else _nearest)(a, b)
    yield from ends


def _longest(a: list[list], b: list[list]) -> Iterator[tuple[list | None, list | None]]:
    """By the longest common subsequence of labels."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][LABEL] == b[j][LABEL] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i][LABEL] == b[j][LABEL]:
            yield a[i], b[j]
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            yield a[i], None
            i += 1
        else:
            yield None, b[j]
            j += 1


def _nearest(a: list[list], b: list[list]) -> Iterator[tuple[list | None, list | None]]:
    """Each node with the next one of its label that is near enough."""
    j = 0
    for x in a:
        k = next((k for k in range(j, min(len(b), j + _NEAR)) if b[k][LABEL] == x[LABEL]), None)
        if k is None:
            yield x, None
        else:
            yield from ((None, y) for y in b[j:k])
            yield x, b[k]
            j = k + 1
    yield from ((None, y) for y in b[j:])


def merge(a: list, b: list) -> list:
    """Align two wrappers of one label: mismatches become optional groups."""
    children = []
    for x, y in _aligned(a[CHILDREN], b[CHILDREN]):
        if x is None or y is None:
            one = list(x or y)
            one[OPTIONAL] = True
            children.append(one)
        else:
            children.append(merge(x, y))
    node = [
        a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], sorted({*a[PAGES], *b[PAGES]})[:_CONTENTS],
        sorted({*a[HASHES], *b[HASHES]})[:_TEXTS], a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], children,
    ]
    _fold(node)
    return node


def expression(node: list) -> str:
    """The wrapper written as a union-free regular expression."""
    inner = ("#text " if node[CHARS] else "") + " ".join(map(expression, node[CHILDREN]))
    body = f"<{node[LABEL]}> {inner} </>" if inner else f"<{node[LABEL]}/>"
    return f"({body})+" if node[REPEATED] else f"({body})?" if node[OPTIONAL] else body


def _constant(node: list) -> bool:
    """A slot with one text on many pages of different contents is part of the template."""
    return len(node[PAGES]) >= _CONTENTS and len(node[HASHES]) == 1 and not node[REPEATED]


def _chrome(block: Block, inside: bool) -> bool:
    if block.hidden or block.name in _DROPPED or (block.name == "header" and not inside):
        return True
    return bool(block.chrome) and not (inside and block.chrome == "header")


def _is_main(block: Block) -> int:
    """How strongly an element claims to be the main container."""
    if block.name == "article" or "articlebody" in block.marks.lower().replace(" ", ""):
        return 3
    if block.name == "main" or re.search(r"(?:^|\s)main(?:\s|$)", block.marks, re.I):
        return 2
    return 1 if block.name in ("div", "section", "td") and block.marks and _MAIN.search(block.marks) else 0


def _measure(root: Block) -> None:
    """Set each block's claim and volume: characters below it without chrome and text in links, seen from outside and from inside a main container."""
    order, stack = [], [root]
    while stack:
        block = stack.pop()
        block.claim = _is_main(block)
        order.append(block)
        stack += block.children
    for block in reversed(order):
        own = max(0, sum(len(x) for x in block.items if isinstance(x, str)) - block.linked)
        block.volume = tuple(0 if _chrome(block, inside) else own + sum(c.volume[inside or block.claim > 0] for c in block.children) for inside in (False, True))


def _containers(root: Block) -> list[tuple[int, int, int, Block]]:
    """(strength, volume, -depth order, element) of the outermost elements that claim to be main."""
    out: list[tuple[int, int, int, Block]] = []
    stack = [root]
    while stack:
        block = stack.pop()
        if _chrome(block, False):
            continue
        if block.claim:
            out.append((block.claim, block.volume[1], -len(out), block))
            if block.claim == 3:
                continue
        stack += reversed(block.children)
    return out


def _main(root: Block) -> list[Block]:
    """The page's main containers; none where no element claims to be one.

    One article is the main container however short it is: what stands beside it has no claim. Of several,
    those count that have at least a quarter of the longest one's text; if they are alike and together
    short against another container, they are teasers, and that container counts. An element that claims
    by a name like content only counts where it has a quarter of the page's text.
    """
    found = [x for x in _containers(root) if x[1] > 0]
    articles = [x for x in found if x[0] == 3]
    rest = [x for x in found if x[0] == 2 or (x[0] == 1 and x[1] * 4 >= root.volume[0])]
    longest = max((x[1] for x in articles), default=0)
    articles = [x for x in articles if x[1] * 4 >= longest]
    if articles and (len(articles) == 1 or 4 * sum(x[1] for x in articles) >= max((x[1] for x in rest), default=0)):
        return [x[3] for x in articles]
    return [max(rest, key=lambda x: x[:3])[3]] if rest else [x[3] for x in articles]


def extract(page: str | None, wrapper: list | None = None) -> str:
    """The page's main text: blocks in page order, joined by blank lines."""
    if not page:
        return ""
    root = parse(page)
    found = _main(root)
    tops = found or [root]
    nodes = _nodes(root, wrapper)
    out: list[str] = []
    inside = bool(found)
    stack: list[str | Block] = list(reversed(tops))
    while stack:
        block = stack.pop()
        if isinstance(block, str):
            out.append(block)
        elif not _chrome(block, inside):
            node = nodes.get(id(block))
            fixed = not inside and node is not None and _constant(node)
            linked = not inside and node is not None and node[CHARS] and node[LINKED] * 2 > node[CHARS]
            stack += reversed([x for x in block.items if isinstance(x, Block) or not (fixed or linked)])
    return "\n\n".join(out)


def _nodes(root: Block, wrapper: list | None) -> dict[int, list]:
    """Which wrapper node each block of the page matches: labels in order, repeated nodes many times."""
    found: dict[int, list] = {}
    stack = [(root, wrapper)] if wrapper else []
    while stack:
        block, node = stack.pop()
        found[id(block)] = node
        at = 0
        for child in block.children:
            k = next((i for i in range(at, len(node[CHILDREN])) if node[CHILDREN][i][LABEL] == child.label), None)
            if k is not None:
                at = k
                stack.append((child, node[CHILDREN][k]))
    return found


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of one partition."""
    held: dict[str, list] = {}
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if page:
                own = tree(parse(page))
                held[host] = merge(held[host], own) if host in held else own
        if len(held) > _HOSTS:
            yield _written(held)
            held = {}
    yield _written(held)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host from its partial ones, which come in order."""
    name, whole = None, None
    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if whole is not None and host != name:
                yield _written({name: whole})
                whole = None
            own = json.loads(text)
            name, whole = host, merge(whole, own) if whole is not None else own
    if whole is not None:
        yield _written({name: whole})


def _written(held: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch(
        {"host": pa.array(held.keys(), pa.string()), "wrapper": pa.array([json.dumps(w, separators=(",", ":")) for w in held.values()], pa.string())}
    )


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper for every host of ``pages`` (url, html); partial wrappers are merged in one order, whichever comes first."""
    own = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_partial, "host string, wrapper string")
    return own.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_combined, "host string, wrapper string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = []
            for host, text, page in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "html")), strict=True):
                if text is not None and host not in known:
                    if len(known) > 256:
                        known.clear()
                    known[host] = json.loads(text)
                texts.append(extract(page, known.get(host)))
            yield pa.record_batch(
                {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    found = stored(wrappers(pages)).withColumnRenamed("host", "wrapper_host")
    if (found.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= WRAPPER_CHARS:
        found = F.broadcast(found)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(found, F.expr("host = wrapper_host"), "left")
    shape = pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.select("page_id", "url", "html", "host", "wrapper").mapInArrow(_read, shape)
