"""Main texts of web pages by wrappers inferred for every host.

A page becomes a tree of blocks with text slots; inline markup is transparent. Blocks of one kind that
follow each other fold into a repeated group. The pages of a host are aligned one after the other: what both sides have
stays, what only one has becomes optional, differing texts become slots. The outcome is a regular expression without
unions over the host's token streams, such as ``nav(ul(li(#)+)) div.ad(#)? article(h1(#) p(#)+)``. Slots carry sums over all
pages (texts, characters, characters in links, whether the text ever differs), by which the wrapper tells the slots
of the main text; a page's texts are then read off by aligning it with the wrapper.

Wrappers merge in any order: each task merges its own pages first, then a few tasks per host, then one. Trees of any depth
are walked without recursion, and the work on a page grows with its size whatever its markup.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Generator, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lorekeep.llm.common import map_rows
from lorekeep.session import materialise

# Bytes of wrappers that may be broadcast.
BROADCAST_BYTES = 16 << 20
# Tasks that merge the wrappers of a host before the last.
SALTS = 32
# A slot without a content root is boilerplate if its text never differs on so many pages.
CONSTANT_PAGES = 3
# Rows of an alignment that are kept; those between are computed again when the alignment is read off.
ROWS_KEPT = 256
# A tag whose quotes do not close ends at the next ">".
_TOKEN = re.compile(
    r"<!--|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)"
    r"((?:(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+(?=>))|[^>]*)>"
)
_RAW = frozenset("script style noscript template textarea svg iframe title".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_BREAKS = frozenset(("br", "hr"))
# Elements that end an open element of the same kind, or a paragraph.
_SIBLINGS = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
             "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NO_PARAGRAPH = frozenset(
    "article section div ul ol dl table h1 h2 h3 h4 h5 h6 p pre blockquote nav header footer aside form main".split()
)
_NOISE_TAGS = frozenset("head nav footer aside form menu dialog button select input".split())
_ROOT_TAGS = frozenset(("article", "main"))
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# Parts of class names and ids: fixed values.
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe signup login share sharing social related recommended sidebar side widget "
    "breadcrumb breadcrumbs menu nav navbar navigation topbar footer header masthead comment comments reply replies "
    "respond discussion disqus pagination pager toc tags skip hidden".split()
)
# Those that also say how a page around the main text is laid out ("with-sidebar"): fixed values.
_LAYOUT_WORDS = frozenset("sidebar side header footer nav navbar menu topbar masthead widget breadcrumb breadcrumbs".split())
# Those that inside the main text name the block of its title: fixed values.
_TITLE_WORDS = frozenset(("header", "masthead"))
_ROOT_WORDS = frozenset("article content main post entry story body".split())
_ATTRIBUTES = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = re.compile(r"[^a-z]+")


def _kind(tag: str, attributes: str) -> str:
    """Tag with the names that tell what a block is for; digits in names differ by page and are left out."""
    if not attributes or attributes.isspace():
        return tag
    names = []
    for name, *values in _ATTRIBUTES.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            names += [part for part in re.sub(r"[0-9]+", "", value).split() if part]
        elif name == "role":
            names.append("role=" + value)
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            names.append("hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        names.append("hidden")
    return ".".join([tag, *sorted(set(names))])


def page_tree(html: str | None) -> list:
    """``[kind, children]``; a child is a tree or a text ``["#", text, characters in links]``."""
    root: list = ["page", []]
    stack = [root]
    tags_open = ["page"]
    count: Counter[str] = Counter()
    buffer: list[str] = []
    links, in_link = 0, 0
    html = html or ""

    def close_text() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(buffer)).split())
        if text:
            stack[-1][1].append(["#", text, links])
        buffer.clear()
        links = 0

    def close(tags: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        if not any(count[tag] for tag in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = tags_open[depth]
            if name in tags:
                close_text()
                count.subtract(tags_open[depth:])
                del stack[depth:], tags_open[depth:]
                return
            if name in stop:
                return

    last = html.rfind(">") + 1
    at = 0
    while True:
        found = _TOKEN.search(html, at, last) if at < last else None
        start = found.start() if found else html.find("<!--", at)
        text = html[at : start if start >= 0 else len(html)]
        if text:
            buffer.append(text)
            if in_link:
                links += len(text)
        if not found:
            break
        at = found.end()
        if found.group() == "<!--":
            end = html.find("-->", at)
            at = end + 3 if end >= 0 else len(html)
            continue
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW and not closing:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in _INLINE:
            continue
        if tag in _BREAKS:
            buffer.append(" ")
            continue
        if tag in _VOID:
            continue
        if closing:
            close((tag,))
            close_text()
            continue
        if tag in _NO_PARAGRAPH:
            close(("p",), ("td", "th", "li", "div", "article", "section", "body"))
        if tag in _SIBLINGS:
            close(_SIBLINGS[tag], ("ul", "ol", "dl", "table"))
        close_text()
        node = [_kind(tag, attributes.rstrip("/")), []]
        stack[-1][1].append(node)
        stack.append(node)
        tags_open.append(tag)
        count[tag] += 1
    close_text()
    return root


# A wrapper is ``[kind, quantifier, children]``, a slot ``["#", quantifier, [pages, characters, in links, low, high]]``, where low
# and high are the smallest and largest hash of what pages have there.


def _walk(call: Generator):
    """The result of a recursive function written as a generator, which yields its inner calls."""
    calls, value = [call], None
    while calls:
        try:
            inner = calls[-1].send(value)
        except StopIteration as end:
            calls.pop()
            value = end.value
        else:
            calls.append(inner)
            value = None
    return value


def folded(node: list) -> list:
    """The wrapper of a single page: neighbours of one kind are a repeated group."""
    return _walk(_fold(node))


def _fold(node: list) -> Generator:
    children: list = []
    for child in node[1]:
        if child[0] == "#":
            name = zlib.crc32(child[1].encode())
            part = ["#", "", [1, len(child[1]), child[2], name, name]]
        else:
            part = yield _fold(child)
        if children and children[-1][0] == part[0]:
            children[-1] = yield _join(children[-1], part, "+")
        else:
            children.append(part)
    return [node[0], "", children]


def _either(one: str, two: str) -> str:
    """The weaker of two quantifiers: "" once, "?" at most once, "+" at least once, "*" any number."""
    optional, repeated = {"?", "*"} & {one, two}, {"+", "*"} & {one, two}
    return "*" if optional and repeated else "?" if optional else "+" if repeated else ""


def joined(one: list, two: list) -> list:
    """The wrappers of two sets of pages as one."""
    return _walk(_join(one, two))


def _join(one: list, two: list, quantifier: str = "") -> Generator:
    """Two parts of one kind as one; with "+" they follow each other on a page."""
    quantifier = _either(_either(one[1], two[1]), quantifier)
    if one[0] == "#":
        a, b = one[2], two[2]
        pages = max(a[0], b[0]) if "+" == quantifier and a[0] == b[0] == 1 else a[0] + b[0]
        return ["#", quantifier, [pages, a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])]]
    return [one[0], quantifier, (yield _align(one[2], two[2]))]


def _pairs(one: list, two: list) -> Iterator[tuple[int | None, int | None]]:
    """A longest common subsequence of kinds, with what stands between, in order.

    A row of the table is one integer with a bit per part of ``one``: bit k is 0 where the k + 1 last parts have a longer
    common subsequence with the parts of ``two`` from the row on than the k last.
    """
    kinds, others = [part[0] for part in one], [part[0] for part in two]
    head = 0
    while head < min(len(kinds), len(others)) and kinds[head] == others[head]:
        yield head, head
        head += 1
    kinds, others = kinds[head:], others[head:]
    n, m = len(kinds), len(others)
    full = (1 << n) - 1
    places: dict[str, int] = {}
    for at, kind in enumerate(reversed(kinds)):
        places[kind] = places.get(kind, 0) | 1 << at

    def after(row: int, kind: str) -> int:
        same = row & places.get(kind, 0)
        return (row + same | row - same) & full

    # kept[k]: the row of the k * ROWS_KEPT last parts of ``two``.
    kept, row = [full], full
    for at in range(1, m + 1):
        row = after(row, others[m - at])
        if at % ROWS_KEPT == 0:
            kept.append(row)
    rows: list[int] = []
    block = -1
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and kinds[i] == others[j]:
            yield head + i, head + j
            i, j = i + 1, j + 1
            continue
        if i < n and j < m:
            if (m - j) // ROWS_KEPT != block:
                block = (m - j) // ROWS_KEPT
                rows = [kept[block]]
                for at in range(block * ROWS_KEPT + 1, min(m, (block + 1) * ROWS_KEPT - 1) + 1):
                    rows.append(after(rows[-1], others[m - at]))
            without_i = rows[(m - j) % ROWS_KEPT] >> n - i - 1 & 1
        if j == m or (i < n and without_i):
            yield head + i, None
            i += 1
        else:
            yield None, head + j
            j += 1


def _optional(part: list) -> list:
    return [part[0], _either(part[1], "?"), part[2]]


def _align(one: list, two: list) -> Generator:
    """Both sequences as one: what only one has is optional; equal neighbours that arise are a repeated group."""
    out: list = []
    for i, j in _pairs(one, two):
        if i is None or j is None:
            part = _optional(two[j] if i is None else one[i])
        else:
            part = yield _join(one[i], two[j])
        if out and out[-1][0] == part[0]:
            out[-1] = yield _join(out[-1], part, "+")
        else:
            out.append(part)
    return out


def packed(wrapper: list) -> str:
    """The wrapper as JSON: its parts in order, each with the number of parts below it or the sums of its slot."""
    found: list = []
    open_parts = [wrapper]
    while open_parts:
        part = open_parts.pop()
        if part[0] == "#":
            found.append(part)
        else:
            found.append([part[0], part[1], len(part[2])])
            open_parts += reversed(part[2])
    return json.dumps(found, separators=(",", ":"))


def unpacked(text: str) -> list:
    """The wrapper that ``packed`` wrote."""
    top: list = ["", "", []]
    open_parts = [(top, 1)]
    for kind, quantifier, below in json.loads(text):
        while open_parts[-1][1] == len(open_parts[-1][0][2]):
            open_parts.pop()
        part = [kind, quantifier, below if kind == "#" else []]
        open_parts[-1][0][2].append(part)
        if kind != "#":
            open_parts.append((part, below))
    return top[2][0]


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression, for reading."""

    def read(part: list) -> Generator:
        if part[0] == "#":
            return "#" + part[1]
        inner = []
        for child in part[2]:
            inner.append((yield read(child)))
        return f"{part[0]}({' '.join(inner)}){part[1]}"

    return _walk(read(wrapper))


def _names(kind: str) -> tuple[str, set[str], set[str]]:
    """Tag, words in names, roles."""
    tag, *names = kind.split(".")
    roles = {name[5:] for name in names if name.startswith("role=")}
    words = {word for name in names if not name.startswith("role=") for word in _SPLIT.split(name)}
    return tag, words, roles


def _noise(kind: str, in_root: bool) -> str:
    """"": no noise. "named": noise by names that may also tell how the page around the main text is laid out. "noise": noise."""
    tag, words, roles = _names(kind)
    # A header inside an article holds its title; one of the page does not.
    if tag in _NOISE_TAGS or (tag == "header" and not in_root) or roles & _NOISE_ROLES:
        return "noise"
    found = words & _NOISE_WORDS
    if tag in ("html", "body"):
        return ""
    if in_root:
        return "noise" if found - _TITLE_WORDS else ""
    return "noise" if found - _LAYOUT_WORDS else "named" if found else ""


def _is_root(kind: str) -> bool:
    tag, words, roles = _names(kind)
    return tag in _ROOT_TAGS or "main" in roles or (tag in ("div", "section", "td") and bool(words & _ROOT_WORDS))


# Verdicts on slots, from the strongest: in a root with no noise around it, in a root below an element that is noise only
# by its name, in no root but neither constant nor made of links.
IN_ROOT, IN_NAMED, VARIES = 1, 2, 4


def marked(wrapper: list) -> list:
    """The wrapper with verdicts in place of each slot's sums, 0 for slots that are never main text."""

    def mark(part: list, root: bool, named: bool, noise: bool) -> Generator:
        if part[0] == "#":
            pages, chars, links, low, high = part[2]
            boilerplate = (pages >= CONSTANT_PAGES and low == high) or 2 * links > chars
            verdict = IN_ROOT if root and not named else IN_NAMED if root else 0
            if not named and not boilerplate:
                verdict |= VARIES
            return ["#", part[1], 0 if noise else verdict]
        found = _noise(part[0], root)
        noise = noise or found == "noise"
        named = named or found == "named"
        root = root or _is_root(part[0])
        children = []
        for child in part[2]:
            children.append((yield mark(child, root, named, noise)))
        return [part[0], part[1], children]

    return _walk(mark(wrapper, False, False, False))


def main_text(page: list, wrapper: list) -> str:
    """The texts of the page's main slots, in order, joined by one space.

    Main slots are those of the strongest verdict that any text of the page has: a page without an article is
    read by the wrapper's sums, whatever other pages of its host hold.
    """
    found: list[tuple[int, str]] = []

    def read(nodes: list, parts: list) -> Generator:
        # Repeated groups stand for any number of neighbours: these are one item of the alignment.
        groups: list[list] = []
        for node in nodes:
            if groups and groups[-1][0] == node[0]:
                groups[-1][1].append(node)
            else:
                groups.append([node[0], [node]])
        place = {j: i for i, j in _pairs(parts, groups) if i is not None and j is not None}
        by_kind = {part[0]: part for part in reversed(parts)}
        for j, (kind, members) in enumerate(groups):
            # The wrapper knows every kind of its pages here; one that was folded elsewhere is looked up by kind.
            part = parts[place[j]] if j in place else by_kind.get(kind)
            if part is None:
                continue
            for node in members:
                if kind == "#":
                    found.append((part[2], node[1]))
                else:
                    yield read(node[1], part[2])

    _walk(read(page[1], wrapper[2]))
    for verdict in (IN_ROOT, IN_NAMED, VARIES):
        texts = [text for verdicts, text in found if verdicts & verdict]
        if texts:
            return " ".join(texts)
    return ""


def host_of(url: str = "url") -> Column:
    """The host of an address; what has none, malformed ones too, is a host named by itself."""
    found = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.coalesce(F.when(found != "", found), F.col(url), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper, marks``: the wrapper of every host over all its pages, as JSON; checkpointed."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        found: dict[str, list] = {}
        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                tree = folded(page_tree(page))
                found[name] = joined(found[name], tree) if name in found else tree
        for name, tree in found.items():
            yield pa.RecordBatch.from_pydict(
                {"host": [name], "salt": pa.array([salt], pa.int32()), "wrapper": [packed(tree)]}
            )

    def combined(table: pa.Table) -> list:
        first, *rest = map(unpacked, sorted(table.column("wrapper").to_pylist()))
        for other in rest:
            first = joined(first, other)
        return first

    def some(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).set_column(2, "wrapper", pa.array([packed(combined(table))]))

    def last(table: pa.Table) -> pa.Table:
        tree = combined(table)
        marks = packed(marked(tree))
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": [packed(tree)], "marks": [marks]})

    schema = "host string, salt int, wrapper string"
    parts = pages.select(host_of().alias("host"), "html").mapInArrow(partial, schema)
    parts = parts.groupBy("host", "salt").applyInArrow(some, schema)
    return materialise(parts.groupBy("host").applyInArrow(last, "host string, wrapper string, marks string"))


@lru_cache(maxsize=256)
def _loaded(marks: str) -> list:
    return unpacked(marks)


def extract_main(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages`` (``page_id, url, html``).

    Null and empty pages give the empty text. A null or malformed address is a host named by itself. Rows that
    repeat give rows that repeat. Empty input gives no rows. Other columns are left behind.
    """
    found = wrappers(pages).select("host", "marks")
    size = found.agg(F.sum(F.length("marks"))).first()[0] or 0
    side = F.broadcast(found) if size <= BROADCAST_BYTES else found
    joined = pages.select("page_id", "url", "html", host_of().alias("host")).join(side, "host")

    def step(batch: pa.RecordBatch):
        rows = zip(batch.column("html").to_pylist(), batch.column("marks").to_pylist())
        texts = [main_text(page_tree(page), _loaded(marks)) for page, marks in rows]
        yield {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "text": texts,
            "n_chars": [len(text) for text in texts],
        }

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(joined, f"page_id {kind}, url string, text string, n_chars long", step)
