"""Main text of web pages, with nearest-URL page differencing.

A page is cut into text blocks (lines).  Blocks inside navigation, header, footer, aside,
form, advert, notice or comment elements go; of a page with an article or main element only
what lies in it is looked at.  The rest is compared with the nearest page of the same host:
pages are ordered by URL path within their host, the neighbour with the longer common path
prefix is taken, the two pages' lines are aligned by longest common subsequence, and shared
lines are template text and deleted.

A copy shares its content, so it is no neighbour: the neighbour on a side is the next page
there or, where that is a copy or near copy (NEAR_COPY), the neighbour which that page has on
the same side.  A page all of whose lines are shared keeps them.

Neighbours are chosen on digests of lines.  These are sorted in parts; what the pages at the
edges of a part have beyond it is worked out from the edges of all parts, so the result does
not depend on where a part ends.

Cases: null html or html without text gives the empty text; broken nesting is read as
written; repeated pages keep their text; a host with one page has no neighbour.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, maybe_among, pieces

#: Pages that share this much of the shorter one's text, in characters of whole lines, are copies.
NEAR_COPY = 0.8
#: Elements whose text never belongs to an article.
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select option textarea input iframe svg canvas object menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"))
#: Elements that begin and end a line of text.
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr fieldset center".split()) | DROPPED
_JUNK = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|widget|related|recommended|share|sharing|social|"
    r"comments?|comment-?list|replies|respond|disqus|login|signup|search|pagination|pager|skip-?link|toolbar|copyright|legal|disclaimer)(?=$|[\s_-])", re.I)
_JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s>/]*)[^>]*>|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
#: An open <p> ends where one of these begins.
_ENDS_P = BLOCK - frozenset(("html", "body"))


def _is_junk(tag: str, raw: str) -> bool:
    if tag in DROPPED:
        return True
    if not raw or raw.isspace():
        return False
    attrs = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(raw)}
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return attrs.get("role", "").lower() in _JUNK_ROLES or bool(_JUNK.search(attrs.get("class", ""))) or bool(_JUNK.search(attrs.get("id", "")))


def blocks(html: str | None) -> list[tuple[str, bool, bool]]:
    """(text, inside an article or main element, inside a dropped element) of each line."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool]] = []
    buffer: list[str] = []
    junk = article = at = 0
    html = html or ""

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            out.append((text, article > 0, junk > 0))

    def close(upto: int) -> None:
        nonlocal junk, article
        for tag, bad in stack[upto:]:
            junk -= bad
            article -= tag in ("article", "main")
        del stack[upto:]

    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            buffer.append(html[at:])
            break
        buffer.append(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break  # a stray inline end tag closes no block
        elif m[2]:
            tag = m[2].lower()
            if tag == "br":
                buffer.append(" ")
            if tag in BLOCK:
                flush()
                if tag in _ENDS_P:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            close(i)
                            break
                        if stack[i][0] in BLOCK:
                            break
            if tag in VOID or m[3].endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            bad = _is_junk(tag, m[3])
            stack.append((tag, bad))
            junk += bad
            article += tag in ("article", "main")
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions of `a` in a longest common subsequence of the two lists of lines
    (Hunt-Szymanski: work follows the number of equal pairs, not the product)."""
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    nodes: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[k], nodes[k] = j, node
    out, node = set(), nodes[-1] if nodes else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def candidates(own: list[tuple[str, bool, bool]]) -> list[int]:
    """Positions of the lines that may be main text."""
    kept = [i for i, x in enumerate(own) if not x[2]]
    return [i for i in kept if own[i][1]] or kept


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


class Page(NamedTuple):
    host: str
    path: str
    lines: np.ndarray  # hash of each line
    sizes: np.ndarray  # its characters; 0 if it is no candidate


def page_of(host: str, path: str, lines: bytes, sizes: bytes) -> Page:
    return Page(host, path, np.frombuffer(lines, dtype=np.int64), np.frombuffer(sizes, dtype=np.int32))


def near_copy(a: Page, b: Page) -> bool:
    x, y = a.sizes > 0, b.sizes > 0
    least = min(int(a.sizes.sum()), int(b.sizes.sum()))
    if not least:
        return True
    one, other = (a, b.lines[y]) if int(a.sizes.sum()) == least else (b, a.lines[x])
    return int(one.sizes[np.isin(one.lines, other)].sum()) >= NEAR_COPY * least


#: The neighbour of a page of which no non-copy lies on that side within its part.
OPEN = False


def step(state, page: Page):
    """(page, its neighbour) from the (page, neighbour) passed before; OPEN: not known here."""
    if state is None:
        return page, OPEN
    last, beyond = state
    if last.host != page.host:
        return page, None
    return page, beyond if near_copy(last, page) else last


def edge_states(edges: list[tuple[Page, Page, Page | None | bool]]) -> list:
    """State in front of each part, from every part's first page, last page and last
    neighbour, in walking order."""
    out, state = [], None
    for first, last, beyond in edges:
        out.append(state)
        if beyond is OPEN:
            beyond = step(state, first)[1]
        state = last, (None if beyond is OPEN else beyond)
    return out


def deleted(page: Page, left: Page | None, right: Page | None) -> list[int]:
    """Positions of the page's template lines."""
    near = [x for x in (left, right) if x is not None and not near_copy(x, page)]
    at = np.flatnonzero(page.sizes > 0).tolist()
    if not near or not at:
        return []
    other = max(near, key=lambda x: _prefix(x.path, page.path))
    shared = common_lines(page.lines.tolist(), other.lines.tolist())
    gone = [i for i in at if i in shared]
    return gone if len(gone) < len(at) else []


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], list[Page]]]:
    """(part, (page_id, key) of its rows, its pages) of rows sorted by part."""
    part, keys, held = None, [], []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("_part", "page_id", "_key", "_host", "_path", "_lines", "_sizes")]
        for n, i, k, *page in zip(*cols, strict=True):
            if n != part and held:
                yield part, keys, held
                keys, held = [], []
            part = n
            keys.append((i, k))
            held.append(page_of(*page))
    if held:
        yield part, keys, held


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars.  Pages are dealt out in (host, path) order, so a host of
    any size spreads over tasks."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    # rows of one id and key are equal, and so are their texts
    rows = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("_key"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                lines, sizes = [], []
                for html in part.column("html").to_pylist():
                    own = blocks(html)
                    size = np.zeros(len(own), dtype=np.int32)
                    for i in candidates(own):
                        size[i] = len(own[i][0])
                    lines.append(b"".join(xxhash.xxh64_digest(t.encode("utf-8", "surrogatepass")) for t, _, _ in own))
                    sizes.append(size.tobytes())
                cols = [part.column(c) for c in ("page_id", "url", "_key", "_host", "_path")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.binary()), pa.array(sizes, pa.binary())], names=names)

    names = ["page_id", "url", "_key", "_host", "_path", "_lines", "_sizes"]
    order = ["_host", "_path", "page_id", "url", "_key"]
    lines = rows.select("page_id", "url", "_key", host.alias("_host"), path.alias("_path"), "html").mapInArrow(
        digest, f"page_id {kind}, url string, _key long, _host string, _path string, _lines binary, _sizes binary")
    lines = materialise(lines)
    lines = materialise(lines.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    lines = lines.repartition("_part").sortWithinPartitions("_part", *order).drop("url")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, held in _parts(batches):
            out = []
            for forward, walk in ((True, held), (False, held[::-1])):
                state = None
                for page in walk:
                    state = step(state, page)
                out.append((part, forward, pickle.dumps((walk[0], walk[-1], state[1]))))
            a, b, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.bool_()), pa.array(c, pa.binary())], names=["part", "forward", "edge"])

    found = lines.mapInArrow(edges, "part int, forward boolean, edge binary").collect()
    before: dict[tuple[int, bool], object] = {}
    for forward in (True, False):
        some = sorted((r for r in found if r.forward is forward), key=lambda r: r.part, reverse=not forward)
        states = edge_states([pickle.loads(r.edge) for r in some])
        before.update({(r.part, forward): s for r, s in zip(some, states, strict=True)})
    shared = pages.sparkSession.sparkContext.broadcast(before)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, held in _parts(batches):
            beside = []
            for forward, walk in ((True, held), (False, held[::-1])):
                state, some = shared.value[part, forward], []
                for page in walk:
                    state = step(state, page)
                    some.append(None if state[1] is OPEN else state[1])
                    state = state[0], some[-1]
                beside.append(some if forward else some[::-1])
            gone = [deleted(*x) for x in zip(held, *beside, strict=True)]
            out = [(i, k, g) for (i, k), g in zip(keys, gone, strict=True) if g]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, id_type), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int32()))], names=["_id", "_k", "_gone"])

    id_type = to_arrow_type(pages.schema["page_id"].dataType)
    gone = materialise(lines.mapInArrow(choose, f"_id {kind}, _k long, _gone array<int>").dropDuplicates(["_id", "_k"]))

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                texts = []
                for html, drop in zip(part.column("html").to_pylist(), part.column("_gone").to_pylist(), strict=True):
                    own, drop = blocks(html), set(drop or ())
                    texts.append("\n\n".join(own[i][0] for i in candidates(own) if i not in drop))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    # pages that lose no line need not cross the network
    marked = maybe_among(rows, gone, "_key", "_k")
    some = marked.where("_maybe").join(gone, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left")
    none = marked.where("NOT _maybe").withColumn("_gone", F.lit(None).cast("array<int>"))
    schema = pages.select("page_id").schema.add("url", "string").add("text", "string").add("n_chars", "long")
    return some.select("page_id", "url", "html", "_gone").unionByName(none.select("page_id", "url", "html", "_gone")).mapInArrow(text, schema)
