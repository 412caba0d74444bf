"""Main text of web pages by differencing pages of near URLs.

A page becomes a list of lines (blocks of text in page order). Each page is paired with
the page of its host whose URL (path and query) is nearest, the lines of both are aligned
by a longest common subsequence, and what they share is the site's and not the page's.
This is done for every page, with an article element or without.

A check by markup follows: of the page's own lines those in menus, headers, footers,
sidebars, notices, adverts, forms and comments go, and shared lines in an article or main
element come back, because hosts carry copies of one article and articles repeat short
lines. All other lines are as differencing left them, also those beside an article, such
as a title above it.

Pages are sorted by host and URL over range partitions and paired with a neighbour, so
no host has to fit one task. Only hashes of lines are shuffled.
"""

from __future__ import annotations

import html as htmllib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.frames import cut, small
from gondola.llm.hashing import slices

#: Pages that share more of their text (what markup doesn't drop) than this are copies of one page, from which nothing is learned.
COPY_SHARE = 0.8
#: A line with more of its text in links than this is a menu's.
LINK_SHARE = 0.5
#: Html handled at a time, in bytes.
HTML_BYTES = 1 << 20

MARKUP = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = {n: re.compile(f"</{n}(?=[\\s/>])", re.I) for n in ("script", "style", "textarea", "noscript", "iframe", "template", "title", "xmp")}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset(("article", "main"))
DROPPED = frozenset("head nav footer aside form button select option datalist fieldset legend dialog menu object canvas svg math audio video map".split())
#: Elements that a new paragraph, list item, row or cell ends.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of class and id that mark what is not the page's text; those of the second set only outside an article.
NOT_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond replies pagination pager toolbar skip copyright".split()
)
HEADER_WORDS = frozenset("header banner masthead topbar search widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: What markup says of a line.
DROP, KEEP, OPEN = range(3)


def _verdict(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's text is no page text; inside: it stands in an article."""
    if name in DROPPED or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body") or name in CONTENT and not inside:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words = WORDS.findall(value)
            if not NOT_TEXT.isdisjoint(words) or not inside and not HEADER_WORDS.isdisjoint(words):
                return True
        elif key == "role" and value.strip() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            return True
    return False


def lines(html: str) -> list[tuple[str, int]]:
    """The page's lines of text in order, each with DROP, KEEP or OPEN."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool]] = []  # open elements, and whether each drops its text
    dropped = content = links = 0
    text: list[str] = []
    linked = 0

    def done() -> None:
        nonlocal text, linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, DROP if dropped or not content and linked > LINK_SHARE * len(joined) else KEEP if content else OPEN))
        text, linked = [], 0

    def close(depth: int) -> None:
        nonlocal dropped, content, links
        while len(stack) > depth:
            name, drops = stack.pop()
            if name not in INLINE:
                done()
            dropped -= drops
            content -= name in CONTENT
            links -= name == "a"

    at = 0
    while at < len(html):
        m = MARKUP.search(html, at)
        raw = html[at : m.start()] if m else html[at:]
        if raw:
            piece = htmllib.unescape(raw) if "&" in raw else raw
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name not in INLINE:
                        close(depth)
                    else:  # misnested inline elements don't end blocks
                        _, drops = stack[depth]
                        if drops:
                            done()
                        del stack[depth]
                        dropped -= drops
                        links -= name == "a"
                    break
            else:
                if name not in INLINE:
                    done()
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = RAW[name].search(html, at)
            at = end.start() if end else len(html)
            if name not in INLINE:
                done()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            done()
            if stack and stack[-1][0] in CLOSED_BY.get(name, ()):
                close(len(stack) - 1)
            for depth in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph and its inline elements
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        if name in VOID or attributes.endswith("/") and name not in INLINE and name not in CONTENT and name != "div":
            continue
        drops = _verdict(name, attributes, content > 0)
        if drops:
            done()
        stack.append((name, drops))
        dropped += drops
        content += name in CONTENT
        links += name == "a"
    close(0)
    done()
    return out


def common(a: list, b: list) -> list[bool]:
    """Which elements of a are in one longest common subsequence with b.

    Halving with bit-parallel rows: time grows with the product of the lengths over the
    word size, memory with their sum.
    """
    hit = [False] * len(a)
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        hit[head] = True
        head += 1
    ta, tb = len(a), len(b)
    while ta > head and tb > head and a[ta - 1] == b[tb - 1]:
        ta, tb = ta - 1, tb - 1
        hit[ta] = True
    both = set(a[head:ta]) & set(b[head:tb])
    place = [i for i in range(head, ta) if a[i] in both]
    x, y = [a[i] for i in place], [v for v in b[head:tb] if v in both]
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            hit[place[a0]] |= x[a0] in y[b0:b1]
            continue
        mid = (a0 + a1) // 2
        ahead, back = _row(x[a0:mid], y[b0:b1]), _row(x[mid:a1][::-1], y[b0:b1][::-1])
        split = b0 + int(np.argmax(ahead + back[::-1]))
        todo += [(a0, mid, b0, split), (mid, a1, split, b1)]
    return hit


def _row(a: list, b: list) -> np.ndarray:
    """Lengths of longest common subsequences of a with b[:j], j = 0 to len(b)."""
    where: dict = {}
    for j, v in enumerate(b):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for v in a:
        same = row & where.get(v, 0)
        row = ((row + same) | (row - same)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def nearness(a: tuple, b: tuple) -> tuple[int, int]:
    """How near two (host, path) are: equal leading path segments, then equal leading characters; of different hosts (-1, -1)."""
    if a[0] != b[0] or not a[0]:
        return -1, -1
    x, y = a[1].split("/"), b[1].split("/")
    segments = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    chars = next((i for i, (p, q) in enumerate(zip(a[1], b[1], strict=False)) if p != q), min(len(a[1]), len(b[1])))
    return segments, chars


def _hashed(batches):
    """k, kinds (a byte a line), sizes and hashes of each page's lines."""
    for batch in batches:
        for part, raw in slices(batch, "_html", HTML_BYTES):
            cols = [[], [], []]
            for h in raw:
                found = lines(h.decode("utf-8", "replace"))
                cols[0].append(bytes(kind for _, kind in found))
                cols[1].append(np.array([len(t) for t, _ in found], "<i4").tobytes())
                cols[2].append(np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) for t, _ in found], "<u8").tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, pa.binary()) for c in cols)], ["k", "host", "path", "kinds", "sizes", "hashes"])


def _paired(batches):
    """k and other (the nearer of the neighbours in a sorted run of k, host, path); the run's first and last row come with place 0 and 1, host, path and how near their inner neighbour is."""
    part, kept, first, last = TaskContext.get().partitionId(), [], None, None
    names = ["part", "place", "k", "other", "host", "path", "segments", "chars"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    before, row = (-1, -1), None
    for batch in batches:
        out = []
        for new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            near = nearness(row[1:], new[1:]) if row else (-1, -1)
            if row:
                if kept:  # an inner row
                    other = kept[-1][0] if before >= near else new[0]
                    if max(before, near)[0] >= 0:
                        out.append((part, None, row[0], other, None, None, None, None))
                else:
                    first = (part, 0, row[0], new[0], *row[1:], *near)
                kept = [row]
            before, row = near, new
        if out:
            yield batch_of(out)
    if row:
        last = (part, 1, row[0], kept[-1][0] if kept else None, *row[1:], *before)
        yield batch_of([x for x in (first, last) if x])


def seams(ends: list[tuple]) -> list[tuple]:
    """k and other of the runs' first and last rows; ends: (part, place, k, other, host, path, segments, chars), sorted."""
    out = {}
    for i, e in enumerate(ends):
        best, other = (e[6], e[7]), e[3]
        for j in (i - 1, i + 1):
            if 0 <= j < len(ends) and ends[j][0] != e[0] and (near := nearness(e[4:6], ends[j][4:6])) > best:
                best, other = near, ends[j][2]
        if best[0] >= 0:
            out[e[2]] = other
    return sorted(out.items())


def nearest_pages(pages: DataFrame) -> DataFrame:
    """k and other, the page of the host with the nearest path; pages without another of their host have no row. pages: k, host, path, each k once.

    In the order of segments, not of characters ('-' and '.' sort before '/'), the nearest page is a neighbour.
    """
    spark = pages.sparkSession
    order = ("host", F.split("path", "/"), "k")
    ordered = pages.where("host <> ''").repartitionByRange(*order).sortWithinPartitions(*order).select("k", "host", "path")
    found = cut(ordered.mapInArrow(_paired, "part int, place int, k binary, other binary, host string, path string, segments int, chars int"), "paired")
    # two rows a partition at most
    ends = sorted((r["part"], r["place"], bytes(r["k"]), r["other"] and bytes(r["other"]), r["host"], r["path"], r["segments"], r["chars"]) for r in found.where("place is not null").collect())
    inner = found.where("place is null").select("k", "other")
    met = seams(ends)
    return inner.unionByName(spark.createDataFrame(met, "k binary, other binary")) if met else inner


def by_markup(kinds: np.ndarray) -> np.ndarray:
    """Which lines are text where nothing was learned from another page: those of articles, or without any all that are open."""
    return kinds == (KEEP if (kinds == KEEP).any() else OPEN)


def differenced(kinds: np.ndarray, sizes: np.ndarray, own: list, others: list) -> np.ndarray | None:
    """Which lines of a page are text: what it doesn't share with the other page, then checked by markup; None of a copy."""
    shared = np.array(common(own, others), bool)
    some = kinds != DROP
    if sizes[shared & some].sum() > COPY_SHARE * sizes[some].sum():
        return None
    return ~shared & some | (kinds == KEEP)


def _decided(batches):
    """k and _text, a byte for each line: 1 if it is text; only of pages where that differs from what markup says alone."""
    for batch in batches:
        rows = []
        for k, kinds, sizes, own, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kinds = np.frombuffer(kinds, np.uint8)
            text = differenced(kinds, np.frombuffer(sizes, "<i4"), np.frombuffer(own, "<u8").tolist(), np.frombuffer(others, "<u8").tolist())
            if text is not None and (text != by_markup(kinds)).any():
                rows.append((k, text.astype(np.uint8).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["k", "_text"])


def _texts(batches):
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("_html", "_text")] + ["text", "n_chars"]
        for part, raw in slices(batch, "_html", HTML_BYTES):
            texts = []
            for h, decided in zip(raw, part.column("_text").to_pylist(), strict=True):
                found = lines(h.decode("utf-8", "replace")) if h else []
                text = by_markup(np.array([kind for _, kind in found], np.uint8)) if decided is None else decided
                texts.append("\n\n".join(t for (t, _), kept in zip(found, text, strict=True) if kept))
            cols = [part.column(n) for n in names[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)


def extract(df: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of each row.

    Text is the page's main text: its blocks in order, white space within them made one blank, joined by an
    empty line. Null html is empty. Rows with one host and html are one page, at the least of its URLs, and get one text,
    so that no page is compared with its repetition at another URL. A page without another of its host, and one
    with COPY_SHARE of its text in the nearest page, from which nothing is learned, are judged by markup alone:
    the text of article or main elements, without them all that markup leaves.
    """
    place = F.coalesce(F.col(url), F.lit(""))
    known = place.contains("://")
    rest = [F.regexp_extract(place, r"(?s)^.*?://([^/?#]*)([^#]*)", i) for i in (1, 2)]
    host = F.when(known, F.translate(rest[0], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")
    key = F.unhex(F.md5(F.concat(F.hex(host), F.lit(" "), F.coalesce(F.col(html), F.lit("")))))
    full = df.select(*keep, key.alias("k"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    pages = df.select(key.alias("k"), host.alias("host"), F.when(known, rest[1]).otherwise("").alias("path"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    hashed = pages.where("host <> ''").mapInArrow(_hashed, "k binary, host string, path string, kinds binary, sizes binary, hashes binary")
    # rows of one host and html differ in their path only
    single = cut(hashed.groupBy("k").agg(F.first("host").alias("host"), F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("kinds", "sizes", "hashes"))), "pages")
    nearest = nearest_pages(single.select("k", "host", "path"))
    pairs = single.select("k", "kinds", "sizes", "hashes").join(nearest, "k").join(single.select(F.col("k").alias("other"), F.col("hashes").alias("others")), "other")
    decided = cut(pairs.select("k", "kinds", "sizes", "hashes", "others").mapInArrow(_decided, "k binary, _text binary"), "decided")
    joined = full.join(small(decided), "k", "left").drop("k")
    kinds = dict(df.dtypes)
    return joined.mapInArrow(_texts, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long")
