"""Collocations, page text and tokenizer alignment against plain versions."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from gondola.llm import alignment, doublearray, pagetext, phrases
from tests.llm.fixtures import SCHEMA, rows

SMALL = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# tries


def test_trie_finds_exactly_its_keys():
    r = random.Random(2)
    word = lambda: bytes(r.choice(b"abcdez\xff\x00") for _ in range(r.randint(1, 5)))
    for _ in range(100):
        roots = r.randint(1, 4)
        keys = sorted({(r.randint(0, roots - 1), word()) for _ in range(r.randint(1, 200))})
        size = np.array([len(k[1]) for k in keys])
        trie = doublearray.build(np.array([k[0] for k in keys]), np.frombuffer(b"".join(k[1] for k in keys), np.uint8), np.cumsum(size) - size, size, roots)
        number = {k: i for i, k in enumerate(keys)}
        for root, text in [*keys, *((r.randint(0, roots - 1), word()) for _ in range(100))]:
            state, base, found = -(root + 2), trie["root_base"][root], -1
            for i, b in enumerate(text):
                slot = base + b
                if trie["check"][slot] != state:
                    break
                state, base = slot, trie["base"][slot]
                found = trie["value"][slot] if i + 1 == len(text) else -1
            assert found == number.get((root, text), -1)


# collocations


def plain_collocations(docs, least=10, absorbed=50, best=2000):
    by_lang: dict = {}
    for lang, text in docs:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        by_lang.setdefault(lang or "und" if lang is None else lang, []).extend([w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low))
    out = []
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(c for x, c in f.items() if len(x) == 1)
        cands = {x: a for x, a in f.items() if len(x) > 1 and a >= least}
        most: dict = {}
        for x, a in cands.items():
            if len(x) == 3:
                for y in (x[:2], x[1:]):
                    most[y] = max(most.get(y, 0), a)
        found = []
        for x, a in cands.items():
            if len(x) == 2 and 100 * most.get(x, 0) >= absorbed * a and x in most:
                continue
            score, _, left, right = min((1000000 * a * a // (f[x[:k]] * f[x[k:]]), k, f[x[:k]], f[x[k:]]) for k in range(1, len(x)))
            found.append((-score, -a, " ".join(x).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return out


def collocations(spark, docs, **settings):
    df = spark.createDataFrame(docs, "lang string, text string")
    return [tuple(r) for r in phrases.collocations(df, **settings).collect()]


def test_collocations_agree_with_plain_counts(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["lang", "text"])
    docs = list(zip(*(c.to_pylist() for c in table.columns), strict=True))
    assert sorted(collocations(spark, docs)) == sorted(plain_collocations(docs))
    assert sorted(collocations(spark, docs, least=3, best=40)) == sorted(plain_collocations(docs, least=3, best=40))


def test_collocations_over_several_tries_and_rounds(spark, monkeypatch):
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["lang", "text"])
    docs = list(zip(*(c.to_pylist() for c in table.columns), strict=True))
    for name, value in (("PART_ROWS", 150), ("ROUND_BYTES", 40_000), ("HELD", 1 << 10), ("TEXT_BYTES", 1 << 14)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(collocations(spark, docs)) == sorted(plain_collocations(docs))


def test_collocations_of_odd_texts(spark):
    docs = [("en", "A b\tc A b  c, a b; a.B" * 30), ("en", None), (None, "x y z " * 20), ("", "p q " * 12), ("en", ""), ("de", "only few words"), ("en", "ä Ä ä Ä " * 12), ("en", "w" * 70_000 + " end"), ("en", "o \x00 p " * 12)]
    assert sorted(collocations(spark, docs)) == sorted(plain_collocations(docs))
    assert collocations(spark, docs[:0]) == [] and collocations(spark, [("en", None)]) == []
    clash = spark.createDataFrame(rows(), SCHEMA)
    assert sorted(tuple(r) for r in phrases.collocations(clash).collect()) == sorted(plain_collocations([(r[2], r[1]) for r in rows()]))


def test_score_passes_64_bits(spark):
    got = spark.range(1).select(phrases._score(*(phrases.F.lit(x) for x in (900_000_000_000, 900_000_000_001, 999_999_999_999)))).first()[0]
    assert got == 1000000 * 900_000_000_000**2 // (900_000_000_001 * 999_999_999_999)


# page text


def test_text_of_articles(spark):
    table = pq.read_table("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r for r in pagetext.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for page_id, url, page in zip(*(table.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(b for b in blocks if b)
        assert (found[page_id]["url"], found[page_id]["text"], found[page_id]["n_chars"]) == (url, want, len(want))


def page(body: str) -> str:
    return f"<html><head><title>t</title></head><body><div>Our Site &amp; Co</div>{body}<div>All rights kept.</div><div>Call us</div></body>"


def test_pages_without_an_article_lose_what_the_nearest_page_shares(spark):
    pages = [
        (1, "http://A.example/x/1", page("<p>First page's own words.<p>Shared tip")),
        (2, "http://a.example/x/2", page("<p>Second page's own words, more of them.<p>Shared tip")),
        (3, "http://a.example/y/deep/3", page("<p>Third one stands alone in its folder with a long text.</p>")),
        (4, "http://b.example/x/1", page("<p>Another host, no other page.</p>")),
        (5, "http://b.example/x/1", page("<p>Another host, no other page.</p>")),  # the same page again
        (6, None, page("<p>No url</p>")),
        (7, "http://c.example/1", None),
        (8, "http://c.example/2", ""),
        (9, "http://d.example/1", page("<p>Copied text of some length here.</p><!--1-->")),
        (10, "http://d.example/2", page("<p>Copied text of some length here.</p><!--2-->")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    site = ["Our Site & Co", "All rights kept.", "Call us"]
    whole = lambda *own: "\n\n".join([site[0], *own, *site[1:]])
    for parts in (1, 3):
        got = {r["page_id"]: r["text"] for r in pagetext.extract(df.repartition(parts)).collect()}
        assert got[1] == "First page's own words." and got[2] == "Second page's own words, more of them."
        assert got[3] == "Third one stands alone in its folder with a long text."
        assert got[4] == got[5] == whole("Another host, no other page.")
        assert got[6] == whole("No url") and got[7] == got[8] == ""
        assert got[9] == got[10] == whole("Copied text of some length here.")
    assert pagetext.extract(df.limit(0)).count() == 0


def test_differencing_decides_beside_articles_too(spark):
    story = lambda n: f"<h1>Title {n} of the day</h1><div>A lead of its own, {n}.</div><article><p>Story number {n} with its words.</p><p>Read on.</p></article>"
    pages = [
        (1, "http://a.example/1", page(story(1))),
        (2, "http://a.example/2", page(story(2) + "<div class=ad>Own advert</div><div class=comments><p>Own reply</p></div>")),
        (3, "http://b.example/1", page(story(3))),  # no other page of its host
        (4, "http://c.example/1", page("<div>Tag 4</div><article><p>One article that two pages of the host carry.</p></article>")),
        (5, "http://c.example/2", page("<div>Tag 5</div><article><p>One article that two pages of the host carry.</p></article>")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pagetext.extract(df).collect()}
    for n in (1, 2):
        assert got[n] == f"Title {n} of the day\n\nA lead of its own, {n}.\n\nStory number {n} with its words.\n\nRead on."
    assert got[3] == "Story number 3 with its words.\n\nRead on."
    assert got[4] == got[5] == "One article that two pages of the host carry."


def test_pages_of_one_path_are_paired_by_query(spark):
    ids = (100, 101, 500, 501, 900, 901)
    body = lambda n: page(f"<div>Section {n // 100} of the site</div><p>Words of the page with number {n} and no other.</p>")
    df = spark.createDataFrame([(n, f"http://a.example/index.php?id={n}#top", body(n)) for n in ids], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pagetext.extract(df).collect()}
    assert got == {n: f"Words of the page with number {n} and no other." for n in ids}


def test_a_page_is_not_compared_with_its_repetition(spark):
    one, two = page("<p>Words of the first page."), page("<p>The second page has others.")
    urls = [("http://a.example/x/1", one), ("https://a.example/x/1", one), ("http://a.example/x/1?from=feed", one), ("http://a.example/x/2", two), ("http://a.example/z", two), (None, one)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(urls)], "page_id long, url string, html string")
    got = [r["text"] for r in sorted(pagetext.extract(df).collect())]
    assert got == ["Words of the first page."] * 3 + ["The second page has others."] * 2 + ["Our Site & Co\n\nWords of the first page.\n\nAll rights kept.\n\nCall us"]


def test_pairs_are_nearest_where_signs_sort_before_slashes(spark):
    r = random.Random(8)
    paths = sorted({"/" + "".join(r.choice("ab-./?%") for _ in range(r.randint(0, 7))) for _ in range(300)} | {"/x", "/x-1", "/x.html", "/x/1"})
    data = [(i.to_bytes(2, "big"), "h", p) for i, p in enumerate(paths)]
    found = {bytes(x["k"]): bytes(x["other"]) for x in pagetext.nearest_pages(spark.createDataFrame(data, "k binary, host string, path string")).collect()}
    by = {d[0]: d[1:] for d in data}
    assert set(found) == set(by)
    for k, other in found.items():
        assert pagetext.nearness(by[k], by[other]) == max(pagetext.nearness(by[k], by[o]) for o in by if o != k)


def test_pairs_are_nearest_over_any_partitioning(spark):
    r = random.Random(5)
    keys = sorted({(r.choice("ab"), "/" + "/".join(r.choice(["x", "y", "zz"]) for _ in range(r.randint(0, 4)))) for _ in range(60)})
    data = [(i.to_bytes(2, "big"), *k) for i, k in enumerate(keys)] + [(b"zz", "alone", "/")]
    near = lambda a, b: pagetext.nearness(a[1:], b[1:])
    for parts in ("1", "5", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {bytes(x["k"]): bytes(x["other"]) for x in pagetext.nearest_pages(spark.createDataFrame(data, "k binary, host string, path string")).collect()}
        by = {d[0]: d for d in data}
        assert set(found) == {d[0] for d in data[:-1]}
        for k, other in found.items():
            assert near(by[k], by[other])[0] == max(near(by[k], d)[0] for d in data if d[0] != k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_common_is_longest():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        kept = [x for x, k in zip(a, pagetext.common(a, b), strict=True) if k]
        it = iter(b)
        assert len(kept) == n[-1][-1] and all(x in it for x in kept)


@pytest.mark.parametrize(
    "given, want",
    [
        ("<p>A <b>bo</b>ld\n <i>x</i><br>y<p>B&nbsp;c &lt;x&gt; &#233; a < b", ["A bold x y", "B c <x> é a < b"]),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", ["one", "two", "x", "y"]),
        ("<nav>n</nav><header>h</header><div class='cookie-notice'>c</div><aside>s</aside><form>f</form>t<footer>f</footer>", ["t"]),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p title='a>b'>yes", ["yes"]),
        ("<main><p>m</main><div>out</div><section id=comments><article>reply</article></section>", ["m", "out"]),
        ("<div class=menu><a href=x>m</a></div><p><a href=y>all linked</a></p><p>half <a>x</a>", ["half x"]),
        ("<p>cut off <a href='x", ["cut off"]),
        ("", []),
    ],
)
def test_lines(given, want):
    assert [t for t, kind in pagetext.lines(given) if kind != pagetext.DROP] == want


def test_a_very_long_page():
    text = "".join(f"<p>line {i} of many</p>" for i in range(60_000))
    found = pagetext.lines(text)
    assert len(found) == 60_000 and sum(pagetext.common([t for t, _ in found], [t for t, _ in found[::2]])) == 30_000


# alignment


def plain_alignment(aligner, text):
    """Counts, digest and links of one text from the libraries' ids of the whole text alone."""
    if not text:
        return (0, 0, 0, 0, ""), {}
    raw = (" " + text).encode()
    ids = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    ends = []
    for side, table in zip(ids, (aligner.a_bytes, aligner.b_bytes), strict=True):
        if b"".join(table[i] for i in side) != raw:
            return (0, 0, 0, 0, ""), {}
        ends.append(np.cumsum([len(table[i]) for i in side]).tolist())
    groups, links, i, j = [], Counter(), 0, 0
    for at in sorted(set(ends[0]) & set(ends[1])):
        a, b = [], []
        while i < len(ids[0]) and ends[0][i] <= at:
            a.append(ids[0][i])
            i += 1
        while j < len(ids[1]) and ends[1][j] <= at:
            b.append(ids[1][j])
            j += 1
        groups.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        links.update((x, y) for x in a for y in b)
    return (len(ids[0]), len(ids[1]), len(groups), links.total(), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def plain_rows(aligner, docs):
    found = [(d, *plain_alignment(aligner, t)) for d, t in docs]
    count = Counter(p for _, _, links in found for p in links)
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return sorted((str(d), *c[:4], sum(k for p, k in links.items() if count[p] == most[p[0]]), sum(k * count[p] for p, k in links.items()), c[4]) for d, c, links in found)


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*PATHS)


ODD = [" ", "  ", "   a  b ", "\n", "a\n b", "a　 b", "x▁y", "🙂🙂 🧿🧿 é̂", "<s> </s> <unk> <0x41> <|endoftext|> x", " lead", "trail ", "\0 a\0", "\x85 b", "\x1c d", "don't we'll 's", "中文字 漢字" * 30, "a" * 3000 + " " + "=" * 999, "﻿ b ​ c", "\r\n\r\n  x"]


def test_units_give_the_tokens_of_whole_texts(aligner):
    r = random.Random(3)
    pool = list("abÀß,.!²  \n\t.,'s1é🙂中▂ 　\xa0\x1f\x0b<>|_- ")
    texts = ODD + ["".join(r.choice(pool) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randint(0, 255), r.randint(0, 0x2FFF), r.randint(0xE000, 0x1FFFF)])) for _ in range(r.randint(1, 12))) for _ in range(700)]
    for text in texts:
        counts, digest, units, times = alignment._document(aligner, alignment.numbered(aligner, text))
        pairs, _, _, number, weight = alignment._linked(aligner, np.zeros(len(units), int), units, times, 1)
        links = {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(w) for p, w in zip(pairs[number], weight, strict=True)}
        assert ((*counts.tolist(), digest), links) == plain_alignment(aligner, text), text


def test_alignment_agrees_with_a_plain_version(spark, aligner, monkeypatch):
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    docs = list(zip(*(c.to_pylist() for c in table.columns), strict=True)) + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a null id"), (3, "a repeated id"), (3, "a repeated id"), (77_777, None), (77_778, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_rows(aligner, docs)
    get = lambda: sorted((str(r[0]), *r[1:]) for r in alignment.align(df, *PATHS).collect())
    assert get() == want
    for name, value in (("CHUNK_BYTES", 20_000), ("MOST_UNITS", 500), ("MANY_LINKS", 3), ("TEXT_CHARS", 1000)):
        monkeypatch.setattr(alignment, name, value)
    assert get() == want


def test_alignment_of_clashing_columns_and_empty_tables(spark, aligner):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert sorted((str(r[0]), *r[1:]) for r in alignment.align(df, *PATHS).collect()) == plain_rows(aligner, [r[:2] for r in rows()])
    assert alignment.align(df.limit(0), *PATHS).count() == 0


def test_ends_between_sure_cuts_come_from_decoded_bytes():
    begin, end = np.array([0, 2, 2, 2, 6]), np.array([2, 2, 2, 6, 7])
    assert alignment.token_ends(begin, end, np.array([2, 1, 1, 2, 1]), np.array([False, True, True, False, False])).tolist() == [2, 3, 4, 6, 7]
