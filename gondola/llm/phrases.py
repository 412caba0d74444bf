"""Collocations of two and three words, counted level by level with double-array tries.

Words, pairs and triples are numbered per language, and only frequent ones have a number.
Level 1: counts of words; the frequent ones make byte tries that turn texts into word numbers.
Level k: a phrase can only be frequent if its first and its last k - 1 words are (Apriori). Each
task notes the phrases that pass, with their number up to the least count; those noted often
enough are the candidates. They are sorted by first part and last word, and each run of them
becomes a trie: its roots are the phrases of k - 1 words, its bytes those of the last word's
number. The tries are broadcast, all positions of a text step through them side by side, a
byte at a time, and the values reached are counted by bincount and summed over the tasks.

A trie holds at most PART_ROWS candidates, and at most ROUND_BYTES of tries are broadcast at
once: with more of them, the texts' numbers are gone through again for each round.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gondola.llm import doublearray
from gondola.llm.frames import arrow_rows, cut, forget, small
from gondola.llm.hashing import slices, trim

#: Phrases with a smaller count are no candidates; a shorter phrase goes if a longer one that holds it has so many hundredths of its count.
LEAST, ABSORBED = 10, 50
#: Phrases returned for each language.
BEST = 2000
#: Keys of one trie, and bytes of tries broadcast at once.
PART_ROWS, ROUND_BYTES = 120_000, 48 << 20
#: Bytes of text in a row of numbered words, about.
TEXT_BYTES = 1 << 20
#: Rows of texts or of numbered words, of about TEXT_BYTES each, that a worker gets at once.
BATCH_ROWS = 8
#: Entries that a task holds before it adds them up.
HELD = 1 << 19
#: Bytes of a word's number as a key.
DIGITS = 4
#: Shares of a language's phrases that are ranked apart first.
SHARES = 64

#: Texts in lower case (A-Z), and the bytes that part words and pieces.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BREAKS = b".,;:!?\n\v\f\r"
BLANKS = bytes.maketrans(BREAKS + b"\t", b" " * (len(BREAKS) + 1))


def _masks() -> tuple[np.ndarray, np.ndarray]:
    ends, parts = np.zeros(256, bool), np.zeros(256, bool)
    ends[list(BREAKS)] = True
    parts[list(BREAKS + b" \t")] = True
    return ends, parts


def joined(batches) -> Iterator[tuple[str, bytes]]:
    """Texts of one language in lower case, joined by line ends, about TEXT_BYTES at a time; batches: lang, _text."""
    for batch in batches:
        for part, texts in slices(batch, "_text", TEXT_BYTES):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, some in by_lang.items():
                yield lang, b"\n".join(some).translate(LOWER)


def _word_counts(batches):
    held: dict[str, Counter] = {}
    kept = 0

    def done():
        for lang, counts in held.items():
            words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            for at in range(0, len(words), 1 << 16):
                some = [w.decode("utf-8", "replace") for w in words[at : at + (1 << 16)]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.string()), pa.array(n[at : at + (1 << 16)])], ["lang", "word", "n"])

    for lang, text in joined(batches):
        counts = held.setdefault(lang, Counter())
        counts.update(text.translate(BLANKS).split(b" "))
        counts.pop(b"", None)
        kept = sum(len(c) for c in held.values())
        if kept > HELD >> 3:
            yield from done()
            held = {}
    yield from done()
    held.clear()
    trim()


BUILT = "part long, place int, lang string, word string, first long, last long, n long, low long, roots string, root_base binary, base binary, check binary, value binary"
NAMES = [c.split()[0] for c in BUILT.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4]


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(NAMES, KINDS, strict=True)], NAMES)


def _runs(batches):
    """Runs of PART_ROWS rows of a sorted partition with their numbers."""
    part, held, rows = TaskContext.get().partitionId() << 20, [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, PART_ROWS - rows)
            batch = batch.slice(some.num_rows)
            held.append(some)
            rows += some.num_rows
            if rows == PART_ROWS:
                yield part, pa.Table.from_batches(held)
                part, held, rows = part + 1, [], 0
    if rows:
        yield part, pa.Table.from_batches(held)


def _trie_row(part: int, trie: dict, low: int | None = None, roots: list | None = None) -> pa.RecordBatch:
    packed = dict(zip(doublearray.FIELDS, ([p] for p in doublearray.pack(trie)), strict=True))
    return _rows(part=[part], low=[low], roots=[None if roots is None else json.dumps(roots)], **packed)


def _word_tries(batches):
    """Numbered words and their tries, a root for each language; batches: lang, word, n, sorted."""
    for part, table in _runs(batches):
        langs, words = table.column(0).to_pylist(), [w.encode() for w in table.column(1).to_pylist()]
        roots = list(dict.fromkeys(langs))
        number = {lang: i for i, lang in enumerate(roots)}
        size = np.array([len(w) for w in words], np.int64)
        trie = doublearray.build(np.array([number[x] for x in langs], np.int64), np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, len(roots))
        yield _rows(part=np.full(len(words), part), place=np.arange(len(words), dtype=np.int32), lang=langs, word=table.column(1).combine_chunks(), n=table.column(2).combine_chunks())
        yield _trie_row(part, trie, roots=roots)
    trim()


def _phrase_tries(batches):
    """Numbered phrases and their tries, a root for each first part; batches: first, last, sorted."""
    for part, table in _runs(batches):
        first, last = (table.column(i).to_numpy() for i in (0, 1))
        low = int(first[0])
        digits = last.astype(f">u{DIGITS}").view(np.uint8)
        rows = np.arange(len(first), dtype=np.int64)
        trie = doublearray.build(first - low, digits, rows * DIGITS, np.full(len(rows), DIGITS), int(first[-1]) - low + 1)
        yield _rows(part=np.full(len(first), part), place=rows.astype(np.int32), first=first, last=last)
        yield _trie_row(part, trie, low)
    trim()


class Level:
    """Numbered words or phrases with their tries, in a table of the shared folder."""

    def __init__(self, built: DataFrame, name: str):
        self.table = cut(built, name)
        parts = self.table.where("base is null").groupBy("part").agg(F.count("*").alias("n")).collect()  # a row a trie
        self.offset, total = {}, 0
        for part, n in sorted(tuple(r) for r in parts):
            self.offset[part], total = total, total + n
        self.size = total

    def numbered(self) -> DataFrame:
        """id and the other columns of the rows."""
        spark = self.table.sparkSession
        offsets = spark.createDataFrame(list(self.offset.items()) or [(0, 0)], "part long, _offset long")
        rows = self.table.where("base is null").join(small(offsets), "part")
        return rows.select((F.col("_offset") + F.col("place")).alias("id"), "lang", "word", "first", "last", "n")

    def rounds(self) -> list[tuple[int, int]]:
        """First and last part of the tries of each round, ROUND_BYTES of them at a time (one at least)."""
        tries = self.table.where("base is not null").select("part", F.expr("3 * octet_length(base) + octet_length(root_base)"))
        groups, held = [], 0
        for part, size in sorted(tuple(r) for r in tries.collect()):  # two numbers a trie
            if groups and held + size <= ROUND_BYTES:
                groups[-1] = (groups[-1][0], part)
            else:
                groups.append((part, part))
                held = 0
            held += size
        return groups

    def tries(self, group: tuple[int, int]) -> list[tuple]:
        """The tries of a round: offset of their numbers, first root, names of roots, arrays."""
        rows = self.table.where(F.col("base").isNotNull() & F.col("part").between(*group)).orderBy("part").select("part", "low", "roots", *doublearray.FIELDS).collect()
        return [(self.offset[r["part"]], r["low"], r["roots"] and json.loads(r["roots"]), [bytes(r[k]) for k in doublearray.FIELDS]) for r in rows]


def word_numbers(text: np.ndarray, lang: str, tries: list[tuple]) -> np.ndarray:
    """Numbers of a text's words, -1 for others and between pieces. All words step through the tries side by side."""
    ends, parts = _masks()
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = ~parts[text]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[0::2], edge[1::2]
    numbers = np.full(len(start), -1, np.int32)
    for offset, _, roots, arrays in tries:
        if lang not in roots:
            continue
        trie, root = doublearray.unpack(arrays), roots.index(lang)
        base, value = trie["base"], trie["value"]
        who, at = np.arange(len(start)), start
        state, base_of = np.full(len(start), -(root + 2), np.int32), np.full(len(start), trie["root_base"][root], np.int32)
        while len(who):
            slot, hit = doublearray.step(trie, base_of, state, text[at])
            who, at, state = who[hit], at[hit] + 1, slot[hit]
            done = at == stop[who]
            found = value[state[done]]
            numbers[who[done][found >= 0]] = found[found >= 0] + offset
            who, at, state = who[~done], at[~done], state[~done]
            base_of = base[state]
    breaks = np.cumsum(ends[text])[start] if len(start) else start
    fresh = np.concatenate([[False], breaks[1:] != breaks[:-1]]) if len(start) else np.empty(0, bool)
    out = np.full(len(start) + int(fresh.sum()), -1, np.int32)
    out[np.arange(len(start)) + np.cumsum(fresh)] = numbers
    return out


def phrase_numbers(first: np.ndarray, last: np.ndarray, tries: list[tuple]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Numbers of the phrases made of a first part and a last word (-1: none), and those met with their counts. All positions step side by side."""
    out, met = np.full(len(first), -1, np.int32), []
    some = np.flatnonzero((first >= 0) & (last >= 0))
    some = some[np.argsort(first[some], kind="stable")]
    ordered = first[some]
    for offset, low, _, arrays in tries:
        trie = doublearray.unpack(arrays)
        a, b = np.searchsorted(ordered, [low, low + len(trie["root_base"])])
        who = some[a:b]
        state = -(ordered[a:b] - low + 2)
        base = trie["root_base"][ordered[a:b] - low]
        for d in range(DIGITS):
            slot, hit = doublearray.step(trie, base, state, (last[who] >> (8 * (DIGITS - 1 - d))) & 255)
            who, state = who[hit], slot[hit]
            base = trie["base"][state]
        found = trie["value"][state]
        out[who] = found + offset
        counts = np.bincount(found)
        nonzero = np.flatnonzero(counts)
        met.append((nonzero + offset, counts[nonzero]))
    return out, met


NUMBERED = "lang string, text binary, words binary, states binary, block long, met binary, counts binary"
#: Numbers whose partial counts go together: number >> BLOCK_BITS is their block.
BLOCK_BITS = 12


def _numbered(lang=None, text=None, words=None, states=None, block=None, met=None, counts=None) -> pa.RecordBatch:
    cols = [[lang], [text], [words], [states], [block], [met], [counts]]
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in NUMBERED.split(", ")])


def numbered_words(docs: DataFrame, words: Level) -> DataFrame:
    """Rows with the numbers of words of about TEXT_BYTES of text; docs: lang, _text."""
    spark = docs.sparkSession
    groups, now = words.rounds(), None
    for i, group in enumerate(groups):
        value = spark.sparkContext.broadcast(words.tries(group))
        last = i + 1 == len(groups)

        def run(batches, value=value, again=i > 0, last=last):
            found = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)) if again else ((*x, None) for x in joined(batches))
            for lang, text, old in found:
                numbers = word_numbers(np.frombuffer(text, np.uint8), lang, value.value)
                if old is not None:
                    numbers = np.maximum(numbers, np.frombuffer(old, "<i4"))
                yield _numbered(lang, None if last else text, numbers.astype("<i4").tobytes())
            trim()

        before = now
        with arrow_rows(spark, BATCH_ROWS) if i else nullcontext():
            now = cut((docs if before is None else before.select("lang", "text", "words")).mapInArrow(run, NUMBERED), "numbered")
        value.destroy()
        if before is not None:
            forget(before)
    return now if groups else cut(spark.createDataFrame([], NUMBERED), "numbered")


def numbered_phrases(numbers: DataFrame, level: Level, k: int) -> DataFrame:
    """Rows met, counts with partial counts of the phrases of k words, and for pairs rows words, states (numbers of the pairs that begin at each position).

    numbers: words, and for triples the states of pairs.
    """
    spark, now, counts = numbers.sparkSession, numbers, []
    for group in level.rounds():
        value = spark.sparkContext.broadcast(level.tries(group))

        def run(batches, value=value, again=bool(counts)):
            held: list[tuple] = []
            weight = 0
            for batch in batches:
                for words, states in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    w = np.frombuffer(words, "<i4")
                    s = w if k == 2 else np.frombuffer(states, "<i4")
                    first, last = s[:-1].copy(), np.full(len(s) - 1, -1, np.int32)
                    last[: len(w) - k + 1] = w[k - 1 :]
                    first[s[1:] < 0] = -1  # its last k - 1 words have to be frequent as well
                    found, met = phrase_numbers(first, last, value.value)
                    held += met
                    weight += sum(len(m[0]) for m in met)
                    if weight > HELD >> 1:
                        held = [_added(held)]
                        weight = len(held[0][0])
                        if weight > HELD >> 2:
                            yield from _blocks(*held[0])
                            held, weight = [], 0
                    if k == 2:
                        found = np.append(found, np.int32(-1))
                        if again:
                            found = np.maximum(found, np.frombuffer(states, "<i4"))
                        yield _numbered(words=words, states=found.astype("<i4").tobytes())
            if held:
                yield from _blocks(*_added(held))
            trim()

        some = now.where("words is not null and octet_length(words) > 4").select("words", "states")
        with arrow_rows(spark, BATCH_ROWS):
            found = cut(some.mapInArrow(run, NUMBERED), f"phrases{k}")
        value.destroy()
        counts.append(found.where("met is not null"))
        if k == 2:
            now = found.where("words is not null")
    out = now if k == 2 and counts else numbers.limit(0)
    for part in counts:
        out = out.unionByName(part)
    return out


def _added(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of several bincounts as one."""
    ids, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return ids, np.bincount(place, np.concatenate([h[1] for h in held]), len(ids)).astype(np.int64)


def _blocks(ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each block of numbers: places in it and counts."""
    block = ids >> BLOCK_BITS
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(ids) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield _numbered(block=int(block[a]), met=(ids[a:b] & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes(), counts=counts[a:b].astype("<i8").tobytes())


def _totals(batches):
    """id, n of rows block, met, counts, sorted by block."""
    now, total = None, np.zeros(1 << BLOCK_BITS, np.int64)

    def done():
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array((now << BLOCK_BITS) + some), pa.array(total[some])], ["id", "n"])

    for batch in batches:
        for block, met, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now:
                if now is not None:
                    yield done()
                now, total = block, np.zeros(1 << BLOCK_BITS, np.int64)
            total[np.frombuffer(met, "<u2")] += np.frombuffer(counts, "<i8")
    if now is not None:
        yield done()


def counted(found: DataFrame) -> DataFrame:
    """id, n: the tasks' bincounts summed, block by block."""
    rows = found.where("met is not null").select("block", "met", "counts")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_totals, "id long, n long")


def candidates(numbers: DataFrame, k: int, least: int) -> DataFrame:
    """first, last of the phrases of k words that pass Apriori and were noted least times; numbers: words, and for k > 2 states of k - 1 words."""

    def run(batches):
        some: list[np.ndarray] = []
        weight = 0

        def noted():
            keys = np.concatenate(some)
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n = np.minimum(np.diff(np.append(first, len(keys))), least).astype(np.int16)
            for at in range(0, len(first), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[first[at : at + (1 << 16)]]), pa.array(n[at : at + (1 << 16)])], ["key", "n"])

        for batch in batches:
            for words, states in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                w = np.frombuffer(words, "<i4")
                s = w if k == 2 else np.frombuffer(states, "<i4")
                first, last = s[: len(w) - k + 1].astype(np.int64), w[k - 1 :].astype(np.int64)
                fine = (first >= 0) & (last >= 0) & (s[1 : len(w) - k + 2] >= 0)
                some.append(first[fine] << 32 | last[fine])
                weight += len(some[-1])
                if weight > HELD:
                    yield from noted()
                    some, weight = [], 0
        if weight:
            yield from noted()
        trim()

    rows = numbers.where(f"words is not null and octet_length(words) >= {4 * k}").select("words", "states").mapInArrow(run, "key long, n short")
    sums = rows.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return sums.select(F.shiftright("key", 32).alias("first"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("last"))


def phrase_level(found: DataFrame, name: str) -> Level:
    """The candidates (first, last), numbered and made into tries."""
    with arrow_rows(found.sparkSession, BATCH_ROWS):
        found = cut(found, "candidates")
    parts = max(1, -(-found.count() // PART_ROWS))
    level = Level(found.repartitionByRange(parts, "first", "last").sortWithinPartitions("first", "last").mapInArrow(_phrase_tries, BUILT), name)
    forget(found)
    return level


def _score(a, left, right):
    """floor(1000000 * a * a / (left * right)), exact for counts below 10**15."""
    wide = [c.cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, absorbed: int = ABSORBED, best: int = BEST) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split at sentence marks and line ends into pieces, and those at blanks and tabs
    into words. A phrase is two or three words of a piece, met a >= least times. n counts all words, l and r the
    parts of the cut with the least score (of equal ones the first), score is floor(1000000 * a * a / (l * r)). A pair
    goes if a frequent triple holds it with absorbed hundredths of its count. Ranks go by score, a (descending)
    and phrase. Null languages count as und, null texts are empty; languages without phrases have no rows.
    """
    docs = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("_text"))
    counts = cut(docs.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.where(F.col("n") >= least)
    parts = max(1, -(-frequent.count() // PART_ROWS))
    words = Level(frequent.repartitionByRange(parts, "lang", "word").sortWithinPartitions("lang", "word").mapInArrow(_word_tries, BUILT), "level1")
    numbers = numbered_words(docs, words)
    pairs = phrase_level(candidates(numbers, 2, least), "level2")
    found2 = numbered_phrases(numbers, pairs, 2)
    triples = phrase_level(candidates(found2, 3, least), "level3")
    found3 = numbered_phrases(found2, triples, 3)

    one = words.numbered().select("id", "lang", "word", "n")
    two = cut(pairs.numbered().select("id", "first", "last").join(counted(found2), "id"), "pairs")
    three = triples.numbered().select("id", "first", "last").join(counted(found3), "id")
    forget(numbers)

    def named(p: str, *more: str) -> DataFrame:
        return one.select(F.col("id").alias(p), F.col("word").alias(f"{p}_word"), F.col("n").alias(f"{p}_n"), *more)

    pair = two.join(named("first", "lang"), "first").join(named("last"), "last")
    pair = pair.select("id", "lang", "first", "last", F.concat_ws(" ", "first_word", "last_word").alias("phrase"), F.col("n").alias("a"), F.col("first_n").alias("l"), F.col("last_n").alias("r"))
    pair = cut(pair, "named")
    # a triple is a pair and a word, and a word and a pair
    head = pair.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("head"), F.col("a").alias("head_a"), F.col("l").alias("head_l"), F.col("last").alias("middle"))
    triple = three.join(head, "first").join(named("last"), "last")
    tail = two.select(F.col("first").alias("middle"), "last", F.col("id").alias("tail"), F.col("n").alias("tail_a"))
    triple = cut(triple.join(tail, ["middle", "last"]), "triples")
    cuts = [F.struct(_score(F.col("n"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, left, right in ((1, F.col("head_l"), F.col("tail_a")), (2, F.col("head_a"), F.col("last_n")))]
    long = triple.select("lang", F.concat_ws(" ", "head", "last_word").alias("phrase"), F.col("n").alias("a"), F.least(*cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    holders = triple.select(F.explode(F.array("first", "tail")).alias("id"), "n").groupBy("id").agg(F.max("n").alias("most"))
    short = pair.join(holders, "id", "left").where(F.coalesce(100 * F.col("most") < absorbed * F.col("a"), F.lit(True))).select("lang", "phrase", "a", "l", "r").withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    every = long.unionByName(short.select("lang", "phrase", "a", "l", "r", "score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    top = every.withColumn("_share", share).withColumn("_n", F.row_number().over(W.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_n") <= best)
    top = top.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return top.join(F.broadcast(totals) if totals.count() < 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
