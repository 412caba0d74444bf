"""Alignment of two tokenizers' tokens by the byte offsets at which both end.

Spans come from the libraries: character offsets of the byte-level tokenizer and byte
spans of sentencepiece's proto. They are coarse cuts, since several tokens may share one
character; between sure cuts, tokens end where their own decoded bytes end.

Texts are split where both tokenizers end a token for certain: at a blank after a solid
character, and between a letter and a sentence mark. Such a unit has the same tokens, groups
and links in any text, so a worker asks the libraries once for each and remembers it. Units
are told apart by their text.

How many documents hold a linked pair of ids is counted in two steps. Each chunk of
documents (CHUNK_BYTES of text) has a list of its distinct pairs with the number of its
documents that hold them; the lists are summed by pair, and the sums go back to the
chunks. A pair has one row a chunk, however often it occurs.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.frames import cut, small
from gondola.llm.hashing import slices, worker_value

#: Text of a chunk of documents, about (a longer document is a chunk of its own).
CHUNK_BYTES = 8 << 20
#: Text handled at a time, in bytes by rows and in characters of one text.
TEXT_BYTES, TEXT_CHARS = 1 << 20, 1 << 20
#: Units, and characters of their texts, that a worker remembers; beyond, it starts anew.
MOST_UNITS, MOST_CHARS = 500_000, 16_000_000
#: Units that are encoded together.
TOGETHER = 1500
#: Groups with more links are counted by distinct ids.
MANY_LINKS = 4096

#: Marks that end a word in both vocabularies: no piece has one after a letter.
MARKS = ",.;:!?"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: There both tokenizers end a token.
SURE_CUT = re.compile(rf"(?<!\s)(?= )|(?<=[{LETTERS}])(?=[{MARKS}])")
#: Units that begin solid, but for one blank, and end solid: these can be encoded together, parted by line ends.
LED = re.compile(r" ?\S(?:.*\S)?", re.S)
#: Stands before such units, since sentencepiece puts a blank in front of any text.
FRONT = " x"


def token_ends(begin: np.ndarray, end: np.ndarray, size: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes. begin, end: the library's spans; size: bytes that the token stands for; single: whether it is one byte of a character.

    A span's end is a sure cut if the next span begins there and the two tokens aren't bytes
    of one run. Other ends lie as many bytes behind the last sure cut as the tokens since have.
    """
    n = len(end)
    if not n:
        return end
    own = np.cumsum(size)
    sure = np.ones(n, bool)
    sure[:-1] = (end[:-1] == begin[1:]) & (end[:-1] > begin[:-1]) & ~(single[:-1] & single[1:])
    sure[-1] = False
    last = np.maximum.accumulate(np.where(sure, np.arange(n), -1))
    base = np.where(last >= 0, end[last] - own[last], 0)
    return own + base


class Numbers(dict):
    """Numbers of units, which new ones get as they are met."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = number = len(self)
        return number


class Aligner:
    """Tokens, groups and links of units of text, in tables that grow as units are met."""

    def __init__(self, byte_path: str, piece_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        letters = {_byte_letter(value): value for value in range(256)}
        assert set(pre_tokenizers.ByteLevel.alphabet()) == set(letters)
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes, single = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            single.append(self.b.is_byte(i))
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if single[-1] else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.b_single = np.array(single, bool)
        within = re.compile(f"[{LETTERS}][{MARKS}]")
        assert not any(within.search(x.decode("utf-8", "replace")) for x in self.b_bytes)
        self.start_anew()

    def start_anew(self) -> None:
        self.ids = Numbers()
        self.chars = 0
        #: Where the tables have the units, by number.
        self.place = np.empty(0, np.int64)
        #: Per unit: tokens of either side, groups, links, whether both sides' bytes are the text's.
        self.counts = np.zeros((0, 4), np.int64)
        self.good = np.zeros(0, bool)
        self.groups: list[str] = []
        #: Per unit where its linked pairs (first id * 2**32 + second id) and their numbers begin in the pools.
        self.first = np.zeros(1, np.int64)
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def units(self, pieces: list[str]) -> np.ndarray:
        """The numbers of the units; learn() has to be called before those of new ones are used."""
        return np.fromiter(map(self.ids.__getitem__, pieces), np.int64, len(pieces))

    def learn(self) -> None:
        """Ask the libraries for all units that are new."""
        new = self.ids.new
        if not new:
            return
        start = len(self.good)
        together = [i for i, u in enumerate(new) if len(u) < TEXT_CHARS >> 4 and LED.fullmatch(u)]
        apart = sorted(set(range(len(new))).difference(together))
        parts = [[FRONT, *(new[i] for i in together[k : k + TOGETHER])] for k in range(0, len(together), TOGETHER)] + [[new[i]] if new[i][0] == " " else [FRONT, new[i]] for i in apart]
        self.chars += sum(map(len, new))
        counts, good, pairs, times, sizes = [self.counts], [self.good], [self.pairs], [self.times], []
        for at in range(0, len(parts), 16):
            some = parts[at : at + 16]
            texts = ["\n".join(p) for p in some]
            for part, text, e in zip(some, texts, self.a.encode_batch(texts, add_special_tokens=False), strict=True):
                c, g, strings, p, t, m = self.aligned(part, text, e)
                front = len(part) > 1  # FRONT's own tokens are left out
                skip = int(m[0]) if front else 0
                counts.append(c[front:])
                good.append(g[front:])
                pairs.append(p[skip:])
                times.append(t[skip:])
                sizes.append(m[front:])
                self.groups.extend(strings[front:])
        self.counts, self.good, self.pairs, self.times = np.concatenate(counts), np.concatenate(good), np.concatenate(pairs), np.concatenate(times)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
        # numbers in the order in which they were asked for
        self.place = np.append(self.place, np.empty(len(new), np.int64))
        self.place[start + np.array(together + apart, np.int64)] = start + np.arange(len(new))
        self.ids.new = []

    def aligned(self, part: list[str], text: str, encoding) -> tuple:
        """For units joined by line ends: counts, whether good, groups as text, linked pairs, their numbers, how many pairs each unit has."""
        raw = text.encode()
        a_ids = np.array(encoding.ids, np.int64)
        offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
        if len(raw) != len(text):  # characters to bytes
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            place = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
            offsets = place[offsets]
        proto = self.b.encode(text[1:], return_type="proto").pieces if len(text) > 1 else None
        if proto is None:  # a blank alone: the piece that the library puts in front of any text
            b_ids, spans = np.array([self.b.piece_to_id("▁")], np.int64), np.array([[0, 1]])
        else:
            b_ids = np.array([x.id for x in proto], np.int64)
            spans = np.array([(x.begin, x.end) for x in proto], np.int64).reshape(-1, 2) + 1
            if len(spans):
                spans[0, 0] = 0
        a_end = token_ends(offsets[:, 0], offsets[:, 1], self.a_size[a_ids], np.zeros(len(a_ids), bool))
        b_end = token_ends(spans[:, 0], spans[:, 1], self.b_size[b_ids], self.b_single[b_ids])
        size = np.array([len(u) for u in part], np.int64) if len(raw) == len(text) else np.array([len(u.encode()) for u in part], np.int64)
        stop = np.cumsum(size + 1) - 1
        start = stop - size
        same = [b"".join(map(table.__getitem__, ids.tolist())) for table, ids in ((self.a_bytes, a_ids), (self.b_bytes, b_ids))]
        if same[0] != raw or same[1] != raw:
            if len(part) > 2:  # told unit by unit
                found = [self.aligned([FRONT, u], f"{FRONT}\n{u}", self.a.encode(f"{FRONT}\n{u}", add_special_tokens=False)) for u in part]
                sizes = [f[5] for f in found]
                tails = [tuple(x[int(m[0]) :] for x in f[3:5]) for f, m in zip(found, sizes, strict=True)]
                return (*(np.concatenate([f[k][1:] for f in found]) for k in (0, 1)), [f[2][1] for f in found], *(np.concatenate([t[k] for t in tails]) for k in (0, 1)), np.concatenate([m[1:] for m in sizes]))
            n = len(part)
            return np.zeros((n, 4), np.int64), np.zeros(n, bool), [""] * n, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n, np.int64)
        # whole groups, numbered; the line ends between units are left out
        ends = a_end[np.isin(a_end, b_end, assume_unique=True)]
        group_start = np.concatenate([[0], ends[:-1]])
        unit = np.searchsorted(start, group_start, side="right") - 1
        inside = group_start < stop[unit]
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        na, nb = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        a_first, b_first = np.cumsum(na) - na, np.cumsum(nb) - nb
        counts = np.zeros((len(part), 4), np.int64)
        for k, x in enumerate((na, nb, np.ones(len(ends), np.int64), na * nb)):
            counts[:, k] = np.bincount(unit[inside], x[inside], len(part)).astype(np.int64)
        strings = self.strings(a_ids, b_ids, na, nb, unit, inside, len(part))
        g = np.flatnonzero(inside & (na * nb <= MANY_LINKS))
        # every first token of a group with every second one
        left = np.repeat(g, na[g])
        left_at = np.arange(len(left)) - np.repeat(np.cumsum(na[g]) - na[g], na[g]) + a_first[left]
        width = nb[left]
        right_at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(b_first[left], width)
        pair = np.repeat(a_ids[left_at] << 32, width) | b_ids[right_at]
        whose, times = np.repeat(unit[left], width), np.ones(len(pair), np.int64)
        for x in np.flatnonzero(inside & (na * nb > MANY_LINKS)).tolist():
            ua, ca = np.unique(a_ids[a_first[x] : a_first[x] + na[x]], return_counts=True)
            ub, cb = np.unique(b_ids[b_first[x] : b_first[x] + nb[x]], return_counts=True)
            pair = np.append(pair, ((ua << 32)[:, None] | ub[None, :]).ravel())
            times = np.append(times, (ca[:, None] * cb[None, :]).ravel())
            whose = np.append(whose, np.full(len(ua) * len(ub), unit[x]))
        order = np.lexsort((pair, whose))
        whose, pair, times = whose[order], pair[order], times[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (whose[1:] != whose[:-1]) | (pair[1:] != pair[:-1])
        if len(pair):
            times = np.add.reduceat(times, np.flatnonzero(fresh))
        return counts, np.ones(len(part), bool), strings, pair[fresh], times, np.bincount(whose[fresh], minlength=len(part))

    @staticmethod
    def strings(a_ids, b_ids, na, nb, unit, inside, n: int) -> list[str]:
        """Each unit's groups as a1,a2|b1;a3|b2."""
        out: list[list[str]] = [[] for _ in range(n)]
        a, b, i, j = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist())), 0, 0
        for x, y, u, keep in zip(na.tolist(), nb.tolist(), unit.tolist(), inside.tolist(), strict=True):
            if keep:
                out[u].append((a[i] if x == 1 else ",".join(a[i : i + x])) + "|" + (b[j] if y == 1 else ",".join(b[j : j + y])))
            i, j = i + x, j + y
        return [";".join(g) for g in out]


def _byte_letter(value: int) -> str:
    """The letter that stands for a byte in byte-level vocabularies: itself if printable, else the next free one from U+0100 on."""
    shown = worker_value("shown_bytes", lambda: [*range(33, 127), *range(161, 173), *range(174, 256)])
    return chr(value) if value in shown else chr(256 + [v for v in range(256) if v not in shown].index(value))


def stretches(text: str):
    """Runs of units of blank + text, each of about TEXT_CHARS characters."""
    text, at = " " + text, 0
    while at < len(text):
        found = SURE_CUT.search(text, at + TEXT_CHARS) if len(text) - at > TEXT_CHARS else None
        to = found.start() if found else len(text)
        pieces = SURE_CUT.split(text[at:to])
        yield pieces if pieces[0] else pieces[1:]  # a split before the first blank
        at = to


def _document(aligner: Aligner, runs) -> tuple:
    """Counts, digest and (unit, times) of one text, whose units come in runs of numbers; without tokens: zeros."""
    counts, found, digest = np.zeros(4, np.int64), [], hashlib.sha256()
    for i, numbers in enumerate(runs):
        aligner.learn()
        units = aligner.place[numbers]
        if not aligner.good[units].all():
            return np.zeros(4, np.int64), "", np.empty(0, np.int64), np.empty(0, np.int64)
        counts += aligner.counts[units].sum(axis=0)
        digest.update((";" if i else "").encode() + ";".join(map(aligner.groups.__getitem__, units.tolist())).encode())
        found.append(np.unique(units, return_counts=True))
    if not found:
        return counts, "", np.empty(0, np.int64), np.empty(0, np.int64)
    return counts, digest.hexdigest(), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def numbered(aligner: Aligner, text: str | None):
    """The numbers of a text's units, run by run; those of a long text as they are needed."""
    if not text:
        return []
    runs = (aligner.units(pieces) for pieces in stretches(text))
    return list(runs) if len(text) < TEXT_CHARS else runs


def _linked(aligner: Aligner, docs: np.ndarray, units: np.ndarray, times: np.ndarray, n: int) -> tuple:
    """Distinct pairs, in how many of n documents each is, and per document (first entry, pair's number, times)."""
    first, width = aligner.first[units], np.diff(aligner.first)[units]
    at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
    pairs, number = np.unique(aligner.pairs[at], return_inverse=True)
    key = np.repeat(docs, width) * max(len(pairs), 1) + number
    order = np.argsort(key, kind="stable")
    key, weight = key[order], (aligner.times[at] * np.repeat(times, width))[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    weight = np.add.reduceat(weight, np.flatnonzero(fresh)) if len(key) else weight
    whose, number = np.divmod(key[fresh], max(len(pairs), 1))
    return pairs, np.bincount(number, minlength=len(pairs)), np.searchsorted(whose, np.arange(n + 1)), number, weight


ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, numbers binary"


def _aligned(batches, paths: tuple[str, str]):
    """A row for each document (pairs: places in its chunk's list as 32-bit numbers; numbers: how often each is linked) and, after each chunk's, one without
    groups_sha256 whose pairs are the chunk's distinct ones and whose numbers say in how many of its documents."""
    aligner = worker_value(("aligner", paths), lambda: Aligner(*paths))
    chunk = TaskContext.get().partitionId() << 32
    held, weight = [], 0
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]

    def done():
        docs = np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
        pairs, holds, starts, number, times = _linked(aligner, docs, *(np.concatenate([h[i] for h in held]) for i in (3, 4)), len(held))
        wide = "<i4" if not len(times) or times.max() < 1 << 31 else "<i8"
        rows = [(chunk, h[0], *h[1].tolist(), h[2], number[a:b].astype("<i4").tobytes(), times[a:b].astype(wide).tobytes()) for h, a, b in zip(held, starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        rows.append((chunk, None, 0, 0, 0, 0, None, pairs.astype("<i8").tobytes(), holds.astype("<i8").tobytes()))
        for at in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 2000], strict=True), kinds, strict=True)], names)

    for batch in batches:
        for part, raw in slices(batch, "_text", TEXT_BYTES):
            if len(aligner.ids) > MOST_UNITS or aligner.chars > MOST_CHARS:
                if held:
                    yield from done()
                    held, weight, chunk = [], 0, chunk + 1
                aligner.start_anew()
            texts = [None if t is None else t.decode("utf-8", "replace") for t in raw]
            runs = [numbered(aligner, t) for t in texts]
            for doc_id, text, some in zip(part.column(0).to_pylist(), texts, runs, strict=True):
                held.append((doc_id, *_document(aligner, some)))
                weight += len(text or "")
                if weight >= CHUNK_BYTES:
                    yield from done()
                    held, weight, chunk = [], 0, chunk + 1
    if held:
        yield from done()


def _pair_rows(batches):
    """chunk, place, pair, docs of the chunks' lists."""
    for batch in batches:
        for chunk, pairs, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, docs = np.frombuffer(pairs, "<i8"), np.frombuffer(docs, "<i8")
            for at in range(0, len(pairs), 1 << 16):
                p, d = pairs[at : at + (1 << 16)], docs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), chunk)), pa.array(np.arange(at, at + len(p), dtype=np.int32)), pa.array(p), pa.array(d)], ["chunk", "place", "pair", "docs"])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _judged(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one chunk with the corpus-wide counts of its pairs."""
    count, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    place = pairs.column("place").to_numpy()
    count[place], best[place] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for at, times in zip(docs.column("pairs").to_pylist(), docs.column("numbers").to_pylist(), strict=True):
        at = np.frombuffer(at, "<i4")
        times = np.frombuffer(times, f"<i{len(times) // len(at)}").astype(np.int64) if len(at) else np.empty(0, np.int64)
        n_best.append(int((times * best[at]).sum()))
        count_sum.append(int((times * count[at]).sum()))
    kept = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    names = [c.split()[0] for c in RESULT.split(", ")]
    return pa.Table.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], names)


def align(df: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Both tokenizers see a blank and the text; byte offsets where tokens of both end cut them into
    groups, and each first token of a group is linked with each second one. A linked pair of ids counts in
    as many rows as hold it; n_best are links whose count is the greatest of their first id, ties
    included. Null and empty texts, and ones that a tokenizer doesn't give back byte by byte (U+2581
    stands for a blank), have no tokens: zeros and an empty digest. Repeated rows and ids count as rows of their own.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    found = cut(rows.mapInArrow(partial(_aligned, paths=(byte_path, piece_path)), ALIGNED), "aligned")
    lists = found.where("groups_sha256 is null").select("chunk", "pairs", "numbers").mapInArrow(_pair_rows, "chunk long, place int, pair long, docs long")
    counts = cut(lists.groupBy("pair").agg(F.sum("docs").alias("n")), "counts")
    # one row for each id of the first vocabulary
    best = cut(counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most")), "best")
    rated = counts.withColumn("a", F.shiftright("pair", 32)).join(small(best), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    back = lists.join(rated, "pair").select("chunk", "place", "n", "best")
    docs = found.where("groups_sha256 is not null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "numbers")
    return docs.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_judged, RESULT)

