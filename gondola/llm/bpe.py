"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf holds the merge rank of a symbol and its right neighbour, joined with its
place, so that the root's minimum is the leftmost lowest-rank merge. After a merge
the leaves of the merged symbol, its left neighbour and the symbol that went are
set anew, with logarithmic updates up the tree, until no pair can be merged.
Many words go through trees of one shape side by side in numpy.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gondola.llm.hashing import slices, worker_value

NONE = np.int64(1) << 62
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Bytes of text encoded at a time, about.
TEXT_BYTES = 1 << 18
#: Words of more than 2 ** LONG_DEPTH bytes are merged one by one.
LONG_DEPTH = 8
#: Lower case where str.lower differs from the simple case of single characters in Unicode 16 (fixed values).
LOWER = (
    {0x03A3: 0x03C3, 0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
    | {c: c + 32 for c in range(0x10D50, 0x10D66)}
    | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
)
#: Letters and numbers newer than the tables of the library's patterns, which take them for other characters (fixed values, first and last of each run).
NEW_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEW_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
#: Combining marks newer than the library's tables of canonical order, which take them for starters (fixed values, first and last of each run).
NEW_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A),
    (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97),
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
#: Words kept in a worker's cache; beyond, it starts anew (the result is the same).
CACHE_WORDS = 300_000
#: Words that the cache keeps from one task to the next: those learned first, frequent ones among them.
CACHE_BETWEEN = 20_000


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def _runs(runs) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)


def composed(text: str) -> str:
    """NFC as the library has it: newer marks part the text."""
    parts = worker_value("new_marks", lambda: regex.compile(f"([{_runs(NEW_MARKS)}])")).split(text)
    return "".join([unicodedata.normalize("NFC", p) for p in parts])


class WordBpe:
    """A BPE vocabulary file with word ends: NFC, white space to one space, lower case, words by pattern, bytes as symbols."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--[{_runs(NEW_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_runs(NEW_NUMBERS)}]]")
        self.words = regex.compile(pattern, regex.V1)
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in merges], np.int64)
        to = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        _, last = np.unique(keys[::-1], return_index=True)  # of a repeated pair the later rank holds
        rank = len(keys) - 1 - last
        self.keys, self.ranks, self.to = keys[rank], rank.astype(np.int64), to[rank]
        symbols = byte_symbols()
        self.inner = np.array([self.vocab.get(s, -1) for s in symbols], np.int64)
        self.final = np.array([self.vocab.get(s + self.end, -1) for s in symbols], np.int64)
        self.tokens = [""] * self.size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.cache: dict[str, tuple[str, str, int]] = {}

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; no merge: NONE."""
        key = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.to[at]

    def merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (its UTF-8 bytes, one at least)."""
        out: list[np.ndarray] = [None] * len(words)
        shape = np.array([max(1, (len(w) - 1).bit_length()) for w in words])
        for depth in np.unique(shape):
            group = np.flatnonzero(shape == depth)
            if depth > LONG_DEPTH:
                for i in group:
                    out[i] = self._merge_long(words[i], int(depth))
                continue
            step = max(1, (1 << 19) >> int(depth))
            for at in range(0, len(group), step):
                some = group[at : at + step]
                for i, ids in zip(some, self._merge([words[i] for i in some], int(depth)), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], depth: int) -> list[np.ndarray]:
        n, width = len(words), 1 << depth
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        ids = np.where(place < size[:, None], self.inner[raw], -1)
        ids[np.arange(n), size - 1] = self.final[raw[np.arange(n), size - 1]]
        following = np.where(place + 1 < size[:, None], place + 1, width)
        before = np.tile(place - 1, (n, 1))
        shift = np.int64(width)
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank, _ = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank = rank.reshape(n, width - 1)
        tree[:, width : 2 * width - 1] = np.where(rank == NONE, NONE, rank * shift + place[:-1])
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        live = np.flatnonzero(tree[:, 1] != NONE)

        def put(rows, at, value):
            node = at + width
            tree[rows, node] = value
            for _ in range(depth):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair_at(rows, at, right):
            there = right < width
            rank, _ = self.pair(ids[rows, at], np.where(there, ids[rows, np.minimum(right, width - 1)], -1))
            return np.where(rank == NONE, NONE, rank * shift + at)

        while len(live):
            at = tree[live, 1] % shift
            right = following[live, at]
            _, to = self.pair(ids[live, at], ids[live, right])
            ids[live, at] = to
            ids[live, right] = -1
            after = following[live, right]
            following[live, at] = after
            inside = after < width
            before[live[inside], after[inside]] = at[inside]
            put(live, right, np.full(len(live), NONE))
            put(live, at, pair_at(live, at, after))
            left = before[live, at]
            some = left >= 0
            put(live[some], left[some], pair_at(live[some], left[some], at[some]))
            live = live[tree[live, 1] != NONE]
        return [row[row >= 0] for row in ids]

    def _merge_long(self, word: bytes, depth: int) -> np.ndarray:
        """The same for one long word, in plain integers."""
        pairs = worker_value(("pairs", id(self)), lambda: dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.to.tolist(), strict=True), strict=True)))
        n, width, none, size = len(word), 1 << depth, int(NONE), self.size
        ids = [*self.inner[np.frombuffer(word, np.uint8)].tolist()]
        ids[-1] = int(self.final[word[-1]])
        following, before = [*range(1, n), width], list(range(-1, n - 1))

        def key(a: int, b: int) -> int:
            if b == width or ids[a] < 0 or ids[b] < 0 or (found := pairs.get(ids[a] * size + ids[b])) is None:
                return none
            return found[0] * width + a

        tree = [none] * width + [key(i, following[i]) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != none:
            at = tree[1] % width
            right = following[at]
            ids[at] = pairs[ids[at] * size + ids[right]][1]
            ids[right] = -1
            after = following[at] = following[right]
            if after < width:
                before[after] = at
            put(right, none)
            put(at, key(at, after))
            if before[at] >= 0:
                put(before[at], key(before[at], at))
        return np.array([i for i in ids if i >= 0], np.int64)

    def _split(self, text: str) -> list[tuple[str, bool]]:
        parts, at = [], 0
        if any(s in text for s in self.special):
            for m in self.specials.finditer(text):
                parts += [(text[at : m.start()], False), (m[0], True)]
                at = m.end()
        return [*parts, (text[at:], False)]

    def units_of(self, text: str) -> list[str]:
        """Runs of lower-cased text between white space, in order; special tokens as they stand, after a blank."""
        out: list[str] = []
        for part, special in self._split(text):
            if special:
                out.append(" " + part)
                continue
            if not latin(part):  # Latin-1 is in NFC already
                part = composed(part).translate(LOWER)
            # str.split also parts at the separators 0x1C to 0x1F, which the vocabulary's white space leaves in words
            out += regex.split(r"\s+", part.lower().strip(" ")) if any(c in part for c in SEPARATORS) else part.lower().split()
        return [u for u in out if u] if "" in out else out

    def learn(self, units: set[str]) -> None:
        """Fill the cache for these units: ids as text, tokens as text, number of ids."""
        new = [u for u in units if u not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {u: self.cache[u] for u in units if u in self.cache}
        split = [[] if u[0] == " " else self.words.findall(u) for u in new]
        words = list(dict.fromkeys(w for s in split for w in s))
        merged = dict(zip(words, self.merge_all([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        for u, s in zip(new, split, strict=True):
            ids = [self.special[u[1:]]] if u[0] == " " else [i for w in s for i in merged[w].tolist()]
            self.cache[u] = (" ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]), len(ids))

    def rest(self) -> None:
        """Give memory back at the end of a task, as the process goes on to other stages."""
        if len(self.cache) > CACHE_BETWEEN:
            self.cache = dict(islice(self.cache.items(), CACHE_BETWEEN))


def vocabulary(path: str) -> WordBpe:
    return worker_value(("word_bpe", path), lambda: WordBpe(path))


def encode_texts(bpe: WordBpe, texts: list[str]) -> list[tuple[int, str, str]]:
    """Per text: number of ids, ids joined by one space, decoded text (tokens joined by one space)."""
    split = [bpe.units_of(t) for t in texts]
    bpe.learn(set().union(*split))
    get = bpe.cache.__getitem__
    out = []
    for units in split:
        ids, tokens, n = zip(*map(get, units), strict=True) if units else ((), (), ())
        if 0 in n:
            ids, tokens = filter(None, ids), filter(None, tokens)
        out.append((sum(n), " ".join(ids), " ".join(tokens)))
    return out


def encode(df: DataFrame, path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """All rows and columns with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    Null texts count as empty: no ids, digests of the empty string. Columns of
    clashing names are replaced. The result is the library's for add_special_tokens=False.
    """
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        new.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    df = df.drop(*[f.name for f in new])
    schema = T.StructType([*df.schema, *new])

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for part, texts in slices(batch, text, TEXT_BYTES):
                done = encode_texts(bpe, [(t or b"").decode("utf-8", "replace") for t in texts])
                cols = [pa.array([d[0] for d in done], pa.int64()), *(pa.array([hashlib.sha256(d[k].encode("utf-8", "surrogatepass")).hexdigest() for d in done], pa.string()) for k in (1, 2))]
                if ids:
                    flat = np.array(" ".join([d[1] for d in done if d[0]]).split(), np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([d[0] for d in done])]), pa.int32()), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *(f.name for f in new)])
        bpe.rest()

    return df.mapInArrow(run, schema)
