"""Vectorised hashing of words and byte strings, shared by several operators."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and 0x09 to 0x0D.
WHITE_BYTES = b" \t\n\v\f\r"
#: Text is handled in runs of rows of about so many bytes, which bounds memory.
SLICE_BYTES = 1 << 20


def worker_store() -> dict:
    """A dictionary that lives as long as the Python process, for vocabularies and word caches."""
    return sys.modules.setdefault("_gondola_worker_store", types.ModuleType("_gondola_worker_store")).__dict__


def trim() -> None:
    """Give freed memory back to the system, at the end of a task: worker processes are used again by later stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker_value(key, make):
    store = worker_store()
    if key not in store:
        store[key] = make()
    return store[key]


#: A hash joins two polynomials with different bases modulo this prime, so that no pattern of letters cancels out as it does modulo a power of two.
PRIME = (1 << 31) - 1
BASES = 2
_P, _SHIFT = np.uint64(PRIME), np.uint64(31)


def residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place, for x below 2**62."""
    for _ in range(2):
        high = x >> _SHIFT
        x &= _P
        x += high
    x[x >= _P] -= _P
    return x


def byte_tables() -> list[np.ndarray]:
    """For each base fixed random numbers below PRIME for the byte values."""
    return worker_value("byte_tables", lambda: [np.random.default_rng(20240229 + i).integers(1, PRIME, 256, dtype=np.uint64) for i in range(BASES)])


def white_table() -> np.ndarray:
    def make():
        t = np.zeros(256, bool)
        t[list(WHITE_BYTES)] = True
        return t

    return worker_value("white_table", make)


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers modulo PRIME and their inverses, for exponents below n."""

    def series(base: int, m: int) -> np.ndarray:
        out = np.ones(m, np.uint64)
        have = 1
        while have < m:
            more = min(have, m - have)
            out[have : have + more] = residue(out[:more] * np.uint64(pow(base, have, PRIME)))
            have += more
        return out

    have = worker_store().get("powers")
    if have is None or len(have[0][0]) < n:
        m = max(n, 1 << 16)
        bases = [int(np.random.default_rng(97 + i).integers(1 << 20, PRIME - 1)) for i in range(BASES)]
        have = [(series(b, m), series(pow(b, -1, PRIME), m)) for b in bases]
        if m <= 1 << 21:  # longer ones are made when needed
            worker_store()["powers"] = have
    return [(up[:n], down[:n]) for up, down in have]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing bijection of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(buf: np.ndarray) -> list[np.ndarray]:
    """For each base the sums P with P[i] that of the first i bytes; see substring_hashes."""
    out = []
    for (up, _), table in zip(powers(len(buf)), byte_tables(), strict=True):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(residue(table[buf] * up), out=sums[1:], dtype=np.uint64)  # below 2**31 each, so below 2**62 for 2 GB
        out.append(sums)
    return out


def substring_hashes(prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], 62 bits spread over 64; equal strings have equal hashes wherever they stand."""
    one, two = (residue(residue(sums[end] - sums[start]) * down[start]) for sums, (_, down) in zip(prefix, powers(max(len(prefix[0]), 1)), strict=True))
    return mix((one << _SHIFT | two) + mix((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more entry than texts)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = lower_ascii(buf)
    word = np.zeros(len(buf) + 1, bool)
    word[1:] = ~white_table()[buf]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[0::2], edge[1::2]
    hashes = substring_hashes(prefix_hashes(buf), start, end)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return hashes, np.searchsorted(start, first)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles of one text's word hashes; of fewer words, all as one."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    return np.unique(h)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Runs of rows with about so many bytes of the column's text, and that text as UTF-8."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.empty(0)
    cut, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield batch.slice(cut, i + 1 - cut), texts.slice(cut, i + 1 - cut).to_pylist()
            cut, total = i + 1, 0
    if cut < len(texts):
        yield batch.slice(cut), texts.slice(cut).to_pylist()
