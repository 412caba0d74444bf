"""Suffix arrays by linear grouping, and removal of byte strings that the corpus holds twice.

The corpus-wide search works on anchors. In each 200-byte window the 48-byte string of
least hash is its anchor, so equal windows have equal anchors at equal places, and an
anchor's context is the stretch of all windows that it anchors. Anchors met once
can't be in a repeat. Contexts met twice repeat as a whole. What is left, contexts that
agree with others in part, is brought together by anchor: each context is written as
symbols for its 25-byte blocks (counted from the anchor), a suffix array of all symbols
finds the runs of 7 blocks that come up again, and their windows are compared by hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.frames import cut, small
from gondola.llm.hashing import mix, prefix_hashes, slices, substring_hashes

LENGTH, GRAM, BLOCK = 200, 48, 25
#: Every window of LENGTH bytes holds so many whole blocks in a row.
RUN = LENGTH // BLOCK - 1
#: Symbols that one suffix array is made of, about (an anchor's contexts stay together).
SYMBOLS = 200_000
#: Anchors with more different contexts are worked off run by run and window by window in shuffles instead.
MOST_CONTEXTS = 20_000


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers by grouping along Lyndon prefixes.

    First, suffixes stand in groups by first symbol. Groups are taken in descending order;
    each suffix of the group points to the last suffix before it of a lower group, and the
    suffixes pointed to are split off, by how often they were, into new groups right after
    their old ones. In the end suffixes with one Lyndon prefix form a group. Second, suffixes
    are emitted in ascending order: each lets its predecessor and that one's pointers take
    the next free place of their groups. Nothing is renamed or solved recursively.
    """
    n = len(s)
    if n == 0:
        return np.empty(0, np.int64)
    by = np.argsort(s, kind="stable")
    order = by.tolist()
    fresh = np.concatenate([[True], s[by][1:] != s[by][:-1]])
    starts = np.flatnonzero(fresh)
    group_np, place_np = np.empty(n, np.int64), np.empty(n, np.int64)
    group_np[by] = np.repeat(starts, np.diff(np.append(starts, n)))
    place_np[by] = np.arange(n)
    group, place = group_np.tolist(), place_np.tolist()
    size = [0] * (n + 1)
    for a, b in zip(starts.tolist(), np.diff(np.append(starts, n)).tolist(), strict=True):
        size[a] = b
    prev = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        members = order[start:end] if end - start == 1 else sorted(order[start:end])
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            levels: dict[int, list[int]] = {}
            for p, times in pointed.items():
                levels.setdefault(times, []).append(p)
            for times in sorted(levels, reverse=True):
                moved = levels[times]
                for p in moved:
                    g = group[p]
                    size[g] -= 1
                    last = g + size[g]
                    at, other = place[p], order[last]
                    order[at], order[last] = other, p
                    place[other], place[p] = at, last
                new = [group[p] + size[group[p]] for p in moved]
                for p, g in zip(moved, new, strict=True):
                    group[p] = g
                    size[g] = 0
                for g in new:
                    size[g] += 1
        end = start
    out, free, placed = [-1] * n, {}, bytearray(n)

    def put(j: int) -> None:
        while j >= 0 and not placed[j]:
            g = group[j]
            at = free.get(g, g)
            free[g] = at + 1
            out[at] = j
            placed[j] = 1
            j = prev[j]

    put(n - 1)
    for i in range(n):
        put(out[i] - 1)
    return np.array(out, np.int64)


def anchors(data: bytes) -> tuple[np.ndarray, ...]:
    """Positions of the anchors, first and last start of the windows each anchors, hashes of anchors and of contexts."""
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    prefix = prefix_hashes(np.frombuffer(data, np.uint8))
    at = np.arange(n - GRAM + 1)
    grams = substring_hashes(prefix, at, at + GRAM)
    width = LENGTH - GRAM + 1
    windows = n - LENGTH + 1
    # least gram of each window, the leftmost of equals: least ones from each tile's ends, and where they stand
    key = mix(grams)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    tiles, place = padded.reshape(-1, width), np.arange(width)
    ahead = np.minimum.accumulate(tiles, axis=1)
    fell = np.ones(tiles.shape, bool)
    fell[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fell, place, 0), axis=1)
    back = np.minimum.accumulate(tiles[:, ::-1], axis=1)
    back_at = width - 1 - np.maximum.accumulate(np.where(tiles[:, ::-1] == back, place, 0), axis=1)
    tile = np.arange(len(tiles))[:, None] * width
    begin, end = slice(0, windows), slice(width - 1, width - 1 + windows)
    left, left_at = back[:, ::-1].ravel()[begin], (tile + back_at[:, ::-1]).ravel()[begin]
    right, right_at = ahead.ravel()[end], (tile + ahead_at).ravel()[end]
    chosen = np.where(left <= right, left_at, right_at)
    change = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    pos, first = chosen[change], change
    last = np.append(change[1:], windows) - 1
    context = substring_hashes(prefix, first, last + LENGTH) + mix((pos - first).astype(np.uint64))
    return pos, first, last, grams[pos], context


def occurrences(texts: DataFrame) -> DataFrame:
    """k, pos, lo, hi, h, c of every anchor of the rows k, _text: windows start at pos - lo to pos - lo + hi."""

    def run(batches):
        names = ["k", "pos", "lo", "hi", "h", "c"]
        for batch in batches:
            for part, raw in slices(batch, "_text"):
                found = [anchors(t) for t in raw]
                counts = [len(f[0]) for f in found]
                pos, first, last, h, c = (np.concatenate([f[i] for f in found]) for i in range(5))
                keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                cols = [pos.astype(np.int32), (pos - first).astype(np.int32), (last - first).astype(np.int32), h.view(np.int64), c.view(np.int64)]
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x) for x in cols)], names)

    return texts.mapInArrow(run, "k binary, pos int, lo int, hi int, h long, c long")


def repeated_windows(h: list[int], lo: list[int], contexts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Per context the stretches, from its first byte, of windows that another context has at the same place from its anchor.

    h: anchors; lo: where the anchor stands in the context.
    """
    n = len(contexts)
    size = np.array([len(x) for x in contexts])
    base = np.concatenate([[0], np.cumsum(size)])
    prefix = prefix_hashes(np.frombuffer(b"".join(contexts), np.uint8))
    lo = np.array(lo)
    first, last = -(lo // BLOCK), (size - lo) // BLOCK  # whole blocks of each context, counted from its anchor
    counts = last - first
    owner = np.repeat(np.arange(n), counts)
    block = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + first[owner]
    start = base[owner] + lo[owner] + block * BLOCK
    anchor = np.array(h, np.int64).view(np.uint64)
    value = mix(substring_hashes(prefix, start, start + BLOCK) + mix(anchor[owner] + block.astype(np.int64).view(np.uint64)))
    # symbols in one string; 0 parts the contexts
    where = np.arange(len(owner)) + owner
    symbols = np.zeros(len(owner) + n, np.int64)
    symbols[where] = np.unique(value, return_inverse=True)[1] + 1
    whose, which = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    whose[where], which[where] = owner, block
    order = suffix_array(symbols)
    long_enough = np.zeros(len(symbols), bool)
    if len(symbols) >= RUN:
        long_enough[: len(symbols) - RUN + 1] = np.lib.stride_tricks.sliding_window_view(symbols, RUN).min(axis=1) > 0
    order = order[long_enough[order]]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if len(order) < 2:
        return out
    same = np.ones(len(order) - 1, bool)
    for k in range(RUN):
        same &= symbols[order[1:] + k] == symbols[order[:-1] + k]
    run = np.concatenate([[0], np.cumsum(~same)])
    many = np.bincount(run)[run] > 1
    member, run = order[many], run[many]
    if not len(member):
        return out
    # windows whose first whole block is the run's first
    owner, back = np.repeat(whose[member], BLOCK), np.tile(np.arange(BLOCK), len(member))
    start = lo[owner] + np.repeat(which[member] * BLOCK, BLOCK) - back
    fits = (start >= 0) & (start + LENGTH <= size[owner])
    owner, back, start, run = owner[fits], back[fits], start[fits], np.repeat(run, BLOCK)[fits]
    value = substring_hashes(prefix, base[owner] + start, base[owner] + start + LENGTH)
    value = mix(value + mix(run.astype(np.uint64) * np.uint64(BLOCK) + back.astype(np.uint64)))
    _, kind, times = np.unique(value, return_inverse=True, return_counts=True)
    hit = times[kind] > 1
    for i, a in sorted(zip(owner[hit].tolist(), start[hit].tolist(), strict=True)):
        if out[i] and out[i][-1][1] >= a:
            out[i][-1] = (out[i][-1][0], a + LENGTH)
        else:
            out[i].append((a, a + LENGTH))
    return out


def _stretches(batches):
    """k, start, end of repeated stretches; rows sorted by h: h, k, from (where the context begins), lo, context."""
    rows: list[tuple] = []
    weight = 0

    def done():
        if len(rows) < 2:
            return None
        found = repeated_windows([r[0] for r in rows], [r[3] for r in rows], [r[4] for r in rows])
        flat = [(r[1], r[2] + a, r[2] + b) for r, f in zip(rows, found, strict=True) for a, b in f]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.binary()), *(pa.array([x[i] for x in flat], pa.int32()) for i in (1, 2))], ["k", "start", "end"]) if flat else None

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if weight >= SYMBOLS and row[0] != rows[-1][0]:
                if (found := done()) is not None:
                    yield found
                rows, weight = [], 0
            rows.append(row)
            weight += len(row[4]) // BLOCK + 1
    if (found := done()) is not None:
        yield found


def _windows_by_run(batches):
    """Per context and whole-block run: h, run (hash of its place and bytes), k, start and off (from the anchor) of its first window, hashes of the windows whose first whole block is the run's."""
    names = ["h", "run", "k", "start", "off", "windows"]
    for batch in batches:
        rows = []
        for h, k, begin, lo, context in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
            prefix, size = prefix_hashes(np.frombuffer(context, np.uint8)), len(context)
            at = np.arange(size - LENGTH + 1)
            value = substring_hashes(prefix, at, at + LENGTH).view(np.int64)
            blocks = np.arange(-(lo // BLOCK), (size - lo) // BLOCK - RUN + 1)
            first = lo + blocks * BLOCK
            runs = mix(substring_hashes(prefix, first, first + RUN * BLOCK) + mix(blocks.view(np.uint64))).view(np.int64)
            for run, last in zip(runs.tolist(), first.tolist(), strict=True):
                a, b = max(0, last - BLOCK + 1), min(last, size - LENGTH)
                if a <= b:
                    rows.append((h, run, k, begin + a, a - lo, value[a : b + 1]))
            if len(rows) >= 20_000:
                yield _columns(rows, names)
                rows = []
        if rows:
            yield _columns(rows, names)


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def crowded_stretches(given: DataFrame) -> DataFrame:
    """k, start, end of repeated windows at anchors with very many contexts: runs of blocks met once drop out, the windows of the rest are counted by hash. No anchor has to fit a task."""
    rows = given.mapInArrow(_windows_by_run, "h long, run long, k binary, start int, off int, windows array<long>")
    again = cut(rows.groupBy("h", "run").agg(F.count("*").alias("n")).where("n > 1").select("h", "run"), "runs")
    each = rows.join(small(again), ["h", "run"]).select("h", "k", "start", "off", F.posexplode("windows").alias("i", "w"))
    each = each.select("h", "k", (F.col("start") + F.col("i")).alias("start"), (F.col("off") + F.col("i")).alias("off"), "w")
    twice = each.groupBy("h", "off", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return each.join(twice, ["h", "off", "w"], "left_semi").select("k", "start", F.expr(f"start + {LENGTH}").alias("end"))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most_contexts: int = MOST_CONTEXTS, kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of each row.

    Every byte covered by a LENGTH-byte string that also starts anywhere else in the rows
    goes, judged on the input. Null texts are empty; shorter texts stay whole. Repeated rows
    are copies of one another, so all their bytes go. Texts are told apart by 128-bit hashes,
    anchors, contexts and windows by 64-bit ones.

    The suffix array settles contexts that agree with others in part. Contexts met twice or
    more are whole repeats by their hash alone, and anchors with more than most_contexts
    different contexts, which would not fit one task, are settled by counting; the result is the same.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("k", F.unhex(F.md5("_text")))
    found = occurrences(docs.where(F.octet_length("_text") >= LENGTH).select("k", "_text"))
    often = cut(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    again = cut(found.join(often, "h", "left_semi"), "occurrences")
    kinds = again.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k", "pos", "lo", "hi")).alias("one"))
    kinds = cut(kinds, "contexts")
    several = kinds.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1")
    # one row of each context that has others beside it at its anchor: n = 1 to be settled, more to compare with
    open_ones = cut(kinds.join(several, "h").select("h", "one.*", "n", "contexts"), "open")
    whole = again.join(kinds.where("n > 1").select("h", "c"), ["h", "c"]).select("k", F.expr("pos - lo").alias("start"), F.expr(f"pos - lo + hi + {LENGTH}").alias("end"))
    per_text = open_ones.groupBy("k").agg(F.collect_list(F.struct("h", F.expr("pos - lo").alias("start"), "lo", "hi", "contexts")).alias("asked"))

    def contexts(batches):
        for batch in batches:
            for part, raw in slices(batch, "_text"):
                rows = [(a["h"], k, a["start"], a["lo"], t[a["start"] : a["start"] + a["hi"] + LENGTH], a["contexts"]) for k, asked, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw, strict=True) for a in asked]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["h", "k", "from", "lo", "context", "contexts"])

    # of equal texts one row is asked
    single = docs.groupBy("k").agg(F.min("doc_id").alias("_d")).withColumnRenamed("k", "_k")
    asked = per_text.join(single, F.col("k") == F.col("_k")).select("k", "asked", "_d")
    text_rows = docs.withColumnRenamed("k", "_k").join(asked, (F.col("_k") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    given = text_rows.select("k", "asked", "_text").mapInArrow(contexts, "h long, k binary, from int, lo int, context binary, contexts long")
    given = cut(given, "given")
    settled = given.where(F.col("contexts") <= most_contexts).drop("contexts").repartition("h").sortWithinPartitions("h").mapInArrow(_stretches, "k binary, start int, end int")

    by_window = crowded_stretches(given.where(F.col("contexts") > most_contexts))
    spans = whole.unionByName(settled).unionByName(by_window).distinct().groupBy(F.col("k").alias("_k")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def apply(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            for part, raw in slices(batch, "_text"):
                rows = []
                for d, spans, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), raw, strict=True):
                    merged: list[list[int]] = []
                    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                        if merged and merged[-1][1] >= a:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    cuts = [0, *(x for m in merged for x in m), len(t)]
                    kept = b"".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                    rows.append((d, len(t), len(t) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if kept_text else None))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())], names)

    kind = dict(docs.dtypes)["doc_id"]
    joined = docs.join(spans, F.col("k") == F.col("_k"), "left").select("doc_id", "spans", "_text")
    out = joined.mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if kept_text else out.drop("kept")
