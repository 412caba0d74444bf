"""Token ids in binary files: frequency ranks in byte-aligned variable-length coding.

Each id is replaced by its rank in corpus frequency, and a rank takes 1 to 4 bytes.
The lengths stand apart from the data, four to a control byte, so that a block is
decoded by looking its control bytes up in a numpy table. A shard is a sequence of
blocks: a header of six 64-bit numbers (magic, documents, ids, control bytes, data
bytes, first id's place in the shard), null flags, document ids, id counts, control
bytes, data. ranks.bin holds the ids by rank as 32-bit numbers; starts.bin has three
64-bit numbers a shard (part, number, place of its first id). Shards are named by part
and number in document order, so the ids of all files form one stream.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.hashing import prefix_hashes, slices, substring_hashes, worker_value

MAGIC = 0x31425647
#: Ids of whole documents that fill a block (a longer document is a block of its own).
BLOCK_IDS = 1 << 20
#: Units that a worker remembers; beyond, it starts anew (the result is the same).
MOST_UNITS = 2_000_000
#: Bytes of one text handled at once, about.
PIECE_BYTES = 1 << 21
#: A letter with a blank after it, where a unit ends.
WORD_BLANK = re.compile(rb"[A-Za-z](?= [A-Za-z])")
#: A shard file is closed after so many bytes.
SHARD_BYTES = 1 << 27

#: Units without white space but a leading blank, and without any.
LED, PLAIN = re.compile(r" \S+"), re.compile(r"\S+")
#: Classes of characters by their first byte. Between two different ones of LETTER, NUMBER and MARK a word of the vocabulary's pattern ends for certain.
WHITE, LETTER, NUMBER, MARK, SOLID, UNSURE = range(6)


def _classes() -> np.ndarray:
    """The class of a byte: SOLID stands for characters that are no white space but otherwise unknown, UNSURE for those that may be."""
    out = np.full(256, SOLID, np.uint8)
    out[:33] = UNSURE  # control characters
    out[127:0xC3] = UNSURE
    out[0xE1:0xE4] = UNSURE
    out[[9, 10, 11, 12, 13, 32]] = WHITE
    for b in range(33, 127):
        out[b] = LETTER if chr(b).isalpha() else NUMBER if chr(b).isdigit() else SOLID if chr(b) == "'" else MARK
    out[0xC3] = LETTER
    return out


def unit_starts(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units of the UTF-8 bytes buf begin; first: where the texts do. A unit has the same ids in any text.

    Units begin between two classes of solid characters, at white space after a solid
    character, and after a single line end between solid characters.
    """
    table = worker_value("unit_classes", _classes)
    kind = table[buf]
    if (buf > 127).any():
        lead = np.maximum.accumulate(np.where((buf & 0xC0) != 0x80, np.arange(len(buf)), 0))
        kind = kind[lead]
        sign = np.flatnonzero((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))  # the signs of multiplication and division
        kind[sign] = kind[sign + 1] = SOLID
    before, here = kind[:-1], kind[1:]
    sure = (before >= LETTER) & (before <= MARK)
    solid = sure | (before == SOLID)
    cut = sure & (here >= LETTER) & (here <= MARK) & (before != here) | solid & (here == WHITE)
    end = np.flatnonzero((buf[1:-1] == 10) & solid[:-1] & (here[1:] >= LETTER) & (here[1:] <= SOLID)) + 1
    cut[end] = True
    cut = np.concatenate([[False], cut])
    cut[first] = True
    return np.flatnonzero(cut)


class ByteEncoder:
    """The tokenizers library, asked once for each unit of text and remembered.

    Units are cut where a word of the vocabulary's pattern ends for certain, so each has
    the same ids anywhere. They are looked up by hash in a sorted table and compared byte
    by byte. Texts with special tokens, and ones that aren't UTF-8, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        #: Bytes that each id stands for; a vocabulary's token has a character a byte.
        self.bytes = np.zeros(self.size, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)
        self.start_anew()

    def start_anew(self) -> None:
        #: The units' hashes (sorted), where their ids stand in the pool and how many, where their bytes stand and how many.
        self.one = np.empty(0, np.uint64)
        self.at, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.raw_at, self.raw_size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, self.type), 0
        self.raw, self.raw_used = np.empty(1 << 18, np.uint8), 0

    def ask(self, units: list[str]) -> list[bytes]:
        """The library's ids of each unit; those without inner white space go in runs, parted by blanks or line ends, which are units of their own."""
        out: list[bytes] = [b""] * len(units)
        width = self.type.itemsize
        blank, plain, odd = [], [], []
        for i, u in enumerate(units):
            (blank if LED.fullmatch(u) else plain if PLAIN.fullmatch(u) else odd).append(i)
        for places, between in ((blank, ""), (plain, "\n")):
            parts = [places[i : i + 500] for i in range(0, len(places), 500)]
            texts = [between + between.join([units[i] for i in p]) for p in parts]
            for part, e in zip(parts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.type)
                ends = np.cumsum([len(units[i].encode()) + len(between) for i in part])
                ends = (np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1) * width
                raw, skip = ids.tobytes(), len(between) * width
                for i, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = raw[a + skip : b]
        for i, e in zip(odd, self.library.encode_batch_fast([units[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.type).tobytes()
        return out

    def learn(self, one: np.ndarray, units: list[bytes]) -> None:
        found = self.ask([u.decode() for u in units])
        count = np.array([len(x) for x in found], np.int64) // self.type.itemsize
        size = np.array([len(u) for u in units], np.int64)
        self.pool, at = _appended(self.pool, self.used, np.frombuffer(b"".join(found), self.type)), self.used
        self.raw, raw_at = _appended(self.raw, self.raw_used, np.frombuffer(b"".join(units), np.uint8)), self.raw_used
        place = np.searchsorted(self.one, one)
        self.at, self.raw_at = np.insert(self.at, place, at + np.cumsum(count) - count), np.insert(self.raw_at, place, raw_at + np.cumsum(size) - size)
        self.count, self.raw_size, self.one = np.insert(self.count, place, count), np.insert(self.raw_size, place, size), np.insert(self.one, place, one)
        self.used, self.raw_used = at + int(count.sum()), raw_at + int(size.sum())

    def _known(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.one, one)
        hit = at < len(self.one)
        hit[hit] = self.one[at[hit]] == one[hit]
        return at, hit

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of UTF-8 texts; a very long one is cut between units, so that memory stays bounded."""
        parts = [pieces(t) for t in texts]
        found = self._encode([p for x in parts for p in x])
        last = np.cumsum([len(x) for x in parts]).tolist()
        return [found[b - 1] if len(x) == 1 else np.concatenate(found[b - len(x) : b]) for x, b in zip(parts, last, strict=True)]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        joined = b"".join(texts)
        if any(s in joined for s in self.special) or not _is_utf8(joined):
            some = [i for i in some if _is_utf8(texts[i]) and not any(s in texts[i] for s in self.special)]
        if some:
            self._by_units(texts, some, out)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.type)
        return out

    def _by_units(self, texts: list[bytes], some: list[int], out: list) -> None:
        if len(self.one) > MOST_UNITS:
            self.start_anew()
        raw = b"".join([texts[i] for i in some])
        buf = np.frombuffer(raw, np.uint8)
        first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])])
        start = unit_starts(buf, first[:-1])
        end = np.append(start[1:], len(buf))
        size = end - start
        one, place, unit = np.unique(substring_hashes(prefix_hashes(buf), start, end), return_index=True, return_inverse=True)
        # each unit against the first one of its hash, and those against the remembered ones
        clash = _differ(buf, start, size, buf, start[place][unit], size[place][unit])
        at, hit = self._known(one)
        if not hit.all():
            new = np.flatnonzero(~hit)
            self.learn(one[new], [raw[a:b] for a, b in zip(start[place[new]].tolist(), end[place[new]].tolist(), strict=True)])
            at, _ = self._known(one)
        clash |= _differ(buf, start[place], size[place], self.raw, self.raw_at[at], self.raw_size[at])[unit]
        count, at = self.count[at][unit], self.at[at][unit]
        ends = np.cumsum(count)
        ids = self.pool[np.repeat(at - ends + count, count) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[np.append(np.searchsorted(start, first[:-1]), len(start))]
        for i, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        if clash.any():  # two units with one hash: their texts go to the library
            for i in np.unique(np.searchsorted(first, start[clash], side="right") - 1).tolist():
                out[some[i]] = None


def _appended(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The pool, made longer if needed, with more behind its used entries."""
    while used + len(more) > len(pool):
        pool = np.concatenate([pool, np.empty_like(pool)])
    pool[used : used + len(more)] = more
    return pool


def _differ(buf: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, at: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether buf[start : start + size] and other[at : at + other_size] differ, for each of many; sizes aren't 0."""
    out = size != other_size
    if not len(size):
        return out
    ends = np.cumsum(size)
    inner = np.arange(ends[-1]) - np.repeat(ends - size, size)
    unlike = buf[np.repeat(start, size) + inner] != other[np.minimum(np.repeat(at, size) + inner, len(other) - 1)]
    return out | np.logical_or.reduceat(unlike, ends - size)


def pieces(text: bytes) -> list[bytes]:
    """The text in pieces of about PIECE_BYTES, each a whole number of units."""
    out, at = [], 0
    while len(text) - at > 2 * PIECE_BYTES and (m := WORD_BLANK.search(text, at + PIECE_BYTES)):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


def _is_utf8(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def encoder(path: str) -> ByteEncoder:
    return worker_value(("byte_encoder", path), lambda: ByteEncoder(path))


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of a block of ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


#: Byte lengths of the four ranks of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks of a block."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def _block(docs: list[int | None], ids: list[np.ndarray], rank: np.ndarray, first: int) -> bytes:
    flat = np.concatenate(ids)
    control, data = pack(rank[flat])
    null = np.array([d is None for d in docs], np.uint8)
    head = np.array([MAGIC, len(docs), len(flat), len(control), len(data), first], "<i8")
    return b"".join([head.tobytes(), null.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([len(x) for x in ids], "<i8").tobytes(), control, data])


def blocks(stream):
    """Of each block of an open shard: document ids (None for null), id counts, ranks, first id's place in the shard. One block is in memory at a time."""
    while head := stream.read(48):
        magic, docs, n, controls, size, first = np.frombuffer(head, "<i8").tolist()
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        null, ids, counts = np.frombuffer(stream.read(docs), np.uint8), np.frombuffer(stream.read(8 * docs), "<i8").tolist(), np.frombuffer(stream.read(8 * docs), "<i8")
        yield [None if x else i for i, x in zip(ids, null, strict=True)], counts, unpack(stream.read(controls), stream.read(size), n), first


def shard_name(part: int, number: int) -> str:
    return f"shard-{part:08d}-{number:06d}.gvb"


def encode_rows(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows _doc, _order (hash of the text, for rows that repeat an id), _ids: the ids with end_id, compressed."""

    def run(batches):
        e = encoder(path)
        end, codec = np.array([end_id], e.type).tobytes(), pa.Codec("zstd", 1)
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                found = [x.tobytes() + end for x in e.encode([t or b"" for t in texts])]
                size = pa.array([len(x) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), size, pa.array([codec.compress(x, asbytes=True) for x in found], pa.binary())], ["_doc", "_order", "_size", "_ids"])

    rows = df.select(F.col(doc_id).cast("long").alias("_doc"), F.xxhash64(text).alias("_order"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "_doc long, _order long, _size long, _ids binary")


def _ids(batch: pa.RecordBatch, kind: np.dtype) -> list[np.ndarray]:
    codec = pa.Codec("zstd")
    return [np.frombuffer(codec.decompress(x, n, asbytes=True), kind) for x, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]


def frequency_ranks(encoded: DataFrame, path: str) -> np.ndarray:
    """Ids by falling count over all rows (ties by id), every id of the vocabulary once. At most a row an id reaches the driver."""
    kind, size = encoder(path).type, encoder(path).size

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                total += np.bincount(np.concatenate(_ids(batch.slice(at, 256), kind)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    found = encoded.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[found["id"].to_numpy()] = found["n"].to_numpy()
    return np.argsort(-total, kind="stable")


def write(df: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """Encode all rows and write ranks.bin, starts.bin and the shards to the folder, in ascending doc_id order; returns the number of ids.

    Null texts are empty; null ids come first; rows that repeat an id follow one another
    by a hash of the text, then as they stand in the encoded table. Rows are dealt into
    ranges of all three, so that rows of one id, or none, may fill many tasks. The folder
    is a URI that pyarrow's file systems open on all executors. Texts are encoded once,
    into a table beside the shards; a shard is written aside and moved into place, so a
    repeated task leaves the same file; one that passes shard_bytes is closed and the next
    begun. One row a shard reaches the driver.
    """
    spark = df.sparkSession
    encode_rows(df, path, end_id, doc_id, text).write.parquet(f"{folder}-encoded")
    encoded = spark.read.parquet(f"{folder}-encoded")
    by_rank = frequency_ranks(encoded, path)
    files, base = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(base)
    with files.open_output_stream(f"{base}/ranks.bin") as out:
        out.write(by_rank.astype("<u4").tobytes())
    rank = np.empty(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared, kind = spark.sparkContext.broadcast(rank), encoder(path).type

    def run(batches):
        ranks = shared.value
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        aside = f"{at}/_aside-{task.partitionId()}-{task.taskAttemptId()}"
        out, number, written, done, docs, ids, waiting = None, 0, 0, 0, [], [], 0

        def flush():
            nonlocal out, written, done, docs, ids, waiting
            if docs:
                out = out or fs.open_output_stream(aside)
                block = _block(docs, ids, ranks, done)
                out.write(block)
                docs, ids, waiting, written, done = [], [], 0, written + len(block), done + waiting

        def close():
            nonlocal out, number, written, done
            out.close()
            fs.move(aside, f"{at}/{shard_name(task.partitionId(), number)}")
            row = pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([done], pa.int64())], ["part", "number", "ids"])
            out, number, written, done = None, number + 1, 0, 0
            return row

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                for d, x in zip(some.column(0).to_pylist(), _ids(some, kind), strict=True):
                    docs.append(d)
                    ids.append(x)
                    waiting += len(x)
                    if waiting >= BLOCK_IDS:
                        flush()
                        if written >= shard_bytes:
                            yield close()
        flush()
        if out:
            yield close()

    numbered = encoded.withColumn("_row", F.monotonically_increasing_id())
    order = ("_doc", "_order", "_row")
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    sizes = sorted(tuple(r) for r in ordered.mapInArrow(run, "part int, number int, ids long").collect())
    ends = np.cumsum([0, *(n for _, _, n in sizes)], dtype=np.int64)
    with files.open_output_stream(f"{base}/starts.bin") as out:
        out.write(np.array([(p, k, x) for (p, k, _), x in zip(sizes, ends[:-1].tolist(), strict=True)], "<i8").reshape(-1, 3).tobytes())
    return int(ends[-1])


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 (and ids) of the documents in the folder's files."""
    files, base = pyarrow.fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/ranks.bin") as f:
        ids = np.frombuffer(f.read(), "<u4")
    with files.open_input_stream(f"{base}/starts.bin") as f:
        starts = {shard_name(p, k): x for p, k, x in np.frombuffer(f.read(), "<i8").reshape(-1, 3).tolist()}
    shared = spark.sparkContext.broadcast((ids, starts))

    def run(batches):
        by_rank, first = shared.value
        fs, place = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                name = name.rsplit("/", 1)[1]
                if name not in first:  # of a write that failed
                    continue
                with fs.open_input_stream(f"{place}/{name}") as stream:
                    for docs, counts, ranks, begin in blocks(stream):
                        found = by_rank[ranks].astype("<u4")
                        cuts = np.concatenate([[0], np.cumsum(counts)])
                        view = memoryview(found.tobytes())
                        cols = [pa.array(docs, pa.int64()), pa.array(first[name] + begin + cuts[:-1]), pa.array(counts), pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found.astype(np.int32))))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.gvb").load(folder).select("path").mapInArrow(run, schema)
