"""MinHash near-duplicates with an LSH forest.

Texts with the same shingle set are one class. Each class's MinHash signature is read
in several orders; in each order all classes are sorted (over range partitions), and
neighbours whose signatures share a prefix long enough are candidates. The depth
asked for adapts to the region: DEPTH values, but fewer (LEAST_DEPTH) where a class has
no neighbour in the order that shares more. Candidates join to clusters, and all links
within a cluster are confirmed on the full shingle sets.

A large cluster is dealt into blocks at random, ROUNDS times anew, and links are
confirmed within the blocks, which is linear in its classes and joins a family of
copies as a rule. What has come together needs no more comparing: only blocks
of different parts of a cluster are compared in pairs, a task each, and of a cluster
that is one part already none. No cluster has to fit one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gondola.llm.components import connected_components
from gondola.llm.frames import cut, small
from gondola.llm.hashing import mix, shingle_hashes, slices, trim, word_hashes, worker_value

#: MinHash values, orders in which they are read, and values of an order's path.
VALUES, ORDERS, PATH = 96, 24, 8
#: Least common prefix of candidates; the shorter one will do for the nearest neighbour that a class has in an order.
DEPTH, LEAST_DEPTH = 6, 4
#: Classes and shingles of a block, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 1000, 400_000
#: Times that large clusters are dealt into blocks at random.
ROUNDS = 2
#: Bytes of text shingled at a time, about.
TEXT_BYTES = 1 << 18
#: Rows with shingle sets taken out of a batch at a time.
ROWS = 500
#: Candidate pairs that a task takes together.
PAIRS = 1 << 17
#: Columns of a dense count matrix at a time.
COLUMNS = 4096
#: Stands for a null id.
NO_ID = -(1 << 63)


def _keys() -> tuple[np.ndarray, np.ndarray]:
    def make():
        r = np.random.default_rng(7)
        return r.integers(0, 1 << 63, VALUES, dtype=np.uint64), r.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    return worker_value("minhash_keys", make)


def _orders() -> np.ndarray:
    def make():
        r = np.random.default_rng(11)
        return np.stack([r.permutation(VALUES)[:PATH] for _ in range(ORDERS)])

    return worker_value("forest_orders", make)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    x, m = _keys()
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[at : at + 2048, None] ^ x) * m).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(">u2")


def shingled(df: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, place (hash of the text), n_shingles, s1, s2 (128 bits that name the set), sig. Null texts and texts without words have no shingles."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "_text", TEXT_BYTES):
                hashes, first = word_hashes([t or b"" for t in texts], lower=True)
                sets = [shingle_hashes(hashes[a:b], words) for a, b in zip(first[:-1], first[1:], strict=True)]
                names = [set_name(x) for x in sets]
                cols = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array([n[i] for n in names], np.int64)) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary())], ["doc_id", "place", "n_shingles", "s1", "s2", "sig"])
        trim()

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, place long, n_shingles long, s1 long, s2 long, sig binary")


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    if not len(shingles):
        return 0, 0
    return tuple(np.array([np.bitwise_xor.reduce(mix(shingles)), np.add.reduce(mix(shingles + np.uint64(99)))], np.uint64).view(np.int64).tolist())


def _paths(batches):
    orders = _orders()
    for batch in batches:
        if batch.num_rows:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, VALUES, 2)
            for t in range(ORDERS):
                path = sigs[:, orders[t]].reshape(len(sigs), -1)
                kind = pa.array(np.full(len(sigs), t, np.int8))
                yield pa.RecordBatch.from_arrays([kind, pa.array([p.tobytes() for p in path], pa.binary()), batch.column(0)], ["t", "path", "rep"])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least one that it reaches over the edges a, b."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        if (label[x] == label[y]).all():
            break
        for end in (x, y):
            np.minimum.at(label, label[end], least)
        while (label[label] != label).any():
            label = label[label]
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def joined(batches):
    """Edges that connect what the pairs a, b of a task connect: PAIRS of them at a time, as stars."""
    held, rows = [], 0

    def done():
        a, b = stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows > PAIRS:
            yield done()
            held, rows = [], 0
    if rows:
        yield done()
    trim()


def near(common, before, after):
    """Whether neighbours with so long a common prefix are candidates; before, after: those of the pairs around."""
    return (common >= DEPTH) | (common >= LEAST_DEPTH) & ((common >= before) | (common >= after))


def _neighbours(batches):
    """Candidate pairs of a sorted run of (order, path, rep); its first and last three rows, with their places, for the seams between runs."""
    part, head, tail, rows, before = TaskContext.get().partitionId(), [], [], 0, -1
    names = ["part", "place", "t", "path", "a", "b"]
    t, path, rep = np.empty(0, np.int8), np.empty((0, PATH), ">u2"), np.empty(0, np.int64)

    def out(place, t, path, a, b):
        kinds = (pa.int64(), pa.int8(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), part, np.int32)), *(pa.array(x, kind) for x, kind in zip((place, t, path, a, b), kinds, strict=True))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        new_t, new_rep = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        new_path = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, PATH)
        ends = [i for i in range(len(new_t)) if i < 3 or i >= len(new_t) - 3]
        ends = [(rows + i, int(new_t[i]), new_path[i].tobytes(), int(new_rep[i])) for i in ends]
        head, tail, rows = (head + ends)[:3], (tail + ends)[-3:], rows + len(new_t)
        t, path, rep = np.append(t, new_t), np.vstack([path, new_path]), np.append(rep, new_rep)
        if len(t) < 3:
            continue
        common = np.cumprod((path[1:] == path[:-1]) & (t[1:] == t[:-1])[:, None], axis=1).sum(axis=1)
        hit = near(common[:-1], np.append(before, common[:-2]), common[1:])
        if rows == len(t):  # the run's first pair is settled with the seams
            hit[0] = False
        a, b = rep[:-2][hit], rep[1:-1][hit]
        yield out([None] * len(a), [None] * len(a), [None] * len(a), a, b)
        t, path, rep, before = t[-2:], path[-2:], rep[-2:], common[-2]
    ends = sorted({*head, *tail})
    if ends:
        place, kind, way, who = zip(*ends, strict=True)
        yield out(place, kind, way, who, who)


def seam_pairs(ends: list[tuple]) -> list[tuple[int, int]]:
    """Candidate pairs of runs' first two rows, last two rows and of one run's last with the next one's first; ends: (run, place, order, path, rep), sorted."""
    last = {e[0]: e[1] for e in ends}
    common = [-1]
    for x, y in zip(ends, ends[1:], strict=False):
        meet = x[2] == y[2] and (x[0] != y[0] or x[1] + 1 == y[1])
        a, b = np.frombuffer(x[3], ">u2"), np.frombuffer(y[3], ">u2")
        common.append(int(np.cumprod(a == b).sum()) if meet else -1)
    common.append(-1)
    out = []
    for i, (x, y) in enumerate(zip(ends, ends[1:], strict=False), 1):
        if (x[0] != y[0] or x[1] == 0 or y[1] == last[y[0]]) and near(common[i], common[i - 1], common[i + 1]):
            out.append((x[4], y[4]))
    return out


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Pairs a, b of neighbours in the forest's orders, repeated ones among them; classes: rep, sig."""
    spark = classes.sparkSession
    paths = classes.select("rep", "sig").mapInArrow(_paths, "t byte, path binary, rep long")
    ordered = paths.repartitionByRange("t", "path", "rep").sortWithinPartitions("t", "path", "rep")
    found = cut(ordered.mapInArrow(_neighbours, "part int, place long, t byte, path binary, a long, b long"), "pairs")
    # six rows a partition at most
    ends = sorted((r["part"], r["place"], r["t"], bytes(r["path"]), r["a"]) for r in found.where("place is not null").collect())
    seams = seam_pairs(ends)
    pairs = found.where("place is null").select("a", "b")
    return pairs.unionByName(spark.createDataFrame(seams, "a long, b long")) if seams else pairs


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    n = len(sets)
    if n == 2:
        both = np.concatenate(sets)
        both.sort()
        same = float((both[1:] == both[:-1]).sum())
        return np.array([[len(sets[0]), same], [same, len(sets[1])]])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    place = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((n, min(COLUMNS, width - at)), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        out += dense @ dense.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def linked(reps: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (class, least class it reaches) over links between different blocks, or of one block if there is but one."""
    order = np.argsort(reps)
    reps, blocks, sets = reps[order], blocks[order], [sets[i] for i in order]
    both = intersections(sets)
    size = np.array([len(s) for s in sets], np.float64)
    link = 100.0 * both >= percent * (size[:, None] + size[None, :] - both)
    if blocks.min() != blocks.max():
        link &= blocks[:, None] != blocks[None, :]
    np.fill_diagonal(link, True)
    label = np.arange(len(reps))
    while True:
        least = np.where(link, label, len(reps)).min(axis=1)
        least = np.minimum(label, least)[np.minimum(label, least)]
        if (least == label).all():
            break
        label = least
    return [(int(reps[i]), int(reps[x])) for i, x in enumerate(label) if i != x]


def shingle_sets(df: DataFrame, members: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """rep, cluster, blocks of the members, with shingles (sorted 64-bit hashes) of the rows that stand for them (by id and place); equal rows give equal rows."""

    def sets(batches):
        for batch in batches:
            for part, texts in slices(batch, "_text", TEXT_BYTES):
                hashes, first = word_hashes([t or b"" for t in texts], lower=True)
                found = [shingle_hashes(hashes[a:b], words) for a, b in zip(first[:-1], first[1:], strict=True)]
                # two texts of one id and place: the one whose set is the member's
                same = pa.array([set_name(x) == (one, two) for x, one, two in zip(found, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)])
                cols = [*part.columns[:3], pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.filter(same) for c in cols], ["rep", "cluster", "blocks", "shingles"])
        trim()

    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    rows = df.select(own.alias("id"), F.xxhash64(text).alias("place"), F.col(text).alias("_text")).join(small(members), ["id", "place"])
    return rows.select("rep", "cluster", "blocks", "s1", "s2", "_text").mapInArrow(sets, "rep long, cluster long, blocks int, shingles binary")


def confirmed_links(tasks: DataFrame, percent: int) -> DataFrame:
    """Edges a, b that connect what the links of 100 * intersection >= percent * union connect within each task.

    tasks: cluster, i, j, block, rep, shingles, a row for each task (cluster, i, j) of a class.
    A task with two blocks looks for links between them only.
    """

    def confirm(batches):
        key, reps, blocks, held = None, [], [], []

        def done():
            if len(reps) < 2:
                return None
            r, at = np.unique(np.array(reps), return_index=True)  # rows that repeat an id stand once
            b = np.array(blocks)[at]
            if len(r) < 2 or key[1] != key[2] and b.min() == b.max():
                return None
            pairs = linked(r, b, [held[i] for i in at], percent)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"]) if pairs else None

        for row in (r for batch in batches for at in range(0, batch.num_rows, ROWS) for r in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True)):
            if row[:3] != key:
                if (found := done()) is not None:
                    yield found
                key, reps, blocks, held = row[:3], [], [], []
            reps.append(row[4])
            blocks.append(row[3])
            held.append(np.frombuffer(row[5], np.uint64))
        if (found := done()) is not None:
            yield found
        trim()

    return tasks.select("cluster", "i", "j", "block", "rep", "shingles").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(confirm, "a long, b long")


def cross_tasks(members: DataFrame) -> DataFrame:
    """Tasks for confirmed_links over all pairs of classes of one cluster but different parts; members: rep, cluster, part, n.

    Parts that fill a block have blocks of their own, which aren't compared with one
    another; the small ones share blocks, whole, and are compared within them too.
    """
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    parts = members.groupBy("cluster", "part").agg(blocks.alias("own"), F.count("*").alias("m"), F.sum("n").alias("w"))
    large = F.col("own") > 1
    cluster = W.partitionBy("cluster")
    shared = F.greatest(F.ceil(F.sum(F.when(~large, F.col("m"))).over(cluster) / BLOCK_CLASSES), F.ceil(F.sum(F.when(~large, F.col("w"))).over(cluster) / BLOCK_SHINGLES))
    parts = parts.withColumn("parts", F.count("*").over(cluster)).where("parts > 1").withColumn("shared", F.coalesce(shared, F.lit(0)).cast("int"))
    before = F.sum(F.when(large, F.col("own")).otherwise(0)).over(cluster.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("low", F.coalesce(before, F.lit(0)) + F.col("shared")).withColumn("total", F.col("shared") + F.sum(F.when(large, F.col("own")).otherwise(0)).over(cluster))
    parts = cut(parts.select(F.col("cluster").alias("_c"), F.col("part").alias("_p"), "own", "shared", "low", "total"), "parts")
    each = members.join(small(parts), (F.col("cluster") == F.col("_c")) & (F.col("part") == F.col("_p")))
    block = F.when(large, F.col("low") + F.pmod(F.xxhash64("rep"), F.col("own"))).otherwise(F.pmod(F.xxhash64("part"), F.col("shared"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), (F.col("total") - 1).cast("int")), lambda j: ~large | (j < F.col("low")) | (j >= F.col("low") + F.col("own")))
    each = each.withColumn("block", block).withColumn("_j", F.explode(others))
    return each.select("rep", "cluster", "block", F.least("block", "_j").alias("i"), F.greatest("block", "_j").alias("j"))


def links_of_clusters(df: DataFrame, members: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Edges a, b that connect what the links within clusters connect; members: rep, cluster, n, id, place, s1, s2."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    members = cut(members.join(members.groupBy("cluster").agg(blocks.alias("blocks")), "cluster"), "members")
    sets = cut(shingle_sets(df, members.drop("n"), words, doc_id, text), "sets")
    block = lambda r: F.pmod(F.xxhash64("rep", F.lit(r)), F.col("blocks")).cast("int")
    rounds = sets.withColumn("block", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array(*[block(r) + r * F.col("blocks") for r in range(ROUNDS)]))))
    edges = cut(confirmed_links(rounds.withColumn("i", F.col("block")).withColumn("j", F.col("block")), percent), "links")
    large = members.where("blocks > 1").select("rep", "cluster", "n")
    if large.limit(1).count():
        found = connected_components(edges).select(F.col("node").alias("_node"), "component")
        parted = cut(large.join(found, F.col("rep") == F.col("_node"), "left").select("rep", "cluster", "n", F.coalesce("component", "rep").alias("part")), "parted")
        tasks = cut(cross_tasks(parted), "tasks")
        # the parts, as stars, stand for the links found so far
        edges = found.select(F.col("_node").alias("a"), F.col("component").alias("b")).unionByName(confirmed_links(sets.where("blocks > 1").select("rep", "shingles").join(small(tasks), "rep"), percent))
    return edges


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    words-word shingles (A-Z lower-cased). component_id is the least id reached over links;
    kept is true for the document with that id. Texts without words and null texts have no
    shingles and no links. Rows are told apart by their sets, not their ids: rows that repeat
    an id each have a row and their own links, and a row with a null id links others, and is
    kept only if no id is in its component (component_id is null then).
    """
    rows = cut(shingled(df, words, doc_id, text), "shingled")
    # a class is a set; of its rows the one of least id and place stands for it
    own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "place")
    classes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min(own).alias("one"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "least", "one.id", "one.place", "n", "sig"), "classes")
    clusters = cut(connected_components(candidate_pairs(classes).mapInArrow(joined, "a long, b long")), "clusters")
    members = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(classes.select("rep", "n", "id", "place", "s1", "s2"), "rep")
    edges = links_of_clusters(df, members, words, percent, doc_id, text)
    found = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("_part"))
    linked = classes.select("rep", "least").join(found, "rep")
    least = found.join(linked.groupBy("_part").agg(F.min("least").alias("_least")), "_part").select("rep", "_least", F.lit(True).alias("_linked"))
    named = classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "rep", "least").join(least, "rep", "left")
    named = named.select("c1", "c2", F.when(F.col("_linked"), F.col("_least")).otherwise(F.col("least")).alias("_component"))
    out = rows.drop("sig", "place").join(named, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
