"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document starts with the weight 1. Among all weights of at most MOST with which
every source has its target of words, sum(weight * size) = target, the mix takes the
ones nearest to the start in relative entropy. Their dual is convex with one
multiplier a source, and the weights are exponential tilts, exp(lambda * size / scale),
cut at MOST: of a source that must grow long documents grow most, of one that must
shrink they shrink most. Each Newton step is one aggregation over the
table of (source, size) counts, which gives all sources their words and the curvature
at their multipliers; a step that leaves the interval known to hold the solution is
replaced by its middle.

Weights are then rounded to whole copies on the same table: in falling size, the n-th
document gets an extra copy whenever the running sum of weights passes a half, which
leaves an error below one large document; smallest documents then make up for it.
Which documents of a cell get the copies is settled by a hash order within bins of
bounded size, so that no cell has to pass through one task. Sums that decide are of
whole numbers or decimals, so that reruns agree.

One task handles the distinct sizes of a source (as many as the longest document has
words, at most), and one the row that each source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gondola.llm.frames import cut, fits, forget, is_word_count, small

#: No target is over so many times its source, and no document is taken more often.
MOST = 3
#: Newton steps after which the solution must be found (as a rule it takes about ten).
NEWTON_STEPS = 200
#: Longest Newton step, and the share of the target that sums may miss it by.
LONGEST_STEP, TOLERANCE = "4D", "1e-12D"
#: Multipliers are kept to a billionth, rates to a millionth.
FINE, UNIT = 1_000_000_000, 1_000_000
#: Documents in a bin of one (source, size) cell, about.
BIN = 2000


def source_targets(sizes: DataFrame, weight: Column | None = None) -> DataFrame:
    """Columns rank, weight and target added to rows source, source_size (one a source, null last by code point).

    weight: of a source, by default 1, 2, 3, 1, ... by rank. Targets share all sizes by
    weight and stop at MOST times the source's size, the excess being shared again by
    weight: target = min(MOST * size, level * weight). The level comes from running sums
    over sources in the order in which they reach their limit. The rows that meet in one
    task are one a source. Sources of size 0 have target 0.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("rank", F.row_number().over(order))
    rows = rows.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double") if weight is None else weight)
    limit = MOST * F.col("source_size")
    by_ratio = W.orderBy(limit / F.col("weight"), "rank")
    all_rows = W.partitionBy()
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    level = (F.col("total") - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("_level", level)
    # the first source (by ratio) that its level doesn't fill to the limit sets the level of all after it
    rows = rows.withColumn("level", F.min(F.when(F.col("_level") * F.col("weight") <= limit, F.struct(limit / F.col("weight"), "rank", F.col("_level").alias("level")))).over(all_rows)["level"])
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(limit.cast("double"), F.coalesce(F.col("level") * F.col("weight"), limit.cast("double"))))
    return rows.withColumn("target", target).drop("total", "weights", "_level", "level")


def tilt(multiplier: str, size: str, scale: str) -> str:
    """SQL for the weight of a document, cut at MOST."""
    return f"least({MOST}D, exp(least(2D, {multiplier} * {size} / {scale})))"


def balance(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with scale (words of a document on average) and lambda (in FINE parts; null where all documents are taken MOST times or the source is empty).

    counts: source, size, n; targets: source, source_size, target. Raises if a source has no solution after NEWTON_STEPS.
    """
    cells = counts.where("size > 0").select(F.col("source").alias("_c"), "size", "n")
    documents = counts.groupBy(F.col("source").alias("_d")).agg(F.sum("n").alias("_n"), F.count("*").alias("cells"))
    state = targets.join(small(cut(documents, "documents")), F.expr("source <=> _d")).drop("_d")
    state = state.withColumn("scale", F.col("source_size") / F.col("_n")).drop("_n")
    at, low, high = (F.lit(x).cast("double") for x in (0.0, None, None))
    settled = (F.col("source_size") == 0) | (F.col("target") >= MOST * F.col("source_size"))
    state = cut(state.withColumn("at", F.when(~settled, at)).withColumn("low", low).withColumn("high", high).withColumn("done", settled), "balance")
    remaining = state.where("not done").count()
    kept = [c for c in state.columns if c not in ("at", "low", "high", "done")]
    ahead = F.broadcast if fits(state) else lambda df: df  # all tables of a row a source are alike
    for _ in range(NEWTON_STEPS):
        if not remaining:
            lam = F.floor(F.col("at") * FINE + 0.5).cast("long")
            return state.withColumn("lambda", lam).drop("at", "low", "high", "done", "cells")
        open_ones = state.where("not done").selectExpr("source as _s", "at as _at", "scale as _scale")
        each = cells.join(ahead(open_ones), F.expr("_c <=> _s")).selectExpr("_c", "n * size as words", "size / _scale as long", f"{tilt('_at', 'size', '_scale')} as w")
        total = "cast(sum(cast({} as decimal(38, 12))) as double)".format
        sums = each.groupBy("_c").agg(F.expr(total("w * words")).alias("words"), F.expr(total(f"if(w < {MOST}, w * words * long, 0)")).alias("bend"))
        moved = state.join(ahead(sums), F.expr("source <=> _c and not done"), "left").selectExpr("*", "target - words as gap")
        step = f"at + greatest(-{LONGEST_STEP}, least({LONGEST_STEP}, try_divide(gap, bend))) as step"
        moved = moved.selectExpr("*", f"done or abs(gap) <= {TOLERANCE} * target + 1e-11D * cells as near", "if(gap > 0, at, low) as _low", "if(gap < 0, at, high) as _high", step)
        inside = "bend > 0 and step > coalesce(_low, -1e300D) and step < coalesce(_high, 1e300D)"
        beyond = f"coalesce((_low + _high) / 2, at + if(gap > 0, {LONGEST_STEP}, -{LONGEST_STEP}))"
        moved = moved.selectExpr("*", f"case when near then at when {inside} then step else {beyond} end as _next")
        moved = moved.select(*kept, F.expr("_next as at"), F.expr("_low as low"), F.expr("_high as high"), F.expr("near or _next <=> at as done"))
        seen = Observation()
        after = cut(moved.observe(seen, F.count_if(~F.col("done")).alias("remaining")), "balance")
        remaining = seen.get["remaining"]
        forget(state)
        state = after
    raise ValueError("no solution for the sources' targets")


def _cells(counts: DataFrame, balanced: DataFrame) -> DataFrame:
    """For each (source, size): its documents n, and the number k of them that get an extra copy over the whole ones."""
    balanced = balanced.select(F.col("source").alias("t_source"), "source_size", "target", "scale", "lambda")
    cells = counts.join(small(balanced), F.expr("source <=> t_source")).drop("t_source")
    rate = F.expr(f"cast(floor({tilt(f'lambda / {FINE}', 'size', 'scale')} * {UNIT} + 0.5D) as long)")
    rate = F.when(F.col("source_size") == 0, F.lit(0)).when(F.col("lambda").isNull(), F.lit(MOST * UNIT)).otherwise(rate)
    cells = cells.withColumn("_rate", rate).withColumn("whole", F.least(F.expr(f"_rate div {UNIT}"), F.lit(MOST - 1)))
    cells = cells.withColumn("_part", F.col("_rate") - F.col("whole") * UNIT)
    down = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumn("_n", F.sum(F.col("_part") * F.col("n")).over(down))
    cells = cells.withColumn("k", F.expr(f"(_n + {UNIT // 2}) div {UNIT} - (_n - _part * n + {UNIT // 2}) div {UNIT}"))
    # what the picks miss the target by, made up for by the smallest documents that can change
    everything = W.partitionBy("source")
    cells = cells.withColumn("_miss", F.col("target") - F.sum((F.col("whole") * F.col("n") + F.col("k")) * F.col("size")).over(everything))
    room = F.when(F.col("size") == 0, 0).when(F.col("_miss") > 0, F.col("n") - F.col("k")).otherwise(F.col("k"))
    cells = cells.withColumn("_room", room)
    up = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_left", F.abs("_miss") - F.coalesce(F.sum(F.col("_room") * F.col("size")).over(up), F.lit(0)))
    change = F.when(F.col("_left") <= 0, 0).otherwise(F.least(F.col("_room"), F.floor(F.col("_left") / F.greatest("size", F.lit(1)) + 0.5)))
    cells = cells.withColumn("k", F.col("k") + F.when(F.col("_miss") > 0, change).otherwise(-change))
    return cells.select(F.col("source").alias("_c_source"), F.col("size").alias("_c_size"), F.col("n").alias("_n"), "source_size", "target", F.col("whole").alias("_whole"), F.col("k").alias("_k"))


def _bin() -> Column:
    """The bin of a cell's document: bins follow one another in hash order."""
    return F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.ceil(F.col("_n") / BIN) / (1 << 32))


def mix(df: DataFrame, key: Column, text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """All rows and columns with size, source_size, target, copies and taken (of clashing names the new ones stay;
    names that begin with _ are kept for inner use).

    size is the text's number of words (null: 0). copies is how often the mix takes the
    document, 0 to MOST; taken = copies * size. Among documents of one source and size the md5 of key
    decides: rows with equal keys, and so repeated rows, are told apart by nothing and may
    get different copies. Documents of size 0 have the weight 1 (0 in a source of size 0). The null
    source is a source of its own. No rows give no rows.
    """
    df = df.drop("size", "source_size", "target", "copies", "taken")
    docs = df.withColumn("size", is_word_count(F.col(text))).withColumn("_s", F.col(source)).withColumn("_h", F.md5(F.coalesce(key.cast("string"), F.lit(""))))
    counts = cut(docs.groupBy(F.col("_s").alias("source"), "size").agg(F.count("*").alias("n")), "sizes")
    per_source = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = cut(source_targets(per_source, weight), "targets")
    cells = cut(_cells(counts, balance(counts, targets)), "cells")
    cells = small(cells)
    place = docs.join(cells, F.expr("_s <=> _c_source and size = _c_size")).drop("_c_source", "_c_size")
    place = place.withColumn("_bin", _bin())
    bins = docs.select("_s", "size", "_h").join(cells, F.expr("_s <=> _c_source and size = _c_size")).where(f"_n > {BIN} and _k > 0 and _k < _n")
    bins = bins.groupBy(F.col("_s").alias("_b_source"), F.col("size").alias("_b_size"), _bin().alias("_b_bin")).agg(F.count("*").alias("m"))
    bins = bins.withColumn("_before", F.sum("m").over(W.partitionBy("_b_source", "_b_size").orderBy("_b_bin").rowsBetween(W.unboundedPreceding, -1))).drop("m")
    placed = place.join(small(cut(bins, "bins")), F.expr("_s <=> _b_source and size = _b_size and _bin = _b_bin"), "left").drop("_b_source", "_b_size", "_b_bin")
    order = W.partitionBy("_s", "size", "_bin").orderBy("_h")
    extra = (F.coalesce("_before", F.lit(0)) + F.row_number().over(order) <= F.col("_k")).cast("long")
    placed = placed.withColumn("copies", F.col("_whole") + extra).withColumn("taken", F.col("copies") * F.col("size"))
    return placed.drop("_s", "_h", "_bin", "_before", "_n", "_whole", "_k")
