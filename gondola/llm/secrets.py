"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Spans are found with SQL functions: the pieces between matches (split) and the
matches give every start by running sums. Tokens of 20 characters and more with
letters are tested further. Their encoding (hex, base32, base64) is inferred from
their characters. Two p-values a token go under Benjamini-Hochberg limits within
strata of token length, over all tokens of the corpus. Against randomness: the least
of chi-squared uniformity over the alphabet, runs above and below the alphabet's
middle, and serial correlation, times three; a token below the limit is structured.
Against structured text of the same encoding: chi-squared again (its coincidences
are fewer than the letters of text give) and the runs of character classes (in single
case those of letters and digits), joined by Fisher's method; a token below the limit
and not structured is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The fixed patterns (letters of the first in either case).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the same as AKIA[A-Z0-9]+ with 16 characters or more: a run has its longest match at its first AKIA
HEX = r"[0-9a-f]{32,}"  # likewise: a match is a whole run
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Share of false discoveries, and the chance of a class change between neighbours in structured text.
DISCOVERY_RATE, CHANGE_RATE = 0.01, 0.12
#: The same chance in single-case text, where only letters and digits change: one number in 33 characters.
SINGLE_RATE = 0.06
#: Structured text: its letters' frequencies (a to z, per thousand) and each encoding's share of digits and their number.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 1.5, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 1.5, 20, 0.7)
DIGITS = {"hex": (0.5, 10), "base32": (0.2, 6), "base64": (0.1, 10)}
#: Lower limits of the strata of token length.
STRATA = (20, 32, 64, 128)
#: Steps of a p-value's tenfold logarithm in the table that finds the limits.
STEPS = 3000


def running(array: Column, join) -> Column:
    """Of each element the join (an associative function, such as sum) of all up to it, by doubling steps: n elements take n * log2(n) operations."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(array), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    further = lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, join(F.get(acc, i - d), x)).otherwise(x))
    return F.when(F.size(array) < 2, array).otherwise(F.aggregate(steps, array, further))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, kind rank, end, match) of all matches, in code points; no match or null: empty."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), F.length)

    def placed(pairs):
        ends = running(F.transform(pairs, lambda x: x["piece"] + F.coalesce(F.length(x["match"]), F.lit(0))), lambda a, b: a + b)
        span = lambda x: F.struct((x["end"] - F.length(x["match"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["match"].alias("match"))
        found = F.transform(F.arrays_zip(ends.alias("end"), F.transform(pairs, lambda x: x["match"]).alias("match")), span)
        return F.filter(found, lambda s: s["match"].isNotNull())

    return F.when(text.rlike(pattern), _bound(F.arrays_zip(pieces.alias("piece"), matches.alias("match")), placed)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>"))


def apart(tokens: Column, base: Column) -> Column:
    """The tokens (spans that don't overlap one another) that overlap no base span."""
    none = 1 << 30
    marked = lambda spans, token: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(token).alias("token"), x.alias("span")))

    def free(rows):
        # the furthest end of base spans that begin no later, and the next start of a base span after
        reach = running(F.transform(rows, lambda x: F.when(x["token"] == 1, F.lit(-1)).otherwise(x["span"]["end"])), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(rows, lambda x: F.when(x["token"] == 1, F.lit(none)).otherwise(x["start"]))), F.least))
        judged = F.arrays_zip(rows.alias("row"), reach.alias("reach"), ahead.alias("ahead"))
        kept = F.filter(judged, lambda j: (j["row"]["token"] == 1) & (j["reach"] <= j["row"]["start"]) & (j["ahead"] >= j["row"]["span"]["end"]))
        return F.transform(kept, lambda j: j["row"]["span"])

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(_bound(F.array_sort(F.concat(marked(tokens, 1), marked(base, 0))), free))


def _upper_tail(z: Column) -> Column:
    """P(normal > z), by a logistic form that is off by 0.0003 at most, bounded to the STEPS' range."""
    return 1.0 / (1.0 + F.exp(F.least(F.lit(600.0), F.greatest(F.lit(-600.0), z * 1.5976 + z * z * z * 0.070565992))))


def _let(array: Column, name: str, value) -> Column:
    """The array of structs with one more field, a function of the struct."""
    return F.transform(array, lambda x: x.withField(name, value(x)))


def _changes(classes: Column) -> Column:
    """Places of a string of 0 and 1 where neighbours differ."""
    n = F.length(classes)
    return ((n - F.length(F.replace(classes, F.lit("01"), F.lit("")))) + (n - F.length(F.replace(classes, F.lit("10"), F.lit(""))))) / 2.0


def _by_encoding(x: Column, value) -> Column:
    out = value(ALPHABETS["base64"])
    return F.when(x["encoding"] == "hex", value(ALPHABETS["hex"])).when(x["encoding"] == "base32", value(ALPHABETS["base32"])).otherwise(out)


def _coincidence(encoding: str, order: int) -> float:
    """Chance that so many characters of structured text are one."""
    letters = LETTERS[:6] if encoding == "hex" else LETTERS
    share, digits = DIGITS[encoding]
    return (1 - share) ** order * sum((x / sum(letters)) ** order for x in letters) + share**order * digits ** (1 - order)


def _of_encoding(x: Column, value) -> Column:
    return F.when(x["encoding"] == "hex", value("hex")).when(x["encoding"] == "base32", value("base32")).otherwise(value("base64"))


def _few_coincidences(x: Column) -> Column:
    """P(structured text has no more pairs of equal characters than the token), from chi-squared, which is linear in them."""
    k2, k3 = _of_encoding(x, lambda e: F.lit(_coincidence(e, 2))), _of_encoding(x, lambda e: F.lit(_coincidence(e, 3)))
    n = x["n"]
    pairs = (x["chi"] + n) * n / x["size"] - n
    spread = 2 * n * (n - 1) * (k2 - k2 * k2) + 4 * n * (n - 1) * (n - 2) * (k3 - k2 * k2)
    return _upper_tail((n * (n - 1) * k2 - pairs - 1) / F.sqrt(spread))


def _many_changes(x: Column) -> Column:
    """P(structured text has as many changes of class), the binomial tail bounded from above by a geometric series."""
    rate = _of_encoding(x, lambda e: F.lit(CHANGE_RATE if e == "base64" else SINGLE_RATE))
    m, k = x["n"] - 1, x["runs"] - 1
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1.0)).cast("int"))
    log = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((m - i + 1) / i)) + k * F.log(rate) + (m - k) * F.log(1 - rate)
    ratio = (m - k) / (k + 1) * rate / (1 - rate)
    return F.when(k > m * rate, F.least(F.lit(1.0), F.exp(log) / (1 - ratio))).otherwise(1.0)


def _score(p: Column) -> Column:
    """-10 log10 of a p-value, rounded down."""
    return F.greatest(F.lit(0), F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-300)))), F.lit(STEPS)))


def tested_tokens(text: Column) -> Column:
    """Array of the text's tokens with letters: start, kind, end, match, stratum, structured and score (-10 log10 of the p-values against randomness and against structured text)."""
    found = F.filter(_spans(text, TOKEN, "random"), lambda s: s["match"].rlike("[A-Za-z]"))
    found = _let(found, "encoding", lambda x: F.when(x["match"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(x["match"].rlike("^[A-Z2-7]+$"), "base32").otherwise("base64"))
    found = _let(found, "word", lambda x: F.when(x["encoding"] == "hex", F.lower(x["match"])).otherwise(F.translate(x["match"], "-_", "+/")))
    found = _let(found, "n", lambda x: F.length(x["word"]).cast("double"))
    found = _let(found, "size", lambda x: _by_encoding(x, lambda a: F.lit(float(len(a)))))
    found = _let(found, "chars", lambda x: F.regexp_extract_all(x["word"], F.lit("."), F.lit(0)))
    found = _let(found, "codes", lambda x: F.transform(x["chars"], lambda c: _by_encoding(x, lambda a: F.instr(F.lit(a), c)).cast("double")))
    # chi-squared uniformity, made normal by the cube root
    square = lambda x: F.aggregate(F.array_distinct(x["chars"]), F.lit(0.0), lambda s, c: s + F.pow(x["n"] - F.length(F.replace(x["word"], c, F.lit(""))), F.lit(2.0)))
    found = _let(found, "chi", lambda x: x["size"] / x["n"] * square(x) - x["n"])
    found = _let(found, "z_chi", lambda x: (F.pow(x["chi"] / (x["size"] - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (x["size"] - 1)))) / F.sqrt(2 / (9 * (x["size"] - 1))))
    # runs above and below the alphabet's middle
    found = _let(found, "bits", lambda x: _by_encoding(x, lambda a: F.translate(x["word"], a, "0" * (len(a) // 2) + "1" * (len(a) // 2))))
    found = _let(found, "ones", lambda x: F.length(F.replace(x["bits"], F.lit("0"), F.lit(""))).cast("double"))
    found = _let(found, "mu", lambda x: 2 * x["ones"] * (x["n"] - x["ones"]) / x["n"] + 1)
    found = _let(found, "z_runs", lambda x: F.when(x["mu"] <= 2, 99.0).otherwise(F.abs(_changes(x["bits"]) + 1 - x["mu"]) / F.sqrt((x["mu"] - 1) * F.greatest(x["mu"] - 2, F.lit(1e-9)) / (x["n"] - 1))))
    # correlation of neighbouring codes
    found = _let(found, "mean", lambda x: F.aggregate(x["codes"], F.lit(0.0), lambda s, c: s + c) / x["n"])
    found = _let(found, "spread", lambda x: F.aggregate(x["codes"], F.lit(0.0), lambda s, c: s + (c - x["mean"]) * (c - x["mean"])))
    last = lambda x: x["n"].cast("int") - 1
    products = lambda x: F.zip_with(F.slice(x["codes"], 1, last(x)), F.slice(x["codes"], F.lit(2), last(x)), lambda a, b: (a - x["mean"]) * (b - x["mean"]))
    found = _let(found, "z_serial", lambda x: F.when(x["spread"] <= 0, 99.0).otherwise(F.abs(F.aggregate(products(x), F.lit(0.0), lambda s, c: s + c)) / F.greatest(x["spread"], F.lit(1e-9)) * F.sqrt(x["n"])))
    least = lambda x: F.least(_upper_tail(x["z_chi"]), 2 * _upper_tail(x["z_runs"]), 2 * _upper_tail(x["z_serial"]))
    # against structured text: coincidences, and changes between lower case, upper case, digits and the rest
    found = _let(found, "runs", lambda x: F.regexp_count(x["match"], F.lit("[a-z]+|[A-Z]+|[0-9]+|[+/_-]+")).cast("double"))
    found = _let(found, "both", lambda x: F.greatest(_few_coincidences(x) * _many_changes(x), F.lit(1e-300)))
    found = _let(found, "p", lambda x: x["both"] * (1 - F.log(x["both"])))

    def stratum(x):
        out = F.lit(STRATA[0])
        for low in STRATA[1:]:
            out = F.when(x["n"] >= low, low).otherwise(out)
        return out

    keep = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["match"].alias("match"), stratum(x).alias("stratum"), _score(3 * least(x)).alias("structured"), _score(x["p"]).alias("score"))
    return F.transform(found, keep)


def discovery_limits(df: DataFrame, text: str = "text") -> dict[tuple[str, int], int]:
    """Per test (structured, score) and stratum the least score that Benjamini-Hochberg accepts over all tokens of the rows (two rows a stratum reach the driver)."""
    tokens = df.where(F.col(text).rlike(TOKEN)).select(F.explode(tested_tokens(F.col(text))).alias("t"))
    tests = F.array(*[F.struct(F.lit(c).alias("test"), F.col(f"t.{c}").alias("score")) for c in ("structured", "score")])
    counts = tokens.select("t.stratum", F.explode(tests).alias("s")).groupBy("s.test", "stratum", "s.score").agg(F.count("*").alias("n"))
    counts = counts.withColumn("m", F.sum("n").over(W.partitionBy("test", "stratum")))
    counts = counts.withColumn("k", F.sum("n").over(W.partitionBy("test", "stratum").orderBy(F.col("score").desc())))
    accepted = counts.where(F.pow(F.lit(10.0), -F.col("score") / 10.0) <= F.col("k") * DISCOVERY_RATE / F.col("m"))
    return {(r["test"], r["stratum"]): r["score"] for r in accepted.groupBy("test", "stratum").agg(F.min("score").alias("score")).collect()}


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns with secrets: array of (start, kind, end, match) by start, then kind as in KINDS (kind is its place there).

    Null and empty texts have none. Repeated rows have the same each. A column called
    secrets is replaced. Random tokens that overlap a fixed pattern's match aren't listed.
    """
    limits = discovery_limits(df, text)
    out = df.withColumn("_t", F.col(text))
    t = F.col("_t")
    assign = F.filter(_spans(t, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8)
    out = out.withColumn("_base", F.array_sort(F.concat(assign, _spans(t, ACCESS, "access"), _spans(t, HEX, "hex"))))
    more = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    if any(test == "score" for test, _ in limits):
        least = lambda test, x: F.element_at(F.create_map(*[F.lit(v) for low in STRATA for v in (low, limits.get((test, low), STEPS + 1))]), x["stratum"])
        good = F.filter(tested_tokens(t), lambda x: (x["structured"] < least("structured", x)) & (x["score"] >= least("score", x)))
        more = apart(F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["match"].alias("match"))), F.col("_base"))
    return out.withColumn("secrets", F.array_sort(F.concat("_base", more))).drop("_t", "_base")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind)))


def described(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by [SECRET]; spans are sorted by start."""

    def cut_out(raw):
        # of each span the furthest end of those before it; a span that begins earlier belongs to their run
        ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        before = F.concat(F.array(F.lit(0)), ends)
        gaps = F.filter(F.transform(F.arrays_zip(spans.alias("s"), before.alias("before")), lambda x: F.struct(x["before"].alias("a"), x["s"]["start"].alias("b"))), lambda g: g["a"] <= g["b"])
        gaps = F.concat(gaps, F.array(F.struct(F.element_at(ends, -1).alias("a"), F.length(text).alias("b"))))
        # four bytes a code point, so that a piece is found without counting through the text
        return F.array_join(F.transform(gaps, lambda g: F.decode(F.substring(raw, 4 * g["a"] + 1, 4 * (g["b"] - g["a"])), "UTF-32")), "[SECRET]")

    return F.when(F.size(spans) == 0, text).otherwise(_bound(F.encode(text, "UTF-32"), cut_out))
