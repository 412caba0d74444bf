"""URL filters with redirect equivalence: block decisions pass along redirects and canonical links.

URLs that redirect to one another or name one another as canonical form one
component. A URL's own longest rule decides it; without one, it is blocked if any
URL of its component is blocked by a rule. So an explicit allow goes before every block
that would come from an alias, but is not handed on: between aliases block goes before
allow, or else a blocked page would open by naming an allowed one as canonical. All of
it is joins and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.components import connected_components
from gondola.llm.frames import cut, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)")).otherwise("")


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Columns host, path and _key (host, path and query: one for all schemes and fragments; null without a host) added; of clashing names the new ones stay.

    Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there
    up to ? or # or the end. Null urls and urls without :// have both empty.
    """
    df = df.withColumn("_u", F.col(url))
    df = df.withColumn("_r", F.coalesce(_rest(F.col("_u")), F.lit("")))
    df = df.withColumn("host", F.translate(F.regexp_extract("_r", "^[^/?#]*", 0), UPPER, LOWER)).withColumn("path", F.regexp_extract("_r", "^[^/?#]*([^?#]*)", 1))
    query = F.regexp_extract("_r", "^[^?#]*([?][^#]*)?", 1)
    return df.withColumn("_key", F.when(F.col("host") != "", F.concat("host", "path", query))).drop("_u", "_r")


def match_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Columns rule and _act (its action) of the longest rule that fits each row's host and path, else null.

    rules: host, path, action. A rule fits its host and all subdomains if the path starts
    with the rule's; of rules equally long, the longer host, then the greater text wins.
    Rules with a null are left out. Distinct hosts meet the rules by an equi-join on
    their suffixes, so neither list is limited.
    """
    rules = rules.select(F.col("host").alias("_rule_host"), F.col("path").alias("_rule_path"), F.col("action").alias("_action")).dropna()
    hosts = df.select(F.col("host").alias("_host")).where("host <> ''").distinct()
    labels = F.split("_host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.withColumn("_rule_host", F.explode(suffix)).join(rules, "_rule_host")
    rule = F.struct(F.length(F.concat("_rule_host", "_rule_path")).alias("n"), F.length("_rule_host").alias("h"), F.concat("_rule_host", "_rule_path").alias("rule"), F.col("_rule_path").alias("path"), F.col("_action").alias("action"))
    by_host = cut(fits.groupBy("_host").agg(F.sort_array(F.collect_set(rule), asc=False).alias("_rules")), "rules")
    joined = df.drop("rule").join(small(by_host), F.col("host") == F.col("_host"), "left")
    best = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return joined.withColumn("rule", best["rule"]).withColumn("_act", best["action"]).drop("_host", "_rules")


def _decoded(html: Column) -> Column:
    return F.regexp_replace(html, "(?i)&(?:amp|#0*38|#x0*26);", "&")


def _no_dots(path: Column) -> Column:
    """The path without segments . and .. (one above the root goes)."""

    def step(acc, x):
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    parts = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.array().cast("array<string>"), step)
    # a last segment of dots leaves a folder
    parts = F.when(path.rlike(r"/[.]{1,2}$"), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    return F.when(path.rlike(r"/[.]{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """The target of a link as a whole URL; a relative one is resolved against the URL base."""
    root = F.regexp_extract(base, "^[^/?#]*//[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_extract(base, "^[^/?#]*//[^/?#]*([^?#]*)", 1), "^.*/", 0)
    path, rest = F.regexp_extract(target, "^[^?#]*", 0), F.regexp_extract(target, "^[^?#]*(.*)$", 1)
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    out = F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
    out = out.when(F.startswith(target, F.lit("?")), F.concat(F.regexp_extract(base, "^[^?#]*", 0), target)).when(F.startswith(target, F.lit("#")), F.concat(F.regexp_extract(base, "^[^#]*", 0), target))
    return out.otherwise(F.concat(root, _no_dots(whole), rest))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges a, b of url keys: each page with all its canonical links and refresh targets. Pages without either give none.

    &amp; is decoded; relative targets are resolved against the page's URL, or its first base tag's.
    """
    some = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv")).select(F.col(url).alias("_from"), F.col(html).alias("_html"))

    def targets(tag: str, value: str) -> Column:
        return F.transform(F.regexp_extract_all("_html", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(_decoded(t), value, 1))

    canonical = targets(r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""")
    refresh = targets(r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""")
    base = F.regexp_extract(_decoded(F.regexp_extract("_html", r"(?i)<base\b[^>]*\bhref\s*=[^>]*>", 0)), r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    some = some.select("_from", base.alias("_base"), F.explode(F.concat(canonical, refresh)).alias("_to")).where("_to <> ''")
    some = some.withColumn("_base", F.when(F.col("_base") == "", F.col("_from")).otherwise(resolved(F.col("_from"), F.col("_base"))))
    there = url_parts(some.withColumn("_to", resolved(F.col("_base"), F.col("_to"))), "_to").select("_from", F.col("_key").alias("b"))
    return url_parts(there, "_from").select(F.col("_key").alias("a"), "b").where("a is not null and b is not null")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """All rows and columns with host, path, rule and verdict ('allow' or 'block'); of clashing names the new ones stay.

    redirects: rows from_url, to_url. A row without a rule is blocked if a rule blocks any
    URL of its component; an allow rule of its own always holds. Null urls are allowed.
    Repeated rows get the same verdict each.
    """
    edges = [link_edges(pages, url, html)] if html else []
    if redirects is not None:
        ends = url_parts(redirects.select(F.col("from_url").alias("_f"), F.col("to_url").alias("_t")), "_f").withColumnRenamed("_key", "a")
        edges.append(url_parts(ends, "_t").select("a", F.col("_key").alias("b")))
    judged = match_rules(url_parts(pages.drop("verdict"), url), rules)
    verdict = F.coalesce("_act", F.lit("allow"))
    if edges:
        links = edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])
        found = cut(connected_components(links), "aliases")
        # a key with a scheme before it is a url again
        own = match_rules(url_parts(found.withColumn("_url", F.concat(F.lit("x://"), "node")), "_url"), rules)
        blocked = own.groupBy("component").agg(F.bool_or(F.coalesce(F.col("_act") == "block", F.lit(False))).alias("_blocked")).where("_blocked")
        aliases = cut(found.join(blocked, "component").select(F.col("node").alias("_node"), "_blocked"), "aliases")
        judged = judged.join(small(aliases), F.col("_key") == F.col("_node"), "left")
        verdict = F.coalesce("_act", F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return judged.withColumn("verdict", verdict).drop("_act", "_key", "_node", "_blocked")
