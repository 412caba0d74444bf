"""DuckDB SQL for the operators that SQL can express."""

from gondola.llm import secrets

OP3 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM docs GROUP BY source
), w AS (
  SELECT *, (((rk - 1) % 3) + 1)::DOUBLE AS weight, 3 * source_size AS lim FROM src
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - 3 * coalesce(sum(source_size) OVER b, 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev
  FROM w WINDOW b AS (ORDER BY lim / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, min_by(CASE WHEN lev * weight <= lim THEN lev END, CASE WHEN lev * weight <= lim THEN (lim / weight, rk) END) OVER () AS level FROM l
), t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(lim::DOUBLE, coalesce(level * weight, lim::DOUBLE)) END AS target FROM g
), counts AS (
  SELECT source, size, count(*) AS n FROM docs GROUP BY source, size
), cells AS (
  SELECT c.source, c.size, c.n, t.source_size, t.target, t.source_size / (sum(c.n) OVER (PARTITION BY c.source))::DOUBLE AS scale
  FROM counts c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), solving AS (
  SELECT source, size, n, scale, target FROM cells WHERE source_size > 0 AND target < 3 * source_size
), halved(step, source, low, high) AS (
  SELECT DISTINCT 0, source, -1000.0::DOUBLE, 2 * scale + 1 FROM solving
  UNION ALL
  SELECT h.step + 1, h.source,
    CASE WHEN sum(s.n * s.size * least(3.0, exp(least(2.0, (h.low + h.high) / 2 * s.size / s.scale)))) < any_value(s.target) THEN (h.low + h.high) / 2 ELSE h.low END,
    CASE WHEN sum(s.n * s.size * least(3.0, exp(least(2.0, (h.low + h.high) / 2 * s.size / s.scale)))) < any_value(s.target) THEN h.high ELSE (h.low + h.high) / 2 END
  FROM halved h JOIN solving s ON h.source IS NOT DISTINCT FROM s.source WHERE h.step < 70 GROUP BY h.step, h.source, h.low, h.high
), solved AS (
  SELECT source, floor((low + high) / 2 * 1e9 + 0.5)::BIGINT AS lam FROM halved WHERE step = 70
), rated AS (
  SELECT c.*, CASE WHEN source_size = 0 THEN 0 WHEN lam IS NULL THEN 3000000
    ELSE floor(least(3.0, exp(least(2.0, lam / 1e9 * size / scale))) * 1000000 + 0.5)::BIGINT END AS rate
  FROM cells c LEFT JOIN solved s ON c.source IS NOT DISTINCT FROM s.source
), k1 AS (
  SELECT *, least(rate // 1000000, 2)::BIGINT AS whole, rate - least(rate // 1000000, 2) * 1000000 AS part FROM rated
), k2 AS (
  SELECT *, ((c + 500000) // 1000000 - (c - part * n + 500000) // 1000000)::BIGINT AS k
  FROM (SELECT *, sum(part * n) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS c FROM k1)
), m AS (
  SELECT *, target - (sum((whole * n + k) * size) OVER (PARTITION BY source))::DOUBLE AS miss FROM k2
), r AS (
  SELECT *, CASE WHEN size = 0 THEN 0 WHEN miss > 0 THEN n - k ELSE k END AS room FROM m
), f AS (
  SELECT *, abs(miss) - coalesce(sum(room * size) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS remains FROM r
), fin AS (
  SELECT source, size, source_size, target, whole, k + (CASE WHEN miss > 0 THEN 1 ELSE -1 END)
    * (CASE WHEN remains <= 0 THEN 0 ELSE least(room, floor(remains / greatest(size, 1) + 0.5))::BIGINT END) AS k FROM f
), o AS (
  SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY md5(coalesce(doc_id::VARCHAR, ''))) AS rn FROM docs
)
SELECT o.doc_id, o.size::BIGINT AS size, fin.source_size::BIGINT AS source_size, fin.target,
  ((fin.whole + CASE WHEN o.rn <= fin.k THEN 1 ELSE 0 END) * o.size)::BIGINT AS taken
FROM o JOIN fin ON o.source IS NOT DISTINCT FROM fin.source AND o.size = fin.size
"""



def _resolved(base: str, target: str) -> str:
    """SQL for the target of a link as a whole URL, relative to the URL base."""
    path, rest = f"regexp_extract({target}, '^[^?#]*')", f"regexp_extract({target}, '^[^?#]*(.*)$', 1)"
    folder = f"regexp_extract(regexp_extract({base}, '^[^/?#]*//[^/?#]*([^?#]*)', 1), '^.*/')"
    whole = f"CASE WHEN starts_with({path}, '/') THEN {path} ELSE (CASE WHEN {folder} = '' THEN '/' ELSE {folder} END) || {path} END"
    fold = f"list_reduce(string_split(substr({whole}, 2), '/'), lambda acc, x: CASE x WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END, '')"
    clean = f"CASE WHEN regexp_matches({whole}, '/[.]{{1,2}}$') THEN {fold} || '/' WHEN regexp_matches({whole}, '/[.]{{1,2}}/') THEN CASE {fold} WHEN '' THEN '/' ELSE {fold} END ELSE {whole} END"
    return f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {target} WHEN starts_with({target}, '//') THEN 'http:' || {target}
      WHEN starts_with({target}, '?') THEN regexp_extract({base}, '^[^?#]*') || {target} WHEN starts_with({target}, '#') THEN regexp_extract({base}, '^[^#]*') || {target}
      ELSE regexp_extract({base}, '^[^/?#]*//[^/?#]*') || ({clean}) || {rest} END"""


OP7 = (
    r"""
WITH RECURSIVE rules(rhost, rpath, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), tags AS (
  SELECT page_id, url, unnest(list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(regexp_replace(t, '(?i)&(amp|#0*38|#x0*26);', '&', 'g'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))
    || list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(regexp_replace(t, '(?i)&(amp|#0*38|#x0*26);', '&', 'g'), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1))) AS t,
    regexp_extract(regexp_replace(regexp_extract(html, '(?i)<base\b[^>]*\bhref\s*=[^>]*>'), '(?i)&(amp|#0*38|#x0*26);', '&', 'g'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS own
  FROM pages
), based AS (
  SELECT page_id, url, t, CASE WHEN own = '' THEN url ELSE """
    + _resolved("url", "own")
    + r""" END AS base FROM tags WHERE t <> ''
), raw AS (
  SELECT page_id, url, 'page' AS kind, NULL AS via FROM pages
  UNION ALL
  SELECT page_id, """
    + _resolved("base", "t")
    + r""", 'link', url FROM based
), rest AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM raw
), parts AS (
  SELECT *, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(r, ''), '^[^?#]*([?][^#]*)?', 1) AS q FROM rest
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || q END AS key FROM parts
), ruled AS (
  SELECT DISTINCT k.host, k.path, k.key, arg_max(rhost || rpath, (length(rhost || rpath), length(rhost), rhost || rpath)) OVER p AS rule,
    arg_max(action, (length(rhost || rpath), length(rhost), rhost || rpath)) OVER p AS action
  FROM (SELECT DISTINCT host, path, key FROM keyed) k
  JOIN rules ON (k.host = rhost OR ends_with(k.host, '.' || rhost)) AND starts_with(k.path, rpath)
  WINDOW p AS (PARTITION BY k.host, k.path, k.key)
), edges AS (
  SELECT DISTINCT a.key AS a, b.key AS b FROM keyed b JOIN keyed a ON a.kind = 'page' AND b.kind = 'link' AND a.page_id = b.page_id
  WHERE a.key IS NOT NULL AND b.key IS NOT NULL AND a.key <> b.key
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (
  SELECT key, key FROM ruled WHERE action = 'block' AND key IN (SELECT a FROM both_ways)
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), tainted AS (
  SELECT DISTINCT b AS key FROM reach
)
SELECT k.page_id, k.host, k.path, r.rule, coalesce(r.action, CASE WHEN t.key IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM keyed k LEFT JOIN ruled r ON r.host = k.host AND r.path = k.path AND r.key IS NOT DISTINCT FROM k.key
LEFT JOIN tainted t ON t.key = k.key
WHERE k.kind = 'page'
"""
)

OP1 = r"""
WITH docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), words AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY r
), lines AS (
  SELECT r, host, line, row_number() OVER (PARTITION BY r) AS dummy,
    translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), frequent AS (
  SELECT host, norm FROM lines JOIN (SELECT host, count(*) AS rows FROM docs GROUP BY host) USING (host) GROUP BY host, norm, rows HAVING count(DISTINCT r) > 10 AND 1000 * count(DISTINCT r) > rows
), removed AS (
  SELECT r, sum(n)::BIGINT AS n FROM lines SEMI JOIN frequent USING (host, norm) GROUP BY r
), base AS (
  SELECT docs.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS words_removed
  FROM docs JOIN words USING (r) LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN removed USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_removed,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - words_removed < 5 OR n_words - words_removed < 0.3 * n_words) AS kept
FROM base
"""


def _op4() -> str:
    s = secrets
    quoted = lambda p: p.replace("'", "''")
    alphabet = lambda part: "CASE enc " + " ".join(f"WHEN '{k}' THEN {part(v)}" for k, v in s.ALPHABETS.items()) + " END"
    tail = lambda z: f"(1.0 / (1.0 + exp(least(600.0, greatest(-600.0, ({z}) * 1.5976 + ({z}) * ({z}) * ({z}) * 0.070565992)))))"
    found = " UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(t, '{quoted(p)}') AS m, string_split_regex(t, '{quoted(p)}') AS p FROM docs" for k, p in enumerate((s.ASSIGN, s.ACCESS, s.HEX, s.TOKEN)))
    by_kind = lambda part: "CASE enc " + " ".join(f"WHEN '{k}' THEN {part(k)!r}::DOUBLE" for k in s.ALPHABETS) + " END"
    score = lambda p: f"greatest(0, least(floor(-10 * log10(greatest({p}, 1e-300::DOUBLE))), {s.STEPS}))::BIGINT"
    strata = "CASE " + " ".join(f"WHEN n >= {x} THEN {x}" for x in sorted(s.STRATA, reverse=True)) + " END"
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), k AS (
  {found}
), u AS (
  SELECT r, kind, m, p, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0
), spans AS (
  SELECT r, kind, m[i] AS match, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM u
), base AS (
  SELECT *, a + length(match) AS z FROM spans WHERE kind IN (1, 2) OR (kind = 0 AND length(regexp_extract(match, '{quoted(s.ASSIGN)}', 2)) >= 8)
), t1 AS (
  SELECT *, a + length(match) AS z, CASE WHEN regexp_full_match(match, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(match, '[A-Z2-7]+') THEN 'base32' ELSE 'base64' END AS enc
  FROM spans WHERE kind = 3 AND regexp_matches(match, '[A-Za-z]')
), t2 AS (
  SELECT *, CASE enc WHEN 'hex' THEN lower(match) ELSE translate(match, '-_', '+/') END AS word, {alphabet(lambda v: f"'{v}'")} AS abc, {alphabet(lambda v: f"{len(v)}.0::DOUBLE")} AS size, length(match)::DOUBLE AS n FROM t1
), t3 AS (
  SELECT *, string_split(word, '') AS chars, translate(word, abc, repeat('0', (size / 2)::INT) || repeat('1', (size / 2)::INT)) AS bits FROM t2
), t4 AS (
  SELECT *, list_transform(chars, lambda c: instr(abc, c)::DOUBLE) AS codes, length(replace(bits, '0', ''))::DOUBLE AS ones,
    size / n * list_sum(list_transform(list_distinct(chars), lambda c: power(n - length(replace(word, c, '')), 2))) - n AS chi FROM t3
), t5 AS (
  SELECT *, (power(chi / (size - 1), 1.0::DOUBLE / 3) - (1 - 2 / (9 * (size - 1)))) / sqrt(2 / (9 * (size - 1))) AS z_chi, 2 * ones * (n - ones) / n + 1 AS mu, list_sum(codes) / n AS mean FROM t4
), t6 AS (
  SELECT *, CASE WHEN mu <= 2 THEN 99.0 ELSE abs(((n - length(replace(bits, '01', ''))) + (n - length(replace(bits, '10', '')))) / 2.0 + 1 - mu) / sqrt((mu - 1) * greatest(mu - 2, 1e-9) / (n - 1)) END AS z_runs,
    list_sum(list_transform(codes, lambda c: (c - mean) * (c - mean))) AS spread,
    list_sum(list_transform(range(1, len(codes)), lambda i: (codes[i] - mean) * (codes[i + 1] - mean))) AS products, len(regexp_extract_all(match, '[a-z]+|[A-Z]+|[0-9]+|[+/_-]+')) AS runs FROM t5
), t7 AS (
  SELECT *, CASE WHEN spread <= 0 THEN 99.0 ELSE abs(products) / greatest(spread, 1e-9) * sqrt(n) END AS z_serial, {strata} AS stratum,
    {by_kind(lambda e: s._coincidence(e, 2))} AS k2, {by_kind(lambda e: s._coincidence(e, 3))} AS k3, (chi + n) * n / size - n AS pairs,
    {by_kind(lambda e: s.CHANGE_RATE if e == "base64" else s.SINGLE_RATE)} AS rate, n - 1 AS m, runs - 1.0::DOUBLE AS k FROM t6
), t8 AS (
  SELECT *, {tail("(n * (n - 1) * k2 - pairs - 1) / sqrt(2 * n * (n - 1) * (k2 - k2 * k2) + 4 * n * (n - 1) * (n - 2) * (k3 - k2 * k2))")} AS few,
    CASE WHEN k > m * rate THEN least(1.0, exp(list_sum(list_transform(range(1, greatest(k, 1)::BIGINT + 1), lambda i: ln((m - i + 1) / i))) + k * ln(rate) + (m - k) * ln(1 - rate))
      / (1 - (m - k) / (k + 1) * rate / (1 - rate))) ELSE 1.0 END AS many FROM t7
), t9 AS (
  SELECT r, kind, a, z, stratum, greatest(few * many, 1e-300::DOUBLE) AS q, 3 * least({tail("z_chi")}, 2 * {tail("z_runs")}, 2 * {tail("z_serial")}) AS uniform FROM t8
), scored AS (
  SELECT r, kind, a, z, stratum, {score("uniform")} AS structured, {score("q * (1 - ln(q))")} AS score FROM t9
), b AS (
  SELECT stratum, test, score, count(*) AS n FROM (SELECT stratum, 'structured' AS test, structured AS score FROM scored UNION ALL SELECT stratum, 'score', score FROM scored) GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY stratum, test) AS m, sum(n) OVER (PARTITION BY stratum, test ORDER BY score DESC) AS k FROM b
), limits AS (
  SELECT stratum, test, min(score) AS least_score FROM c WHERE power(10.0::DOUBLE, -score / 10.0) <= k * {s.DISCOVERY_RATE} / m GROUP BY stratum, test
), more AS (
  SELECT r, kind, a, z FROM scored JOIN limits y ON y.stratum = scored.stratum AND y.test = 'score' LEFT JOIN limits x ON x.stratum = scored.stratum AND x.test = 'structured'
  WHERE score >= y.least_score AND structured < coalesce(x.least_score, {s.STEPS + 1})
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.r = scored.r AND base.a < scored.z AND scored.a < base.z)
), listed AS (
  SELECT r, kind, a, (['assign', 'access', 'hex', 'random'])[kind + 1] || ':' || a || ':' || z AS one FROM (SELECT r, kind, a, z FROM base UNION ALL SELECT * FROM more)
), per AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(one, ',' ORDER BY a, kind) FILTER (kind < 3) AS based, string_agg(one, ',' ORDER BY a, kind) AS spans FROM listed GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (r)
"""


OP4 = _op4()

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), spots AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split
), f1 AS (
  SELECT lang, ws[i] AS w, count(*) AS f FROM spots GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), f2 AS (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM spots WHERE i + 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM spots WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10
), held AS (
  SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w = f2.w2
  LEFT JOIN held h ON h.lang = f2.lang AND h.w1 = f2.w1 AND h.w2 = f2.w2 WHERE h.most IS NULL OR 100 * h.most < 50 * f2.f
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w = f3.w3
), scored AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE c = 1
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
