"""DuckDB SQL for the rows of the queries that SQL can express."""

_VOTES = """
CASE WHEN n_words = 0 THEN 0 WHEN word_chars / n_words < 2.5 OR word_chars / n_words > 12 THEN -1
     WHEN word_chars / n_words >= 3.5 AND word_chars / n_words <= 9 THEN 1 ELSE 0 END AS v0,
CASE WHEN n_words = 0 THEN 0 WHEN n_symbols / n_words > 0.3 THEN -1 WHEN n_symbols / n_words <= 0.1 THEN 1 ELSE 0 END AS v1,
CASE WHEN n_lines = 0 THEN 0 WHEN n_dup_lines / n_lines > 0.3 THEN -1 WHEN n_dup_lines / n_lines <= 0.1 THEN 1 ELSE 0 END AS v2,
CASE WHEN n_words = 0 THEN 0 WHEN n_repeat_words / n_words > 0.25 THEN -1
     WHEN n_repeat_words / n_words <= 0.1 THEN 1 ELSE 0 END AS v3,
CASE WHEN word_chars = 0 THEN 0 WHEN n_other / word_chars > 0.3 THEN -1 WHEN n_other / word_chars <= 0.15 THEN 1 ELSE 0 END AS v4,
CASE WHEN word_chars = 0 THEN 0 WHEN n_upper / word_chars > 0.4 THEN -1 WHEN n_upper / word_chars <= 0.2 THEN 1 ELSE 0 END AS v5,
CASE WHEN n_words = 0 THEN 0 WHEN n_exclaims / n_words > 0.3 THEN -1 WHEN n_exclaims / n_words <= 0.1 THEN 1 ELSE 0 END AS v6,
CASE WHEN n_words >= 40 AND n_stop_words = 0 THEN -1 WHEN n_stop_words >= 2 THEN 1 ELSE 0 END AS v7
"""
_RULES = range(8)
_ODDS = " + ".join(f"v{r} * ln(a{r} / (1 - a{r}))" for r in _RULES)
_POSTERIOR = f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {_ODDS})))"
_STEP = ", ".join(
    f"(sum(n * CASE v{r} WHEN 1 THEN q WHEN -1 THEN 1 - q ELSE 0 END) + 16.0) / (sum(n * abs(v{r})) + 20.0)" for r in _RULES)

_EIGHT = "x" + "".join(f" || ' ' || lead(x, {k}) OVER o" for k in range(1, 8))

QUALITY_RULES = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
x AS (SELECT rid, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM d),
w AS (
  SELECT rid, i, {_EIGHT} AS t
  FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest(range(i, i + 8)) AS p
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM w WHERE t IS NOT NULL) WHERE c > 1)
  GROUP BY rid),
s AS (
  SELECT d.rid, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^0-9!-/:-@\[-`{{-~]', '', 'g')) AS n_other,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
         len(list_intersect(words, ['the', 'of', 'and', 'to', 'in', 'is', 'der', 'die', 'und', 'das', 'ist', 'de', 'la', 'le',
                                    'les', 'et', 'des', 'que', 'el', 'en', 'los', 'y'])) AS n_stop_words
  FROM d LEFT JOIN r ON d.rid = r.rid),
v AS (SELECT *, {_VOTES} FROM s),
p AS (SELECT v0, v1, v2, v3, v4, v5, v6, v7, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
em(i, prior, a0, a1, a2, a3, a4, a5, a6, a7) AS (
  SELECT 0, 0.8::DOUBLE, {", ".join("0.8::DOUBLE" for _ in _RULES)}
  UNION ALL
  SELECT i + 1, (sum(n * q) + 1.0) / (sum(n) + 2.0), {_STEP}
  FROM (SELECT em.*, p.*, {_POSTERIOR} AS q FROM em, p WHERE i < 25) GROUP BY i)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {_POSTERIOR} >= 0.5) AS kept,
       round({_POSTERIOR}, 6) AS quality
FROM v, (SELECT * FROM em WHERE i = 25)
"""


def _strength(level: str, n: str, good: str) -> str:
    m, scale = "(s / n)", "((s / n) * (1 - s / n))"
    room = "(n - nn / n - (g - 1))"
    rho = f"((ss - s * {m} - {scale} * (g - 1)) / ({scale} * {room}))"
    return f"""(SELECT 1 / (CASE WHEN g > 1 AND {scale} > 0 AND {room} > 1e-9
                 THEN greatest(0.001, least(0.9, {rho})) ELSE 0.001 END) - 1
        FROM (SELECT count(*)::DOUBLE AS g, sum({n})::DOUBLE AS n, sum({good})::DOUBLE AS s, sum({n} * {n})::DOUBLE AS nn,
                     sum({good} * {good} / {n}) AS ss FROM {level} WHERE {n} > 0))"""


URL_REPUTATION = rf"""
WITH u AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
h AS (
  SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good,
         regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix
  FROM u LEFT JOIN l USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(good) AS dg FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(dn) AS sn, sum(dg) AS sg FROM d GROUP BY suffix),
one AS (
  SELECT (SELECT (coalesce(sum(sg), 0) + 1) / (coalesce(sum(sn), 0) + 2) FROM s) AS m,
         {_strength("s", "sn", "sg")} AS ks, {_strength("d", "dn", "dg")} AS kd, {_strength("h", "n", "good")} AS kh),
b AS (
  SELECT host, good + kh * (dg + kd * (sg + ks * m) / (sn + ks)) / (dn + kd) AS a,
         n - good + kh * (1 - (dg + kd * (sg + ks * m) / (sn + ks)) / (dn + kd)) AS b
  FROM h JOIN d USING (domain, suffix) JOIN s USING (suffix), one),
f AS (
  SELECT page_id, u.host, path, a / (a + b) AS posterior,
         a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper,
         CASE WHEN (u.host = 'www.example.com' OR u.host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
              WHEN (u.host = 'example.com' OR u.host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
              WHEN (u.host = 'net' OR u.host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
              WHEN (u.host = 'net' OR u.host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
              WHEN (u.host = 'com' OR u.host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM u JOIN b ON u.host = b.host)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(posterior, 6) AS good_share
FROM f
"""


def _assigned(r: int) -> str:
    """Parts with the entry of round ``r`` that is nearest, the lower one on ties."""
    return f"""a{r} AS MATERIALIZED (
  SELECT rid, p, any_value(v) AS v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT rid, parts.p, parts.v, e,
           coalesce(list_sum([(parts.v[i] - b.v[i]) * (parts.v[i] - b.v[i]) for i in range(1, len(b.v) + 1)]), 0)::BIGINT AS d
    FROM parts JOIN b{r} b ON parts.p = b.p) GROUP BY rid, p)"""


def _replaced(r: int) -> str:
    """Entries of round ``r + 1``: floors of means, worked out position by position."""
    return f"""b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT p, e, list(x ORDER BY i) AS v FROM (
      SELECT p, e, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*))::BIGINT AS x
      FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""


VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, vec_id, p, list_slice(v, (p * (len(v) // 4) + 1)::BIGINT, ((p + 1) * (len(v) // 4))::BIGINT) AS v
  FROM kept, range(4) t(p)),
b0 AS MATERIALIZED (
  SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256),
{", ".join(f"{_assigned(r)}, {_replaced(r)}" for r in range(4))}, {_assigned(4)},
c AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x, ',' ORDER BY p, e, i))
        FROM (SELECT p, e, unnest(v)::VARCHAR AS x, generate_subscripts(v, 1) AS i FROM b4)) AS codebooks_sha256
FROM kept JOIN c USING (rid)
"""
