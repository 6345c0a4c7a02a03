"""DuckDB statements for the queries that SQL can express, written another way than the operators."""

from __future__ import annotations

from hourgrid.llm.secret_scan import BASE, IDENTIFIERS, KINDS, PATTERNS, SCOPE, SECRETS

TOP_K = """
WITH v AS (
    SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n AND len(q.x) = len(c.x)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(number: int) -> str:
    """(r, kind, a, b) of the parts that a pattern finds: lengths of gaps and matches add up."""
    kind, pattern, group = PATTERNS[number]
    p, short = _text(pattern), KINDS.index("short_secret")
    what = {
        "assign": f"CASE WHEN length(v) >= 12 THEN {number} WHEN length(v) >= 6 THEN {short} END",
        "bare_key": f"CASE WHEN length(m) = 40 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') THEN {number} END",
    }.get(kind, str(number))
    return f"""
SELECT r, {what} AS kind, b - length(m) AS a, b FROM (
  SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS b FROM (
    SELECT r, i, ms[i] AS m, vs[i] AS v, gs[i] AS g FROM (
      SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, string_split_regex(t, {p}) AS gs
        FROM d WHERE regexp_matches(t, {p})))))"""


def _near(kinds: list[str], most: int) -> str:
    numbers = ", ".join(str(KINDS.index(k)) for k in kinds)
    return f"EXISTS (SELECT 1 FROM p q WHERE q.r = p.r AND q.n <> p.n AND q.kind IN ({numbers}) AND greatest(q.a - p.b, p.a - q.b) <= {most})"


def _is(kinds: list[str]) -> str:
    return f"kind IN ({', '.join(str(KINDS.index(k)) for k in kinds)})"


NAME = "CASE kind " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS)) + " END || ':' || a || ':' || b"
SPANS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, row_number() OVER () AS n FROM ({' UNION ALL '.join(_found(n) for n, k in enumerate(KINDS) if k != 'short_secret')}) WHERE kind IS NOT NULL),
told AS (
  SELECT r, kind, a, {NAME} AS s FROM p
  WHERE {_is(BASE)} OR (NOT {_near(BASE, -1)} AND CASE WHEN {_is(IDENTIFIERS)} THEN {_near(SECRETS, SCOPE)}
    WHEN {_is(SECRETS)} THEN {_near(IDENTIFIERS, SCOPE)} ELSE {_near(IDENTIFIERS, SCOPE)} AND {_near(SECRETS, SCOPE)} END)),
by_doc AS (
  SELECT r, {', '.join(f'count(*) FILTER (kind = {n}) AS n_{k}' for n, k in enumerate(BASE))},
         string_agg(s, ',' ORDER BY a, kind) FILTER ({_is(BASE)}) AS base, string_agg(s, ',' ORDER BY a, kind) AS spans
  FROM told GROUP BY r)
SELECT doc_id, {', '.join(f'CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}' for k in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc USING (r)
"""

def _cut(a: str, left: str, right: str) -> str:
    return f"CAST({a} AS HUGEINT) * {a} * 1000000 // (CAST({left} AS HUGEINT) * {right})"


PHRASES = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
w AS (SELECT lang, unnest(ws) AS w1 FROM split),
w2 AS (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: [ws[i], ws[i + 1]])) AS p FROM split),
w3 AS (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS p FROM split),
f1 AS (SELECT lang, w1, count(*) AS f FROM w GROUP BY ALL),
f2 AS (SELECT lang, p[1] AS w1, p[2] AS w2, count(*) AS f FROM w2 GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, p[1] AS w1, p[2] AS w2, p[3] AS w3, count(*) AS f FROM w3 GROUP BY ALL HAVING count(*) >= 10),
three AS (
  SELECT t.lang, t.w1, t.w2, t.w3, t.f AS a, x.f AS x, yz.f AS yz, xy.f AS xy, z.f AS z, {_cut('t.f', 'x.f', 'yz.f')} AS s1, {_cut('t.f', 'xy.f', 'z.f')} AS s2
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f1 z ON z.lang = t.lang AND z.w1 = t.w3
  JOIN f2 xy ON xy.lang = t.lang AND xy.w1 = t.w1 AND xy.w2 = t.w2 JOIN f2 yz ON yz.lang = t.lang AND yz.w1 = t.w2 AND yz.w2 = t.w3),
found AS (
  SELECT lang, w1 || ' ' || w2 || ' ' || w3 AS phrase, a, CASE WHEN s1 <= s2 THEN x ELSE xy END AS l, CASE WHEN s1 <= s2 THEN yz ELSE z END AS r, least(s1, s2) AS score FROM three
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2, p.f, x.f, y.f, {_cut('p.f', 'x.f', 'y.f')}
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND 100 * t.f >= 50 * p.f AND (t.w1 = p.w1 AND t.w2 = p.w2 OR t.w2 = p.w1 AND t.w3 = p.w2))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found)
SELECT lang, rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op5_exact_topk": TOP_K, "op7_secret_scan": SPANS, "op13_collocations": PHRASES}
