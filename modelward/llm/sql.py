"""DuckDB SQL of the corpus queries."""

from __future__ import annotations

from modelward.llm import secret_scan

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT n, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY n)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.n) AS text_sha256 FROM d JOIN g USING (n)
"""

MIXING = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                            md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
filled(round, source, source_size, weight, target, full_up) AS (
  SELECT 0, source, source_size, weight, 0.0::DOUBLE, false FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, CASE WHEN full_up THEN target ELSE least(3.0 * source_size, level * weight) END, full_up OR level * weight > 3.0 * source_size
  FROM (SELECT *, (sum(source_size) OVER () - sum(CASE WHEN full_up THEN target ELSE 0 END) OVER ())::DOUBLE / nullif(sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER (), 0) AS level,
               (SELECT count(*) FROM s) AS n FROM filled) WHERE round <= n),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE target END AS target, round(CASE WHEN source_size = 0 THEN 0 ELSE target END)::BIGINT AS goal FROM filled QUALIFY round = max(round) OVER ()),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.goal // t.source_size ELSE 0 END AS whole, t.goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, goal - whole * source_size - ahead)))::BIGINT AS taken FROM r
"""

_SPANS = r"""
SELECT doc_id, '{kind}' AS kind, {rank} AS rank, starts[i]::BIGINT AS s, (starts[i] + length(whole[i]))::BIGINT AS e, value[i] AS v FROM (
  SELECT doc_id, whole, value, list_transform(range(1, len(whole) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0)) AS starts, unnest(range(1, len(whole) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(t, p, 0) AS whole, regexp_extract_all(t, p, {group}) AS value, regexp_split_to_array(t, p) AS gaps FROM (SELECT doc_id, coalesce(text, '') AS t, '{pattern}' AS p FROM documents)))
"""


def _spans(rank: int, pattern: str, group: int = 0) -> str:
    return _SPANS.format(kind=secret_scan.KINDS[rank], rank=rank, group=group, pattern=pattern.replace("'", "''"))


_BLANKED = "v"
for _word in ("example", "sample", "placeholder", "changeme", "xxxx", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "1234567890123456"):
    _BLANKED = f"regexp_replace({_BLANKED}, '{_word}', '{'~' * len(_word)}', 'gi')"

SECRETS = f"""
WITH base AS (
  SELECT * FROM ({_spans(0, secret_scan.ASSIGN, 2)}) WHERE length(v) >= {secret_scan.MIN_ASSIGNED}
  UNION ALL SELECT * FROM ({_spans(1, secret_scan.ACCESS)}) WHERE length(v) >= {secret_scan.MIN_ACCESS}
  UNION ALL SELECT * FROM ({_spans(2, secret_scan.HEX)}) WHERE length(v) >= {secret_scan.MIN_HEX}),
candidate AS (SELECT row_number() OVER () AS c, * FROM ({_spans(3, '[A-Za-z0-9+/_=-]{20,}')})
  WHERE regexp_matches(v, '[A-Za-z]') AND NOT regexp_full_match(v, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')),
blanked AS (SELECT c, {_BLANKED} AS x FROM candidate),
w AS (SELECT c, substring(x, o, 20) AS v, o FROM (SELECT c, x, unnest(range(1, length(x) - 18)) AS o FROM blanked)),
judged AS (SELECT * FROM w WHERE NOT contains(v, '~') AND regexp_matches(v, '[A-Za-z]')),
ch AS (SELECT c, o, v, substring(v, k + 1, 1) AS x, count(*) AS n FROM judged, range(20) r(k) GROUP BY ALL),
bits AS (SELECT DISTINCT c FROM (SELECT c, o, v, log2(20) - sum(n * log2(n)) / 20 AS h FROM ch GROUP BY c, o, v)
  WHERE h - CASE WHEN NOT regexp_matches(v, '[^0-9a-fA-F]') THEN 3.05 WHEN NOT regexp_matches(v, '[0-9]') THEN 4.0 ELSE 3.81 END > 1e-9),
dense AS (SELECT doc_id, kind, rank, s, e, v FROM candidate JOIN bits USING (c)
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = candidate.doc_id AND b.s < candidate.e AND candidate.s < b.e)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM dense)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""

URL_FILTERS = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
best AS (SELECT h.n, r.host || r.path AS rule, r.verdict FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
         QUALIFY row_number() OVER (PARTITION BY h.n ORDER BY length(r.host || r.path) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN best USING (n)
"""

MERKLE = """
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, lang, crc % 7 = 0 AS tampered, list_transform([0, 1], lambda more: sha256(concat_ws('',
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen((n_chars + more)::VARCHAR) || ':' || (n_chars + more), '-'), coalesce(strlen(text) || ':' || text, '-')))) AS h
  FROM (SELECT *, {crc} AS crc FROM documents)),
leaf AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h[1]) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM t),
node(lvl, lang, i, h, n) AS (
  SELECT 0, lang, i, h[1], n FROM leaf
  UNION ALL SELECT lvl + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM node WHERE n > 1 GROUP BY lvl, lang, i // 2, n),
sub AS (SELECT lang, lvl AS height, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
up(lvl, i, h, n) AS (
  SELECT 0, i, h, n FROM sub
  UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lvl, i // 2, n),
way(r, lvl, i, g, height, h, beside) AS (
  SELECT r, 0, leaf.i, sub.i, sub.height, leaf.h[CASE WHEN tampered THEN 2 ELSE 1 END], '' FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang
  UNION ALL
  SELECT way.r, way.lvl + 1, CASE WHEN way.lvl + 1 = way.height THEN way.g ELSE way.i // 2 END, way.g, way.height,
    sha256(CASE WHEN x.h IS NULL THEN way.h WHEN way.i % 2 = 0 THEN way.h || x.h ELSE x.h || way.h END), way.beside || coalesce(x.h, '')
  FROM way JOIN sub ON sub.i = way.g LEFT JOIN node x ON x.lvl = way.lvl AND x.lang IS NOT DISTINCT FROM sub.lang AND x.i = xor(way.i, 1)
  WHERE way.lvl < way.height),
rise(r, lvl, i, h, beside) AS (
  SELECT r, 0, g, h, beside FROM way WHERE lvl = height
  UNION ALL
  SELECT rise.r, rise.lvl + 1, rise.i // 2, sha256(CASE WHEN x.h IS NULL THEN rise.h WHEN rise.i % 2 = 0 THEN rise.h || x.h ELSE x.h || rise.h END), rise.beside || coalesce(x.h, '')
  FROM rise LEFT JOIN up x ON x.lvl = rise.lvl AND x.i = xor(rise.i, 1) WHERE rise.lvl < (SELECT max(lvl) FROM up))
SELECT leaf.doc_id, leaf.h[1] AS leaf, sub.h AS subroot, up.h AS root, sha256(rise.beside) AS proof_sha256, rise.h AS folded_root, rise.h = up.h AS verified
FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang JOIN up ON up.n = 1 JOIN rise ON rise.r = leaf.r AND rise.lvl = up.lvl
"""

#: DuckDB has no crc32: eight shifts for each byte of the id's digits.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"""
MERKLE = MERKLE.replace("{crc}", f"xor({_CRC}, 4294967295::UBIGINT)")

ORACLES = {
    "op1_secrets": SECRETS, "op3_mixing": MIXING, "op8_exact_dedup": EXACT_DEDUP, "op11_hard_negatives": HARD_NEGATIVES, "op12_url_filters": URL_FILTERS, "op13_merkle_manifest": MERKLE,
}
