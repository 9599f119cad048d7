"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
TOKEN = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH l AS (
  SELECT doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS d
  FROM (SELECT doc_id, pos, line, len(regexp_extract_all(line, {TOKEN})) AS w FROM l) WHERE w > 0),
win AS (
  SELECT doc_id, min(pos) OVER f AS b, max(pos) OVER f AS e, sum(w) OVER f AS held, string_agg(line, chr(10)) OVER f AS txt
  FROM c WINDOW f AS (PARTITION BY doc_id ORDER BY d - w RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER g, max(pos) OVER g, sum(w) OVER g, string_agg(line, chr(10)) OVER g
  FROM c WINDOW g AS (PARTITION BY doc_id ORDER BY d RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
later AS (
  SELECT * FROM (
    SELECT doc_id, b, e, row_number() OVER (PARTITION BY txt ORDER BY doc_id, b) AS nth FROM win WHERE held >= 50) WHERE nth > 1),
opened AS (
  SELECT doc_id, b, e, coalesce(b > max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens
  FROM later),
runs AS (
  SELECT doc_id, min(b) AS b, max(e) AS e FROM (
    SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM opened)
  GROUP BY doc_id, run),
spans AS (
  SELECT doc_id, string_agg(b || '-' || e, ',' ORDER BY b) AS deleted, sum(e - b + 1)::BIGINT AS n_deleted FROM runs GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (r.doc_id IS NULL), '') AS txt,
         bool_and(l.text IS NULL) AS none
  FROM l LEFT JOIN runs r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.b AND r.e GROUP BY l.doc_id)
SELECT kept.doc_id, n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(deleted, '') AS deleted,
       CASE WHEN none THEN NULL ELSE txt END AS text
FROM kept LEFT JOIN spans ON kept.doc_id = spans.doc_id
"""

OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS ws FROM documents),
g AS (
  SELECT doc_id, list_distinct([array_to_string(ws[i : i + 4], ' ') || CASE WHEN len(ws) < 5 THEN '#' || len(ws) ELSE '' END
                                FOR i IN range(1, greatest(len(ws) - 3, 2))]) AS gs FROM w WHERE len(ws) > 0),
one AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS gram FROM g),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM one x JOIN one y ON x.gram = y.gram AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING count(*) >= 0.8 * (any_value(x.n) + any_value(y.n) - count(*)) - 1e-9),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, pair.b FROM reach JOIN pair ON reach.r = pair.a),
cls AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id),
links AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT cls.doc_id, class_id, coalesce(n, 0) AS n_links, cls.doc_id = class_id AS is_first
FROM cls LEFT JOIN links ON cls.doc_id = links.a
"""

OP5 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {TOKEN})) AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (
  SELECT source, source_size, 2 * source_size AS cap,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
lv AS (
  SELECT 1.5::DOUBLE * sum(source_size) / sum(w) AS level, 0 AS i FROM s
  UNION ALL
  SELECT (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (cap < w * lv.level), 0)) / sum(w) FILTER (cap >= w * lv.level) FROM s), i + 1
  FROM lv WHERE i < 40),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, w * (SELECT max(level) FROM lv)) AS target FROM s),
x AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
o AS (
  SELECT d.doc_id, d.size, x.source_size, x.target, x.whole, x.target - x.whole * x.source_size AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((whole + CASE WHEN size > 0 AND upto - size / 2.0::DOUBLE <= extra THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM o
"""

OP3 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v)::BIGINT DESC, b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
WHERE rank <= 5
"""

OP6 = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
base(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
own(h) AS (SELECT unnest(['2o7.net', 'adnxs.com', 'adsrvr.org', 'bet365.com', 'betfair.com', 'criteo.com', 'doubleclick.net', 'exoclick.com', 'googleadservices.com', 'googlesyndication.com',
  'outbrain.com', 'pokerstars.com', 'popads.net', 'pornhub.com', 'propellerads.com', 'quantserve.com', 'rubiconproject.com', 'scorecardresearch.com', 'taboola.com', 'xhamster.com', 'xnxx.com', 'xvideos.com'])),
hit AS (
  SELECT page_id, host, path, h || p AS rule, v FROM u LEFT JOIN base ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN EXISTS (SELECT 1 FROM own WHERE host = h OR ends_with(host, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM hit
"""

LICENSE_BASE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS ws FROM documents),
p(phrase, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
n AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
h AS (SELECT doc_id, label, i - 1 AS start FROM n JOIN p ON ws[i] = phrase[1] AND ws[i : i + len(phrase) - 1] = phrase)
SELECT w.doc_id, any_value(len(ws))::BIGINT AS n_words, count(label) AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN h ON w.doc_id = h.doc_id GROUP BY w.doc_id
"""

PERSONAL_BASE = r"""
WITH pat(kind, ord, rx) AS (VALUES
  ('email', 0, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)'), ('ip', 1, '([0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+))'),
  ('card', 2, '([0-9](?:[\x20-]?[0-9])+)'), ('phone', 3, '(\+[0-9][\x20().0-9-]+[0-9])')),
cut AS (
  SELECT doc_id, kind, ord, string_split(regexp_replace(coalesce(text, ''), rx, chr(1) || '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents, pat),
piece AS (SELECT doc_id, kind, ord, unnest(ps) AS hit, generate_subscripts(ps, 1) AS n FROM cut),
placed AS (
  SELECT *, sum(length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY n) AS stop, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM piece),
found AS (
  SELECT doc_id, kind, ord, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM placed
  WHERE n % 2 = 0 AND CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INT), 256) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i:
      CASE WHEN i % 2 = 0 THEN digits[length(digits) - i]::INT ELSE 2 * digits[length(digits) - i]::INT - CASE WHEN digits[length(digits) - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
       count(*) FILTER (kind = 'phone') AS n_phone, sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start), '')) AS base_sha256
FROM documents d LEFT JOIN found ON d.doc_id = found.doc_id GROUP BY d.doc_id
"""

STATISTICS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {TOKEN}) AS ws FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, {TOKEN}) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
       len(ws) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(ws) AS base_failed
FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN covered ON w.doc_id = covered.doc_id
"""

OP11 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT pos.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos JOIN s ON pos.anchor_id = s.anchor_id AND NOT same
  WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
WHERE rank <= 3
"""


def _op12(rounds: int = 4) -> str:
    """Every round is an assignment a and the next books b."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT vec_id, label, p.part, x, 
         min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + entry)::BIGINT AS best
  FROM p JOIN b{i} ON p.part = b{i}.part GROUP BY vec_id, label, p.part, x)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT part, best % 256 AS entry, pos, sum(v::BIGINT) AS s, count(*) AS n
  FROM (SELECT part, best, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY part, best % 256, pos),
c{i} AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS c FROM m{i} GROUP BY part, entry),
b{i + 1} AS (
  SELECT b{i}.part, b{i}.entry, coalesce(c{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN c{i} ON b{i}.part = c{i}.part AND b{i}.entry = c{i}.entry)""")
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS part)),
b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256),{','.join(steps)},
r AS (
  SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos))
        FROM (SELECT part, entry, unnest(c) AS v, generate_subscripts(c, 1) AS pos FROM b{rounds})) AS codebooks_sha256
FROM r
"""


OP12 = _op12()
