"""DuckDB SQL for the queries that SQL can express."""

from .queries import BLOCKED_LABELS, URL_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rules(then: int) -> str:
    cases = []
    for action, rule in sorted(URL_RULES, key=lambda r: -len(r[1])):
        site, path = rule[: rule.index("/")], rule[rule.index("/") :]
        cases.append(f"WHEN (host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{path}') THEN '{(action, rule)[then]}'")
    return f"CASE {' '.join(cases)} END"


OP1 = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), listed AS (
  SELECT DISTINCT host || path AS key FROM parts WHERE list_has_any(string_split(host, '.'), {BLOCKED_LABELS})
)
SELECT page_id, host, path, {_rules(1)} AS rule,
       coalesce({_rules(0)}, CASE WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM i)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
twice AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 34)) AS p FROM g WHERE h IN (SELECT h FROM twice)),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d),
left_ AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (doc_id)"""

OP10 = """
SELECT conv_id, turn, role, text, lag(turn) OVER w AS parent, first_value(turn) OVER w AS root,
       row_number() OVER w - 1 AS depth, row_number() OVER w AS position
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""



def _clusters() -> str:
    """Ten rounds over 8 centroids; every CTE is materialised, as each is read twice."""
    distance = "list_sum(list_transform(list_zip(v, x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = f"SELECT i, v, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT i, v, c, {distance} AS d FROM kept, at_K) GROUP BY i, v"
    steps = []
    for k in range(10):
        steps.append(f"""near_{k} AS MATERIALIZED ({nearest.replace("at_K", f"at_{k}")}), at_{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(m, x) AS x FROM at_{k} LEFT JOIN (SELECT c, list(m ORDER BY p) AS m FROM (
    SELECT c, p, CAST((sum(y) - (sum(y) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
    FROM (SELECT c, unnest(v) AS y, unnest(generate_series(1, 64)) AS p FROM near_{k}) GROUP BY c, p) GROUP BY c) USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64
), at_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS x FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8)
), {", ".join(steps)}, last AS MATERIALIZED ({nearest.replace("at_K", "at_10")})
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM last JOIN at_10 USING (c) JOIN kept USING (i)"""


OP11 = """
WITH RECURSIVE crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, s, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END
  FROM (SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(s[k // 8 + 1]) AS BIGINT)) ELSE v END AS x FROM crc WHERE k < 8 * length(s))
), heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(v, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE k = 8 * length(s)
), original AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(o.turns, h + 1, len(o.turns))) AS turns
  FROM heads JOIN original o USING (conv_id) LEFT JOIN original b ON b.conv_id = base
), steps AS (
  SELECT conv_id, d, list_slice(turns, 1, d) AS path, d = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(generate_series(0, len(turns))) AS d FROM rebuilt)
), nodes AS MATERIALIZED (
  SELECT path, min(conv_id) AS conv_id, d AS depth, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(path[d].text) END AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps GROUP BY path, d
), children AS (
  SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT list_slice(path, 1, k) AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(generate_series(0, depth)) AS k FROM nodes LEFT JOIN children USING (path)) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (path) LEFT JOIN children USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = list_slice(n.path, 1, n.depth - 1)"""

OP13 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, b, unnest(range(octet_length(b) - 199)) AS s FROM d WHERE octet_length(b) >= 200),
g AS MATERIALIZED (SELECT r, s, md5_number(array_slice(b, s + 1, s + 200)) AS h FROM starts),
hits AS (SELECT r, s FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT r, s, CASE WHEN s <= lag(s) OVER w + 200 THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY r ORDER BY s)),
spans AS (SELECT r, i, min(s) AS a, max(s) + 200 AS z FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS i FROM marked) GROUP BY r, i),
gaps AS (
  SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p FROM spans
), cut AS (
  SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS tail, string_agg(hex(array_slice(b, p + 1, a)), '' ORDER BY a) AS x FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN r IN (SELECT r FROM cut) THEN unhex(x || hex(array_slice(b, tail + 1, octet_length(b)))) ELSE b END) AS kept_sha256
FROM d LEFT JOIN cut USING (r)"""

ORACLES = {"op1_url_filter": OP1, "op2_decontamination": OP2, "op3_substring_dedup": OP3, "op10_chat": OP10, "op11_prefix_trie": OP11, "op12_centroids": _clusters(), "op13_suffix_dedup": OP13}
