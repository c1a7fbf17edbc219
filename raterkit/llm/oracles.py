"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from raterkit.llm import mixing, quality, queries, urls

BLANK = r"[\x20\x09-\x0D]"


def _quality() -> str:
    bits = " | ".join(f"CASE WHEN {test} THEN {1 << i} ELSE 0 END" for i, test in enumerate(quality.RULES.values()))
    base = quality.mask_of(quality.BASE_RULES)
    mask = quality.mask_of(quality.POLICIES[quality.CURRENT]) | base
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, CAST(sum(s) AS BIGINT) AS n_repeat_words
      FROM (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS s FROM p) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '{BLANK}+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT *, (failed & {base}) <> 0 AS base_failed, (failed & {mask}) = 0 AS kept,
       CAST({quality.CURRENT} AS INTEGER) AS policy FROM f"""


def _share(text: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 13) AS UBIGINT) AS DOUBLE) / {float(1 << 52)!r}"


def _mix() -> str:
    origin = f"'{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null') || ':' || ordinal"
    copy_key = "md5(origin || ':' || copy)"
    return f"""
WITH s AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS size FROM documents GROUP BY source),
h AS (SELECT source, size, pow(CAST(size AS DOUBLE), {mixing.ALPHA!r}) AS share FROM s),
t AS (SELECT CAST(sum(size) AS DOUBLE) AS all_size, sum(share) AS all_share FROM h WHERE size > 0),
v AS (SELECT source, CASE WHEN size > 0 THEN share / all_share * all_size / size ELSE 1.0 END AS rate FROM h, t),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM v),
p AS (SELECT source, k, exp(-rate + (CASE WHEN k > 0 THEN k * ln(rate) ELSE 0.0 END)
             - sum(CASE WHEN k > 0 THEN ln(CAST(k AS DOUBLE)) ELSE 0.0 END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
a AS (SELECT source, list(c ORDER BY k) AS cdf FROM c GROUP BY source),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text) AS ordinal FROM documents),
g AS (SELECT * EXCLUDE (ordinal), {origin} AS origin FROM o),
n AS (SELECT d.*, len(list_filter(cdf, lambda x: x <= {_share("origin")})) AS n
      FROM g d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
e AS (SELECT * EXCLUDE (n), CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM n)
SELECT * EXCLUDE (origin), {copy_key} AS shuffle_key FROM e"""


def _urls() -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    return f"""
WITH u AS (SELECT page_id, row_number() OVER () AS r,
             CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
v(verdict, h, p) AS (VALUES {values}),
f AS (SELECT r, h || p AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC,
             verdict = 'block' DESC, h || p DESC) AS k
      FROM s JOIN v ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, '{urls.DEFAULT}') AS verdict
FROM s LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (r)"""


def _exact() -> str:
    return f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '{BLANK}+', '', 'g')) AS text_sha256
           FROM documents),
k AS (SELECT doc_id, text_sha256, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, text_sha256 FROM k"""


def _suffix() -> str:
    return """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s
      FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
g AS (SELECT r, i, sum(b) OVER (PARTITION BY r ORDER BY i) AS g
      FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS b FROM f)),
s AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY r, g),
e AS (SELECT r, a, z FROM s UNION ALL SELECT r, length(h) // 2, NULL FROM d),
k AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z NULLS LAST), 0) AS x, a, z FROM e),
t AS (SELECT r, count(z) AS n_spans, coalesce(sum(z - a), 0) AS n_removed,
             string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (a - x) AS BIGINT)), '' ORDER BY a, z NULLS LAST) AS kept
      FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (r)"""


def _jaccard(words: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
       FROM documents),
g AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + {words - 1}), ' ') AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
m AS (SELECT a AS r, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = b GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""


def _tree(nodes: str, start: str, group: str) -> str:
    """Recursive tables of a tree's nodes, and of the digests folded from its leaves."""
    return f"""
{nodes} AS (SELECT {group} AS g, CAST(0 AS BIGINT) AS level, pos, size, digest FROM {start}
  UNION ALL SELECT g, level + 1, pos // 2, (any_value(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
            FROM {nodes} WHERE size > 1 GROUP BY g, level, pos // 2)"""


def _fold(folded: str, nodes: str, start: str) -> str:
    return f"""
{folded} AS (SELECT r, g, CAST(0 AS BIGINT) AS level, pos, size, cur, proof FROM {start}
  UNION ALL SELECT f.r, f.g, f.level + 1, f.pos // 2, (f.size + 1) // 2,
                   sha256(CASE WHEN s.pos < f.pos THEN s.digest ELSE '' END || cur || CASE WHEN s.pos > f.pos THEN s.digest ELSE '' END),
                   proof || coalesce(s.digest, '')
            FROM {folded} f LEFT JOIN {nodes} s ON s.g = f.g AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.size > 1)"""


def _merkle() -> str:
    fields = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || {c}, '-')" for c in queries.MANIFEST_FIELDS)
    steps = "lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    start = "CAST(4294967295 AS BIGINT)"
    return f"""
WITH RECURSIVE
k AS (SELECT list(c ORDER BY i) AS k FROM (SELECT i, list_reduce(list_prepend(i, range(8)), {steps}) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, CAST(n_chars AS HUGEINT) AS n_chars, text,
             xor({start}, list_reduce(list_prepend({start}, {codes}), lambda c, x: xor(c >> 8, k[(xor(c, x) & 255) + 1]))) % 7 = 0 AS changed
      FROM documents, k),
l AS (SELECT r, doc_id, lang, sha256({fields}) AS digest, changed FROM d),
t AS (SELECT r, sha256({fields}) AS other FROM (SELECT * REPLACE (n_chars + 1 AS n_chars) FROM d)),
o AS (SELECT DISTINCT lang, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l),
p AS (SELECT r, doc_id, g, digest, CASE WHEN changed THEN other ELSE digest END AS cur, '' AS proof,
             row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size
      FROM l JOIN t USING (r) JOIN o ON o.lang IS NOT DISTINCT FROM l.lang),{_tree("n", "p", "g")},{_fold("f", "n", "p")},
b AS (SELECT 0 AS g, g AS pos, (SELECT count(*) FROM o) AS size, digest FROM n WHERE size = 1),{_tree("m", "b", "0")},
w AS (SELECT f.r, 0 AS g, f.g AS pos, b.size, cur, proof, b.digest AS subroot FROM f JOIN b ON b.pos = f.g WHERE f.size = 1),{_fold("e", "m", "w")}
SELECT p.doc_id, p.digest AS leaf, w.subroot, m.digest AS root, sha256(e.proof) AS proof_sha256, e.cur AS folded_root, e.cur = m.digest AS verified
FROM e JOIN p USING (r) JOIN w USING (r) JOIN m ON m.size = 1 WHERE e.size = 1"""


def _forest() -> str:
    return f"SELECT *, component_id IS NOT DISTINCT FROM doc_id AS kept FROM ({_jaccard(queries.FOREST_WORDS, queries.FOREST_PERCENT)})"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": _suffix(),
        "op7_jaccard_join": _jaccard(queries.SHINGLE_WORDS, queries.SHINGLE_PERCENT),
        "op2_quality_rules": _quality(),
        "op4_poisson_mix": _mix(),
        "op6_url_rules": _urls(),
        "op10_exact_dedup": _exact(),
        "op12_merkle_manifest": _merkle(),
        "op13_minhash_forest": _forest(),
    }
