"""DuckDB SQL for those corpus queries that SQL can express whole."""

from scrivia.llm.secrets import RULES

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
own AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN own USING (rid)
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), [])"

#: All pairs through an inverted index of shingles; classes by reachability.
OP1 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY x.rid, y.rid),
link AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 10 * common >= 8 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a AS rid, min(doc_id) AS least_id FROM reach JOIN d ON d.rid = b GROUP BY a),
links AS (SELECT a AS rid, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(least(doc_id, least_id), doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN class USING (rid) LEFT JOIN links USING (rid)
"""

#: crc32 is computed by its definition, bit by bit for the 256 bytes, then byte by byte.
OP7 = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
ids AS (SELECT DISTINCT doc_id AS id FROM documents),
held AS (SELECT id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 1 AS held FROM ids, crc),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(held, false) AS held_out, list_append({_WORDS}, '') AS w FROM documents LEFT JOIN held ON id = doc_id),
flat AS (SELECT rid, held_out, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
tok AS (SELECT rid, held_out, t, lag(t, 1, ' ') OVER (PARTITION BY rid ORDER BY i) AS u FROM flat),
one AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t),
two AS (SELECT u, t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY u, t),
context AS (SELECT u, sum(c) AS c FROM two GROUP BY u),
total AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM one),
p AS (SELECT rid, coalesce(one.c, 0) AS c, (coalesce(one.c, 0) + 0.5::DOUBLE) / (total.n + 0.5::DOUBLE * (total.v + 1)) AS root, coalesce(two.c, 0) AS pair, coalesce(context.c, 0) AS before, n
      FROM tok CROSS JOIN total LEFT JOIN one ON one.t = tok.t LEFT JOIN two ON two.u = tok.u AND two.t = tok.t LEFT JOIN context ON context.u = tok.u),
a AS (SELECT rid, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens, sum(log10(root)) AS base_score, sum(log10((pair + 16 * root) / (before + 16))) AS score FROM p GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM d JOIN a USING (rid)
"""

#: All windows of 400 bytes; texts as hex, cut into overlapping stretches so that no window is sought in a long text.
OP8 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
stretch AS (SELECT rid, k, substr(h, 2 * k + 1, 1054) AS s, n FROM (SELECT rid, h, len(h) // 2 - 399 AS n, unnest(range(0, greatest(len(h) // 2 - 399, 0), 128)) AS k FROM d)),
win AS (SELECT rid, k + i AS place, md5_number(substr(s, 2 * i + 1, 800)) AS m FROM (SELECT rid, k, s, unnest(range(0, least(128, n - k))) AS i FROM stretch)),
again AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
hit AS (SELECT rid, place, place - lag(place) OVER (PARTITION BY rid ORDER BY place) <= 400 AS joined FROM win WHERE m IN (SELECT m FROM again)),
numbered AS (SELECT rid, place, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY place) AS run FROM hit),
runs AS (SELECT rid, min(place) AS b, max(place) + 400 AS e FROM numbered GROUP BY rid, run),
gaps AS (SELECT rid, b, e, lag(e, 1, 0) OVER (PARTITION BY rid ORDER BY b) AS last_e FROM runs),
a AS (SELECT rid, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last_e, string_agg(substr(h, 2 * last_e + 1, 2 * (b - last_e)), '' ORDER BY b) AS head FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last_e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN a USING (rid)
"""


def _op5() -> str:
    """The rules of the operator as SQL: matches, the gaps between them, and so their places."""
    parts = []
    for rank, rule in enumerate(RULES):
        regex = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, regexp_extract_all(t, '{regex}') AS m, regexp_extract_all(t, '{regex}', {rule.group}) AS p,
            string_split_regex(t, '{regex}') AS g, {rule.least} AS least FROM d WHERE regexp_matches(t, '{regex}')""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
y AS (SELECT rid, rank, kind, least, len(p[i]) AS n, list_sum(list_transform(g[1:i], lambda v: len(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: len(v))), 0) AS b, len(m[i]) AS l FROM x),
s AS (SELECT rid, rank, kind, CAST(b AS BIGINT) AS b, CAST(b + l AS BIGINT) AS e FROM y WHERE n >= least),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""

#: All pairs through an inverted index of shingles; components by reachability.
OP11 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + least(len(w), 4) - 1), ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY x.rid, y.rid),
link AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a AS rid, min(doc_id) AS least_id FROM reach JOIN d ON d.rid = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(doc_id, least_id), doc_id) AS component_id, coalesce(doc_id = least(doc_id, least_id), doc_id IS NOT NULL) AS kept
FROM d LEFT JOIN class USING (rid) LEFT JOIN n USING (rid)
"""

OP13 = """
WITH r AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
s AS (SELECT a.k, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, b.label, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id, label) AS place FROM s WHERE same AND id <> anchor_id QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.id, s.label) AS rank
    FROM p JOIN s ON s.k = p.k AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLE_SQL = {"op1_ngram_jaccard_join": OP1, "op5_secret_scan": _op5(), "op7_lm_scoring": OP7, "op8_suffix_dedup": OP8, "op10_decontamination": OP10, "op11_minhash_near_dedup": OP11, "op13_hard_negatives": OP13}
