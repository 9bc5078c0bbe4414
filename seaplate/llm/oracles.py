"""SQL counterparts of the operators' queries, where SQL can express them on whole tables.

Without one: language ID and quality (trained here), token planes (a tokenizer), the mix (its order comes from a
hash that the SQL engine lacks), repeated strings (too slow over whole tables) and the pipeline.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REACH = """
reach AS (
    SELECT id, id AS other FROM nodes
    UNION
    SELECT reach.id, links.y FROM reach JOIN links ON reach.other = links.x
),
parts AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

OP4 = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
),
nodes AS (SELECT vec_id AS id FROM embeddings),
{REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE x = id) AS n_links, component_id, id = component_id AS kept FROM parts
"""

OP7 = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
),
nodes AS (SELECT doc_id AS id FROM documents),
{REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept
FROM parts LEFT JOIN n ON n.doc_id = id
"""

OP8 = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
places AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t),
x AS (
    SELECT doc_id, i, ls[i] AS line,
           translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM places
),
f AS (SELECT k, max(doc_id) AS last FROM x WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT x.doc_id, i, line, coalesce(x.doc_id <> f.last, false) AS gone FROM x LEFT JOIN f ON x.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP9 = rf"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
windows AS (
    SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + 12], ' ') AS g
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM item_words WHERE len(ws) > 0)
),
w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM places),
found AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id
"""

OP10 = """
WITH r AS (
    SELECT page_id,
           replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS address,
           coalesce(html, '') AS body, chr(13) || chr(10) AS e
    FROM pages
),
t AS (
    SELECT page_id,
           'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || e
           || 'WARC-Target-URI: ' || address || e || 'WARC-Date: 1970-01-01T00:00:00Z' || e || 'Content-Type: text/html' || e
           || 'Content-Length: ' || strlen(body)::VARCHAR || e || e || body AS record
    FROM r
)
SELECT page_id, strlen(record) AS n_bytes, sha256(record) AS record_sha256, coalesce(page_id % 97 = 5, false) AS damaged FROM t
"""

def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR, '-')"


def _climb(name: str, levels: int) -> str:
    """Levels ``{name}0`` on of (t, i, d) nodes; ``{name}p0`` on have each node's siblings, left and right."""
    out = []
    for k in range(levels):
        around = "OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(f"""{name}p{k} AS (
    SELECT t, i, d, count(*) OVER (PARTITION BY t) AS c,
           coalesce(string_agg(d, '') {around} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(d, '') {around} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}{k}
),
{name}{k + 1} AS (
    SELECT t, i // 8 AS i, CASE WHEN max(c) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
    FROM {name}p{k} GROUP BY t, i // 8
)""")
    return ",\n".join(out)


def _fold(name: str, nodes: str, levels: int) -> str:
    """Steps ``{name}0`` on of (n, t, i, o, proof): the digest folded so far, and the siblings passed."""
    return ",\n".join(
        f"""{name}{k + 1} AS (
    SELECT n, t, i // 8 AS i, CASE WHEN c = 1 THEN o ELSE sha256(l || o || r) END AS o, proof || l || r AS proof
    FROM {name}{k} JOIN {nodes}p{k} USING (t, i)
)"""
        for k in range(levels)
    )


# Trees of up to 8**7 leaves, up to 8**3 of them.
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP11 = f"""
WITH rows_ AS (
    SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS t, sha256({_LEAF} || {_field("text")}) AS leaf,
           list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, b: list_reduce(range(8),
               lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295) AS crc,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
    FROM documents
),
numbered AS (
    SELECT *, row_number() OVER () AS n, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
           CASE WHEN xor(crc, 4294967295) % 3 = 0 AND text IS NOT NULL THEN sha256({_LEAF} || {_field("lowered")}) ELSE leaf END AS changed
    FROM rows_
),
a0 AS (SELECT t, i, leaf AS d FROM numbered),
{_climb("a", 7)},
b0 AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, d, t AS tree FROM a7),
{_climb("b", 3)},
s0 AS (SELECT n, t, i, changed AS o, '' AS proof FROM numbered),
{_fold("s", "a", 7)},
u0 AS (SELECT n, b0.t, b0.i, o, proof FROM s7 JOIN b0 ON s7.t = b0.tree),
{_fold("u", "b", 3)}
SELECT doc_id, leaf, a7.d AS subroot, b3.d AS root, sha256(proof) AS proof_sha256, o AS folded_root, o = b3.d AS verified
FROM numbered JOIN u3 USING (n) JOIN a7 ON a7.t = numbered.t JOIN b3 ON true
"""

OP12 = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
    SELECT lang, ws[i:i + m - 1] AS g FROM (
        SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(m) WHERE len(ws) >= m)
),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 30),
candidates AS (SELECT * FROM f WHERE len(g) >= 2),
cuts AS (
    SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidates) c
    JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]
),
weakest AS (SELECT lang, g, a, min((score, k, l, r)) AS cut FROM cuts GROUP BY lang, g, a),
inside AS (
    SELECT lang, a, g[i:i + m - 1] AS g FROM (
        SELECT lang, a, g, m, unnest(range(1, len(g) - m + 2)) AS i FROM candidates CROSS JOIN (VALUES (2), (3)) AS t(m) WHERE len(g) > m)
),
longer AS (SELECT lang, g, max(a) AS most FROM inside GROUP BY lang, g),
kept AS (
    SELECT c.lang, array_to_string(c.g, ' ') AS phrase, a, cut[3]::BIGINT AS l, cut[4]::BIGINT AS r, cut[1]::BIGINT AS score
    FROM weakest c LEFT JOIN longer ON longer.lang = c.lang AND longer.g = c.g WHERE most IS NULL OR 100 * most < 80 * a
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000
"""

OP13 = r"""
WITH w AS (
    SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
windows AS (
    SELECT n, doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h
    FROM (SELECT n, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (
    SELECT DISTINCT n, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE doc_id > least
),
words AS (SELECT n, doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
    SELECT words.n, string_agg(ws[words.p], ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS kept, count(gone.p) AS n_removed
    FROM words LEFT JOIN gone ON gone.n = words.n AND gone.p = words.p GROUP BY words.n
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (n)
"""

ORACLES: dict[str, str] = {
    "op4_embedding_neardup": OP4,
    "op7_minhash": OP7,
    "op8_line_dedup": OP8,
    "op9_decontaminate": OP9,
    "op10_warc_audit": OP10,
    "op11_merkle_manifest": OP11,
    "op12_collocations": OP12,
    "op13_passage_dedup": OP13,
}
