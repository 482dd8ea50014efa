"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from scrivana.llm.queries import SAID, WEIGHTS

_VALUES = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM w JOIN m USING (s) WHERE doc_id > least),
b AS (SELECT doc_id, j, substr(h, 2 * j - 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS j FROM d)),
k AS (SELECT b.doc_id, string_agg(x, '' ORDER BY j) AS kept FROM b ANTI JOIN c USING (doc_id, j) GROUP BY b.doc_id),
n AS (SELECT c.doc_id, count(*) AS n_removed, count(*) FILTER (p.j IS NULL) AS n_spans FROM c LEFT JOIN c p ON p.doc_id = c.doc_id AND p.j = c.j - 1 GROUP BY c.doc_id)
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP3 = f"""
WITH w(source, weight) AS (VALUES {_VALUES}),
n AS (SELECT source, count(*) AS rows FROM documents JOIN w USING (source) GROUP BY source),
r AS (SELECT source, weight::double / (SELECT sum(weight) FROM w JOIN n USING (source)) * (SELECT sum(rows) FROM n) / rows AS rate
      FROM n JOIN w USING (source)),
cdf AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
        FROM r, range(0, 100) t(k)),
steps AS (SELECT source, list(floor(least(p, 1) * 4503599627370496)::bigint ORDER BY k) AS s FROM cdf GROUP BY source),
counted AS (SELECT d.*, CASE WHEN s IS NULL THEN 1
              ELSE len(list_filter(s, lambda x: x <= ('0x' || substr(md5('17/0:' || d.doc_id), 1, 13))::bigint)) END AS c
            FROM documents d LEFT JOIN steps USING (source)),
copies AS (SELECT * EXCLUDE (c), unnest(range(0, c))::int AS mix_copy FROM counted)
SELECT *, ('0x' || substr(md5('17/order:' || doc_id || ':' || mix_copy), 1, 13))::bigint AS mix_order FROM copies
"""

OP4 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id,
             list_sum(list_transform(range(1, len(e.v) + 1), lambda i: q.v[i] * e.v[i]))::bigint AS score
      FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP5 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
r AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
m AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM s SEMI JOIN r USING (h)),
p AS (SELECT doc_id, list(j) AS gone FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k)), lambda k: w[k]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN p USING (doc_id)
"""

OP8 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'),
f AS (SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|ANS\]|/?SYS\]|/?ROLE\]|:\]|/?s>|(?:IMAGE|AUDIO|DOCUMENT):[0-9]+\])', '\1\\\2\3', 'g'))
             + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 11 ELSE 16 + length(role) END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::bigint AS formatted_chars, 0::bigint AS n_attachments, 0::bigint AS attachment_tokens
FROM f GROUP BY conv_id
"""


def _sets(table: str, key: str) -> str:
    """Distinct five-word shingles; a text of fewer words is one shorter shingle."""
    return f"""(SELECT DISTINCT {key}, len(w) AS n_words, s FROM (
        SELECT {key}, w, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM (SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                              '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})))"""


#: No item of the table has fewer than five words.
OP9 = f"""
WITH d AS {_sets('documents', 'doc_id')}, b AS {_sets('benchmark', 'item_id')},
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 100 >= n_shingles * 75
"""

OP10 = f"""
WITH RECURSIVE d AS MATERIALIZED {_sets('documents', 'doc_id')},
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE k * 100 >= 75 * (p.n + q.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON a = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffixdup": OP2, "op3_mixing": OP3, "op4_topk": OP4, "op5_windowdup": OP5, "op8_chat": OP8, "op9_decontaminate": OP9, "op10_neardup": OP10}
