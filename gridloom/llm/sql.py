"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

#: All pairs of texts that share a shingle, exactly; classes by reachability.
OP3 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_id, doc_id, text FROM documents
), w AS (
  SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d WHERE text IS NOT NULL
), k AS (
  SELECT row_id, CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])
                      WHEN len(words) > 0 THEN [words] ELSE [] END AS grams FROM w
), c AS (
  SELECT row_id, gram, count(*) AS n FROM (SELECT row_id, unnest(grams) AS gram FROM k) GROUP BY 1, 2
), t AS (
  SELECT row_id, sum(n) AS n FROM c GROUP BY 1
), o AS (
  SELECT a.row_id AS x, b.row_id AS y, sum(least(a.n, b.n)) AS shared
  FROM c a JOIN c b ON a.gram = b.gram AND a.row_id < b.row_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM o JOIN t p ON p.row_id = x JOIN t q ON q.row_id = y WHERE 5 * shared >= 4 * (p.n + q.n - shared)
  UNION ALL SELECT x, y FROM (SELECT min(row_id) OVER () AS x, row_id AS y FROM k WHERE len(grams) = 0) WHERE x <> y
), both_ways AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
  SELECT row_id AS a, row_id AS b FROM d
  UNION SELECT r.a, n.y FROM reach r JOIN both_ways n ON n.x = r.b
), classes AS (
  SELECT a, min(d.doc_id) AS class_id, count(*) AS class_size FROM reach JOIN d ON d.row_id = reach.b GROUP BY a
)
SELECT doc_id, class_id, class_size, doc_id IS NOT DISTINCT FROM class_id AS representative
FROM d JOIN classes ON classes.a = d.row_id
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         coalesce(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * d.c[i])), 0)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q
  JOIN v d ON q.vec_id <> d.vec_id AND len(q.c) = len(d.c)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: One word, one line rule: the phrases are those of line_rules.PHRASES.
OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), five AS (
  SELECT row_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5
), keyed AS (
  SELECT row_id, i, words[i:i + 4] AS k FROM five
), twice AS (
  SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, k) AS n FROM keyed) WHERE n > 1
), repeats AS (
  SELECT row_id, count(DISTINCT i + j) AS n FROM twice, range(5) t(j) GROUP BY row_id
), lines AS (
  SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d
), parts AS (
  SELECT row_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words,
         translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small FROM lines
), counted AS (
  SELECT *, length(array_to_string(words, '')) AS chars,
         len(regexp_extract_all(line, '[!-/:-@\[-`{-~]')) AS marks,
         len(list_filter(words, lambda x: regexp_matches(x, '[!-/:-@\[-`{-~]{2}$'))) AS tails,
         len(list_filter(words, lambda x: regexp_matches(x, '^[|>/*\-+=]$'))) AS lone
  FROM parts WHERE len(words) > 0
), judged AS (
  SELECT *, (100 * marks > 20 * chars OR 100 * tails > 30 * len(words) OR (lone >= 2 AND 100 * lone > 20 * len(words)) OR {phrases}) AS bad
  FROM counted
), by_line AS (
  SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines,
         coalesce(sum(chars) FILTER (bad), 0) AS lost_chars
  FROM judged GROUP BY row_id
), counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM d JOIN w USING (row_id) LEFT JOIN repeats USING (row_id) LEFT JOIN by_line USING (row_id)
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
)
SELECT *, NOT base_failed AND NOT 100 * lost_chars > 30 * word_chars AS kept FROM failed
"""

#: A run of period q and length n is n - q - 5 six-word windows in a row, each equal to the one q words on.  crc32 is worked out bit by bit.
OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), c AS (
  SELECT *, len(words) AS n, coalesce(xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)), 4294967295), 1) AS h FROM d
), g AS (
  SELECT *, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM c
), p AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS period FROM g
), w AS (
  SELECT row_id, doc_id, n, list_transform(range(0, n), lambda i: words[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % period ELSE i END]) AS words FROM p
), k AS (
  SELECT row_id, i, words[i + 1:i + 6] AS gram FROM (SELECT row_id, words, unnest(range(0, n - 5)) AS i FROM w WHERE n > 5)
), m AS (
  SELECT x.row_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.row_id = y.row_id AND x.gram = y.gram AND x.i < y.i
), s AS (
  SELECT row_id, q, min(i) AS first, count(*) + 5 + q AS size
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row_id, q ORDER BY i) AS island FROM m) GROUP BY row_id, q, island
), r AS (
  SELECT row_id, first, size, min(q) AS q FROM s WHERE size >= 12 AND size >= 2 * q GROUP BY row_id, first, size
), dropped AS (
  SELECT DISTINCT row_id, unnest(range(first + q, first + size)) AS i FROM r
), kept AS (
  SELECT row_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM (SELECT row_id, unnest(words) AS word, unnest(range(0, n)) AS i FROM w) e ANTI JOIN dropped USING (row_id, i) GROUP BY row_id
), report AS (
  SELECT row_id, count(*) AS n, string_agg(first || ',' || size || ',' || q || chr(10), '' ORDER BY first, q) AS lines FROM r GROUP BY row_id
), best AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY size DESC, first, q) = 1
)
SELECT doc_id, coalesce(report.n, 0)::BIGINT AS n_runs, best.first::BIGINT AS start, best.size::BIGINT AS length, best.q::BIGINT AS period,
       (1000 * best.size // best.q)::BIGINT AS exponent_milli, w.n::BIGINT AS n_words, coalesce(kept.n, 0)::BIGINT AS n_kept,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN report USING (row_id) LEFT JOIN best USING (row_id) LEFT JOIN kept USING (row_id)
"""

#: All pairs of a label, their cosines, and classes by reachability.
OP13 = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), u AS (
  SELECT row_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM d
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.row_id AS x, b.row_id AS y FROM u a JOIN u b ON a.label = b.label AND a.row_id <> b.row_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reach AS (
  SELECT row_id AS a, row_id AS b FROM d UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b
), least AS (
  SELECT a, min(vec_id) AS component_id FROM reach JOIN d ON d.row_id = reach.b GROUP BY a
), n AS (
  SELECT x, count(*) AS n_links FROM e GROUP BY x
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN least ON least.a = d.row_id LEFT JOIN n ON n.x = d.row_id
"""


def oracle_sql() -> dict[str, str]:
    from gridloom.llm.line_rules import PHRASES

    return {
        "op3_bagminhash": OP3,
        "op5_cover_tree": OP5,
        "op12_masked_runs": OP12,
        "op13_cross_polytope": OP13,
        "op6_line_rules": OP6.replace("{phrases}", " OR ".join(f"contains(small, '{p}')" for p in PHRASES)),
    }
