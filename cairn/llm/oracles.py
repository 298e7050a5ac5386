"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from cairn.llm.mixing import BITS, LEVELS

#: Targets: the level of the sources below their limit is that of the first prefix of sources (in the
#: order of limit by weight) whose next member stays below its own.  Documents: in the order of
#: their hashes, repeated rows by one of their own each, while the budget lasts; the one it ends in if that is nearer.
MIXING = f"""
WITH plain AS (
  SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS * LEVELS // 4}))::BIGINT AS hash
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, src, hash) - 1 AS turn FROM plain
), docs AS (
  SELECT doc_id, src, size, CASE WHEN turn = 0 THEN hash ELSE ('0x' || substr(md5(hash::VARCHAR || ':' || turn::VARCHAR), 1, {BITS * LEVELS // 4}))::BIGINT END AS hash FROM numbered
), sizes AS (
  SELECT src, sum(size)::BIGINT AS source_size FROM docs GROUP BY src
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS lim FROM sizes
), filled AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM weighed WINDOW w AS (ORDER BY lim / weight, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest / open AS level FROM filled WHERE rest / open * weight <= lim ORDER BY lim / weight LIMIT 1
), goals AS (
  SELECT src, source_size, CASE WHEN (SELECT level FROM level) IS NULL THEN lim ELSE least(lim, (SELECT level FROM level) * weight) END AS target FROM weighed
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE 0 END AS budget
  FROM goals
), steps AS (
  SELECT src, hash, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY src ORDER BY hash) AS upto FROM docs GROUP BY src, hash
), bounds AS (
  SELECT b.src, min(CASE WHEN s.upto > b.budget THEN s.hash END) AS edge, max(CASE WHEN s.upto <= b.budget THEN s.upto END) AS used
  FROM budgets b JOIN steps s ON s.src IS NOT DISTINCT FROM b.src GROUP BY b.src
), below AS (
  SELECT o.src, coalesce(o.edge + CASE WHEN 2 * (b.budget - coalesce(o.used, 0)) >= s.n THEN 1 ELSE 0 END, {1 << (BITS * LEVELS)}) AS below
  FROM bounds o JOIN budgets b ON b.src IS NOT DISTINCT FROM o.src LEFT JOIN steps s ON s.src IS NOT DISTINCT FROM o.src AND s.hash = o.edge
)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.whole + CASE WHEN d.hash < w.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN budgets b ON b.src IS NOT DISTINCT FROM d.src JOIN below w ON w.src IS NOT DISTINCT FROM d.src
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.b
), comp AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), links AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.a = e.vec_id LEFT JOIN links l ON l.a = e.vec_id
"""

ORACLES: dict[str, str] = {"op4_mixing": MIXING, "op9_embeddings": EMBEDDINGS}

WORD = r"[^\x20\x09-\x0D]+"
#: Windows of 2 to 10 words as joined strings; words hold no spaces, so equal strings are equal windows.
RULES = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), base AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM docs
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
), repeats AS (
  SELECT r, line FROM lines WHERE regexp_matches(line, '{WORD}') QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1
), dup_lines AS (
  SELECT r, count(*) AS n_dup_lines, sum(list_sum(list_transform(regexp_extract_all(line, '{WORD}'), lambda x: length(x)))) AS dup_chars FROM repeats GROUP BY r
), windows AS (
  SELECT r, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS g FROM docs, range(2, 11) t(n), unnest(range(1, len(words) - n + 2)) u(i)
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY r, n, g) AS c, row_number() OVER (PARTITION BY r, n, g ORDER BY i) AS nth FROM windows QUALIFY c > 1
), repeat_words AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM counted, unnest(range(i, i + 3)) u(p) WHERE n = 3 GROUP BY r
), most AS (
  SELECT r, n, max(c) AS c FROM counted WHERE n < 5 GROUP BY r, n
), top AS (
  SELECT m.r, m.n, least(1.0::DOUBLE, (m.c * max(length(x.g) - (m.n - 1)))::DOUBLE / any_value(b.word_chars)) AS share
  FROM most m JOIN counted x USING (r, n, c) JOIN base b USING (r) GROUP BY m.r, m.n, m.c
), inside AS (
  SELECT DISTINCT r, n, p FROM counted, unnest(range(i, i + n)) u(p) WHERE n > 4 AND nth > 1
), dup AS (
  SELECT r, n, sum(length(d.words[p]))::DOUBLE / any_value(b.word_chars) AS share FROM inside JOIN docs d USING (r) JOIN base b USING (r) GROUP BY r, n
), limits AS (
  SELECT * FROM (VALUES (2, 0.20::DOUBLE), (3, 0.18), (4, 0.16), (5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10)) l(n, most)
), verdicts AS (
  SELECT r, max(CASE WHEN n < 5 THEN share END) AS top_share, max(CASE WHEN n > 4 THEN share END) AS dup_share, bool_or(share > most) AS bad
  FROM (SELECT * FROM top UNION ALL SELECT * FROM dup) JOIN limits USING (n) GROUP BY r
), joined AS (
  SELECT b.*, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(w.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(v.top_share, 0.0::DOUBLE) AS top_share, coalesce(v.dup_share, 0.0::DOUBLE) AS dup_share,
         CASE WHEN word_chars > 0 THEN coalesce(l.dup_chars, 0)::DOUBLE / word_chars ELSE 0 END AS line_share, coalesce(l.dup_chars, 0) AS dup_chars, coalesce(v.bad, false) AS bad
  FROM base b LEFT JOIN dup_lines l USING (r) LEFT JOIN repeat_words w USING (r) LEFT JOIN verdicts v USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, top_share, dup_share, line_share,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT bad AND NOT dup_chars > 0.20::DOUBLE * word_chars AS kept
FROM joined
"""

ORACLES["op7_quality_rules"] = RULES
