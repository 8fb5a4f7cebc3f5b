"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_THREE = "unnest([t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] FOR i IN range(0, len(t) - 2)])"

# By definition, with no masks: whatever stretch agrees to 80 % has three equal tokens in a row, and so
# each alignment at which the texts have that is tried in full.
DECONTAMINATION = f"""
WITH b AS (SELECT t, min(item_id) AS item_id FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark) GROUP BY t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS t FROM documents),
bp AS (SELECT item_id, unnest(range(0, len(t) - 2)) AS q, {_THREE} AS s FROM b WHERE len(t) >= 12),
dp AS (SELECT r, unnest(range(0, len(t) - 2)) AS p, {_THREE} AS s FROM d WHERE len(t) >= 12),
alignments AS (SELECT DISTINCT r, item_id, p - q AS shift FROM dp JOIN bp USING (s)),
stretches AS (
  SELECT doc_id, item_id, shift, d.t AS x, b.t AS y, greatest(0, shift) AS lo, least(len(d.t), len(b.t) + shift) AS hi,
    least(16, len(b.t), greatest(12, len(d.t))) AS needed
  FROM alignments JOIN d USING (r) JOIN b USING (item_id)),
windows AS (SELECT *, greatest(z - 6, lo) AS a, least(z + 18, hi) AS e
            FROM (SELECT *, unnest(range(lo, hi - 11)) AS z FROM stretches)),
compared AS (SELECT doc_id, item_id, needed, e - a AS n, len([1 FOR i IN range(a, e) IF x[i + 1] = y[i - shift + 1]]) AS same FROM windows)
SELECT DISTINCT doc_id, item_id FROM compared WHERE n >= needed AND 100 * same >= 80 * n
UNION
SELECT doc_id, item_id FROM d JOIN b ON len(b.t) BETWEEN 1 AND 11
  AND contains(' ' || array_to_string(d.t, ' ') || ' ', ' ' || array_to_string(b.t, ' ') || ' ')
"""

_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_PHRASES = ("cookie|privacy policy|terms of use|terms of service|all rights reserved|subscribe|newsletter|sign in|log in|"
            "sign up|click here|read more|share this|javascript|skip to content|back to top|lorem ipsum")


def _n(pattern: str, text: str = "line") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


LINE_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, {_WORDS.format('x')} AS w,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
rep AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM g3, (VALUES (0), (1), (2)) v(o) WHERE n >= 2 GROUP BY r),
ln AS (SELECT r, line, len({_WORDS.format('line')}) AS own, len(list_distinct({_WORDS.format('line')})) AS kinds
       FROM (SELECT DISTINCT r, unnest(lines) AS line FROM w)),
judged AS (SELECT r, line, own,
    ({_n('[|»›·•>]')} >= 3 AND {_n('[|»›·•>]')} * 8 >= own)
    OR {_n('[#*$%&|<>~^={}\\\\_]')} * 12 >= length(line)
    OR ({_n('[!?]{2,}')} > 0 AND {_n('[!?]{2,}')} * 4 >= own)
    OR (own >= 5 AND {_n('\\p{Lu}')} * 2 >= length(line))
    OR (own >= 10 AND kinds * 5 <= own)
    OR (own <= 4 AND NOT regexp_matches(line, '[.!?…:;,"''”»)\\]。！？][\\x20\\x09-\\x0D]*$'))
    OR (own < 20 AND regexp_matches(lower(line), '{_PHRASES}')) AS bad FROM ln),
left_over AS (SELECT r, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS n_bad_lines,
    sum(CASE WHEN bad THEN 0 ELSE length(line) END) AS good_chars, sum(CASE WHEN bad THEN 0 ELSE own END) AS good_words
  FROM judged GROUP BY r),
all_of AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars,
    {_n('[#*$%&|<>]', 'x')}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines)::BIGINT AS n_lines, coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0) AS line_chars FROM w)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words)
    AND 100 * coalesce(good_chars, 0) >= 50 * line_chars AND coalesce(good_words, 0) >= 50 AS kept,
  n_lines, coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines
FROM all_of LEFT JOIN rep USING (r) LEFT JOIN left_over USING (r)
"""

COLLOCATIONS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (SELECT d, lang, unnest(range(len(pieces))) AS p, unnest(pieces) AS piece FROM docs),
lists AS (SELECT d, lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, d, p, unnest(range(len(w))) AS i, unnest(w) AS w FROM lists),
runs AS (SELECT lang, w AS x, lead(w) OVER piece AS y, lead(w, 2) OVER piece AS z FROM words
         WINDOW piece AS (PARTITION BY d, p ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, x AS phrase, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y, count(*) FROM runs WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, count(*) FROM runs WHERE z IS NOT NULL GROUP BY ALL),
candidates AS MATERIALIZED (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ') AND f >= 10),
parts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r,
    (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score
  FROM parts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE len(w) = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE len(w) = 3) GROUP BY ALL),
ranked AS (
  SELECT c.lang, c.phrase, a, l, r, score,
    row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(c.phrase)) AS rank
  FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

HARD_NEGATIVES = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM rows a, rows r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
