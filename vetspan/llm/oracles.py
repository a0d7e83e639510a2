"""DuckDB SQL for the corpus queries that SQL expresses, over the same tables."""

from __future__ import annotations

from .clusters import Clustering

#: Words of a text.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP3 = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
), kinds AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM kinds
"""

OP6 = r"""
WITH filled AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, row_number() OVER w - 1 AS position, lag(role, 1, '') OVER w AS before
  FROM filled WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, role IN ('system', 'user', 'assistant') AS known,
    CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END AS follows,
    list_transform([text, role], lambda x: 2 * length(x) - length(replace(x, '\', '')) + len(regexp_extract_all(x, '</?s>|\[/?(?:SYS|INST|ROLE)\]|\[OUT\]'))) AS sizes
  FROM turns
), written AS (
  SELECT *, sizes[1] + CASE role WHEN 'system' THEN length('<s>[SYS] ' || ' [/SYS]') WHEN 'user' THEN length('<s>[INST] ' || ' [/INST]')
    WHEN 'assistant' THEN length('[OUT] ' || ' </s>') ELSE length('[ROLE] ' || ' [/ROLE] ' || ' </s>') + sizes[2] END AS chars
  FROM sized
), told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars, min(position) FILTER (NOT follows) AS wrong, max_by(role, position) AS last
  FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, wrong IS NULL AND last = 'assistant' AS valid,
  CASE WHEN wrong IS NOT NULL THEN wrong WHEN last <> 'assistant' THEN n_turns END AS first_error
FROM told
"""

OP10 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _grams(n: int) -> str:
    return f"CASE WHEN lead(word, {n - 1}) OVER w IS NOT NULL THEN string_agg(word, ' ') OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS gram{n}"


def _repeats(n: int) -> str:
    return f"gram{n} IS NOT NULL AND count(*) OVER (PARTITION BY row, gram{n}) > 1 AS again{n}"


def _covers(n: int) -> str:
    return f"bool_or(again{n}) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS cover{n}"


def op8(shares: tuple[tuple[int, float], ...], line_share: float, window: int, min_words: int, percent: int) -> str:
    """SQL of the repetition rules: a word is covered by n where one of the last n windows stands in its text twice or more."""
    widths = sorted({window, *[n for n, _ in shares]})
    chars = ", ".join(f"CAST(coalesce(sum(length(word)) FILTER (cover{n}), 0) AS BIGINT) AS dup_{n}gram_chars" for n, _ in shares)
    empty = ", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n, _ in shares)
    worst = " OR ".join([*[f"dup_{n}gram_chars > CAST({most} AS DOUBLE) * greatest(word_chars, 1)" for n, most in shares], f"dup_line_chars > CAST({line_share} AS DOUBLE) * greatest(n_chars, 1)"])
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, unnest(list) AS word, generate_subscripts(list, 1) AS i FROM (SELECT row, {WORDS.format("text")} AS list FROM texts)),
grams AS (SELECT row, i, word, {", ".join(map(_grams, widths))} FROM words WINDOW w AS (PARTITION BY row ORDER BY i)),
repeats AS (SELECT row, i, word, {", ".join(map(_repeats, widths))} FROM grams),
covers AS (SELECT row, word, {", ".join(map(_covers, widths))} FROM repeats),
by_words AS (
  SELECT row, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (cover{window}) AS n_repeat_words, {chars}
  FROM covers GROUP BY row
),
lines AS (SELECT row, line, count(*) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row, line),
by_lines AS (SELECT row, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum((n - 1) * length(line)) AS BIGINT) AS dup_line_chars FROM lines GROUP BY row),
counts AS (
  SELECT doc_id, length(text) AS n_chars, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {empty}, coalesce(dup_line_chars, 0) AS dup_line_chars
  FROM texts LEFT JOIN by_words USING (row) LEFT JOIN by_lines USING (row)
),
judged AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {percent} * n_words AS base_failed FROM counts)
SELECT * EXCLUDE (n_chars), NOT base_failed AND NOT ({worst}) AS kept FROM judged
"""


def op9(words: int, percent: int) -> str:
    """SQL of the links and components: pairs of texts that share a shingle, measured on whole sets."""
    return rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS list FROM documents
), words AS (SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS i FROM texts),
runs AS (
  SELECT doc_id, i, count(*) OVER w AS n, string_agg(word, ' ') OVER w AS shingle
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {words - 1} FOLLOWING)
), shingles AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE n = {words} OR i = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= {percent} * (x.n + y.n - s.n)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
groups AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN groups USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


#: Runs of letters, digits and characters beyond ASCII, A-Z lower-cased.
PLAIN = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {PLAIN.format("text")} AS list FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT row, doc_id, CAST(len(list) AS BIGINT) AS n FROM docs WHERE len(list) > 0),
totals AS (SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS words FROM sizes),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(list) AS term FROM docs) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * texts + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, texts),
items AS (SELECT row_number() OVER () AS item, item_id, {PLAIN.format("text")} AS list FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT DISTINCT item, item_id, unnest(list) AS term FROM items),
scores AS (
  SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * texts) // words)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

_GRAMS = ", ".join(f"string_agg(word, ' ') OVER (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g{n}" for n in range(1, 11))
_OF_SIZE = " ".join(f"WHEN {n} THEN g{n}" for n in range(1, 11))
OP12 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {PLAIN.format("coalesce(text, '')")} AS list FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {PLAIN.format("coalesce(text, '')")} AS list FROM benchmark),
starts AS (SELECT item, list, least(len(list), 10) AS size, unnest(range(1, greatest(len(list) - 9, 1) + 1)) AS i FROM items WHERE len(list) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(list[i : i + size - 1], ' ') AS gram FROM starts),
words AS (SELECT row, unnest(list) AS word, generate_subscripts(list, 1) AS i, len(list) AS n FROM docs),
grams AS (SELECT row, i, n, {_GRAMS} FROM words),
found AS (SELECT row, i, size, gram FROM (SELECT row, i, n, size, CASE size {_OF_SIZE} END AS gram FROM grams, (SELECT DISTINCT size FROM windows)) SEMI JOIN windows USING (size, gram) WHERE i + size - 1 <= n),
hits AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS word FROM found) GROUP BY row),
owners AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row, item FROM found JOIN windows USING (size, gram)) GROUP BY row)
SELECT doc_id, CAST(len(list) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (row) LEFT JOIN owners USING (row)
"""


def op13(rule: Clustering) -> str:
    """SQL of the clustering, a few steps for each round."""
    steps = []
    for i in range(rule.rounds + 1):
        steps.append(f"""gaps{i} AS MATERIALIZED (
  SELECT row, vec_id, x.v, c.cluster, c.v AS centre, CAST(list_sum(list_transform(range(1, {rule.dimensions + 1}), lambda j: (x.v[j] - c.v[j]) * (x.v[j] - c.v[j]))) AS BIGINT) AS distance
  FROM kept x, centroids{i} c
), own{i} AS MATERIALIZED (SELECT * FROM gaps{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if i < rule.rounds:
            steps.append(f"""parts{i} AS (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM own{i}),
means{i} AS (SELECT cluster, j, sum(x) AS s, count(*) AS n FROM parts{i} GROUP BY cluster, j),
moved{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM means{i} GROUP BY cluster),
centroids{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM centroids{i} c LEFT JOIN moved{i} m USING (cluster))""")
    last = rule.rounds
    return f"""
WITH whole AS (SELECT row_number() OVER () AS row, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {rule.dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {rule.dimensions}),
kept AS MATERIALIZED (SELECT row, vec_id, list_transform(e, lambda x: CAST(floor(CAST(x AS DOUBLE) * {rule.scale}) AS BIGINT)) AS v FROM whole),
centroids0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{rule.seed}' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM kept QUALIFY cluster < {rule.clusters}),
{", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256
FROM own{last}
"""
