"""SQL (DuckDB) for the numbered queries that it can express."""

SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

KNN = """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), scored AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             max(CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT)) AS score
      FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
      WHERE q.vec_id % 50 = 0
      GROUP BY q.vec_id, c.vec_id
    ), ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
      FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

HARD_NEGATIVES = """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
             CAST(coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM v AS a JOIN v AS c ON a.vec_id <> c.vec_id
      WHERE a.vec_id % 100 = 0
    ), positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
"""

NEAR_DUP = rf"""
    WITH RECURSIVE worded AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '{WORD}+') AS w FROM documents
    ), sets AS (
      SELECT doc_id, CASE
        WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
      END AS s FROM worded
    ), each AS (
      SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
    ), common AS (
      SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n_x, any_value(b.n) AS n_y, count(*) AS n
      FROM each AS a JOIN each AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id
    ), links AS (
      SELECT x, y FROM common WHERE 100 * n >= 85 * (n_x + n_y - n)
    ), reach AS (
      SELECT doc_id, doc_id AS other FROM documents
      UNION
      SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other
    ), least AS (
      SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
    )
    SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

_LEDGER = rf"""
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS t FROM documents
    ), parts AS (
      SELECT doc_id, t, regexp_extract_all(t, '{WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM texts
    ), windows AS (
      SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'i': i, 'x': array_to_string(w[i:i + 2], ' ')}})) AS a FROM parts
    ), again AS (
      SELECT doc_id, a.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a.x) >= 2
    ), covered AS (
      SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
    ), characters AS (
      SELECT doc_id, unnest(regexp_extract_all(t, '(?s).')) AS c, unnest(range(length(t))) AS i FROM texts
    ), stretches AS (
      SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS stretch FROM characters WHERE regexp_matches(c, '{WORD}')
    ), runs AS (
      SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, count(*) AS n FROM stretches GROUP BY doc_id, c, stretch HAVING count(*) >= 6) GROUP BY doc_id
    ), measured AS (
      SELECT doc_id, len(w) AS n_words,
        length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(covered.n, 0) AS n_repeat_words,
        len(lines) AS n_lines,
        length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
        len(list_filter(lines, lambda x: regexp_matches(x, '^{SPACE}*([-*]({SPACE}|$)|\x{{2022}})'))) AS n_bullets,
        len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|\x{{2026}}){SPACE}*$'))) AS n_cut_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{C0}}-\x{{10FFFF}}]'))) AS n_wordy,
        len(list_filter(w, lambda x: length(x) > 30)) AS n_long_words,
        coalesce(runs.n, 0) AS n_run_chars
      FROM parts LEFT JOIN covered USING (doc_id) LEFT JOIN runs USING (doc_id)
    ), rule_bits (bit, rule) AS (
      VALUES (1, 'few_words'), (2, 'repeated_words'), (4, 'short_or_long_words'), (8, 'symbols'), (16, 'duplicate_lines'), (32, 'capitals'),
        (64, 'bullets'), (128, 'cut_lines'), (256, 'no_letters'), (512, 'long_words'), (1024, 'runs')
    ), ledger AS (
      SELECT *, CAST(
          CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 4 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 20 * greatest(n_words, 1) THEN 8 ELSE 0 END
        + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END
        + CASE WHEN n_letters >= 50 AND 100 * n_capitals > 40 * n_letters THEN 32 ELSE 0 END
        + CASE WHEN n_lines >= 3 AND 100 * n_bullets > 90 * n_lines THEN 64 ELSE 0 END
        + CASE WHEN n_lines >= 3 AND 100 * n_cut_lines > 30 * n_lines THEN 128 ELSE 0 END
        + CASE WHEN 100 * n_wordy < 60 * n_words THEN 256 ELSE 0 END
        + CASE WHEN 100 * n_long_words > 10 * n_words THEN 512 ELSE 0 END
        + CASE WHEN 100 * n_run_chars > 20 * word_chars THEN 1024 ELSE 0 END
      AS BIGINT) AS failed_bits FROM measured
    )
"""

RULES = f"""{_LEDGER}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits, rule AS only_rule
    FROM ledger LEFT JOIN rule_bits ON failed_bits = bit
"""

ABLATION = f"""{_LEDGER}, policies (policy, mask) AS (
      VALUES ('base', 3), ('2', 63), ('3', 2047)
    )
    SELECT policy, rule, count(*) FILTER (WHERE failed_bits & bit <> 0) AS failed, count(*) FILTER (WHERE failed_bits & mask = bit) AS only_this,
      count(*) FILTER (WHERE failed_bits & mask <> 0) AS dropped, count(*) AS rows
    FROM ledger, policies JOIN rule_bits ON mask & bit <> 0
    GROUP BY policy, rule
"""
