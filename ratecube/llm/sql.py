"""SQL for the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

from ratecube.llm import licenses

#: Documents with their words. The classes are those of the operators.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"
CLEAN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

MEASURES = rf"""
    plain AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{PLAIN_WORD}') AS words
        FROM {{documents}}
    ),
    windows AS (
        SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM plain)
    ),
    repeats AS (
        SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows), (SELECT unnest([0, 1, 2]) AS j)
        WHERE n > 1 GROUP BY doc_id
    ),
    lines AS (
        SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM plain)
        WHERE regexp_matches(line, '{PLAIN_WORD}') GROUP BY doc_id
    ),
    measures AS (
        SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM plain LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)
    ),
    ledger AS (
        SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
                + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
                + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
                + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
                + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
                + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS failures
        FROM measures
    )"""

QUALITY = f"""
WITH {MEASURES.format(documents="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failures = 0 AS kept, failures::BIGINT AS failures
FROM ledger
"""

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_scan() -> str:
    templates = ", ".join(f"({_quoted(n)}, [{', '.join(map(_quoted, g))}])" for n, t in licenses.TEMPLATES.items() if (g := licenses.template_bigrams(t)))
    return rf"""
WITH lines AS (
    SELECT doc_id, list_transform(string_split(coalesce({LOWERED}, ''), chr(10)), lambda x: regexp_extract_all(x, '{CLEAN_WORD}')) AS lines
    FROM documents
), units AS (
    SELECT doc_id, unnest(list_concat(lines, CASE WHEN len(list_filter(lines, lambda x: len(x) > 0)) > 1 THEN [flatten(lines)] ELSE [] END)) AS words
    FROM lines
), grams AS (
    SELECT doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams
    FROM units WHERE len(words) > 1
), pairs AS (
    SELECT doc_id, name, len(list_intersect(g.grams, t.grams)) AS common, len(g.grams) + len(t.grams) AS sizes
    FROM grams g JOIN (VALUES {templates}) t(name, grams)
      ON 2 * 10 * least(len(g.grams), len(t.grams)) >= 8 * (len(g.grams) + len(t.grams))
), good AS (
    SELECT *, 2.0::DOUBLE * common / sizes AS dice FROM pairs WHERE 2 * 10 * common >= 8 * sizes
)
SELECT d.doc_id, coalesce(u.n, 0) AS n_units, coalesce(p.n, 0) AS n_candidates, coalesce(g.n, 0) AS n_matches,
       coalesce(g.licenses, '') AS licenses, g.best_license, g.best_dice
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id) u USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM pairs GROUP BY doc_id) p USING (doc_id)
LEFT JOIN (
    SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
           (list(name ORDER BY dice DESC, name))[1] AS best_license, max(dice) AS best_dice
    FROM good GROUP BY doc_id
) g USING (doc_id)
"""


#: Hits of benchmark windows in documents; `{documents}` is the table to scan.
HITS = rf"""
    item_words AS (
        SELECT item_id, regexp_extract_all({LOWERED}, '{CLEAN_WORD}') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
    ),
    item_windows AS (
        SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i : i + 9], ' ') AS win
        FROM (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM item_words WHERE len(words) > 0)
    ),
    clean AS (
        SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '{CLEAN_WORD}') AS words FROM {{documents}}
    ),
    places AS (
        SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS win
        FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM clean, (SELECT DISTINCT n FROM item_windows))
    ),
    hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN item_windows w ON p.win = w.win AND p.n = w.n)"""

DECONTAMINATE = f"""
WITH {HITS.format(documents="documents")}
SELECT c.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM clean c
LEFT JOIN (
    SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM hits) GROUP BY doc_id
) USING (doc_id)
LEFT JOIN (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
) USING (doc_id)
"""


PHRASES = rf"""
WITH plain AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN_WORD}') AS words FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS win
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM plain)
),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, (SELECT unnest(range(35)) AS j)),
each AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM plain)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT p.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM plain p LEFT JOIN kept USING (doc_id)
"""

#: Components by the sets of shingles of `{size}` words, linked from `{percent}` of 100 on.
_COMPONENTS = rf"""
WITH RECURSIVE plain AS (
    SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '{PLAIN_WORD}') AS words FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(words[i : i + {{size}} - 1], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - {{size}} + 2))) AS i FROM plain WHERE len(words) > 0)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS MATERIALIZED (
    SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * common >= {{percent}} * (s.n + t.n - common)
),
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT doc_id, CASE WHEN other = a THEN b ELSE a END FROM reached JOIN links ON other = a OR other = b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""

COMPONENTS = _COMPONENTS.format(size=4, percent=85)
NEAR_COPIES = f"SELECT *, doc_id = component_id AS kept FROM ({_COMPONENTS.format(size=2, percent=80)})"

#: Bytes are pairs of hexadecimal digits here.
STRINGS = """
WITH plain AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
    SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM plain)
),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM strings) WHERE least < doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, p + j AS p FROM hits, (SELECT unnest(range(50)) AS j)),
each AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM plain)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS k FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
spans AS (
    SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before <> p - 1) AS n_spans
    FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM plain LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""


#: Characters of the terms of the ranked search.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = rf"""
WITH doc_terms AS MATERIALIZED (
    SELECT row, doc_id, term, count(*) AS tf
    FROM (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(coalesce({LOWERED}, ''), '{TERM}')) AS term FROM documents) GROUP BY ALL
),
sizes AS MATERIALIZED (SELECT row, sum(tf)::BIGINT AS n FROM doc_terms GROUP BY row),
totals AS MATERIALIZED (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM doc_terms GROUP BY term), totals
),
item_terms AS (
    SELECT item_id, unnest(regexp_extract_all(coalesce({LOWERED}, ''), '{TERM}')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)
),
scores AS (
    SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
    FROM item_terms JOIN weights USING (term) JOIN doc_terms USING (term) JOIN sizes USING (row), totals GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""


def _round(k: int) -> str:
    """Assignment k, and the centroids that follow from it."""
    return f"""
assigned{k} AS MATERIALIZED (
    SELECT i, min({{{{'d': d, 'n': n}}}}) AS best
    FROM (
        SELECT i, n, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM vectors, centroids{k}
    ) GROUP BY i
),
centroids{k + 1} AS MATERIALIZED (
    SELECT n, coalesce(mean, c) AS c FROM centroids{k} LEFT JOIN (
        SELECT n, list((total - ((total % size) + size) % size) // size ORDER BY j) AS mean
        FROM (
            SELECT best.n AS n, j, sum(v[j])::BIGINT AS total, count(*) AS size
            FROM assigned{k} JOIN vectors USING (i), (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL
        ) GROUP BY n
    ) USING (n)
)"""


def clusters(rounds: int = 5) -> str:
    steps = ",".join(_round(k) for k in range(rounds + 1)).replace("{{", "{").replace("}}", "}")
    return f"""
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
centroids0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY hash, v) - 1 AS n, v AS c
    FROM (SELECT sha256('2:' || vec_id) AS hash, v FROM vectors ORDER BY hash, v LIMIT 40)
),{steps}
SELECT vec_id, best.n::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.n))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM assigned{rounds} JOIN vectors USING (i) JOIN centroids{rounds} ON centroids{rounds}.n = best.n
"""
