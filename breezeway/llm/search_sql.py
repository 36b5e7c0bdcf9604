"""DuckDB's SQL for the search query."""

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = (f"regexp_extract_all(translate(text, '{_A_TO_Z}', '{_A_TO_Z.lower()}'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

SEARCH_SQL = f"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE len({_TERMS}) > 0),
totals AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM docs),
asked AS (
    SELECT item_id, i, term, count(*) AS times
    FROM (SELECT i, item_id, unnest(terms) AS term
          FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark)) GROUP BY ALL),
bags AS MATERIALIZED (
    SELECT r, doc_id, term, count(*) AS tf, max(m) AS m FROM (
        SELECT r, doc_id, unnest(terms) AS term, 75 + (25 * len(terms) * (SELECT n FROM totals)) // (SELECT l FROM totals) AS m FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * (SELECT n FROM totals) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM bags GROUP BY term),
scored AS (
    SELECT item_id, i, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN bags USING (term) GROUP BY item_id, i, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
