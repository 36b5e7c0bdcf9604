"""DuckDB's SQL for the quality query."""

from breezeway.llm.quality import BITS, MEASURES, QUANTILES, WINDOW

_MEASURE_ROWS = " UNION ALL ".join(
    f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM measured WHERE NOT base_failed" for m in MEASURES)
# the median, an upper quantile, how far a fence reaches beyond it, and 5 per mille
_FENCE = """CASE measure WHEN 'symbol_share' THEN q500 + 8 * (q750 - q500) + 5 WHEN 'mark_share' THEN q500 + 8 * (q750 - q500) + 5
    WHEN 'same_word_share' THEN q500 + 6 * (q900 - q500) + 5 WHEN 'capital_share' THEN q500 + 6 * (q900 - q500) + 5
    WHEN 'dup_line_share' THEN q500 + 3 * (q980 - q500) + 5 WHEN 'repeat_share' THEN q500 + 3 * (q980 - q500) + 5 END"""
_SHIFT = f"greatest(length(bin(v)) - {BITS}, 0)"


def _fences(group: str, label: str) -> str:
    by = f"{group}, measure" if group else "measure"
    some = f"CASE WHEN n >= 100 THEN {{}} END" if group else "{}"
    quant = ", ".join(f"min(bucket) FILTER (1000 * upto >= {q} * n) AS q{q}" for q in QUANTILES)
    return f"""{label} AS (SELECT {by}, {some.format(_FENCE)} AS fence FROM (
        SELECT {by}, max(n) AS n, {quant} FROM (
            SELECT {by}, bucket, sum(count(*)) OVER (PARTITION BY {by} ORDER BY bucket) AS upto,
                sum(count(*)) OVER (PARTITION BY {by}) AS n FROM buckets GROUP BY {by}, bucket)
        GROUP BY {by}))"""


QUALITY_SQL = f"""
WITH texts AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
            lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM documents),
starts AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS n
    FROM texts, unnest(range(1, len(w) - {WINDOW - 2})) AS r(i) WHERE len(w) > {WINDOW}),
covered AS (
    SELECT doc_id, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n_repeat_words
    FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM starts WHERE n > 1)
    GROUP BY doc_id),
counted AS (
    SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
        len(list_filter(list_zip(w[:-2], w[2:]), lambda x: x[1] = x[2]))::BIGINT AS n_same_words,
        (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals,
        (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_marks
    FROM texts LEFT JOIN covered USING (doc_id)),
measured AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        {", ".join(f"CASE WHEN {per} > 0 THEN (1000 * {c}) // {per} ELSE 0 END AS {m}"
                   for m, (c, per, _, _) in MEASURES.items())}
    FROM counted),
buckets AS (
    SELECT lang, source, measure, (v // (1::BIGINT << {_SHIFT})) * (1::BIGINT << {_SHIFT}) AS bucket
    FROM ({_MEASURE_ROWS})),
{_fences("lang, source", "own")},
{_fences("lang", "by_lang")},
{_fences("", "overall")},
chosen AS (
    SELECT own.lang, own.source, own.measure, coalesce(own.fence, by_lang.fence, overall.fence) AS fence
    FROM own LEFT JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang AND own.measure = by_lang.measure
    LEFT JOIN overall ON own.measure = overall.measure),
wide AS (
    SELECT lang, source, {", ".join(f"max(fence) FILTER (measure = '{m}') AS most_{m}" for m in MEASURES)}
    FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {" AND ".join(f"coalesce({m} <= most_{m}, true)" for m in MEASURES)} AS kept
FROM measured m LEFT JOIN wide f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""
