"""The dated list of the URL query, derived from the pages, and DuckDB's SQL for the query."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeway.llm.url_filter import host, is_address, page

#: Days of 2024 on which hosts, domains and pages are added (+) and removed (-), by a number x of the name.
#: kind -> (every how many names are listed, [(sign, constant day, modulus of x)])
LISTED = {
    "host": (2, [(1, 10, 150), (-1, 40, 200), (1, 200, 120)]),
    "domain": (1, [(1, 60, 120), (-1, 110, 150)]),
    "page": (8, [(1, 0, 300)]),
}


def _number(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name.cast("string").cast("binary")), 1, 4), 16, 10).cast("int")


def fetched(key: Column) -> Column:
    """Time of a fetch: a second of 2024 from the page's id."""
    return F.timestamp_seconds(F.lit(1704067200) + (_number(key) % 365) * 86400 + F.pmod(key, F.lit(86400)))


def changes(pages: DataFrame) -> DataFrame:
    """Dated changes pattern, at, added of a list whose names are those of the pages."""
    url = F.col("url")
    domain = F.when(is_address(host(url)), host(url)).otherwise(F.substring_index(host(url), ".", -2))
    names = {"host": host(url), "domain": domain, "page": page(url)}
    out = None
    for kind, (every, days) in LISTED.items():
        listed = pages.select(names[kind].alias("pattern")).where("pattern IS NOT NULL").distinct().withColumn(
            "x", _number(F.col("pattern"))).where(F.col("x") % every == 0)
        at = F.explode(F.array(*[F.struct(
            F.timestamp_seconds(F.lit(1704067200) + (F.lit(day) + F.col("x") % modulus) * 86400).alias("at"),
            F.lit(sign > 0).alias("added")) for sign, day, modulus in days]))
        part = listed.select("pattern", at.alias("_c")).select("pattern", "_c.at", "_c.added")
        out = part if out is None else out.unionByName(part)
    return out


def _x(name: str) -> str:
    return f"('0x' || substr(md5({name}::VARCHAR), 1, 4))::INTEGER"


def _time(seconds: str) -> str:
    return f"make_timestamp(({seconds})::BIGINT * 1000000)"


_CHANGES = " UNION ALL ".join(
    f"SELECT pattern, {_time(f'1704067200 + ({day} + x % {modulus}) * 86400')} AS day_at, {str(sign > 0).lower()} AS added "
    f"FROM (SELECT DISTINCT {kind} AS pattern, {_x(kind)} AS x FROM named WHERE {kind} IS NOT NULL) WHERE x % {every} = 0"
    for kind, (every, days) in LISTED.items() for sign, day, modulus in days)

_ADDRESS = r"coalesce(regexp_matches(host, '^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$'), false)"

URL_SQL = f"""
WITH hosted AS (
    SELECT page_id, url, nullif(regexp_replace(regexp_extract(lower(url),
        '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/:?#]+)', 1), '\\.$', ''), '') AS host FROM pages),
named AS (
    SELECT page_id, host, string_split(host, '.') AS labels, {_ADDRESS} AS address,
        CASE WHEN {_ADDRESS} THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
        host || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS page,
        {_time(f"1704067200 + ({_x('page_id')} % 365) * 86400 + page_id % 86400")} AS fetched_at
    FROM hosted),
known AS (SELECT pattern, day_at, max(added) AS added FROM ({_CHANGES}) GROUP BY pattern, day_at),
turns AS (
    SELECT pattern, day_at, added FROM (
        SELECT *, lag(added) OVER (PARTITION BY pattern ORDER BY day_at) AS was FROM known)
    WHERE added <> coalesce(was, false)),
spans AS (
    SELECT pattern, day_at AS since, until FROM (
        SELECT *, lead(day_at) OVER (PARTITION BY pattern ORDER BY day_at) AS until FROM turns) WHERE added),
asked AS (
    SELECT DISTINCT page_id, fetched_at, pattern FROM (
        SELECT page_id, fetched_at, page AS pattern FROM named
        UNION ALL SELECT page_id, fetched_at, array_to_string(labels[i:], '.') FROM named, range(1, 20) AS r(i)
        WHERE i <= CASE WHEN address THEN 1 ELSE greatest(len(labels) - 1, 1) END)),
hits AS (
    SELECT page_id, count(*) AS n_entries, arg_max(pattern, length(pattern)) AS entry,
        arg_max(since, length(pattern)) AS since
    FROM asked JOIN spans USING (pattern)
    WHERE fetched_at >= since AND (until IS NULL OR fetched_at < until) GROUP BY page_id)
SELECT page_id, host, fetched_at, n_entries IS NOT NULL AS blocked, coalesce(n_entries, 0)::BIGINT AS n_entries,
    entry, since AS listed_at
FROM named LEFT JOIN hits USING (page_id)
"""
