"""DuckDB's SQL for the manifest query."""

#: Levels that the SQL unrolls: up to 8 ** 8 documents of a language, 8 ** 3 languages.
_LEAF_LEVELS, _ROOT_LEVELS = 8, 3

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(str_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))))"""


def _part(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(kind: str, group: str, n: int) -> str:
    """Nodes of each level; a group that has come down to one node keeps it."""
    out = []
    for k in range(n):
        out.append(f"""{kind}{k + 1} AS MATERIALIZED (
    SELECT {group}, pos // 8 AS pos, CASE WHEN max(total) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h,
        (max(total) + 7) // 8 AS total
    FROM {kind}{k} GROUP BY {group}, pos // 8)""")
    return ",\n".join(out)


def _climb(kind: str, group: str, n: int, of: str, rows: str) -> str:
    """Siblings and folded hash of each row of ``rows`` (group, pos, folded, proof), level by level."""
    out, before = [], rows
    for k in range(n):
        out.append(f"""{of}{k} AS MATERIALIZED (
    SELECT r.* REPLACE (r.pos // 8 AS pos,
        CASE WHEN s.total > 1 THEN sha256(coalesce(s.l, '') || r.folded || coalesce(s.r, '')) ELSE r.folded END AS folded,
        r.proof || CASE WHEN s.total > 1 THEN coalesce(s.l, '') || coalesce(s.r, '') ELSE '' END AS proof)
    FROM {before} r JOIN (
        SELECT n.{group}, n.pos, max(n.total) AS total, string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < n.pos) AS l,
            string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > n.pos) AS r
        FROM {kind}{k} n JOIN {kind}{k} o ON n.{group} IS NOT DISTINCT FROM o.{group} AND n.pos // 8 = o.pos // 8
        GROUP BY n.{group}, n.pos) s
    ON r.{group} IS NOT DISTINCT FROM s.{group} AND r.pos = s.pos)""")
        before = f"{of}{k}"
    return ",\n".join(out)


MERKLE_SQL = f"""
WITH hashed AS MATERIALIZED (
    SELECT doc_id, lang, {_leaf('text')} AS h,
        CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf(f"translate(text, '{_A_TO_Z}', '{_A_TO_Z.lower()}')")} END AS altered
    FROM documents),
doc0 AS MATERIALIZED (
    SELECT doc_id, lang, h, altered, count(*) OVER (PARTITION BY lang) AS total,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM hashed),
{_levels('doc', 'lang', _LEAF_LEVELS)},
lang0 AS MATERIALIZED (
    SELECT lang, h, 0 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total
    FROM doc{_LEAF_LEVELS}),
{_levels('lang', 'one', _ROOT_LEVELS)},
leaves AS (SELECT doc_id, lang, pos, h AS leaf, coalesce(altered, h) AS folded, '' AS proof FROM doc0),
{_climb('doc', 'lang', _LEAF_LEVELS, 'up', 'leaves')},
tops AS (
    SELECT u.doc_id, u.leaf, l.h AS subroot, l.one, l.pos, u.folded, u.proof
    FROM up{_LEAF_LEVELS - 1} u JOIN lang0 l ON u.lang IS NOT DISTINCT FROM l.lang),
{_climb('lang', 'one', _ROOT_LEVELS, 'over', 'tops')}
SELECT doc_id, leaf, subroot, (SELECT h FROM lang{_ROOT_LEVELS}) AS root, sha256(proof) AS proof_sha256,
    folded AS folded_root, folded = (SELECT h FROM lang{_ROOT_LEVELS}) AS verified
FROM over{_ROOT_LEVELS - 1}
"""
