"""DuckDB counterparts of the queries that SQL can state."""

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def _plain(column: str) -> str:
    narrow = f"translate({column}, '{_WIDE}', '{_ASCII}')"
    return f"lower(regexp_replace(regexp_replace({narrow}, '\\p{{Cf}}+', '', 'g'), '^\\s+|\\s+$', '', 'g'))"


def _handle(text: str) -> str:
    bare = rf"regexp_replace(regexp_replace({text}, '\s*\([^)]*\)$', ''), '^(?:/?u/|/?user/|@)\s*', '')"
    return f"nullif(nullif({bare}, ''), '[deleted]')"


SOURCE = f"regexp_extract({_plain('source')}, '^([^@\\s]*)', 1)"
_IN_SOURCE = f"regexp_extract({_plain('source')}, '@(.+)$', 1)"
ACCOUNT = f"coalesce({_handle(_plain('author'))}, {_handle(_IN_SOURCE)})"

P2_FOUND = f"""
WITH named AS (SELECT id, {SOURCE} AS src, {ACCOUNT} AS account, external_id, fetched_at, quality_score FROM posts),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, coalesce(external_id, '#' || id) ORDER BY fetched_at DESC NULLS LAST, id DESC) AS nth FROM named) WHERE nth = 1
),
ranked AS (
  SELECT id, src, row_number() OVER (PARTITION BY src, account ORDER BY quality_score DESC NULLS LAST, id) AS place FROM latest WHERE account IS NOT NULL
)
SELECT r.id FROM ranked r JOIN contributor_caps c ON c.source = r.src WHERE r.place > c.max_posts
"""

P5_FOUND = f"""
WITH named AS (SELECT id, {ACCOUNT} AS account FROM posts),
firsts AS (SELECT account, min(id) AS first_id FROM named WHERE account IS NOT NULL GROUP BY account)
SELECT f.first_id, n.id FROM named n JOIN firsts f ON f.account = n.account WHERE n.id > f.first_id
"""
