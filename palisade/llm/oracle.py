"""Reference SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from palisade.llm.mixing import HASH_DIGITS

_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def mixing_sql(docs: str, columns: str) -> str:
    """``columns`` over ``copied``: the rows of ``docs`` with their ``copies``."""
    return f"""
WITH sized AS (SELECT *, {_SIZE}::BIGINT AS size FROM {docs}),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::BIGINT AS cap,
    ([5.0, 2.0, 1.0]::DOUBLE[])[
      ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (
      ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per_source),
targets AS (
  SELECT source, source_size, CASE WHEN cap >= level * weight
    THEN (max(CASE WHEN cap >= level * weight THEN level END) OVER ()) * weight
    ELSE cap END AS target
  FROM levels),
rates AS (
  SELECT s.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0.0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, {HASH_DIGITS}))::BIGINT::DOUBLE
      / {16**HASH_DIGITS}::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM rates)
SELECT {columns} FROM copied"""


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

RANKED_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
total AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs WHERE len(ts) > 0),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counted AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weighed AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counted CROSS JOIN total GROUP BY term, n_docs),
impacts AS (
  SELECT r, term, w * ((1000000000 * tf)
    // (1000 * tf + 20 * (100 - 50 + ((50 * len(ts)::BIGINT * n_docs) // n_terms)))) AS impact
  FROM counted JOIN docs USING (r) JOIN weighed USING (term) CROSS JOIN total),
scored AS (
  SELECT item_id, r, sum(impact)::BIGINT AS score
  FROM wanted JOIN impacts USING (term) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


TRIE_SQL = """
WITH given AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(
      string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(
      [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, nothing: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h
  FROM given),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(f.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN given f ON f.conv_id = c.conv_id - ((c.conv_id % 5) + 5) % 5),
members AS (
  SELECT conv_id, depth, turns[1:depth] AS path, len(turns) AS n
  FROM rebuilt, unnest(range(len(turns) + 1)) AS depths(depth)),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends,
    (count(*) - 1) * coalesce(strlen(path[-1].text), 0) AS saved
  FROM members GROUP BY depth, path),
children AS (
  SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*)::BIGINT AS n
  FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, path)),
subtrees AS (
  SELECT path[1:above] AS path, above AS depth, sum((n_children = 0)::INT)::BIGINT AS n_leaves,
    sum(saved)::BIGINT AS saved_tokens
  FROM counted, unnest(range(depth + 1)) AS parts(above) GROUP BY ALL)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
  s.n_leaves, s.saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN subtrees s USING (depth, path)
LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]"""


ORACLE_SQL = {
    "op11_ranked_search": RANKED_SQL,
    "op13_conversation_trie": TRIE_SQL,
    "op4_source_mixing": mixing_sql(
        "documents",
        "doc_id, size, source_size, target, (size * copies)::BIGINT AS taken",
    ),
}
