"""SQL equivalents of the training-data queries that SQL can express, for DuckDB; each is a plain way to the same rows, for small tables."""

from __future__ import annotations

#: All pairs of documents, compared outright.
NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, b.b FROM r JOIN both_ways b ON b.a = r.seen),
least_seen AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN least_seen ON node = d.doc_id"""

#: Every document scored for every item.
LEXICAL = r"""WITH terms AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS ts FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_number() OVER () AS d, doc_id, ts, len(ts) AS n FROM terms WHERE len(ts) > 0),
whole AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
weight AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, nn),
scored AS (SELECT item_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN docs USING (d), whole GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored JOIN docs USING (d) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""


def _least(*costs: str) -> str:
    return f"least({', '.join(costs)})"


def _plus(path: str, cost: str, letter: str) -> str:
    """A path, cost in twelve digits and then the audit, after one more edit; null stays null."""
    return f"(lpad((left({path}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({path}, 13) || '{letter}')"


def _conversations() -> str:
    """The cheapest path through the four states of (s?(ua)+)?, one turn of each conversation at a time."""
    crc_step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = f"list_transform(range(0, 256), lambda b: list_reduce(list_concat([b], list_transform(range(0, 8), lambda z: 0::BIGINT)), lambda c, k: {crc_step}))"
    ins = lambda path: _plus(path, "5", "I")
    # q: nothing kept, s: a system turn, u: a user turn last, a: an assistant turn last
    u1 = _least("u", ins("q"), ins("s"), ins("a"))
    a1 = _least("a", ins("u1"))
    drop = lambda path: _plus(path, "2", "D")
    stay = lambda path, kind: f"CASE WHEN NOT goes AND initial = '{kind}' THEN {_plus(path, 'more', 'K')} END"
    turn = lambda path: f"CASE WHEN NOT goes THEN {_plus(path, '1 + more', 'R')} END"
    to_u = [x for p in ("q", "s", "a1") for x in (stay(p, "u"), turn(p))]
    return rf"""WITH RECURSIVE crc_table AS MATERIALIZED (SELECT {table} AS t),
numbered AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bytes AS (SELECT id, list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::INTEGER, 1))::BIGINT)) AS bs FROM numbered),
crc AS MATERIALIZED (SELECT id, xor(list_reduce(bs, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM bytes, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM numbered JOIN crc USING (id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || ':' || text), copy) AS i FROM damaged),
flagged AS (SELECT conv_id, i, turn, role, text, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS was, regexp_full_match(text, '[\x20\x09-\x0D]*') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open_end FROM ordered),
faults AS MATERIALIZED (SELECT *, blank OR again AS goes, CASE WHEN NOT blank AND NOT again AND open_end THEN 5 ELSE 0 END AS more FROM flagged),
paths AS (SELECT conv_id, 0::BIGINT AS i, '000000000000' AS q, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, next_i, {drop("q")}, {_least(drop("s"), stay("q", "s"))}, {_least(drop("u"), *to_u)}, {_least(drop("a"), stay("u1", "a"), turn("u1"))}
  FROM (SELECT p.*, f.i AS next_i, f.initial, f.goes, f.more, {u1} AS u1 FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1) AS z, LATERAL (SELECT {a1} AS a1) AS y),
ends AS (SELECT conv_id, {_least("q", "a", ins("u"), ins(_plus("s", "5", "I")))} AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM paths) WHERE last = 1),
edits AS MATERIALIZED (SELECT conv_id, left(best, 12)::BIGINT AS cost, substr(best, 13) AS audit FROM ends),
letters AS (SELECT conv_id, j, substr(audit, j::INTEGER, 1) AS letter, (length(audit) - length(replace(audit, 'D', ''))) AS gone, length(audit) AS len FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM edits)),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w - 1 - (len - gone) % 2 AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lines AS (SELECT p.conv_id, string_agg(CASE letter WHEN 'K' THEN role WHEN 'I' THEN CASE WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END ELSE CASE WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND letter <> 'I' WHERE letter <> 'D' GROUP BY p.conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (more = 5) AS truncated,
  count(*) FILTER (was || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM edits e LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


CONVERSATIONS = _conversations()


def oracle_sql() -> dict[str, str]:
    return {"op8_near_dedup": NEAR_DUPLICATES, "op11_lexical": LEXICAL, "op13_conversations": CONVERSATIONS}
