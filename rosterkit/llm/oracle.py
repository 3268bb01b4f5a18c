"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

from __future__ import annotations

# n-gram Jaccard join: distinct 3-word shingles, links of at least 90 percent, least id of a component.
OP7_JACCARD = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
           THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, list_sort(list(s)) AS key FROM shingles GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS rep FROM sets),
own AS (SELECT sh.doc_id, s FROM shingles sh JOIN class c ON c.doc_id = sh.doc_id AND c.rep = c.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(start, node) AS (
  SELECT DISTINCT a, a FROM edges
  UNION
  SELECT r.start, e.b FROM reach r JOIN edges e ON e.a = r.node
),
roots AS (SELECT start AS rep, min(node) AS root FROM reach GROUP BY start)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(r.root, c.rep, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN class c USING (doc_id) LEFT JOIN roots r ON r.rep = c.rep
"""

# Line dedup: long keys in five documents or more stay in the largest doc_id only.
OP11_LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)
),
k AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5
),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.last AS gone FROM l LEFT JOIN k ON k.key = l.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

def _crc(text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
            f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
            f"lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295::BIGINT)")


# Conversation prefix trie: prefixes by the hashes of their turns, subtrees by joining every node with its ancestors.
OP12_TRIE = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
),
convs AS (SELECT c, c - c % 5 AS s, {_crc("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (
  SELECT v.c, 0 AS part, t.pos, t.role, t.text FROM convs v JOIN own t ON t.c = v.s WHERE t.pos <= v.h
  UNION ALL
  SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN own t ON t.c = v.c WHERE t.pos > v.h
),
seq AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, md5(md5(role) || md5(text)) AS m, strlen(text) AS nb FROM rebuilt),
path AS (
  SELECT c, d, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS p, nb FROM seq
  UNION ALL
  SELECT c, 0, '', 0 FROM convs
),
ends AS (
  SELECT p, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e
  FROM (SELECT *, max(d) OVER (PARTITION BY c) AS n FROM path) WHERE d = n GROUP BY p
),
node AS (SELECT p, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, any_value(nb) AS nb FROM path GROUP BY p),
kids AS (SELECT left(p, length(p) - 32) AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
below AS (
  SELECT left(x.p, 32 * k) AS p, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.nb) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM node) x LEFT JOIN kids ON kids.p = x.p GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, below.n_leaves,
       below.saved::BIGINT AS saved_tokens, coalesce(ends.e, sha256('')) AS ends_sha256
FROM node n LEFT JOIN node up ON n.d > 0 AND up.p = left(n.p, length(n.p) - 32)
LEFT JOIN kids ON kids.p = n.p LEFT JOIN below ON below.p = n.p LEFT JOIN ends ON ends.p = n.p
"""

# Structure repair: least (cost, audit) per state and row, row by row.
OP13_REPAIR = f"""
WITH RECURSIVE harmed AS (
  SELECT *, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations)
),
rows_ AS (
  SELECT conv_id AS c, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos
  FROM (SELECT *, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM harmed WHERE harm <> 0)
),
faulty AS (
  SELECT *, left(role, 1) AS x, CASE
      WHEN t = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM rows_)
),
moves(f, sym, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(f, ins, t) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3),
                              (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)),
edits AS (
  SELECT i.f, i.ins || e.edit AS edits, e.edit, e.sym, e.t, 5 * length(i.ins) + e.price AS price
  FROM inserts i JOIN (
    SELECT s.f, 'D' AS edit, '' AS sym, s.f AS t, 2 AS price FROM (SELECT DISTINCT f FROM inserts) s
    UNION ALL SELECT f, 'K', sym, t, 0 FROM moves
    UNION ALL SELECT f, 'R', sym, t, 1 FROM moves WHERE sym <> 's'
  ) e ON e.f = i.t
),
dp AS (
  SELECT c, 0::BIGINT AS pos, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM (SELECT DISTINCT c FROM faulty)
  UNION ALL
  SELECT dp.c, r.pos, e.t, min({{'cost': dp.best.cost + e.price + CASE WHEN r.fault = 'truncated' AND e.edit <> 'D' THEN 5 ELSE 0 END,
                                 'audit': dp.best.audit || e.edits}})
  FROM dp JOIN faulty r ON r.c IS NOT DISTINCT FROM dp.c AND r.pos = dp.pos + 1
  JOIN edits e ON e.f = dp.state AND (e.edit <> 'K' OR e.sym = r.x) AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY dp.c, r.pos, e.t
),
total AS (SELECT c, count(*) AS n FROM faulty GROUP BY c),
final AS (
  SELECT dp.c, min({{'cost': dp.best.cost + 5 * length(i.ins), 'audit': dp.best.audit || i.ins}}) AS best
  FROM dp JOIN total ON total.c IS NOT DISTINCT FROM dp.c AND total.n = dp.pos JOIN inserts i ON i.f = dp.state AND i.t IN (0, 3) GROUP BY dp.c
),
letters AS (SELECT c, i, best.audit[i] AS e FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS i FROM final)),
placed AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY c ORDER BY i) AS pos FROM letters),
kept AS (
  SELECT p.c, p.i, p.e, r.role, CASE WHEN p.e = 'I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY p.c ORDER BY p.i) AS o
  FROM placed p LEFT JOIN faulty r ON r.c IS NOT DISTINCT FROM p.c AND r.pos = p.pos WHERE p.e <> 'D'
),
shifted AS (SELECT *, max(CASE WHEN o = 1 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS s FROM kept),
repaired AS (
  SELECT c, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS h
  FROM shifted GROUP BY c
),
stats AS (
  SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(x) OVER (PARTITION BY c ORDER BY pos) AS before FROM faulty) GROUP BY c
)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(final.best.cost, 0) AS cost, coalesce(final.best.audit, '') AS audit,
       coalesce(repaired.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN stats ON stats.c IS NOT DISTINCT FROM v.conv_id
LEFT JOIN final ON final.c IS NOT DISTINCT FROM v.conv_id LEFT JOIN repaired ON repaired.c IS NOT DISTINCT FROM v.conv_id
"""

ORACLE = {"op7_jaccard": OP7_JACCARD, "op11_lines": OP11_LINES, "op12_trie": OP12_TRIE, "op13_repair": OP13_REPAIR}
