"""DuckDB SQL for the queries that SQL can express; each restates the contract on its own."""

from __future__ import annotations

OP1 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)
), starts AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM starts, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), m AS (
  SELECT s.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id
), bits AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM bits
"""


def _spans(kind: str, rank: int, pattern: str, good: str) -> str:
    p = pattern.replace("'", "''")
    return rf"""
  SELECT doc_id, p0 AS s, {rank} AS k, '{kind}' AS kind, p0 + length(piece) AS e
  FROM (
    SELECT doc_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS p0
    FROM (SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
          FROM (SELECT doc_id, string_split(regexp_replace(t, '{p}', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS pieces FROM base))
  ) WHERE i % 2 = 0 AND {good}"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
OP2 = (
    "WITH base AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents), found AS ("
    + " UNION ALL ".join(
        _spans(*x)
        for x in (
            ("assign", 0, _ASSIGN, "length(regexp_extract(piece, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 6"),
            ("access", 1, "AKIA[A-Z0-9]+", "length(piece) >= 20"),
            ("hex", 2, "[0-9a-f]+", "length(piece) >= 24"),
            ("github", 3, "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
            ("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
            ("pem", 5, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true"),
        )
    )
    + r"""
), joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '') AS b,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS a
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM base d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
)

OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[\\#<]')) AS codes, len(regexp_extract_all(coalesce(role, ''), '[\\#<:]')) AS role_codes
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + role_codes + length(text) + codes + 15)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_B32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_CHUNKS = " || ".join(f"substr({_B32}, ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_CHUNKS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT p.*, o.first FROM p JOIN o USING (h))
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM e JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), both_ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON reach.y = both_ways.a
), comp AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Unsigned CRC-32 of a decimal id: eight shifts a byte.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"""

OP12 = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT c, c - c % 20 AS base, {CRC.format("c")} % 4 AS h FROM t
), r AS (
  SELECT c.c, 0 AS part, p, role, text FROM c JOIN t ON t.c = c.base AND t.p <= c.h
  UNION ALL
  SELECT c.c, 1, p, role, text FROM c JOIN t ON t.c = c.c AND t.p > c.h
), whole AS (
  SELECT c.c, coalesce(list({{'role': role, 'text': text}} ORDER BY part, p) FILTER (r.c IS NOT NULL), []) AS turns FROM c LEFT JOIN r USING (c) GROUP BY c.c
), prefixes AS (
  SELECT c, d, turns[1:d] AS path, d = len(turns) AS last FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole)
), nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d]['text'], '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM prefixes GROUP BY d, path
), kids AS (
  SELECT a.d, a.path, count(b.path) AS k FROM nodes a LEFT JOIN nodes b ON b.d = a.d + 1 AND b.path[1:a.d] = a.path GROUP BY ALL
), counted AS (
  SELECT * FROM nodes JOIN kids USING (d, path)
)
SELECT a.conv_id, a.d::BIGINT AS depth, any_value(p.conv_id) AS parent_conv_id, a.n AS n_convs, a.k AS n_children,
       count(*) FILTER (b.k = 0) AS n_leaves, sum((b.n - 1) * b.words)::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM counted a JOIN counted b ON b.d >= a.d AND b.path[1:a.d] = a.path LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.path = a.path[1:a.d - 1]
GROUP BY a.d, a.path, a.conv_id, a.n, a.k, a.ends
"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"

OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_FIELD.format("source")} AS g, source, {_LEAF.format("text")} AS leaf,
         CASE WHEN {CRC.format("doc_id")} % 5 = 0 THEN {_LEAF.format("low")} END AS changed
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d
), tree AS (
  SELECT g, 0 AS level, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT g, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, level, i // 16, n
), sources AS (
  SELECT g, t.h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT g, source FROM d) JOIN tree t USING (g) WHERE t.n = 1
), top AS (
  SELECT 0 AS level, i, n, subroot AS h FROM sources
  UNION ALL
  SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 16, n
), beside AS (
  SELECT p.doc_id, t.level, t.i, t.h, sign(t.i - (p.i >> (4 * t.level))) AS side
  FROM placed p JOIN tree t ON t.g = p.g AND t.n > 1 AND t.i >> 4 = p.i >> (4 * t.level + 4)
  UNION ALL
  SELECT p.doc_id, 100 + t.level, t.i, t.h, sign(t.i - (s.i >> (4 * t.level)))
  FROM placed p JOIN sources s USING (g) JOIN top t ON t.n > 1 AND t.i >> 4 = s.i >> (4 * t.level + 4)
), steps AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY level) AS k,
         coalesce(string_agg(h, '' ORDER BY i) FILTER (side < 0), '') AS l, coalesce(string_agg(h, '' ORDER BY i) FILTER (side > 0), '') AS r
  FROM beside GROUP BY doc_id, level
), fold AS (
  SELECT doc_id, 0 AS k, coalesce(changed, leaf) AS h FROM d
  UNION ALL
  SELECT doc_id, f.k + 1, sha256(l || h || r) FROM fold f JOIN steps s USING (doc_id) WHERE s.k = f.k + 1
), proofs AS (
  SELECT doc_id, string_agg(l || r, '' ORDER BY k) AS said FROM steps GROUP BY doc_id
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(said, '')) AS proof_sha256, last AS folded_root, last = root AS verified
FROM placed JOIN sources USING (g) JOIN (SELECT doc_id, arg_max(h, k) AS last FROM fold GROUP BY doc_id) USING (doc_id)
  LEFT JOIN proofs USING (doc_id), (SELECT h AS root FROM top WHERE n = 1)
"""

ORACLES = {"op1_quality_rules": OP1, "op2_secret_scans": OP2, "op6_chat_format": OP6, "op7_warc": OP7, "op9_near_dedup": OP9, "op12_prefix_trie": OP12, "op13_merkle_manifest": OP13}
