"""SQL counterparts of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

#: a table `crc(t)`: what a byte does to a checksum
_CRC_TABLE = """crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0 FOR k IN range(8)]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) bytes(i)))"""


def _crc32(codes: str) -> str:
    """Unsigned crc32 of a list of bytes, beside `crc`."""
    start = f"list_concat([4294967295::BIGINT], {codes})"
    return f"xor(list_reduce({start}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _list_of_bytes(text: str) -> str:
    """UTF-8 bytes of a text of code points below 2048."""
    code = f"unicode(substr({text}, i, 1))::BIGINT"
    return f"flatten([CASE WHEN {code} < 128 THEN [{code}] ELSE [192 | ({code} >> 6), 128 | ({code} & 63)] END FOR i IN range(1, length({text}) + 1)])"


VECTORS = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id, vec_id AS top FROM good UNION SELECT l.b, r.top FROM reach r JOIN links l ON l.a = r.vec_id WHERE r.top < l.b),
tops AS (SELECT vec_id, min(top) AS top FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(t.top, e.vec_id) AS component_id, e.vec_id = coalesce(t.top, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c USING (vec_id) LEFT JOIN tops t USING (vec_id)
"""

ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
firsts AS (SELECT payload, min(page_id) AS page_id FROM p GROUP BY 1),
digests AS (
  SELECT p.page_id, strlen(p.payload) AS payload_bytes, sha1(p.payload) AS h, f.page_id AS head FROM p JOIN firsts f ON f.payload = p.payload)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INTEGER, 1)
                        FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM digests
"""


def secret_spans(head: str, kinds: list[tuple[str, str, str, str]]) -> str:
    """`kinds` are (kind, pattern, value, condition); `m` is a match and `v` its value in the last two."""
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    parts = "\nUNION ALL BY NAME\n".join(
        f"""SELECT r, doc_id, source, lang, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(x, {quoted(pattern)}) AS found, regexp_split_to_array(x, {quoted(pattern)}) AS gaps
  FROM d WHERE regexp_matches(x, {quoted(pattern)})"""
        for rank, (kind, pattern, _, _) in enumerate(kinds)
    )
    value = "CASE kind " + " ".join(f"WHEN '{kind}' THEN {v}" for kind, _, v, _ in kinds) + " END"
    holds = "CASE kind " + " ".join(f"WHEN '{kind}' THEN {c}" for kind, _, _, c in kinds) + " END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS x FROM documents),
hits AS ({parts}),
each AS (SELECT r, source, lang, rank, kind, unnest(found) AS m, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM hits),
placed AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS stop, {value.replace('HEAD', quoted('^' + head))} AS v FROM each),
spans AS (SELECT r, source, lang, rank, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop, v FROM placed WHERE {holds}),
known AS (
  SELECT v, count(DISTINCT source) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repositories FROM spans GROUP BY 1),
chosen AS (
  SELECT s.*, k.owners <= 1 AND k.repositories <= 2 AS live FROM spans s JOIN known k ON k.v = s.v
  WHERE s.rank < 3 OR (k.owners <= 1 AND k.repositories <= 2
    AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = s.r AND b.rank < 3 AND b.start < s.stop AND s.start < b.stop))),
texts AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM chosen GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (r)
"""


REPEATS = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
chunks AS (SELECT doc_id, unnest(range(0, n, 256)) AS base, h, n FROM d),
cut AS (SELECT doc_id, base, n, substr(h, 2 * base + 1, 2 * (256 + 49)) AS part FROM chunks),
windows AS (SELECT doc_id, base + k AS pos, md5_number(substr(part, 2 * k + 1, 100)) AS w
  FROM (SELECT doc_id, base, n, part, unnest(range(0, least(256, n - 49 - base))) AS k FROM cut)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, pos FROM windows JOIN firsts USING (w) WHERE doc_id > first),
steps AS (SELECT doc_id, pos, coalesce(pos > 50 + lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), true)::INTEGER AS fresh FROM hits),
runs AS (SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM steps),
spans AS (SELECT doc_id, run, min(pos) AS low, max(pos) + 50 AS high FROM runs GROUP BY 1, 2),
gaps AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM spans),
kept AS (
  SELECT g.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS h,
         sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS MATERIALIZED (
  SELECT doc_id, x, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
    FROM documents) GROUP BY 1, 2),
hashed AS (SELECT x, times, {_crc32(_list_of_bytes("(doc_id || ':' || x)"))} AS h FROM runs, crc),
words AS MATERIALIZED (
  SELECT CASE WHEN h % 31 = 0 THEN substr(x, 1, (h % length(x))::INTEGER) || substr(x, (h % length(x))::INTEGER + 2) ELSE x END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1),
known AS MATERIALIZED (SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2),
keys AS (
  SELECT word, n, 0 AS i, word AS k FROM known
  UNION ALL SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM known)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM keys a JOIN keys b ON a.k = b.k AND a.word <> b.word
  WHERE (a.i = b.i AND length(a.word) = length(b.word)) OR (a.i = 0 AND length(b.word) = length(a.word) + 1) OR (b.i = 0 AND length(a.word) = length(b.word) + 1)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY 1),
formed AS MATERIALIZED (
  SELECT k.word, k.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * k.n THEN b.other END AS form, CASE WHEN b.m >= 10 * k.n THEN b.m END AS form_n
  FROM known k LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""

TRIE = f"""
WITH {_CRC_TABLE},
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations),
ids AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1),
cuts AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, {_crc32(_list_of_bytes("conv_id::VARCHAR"))} % 9 AS h FROM ids, crc),
sizes AS (SELECT c.*, least(h, coalesce(i.turns, 0)) AS lead FROM cuts c LEFT JOIN ids i ON i.conv_id = c.donor),
rebuilt AS (
  SELECT s.conv_id, o.n AS depth, o.role, o.text FROM sizes s JOIN own o ON o.conv_id = s.donor AND o.n <= s.h
  UNION ALL SELECT s.conv_id, s.lead + o.n - s.h, o.role, o.text FROM sizes s JOIN own o ON o.conv_id = s.conv_id AND o.n > s.h),
paths AS MATERIALIZED (
  SELECT conv_id, depth, strlen(text) AS bytes,
         md5(array_to_string(list(sha256(role) || sha256(text)) OVER (PARTITION BY conv_id ORDER BY depth), '')) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
up AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM paths),
nodes AS MATERIALIZED (
  SELECT node, any_value(depth)::BIGINT AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM up GROUP BY 1),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
below AS (SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT top AS node, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.bytes)::BIGINT AS saved
  FROM below JOIN nodes x ON x.node = below.node LEFT JOIN children c ON c.node = below.node GROUP BY 1)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums s ON s.node = x.node LEFT JOIN children c ON c.node = x.node LEFT JOIN nodes p ON p.node = x.parent
"""
