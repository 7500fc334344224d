"""SQL for the queries of this subpackage that SQL can express over whole tables."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {}

SQL["op2_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

SQL["op6_substrings"] = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM i),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM x WHERE nth > 1),
k AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d)
      ANTI JOIN gone USING (doc_id, pos)),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

SQL["op8_minmax_dedup"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce({_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")}, []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT y, c FROM r JOIN l ON x = id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT id AS doc_id, min(c) AS component_id FROM r GROUP BY id) LEFT JOIN n USING (doc_id)"""

SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN nullif(max(page_id) OVER (PARTITION BY h), page_id) END AS refers_to FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

#: crc32 of a decimal, bit by bit: an item of -1 shifts, any other one is a byte to add.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295::BIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


SQL["op12_merkle"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
         {_leaf(f"n_chars + CASE WHEN {_CRC.format('doc_id')} % 7 = 0 THEN 1 ELSE 0 END")} AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT lang, 0 AS level, pos, n, leaf AS h FROM p
      UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
                FROM t WHERE n > 1 GROUP BY lang, level, pos // 2, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, subroot AS h FROM s
      UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
                FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
r AS (SELECT h AS root FROM u WHERE n = 1),
steps AS (
  SELECT p.lang, p.pos, 0 AS tier, k.level, o.h AS s, (p.pos >> k.level) % 2 = 1 AS l
  FROM p JOIN (SELECT DISTINCT lang, level FROM t WHERE n > 1) k ON p.lang IS NOT DISTINCT FROM k.lang
  LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM p.lang AND o.level = k.level AND o.pos = xor(p.pos >> k.level, 1)
  UNION ALL
  SELECT p.lang, p.pos, 1, k.level, o.h, (s.pos >> k.level) % 2 = 1
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT DISTINCT level FROM u WHERE n > 1) k
  LEFT JOIN u o ON o.level = k.level AND o.pos = xor(s.pos >> k.level, 1)),
w AS (SELECT lang, pos, list({{'s': s, 'l': l}} ORDER BY tier, level) AS path, string_agg(s, '' ORDER BY tier, level) AS proof FROM steps GROUP BY ALL),
f AS (
  SELECT p.doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend({{'s': tampered, 'l': false}}, coalesce(path, [])), lambda a, x: {{'s': sha256(CASE
           WHEN x.s IS NULL THEN a.s WHEN x.l THEN x.s || a.s ELSE a.s || x.s END), 'l': false}}).s AS folded_root
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r
  LEFT JOIN w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos)
SELECT *, folded_root = root AS verified FROM f"""

SQL["op13_periodic"] = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w, {_CRC.format('doc_id')} AS h FROM documents),
k AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
m AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM k),
x AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i:
        w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM m),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS six FROM (SELECT doc_id, w, unnest(range(len(w) - 5)) AS i FROM x)),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.six = b.six AND a.i < b.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(length := length, later := -start, longer := -period)) AS most,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS pos FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept
         FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM x) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -most.later AS start, most.length AS length, -most.longer AS period,
       1000 * most.length // -most.longer AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)"""
