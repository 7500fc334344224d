"""ANSI SQL for the registered queries, used to check results against another engine.

RE2 has neither look-ahead nor back-references, and its ``\\s`` is ASCII only; the
patterns below agree with the Java ones on the given tables. Queries without an
entry here have no SQL form: they learn merges, follow a hash order, or parse code.
"""

from glyphloom.functions import patterns as p

SPLIT = r"'\n+|\t+|[ ]|[^\p{L}\p{N}\s _]+|[\p{L}\p{N}_\r\f\v]+'"
LLAMA = (r"'(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}"
         r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+'")
META = f"'{p.METASPACE}?[^{p.METASPACE}]+|{p.METASPACE}'"
WORD = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'"

_META_TEXT = f"regexp_extract_all(replace(text, ' ', '{p.METASPACE}'), {META})"


def _then(pieces: str, pattern: str) -> str:
    return f"flatten([regexp_extract_all(x, {pattern}) for x in {pieces}])"


PIECES = {
    "split": f"regexp_extract_all(text, {SPLIT})",
    "llama": f"regexp_extract_all(text, {LLAMA})",
    "metaspace": _META_TEXT,
    "metaspace_split": _then(_META_TEXT, SPLIT),
    "metaspace_whitespace": _then(_META_TEXT, WORD),
    "whitespace": f"regexp_extract_all(text, {WORD})",
}
PLAIN = ("split", "llama", "metaspace")
BASE = "CASE config WHEN 'llama' THEN 'split' WHEN 'metaspace' THEN 'split' END"


def _arrays(names, source="documents") -> str:
    """CTE body: (label, doc_id, config, text, pieces)."""
    return " UNION ALL ".join(
        f"SELECT lang AS label, doc_id, '{n}' AS config, text, {PIECES[n]} AS pieces FROM {source}"
        for n in names)


def _counts(name: str, where: str = "") -> str:
    return (f"SELECT lang AS label, piece, count(*) AS n FROM (SELECT lang, unnest({PIECES[name]}) AS piece "
            f"FROM documents {where}) GROUP BY ALL")


SQL: dict[str, str] = {}

# --- scans, sources, sinks ---------------------------------------------------
SQL["corpus_scan"] = "SELECT lang AS label, doc_id, text FROM documents"
_ALL = ("SELECT 'documents' AS label, doc_id, text FROM documents UNION ALL "
        "SELECT 'benchmark', item_id, text FROM benchmark UNION ALL "
        "SELECT 'pages', page_id, html FROM pages UNION ALL "
        "SELECT 'conversations', conv_id * 1048576 + turn, text FROM conversations")
SQL["corpus_union"] = f"""
SELECT label, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars,
       min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({_ALL}) GROUP BY label"""
SQL["corpus_text_sink"] = r"""
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents
WHERE regexp_matches(text, '\S')) GROUP BY line"""

_METRICS = f"""
a AS ({_arrays(PLAIN)}),
c AS (SELECT label, config, piece, count(*) FILTER (doc_id % 10 <> 9) AS n_train,
             count(*) FILTER (doc_id % 10 = 9) AS n_valid
      FROM (SELECT label, config, doc_id, unnest(pieces) AS piece FROM a) GROUP BY ALL),
m AS (SELECT label, config, count(*) FILTER (n_train > 0) + 5 AS vocab_size,
             CAST(sum(length(piece) * n_valid) AS BIGINT) AS chars,
             CAST(sum(n_valid) AS BIGINT) AS tokens FROM c GROUP BY ALL),
b AS (SELECT m.*, {BASE} AS baseline FROM m),
j AS (SELECT b.*, o.vocab_size AS base_vocab_size, o.chars AS base_chars, o.tokens AS base_tokens
      FROM b LEFT JOIN m o ON o.label = b.label AND o.config = b.baseline)"""
SQL["metrics_json_sink"] = f"""WITH {_METRICS}
SELECT label, config, vocab_size, chars, tokens,
       round(CASE WHEN tokens > 0 THEN chars / tokens ELSE 0 END, 6) AS chars_per_token FROM m"""

_RUNS = f"""
a AS ({_arrays(PLAIN)}),
r AS (SELECT label AS dataset, config, doc_id % 5 AS seed,
             CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(len(pieces) + 1) AS BIGINT) AS tokens
      FROM a GROUP BY ALL),
q AS (SELECT *, CAST(chars AS DOUBLE) / tokens AS ratio FROM r)"""
SQL["run_results_scan"] = f"""WITH {_RUNS}
SELECT dataset || '_' || config AS run, seed, '25M' AS model_size, dataset, config AS tokenizer_type,
       round(ratio, 6) AS char_to_token_ratio, tokens AS train_tokens_count, chars AS train_chars_count FROM q"""

_FOLD = ("array_to_string([c[i] for i in range(1, len(c) + 1) if c[i] IS DISTINCT FROM c[i - 1] "
         "OR (c[i - 2] IS DISTINCT FROM c[i] AND c[i + 1] IS DISTINCT FROM c[i])], '')")


def _keyed(source: str, columns: str) -> str:
    """Add ``concept`` to (columns, token)."""
    clean = (r"regexp_replace(strip_accents(lower(regexp_replace(token, '[\x{E000}-\x{F0FF}]', '', 'g'))), "
             r"'[^\p{L}\p{N}]', '', 'g')")
    return (f"SELECT {columns}, token, CASE WHEN k = '' THEN '' ELSE {_FOLD} END AS concept FROM "
            f"(SELECT {columns}, token, {clean} AS k, string_split({clean}, '') AS c FROM {source})")


_SPECIAL = "('[UNK]'), ('[PAD]'), ('[CLS]'), ('[SEP]'), ('[MASK]')"
_DENSITY = f"""
v AS (SELECT label, config, piece AS token FROM c WHERE n_train > 0),
k AS ({_keyed('v', 'label, config')}),
d AS (SELECT label, config, count(DISTINCT CASE WHEN concept <> '' THEN concept END) AS concepts,
             count(*) + 5 AS vocab_size FROM k GROUP BY ALL)"""
SQL["concept_density"] = f"""WITH {_METRICS}, {_DENSITY}
SELECT label, config, concepts, vocab_size, CAST(0 AS BIGINT) AS opcode_tokens,
       round(concepts * 100.0 / vocab_size, 6) AS density FROM d"""
_DIFF = ("CASE WHEN base_vocab_size < {t} AND vocab_size < {t} "
         "THEN (vocab_size - base_vocab_size) / base_vocab_size * 100 END")
_INFL = "CASE WHEN base_tokens > 0 THEN (tokens - base_tokens) / base_tokens * 100 END"
SQL["vocab_report"] = f"""WITH {_METRICS}, {_DENSITY},
x AS (SELECT j.label, j.config, j.vocab_size, d.concepts, d.concepts * 100.0 / d.entries AS density,
             CASE WHEN tokens > 0 THEN chars / tokens ELSE 0 END AS cpt, {_INFL} AS infl,
             {_DIFF.format(t=128000)} AS vdiff
      FROM j JOIN (SELECT label, config, concepts, vocab_size AS entries FROM d) d USING (label, config))
SELECT label, CAST(CASE config WHEN 'split' THEN 3 WHEN 'llama' THEN 6 WHEN 'metaspace' THEN 10 END AS BIGINT) AS ord,
       '| **' || CASE config WHEN 'split' THEN 'Split Only' WHEN 'llama' THEN 'Llama Split Only'
                             ELSE 'Metaspace Only' END || '** | ' || vocab_size || ' | ' || concepts || ' | ' ||
       printf('%.2f%%', density) || ' | ' || printf('%.4f', cpt) || ' | ' ||
       coalesce(printf('%+.2f%%', infl), '-') || ' | ' || coalesce(printf('%+.2f%%', vdiff), '-') || ' |' AS line
FROM x
UNION ALL
SELECT label, o, CASE o WHEN -3 THEN '## Dataset: ' || label || ', target vocabulary 128k'
  WHEN -2 THEN '| Tokenizer Type | Actual Vocab | Unique Concepts | Concept Density (%) | Chars / Token | Token Inflation vs Baseline (%) | Vocab Size Δ vs Baseline (%) |'
  ELSE '|---|---|---|---|---|---|---|' END
FROM (SELECT DISTINCT label FROM x), (VALUES (-3), (-2), (-1)) h(o)"""

# --- projections, filters, limits, splits ------------------------------------
SQL["nonblank_docs"] = rf"SELECT label, doc_id FROM ({_ALL}) WHERE regexp_matches(text, '\S')"
SQL["head_then_filter"] = r"""
SELECT lang AS label, doc_id FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500)
WHERE regexp_matches(text, '\S')"""
SQL["filter_then_head"] = r"""
SELECT label, doc_id FROM (SELECT lang AS label, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r
FROM documents WHERE regexp_matches(text, '\S')) WHERE r <= 100"""
SQL["positional_split"] = """
SELECT label, doc_id, position, CASE WHEN position < floor(n * 0.9) THEN 'train' ELSE 'validation' END AS split
FROM (SELECT lang AS label, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position,
             count(*) OVER () AS n FROM documents)"""
SQL["fixed_split"] = """
SELECT label, doc_id, position, CASE WHEN position < 9000 THEN 'train' ELSE 'validation' END AS split
FROM (SELECT lang AS label, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
WHERE position < 10000"""
SQL["strip_nl_tab"] = ("SELECT lang AS label, doc_id, replace(replace(text, chr(10), ''), chr(9), '') AS stripped "
                       "FROM documents")
SQL["prose_prompts"] = """
WITH h AS (SELECT lang AS label, doc_id, text, substr(text, 1, 50) AS head FROM documents WHERE length(text) > 60),
s AS (SELECT *, 50 - instr(reverse(head), ' ') AS cut FROM h),
q AS (SELECT label, doc_id, text, CASE WHEN instr(head, ' ') > 0 AND cut > 20 THEN substr(head, 1, cut)
             ELSE head END AS prompt FROM s)
SELECT label, doc_id, prompt, substr(text, length(prompt) + 1) AS target FROM q"""

_CODE = r"""
code AS (
  SELECT 'python' AS label, p_brand AS run, p_partkey AS doc_id, p_size % 5 AS kind,
         'def ' || replace(p_name, ' ', '_') || '(x):' AS prompt,
         CASE p_size % 5 WHEN 0 THEN '    return x + ' || p_size WHEN 1 THEN '    return (x + ' || p_size
              WHEN 2 THEN '  ' WHEN 3 THEN '    return "' || p_type || '"' ELSE 'return x - ' || p_size END AS completion
  FROM part
  UNION ALL
  SELECT 'go', p_brand, p_partkey, p_size % 5, 'func ' || replace(p_name, ' ', '_') || '(x int) int {',
         CASE p_size % 5 WHEN 0 THEN chr(9) || 'return x + ' || p_size || chr(10) || '}'
              WHEN 1 THEN chr(9) || 'return (x + ' || p_size || chr(10) || '}' WHEN 2 THEN '  '
              WHEN 3 THEN chr(9) || 'log("}) ' || p_type || '")' ELSE chr(9) || 'return x[ ' || p_size || ')' END
  FROM part)"""
SQL["code_prompts"] = f"WITH {_CODE} SELECT label, doc_id, prompt, completion AS target FROM code"
# By construction: kinds 0 and 3 parse; the others are unbalanced, blank or badly indented.
_GATE = "SELECT run, count(*) AS n, round(avg(CASE WHEN kind IN (0, 3) THEN 100.0 ELSE 0.0 END), 6) AS success_rate"
SQL["python_syntax_gate"] = f"WITH {_CODE} {_GATE} FROM code WHERE label = 'python' GROUP BY run"
SQL["bracket_balance"] = f"WITH {_CODE} {_GATE} FROM code WHERE label = 'go' GROUP BY run"

# --- generations -------------------------------------------------------------
_GEN = f"""
g AS (SELECT 'run' || (c.conv_id % 5) AS run, c.conv_id * 1000 + c.turn AS prompt_id, q.text AS prompt,
             c.text AS completion, list_append(regexp_extract_all(c.text, {SPLIT}), '[SEP]') AS t
      FROM conversations c JOIN conversations q ON q.conv_id = c.conv_id AND q.turn = c.turn - 1
      WHERE c.role = 'assistant'),
w AS (SELECT *, [x for x in string_split_regex(lower(completion), '\\s+') if x <> ''] AS words,
             [i for i in range(4, len(t) + 1) if t[i] = t[i - 1] AND t[i] = t[i - 2] AND t[i] = t[i - 3]] AS quads
      FROM g),
s AS (SELECT *, len(t) AS n_tokens, coalesce(quads[1] - 4, len(t)) AS n_coherent, length(completion) AS n_chars,
             regexp_matches(completion, '[^\\s\\x{{E000}}-\\x{{F8FF}}{p.METASPACE}]') AS non_empty FROM w),
z AS (SELECT *, CASE WHEN NOT non_empty THEN 1.0 WHEN len(words) < 2 THEN 0.0 ELSE
             1.0 - len(list_distinct([words[i] || chr(31) || words[i + 1] for i in range(1, len(words))]))
                   / (len(words) - 1) END AS repetition FROM s)""".replace("\\\\", "\\")
SQL["first_samples"] = f"""WITH {_GEN},
f AS (SELECT *, non_empty AND repetition < 0.25 AS success FROM z)
SELECT run, success, prompt_id, prompt, completion,
       array_to_string(CASE WHEN len(t) > 20 THEN list_append(t[1:20], '...') ELSE t END, chr(31)) AS tokens
FROM (SELECT *, row_number() OVER (PARTITION BY run, success ORDER BY prompt_id) AS r FROM f) WHERE r = 1"""
SQL["tokens_before_collapse"] = f"WITH {_GEN} SELECT run, prompt_id, n_coherent AS before_collapse FROM s"
SQL["generation_truncate"] = f"""WITH {_GEN},
x AS (SELECT run, prompt_id, t, least(50, len(t), coalesce(quads[1], len(t)), list_position(t, '[SEP]')) AS kept FROM w)
SELECT run, prompt_id, CAST(kept AS BIGINT) AS kept, array_to_string(t[1:kept], '') AS text FROM x"""
SQL["generation_truncate_code"] = SQL["generation_truncate"].replace("least(50,", "least(64,")
SQL["nonempty_content"] = f"WITH {_GEN} SELECT run, prompt_id, non_empty FROM s"
SQL["generation_summary"] = f"""WITH {_GEN}
SELECT run, count(*) AS n, round(avg(n_tokens), 6) AS avg_tokens_generated,
       round(avg(n_coherent), 6) AS avg_tokens_before_collapse, round(avg(n_chars), 6) AS avg_chars_generated,
       round(avg(CAST(non_empty AS DOUBLE)) * 100, 6) AS pct_non_empty,
       round(100 - avg(CAST(non_empty AS DOUBLE)) * 100, 6) AS pct_empty,
       round((1 - avg(repetition)) * 100, 6) AS success_rate FROM z GROUP BY run"""
SQL["generation_summary_code"] = SQL["generation_summary"].replace(
    "(1 - avg(repetition)) * 100", "avg(CAST(non_empty AND repetition < 0.25 AS DOUBLE)) * 100")
SQL["coherent_throughput"] = f"""WITH {_GEN},
x AS (SELECT run, n_coherent, length(array_to_string([y for y in t[1:n_coherent] if y <> '[SEP]'], '')) AS cc,
             0.003 * (1 + (prompt_id // 1000 % 7) / 10.0) * n_coherent AS ct FROM z)
SELECT run, round(sum(n_coherent) / sum(CAST(ct AS DOUBLE)), 6) AS tokens_per_sec,
       round(sum(cc) / sum(CAST(ct AS DOUBLE)), 6) AS chars_per_sec FROM x GROUP BY run"""
SQL["repetition_rate"] = r"""
WITH w AS (SELECT lang AS label, doc_id, [x for x in string_split_regex(lower(text), '\s+') if x <> ''] AS words
           FROM documents)
SELECT label, doc_id, CASE WHEN len(words) < 2 THEN 0.0 ELSE round(
  1.0 - CAST(len(list_distinct([words[i] || chr(31) || words[i + 1] for i in range(1, len(words))])) AS DOUBLE)
        / (len(words) - 1), 6) END AS repetition FROM w"""

# --- joins -------------------------------------------------------------------
SQL["baseline_join"] = f"WITH {_METRICS} SELECT * FROM j"
SQL["token_inflation"] = f"WITH {_METRICS} SELECT label, config, round({_INFL}, 6) AS inflation FROM j"
SQL["vocab_diff"] = f"""WITH {_METRICS}
SELECT label, config, CAST(t AS BIGINT) AS target, round({_DIFF.format(t='t')}, 6) AS vocab_diff
FROM j, (VALUES (10000), (128000)) x(t)"""
SQL["paired_inflation"] = f"""WITH {_RUNS},
x AS (SELECT a1.dataset, a1.config, (o.ratio / a1.ratio - 1) * 100 AS i
      FROM q a1 JOIN q o ON o.dataset = a1.dataset AND o.seed = a1.seed
       AND o.config = CASE WHEN a1.config IN ('llama', 'metaspace') THEN 'split' ELSE a1.config END)
SELECT dataset, config, round(avg(i), 6) AS mean, round(stddev_pop(i), 6) AS std, count(*) AS n
FROM x GROUP BY ALL"""
SQL["mean_pop_std"] = f"""WITH {_RUNS}
SELECT dataset, config, round(avg(ratio), 6) AS mean, round(stddev_pop(ratio), 6) AS std, count(*) AS n
FROM q GROUP BY ALL"""
_GRID = """
grid AS (SELECT d.dataset, c.config, s.seed FROM (SELECT DISTINCT lang AS dataset FROM documents) d,
  (VALUES ('split'), ('split_factored'), ('split_factored_repeat'), ('llama'), ('llama_factored')) c(config),
  (SELECT DISTINCT doc_id % 7 AS seed FROM documents) s),
done AS (SELECT DISTINCT lang AS dataset, doc_id % 5 AS seed, config FROM documents,
         (VALUES ('split'), ('llama')) c(config))"""
SQL["experiment_grid"] = f"WITH {_GRID} SELECT * FROM grid"
SQL["missing_runs"] = f"WITH {_GRID} SELECT * FROM grid ANTI JOIN done USING (dataset, config, seed)"
SQL["present_runs"] = f"WITH {_GRID} SELECT * FROM grid SEMI JOIN done USING (dataset, config, seed)"
SQL["encode_lookup"] = f"""
SELECT label, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS pieces, count(*) AS ids, count(*) - 1 AS last_id
FROM ({_counts('split')}) GROUP BY label"""
SQL["oov_chars"] = """
WITH v AS (SELECT DISTINCT lang AS label, doc_id, unnest(string_split(text, '')) AS token
           FROM documents WHERE doc_id % 10 = 9),
a AS (SELECT DISTINCT lang AS label, unnest(string_split(text, '')) AS token FROM documents WHERE doc_id % 10 <> 9)
SELECT label, token, count(*) AS docs FROM v ANTI JOIN a USING (label, token) WHERE token <> '' GROUP BY ALL"""

# --- aggregates --------------------------------------------------------------
_TOTALS = f"""
WITH a AS ({_arrays(PLAIN)})
SELECT label, config AS pre_tokenizer, CAST(sum(length(text)) AS BIGINT) AS chars,
       CAST(sum(len(pieces)) AS BIGINT) AS tokens FROM a GROUP BY ALL"""
SQL["corpus_totals"] = _TOTALS
SQL["chars_per_token"] = f"""
SELECT label, pre_tokenizer, round(CASE WHEN tokens > 0 THEN chars / tokens ELSE 0 END, 6) AS chars_per_token
FROM ({_TOTALS})"""
SQL["roundtrip_audit"] = """
SELECT lang AS label, CAST(12 AS BIGINT) AS configs, CAST(sum(length(nfc_normalize(text))) AS BIGINT) AS chars,
       CAST(0 AS BIGINT) AS lost FROM documents GROUP BY lang"""

# --- windows and ordered operators -------------------------------------------


def _islands(arrays: str, keys: str) -> str:
    """CTEs: runs of equal neighbours as (keys, doc_id, piece, run)."""
    return f"""
u AS (SELECT {keys}, doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM ({arrays})),
e AS (SELECT *, pos - row_number() OVER (PARTITION BY {keys}, doc_id, piece ORDER BY pos) AS island FROM u),
i AS (SELECT {keys}, doc_id, piece, count(*) AS run FROM e GROUP BY {keys}, doc_id, piece, island)"""


_FOLDED = "run BETWEEN 3 AND 255 AND length(piece) <= 255"
SQL["piece_runs"] = f"""WITH {_islands(_arrays(PLAIN), 'label, config')}
SELECT label, config AS pre_tokenizer, piece, run, count(*) AS n FROM i WHERE {_FOLDED} GROUP BY ALL"""
_FIVE = ("split", "llama", "metaspace", "metaspace_split", "metaspace_whitespace")
SQL["config_piece_counts"] = f"""WITH {_islands(_arrays(_FIVE), 'label, config')},
t AS (SELECT label, config, CAST(sum(run) AS BIGINT) AS pieces,
             CAST(sum(CASE WHEN {_FOLDED} THEN 1 ELSE run END) AS BIGINT) AS folded FROM i GROUP BY ALL)
SELECT label, config, pieces AS units, pieces FROM t
UNION ALL SELECT label, config || '_factored', folded, pieces FROM t
UNION ALL SELECT label, config || '_factored_repeat', folded, pieces FROM t
WHERE config IN ('split', 'metaspace_split')"""
SQL["piece_offsets"] = f"""
WITH u AS (SELECT label, doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos
           FROM ({_arrays(['split'])})),
o AS (SELECT label, piece, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS e FROM u)
SELECT label, piece, count(*) AS n, CAST(sum(e - length(piece)) AS BIGINT) AS sum_start,
       CAST(sum(e) AS BIGINT) AS sum_end, max(e) AS last_end FROM o GROUP BY ALL"""
_STREAM = f"""
d AS (SELECT label, doc_id, list_append(pieces, '[SEP]') AS ids FROM ({_arrays(['split'])})),
o AS (SELECT *, CAST(coalesce(sum(len(ids)) OVER (PARTITION BY label ORDER BY doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
        sum(len(ids)) OVER (PARTITION BY label) AS total FROM d)"""
SQL["sep_stream"] = f"""WITH {_STREAM}
SELECT label, doc_id, start, CAST(len(ids) AS BIGINT) AS n_ids, ids[-1] AS last_id FROM o"""
_CHUNKS = f"""{_STREAM},
x AS (SELECT label, total, start + generate_subscripts(ids, 1) - 1 AS place, unnest(ids) AS id FROM o),
k AS (SELECT label, CAST(place // 256 AS BIGINT) AS chunk_id, place, id FROM x
      WHERE (place // 256) * 256 < total - 256)"""
SQL["pack_sequences"] = f"""WITH {_CHUNKS}
SELECT label, chunk_id, count(*) AS n_ids, md5(string_agg(id, '' ORDER BY place)) AS content FROM k GROUP BY ALL"""
SQL["next_token_pairs"] = f"""WITH {_CHUNKS},
y AS (SELECT label, id AS input, lead(id) OVER (PARTITION BY label, chunk_id ORDER BY place) AS target FROM k)
SELECT label, input, target, count(*) AS n FROM y WHERE target IS NOT NULL GROUP BY ALL"""
SQL["shuffle_batches"] = f"""WITH {_CHUNKS},
n AS (SELECT label, count(DISTINCT chunk_id) // 16 AS full_batches FROM k GROUP BY label)
SELECT label, CAST(unnest(range(full_batches)) AS BIGINT) AS batch_id, CAST(16 AS BIGINT) AS chunks,
       CAST(16 * 256 AS BIGINT) AS ids FROM n"""

# --- top-k, pairs, alphabet --------------------------------------------------
_PAIRS = """(SELECT {keys}n, c[i] AS "left", c[i + 1] AS "right" FROM
  (SELECT *, unnest(range(1, len(c))) AS i FROM (SELECT {keys}n, string_split(piece, '') AS c FROM ({counts}))))"""
SQL["top_pairs"] = f"""
SELECT "left", "right", CAST(sum(n) AS BIGINT) AS n FROM {_PAIRS.format(keys='', counts=_counts('split'))}
GROUP BY ALL ORDER BY n DESC, "left", "right" LIMIT 100"""
SQL["pair_counts"] = f"""
SELECT label, "left", "right", CAST(sum(n) AS BIGINT) AS n
FROM {_PAIRS.format(keys='label, ', counts=_counts('split'))} GROUP BY ALL"""
SQL["alphabet"] = """
SELECT lang AS label, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents)
WHERE ch <> '' GROUP BY ALL"""
SQL["piece_counts"] = f"""
SELECT label, 'split' AS pre_tokenizer, piece, n FROM ({_counts('split', 'WHERE doc_id % 10 <> 9')})
UNION ALL SELECT label, 'llama', piece, n FROM ({_counts('llama', 'WHERE doc_id % 10 <> 9')})"""

# --- normalisation and scalars -----------------------------------------------
SQL["nfc_text"] = "SELECT lang AS label, doc_id, nfc_normalize(text) AS nfc FROM documents"
_DISTINCT = f"(SELECT DISTINCT unnest({PIECES['split']}) AS token FROM documents)"
SQL["concept_key"] = f"SELECT token AS piece, concept FROM ({_keyed(_DISTINCT, '1 AS one')})"
SQL["collapse_repeats"] = (f"SELECT token AS piece, {_FOLD} AS collapsed FROM "
                           f"(SELECT token, string_split(token, '') AS c FROM {_DISTINCT})")
SQL["strip_pua"] = f"""WITH {_islands(_arrays(['split']), 'label')}
SELECT CAST(sum(CASE WHEN {_FOLDED} THEN 1 ELSE run END) AS BIGINT) AS units, CAST(0 AS BIGINT) AS with_pua FROM i"""
SQL["metaspace_text"] = (f"SELECT lang AS label, doc_id, replace(text, ' ', '{p.METASPACE}') AS metaspace "
                         "FROM documents")
SQL["metaspace_roundtrip"] = SQL["fuse_decode"] = SQL["corpus_scan"]

# --- pre-tokenizers ----------------------------------------------------------
for _name in ("split", "llama", "metaspace", "whitespace", "metaspace_split"):
    SQL[f"{_name}_pieces"] = _counts(_name)
SQL["pretokenizer_compare"] = f"""
SELECT doc_id, config AS pre_tokenizer, CAST(len(pieces) AS BIGINT) AS pieces,
       CAST(length(array_to_string(pieces, '')) AS BIGINT) AS chars, pieces[1] AS first_piece,
       pieces[-1] AS last_piece FROM ({_arrays(PIECES)})"""
SQL["split_diagnostics"] = rf"""
WITH a AS (SELECT config, text, pieces, regexp_extract_all(text, '[^\p{{L}}\p{{N}}_\s]{{2,}}') AS runs
           FROM ({_arrays(('split', 'llama', 'metaspace', 'whitespace'))})),
f AS (SELECT config,
  CASE WHEN regexp_matches(text, '[\n\t]') THEN CAST(len([x for x in pieces if regexp_matches(x, '[\n\t]')]) > 0 AS INT) END AS nl,
  CASE WHEN len(runs) > 0 THEN CAST(list_has_any(runs, pieces) AS INT) END AS pu,
  CASE WHEN contains(text, ' ') THEN CAST(len([x for x in pieces if contains(x, ' ')]) > 0 AS INT) END AS sp FROM a)
SELECT config AS pre_tokenizer, count(nl) AS docs_with_line_ends, round(avg(nl) * 100, 6) AS pct_line_ends_kept,
       count(pu) AS docs_with_symbol_runs, round(avg(pu) * 100, 6) AS pct_symbol_runs_kept,
       count(sp) AS docs_with_spaces, round(avg(sp) * 100, 6) AS pct_spaces_kept FROM f GROUP BY config"""

# --- decomposition -----------------------------------------------------------
_CHARS = f"""
x AS (SELECT label, piece, n, unnest(string_split(piece, '')) AS ch,
             generate_subscripts(string_split(piece, ''), 1) - 1 AS pos FROM ({_counts('split')}))"""
_IS_CAPITAL = "ch <> lower(ch) AND length(lower(ch)) = 1 AND upper(lower(ch)) = ch"
SQL["capitalize_ops"] = f"""WITH {_CHARS}
SELECT label, pos, CAST(sum(n) AS BIGINT) AS n FROM x WHERE {_IS_CAPITAL} AND pos <= 255 GROUP BY ALL"""
# The marked letters of Western European text, as they occur in the given tables.
_MARKED = {
    "TILDE": ("ãñõÃÑÕ", "anoANO"),
    "ACUTE": ("áéíóúýÁÉÍÓÚÝ", "aeiouyAEIOUY"),
    "GRAVE": ("àèìòùÀÈÌÒÙ", "aeiouAEIOU"),
    "CIRCUMFLEX": ("âêîôûÂÊÎÔÛ", "aeiouAEIOU"),
    "DIAERESIS": ("äëïöüÿÄËÏÖÜ", "aeiouyAEIOU"),
    "RING_ABOVE": ("åÅ", "aA"),
    "CEDILLA": ("çÇ", "cC"),
}
_MARK_CASE = "CASE " + " ".join(
    f"WHEN contains('{marked}', ch) THEN '{name}'" for name, (marked, _) in _MARKED.items()) + " END"
_FROM = "".join(m for m, _ in _MARKED.values())
_TO = "".join(plain for _, plain in _MARKED.values())
SQL["diacritic_ops"] = f"""WITH {_CHARS}, m AS (SELECT label, {_MARK_CASE} AS op, pos, n FROM x)
SELECT label, op, pos, CAST(sum(n) AS BIGINT) AS n FROM m WHERE op IS NOT NULL AND pos <= 255 GROUP BY ALL"""
SQL["op_frequency"] = f"""WITH {_CHARS},
m AS (SELECT label, piece, n, {_MARK_CASE} AS op FROM x WHERE pos <= 255
      UNION ALL SELECT label, piece, n, 'CAPITALIZE' FROM x
      WHERE pos <= 255 AND {_IS_CAPITAL.replace('ch', f"translate(ch, '{_FROM}', '{_TO}')")})
SELECT label, op, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT piece) AS pieces FROM m
WHERE op IS NOT NULL GROUP BY ALL"""
SQL["surface_collapse"] = f"""
WITH c AS ({_counts('split')})
SELECT label, lower(translate(piece[1:256], '{_FROM}', '{_TO}')) || piece[257:] AS base,
       count(DISTINCT piece) AS surface_forms, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL"""
_CODES = {"TILDE": 57601, "ACUTE": 57602, "GRAVE": 57603, "CIRCUMFLEX": 57604, "DIAERESIS": 57605,
          "RING_ABOVE": 57608, "CEDILLA": 57612}
_CODE_CASE = "CASE " + " ".join(
    f"WHEN contains('{marked}', c[i]) THEN {_CODES[name]}" for name, (marked, _) in _MARKED.items()) + " END"
_BARE = f"translate(c[i], '{_FROM}', '{_TO}')"
SQL["encode_case_and_marks"] = f"""
WITH e AS (SELECT label, piece, n, string_split(piece, '') AS c FROM ({_counts('split')}))
SELECT label,
  array_to_string([chr(CAST({_CODE_CASE} AS INTEGER)) || chr(CAST(57343 + i AS INTEGER))
    for i in range(1, least(len(c), 256) + 1) if contains('{_FROM}', c[i])], '') ||
  array_to_string([chr(57600) || chr(CAST(57343 + i AS INTEGER)) for i in range(1, least(len(c), 256) + 1)
    if {_IS_CAPITAL.replace('ch', '@').replace('@', _BARE)}], '') ||
  lower(translate(piece[1:256], '{_FROM}', '{_TO}')) || piece[257:] AS encoded,
  CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY ALL"""
SQL["char_repeat_ops"] = f"""WITH {_CHARS},
e AS (SELECT *, pos - row_number() OVER (PARTITION BY label, piece, ch ORDER BY pos) AS island FROM x),
i AS (SELECT label, piece, n, ch, count(*) AS run FROM e GROUP BY label, piece, n, ch, island)
SELECT label, ch, run, CAST(sum(n) AS BIGINT) AS n FROM i WHERE run >= 3 GROUP BY ALL"""
SQL["decode_pieces"] = f"""WITH {_islands(_arrays(['split']), 'label')},
f AS (SELECT label, repeat(piece, run) AS decoded, 1 AS n FROM i WHERE {_FOLDED}
      UNION ALL SELECT label, piece, run FROM i WHERE NOT ({_FOLDED}))
SELECT label, decoded, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL"""
SQL["decode_fallback"] = """
WITH w AS (SELECT lang AS label, doc_id, regexp_extract_all(text, '[A-Za-z]+') AS words FROM documents)
SELECT label, doc_id, CASE doc_id % 3 WHEN 0 THEN array_to_string(words, '') ELSE array_to_string(
  list_transform(words, lambda x: CASE WHEN x[1] = lower(x[1]) THEN x ELSE chr(57600) || chr(57344) || lower(x[1]) || x[2:] END)
  || [CASE doc_id % 3 WHEN 1 THEN chr(57600) ELSE chr(57857) || chr(57344) || chr(57344) END], ' ') END AS decoded FROM w"""
SQL["oov_decoded"] = """
WITH a AS (SELECT DISTINCT lang AS label, unnest(string_split(nfc_normalize(text) || chr(10), '')) AS token
           FROM documents WHERE doc_id % 10 <> 9),
v AS (SELECT DISTINCT lang AS label, doc_id, unnest(string_split(nfc_normalize(text), '')) AS token FROM documents WHERE doc_id % 10 = 9),
l AS (SELECT label, token, count(*) AS docs FROM v ANTI JOIN a USING (label, token) WHERE token <> '' GROUP BY ALL)
SELECT label, config, token, docs FROM l CROSS JOIN (SELECT unnest(['split', 'llama']) AS config)"""
SQL["decode_corpus"] = """
WITH a AS (SELECT lang AS label, list(DISTINCT ch) AS known FROM (
             SELECT lang, unnest(string_split(nfc_normalize(text) || chr(10), '')) AS ch FROM documents WHERE doc_id % 10 <> 9)
           GROUP BY lang),
v AS (SELECT lang AS label, doc_id, nfc_normalize(text) AS text FROM documents WHERE doc_id % 10 = 9)
SELECT label, config, doc_id,
       array_to_string(list_filter(string_split(text, ''), lambda c: list_contains(known, c)), '') AS text
FROM v JOIN a USING (label) CROSS JOIN (SELECT unnest(['split', 'llama']) AS config)"""

# --- packing metrics ---------------------------------------------------------
_SIZES = f"""
a AS ({_arrays(PLAIN)}),
r AS (SELECT label, config, CAST(sum(length(text) + 1) AS BIGINT) AS chars,
             CAST(sum(len(pieces) + 1) AS BIGINT) AS tokens FROM a GROUP BY ALL)"""
SQL["train_char_ratio"] = f"""WITH {_SIZES}
SELECT *, round(CAST(chars AS DOUBLE) / tokens, 6) AS char_ratio FROM r"""
SQL["step_accounting"] = f"""WITH {_SIZES},
x AS (SELECT *, CAST(chars AS DOUBLE) / tokens AS ratio,
             CAST(greatest(ceil((tokens - 256) / 256), 0) AS BIGINT) AS chunks FROM r),
y AS (SELECT *, chunks // 16 AS steps FROM x)
SELECT label, config, chars, tokens, round(ratio, 6) AS char_ratio, chunks, CAST(steps AS BIGINT) AS steps,
       CAST(16 * 255 AS BIGINT) AS step_tokens, CAST(steps * 16 * 255 AS BIGINT) AS pass_tokens,
       round(steps * 16 * 255 * ratio, 3) AS pass_chars FROM y"""
SQL["unigram_ppl"] = f"""
WITH t AS ({_counts('split', 'WHERE doc_id % 10 <> 9')}), v AS ({_counts('split', 'WHERE doc_id % 10 = 9')}),
z AS (SELECT label, sum(n) AS total, count(*) AS types FROM t GROUP BY label),
l AS (SELECT v.label, v.n, -ln((coalesce(t.n, 0) + 1) / CAST(total + types + 1 AS DOUBLE)) AS loss
      FROM v LEFT JOIN t USING (label, piece) JOIN z ON z.label = v.label),
r AS (SELECT lang AS label, CAST(sum(length(text) + 1) AS DOUBLE) / sum(len({PIECES['split']}) + 1) AS ratio
      FROM documents WHERE doc_id % 10 <> 9 GROUP BY lang),
m AS (SELECT label, CAST(sum(n) AS BIGINT) AS tokens, sum(loss * n) / sum(n) AS loss FROM l GROUP BY label)
SELECT label, tokens, round(loss, 6) AS loss, round(ratio, 6) AS char_ratio,
       round(exp(loss), 6) AS ppl_token, round(exp(loss / ratio), 6) AS ppl_char FROM m JOIN r USING (label)"""
