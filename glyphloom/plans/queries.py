"""Registered queries: one per operator, each over the whole given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import opcodes as oc
from glyphloom.functions import patterns as p
from glyphloom.functions import pieces as pc
from glyphloom.functions import scoring as sc
from glyphloom.functions import text as t
from glyphloom.operators import decompose as dec
from glyphloom.operators import encode as enc
from glyphloom.operators import experiments as ex
from glyphloom.operators import generation as gen
from glyphloom.operators import metrics as mt
from glyphloom.operators import packing as pk
from glyphloom.operators import pieces as pcs
from glyphloom.operators import ranking as rk
from glyphloom.operators.configs import CATALOGUE, REPORT_CONFIGS, config_table
from glyphloom.plans import bindings as b
from glyphloom.plans.vocabulary_profile import Profile, profile
from glyphloom.session import work_dir, written
from glyphloom.sources import corpus as co
from glyphloom.sources import reports, results

QUERIES = {}
FACTORED = ("split_factored",)
TARGET_SIZE = 16_000       # vocabulary target of the registered training queries
CONTEXT = 256              # sequence length of the packing queries
BATCH = 16
TOP_PAIRS = 100


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(col):
    return F.round(col, 6)


def _text(spark, sf):
    """Documents as (label, doc_id, text)."""
    return b.documents(spark, sf)


# --- scans, sources, sinks ---------------------------------------------------

@query
def corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _text(spark, sf)


@query
def corpus_union(spark, sf):
    return co.all_corpora(spark, sf).groupBy("label").agg(
        F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"),
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query
def corpus_text_sink(spark, sf):
    path = work_dir(spark, "corpus-text")
    co.write_training_text(_text(spark, sf), path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def metrics_json_sink(spark, sf):
    path = work_dir(spark, "metrics")
    df = mt.chars_per_token(b.piece_metrics(_text(spark, sf)))
    results.write_metrics(df, path)
    return results.read_metrics(spark, path, df.schema).withColumn(
        "chars_per_token", r6("chars_per_token"))


@query
def run_results_scan(spark, sf):
    path = work_dir(spark, "runs")
    runs = b.run_results(_text(spark, sf)).withColumnRenamed("config", "tokenizer_type")
    results.write_runs(runs, path)
    return results.read_runs(spark, path, multiline=False).select(
        "run", "seed", "model_size", "dataset", "tokenizer_type",
        r6("char_to_token_ratio").alias("char_to_token_ratio"),
        "train_tokens_count", "train_chars_count")


@query
def vocab_report(spark, sf):
    df = mt.with_baseline(b.piece_metrics(_text(spark, sf)), baselines=b.BASELINES)
    concepts = _piece_concepts(_text(spark, sf))
    df = df.join(concepts.select("label", "config", "concepts", "density"), ["label", "config"]).select(
        "label", F.lit(128_000).cast("bigint").alias("target_vocab_size"), "config",
        F.col("vocab_size").alias("actual_vocab_size"), "concepts", "density",
        mt.ratio(F.col("chars"), F.col("tokens")).alias("chars_per_token"),
        mt.inflation(F.col("tokens"), F.col("base_tokens")).alias("inflation"),
        mt.vocab_diff(F.col("vocab_size"), F.col("base_vocab_size"), F.lit(128_000)).alias("vocab_diff"))
    return reports.vocab_report(df).select("label", F.col("ord").cast("bigint").alias("ord"), "line")


@query
def sample_report(spark, sf):
    samples = gen.first_samples(b.generation_results(spark, sf))
    return reports.sample_report(samples).withColumn("ord", F.col("ord").cast("bigint"))


# --- projections, filters, limits, splits ------------------------------------

@query
def nonblank_docs(spark, sf):
    return co.nonblank(co.all_corpora(spark, sf)).select("label", "doc_id")


@query
def head_then_filter(spark, sf):
    return co.nonblank(rk.first_n(_text(spark, sf), 500)).select("label", "doc_id")


@query
def filter_then_head(spark, sf):
    return rk.first_n_per_group(co.nonblank(_text(spark, sf)).select("label", "doc_id"), 100, "label")


@query
def positional_split(spark, sf):
    return rk.positional_split(_text(spark, sf).select("label", "doc_id"))


@query
def fixed_split(spark, sf):
    """9,000 rows to train and 1,000 to validate, as a corpus that ships without a split is cut."""
    return rk.positional_split_at(_text(spark, sf).select("label", "doc_id"), 9_000, 1_000)


@query
def strip_nl_tab(spark, sf):
    return _text(spark, sf).select("label", "doc_id", t.strip_newline_tab(F.col("text")).alias("stripped"))


@query
def prose_prompts(spark, sf):
    return gen.prose_prompts(_text(spark, sf))


@query
def code_prompts(spark, sf):
    return gen.code_prompts(b.code(spark, sf))


@query
def first_samples(spark, sf):
    df = gen.first_samples(b.generation_results(spark, sf))
    return df.withColumn("tokens", F.array_join("tokens", "\x1f"))


# --- joins -------------------------------------------------------------------

@query
def baseline_join(spark, sf):
    return mt.with_baseline(b.piece_metrics(_text(spark, sf)), baselines=b.BASELINES)


@query
def paired_inflation(spark, sf):
    df = ex.paired_inflation(b.run_results(_text(spark, sf)), baselines=b.BASELINES)
    return df.groupBy("dataset", "config").agg(
        r6(F.avg("inflation")).alias("mean"), r6(F.stddev_pop("inflation")).alias("std"),
        F.count("*").alias("n"))


def _planned(spark, sf):
    """Every label, configuration and shard of the documents table."""
    docs = _text(spark, sf)
    return ex.grid(docs.select(F.col("label").alias("dataset")).distinct(),
                   config_table(spark, REPORT_CONFIGS).select("config"),
                   docs.select(F.pmod("doc_id", F.lit(7)).alias("seed")).distinct())


def _finished(spark, sf):
    """Runs counted as done: the unfactored ones, for shards 0 to 4."""
    return b.run_results(_text(spark, sf), ("split", "llama"))


@query
def experiment_grid(spark, sf):
    return _planned(spark, sf)


@query
def missing_runs(spark, sf):
    return ex.missing_runs(_planned(spark, sf), _finished(spark, sf))


@query
def present_runs(spark, sf):
    return ex.present_runs(_planned(spark, sf), _finished(spark, sf))


@query
def encode_lookup(spark, sf):
    """Piece -> id over all occurrences, ids ranked by piece within each label."""
    counts = pcs.piece_counts(_text(spark, sf), ["split"])
    ids = rk.with_position(counts.withColumn("key", F.xxhash64("piece")), "id", "key", ("label",))
    back = counts.join(ids.select("label", "piece", "id"), ["label", "piece"])
    # ids depend on the hash; what must hold is that they are dense and unique
    return back.groupBy("label").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("pieces"),
        F.count_distinct("id").alias("ids"), F.max("id").alias("last_id"))


@query
def oov_chars(spark, sf):
    docs = _text(spark, sf)
    letters = pcs.alphabet(pcs.piece_counts(b.train(docs), ["split"]))
    return enc.oov_characters(b.validation(docs), letters.select("label", F.col("ch").alias("token")))


# --- aggregates --------------------------------------------------------------

@query
def corpus_totals(spark, sf):
    return pcs.piece_totals(_text(spark, sf), b.PLAIN)


@query
def chars_per_token(spark, sf):
    df = mt.chars_per_token(pcs.piece_totals(_text(spark, sf), b.PLAIN))
    return df.select("label", "pre_tokenizer", r6("chars_per_token").alias("chars_per_token"))


@query
def token_inflation(spark, sf):
    df = mt.with_baseline(b.piece_metrics(_text(spark, sf)), baselines=b.BASELINES)
    return df.select("label", "config", r6(mt.inflation(
        F.col("tokens"), F.col("base_tokens"))).alias("inflation"))


@query
def vocab_diff(spark, sf):
    """Targets that some vocabularies reach and some do not."""
    df = mt.with_baseline(b.piece_metrics(_text(spark, sf)), baselines=b.BASELINES)
    return df.withColumn("target", F.explode(F.array(F.lit(10_000), F.lit(128_000)))).select(
        "label", "config", F.col("target").cast("bigint").alias("target"),
        r6(mt.vocab_diff(F.col("vocab_size"), F.col("base_vocab_size"), F.col("target"))).alias("vocab_diff"))


def _piece_concepts(docs):
    """Concepts of the distinct training pieces, with five special tokens on top."""
    counts = b.split_counts(docs, b.PLAIN).filter(F.col("n_train") > 0)
    return mt.concept_density(counts.withColumnRenamed("pre_tokenizer", "config"),
                              ["label", "config"], "piece", unlisted=len(p.SPECIAL_TOKENS))


@query
def concept_density(spark, sf):
    df = _piece_concepts(_text(spark, sf))
    return df.withColumn("density", r6("density"))


@query
def mean_pop_std(spark, sf):
    df = ex.mean_pop_std(b.run_results(_text(spark, sf)), "char_to_token_ratio")
    return df.withColumns({"mean": r6("mean"), "std": r6("std")})


@query
def generation_summary(spark, sf):
    df = gen.summary(b.generation_results(spark, sf))
    return df.select("run", "n", *[r6(c).alias(c) for c in df.columns[2:]])


@query
def generation_summary_code(spark, sf):
    """The summary of code runs, whose success rate is the share of successes."""
    df = gen.summary(b.generation_results(spark, sf), code=True)
    return df.select("run", "n", *[r6(c).alias(c) for c in df.columns[2:]])


@query
def coherent_throughput(spark, sf):
    df = gen.coherent_throughput(b.generation_results(spark, sf))
    return df.select("run", r6("tokens_per_sec").alias("tokens_per_sec"),
                     r6("chars_per_sec").alias("chars_per_sec"))


@query
def roundtrip_audit(spark, sf):
    """decode(encode(x)) = x over every distinct unit of every configuration."""
    units = dec.decode_units(dec.dictionary(_text(spark, sf), CATALOGUE))
    return units.groupBy("label").agg(
        F.count_distinct("config").alias("configs"),
        F.sum(F.when(F.col("config") == "split",
                     F.col("n") * F.col("run") * F.length("piece")).otherwise(0)).alias("chars"),
        F.sum(F.when(~F.col("lossless"), F.col("n")).otherwise(0)).alias("lost"))


# --- windows and ordered operators -------------------------------------------

@query
def piece_runs(spark, sf):
    factored = ("split_factored", "llama_factored", "metaspace_factored")
    runs = pcs.unit_arrays(_text(spark, sf), factored).select(
        "label", F.substring_index("stream", "+", 1).alias("pre_tokenizer"), F.inline("units"))
    return runs.filter(F.col("run") > 1).groupBy(
        "label", "pre_tokenizer", "piece", F.col("run").cast("bigint").alias("run")).agg(F.count("*").alias("n"))


@query
def tokens_before_collapse(spark, sf):
    return b.generations(spark, sf).select("run", "prompt_id", sc.tokens_before_collapse(
        F.col("tokens")).cast("bigint").alias("before_collapse"))


def _truncated(spark, sf, cap):
    cut = sc.truncate_generation(F.col("tokens"), F.lit(b.SEP), cap)
    return b.generations(spark, sf).select(
        "run", "prompt_id", F.size(cut).cast("bigint").alias("kept"),
        F.array_join(cut, "").alias("text"))


@query
def generation_truncate(spark, sf):
    return _truncated(spark, sf, 50)


@query
def generation_truncate_code(spark, sf):
    """The longer cap of code completions."""
    return _truncated(spark, sf, 64)


@query
def piece_offsets(spark, sf):
    return pcs.piece_spans(_text(spark, sf), ["split"]).drop("pre_tokenizer")


def _stream(spark, sf):
    """Documents as streams of pieces, each closed by the separator."""
    arrays = pcs.piece_arrays(_text(spark, sf), ["split"])
    docs = arrays.select("label", F.col("pre_tokenizer").alias("config"), "doc_id",
                         F.col("pieces").alias("ids"))
    return pk.with_separator(docs, F.lit(b.SEP))


@query
def sep_stream(spark, sf):
    df = pk.stream_offsets(_stream(spark, sf))
    return df.select("label", "doc_id", "start", F.size("ids").cast("bigint").alias("n_ids"),
                     F.element_at("ids", -1).alias("last_id"))


@query
def pack_sequences(spark, sf):
    df = pk.pack(_stream(spark, sf), CONTEXT)
    return df.select("label", F.col("chunk_id").cast("bigint").alias("chunk_id"),
                     F.size("ids").cast("bigint").alias("n_ids"), F.md5(F.array_join("ids", "")).alias("content"))


@query
def next_token_pairs(spark, sf):
    df = pk.next_token_pairs(pk.pack(_stream(spark, sf), CONTEXT))
    return df.groupBy("label", "input", "target").agg(F.count("*").alias("n"))


@query
def shuffle_batches(spark, sf):
    # batches are told by chunk and size: ids that nobody reads are neither dealt to ranges nor written
    chunks = pk.pack(_stream(spark, sf), CONTEXT).withColumn("ids", F.size("ids"))
    df = pk.batches(chunks, BATCH, seed=42)
    return df.groupBy("label", "batch_id").agg(F.count("*").alias("chunks"), F.sum("ids").alias("ids"))


# --- top-k -------------------------------------------------------------------

@query
def top_pairs(spark, sf):
    counts = pcs.piece_counts(_text(spark, sf), ["split"])
    return pcs.top_pairs(pcs.pair_counts(counts, ()), TOP_PAIRS)


# --- normalisation and scalars -----------------------------------------------

@query
def nfc_text(spark, sf):
    return _text(spark, sf).select("label", "doc_id", t.nfc(F.col("text")).alias("nfc"))


def _distinct_pieces(spark, sf):
    return pcs.piece_counts(_text(spark, sf), ["split"], ()).select("piece")


@query
def concept_key(spark, sf):
    return _distinct_pieces(spark, sf).select("piece", t.concept_key(F.col("piece")).alias("concept"))


@query
def collapse_repeats(spark, sf):
    return _distinct_pieces(spark, sf).select(
        "piece", t.collapse_repeats(F.col("piece")).alias("collapsed"))


@query
def strip_pua(spark, sf):
    """Opcodes out again: the encoded distinct pieces give back their bases."""
    dic = dec.encode_units(dec.dictionary(_text(spark, sf), ("split_factored",), ()))
    clean = t.strip_pua(F.col("encoded"))
    return dic.select("n", clean.alias("base")).groupBy("base").agg(F.sum("n").alias("n")) \
        .agg(F.sum("n").alias("units"), F.sum(F.when(
            F.regexp_like("base", F.lit(f"[{p.PUA_WIDE}]")), 1).otherwise(0)).cast("bigint").alias("with_pua"))


@query
def metaspace_text(spark, sf):
    return _text(spark, sf).select("label", "doc_id", t.to_metaspace(F.col("text")).alias("metaspace"))


@query
def metaspace_roundtrip(spark, sf):
    pieces = F.col("pieces")
    return pcs.piece_arrays(_text(spark, sf), ["metaspace"]).select(
        "label", "doc_id", t.from_metaspace(t.fuse(pieces)).alias("text"))


@query
def fuse_decode(spark, sf):
    return pcs.piece_arrays(_text(spark, sf), ["split"]).select(
        "label", "doc_id", t.fuse(F.col("pieces")).alias("text"))


@query
def nonempty_content(spark, sf):
    return b.generations(spark, sf).select(
        "run", "prompt_id", sc.nonempty_content(F.col("completion")).alias("non_empty"))


@query
def repetition_rate(spark, sf):
    return _text(spark, sf).select("label", "doc_id", r6(
        sc.repetition_rate(F.col("text"))).alias("repetition"))


@query
def bracket_balance(spark, sf):
    df = gen.bracket_gate(b.code(spark, sf).filter(F.col("label") == "go"))
    return df.withColumn("success_rate", r6("success_rate"))


@query
def python_syntax_gate(spark, sf):
    df = gen.python_gate(b.code(spark, sf).filter(F.col("label") == "python"))
    return df.withColumn("success_rate", r6("success_rate"))


# --- pre-tokenizers ----------------------------------------------------------

def _counted(spark, sf, name):
    return pcs.piece_counts(_text(spark, sf), [name]).drop("pre_tokenizer")


@query
def split_pieces(spark, sf):
    return _counted(spark, sf, "split")


@query
def llama_pieces(spark, sf):
    return _counted(spark, sf, "llama")


@query
def metaspace_pieces(spark, sf):
    return _counted(spark, sf, "metaspace")


@query
def whitespace_pieces(spark, sf):
    return _counted(spark, sf, "whitespace")


@query
def metaspace_split_pieces(spark, sf):
    return _counted(spark, sf, "metaspace_split")


@query
def config_piece_counts(spark, sf):
    """Units per configuration; the factored ones count the units left after folding runs."""
    sizes = pcs.unit_sizes(_text(spark, sf), CATALOGUE)
    return pcs.with_configs(sizes, CATALOGUE).select("label", "config", "units", "pieces")


@query
def pretokenizer_compare(spark, sf):
    """Every pre-tokenizer on every text, summed per document."""
    return pcs.piece_sizes(_text(spark, sf), tuple(pc.PRE_TOKENIZERS)).select(
        "doc_id", "pre_tokenizer", F.col("pieces").cast("bigint").alias("pieces"), "chars", "first_piece", "last_piece")


@query
def split_diagnostics(spark, sf):
    return pcs.split_diagnostics(_text(spark, sf), ("split", "llama", "metaspace", "whitespace"))


# --- decomposition -----------------------------------------------------------

@query
def capitalize_ops(spark, sf):
    """Capital positions with repetition off, so positions are those in the text."""
    counts = pcs.piece_counts(_text(spark, sf), ["split"])
    dic = oc.with_opcodes(counts, capitalize=True, repeat=False, serialize=False)
    return dec.op_positions(dic).select("label", F.col("pos").cast("bigint").alias("pos"), "n")


@query
def diacritic_ops(spark, sf):
    counts = pcs.piece_counts(_text(spark, sf), ["split"])
    dic = oc.with_opcodes(counts, capitalize=False, repeat=False, serialize=True)
    return dec.op_positions(dic).select("label", "op", F.col("pos").cast("bigint").alias("pos"), "n")


@query
def char_repeat_ops(spark, sf):
    counts = pcs.piece_counts(_text(spark, sf), ["split"])
    return dec.char_runs(counts).withColumn("run", F.col("run").cast("bigint"))


@query
def multi_repeat_ops(spark, sf):
    dic = dec.dictionary(_text(spark, sf), FACTORED)
    uses = dec.op_occurrences(dic).filter(F.col("op") == "MULTIREPEAT")
    return uses.select("label", F.array_join("params", ",").alias("params"), "n").groupBy(
        "label", "params").agg(F.sum("n").alias("n"))


@query
def op_limits(spark, sf):
    return dec.limits(dec.dictionary(_text(spark, sf), FACTORED))


@query
def split_operator_forms(spark, sf):
    """Words per unit when operators stand apart and when they are fused to the base."""
    dic = dec.dictionary(_text(spark, sf), FACTORED)
    apart, fused = (oc.words(F.col("ops"), F.col("base"), flag) for flag in (True, False))
    return dic.groupBy("label").agg(
        F.sum(F.size(apart) * F.col("n")).alias("words_apart"),
        F.sum(F.size(fused) * F.col("n")).alias("words_fused"),
        F.count_distinct(F.element_at(apart, -1)).alias("bases"),
        F.count_distinct(F.element_at(fused, -1)).alias("fused_forms"))


@query
def encode_pieces(spark, sf):
    dic = dec.encode_units(dec.dictionary(_text(spark, sf), FACTORED))
    return dic.groupBy("label", "encoded").agg(F.sum("n").alias("n"))


@query
def encode_case_and_marks(spark, sf):
    """Encoded distinct pieces with repetition off."""
    counts = pcs.piece_counts(_text(spark, sf), ["split"])
    dic = oc.with_opcodes(counts, capitalize=True, repeat=False, serialize=True)
    return dec.encode_units(dic).groupBy("label", "encoded").agg(F.sum("n").alias("n"))


@query
def decode_fallback(spark, sf):
    """Streams of case operators, two thirds of them broken at their end, decoded or joined as they are."""
    def token(word):
        first = F.substring(word, 1, 1)
        lowered = F.concat(F.lit(chr(p.CAPITALIZE) + chr(p.PARAM_BASE)), F.lower(first), F.substring(word, F.lit(2), F.length(word)))
        return F.when(first != F.lower(first), lowered).otherwise(word)

    tokens = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), token)
    third = F.pmod("doc_id", F.lit(3))
    broken = F.when(third == 1, F.array(F.lit(chr(p.CAPITALIZE)))).when(
        third == 2, F.array(F.lit(chr(p.MULTIREPEAT) + chr(p.PARAM_BASE) * 2))).otherwise(F.array().cast("array<string>"))
    docs = _text(spark, sf).withColumn("tokens", F.concat(tokens, broken))
    return oc.with_decoded_or_joined(docs, "tokens", "decoded").select("label", "doc_id", "decoded")


@query
def decode_pieces(spark, sf):
    """Decoded units, counted; must equal the units of the text."""
    df = dec.decode_units(dec.dictionary(_text(spark, sf), FACTORED))
    return df.groupBy("label", "decoded").agg(F.sum("n").alias("n"))


@query
def surface_collapse(spark, sf):
    counts = pcs.piece_counts(_text(spark, sf), ["split"])
    dic = oc.with_opcodes(counts, capitalize=True, repeat=False, serialize=True)
    return dec.surface_collapse(dic, ("label",))


@query
def op_frequency(spark, sf):
    counts = pcs.piece_counts(_text(spark, sf), ["split"])
    dic = oc.with_opcodes(counts, capitalize=True, repeat=False, serialize=True)
    return dec.op_frequency(dic, ("label",))


# --- vocabulary induction and encoding ---------------------------------------

_PROFILES: dict[tuple, Profile] = {}


def _profile(spark, sf) -> Profile:
    """One training run per session and scale; its tables are written, not held."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PROFILES:
        docs = _text(spark, sf)
        _PROFILES[key] = profile(b.train(docs), b.validation(docs), TARGET_SIZE)
    return _PROFILES[key]


@query
def piece_counts(spark, sf):
    return pcs.piece_counts(b.train(_text(spark, sf)), ["split", "llama"])


@query
def alphabet(spark, sf):
    return pcs.alphabet(pcs.piece_counts(_text(spark, sf), ["split"]))


@query
def pair_counts(spark, sf):
    return pcs.pair_counts(pcs.piece_counts(_text(spark, sf), ["split"]))


@query
def bpe_merges(spark, sf):
    return _profile(spark, sf).vocabulary.merges


@query
def vocab_table(spark, sf):
    return _profile(spark, sf).vocabulary.vocab


@query
def vocab_table_roundtrip(spark, sf):
    path = work_dir(spark, "vocabulary")
    v = _profile(spark, sf).vocabulary
    results.write_vocabulary(v.merges, v.vocab, path)
    merges, vocab = results.read_vocabulary(spark, path)
    words = merges.groupBy("label", "config").agg(F.count("*").alias("merges"))
    return vocab.groupBy("label", "config").agg(
        F.count("*").alias("entries"), F.max("id").alias("last_id")).join(words, ["label", "config"])


@query
def opcode_vocab_count(spark, sf):
    m = _profile(spark, sf).metrics()
    return m.select("label", "config", "actual_vocab_size", "opcode_tokens")


@query
def vocabulary_profile(spark, sf):
    m = _profile(spark, sf).metrics()
    rounded = ("density", "chars_per_token", "inflation", "vocab_diff")
    return m.select(*[r6(c).alias(c) if c in rounded else c for c in m.columns])


@query
def encode_corpus(spark, sf):
    df = _profile(spark, sf).encoded()
    return df.select("label", "config", "doc_id", F.size("ids").cast("bigint").alias("tokens"),
                     F.md5(F.array_join("ids", ",")).alias("content"))


def _decoded(spark, sf, configs):
    prof = _profile(spark, sf)
    df = enc.decode_ids(prof.encoded().filter(F.col("config").isin(configs)), prof.vocabulary.vocab)
    return df.select("label", "config", "doc_id", F.col("decoded").alias("text"))


@query
def decode_corpus(spark, sf):
    """All validation documents, encoded and decoded by the plain configurations."""
    return _decoded(spark, sf, [c for c in REPORT_CONFIGS if not CATALOGUE[c].factored])


@query
def decode_factored(spark, sf):
    """All validation documents, encoded and decoded by the configurations with operators."""
    return _decoded(spark, sf, [c for c in REPORT_CONFIGS if CATALOGUE[c].factored])


@query
def token_lookup(spark, sf):
    """Ids of all validation documents to tokens, and these back to ids."""
    prof = _profile(spark, sf)
    df = enc.id_to_token(prof.encoded(), prof.vocabulary.vocab)
    df = enc.token_to_id(df, prof.vocabulary.vocab, out="back")
    return df.select("label", "config", "doc_id", F.size("tokens").cast("bigint").alias("tokens"),
                     F.md5(F.array_join("tokens", "\x1f").cast("binary")).alias("content"), (F.col("back") == F.col("ids")).alias("same"))


@query
def oov_decoded(spark, sf):
    """Characters that plain configurations lose on validation documents, for want of a token."""
    prof = _profile(spark, sf)
    plain = F.col("config").isin([c for c in REPORT_CONFIGS if not CATALOGUE[c].factored])
    return enc.oov_after_decoding(prof.decoded().filter(plain), prof.vocabulary.vocab)


@query
def roundtrip_classes(spark, sf):
    return _profile(spark, sf).roundtrip()


# --- packing metrics ---------------------------------------------------------

@query
def train_char_ratio(spark, sf):
    df = pk.char_ratio(b.doc_sizes(_text(spark, sf)))
    return df.withColumn("char_ratio", r6("char_ratio"))


@query
def step_accounting(spark, sf):
    df = pk.step_accounting(pk.char_ratio(b.doc_sizes(_text(spark, sf))), CONTEXT, BATCH)
    return df.withColumns({"char_ratio": r6("char_ratio"), "pass_chars": F.round("pass_chars", 3)})


@query
def unigram_ppl(spark, sf):
    docs = _text(spark, sf)
    counts = b.split_counts(docs, ["split"])
    ratios = pk.char_ratio(b.doc_sizes(b.train(docs), ["split"]), ("label",))
    df = pk.unigram_losses(counts, ratios)
    return df.select("label", "tokens", *[r6(c).alias(c) for c in
                                          ("loss", "char_ratio", "ppl_token", "ppl_char")])


# --- cross-seed reports ------------------------------------------------------

def _sweep_rows(spark, sf):
    """Run results with the unigram model standing in for the trained one."""
    docs = _text(spark, sf)
    sizes = b.doc_sizes(docs).withColumn("seed", F.pmod("doc_id", F.lit(b.SHARDS)))
    keys = ("label", "config", "seed")
    ratios = pk.char_ratio(sizes, keys)
    counts = b.split_counts(docs.withColumn("seed", F.pmod("doc_id", F.lit(b.SHARDS))), b.PLAIN, ("label", "seed"))
    ppl = pk.unigram_losses(counts.withColumnRenamed("pre_tokenizer", "config"), ratios, keys).withColumn(
        "vocab_size", F.col("types") + 5)
    seconds = F.lit(60.0)
    return ratios.join(ppl.drop("tokens", "char_ratio"), list(keys)).filter(F.col("types") > 0).select(
        F.col("label").alias("dataset"), "config", "seed", "vocab_size",
        F.col("char_ratio").alias("char_to_token_ratio"),
        (F.col("tokens") / seconds).alias("tokens_per_sec"), (F.col("chars") / seconds).alias("chars_per_sec"),
        F.col("loss").alias("final_val_loss"), F.col("ppl_token").alias("final_ppl_token"),
        F.col("ppl_char").alias("final_ppl_char"))


@query
def sweep_report(spark, sf):
    rows = written(_sweep_rows(spark, sf), "sweep")     # a few a run; the report reads them four times
    return reports.sweep_report(rows).withColumn("ord", F.col("ord").cast("bigint"))


@query
def generation_report(spark, sf):
    scored = b.generation_results(spark, sf)
    rows = gen.summary(scored).join(gen.coherent_throughput(scored), "run")
    rows = rows.select(F.lit("conversations").alias("dataset"), F.lit("split").alias("config"),
                       F.col("run").alias("seed"), *rows.columns[1:])
    lines = reports.generation_report(rows, "Coherence (1 - Repetition) (%)")
    return lines.withColumn("ord", F.col("ord").cast("bigint"))
