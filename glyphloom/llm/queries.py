"""One registered query per operator, each over its whole table; ``oracles`` has SQL where SQL can say the same."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm import bpe_fold, merkle, minmax, mixing, periodic, pii, pitman_yor, ppm, substrings, topk, toxicity, vptree, warc
from glyphloom.llm.frames import remainder, table
from glyphloom.session import work_dir

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnable = F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0
    sample = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic",
                                      toxicity.Settings.rows, learnable)
    scores = toxicity.scored(docs, toxicity.fit(sample))
    return scores.select("doc_id", (F.coalesce(remainder("doc_id", 5), F.lit(-1)) == 0).alias("held_out"),
                         "score", "predicted")


@query
def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "warc")
    warc.archived(table(spark, sf_dir, "pages"), path)
    return warc.verified_at(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


@query
def op4_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest_neighbours(table(spark, sf_dir, "embeddings"))


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def public_codec(vocabulary: str = VOCABULARY) -> bpe_fold.Codec:
    """Codec of a public byte-level vocabulary, read where the tokenizer files are installed."""
    import public_tokenizers

    return bpe_fold.Codec(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = public_codec()
    encoded = codec.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False,
                            decode="decoded")
    return bpe_fold.digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = mixing.mixed(docs, table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "n_tokens", "domain", "posterior", "rate")


@query
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 5), F.lit(-1)) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", (~held_out).alias("train"), "text")
    return pitman_yor.scored(docs).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                          "base_score", "score")


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.col("n_chars") + F.when(remainder("doc_id", 7) == 0, 1).otherwise(0)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf(*(changed if c == "n_chars" else F.col(c) for c in fields))
    rows = merkle.manifest(docs, "doc_id", "lang", merkle.leaf(*map(F.col, fields)), {"_tampered": tampered})
    rows = rows.withColumn("folded_root", merkle.folded(F.col("_tampered"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the texts made periodic from some word on, as the contract of op13 has it; the others as they are."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    df = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    df = df.withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    a = F.when(n > 0, g % n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    df = df.withColumn("_a", a.cast("int")).withColumn("_p", p.cast("int"))
    source = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", F.when(
        i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    text = F.when(n > 0, F.array_join(source, " ")).otherwise(F.col("text"))
    return df.select("doc_id", text.alias("text"))


@query
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("later"), (-r["period"]).alias("longer"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_most", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_most.later")).alias("start"),
        F.col("_most.length").alias("length"), (-F.col("_most.longer")).alias("period"),
        F.floor(1000 * F.col("_most.length") / -F.col("_most.longer")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op11_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.coalesce(remainder("doc_id", 3), F.lit(-1)) == 1
    model = ppm.fit(ppm.sample(docs, "lang", ppm.Settings.rows, ~held_out))
    found = ppm.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
