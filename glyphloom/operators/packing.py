"""Sequence packing, next-token pairs, batches and count-based language-model metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.operators.metrics import ratio
from glyphloom.operators.ranking import with_position, with_prefix
from glyphloom.session import written

STREAM = ("label", "config")


def with_separator(encoded: DataFrame, sep: Column) -> DataFrame:
    """Close each document's ids with the separator."""
    return encoded.withColumn("ids", F.concat("ids", F.array(sep)))


def stream_offsets(encoded: DataFrame, by=STREAM, order: str = "doc_id") -> DataFrame:
    """Add ``start``, the position of the document's first id in the concatenated
    stream, and ``stream_size``.

    Only ``(by, doc_id, length)`` goes through the prefix sum, from a written
    table, as it is read three times; the ids stay put until the join on the
    document key.
    """
    sizes = written(encoded.select(*by, order, F.size("ids").alias("_len")), "sizes")
    starts = with_prefix(sizes, F.col("_len"), "start", order, by, "stream_size").drop("_len")
    return encoded.join(starts, [*by, order])


def pack(encoded: DataFrame, context: int, by=STREAM, order: str = "doc_id") -> DataFrame:
    """``(by, chunk_id, ids)``: the stream cut into full chunks of ``context`` ids.

    A chunk is kept while it starts before ``n - context``, so a final chunk that
    fits exactly is dropped. A document is cut at chunk borders where it lies, and
    only those slices are shuffled, to the chunk they belong to.
    """
    df = stream_offsets(encoded, by, order)
    size = F.size("ids")
    first = F.floor(F.col("start") / context)
    last = F.floor((F.col("start") + size - 1) / context)
    df = df.filter(size > 0).withColumn("chunk_id", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("chunk_id") * context - F.col("start"), F.lit(0)).cast("int")
    end = F.least((F.col("chunk_id") + 1) * context - F.col("start"), size).cast("int")
    df = df.withColumn("part", F.slice("ids", begin + 1, end - begin))
    df = df.withColumn("at", F.col("start") + begin)
    kept = df.filter(F.col("chunk_id") * context < F.col("stream_size") - context)
    return (kept.groupBy(*by, "chunk_id")
            .agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("w"))
            .select(*by, "chunk_id", F.flatten(F.col("w.part")).alias("ids")))


def next_token_pairs(chunks: DataFrame, by=STREAM) -> DataFrame:
    """``(by, chunk_id, pos, input, target)``: each id with the one that follows."""
    n = F.size("ids")
    pairs = F.arrays_zip(F.slice("ids", F.lit(1), n - 1).alias("input"),
                         F.slice("ids", F.lit(2), n - 1).alias("target"))
    return chunks.filter(n > 1).select(*by, "chunk_id", F.posexplode(pairs).alias("pos", "x")) \
                 .select(*by, "chunk_id", "pos", "x.input", "x.target")


def batches(chunks: DataFrame, batch: int, seed: int, by=STREAM, drop_last: bool = True) -> DataFrame:
    """Add ``batch_id`` by a seeded shuffle that any rerun repeats; chunks are packed once."""
    df = written(chunks.withColumn("_order", F.xxhash64("chunk_id", F.lit(seed))), "chunks")
    df = with_position(df, "_at", "_order", by, "_n").withColumn(
        "batch_id", F.floor(F.col("_at") / batch))
    if drop_last:
        df = df.filter(F.col("batch_id") < F.floor(F.col("_n") / batch))
    return df.drop("_order", "_at", "_n")


def char_ratio(docs: DataFrame, by=STREAM) -> DataFrame:
    """Characters and tokens per stream, each document closed by one separator."""
    df = docs.groupBy(*by).agg(F.sum(F.col("n_chars") + 1).alias("chars"),
                               F.sum(F.col("n_tokens") + 1).alias("tokens"))
    return df.withColumn("char_ratio", ratio(F.col("chars"), F.col("tokens")))


def step_accounting(ratios: DataFrame, context: int, batch: int) -> DataFrame:
    """Chunks, steps, and the tokens and characters one pass of full batches sees."""
    chunks = F.greatest(F.ceil((F.col("tokens") - context) / context), F.lit(0))
    df = ratios.withColumn("chunks", chunks).withColumn("steps", F.floor(F.col("chunks") / batch))
    df = df.withColumn("step_tokens", F.lit(batch * (context - 1)).cast("bigint"))
    return df.withColumn("pass_tokens", F.col("steps") * F.col("step_tokens")).withColumn(
        "pass_chars", F.col("pass_tokens") * F.col("char_ratio"))


def unigram_perplexity(train: DataFrame, valid: DataFrame, ratios: DataFrame,
                       by=("label",), token: str = "piece") -> DataFrame:
    """Loss and perplexity of an add-one unigram model, from token counts.

    ``train`` and ``valid`` hold ``(by, token, n)``; the loss is the mean over
    validation tokens, and the character perplexity divides it by the training
    ratio of characters to tokens.
    """
    sizes = train.groupBy(*by).agg(F.sum("n").alias("_total"), F.count("*").alias("_types"))
    df = valid.join(train.select(*by, token, F.col("n").alias("_seen")), [*by, token], "left")
    df = df.join(sizes, list(by))
    # one further type stands for everything unseen
    p = (F.coalesce("_seen", F.lit(0)) + 1) / (F.col("_total") + F.col("_types") + 1)
    df = df.withColumn("_loss", -F.log(p) * F.col("n"))
    out = df.groupBy(*by).agg(F.sum("n").alias("tokens"), (F.sum("_loss") / F.sum("n")).alias("loss"))
    out = out.join(ratios.select(*by, "char_ratio"), list(by))
    return out.withColumn("ppl_token", F.exp("loss")).withColumn(
        "ppl_char", F.exp(F.when(F.col("char_ratio") > 0, F.col("loss") / F.col("char_ratio"))))


def unigram_losses(counts: DataFrame, ratios: DataFrame, by=("label",)) -> DataFrame:
    """``unigram_perplexity`` from rows that hold ``n_train`` and ``n_valid`` of a token: one aggregation, no join.

    What the model's size takes off every token is the same, so it is taken off the mean;
    ``types`` is the number of training tokens' kinds. Streams without validation tokens have no loss.
    """
    tokens = F.sum("n_valid")
    out = counts.groupBy(*by).agg(
        F.sum("n_train").alias("_total"), F.count_if(F.col("n_train") > 0).alias("types"), tokens.alias("tokens"),
        F.sum(F.log(F.col("n_train") + 1) * F.col("n_valid")).alias("_known"))
    out = out.withColumn("loss", F.when((F.col("tokens") > 0) & (F.col("types") > 0), F.log(
        F.col("_total") + F.col("types") + 1) - F.col("_known") / F.nullif("tokens", F.lit(0)))).drop("_total", "_known")
    out = out.join(ratios.select(*by, "char_ratio"), list(by))
    return out.withColumn("ppl_token", F.exp("loss")).withColumn(
        "ppl_char", F.exp(F.when(F.col("char_ratio") > 0, F.col("loss") / F.col("char_ratio"))))
