"""The corpus pipeline: five training-data operators over documents, one after the other.

Each stage takes all rows that its predecessor kept and gives documents with the
same columns; the last gives the encoded corpus. Stages are written as Parquet
and read again in between, by ``run`` in the shared folder.
"""

from pyspark.sql import DataFrame, SparkSession

from glyphloom.llm import bpe_fold, minmax, mixing, pii, toxicity
from glyphloom.llm.frames import guarded, table
from glyphloom.llm.queries import public_codec
from glyphloom.session import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on the labelled ones, scores below 0.5."""
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", toxicity.Settings.rows))
    return guarded(docs, ["doc_id", "text"], lambda d: toxicity.scored(d, model).where("predicted = 0"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 0.8 or more): its smallest id.

    Thirty bands miss a pair at the threshold with probability (1 - 0.8^4)^30 = 1e-7.
    """
    return minmax.kept(docs, minmax.Settings(hundredths=80, permutations=60))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; every document stays at least once."""
    return mixing.remixed(docs, table(spark, sf_dir, "labels"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    codec = public_codec()
    both = codec.encoded(docs.select("doc_id", "lang", "source", "text"), keep=False, decode="decoded")
    return bpe_fold.digests(both).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", without_toxic), ("minmax_dedup", without_near_copies), ("pii", without_personal_data),
          ("mixing", mixed), ("bpe", encoded)]

#: The stages learn models, sample seeds and merge by rank: nothing SQL can say; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the digests, without the ids themselves."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs.drop("ids")
