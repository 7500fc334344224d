"""Corpus scans: many tables, one shape ``(label, doc_id, text)``."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.functions import text as t
from glyphloom.session import spread

CORPUS_COLUMNS = ("label", "doc_id", "text")
PARTS = 1 << 20


@dataclass(frozen=True)
class CorpusSpec:
    """Where one corpus lives and which of its columns to read."""

    path: str
    text_column: str = "text"
    label: str | None = None            # a constant label ...
    label_column: str | None = None     # ... or a column that holds it
    id_column: str | None = "doc_id"    # None: position in the input files
    part_column: str | None = None      # numbers the rows of one id, from 0 to below PARTS
    format: str = "parquet"             # parquet, json or text
    options: tuple[tuple[str, str], ...] = ()


def scan(spark: SparkSession, spec: CorpusSpec) -> DataFrame:
    """Read one corpus; only the named columns reach the scan."""
    reader = spark.read.options(**dict(spec.options))
    df = reader.format(spec.format).load(spec.path)
    text_column = "value" if spec.format == "text" else spec.text_column
    label = F.col(spec.label_column) if spec.label_column else F.lit(spec.label)
    if spec.id_column and spec.format != "text":
        doc_id = F.col(spec.id_column).cast("bigint")
        if spec.part_column:
            doc_id = doc_id * PARTS + F.col(spec.part_column).cast("bigint")
    else:
        doc_id = F.monotonically_increasing_id()
    label = F.coalesce(label.cast("string"), F.lit(""))  # a label is a join key
    return df.select(label.alias("label"), doc_id.alias("doc_id"),
                     F.col(text_column).alias("text"))


def union(spark: SparkSession, specs: list[CorpusSpec]) -> DataFrame:
    """All corpora in one DataFrame, so that one job serves every label."""
    first, *rest = [scan(spark, s) for s in specs]
    for df in rest:
        first = first.unionByName(df)
    return first


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(t.is_nonblank(F.col(text)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as a corpus labelled by language."""
    spec = CorpusSpec(f"{sf_dir}/documents.parquet", label_column="lang")
    return spread(scan(spark, spec), "doc_id")


def all_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text-bearing table, each under its own label."""
    return union(spark, [
        CorpusSpec(f"{sf_dir}/documents.parquet", label="documents"),
        CorpusSpec(f"{sf_dir}/benchmark.parquet", label="benchmark", id_column="item_id"),
        CorpusSpec(f"{sf_dir}/pages.parquet", "html", label="pages", id_column="page_id"),
        CorpusSpec(f"{sf_dir}/conversations.parquet", label="conversations", id_column="conv_id",
                   part_column="turn"),
    ])


def is_validation(doc_id: Column) -> Column:
    """Held-out tenth of a table that ships without its own split."""
    return F.pmod(doc_id, F.lit(10)) == 9


def training_lines(df: DataFrame) -> DataFrame:
    """Vocabulary training reads a text file line by line, line ends included.

    Emulates "one document and a newline per record" without writing the file:
    each document becomes its lines, each still ending in its newline.
    """
    lines = F.split(F.concat("text", F.lit("\n")), r"(?<=\n)(?!\z)")
    return df.select("label", "doc_id", F.explode(lines).alias("text"))


def write_training_text(df: DataFrame, path: str) -> None:
    """Training corpus as text files, one document and a newline per record."""
    nonblank(df).select("text").write.option("lineSep", "\n").text(path)
