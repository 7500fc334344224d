"""Session defaults and the shared working folder."""

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", memory: str = "12g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster, bring your own."""
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("glyphloom")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="glyphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage in a way that survives lost executors, and computes the
    input once where ``checkpoint()`` would compute it twice.
    """
    return written_at(df, work_dir(df.sparkSession, name))


def written_at(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """As ``written``; tables of large blobs are best written ``uncompressed``, as a codec's buffers lie beside the heap."""
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table this session wrote and no longer reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-side list as a table whose size the optimizer knows."""
    return small_tables(spark, [rows], schema)


def small_tables(spark: SparkSession, lists: Iterable[list[tuple]], schema: str) -> DataFrame:
    """As ``small_table``, of lists that are made one after the other: only one at a time is held as Python objects."""
    fields = StructType.fromDDL(schema)
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    tables = [pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[] for _ in fields], types)], names=names)
              for rows in lists]
    arrow = pa.concat_tables(tables or [pa.table([pa.array([], kind) for kind in types], names=names)]).combine_chunks()
    return spark.createDataFrame(arrow, fields)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when the scan yields fewer splits than cores; else do nothing.

    A large corpus has far more splits than cores and is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
