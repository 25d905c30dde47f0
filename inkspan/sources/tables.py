"""Results kept as tables, for plans that use them several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def kept_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share; a temporary one only for a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back, until the application ends; what uses it, or is lost, never computes it again."""
    spark = df.sparkSession
    path = f"{kept_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, *counters: Column) -> tuple[DataFrame, dict]:
    """`df` kept, and counters of its rows, taken while it is written: no second pass."""
    seen = Observation(name)
    out = kept(df.observe(seen, *counters), name)
    return out, seen.get


#: Tasks for each core that rows are dealt out over, at least.
TURNS = 4


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out evenly over all cores: a file's splits needn't hold equally many rows, and a split without a row group holds none."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TURNS * spark.sparkContext.defaultParallelism))
