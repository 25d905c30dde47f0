"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that a Python worker works on at once. What Spark sends it is bounded by spark.sql.execution.arrow.maxBytesPerBatch.
BATCH_BYTES = 4 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null.

    `lower` has a byte-wise path for texts that are ASCII throughout; only the others pay for `translate`.
    """
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back: a lost executor never recomputes beyond this point."""
    path = scratch(session(df), name)
    df.write.parquet(path)
    return session(df).read.schema(df.schema).parquet(path)


def batches_by_bytes(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined or split so that their texts (`column`) hold about `most` bytes; a longer text comes alone."""
    held, size = [], 0

    def whole() -> pa.RecordBatch:
        if len(held) == 1 and not held[0].column(column).offset:
            return held[0]
        # copied, also if it is one slice: kernels then see arrays that begin at their buffers' start
        return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in held]) if len(held) > 1 else held[0].column(k).take(pa.array(range(held[0].num_rows))) for k in range(held[0].num_columns)], schema=held[0].schema)

    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        a = 0
        for k, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                if a < k:
                    held.append(b.slice(a, k - a))
                yield whole()
                held, size, a = [], 0, k
            size += n
        if a < b.num_rows:
            held.append(b.slice(a))
    if held:
        yield whole()


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores behind it until no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
