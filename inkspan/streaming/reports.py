"""A stream of reports written once: batches by their number, days as folders, a log of what is whole.

A batch goes to folders of its own number, which a replay overwrites, and counts once its entry is in the log; readers
see the batches in the log alone. So a batch that failed half way, or is run again, leaves nothing twice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkspan.operators.report import KEPT_DAYS

LOG = "commits"


def _path(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_batch(reports: DataFrame, batch: int, path: str) -> None:
    """Reports(checked_at, ...) of one batch; its entry in the log, with its days and rows, comes last and by itself."""
    spark = reports.sparkSession
    made = f"{path}/data/batch={batch}"
    reports.withColumn("day", F.to_date("checked_at")).write.mode("overwrite").partitionBy("day").parquet(made)
    # counted from what was written: a batch's rows needn't be computed again
    _, fs = _path(spark, made)
    days = spark.read.parquet(made).groupBy("day").agg(F.count(F.lit(1)).alias("rows")) if any(s.isDirectory() for s in fs.listStatus(_path(spark, made)[0])) else spark.createDataFrame([], "day date, rows long")
    days.select(F.lit(batch).cast("long").alias("batch"), "day", "rows").coalesce(1).write.mode("overwrite").parquet(f"{path}/{LOG}/{batch}")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, day, rows) of whole batches. A folder of the log without its success mark isn't one."""
    at, fs = _path(spark, f"{path}/{LOG}")
    empty = spark.createDataFrame([], "batch long, day date, rows long")
    if not fs.exists(at):
        return empty
    whole = [s.getPath().toString() for s in fs.listStatus(at) if fs.exists(_path(spark, s.getPath().toString() + "/_SUCCESS")[0])]
    return spark.read.schema("batch long, day date, rows long").parquet(*whole) if whole else empty


def stored(spark: SparkSession, path: str, schema: str, today: dt.date | None = None) -> DataFrame:
    """The reports of whole batches, with `today` those of the days that are kept; other folders are not read."""
    rows = spark.read.schema(f"{schema}, batch long, day date").option("basePath", f"{path}/data").parquet(f"{path}/data")
    rows = rows if today is None else rows.where(F.col("day") >= F.lit(today - dt.timedelta(days=KEPT_DAYS)))
    return rows.join(committed(spark, path).select("batch", "day"), ["batch", "day"], "left_semi").drop("batch")


def drop_old(spark: SparkSession, path: str, today: dt.date, days: int = KEPT_DAYS) -> int:
    """Delete the folders of days that are no longer kept; how many there were. Rows are neither read nor rewritten."""
    old = committed(spark, path).where(F.col("day") < F.lit(today - dt.timedelta(days=days))).collect()  # a row per batch and day
    gone = 0
    for r in old:
        at, fs = _path(spark, f"{path}/data/batch={r.batch}/day={r.day.isoformat()}")
        gone += bool(fs.delete(at, True))
    return gone


def store(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of reports(checked_at, ...), all that there is now."""
    return reports.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
