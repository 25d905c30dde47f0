"""Reports of a stream are stored once, whatever runs again."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from inkspan.streaming import reports

SCHEMA = "doc_id long, checked_at timestamp, plagiarism_score int"
T = dt.datetime(2024, 5, 1, 12)


def rows(first, n, days=0):
    return [(k, T + dt.timedelta(days=days, minutes=k), k % 100) for k in range(first, first + n)]


def test_batches_that_run_again_leave_nothing_twice(spark, tmp_path):
    src, path, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for part in (rows(0, 40), rows(40, 25, days=1)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        reports.store(spark.readStream.schema(SCHEMA).parquet(src), path, mark).awaitTermination(120)
    ids = lambda **how: sorted(r.doc_id for r in reports.stored(spark, path, SCHEMA, **how).collect())
    assert ids() == list(range(65))
    # the last batch's end is forgotten, as if the driver had been lost before it was noted: it runs again
    last = max((f for f in os.listdir(f"{mark}/commits") if f.isdigit()), key=int)
    for f in (f"{mark}/commits/{last}", f"{mark}/commits/.{last}.crc"):
        if os.path.exists(f):
            os.remove(f)
    reports.store(spark.readStream.schema(SCHEMA).parquet(src), path, mark).awaitTermination(120)
    assert ids() == list(range(65)) and {(r.batch, r.rows) for r in reports.committed(spark, path).collect()} == {(0, 40), (1, 25)}
    assert ids(today=dt.date(2024, 6, 1)) == list(range(40, 65))


def test_half_written_batches_do_not_count_and_days_go(spark, tmp_path):
    path = str(tmp_path / "out")
    assert reports.committed(spark, path).count() == 0
    reports.write_batch(spark.createDataFrame(rows(0, 10) + rows(10, 5, days=40), SCHEMA), 0, path)
    reports.write_batch(spark.createDataFrame([], SCHEMA), 1, path)
    # data of a batch whose entry is missing, and an entry that isn't whole
    half = spark.createDataFrame(rows(100, 7), SCHEMA).withColumn("day", F.to_date("checked_at"))
    half.write.partitionBy("day").parquet(f"{path}/data/batch=2")
    os.makedirs(f"{path}/commits/3")
    assert reports.stored(spark, path, SCHEMA).count() == 15
    assert reports.drop_old(spark, path, dt.date(2024, 6, 20)) == 1
    assert sorted(r.doc_id for r in reports.stored(spark, path, SCHEMA).collect()) == list(range(10, 15))
    assert not glob.glob(f"{path}/data/batch=0/day=2024-05-01/*")
