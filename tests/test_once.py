"""Work that is done once: plans that don't repeat a step, rows that are dealt out evenly."""

from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.operators import prep, probe, report, stylometry
from inkspan.plans import registry
from inkspan.sources.tables import TURNS, spread

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_report_signals_judge_each_text_once(spark):
    d = spark.createDataFrame([(1, "Plain words about rivers. " * 90, "en")], "doc_id int, text string, lang string")
    assert plan(stylometry.report_signals(d)).count("monotonically_increasing_id") == 1


def test_few_row_groups_are_dealt_out(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    sizes = spread(spark.read.parquet(str(tmp_path / "t"))).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) >= TURNS * 4 and max(r["count"] for r in sizes) < 2 * 5000 / len(sizes)
    assert "Repartition" in plan(registry.document_texts(spark, SMALL))


def test_ranked_matches_are_made_once_for_a_report(spark):
    assert plan(registry.scan_reports(spark, SMALL)).count("row_number()") == 1  # that of the confirmed score


def test_white_space_at_the_ends_alone_is_trimmed(spark):
    # the next-line character is no white space of the standard, and what stands before it is not at the end
    rows = [("a \u0085",), ("  a b﻿\n",), (" \t",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.trim_ws(F.col("t"))).collect()]
    assert got == ["a \u0085", "a b", "", "", None]


def test_a_line_is_trimmed_once(spark):
    d = spark.createDataFrame([("x = 1;",)], "t string").select(prep.code_line(F.col("t")))
    assert plan(d).count("trim(") == 1


def test_a_chunk_is_parted_into_words_once(spark):
    d = spark.createDataFrame([(1, 0, "some words of a chunk")], "doc_id int, chunk_index int, chunk_text string")
    assert plan(probe.search_queries(d).select("doc_id", "query")).count("\\x{1680}") <= plan(d.select(T.words(F.col("chunk_text")))).count("\\x{1680}")


def test_rerank_ranks_what_tiles_leave(spark, monkeypatch):
    import random

    from inkspan.operators import corpus

    rng = random.Random(4)
    monkeypatch.setattr(corpus, "TILE", 40)
    monkeypatch.setattr(corpus, "BLOCK", 3)
    rows = [(k, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for k in range(200)] + [(300, None), (301, [1.0, None, 2.0, 3.0]), (302, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 20 = 0 OR vec_id > 300").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = corpus.rerank(v, q, 5)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString() and "near" in plan(found)
    got = {(r.query_id, r["rank"]): r.vec_id for r in found.collect()}
    cos = lambda a, b: None if not a or not b or len(a) != len(b) or None in a or None in b else sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    for k, a in rows:
        if k % 20 == 0 or k > 300:
            each = [(i, cos(b, a)) for i, b in rows]
            best = sorted(each, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:5]
            told = [got[k, r] for r in range(1, 6)]
            near = dict(each)
            assert [near[i] is None for i in told] == [c is None for _, c in best]
            assert all(c is None and i == j or c is not None and abs(near[i] - c) < 1e-12 for i, (j, c) in zip(told, best))
