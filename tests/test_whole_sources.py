"""Sources are compared to their end."""

import pytest

from inkspan.plans import registry

PASSAGE = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    filler = " ".join(f"filler{i}" for i in range(8500))
    spark.createDataFrame([(1, f"{PASSAGE} own{'x' * 3} words"), (2, "nothing of it here " * 9)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, f"{filler} {PASSAGE}"), (2, "some other item " * 8)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_a_passage_after_8000_tokens_is_matched(spark, tables):
    got = registry.reuse_matches(spark, tables)
    assert [(r.doc_id, r.url, r.longest_run, r.source_evidence) for r in got.collect()] == [(1, "item:1", 60, PASSAGE)]
    # the SQL takes over a minute for so long an item
    assert "8000" not in registry.oracle_sql()["reuse_matches"]


def test_a_passage_after_8000_tokens_is_scored(spark, tables):
    matched = registry.reuse_matches(spark, tables).first()
    assert [tuple(r) for r in registry.reuse_scores(spark, tables).collect()] == [(1, matched.score)] and matched.score > 90
    assert "8000" not in registry.oracle_sql()["reuse_scores"]
