"""Style: nothing is tokenised or scored twice, and the shorter ways find the same."""

from pyspark.sql import functions as F

from inkspan.functions.text import tokens
from inkspan.operators import stylometry


def test_a_text_of_one_window_is_scored_once(spark, monkeypatch):
    seen = []
    score = stylometry.single_pass
    monkeypatch.setattr(stylometry, "single_pass", lambda units, *a, **k: (seen.append(units), score(units, *a, **k))[1])
    rows = [(1, "word " * 219 + "end."), (2, "word " * 400), (3, "")]
    prepared = spark.createDataFrame([(i, "en", t.strip(), 0, 0, 0) for i, t in rows], "doc_id int, lang string, text string, code_words int, quoted_words int, reference_words int")
    got = {r.doc_id: r for r in stylometry.judged(prepared).collect()}
    assert {i: r.windows for i, r in got.items()} == {1: 1, 2: 3, 3: 0}
    assert (got[1].segments[0]["index"], got[1].segments[0].end_word, got[1].segments[0].score) == (0, 220, got[1].probability)
    assert seen[0].count() == 1 + 4 + 1  # the first was two units


def test_runs_of_token_characters_are_the_tokens(spark):
    texts = [("It's a well-known İstanbul ΟΔΟΣ, Σ.",), ("п'ять -- 'ab' abćd 𝒳𝒴𝒵 １２３",), ("",), ("a bb ccc d_d_d eee_fff",), ("Ǆab ﬁre ªbc x²y³z",)]
    for r in spark.createDataFrame(texts, "t string").select(stylometry.token_runs(F.col("t")).alias("a"), tokens(F.col("t"), True).alias("b")).collect():
        assert r.a == r.b


def test_repeated_runs_are_counted(spark):
    cases = [([], 0), (list("abc"), 0), (list("abcd"), 0), (list("abcdabcd"), 1), (list("aaaaaaa"), 3), (list("abcdefg"), 0)]
    got = spark.createDataFrame([(c,) for c, _ in cases], "c array<string>").select(stylometry.repeated_grams(F.col("c"))).collect()
    assert [r[0] for r in got] == [n for _, n in cases]
