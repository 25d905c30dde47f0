"""What a query costs: texts are searched and moved no more than their rows need."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.operators import corpus, language, rewrite, stylometry
from inkspan.plans import registry

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def steps(df):
    df._jdf.queryExecution().executedPlan()
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_white_space_is_that_of_the_standard(spark):
    every = spark.range(0x10000).where("id < 55296 OR id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    unlike = every.where(F.col("c").rlike("^" + T.WS + "$") != F.col("c").rlike("^" + T.BLANK + "$")).count()
    negated = every.where(F.col("c").rlike("^" + T.WS + "$") == F.col("c").rlike("^[^" + T.BLANK[1:] + "$")).count()
    assert unlike == negated == 0 and T.BLANK != T.WS
    texts = [("a  b",), (" a\n\n b ",), ("a b  c",), ("﻿",), ("a   b",), ("a b",), (None,), ("",), ("\t\ta\x0b",)]
    got = spark.createDataFrame(texts, "t string").select(T.normalize_ws(F.col("t")), T.count_words(F.col("t")), T.count_normal(T.normalize_ws(F.col("t"))))
    for (t,), r in zip(texts, got.collect()):
        w = [x for x in "".join(" " if c in T.BLANKS else c for c in t or "").split(" ") if x]
        assert tuple(r) == (" ".join(w), len(w), len(w)), t


def test_modes_shuffle_no_texts(spark):
    p = steps(registry.document_modes(spark, SMALL))
    assert "Join" not in p  # texts were joined to the counts of their chunks
    made = registry.document_modes(spark, SMALL).count()
    assert made == registry.text_chunks(spark, SMALL).select("doc_id").distinct().count()


def test_an_index_is_made_and_read_beside_its_text(spark):
    d = spark.createDataFrame([(1, "b a  b\nc a"), (2, " "), (3, None), (4, "x"), (4, "y x y")], "doc_id int, text string")
    i = corpus.word_index(d)
    assert "Exchange" not in steps(corpus.text_of_index(i).select("doc_id", "text")).replace("RoundRobin", "")
    assert sorted((r.doc_id, sorted(r.places.items())) for r in i.collect()) == [(1, [("a", [1, 4]), ("b", [0, 2]), ("c", [3])]), (4, [("x", [0])]), (4, [("x", [1]), ("y", [0, 2])])]
    # rows of one id stay apart, as in SQL
    assert sorted(map(tuple, corpus.text_of_index(i).collect())) == [(1, "b a b c a"), (4, "x"), (4, "y x y")]
    loose = spark.createDataFrame([(7, {"v": [2], "u": [0, 1]}), (8, {}), (9, None)], "doc_id int, places map<string,array<int>>")
    assert [tuple(r) for r in corpus.text_of_index(loose).collect()] == [(7, "u u v")]


def test_trigrams_are_counted_in_parts(monkeypatch):
    import pyarrow as pa

    text = " " + "шум und größe ab " * 40
    whole = language.trigrams(text)
    monkeypatch.setattr(language, "PART", 50)
    sizes, merged = [], language.merged
    monkeypatch.setattr(language, "merged", lambda found: sizes.append(sum(len(g) for g, _ in found)) or merged(found))
    for a, b in zip(whole, language.trigrams(text)):
        assert np.array_equal(a, b)
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"] * 60), pa.array([text] * 120)], ["lang", "t"])
    out = list(language._counts(iter([batch])))
    assert [(b.column(0)[0].as_py(), b.column(2).to_pylist()) for b in out] == [(n, [60 * int(c) for c in whole[1]]) for n in "xy"]
    assert max(sizes) <= 50 + 2 * len(whole[0])  # all texts of a batch were held at once


def test_rules_are_tried_only_where_they_can_match(spark):
    d = spark.createDataFrame([(1, "Certainly! It is robust. " + "plain words of a text that go on " * 4), (2, "word " * 25)], "doc_id int, text string")
    r = rewrite.rewrite(d)
    p = plan(r)
    assert 'Contains(' in p or "contains" in p.lower()
    assert [(x.doc_id, [tuple(c) for c in x.changes]) for x in r.orderBy("doc_id").collect()] == [(1, [("chat", 1), ("adverts", 1)]), (2, [])]


@pytest.mark.parametrize("text,rules", [
    # a pattern's words come about only through an earlier rule: marks within a word, or an expression replaced
    ("Пишемо **дан**ий текст. " + "слово " * 25, [("format", 2), ("synonyms", 1)]),
    ("Слово. Отже, далі. " + "слово " * 25, [("transitions", 1)]),
    ("КРИТИЧНО ВАЖЛИВИЙ КОМПЛЕКСНИЙ ПІДХІД " + "слово " * 25, [("adjectives", 1)]),
])
def test_rules_see_what_earlier_ones_made(spark, text, rules):
    r = rewrite.rewrite(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [tuple(c) for c in r.changes] == rules


def test_a_sentence_key_is_one_space_between_words(spark):
    s = "  Ab-12,  cd «éF» 3.  x's"
    assert one(spark, rewrite.sentence_key(F.lit(s))) == "ab # cd éf # x s"


def test_texts_are_parted_once_for_style(spark):
    d = spark.createDataFrame([(1, "I wrote this. Вступ! Висновки. " + "Plain words here. " * 20)], "doc_id int, text string")
    s = stylometry.single_pass(d)
    assert plan(s).count("]_]+") + plan(s).count("]]_]+") <= 2 and "[^\\p{L}\\p{N}_]+" not in plan(s)
    assert s.first().word_count > 60


def test_cyrillic_strings_are_looked_for_in_cyrillic_texts(spark):
    rows = [("plain",), ("größe",), ("слово",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.cyrillic(F.col("t"))).collect()]
    assert got == ["", "", "слово", ""]
    low = spark.createDataFrame([("таким чином",), ("in conclusion",), ("größe",)], "t string")
    p = "in conclusion|таким чином"
    assert [r[0] for r in low.select(T.may_match(F.col("t"), p, T.cyrillic(F.col("t")))).collect()] == [True, True, False]


def test_lengths_need_no_chunks(spark):
    from inkspan.operators import search
    from inkspan.operators.sequence import Settings, chunks

    rows = [(k, "w " * n) for k, n in enumerate([0, 1, 80, 81, 2000, 2001, 5001, 9000])] + [(7, "w " * 30), (20, None), (21, " \n"), (None, "a b")]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    for s in (Settings(), Settings(300, 100, "deep")):
        cut = search.modes(d, chunks(d, s), s.sensitivity == "deep")
        assert sorted(map(tuple, search.planned_modes(d, s).collect())) == sorted(map(tuple, cut.collect()))
        assert "Join" not in plan(search.planned_modes(d, s)) and "Generate" not in plan(search.planned_modes(d, s))


def test_bare_words_keep_their_places(spark):
    from inkspan.operators import probe

    s = "«Ab» — x-1 it's !! É2."
    assert one(spark, probe.bare_words(F.lit(s))) == ["Ab", "", "x-1", "it's", "", "É2"] == [one(spark, probe.bare(F.lit(w))) for w in s.split(" ")]
