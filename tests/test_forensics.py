import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.operators import align, corpus, match, prep, rewrite, state, stylometry
from inkspan.operators.sequence import Settings, analysis_windows, chunks, winnow
from inkspan.sources.files import html_text


def fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_hash_of_latin_and_cyrillic(spark):
    assert one(spark, "hello", T.stable_hash) == 1335831723
    assert one(spark, "жук", T.stable_hash) == 1943803020


@pytest.mark.parametrize("n", [0, 1, 4, 5, 7, 8, 9])
def test_winnow_against_python(spark, n):
    toks = [f"word{k}" for k in range(n)]
    h = [fnv(" ".join(toks[i : i + 5])) for i in range(n - 4)]
    w = min(4, len(h))
    want = {min(h[i : i + w]) for i in range(len(h) - w + 1)} if h else set()
    assert set(one(spark, " ".join(toks), lambda c: winnow(T.tokens(c, True)))) == want


def test_white_space_of_the_standard(spark):
    assert one(spark, "a b﻿c d", T.normalize_ws) == "a b c d"
    assert one(spark, " \n", T.count_words) == 0


@pytest.mark.parametrize("n,starts", [(219, [1]), (220, [1]), (221, [1, 2]), (385, [1, 166]), (386, [1, 166, 167])])
def test_windows_end_with_the_text(spark, n, starts):
    d = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(n)))], "doc_id int, text string")
    rows = analysis_windows(d).orderBy("window_index").collect()
    assert [r.start_word for r in rows] == starts and rows[-1].end_word == n


def test_chunks_reach_the_last_word(spark):
    d = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(420)))], "doc_id int, text string")
    rows = chunks(d, Settings(100, 20)).orderBy("chunk_index").collect()
    assert len(rows) > 3 and rows[-1].chunk_text.endswith("w419")


def runs_of(spark, pairs):
    d = spark.createDataFrame([(k, s, c) for k, (s, c) in enumerate(pairs)], "k int, s array<string>, c array<string>")
    got = d.select("k", match.common_run(F.col("s"), F.col("c")).alias("r")).select("k", "r.*").collect()
    return [(r.longest_run, r.run_start, r.candidate_start) for r in sorted(got, key=lambda r: r.k)]


def test_longest_run_takes_the_first_of_equal_ones(spark):
    assert runs_of(spark, [("a b c x a b c d".split(), "z a b c d a b".split()), ([], ["a"]), (["a"], ["b"]), (["a"], ["b", "a"])]) == [(4, 4, 1), (0, None, None), (0, None, None), (1, 0, 1)]


def test_longest_run_against_all_starts(spark):
    import random

    r = random.Random(8)

    def plain(s, c):
        best = (0, None, None)
        for i in range(len(s)):
            for j in range(len(c)):
                n = 0
                while i + n < len(s) and j + n < len(c) and s[i + n] == c[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        return best

    # few different tokens, so that nearly all repeat, and one token alone
    pairs = [([r.choice("abc"[: 1 + k % 3]) for _ in range(r.randrange(40))], [r.choice("abc"[: 1 + k % 3]) for _ in range(r.randrange(70))]) for k in range(80)]
    assert runs_of(spark, pairs) == [plain(s, c) for s, c in pairs]


def test_rows_of_one_url_and_of_one_id_are_scored_apart(spark):
    words = [f"word{k}" for k in range(60)]
    text, other = " ".join(words), " ".join(words[30:50][::-1] + [f"else{k}" for k in range(40)])
    schema = "title string, url string, snippet string, source_text string"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    one = [("t", "u", "s", " ".join(words[10:30] + [f"new{k}" for k in range(20)]))]
    facts = lambda d, rows: [(r.doc_id, r.url, r.score, r.longest_run, r["rank"]) for r in match.reuse(d, spark.createDataFrame(rows, schema)).collect()]
    alone = facts(docs, one)
    assert alone[0][3] == 20
    assert facts(docs, one * 3) == facts(docs, [*one, ("t", "u", "s", other)]) == facts(docs.union(docs), one) == alone
    two = docs.union(spark.createDataFrame([(1, other)], "doc_id int, text string"))
    assert facts(two, one) == alone


def test_a_shuffled_index_finds_the_same_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(match, "COMMON", 5)
    r = random.Random(6)
    common = "every page of this site ends with these very words".split()
    items = [[f"w{r.randrange(3000)}" for _ in range(50)] + common for _ in range(40)]
    docs = [(j, " ".join(x if k % (3 + j % 4) else f"new{k}" for k, x in enumerate(t))) for j, t in enumerate(items)] + [(k, " ".join([*common, *(f"d{k}v{j}" for j in range(60))])) for k in range(100, 160)]
    corpus = spark.createDataFrame([("t", f"u{j}", "s", " ".join(t)) for j, t in enumerate(items)], "title string, url string, snippet string, source_text string")
    parts = chunks(spark.createDataFrame(docs, "doc_id int, text string"))
    found = [match.possible_pairs(parts, corpus, Settings(), slight=n) for n in (10**6, 0)]
    small, large = ({(x.doc_id, x.chunk_index, x.url) for x in f.collect()} for f in found)
    assert small and small <= large and len({d for d, _, _ in large}) >= 40


def test_copied_passage_in_noise(spark):
    sentence = "the quiet harbour town built several long wooden piers before winter storms arrived from northern waters again"
    noise = " ".join(f"filler{k}" for k in range(60))
    docs = spark.createDataFrame([(1, sentence)], "doc_id int, text string")
    corpus = spark.createDataFrame([("t", "u", "s", f"{noise} {sentence} {noise}")], "title string, url string, snippet string, source_text string")
    r = match.reuse(docs, corpus).first()
    assert r.longest_run >= 12 and r.hash_percent > 45 and r.score > 55 and r.confidence == "page"


def test_code_goes_and_prose_stays(spark):
    text = "Plain words stay here.\nconst a = f(1);\nlet b = 2;\nMore plain words."
    d = spark.createDataFrame([(1, text), (2, "one line => gone"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.text for r in prep.prose(d).collect()}
    assert got == {1: "Plain words stay here. More plain words.", 2: "", 3: ""}


def test_rewrite_rules(spark):
    body = "In order to win we utilize a robust plan. " + " ".join(f"word{k}" for k in range(20)) + "."
    r = rewrite.rewrite(spark.createDataFrame([(1, body), (2, "short")], "doc_id int, text string")).collect()
    assert len(r) == 1 and r[0].revised.startswith("to win we utilize a stable plan.") and len(r[0].changes) == 2


def test_breaker_opens_and_closes(spark):
    t = dt.datetime(2024, 1, 1)
    log = [("p", t, 1, False), ("p", t, 2, False), ("p", t, 3, True), ("p", t + dt.timedelta(milliseconds=5001), 4, True)]
    d = spark.createDataFrame(log, "provider string, ts timestamp, seq long, ok boolean")
    assert [r.allowed for r in state.circuit_breaker(d, 2, 5.0).orderBy("seq").collect()] == [True, True, False, True]


def test_diff_gives_back_both_texts():
    a, b = "one two  three", "one 2 three four"
    parts = align.diff_parts(a, b)
    assert "".join(p["value"] for p in parts if p["kind"] != "added") == a and "".join(p["value"] for p in parts if p["kind"] != "removed") == b
    assert align.align_paragraphs(["a b c", "x y z"], ["x y q"]) == ["", "x y q"]


def test_short_texts_have_no_ngrams_and_no_repetition(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, "lone"), (4, "alpha beta gamma"), (5, "the and with that from this have are was were alpha beta gamma")], "k int, text string")
    assert [r[0] for r in d.select(T.ngrams(T.tokens(F.col("text")), 4)).collect()] == [[]] * 5
    got = {r.k: (r.lexical, r.probability) for r in stylometry.single_pass(d).collect()}
    assert got == {1: (100, 0), 2: (100, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}  # no tokens have a ratio of 0 in the reference, too


@pytest.mark.parametrize("how", ["quick", "balanced", "deep"])
def test_reuse_finds_what_scoring_all_pairs_finds(spark, how):
    import random

    r, stop = random.Random(3), T.STOP_WORDS[-12:]
    word = lambda share=0.25: r.choice(stop) if r.random() < share else f"w{r.randrange(4000)}x"
    items = [[word(0.25 * (j % 6 != 3)) for _ in range(48)] for j in range(24)]
    reworded = lambda t, k: [f"new{r.randrange(4000)}" if i % k == k - 1 else x for i, x in enumerate(t)]
    docs = [(j, " ".join(reworded(t, 2 + j % 6))) for j, t in enumerate(items)] + [(90, " ".join(word() for _ in range(48))), (91, ""), (92, "the and that"), (93, " ".join(items[0][5:16]))]
    docs = spark.createDataFrame(docs, "doc_id int, text string")
    texts = [("t", f"u{j}", "s", " ".join(t)) for j, t in enumerate(items)] + [("t", "short", " ".join(items[5]), "too short"), ("t", "none", " ".join(items[3]), None)]
    corpus = spark.createDataFrame(texts, "title string, url string, snippet string, source_text string")
    s = Settings(sensitivity=how)
    every = match.score_pairs(chunks(docs, s).crossJoin(corpus), ["doc_id", "chunk_index"])
    rows = lambda d: {(x.doc_id, x.url, x.score, x.longest_run) for x in d.collect()}
    want = rows(match.ranked_matches(match.unique_matches(every, "url"), s))
    assert rows(match.reuse(docs, corpus, s)) == want
    assert how == "quick" or any(run < 5 for _, _, _, run in want) and all((j, f"u{j}") in {x[:2] for x in want} for j in range(24) if j % 6 == 3)


def test_long_diff_gives_back_both_texts():
    a = " ".join(f"w{k % 900} of the" if k % 7 else f"rare{k}" for k in range(20_000))
    b = a.replace("rare7 ", "other ").replace("rare19999", "changed") + " end"
    b = b[:90_000] + b[90_400:]
    parts = align.diff_parts(a, b)
    assert "".join(p["value"] for p in parts if p["kind"] != "added") == a and "".join(p["value"] for p in parts if p["kind"] != "removed") == b
    assert len(parts) < 40 and sum(len(p["value"]) for p in parts if p["kind"] == "same") > len(a) - 1000
    assert align.diff_parts("", "x " * 40_000) == [{"value": "x " * 40_000, "kind": "added"}]


def test_long_pages_are_read_whole():
    page = "<script>" + "x = 1;" * 200_000 + "</script><p>" + "word " * 40_000 + "</p><p>the end & more"
    assert html_text(page) == "word " * 40_000 + "the end & more"


@pytest.mark.parametrize("block", [1000, 60])
def test_rerank_answers_every_query(spark, monkeypatch, block):
    monkeypatch.setattr(corpus, "BLOCK", block, raising=False)
    v = spark.createDataFrame([(k, [float(k % 17 + 1), float(k % 13), float(k)]) for k in range(150)], "vec_id long, embedding array<double>")
    got = corpus.rerank(v, v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 2).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(k, i) for k in range(150) for i in (1, 2)]
    assert all(r.cosine > 1 - 1e-9 for r in got if r["rank"] == 1)
