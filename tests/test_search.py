"""The search engine against all sources, language profiles against their definition, and the composed scan."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.operators import language, prep, report, scan, search, stylometry
from inkspan.operators.sequence import Settings, chunks

CORPUS = "title string, url string, snippet string, source_text string"


def split(text):
    return [t for t in re.split(r"[^a-zа-яіїєґ0-9]+", text.lower()) if t]


def plain_search(texts, queries, k):
    """Every source scored for every query."""
    held = {u: Counter(split(t)) for u, t in texts.items()}
    df = Counter(t for c in held.values() for t in c)
    out = {}
    for q in queries:
        terms = split(q)
        fits = lambda u: not q.startswith('"') or f" {' '.join(terms)} " in f" {' '.join(split(texts[u]))} "  # noqa: E731, B023
        score = {u: sum(round(math.log(1 + len(texts) / df[t]) * 1000) * c[t].bit_length() for t in set(terms) if t in c) for u, c in held.items()}
        best = sorted(((-s, u) for u, s in score.items() if s and fits(u)))[:k]
        out[q] = [(u, -s) for s, u in best]
    return out


@pytest.mark.parametrize("first", [1, 4])
def test_search_against_all_sources(spark, first, monkeypatch):
    monkeypatch.setattr(search, "FIRST_BLOCKS", first)
    monkeypatch.setattr(search.top_sources, "__defaults__", (first,))
    r = random.Random(4)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 300}"
    texts = {f"u{k:03}": " ".join(word() for _ in range(r.randrange(18, 90))) for k in range(120)}
    rows = [("t", u, "s", t) for u, t in texts.items()] + [("t", "u000#part", "zz", texts["u000"]), ("t", "u001/", "s", texts["u001"])]
    index = search.build(spark.createDataFrame(rows, CORPUS), block_sources=5)
    phrases = [" ".join(t.split()[j : j + n]) for t in list(texts.values())[:12] for j, n in ((0, 1), (3, 4), (5, 9))]
    queries = [f'"{p}"' for p in phrases] + [f'"{" ".join(reversed(p.split()))}"' for p in phrases[:6]] + [" ".join(word() for _ in range(n)) for n in (1, 3, 8, 8, 12)] + ["none of these", '"w1 unknown"', '"w1 w1 w1"', "", '""', "w1 w1 w2"]
    got = {}
    for x in search.search(index, spark.createDataFrame([(q,) for q in queries + queries[:9]], "query string"), 4).collect():
        got.setdefault(x.query, []).append((x["rank"], x.source, x.score))
    got = {q: [(u, s) for _, u, s in sorted(v)] for q, v in got.items()}
    assert got == {q: v for q, v in plain_search(texts, queries, 4).items() if v}


def test_results_are_interleaved_and_limited(spark):
    rows = [("t", f"u{k}", "s", " ".join([f"only{k}x"] * (k + 1) + ["shared", "words", "of", "all", "sources"] + [f"pad{k}v{j}" for j in range(20)])) for k in range(9)]
    index = search.build(spark.createDataFrame(rows, CORPUS))
    asked = [(1, 0, 0, "shared words of all", 3), (1, 0, 1, "only7x only2x", 3), (1, 0, 2, '"of all sources"', 3), (1, 1, 0, "only7x", 3), (2, 0, 0, "nothing here", 8)]
    got = search.chunk_candidates(index, spark.createDataFrame(asked, "doc_id int, chunk_index int, place int, query string, search_limit int")).collect()
    by = {}
    for x in sorted(got, key=lambda x: (x.doc_id, x.chunk_index, x.place)):
        by.setdefault((x.doc_id, x.chunk_index), []).append(x.source)
    assert by == {(1, 0): ["u0", "u7", "u1"], (1, 1): ["u7"]}


def plain_rank(text):
    only = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    s = f" {only} " if only else ""
    return [g for g, _ in sorted(Counter(s[i : i + 3] for i in range(len(s) - 2)).items(), key=lambda x: (-x[1], x[0]))[:300]]


def test_languages_by_ranks(spark):
    r = random.Random(2)
    words = {"en": "the of and that with river house there over under".split(), "uk": "та що цей який річка будинок там над під мова".split(), "de": "der die und nicht ist über fluß häuser dort unter".split()}
    say = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n)) + r.choice(["", " 12!", "\n"])
    train = [(k, say(k, 60)) for k in words for _ in range(20)] + [(None, "zzz")]
    made = language.profiles(spark.createDataFrame(train, "lang string, text string"))
    counts = {k: Counter() for k in words}
    for k, t in train[:-1]:
        s = " " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " "
        counts[k].update(s[i : i + 3] for i in range(len(s) - 2))
    ranked = {k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:300]] for k, c in counts.items()}
    unpack = lambda g: "".join(chr(g >> s & (1 << 21) - 1) for s in (42, 21, 0))
    assert {k: [unpack(int(g)) for g in v] for k, v in made.items()} == ranked
    texts = [(k, say(k, n)) for k in words for n in (1, 3, 8, 30, 2000)] + [("none", ""), ("none", None), ("none", "12 34 !?")]
    far = spark.createDataFrame(texts, "lang string, text string").select("lang", "text", language.distances(F.col("text"), made).alias("far"))
    for x in far.collect():
        own = plain_rank(x.text or "")
        expected = [sum(abs(ranked[k].index(g) - i) if g in ranked[k] else 300 for i, g in enumerate(own)) for k in sorted(words)]
        assert x.far == (expected if own else None)
    found = language.identified(spark.createDataFrame(texts, "label string, text string"), made).collect()
    assert all(x.lang == x.label for x in found if x.label != "none" and len(x.text) > 20) and all(x.lang is None for x in found if x.label == "none")
    assert language.profiles(spark.createDataFrame([], "lang string, text string")) == {} and np.array_equal(np.sort(made["en"]), np.unique(made["en"]))


def test_style_needs_no_language_column(spark):
    en = "The river carries broken branches past the old stone bridge while people watch from wooden benches. "
    uk = "Річка несе зламані гілки повз старий кам'яний міст, а люди дивляться на неї з дерев'яних лавок біля води. "
    docs = spark.createDataFrame([(1, en * 12, "en"), (2, uk * 12, "uk"), (3, "", "en")], "doc_id int, text string, lang string")
    made = language.profiles(docs)
    key = lambda d: sorted((x.doc_id, x.probability, x.verdict, x.language, x.percent, x.level) for x in d.collect())
    assert key(stylometry.ensemble(docs.drop("lang"), profiles=made)) == key(stylometry.ensemble(docs))


def test_documents_are_scanned_as_prepared(spark):
    passage = "the quiet harbour town built several long wooden piers before winter storms arrived from northern waters again while gulls circled above empty boats"
    own = "and so we go on to see it all as far as one can tell of it by now " * 5
    code = "\n".join(f"const value{k} = compute(input{k});" for k in range(8))
    docs = [(1, f"{passage} {own}\n{code}\n", "en"), (2, "too short", "en"), (3, code * 3, "en"), (4, None, "en"), (5, f"{own[:300]} unlike anything else", "en")]
    corpus = spark.createDataFrame([("Harbours", "https://a.b/c", " ".join(passage.split()[:14]), None), ("Other", "https://d.e/f", "nothing of this kind is said in here at all today", None), ("", "https://g.h", passage, None)], CORPUS)
    pages = spark.createDataFrame([("https://a.b/c", f"before it {passage} and after it there is more text of the page")], "url string, text string")
    got = scan.scan_documents(spark.createDataFrame(docs, "doc_id int, text string, lang string"), corpus, pages)
    assert sorted((x.doc_id, x.gate) for x in got.refused.collect()) == [(2, "received"), (3, "prepared"), (4, "received")]
    c = got.counters
    assert (c["accepted"], c["refused"], c["matches"], c["verified"], c["unavailable"]) == (2, 1, 1, 1, 0) and c["chunks"] == 2 <= c["queries"] and c["candidates"] == 1
    hit = got.matches.collect()
    assert [(x.doc_id, x.url, x.confidence) for x in hit] == [(1, "https://a.b/c", "page")] and hit[0].longest_run >= 20
    notes = [x.note for x in sorted(got.notes.where("doc_id = 1").collect(), key=lambda x: x.place)]
    assert notes[0].startswith("Код автоматично вилучено з перевірки: ") and notes[1].startswith("Вебіндекси: local: ") and notes[2] == "Перевірка сторінок: підтверджено 1, недоступно 0, кеш-влучень 0, повторно не завантажувались 0."
    made = {x.doc_id: x for x in got.reports.collect()}
    assert set(made) == {1, 5} and made[1].n_confirmed == 1 and made[1].plagiarism_score == hit[0].score and "Harbours" in made[1].summary and made[5].n_matches == 0
    alone = stylometry.ensemble(prep.document_text(spark.createDataFrame(docs[:1], "doc_id int, text string, lang string"), "lang")).first()
    assert (made[1].probability, made[1].verdict) == (alone.probability, alone.verdict)


def test_modes_limit_queries_and_candidates(spark):
    docs = spark.createDataFrame([(1, "short words " * 60), (2, "longer words " * 1100), (3, "longest words " * 4100)], "doc_id int, text string")
    got = {x.doc_id: (x.long, x.very_long, x.search_limit, x.query_limit, x.page_limit) for x in search.modes(docs, chunks(docs), False).collect()}
    assert got == {1: (False, False, 8, None, 80), 2: (True, False, 4, 2, 48), 3: (True, True, 3, 1, 32)}
    d = spark.createDataFrame([(1, k) for k in range(30)], "doc_id int, f int")
    count = lambda deep, most: report.limited(d, ["doc_id"], ["f"], deep, F.lit(most)).count()
    assert [count(False, 50), count(True, 50), count(True, 5)] == [10, 18, 5] and Settings().threshold == 32


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_interleaving_in_blocks_of_any_size(spark, block):
    from inkspan.operators import corpus

    rows = [(g, p) for g, n in (("a", 50), ("b", 3), ("c", 21)) for p in range(1, n + 1)]
    got = {(r.g, r.p): r.place for r in corpus.interleave(spark.createDataFrame(rows, "g string, p int"), "g", "p", block=block).collect()}
    assert got == {r: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_nothing_is_scanned(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    got = scan.scan_documents(none("doc_id int, text string, lang string"), none(CORPUS), none("url string, text string"))
    assert got.reports.count() == got.matches.count() == got.notes.count() == 0 and set(got.counters.values()) == {0}
