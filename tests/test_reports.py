import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.operators import align, corpus, prep, probe, report, rewrite, state, stylometry
from inkspan.sources import files, html
from inkspan.streaming import caches


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def table_of(n, m, gap, cost):
    """The edit table cell by cell."""
    c = [[(i + j) * gap if not (i and j) else 0 for j in range(m + 1)] for i in range(n + 1)]
    way = [[3 if j else 2 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        way[i][0] = 2
        for j in range(1, m + 1):
            both, drop, add = c[i - 1][j - 1] + cost(i - 1, j - 1), c[i - 1][j] + gap, c[i][j - 1] + gap
            way[i][j] = 1 if both <= drop and both <= add else 2 if drop <= add else 3
            c[i][j] = {1: both, 2: drop, 3: add}[way[i][j]]
    return way


def test_directions_against_the_table():
    import numpy as np

    r = random.Random(2)
    for _ in range(60):
        n, m, gap = r.randrange(1, 12), r.randrange(1, 12), r.choice([1.0, 0.65])
        cost = np.array([[r.choice([0, 1, 2, 0.4]) for _ in range(m)] for _ in range(n)], float)
        got, want = align._directions(n, m, gap, lambda i, j: cost[i, j]), table_of(n, m, gap, lambda i, j: cost[i, j])
        assert all(got[i, j] == want[i][j] for i in range(n + 1) for j in range(m + 1) if i or j)


def test_revised_text_goes_to_its_parts():
    assert align.distribute(["The ", "quick", " brown fox."], "The quick red fox.") == ["The ", "quick", " red fox."]
    assert align.distribute(["a", "b"], "") == ["", ""] and align.distribute([], "x") == []
    assert align.align_tokens(["a", " ", "b"], ["a", "\t", "new", "b"]) == [0, 1, 1, 2]
    assert align.align_paragraphs(["one two three", "four five six"], ["one two three", "added here now", "four five seven"]) == ["one two three", "four five seven"]
    assert align.align_paragraphs(["one two", "three four"], ["three four"]) == ["", "three four"] and align.align_paragraphs([], ["x"]) == []


def test_html_keeps_its_marks():
    src = '<h1 class="t">Title</h1><p>Plain <strong>bold words</strong> end &amp; more.<p>Second one<br>here</p>'
    assert html.rich_text(src) == "Title\n\nPlain bold words end & more.\n\nSecond one\nhere"
    out = html.merged(src, "Title\n\nPlain bold words stop & more.\n\nSecond one here")
    assert '<h1 class="t">Title</h1>' in out and "<strong>bold words</strong> stop &amp; more." in out
    assert html.merged(src, "Title").count("<p>") == 2 and "bold" not in html.merged(src, "Title") and html.merged(" ", "x") == ""
    assert html.only('<p onclick="x()">a <b style="q">b</b><script>evil()</script><i>c</i></p>') == "a <b>b</b><i>c</i>"


def test_html_of_plain_text(spark):
    assert one(spark, "a < b\nc\n\n\n d & e ", html.from_plain) == "<p>a &lt; b<br>c</p><p>d &amp; e</p>"
    assert one(spark, "my.file.docx", html.download_name) == "my.file-formatted.doc"
    page = one(spark, "<p>x</p>", lambda c: html.word_page(c, F.lit('a "t"')))
    assert "<title>a &quot;t&quot;</title>" in page and page.endswith("<body><p>x</p></body>\n</html>")


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>t</title><body>hello there</body></html>", "hello there"),
        ("<head><meta charset=x><style>p {}</style><p>no end of the head", "no end of the head"),
        ("<title>t</title>text <main>and <article>more", "text and moreand moremore"),
        ("<body><nav>menu<div>deep</nav>kept<form><p>asked</form> too", "kept too"),
        ("<ul><li>one<li>two</ul><svg><title>s</title><path/></svg><br/>x", "onetwox"),
    ],
)
def test_pages_with_tags_left_out(page, text):
    assert files.html_text(page) == text


def test_names_and_extracted_white_space(spark):
    name = "Звіт про роботу.docx"
    assert one(spark, name.encode().decode("latin-1"), T.repaired_name) == name
    assert [one(spark, x, T.repaired_name) for x in ("plain.txt", "Ð", "a\ufffd", "Ò.txt")] == ["plain.txt", "\ufffd", "a\ufffd", "\ufffd.txt"]
    assert one(spark, "a\u2009\u3000b\r\nc \u2028 d \n\n\n\n e\x85", T.extracted_text) == "a b\nc d\n\ne\x85"


def test_page_text_is_the_body_and_its_articles():
    src = "<html><head><title>no</title></head><body>top <nav>menu</nav><article>one <b>two</b></article><p>three</body></html>"
    assert files.html_text(src) == "top one twothreeone two"
    assert files.html_text(None) == "" and files.html_text("<p>a<script>b</script> c") == "a c"


def phrase_value(words):
    own = [w for w in (re.sub(r"[^\w'-]|_", "", x.lower()) for x in words) if w]
    n = max(1, len(own))
    return len(set(own)) / n * 10 + sum(len(w) >= 7 or any(c.isdigit() for c in w) for w in own) * 1.8 + sum(map(len, own)) / n


@pytest.mark.parametrize("deep", [False, True])
def test_probe_queries(spark, deep):
    r = random.Random(6)
    size, phrases, keys = probe.SHAPES[deep]
    for n in (0, 1, 8, 12, 40, 130):
        words = [r.choice(["ab", "Word", "telling1", "extraordinary", "it's,", "(x)"]) + r.choice("abcdefgh") for _ in range(n)]
        starts = range(0, max(0, n - size) + 1, max(5, size // 2))
        found = [(s, words[s : s + size]) for s in starts if len(words[s : s + size]) >= min(7, size)]
        best = [max((x for x in found if min(3, x[0] * 4 // max(1, n - size)) == b), key=lambda x: (phrase_value(x[1]), -x[0]), default=None) for b in range(4)]
        best = sorted((x for x in best if x), key=lambda x: -phrase_value(x[1]))
        exact = list({" ".join(x[1]).lower(): f'"{" ".join(x[1])}"' for x in reversed(best)}.values())[::-1]
        got = one(spark, " ".join(words), lambda c: probe.queries_of(c, deep)) or []
        assert got[: min(phrases, len(exact))] == sorted(exact[:phrases], key=got.index) and len(got) <= phrases + 2
        assert all(len(q.replace('"', "").strip()) > 20 for q in got) and (n >= 8 or len(got) <= 1)


def test_code_within_lines_and_blocks(spark):
    text = "Call console.log now.\n```\nx = 1\n```\nif (a) {\n}\nWords stay\nfooBar(1) is gone here"
    got = spark.createDataFrame([(1, text), (2, "\t"), (3, "```\nall code")], "doc_id int, text string")
    rows = {r.doc_id: r for r in prep.prose(got).collect()}
    assert rows[1].text == "Call now. Words stay is gone here" and rows[1].code_blocks == 2 and rows[1].code_words == 3 + 4 + 2
    assert (rows[2].text, rows[2].code_blocks, rows[3].text, rows[3].code_words) == ("", 0, "", 2)


def test_title_page_and_tail(spark):
    body = "Вступ " + "Авторський текст роботи описує предмет. " * 20
    text = "Міністерство освіти України\nУніверситет міста\nКафедра мов\nСтудентка групи\n" + body
    d = spark.createDataFrame([(1, text, "uk"), (2, body + "References. One, two, three four", "uk")], "doc_id int, text string, lang string")
    r = {x.doc_id: x for x in prep.document_text(d).collect()}
    assert r[1].text.startswith("Вступ") and r[1].skipped_title_words == 9 and r[2].skipped_title_words == 0
    a = {x.doc_id: x for x in prep.analysis_text(d).collect()}
    assert a[2].reference_words == 5 and not a[2].text.endswith("four")


def test_signals_rest_on_evidence(spark):
    text = "Moreover, the crucial method is robust. " * 12 + "It was 12 km in 2020. We cite [1]."
    d = spark.createDataFrame([(1, text), (2, "too short")], "doc_id int, text string")
    s = {r.label: r for r in stylometry.signals(d).collect()}
    own = {k: s[v] for k, v in stylometry.LABELS.items() if v in s}
    assert own["starts"].evidence == ["moreover the crucial (12x)"] and own["lexicon"].evidence == ["crucial", "robust"]
    assert own["rhythm"].evidence[:2] == ["5 слів", "5 слів"] and own["lexical"].evidence[1].endswith("(12x)") or own["lexical"].evidence[1].endswith("(11x)")
    assert own["safeguard"].place == max(r.place for r in s.values()) and own["safeguard"].evidence[0].startswith("1 посилань")
    assert [r.score for r in sorted(s.values(), key=lambda r: r.place)][:-1] == sorted((r.score for r in s.values() if r.category != "safeguard"), reverse=True)


def test_number_ends_at_a_word(spark):
    assert one(spark, "12abc 7 абв12 3,5 x12", lambda c: stylometry.matches(c, stylometry.NUMBER)) == 3


def test_languages(spark):
    rows = [("a b", "en"), ("word " * 20, "en"), ("слово " * 20, "ru"), ("слово word " * 9, "xx"), ("mot " * 20, "fr"), ("слово " * 20, "uk")]
    d = spark.createDataFrame(rows, "t string, l string").select(stylometry.coverage(F.trim("t"), F.col("l")).alias("c"))
    assert [tuple(r.c) for r in d.collect()] == [("limited", 0), ("en", 95), ("limited", 30), ("mixed", 100), ("limited", 35), ("uk", 95)]


def test_repeated_sentences_go_within_a_paragraph(spark):
    s = "The same old sentence has eight words here."
    text = f"{s} Another line stands , , between them. {s.replace('eight', 'EIGHT')}\n\n{s} Moreover, it ends. Studies show much."
    r = rewrite.rewrite(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.revised == f"{s} Another line stands, between them.\n\n{s} it ends. Studies show much." and r.vague == 1
    assert [(c.rule, c["count"]) for c in r.changes] == [("transitions", 1), ("repeats", 1)] and r.original_words == 37 and r.revised_words == 26


def test_summaries(spark):
    def said(n, k, attempted, succeeded, paused=False):
        i = lambda x: F.lit(x)
        return spark.range(1).select(report.summary(i(40), i(7), i("low"), i(n), i(k), i(55), i("T"), i(attempted), i(succeeded), i(paused))).first()[0]

    assert said(0, 0, 3, 0).startswith("Вебпошук не завершено: усі 3 запитів") and "не знайдено" not in said(0, 0, 3, 0)
    assert "призупинені" in said(0, 0, 0, 0, True) and said(0, 0, 2, 1).startswith("Сильних збігів")
    assert said(3, 1, 1, 1).startswith('Найсильніший підтверджений збіг: 55% з "T"') and "Ще 2" in said(3, 1, 1, 1) and said(2, 0, 1, 1).startswith("Знайдено 2")


def test_opinions(spark):
    good = 'Sure:\n```json\n{"probability": "71.6", "signals": [{"label": "L", "score": 300, "evidence": ["a", "b", "c", "d", "e"]}]}\n```'
    got = one(spark, good, report.parsed_opinion)
    assert got.probability == 72 and got.signals[0].score == 100 and got.signals[0].evidence == list("abcd")
    assert one(spark, "no json", report.parsed_opinion) is None and one(spark, '{"probability": "x"}', report.parsed_opinion).probability == 0
    d = spark.createDataFrame([(1, "S."), (2, "S.")], "doc_id int, summary string")
    told = {r.doc_id: r.summary for r in report.with_opinion(d, spark.createDataFrame([(2, 9)], "doc_id int, probability int")).collect()}
    assert told[1] == "S." and told[2].endswith("9%.")


def test_stored_reports(spark, tmp_path):
    d = spark.createDataFrame([(k, f"f{k}", k, f"k{k}") for k in range(12)], "doc_id int, file_name string, plagiarism_score int, report_key string")
    at = F.lit(dt.datetime(2024, 3, 31)) - F.make_interval(days=F.col("doc_id") * 4)
    report.save(d, str(tmp_path / "r"), at)
    kept = report.lookup(spark, str(tmp_path / "r"), F.lit(dt.datetime(2024, 3, 31)))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(8))
    assert [r.doc_id for r in report.listed(kept, 3).collect()] == [0, 1, 2]
    new = report.unscanned(spark.createDataFrame([("k1",), ("zz",)], "k string"), kept, F.col("k"))
    assert [r.k for r in new.collect()] == ["zz"]


def test_places_go_round_over_blocks(spark):
    rows = [(g, p) for g, n in (("a", 7), ("b", 3), ("c", 5)) for p in range(1, n + 1)]
    got = corpus.interleave(spark.createDataFrame(rows, "g string, p int"), "g", "p", block=2).orderBy("place").collect()
    assert [(r.g, r.p) for r in got] == sorted(rows, key=lambda x: (x[1], x[0])) and [r.place for r in got] == list(range(1, 16))


def _streamed(spark, rows, schema, path, make, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    q = make(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", path + "-state").start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    log = [("p", t, 1, False), ("p", t, 2, False), ("p", t, 3, True), ("p", t + dt.timedelta(milliseconds=5001), 4, True), ("q", t, 5, True)]
    got = _streamed(spark, log, "provider string, ts timestamp, seq long, ok boolean", str(tmp_path / "a"), lambda s: caches.breaker(s, 2, 5.0), "b1")
    assert {r.seq: r.allowed for r in got} == {1: True, 2: True, 3: False, 4: True, 5: True}
    seen = [("k", t, None), ("k", t + dt.timedelta(seconds=5), "v"), ("k", t + dt.timedelta(seconds=20), "v")]
    got = _streamed(spark, seen, "key string, ts timestamp, value string", str(tmp_path / "c"), lambda s: caches.cached(s, 10), "c1")
    assert sorted((r.ts, r.hit, r.negative) for r in got) == [(seen[0][1], False, False), (seen[1][1], True, True), (seen[2][1], False, False)]
    asked = [("x", t), ("x", t + dt.timedelta(days=1)), ("y", t)]
    got = _streamed(spark, asked, "report_key string, ts timestamp", str(tmp_path / "d"), caches.first_reports, "d1")
    assert sorted(r.report_key for r in got) == ["x", "y"]


def test_durations_and_labels(spark):
    d = spark.createDataFrame([(0,), (42,), (60,), (130,)], "s int").select(report.duration(F.col("s")).alias("d"))
    assert [r.d for r in d.collect()] == ["після додавання тексту", "~42 с", "~1 хв", "~2 хв 10 с"]
    errors = {"HTTP 429 now": "модель тимчасово обмежена лімітом запитів", "Rate-limited": "модель тимчасово обмежена лімітом запитів", "out of credits": "у провайдера закінчилася квота", "Request ABORTED": "модель не відповіла вчасно", "an empty response": "модель повернула порожню відповідь", "x" * 200: "x" * 180, "": ""}
    assert {k: one(spark, k, T.error_sentence) for k in errors} == errors


def test_rich_html_keeps_what_is_allowed():
    src = '<style>.MsoNormal, p.x { color: red; behavior: url(a) }</style><p class="MsoNormal evil" onclick="x()" style="margin: 1pt; background: url(x)">a <font>b</font><script>c</script><a href="javascript:x" id="q1">d</a><a href="https://e.f">g</a></p><table width="50%" border="9x"><tr><td colspan="2">h</td></tr></table>'
    assert html.rich_only(src) == '<p class="MsoNormal" style="color:red;margin:1pt">a b<a id="q1">d</a><a href="https://e.f">g</a></p><table width="50%"><tr><td colspan="2">h</td></tr></table>'
    assert html.rich_only(None) == ""


def test_report_signals_begin_with_the_windows(spark):
    text = "Plain words about rivers and towns fill this line of text. " * 60 + "References. One two three"
    d = spark.createDataFrame([(1, text, "en"), (2, "this short text holds enough words for signals but not for more than one window here", "en")], "doc_id int, text string, lang string")
    rows = sorted(stylometry.report_signals(d).collect(), key=lambda r: (r.doc_id, r.place))
    own = [r for r in rows if r.doc_id == 1]
    assert own[0].label == stylometry.LABELS["segments"] and own[0].evidence[0].startswith("сегмент ") and own[-1].label == stylometry.LABELS["excluded"] and own[-1].evidence == ["4 слів у списку джерел"]
    assert [r.place for r in own] == list(range(len(own))) and rows[-1].label == stylometry.LABELS["safeguard"]


def test_stopped_tasks_are_not_attempted(spark):
    from inkspan.operators import state

    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("p", t, k, False, k == 1, 3) for k in range(1, 6)] + [("q", t, 9, True, False, 3)], "provider string, ts timestamp, seq long, ok boolean, timed_out boolean, results int")
    got = {r.seq: r for r in state.outcomes(log, 3, 60.0).collect()}
    assert [got[k].attempted for k in (1, 2, 3, 4, 5)] == [1, 1, 1, 0, 0] and got[1].timed_out == 1 and got[4].skipped_reason and got[9].results == 3
    merged = {r.provider: r for r in corpus.merge_diagnostics(state.outcomes(log, 3, 60.0), "seq").collect()}
    assert (merged["p"].attempted, merged["p"].failed, merged["q"].results) == (3, 3, 3)


def test_small_texts(spark):
    assert one(spark, "https://d.com/l/?uddg=https%3A%2F%2Fa.b%2Fc", T.redirect_target) == "https://a.b/c" and one(spark, "https://a.b/", T.redirect_target) == "https://a.b/"
    assert one(spark, "1234567", lambda c: T.grouped_number(c.cast("long"))) == "1 234 567"


def _docx(paragraphs):
    import io
    import zipfile

    body = "".join("<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in p) + "</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", "<styles/>")
    return out.getvalue()


def test_documents_are_read_and_written_run_by_run(spark, tmp_path):
    import io
    import zipfile

    raw = _docx([["The ", "quick", " fox &amp; hen"], ["Second paragraph"]])
    assert files.docx_text(raw) == "The quick fox & hen\n\nSecond paragraph"
    new = files.docx_with(raw, "The quick dog & hen\n\nSecond paragraph")
    assert files.docx_text(new) == "The quick dog & hen\n\nSecond paragraph"
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        xml = z.read("word/document.xml").decode()
        assert "<w:t>quick</w:t>" in xml and "dog &amp; hen</w:t>" in xml and 'space="preserve"' in xml and z.read("word/styles.xml") == b"<styles/>"
    (tmp_path / "a.docx").write_bytes(raw)
    (tmp_path / "b.md").write_text("One\r\n\r\n\r\n\r\ntwo  three")
    (tmp_path / "c.xyz").write_text("x")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text.startswith("The quick fox") and got["b.md"].text == "One\n\ntwo three"
    assert got["c.xyz"].method == "unsupported" and got["c.xyz"].error and got["d.docx"].text is None and got["d.docx"].error


def test_texts_without_a_patterns_literals_need_no_search(spark):
    every = [p for _, _, _, ps in stylometry.GROUPS for p in ps] + [stylometry.CITATION, stylometry.NUMBER, stylometry.QUOTE]
    pieces = "NOT ONLY this but also that|It's not just x it's y|ROBUŞT ROBUST robuſt roBust|Ключова роль, важливий підхід|не лише це, а й те|1. a 2. b 3. c|у  роботі розглянуто|[12] (Іваненко, 2021) HTTP://x.y doi: 1|«довга цитата про щось важливе» \"short\"|I DON'T HAVE ACCESS|İn conclusion, İ cannot|ᲀАЖЛИВО ЗАЗНАЧИТИ|Kelvin 12 км|у сучасному світі|nothing here at all".split("|")
    r = random.Random(1)
    texts = pieces + [" ".join(r.choice(pieces) for _ in range(4)) for _ in range(30)] + ["", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.folded(F.col("t")).alias("low"))
    both = lambda p: F.struct(F.coalesce(stylometry.matches(F.col("t"), p), F.lit(0)).alias("plain"), F.coalesce(stylometry.matches(F.col("t"), p, F.col("low")), F.lit(0)).alias("gated"))
    got = d.select("t", *[both(p).alias(f"p{k}") for k, p in enumerate(every)]).collect()
    assert all(x[f"p{k}"].plain == x[f"p{k}"].gated for x in got for k in range(len(every)))
    assert sum(x[f"p{k}"].plain > 0 for x in got for k in range(len(every))) > 60
    words = d.select(F.size(stylometry.listed(F.coalesce("low", F.lit("")), stylometry.FIRST_PERSON)).alias("a"), F.coalesce(stylometry.matches(F.col("t"), stylometry.bounded(stylometry.FIRST_PERSON)), F.lit(0)).alias("b"))
    assert all(x.a == x.b for x in words.collect())


@pytest.mark.parametrize("pattern,need", [("abc|de", ("abc", "de")), ("a(?:bcd|xy)?e+f", ("a",)), (r"\s*x{0,3}", None), (r"[12]yz\d", ("yz",)), ("(?:AB|cde)fg", ("fg",)), ("(?:AB|cde)f", ("ab", "cde"))])
def test_literals_of_patterns(pattern, need):
    assert T.literals(pattern) == need


def plain_cache(log, capacity, seconds):
    """Lookups in order against a dictionary a cache, which keeps the order of first insertion."""
    caches_, out = {}, {}
    for cache, key, ts, seq, value in sorted(log, key=lambda x: (x[2], x[3])):
        entries = caches_.setdefault(cache, {})
        if key in entries and entries[key][0] < ts:
            del entries[key]
        out[seq] = (key in entries, key in entries and entries[key][1])
        if key not in entries:
            if len(entries) >= capacity:
                del entries[min(entries, key=lambda k: entries[k][2])]
            entries[key] = (ts + dt.timedelta(seconds=seconds), value is None, seq)
    return out


LOOKUPS = "cache string, key string, ts timestamp, seq long, value string"


def lookup_log(n, seed=3):
    r, t = random.Random(seed), dt.datetime(2024, 1, 1)
    times = sorted(t + dt.timedelta(seconds=r.randrange(400)) for _ in range(n))
    return [(r.choice("ab"), f"k{r.randrange(9)}", at, k, r.choice([None, "v"])) for k, at in enumerate(times)]


def test_bounded_cache_against_a_dictionary(spark):
    log = lookup_log(300)
    got = state.bounded_cache(spark.createDataFrame(log, LOOKUPS).repartition(3), 4, 60.0).collect()
    assert {x.seq: (x.hit, x.negative) for x in got} == plain_cache(log, 4, 60.0)
    assert state.bounded_cache(spark.createDataFrame([], LOOKUPS)).count() == 0


def test_bounded_cache_in_a_stream(spark, tmp_path):
    log = lookup_log(160, seed=5)
    name, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = str(tmp_path / "in")
        for part in (log[:70], log[70:]):  # two micro-batches: the state lives on between them
            spark.createDataFrame(part, LOOKUPS).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(LOOKUPS).parquet(src)
            q = caches.bounded_cache(stream, 4, 60.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.set(name, old)
    assert {x.seq: (x.hit, x.negative) for x in got} == plain_cache(log, 4, 60.0)


def test_as_of_against_all_reads(spark):
    r, t = random.Random(9), dt.datetime(2024, 1, 1)
    row = lambda k: (r.choice("xy"), t + dt.timedelta(seconds=r.randrange(600)), k)
    lookups, reads = [row(k) for k in range(150)], [(*row(k), r.choice([None, "page"])) for k in range(40)]
    reads += [(k, at, 1000 + j, None) for j, (k, at, _, _) in enumerate(reads[:5])]  # of one time, the last by seq
    got = state.as_of(spark.createDataFrame(lookups, "key string, ts timestamp, seq long"), spark.createDataFrame(reads, "key string, ts timestamp, seq long, value string"), 30).collect()
    expected = {}
    for key, ts, seq in lookups:
        live = max(((a, s, v is None) for k, a, s, v in reads if k == key and a <= ts < a + dt.timedelta(seconds=30)), default=None)
        expected[seq] = (live is not None, bool(live and live[2]), live and live[0])
    assert {x.seq: (x.hit, x.negative, x.read_at) for x in got} == expected


def test_repeated_elements_are_counted_in_first_order(spark):
    lists = [[], ["a"], list("abcabxcz"), ["x"] * 5 + ["y", "b", "y"], ["ж", "a", "ж"]]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, x array<string>").select("k", stylometry.counted(F.col("x")).alias("c")).collect()
    assert {r.k: [(e.x, e.n) for e in r.c] for r in got} == {k: [(y, x.count(y)) for y in dict.fromkeys(x) if x.count(y) > 1] for k, x in enumerate(lists)}
