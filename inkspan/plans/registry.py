"""Registered queries of the document-forensics operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import text as T
from inkspan.operators import align, corpus, language, match, prep, probe, report, rewrite, scan, search, state, stylometry
from inkspan.operators.sequence import analysis_windows, chunk_plan, chunks, full_coverage, winnow
from inkspan.plans import oracles as O
from inkspan.sources import html
from inkspan.sources.files import page_texts
from inkspan.sources.tables import kept, spread


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents dealt out evenly: work on their texts outweighs reading them by far."""
    return spread(_t(spark, d, "documents"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    return _t(spark, d, "benchmark").select(name.alias("title"), F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("url"), F.col("text").alias("snippet"), F.col("text").alias("source_text"))


def word_stats(s, d):
    # the text is normalised once, and its tokens are found once
    def counted(n):
        content = lambda t: F.size(F.array_distinct(F.filter(t, lambda x: ~x.isin(T.STOP_WORDS))))
        return T.let(T.tokens(n, True), lambda t: F.struct(F.size(T.words(n, True)).alias("n_words"), F.size(t).alias("n_tokens"), content(t).alias("n_distinct")))

    return _docs(s, d).select("doc_id", T.let(T.normalize_ws(F.col("text")), counted).alias("c")).select("doc_id", "c.*")


def chunk_settings(s, d):
    return _t(s, d, "documents").select("doc_id", full_coverage(T.count_words(F.col("text"))).alias("p")).select("doc_id", "p.*")


def text_chunks(s, d):
    return chunks(_docs(s, d))


def windows(s, d):
    return analysis_windows(_docs(s, d))


def fingerprints(s, d):
    b = _t(s, d, "benchmark").select("item_id", winnow(T.tokens(F.col("text"), True)).alias("fp"))
    return b.select("item_id", F.explode("fp").alias("fingerprint"))


def _grams(table, key: str) -> DataFrame:
    return table.select(key, match.gram_hashes(T.tokens(F.col("text"), True), 5).alias("fp"))


def candidate_pairs(s, d):
    """Documents and benchmark items that share a 5-gram, with how many."""
    return match.candidate_pairs(_grams(_docs(s, d), "doc_id"), _grams(_t(s, d, "benchmark"), "item_id"), ["doc_id"], ["item_id"])


def ngram_containment(s, d):
    """Share of an item's distinct 5-grams that a document has, for pairs that share any."""
    b = _grams(_t(s, d, "benchmark"), "item_id").select("item_id", F.size(F.array_distinct("fp")).alias("n"))
    return candidate_pairs(s, d).join(b, "item_id").select("doc_id", "item_id", (F.col("shared") / F.col("n")).alias("containment"))


def longest_runs(s, d):
    a = _docs(s, d).select("doc_id", T.tokens(F.col("text"), True).alias("a"))
    b = _t(s, d, "benchmark").select("item_id", T.tokens(F.col("text"), True).alias("b"))
    pairs = candidate_pairs(s, d).select("doc_id", "item_id").join(a, "doc_id").join(b, "item_id")
    return pairs.select("doc_id", "item_id", match.common_run(F.col("a"), F.col("b"))["longest_run"].alias("longest_run"))


def reuse_matches(s, d):
    return match.reuse(_docs(s, d), _corpus(s, d))


def reuse_scores(s, d):
    return match.confirmed_score(reuse_matches(s, d))


def page_url_dedupe(s, d):
    return corpus.dedupe_by_url(_t(s, d, "pages").select("page_id", "url"), "page_id")


def page_interleave(s, d):
    p = _t(s, d, "pages").select("page_id", F.regexp_extract("url", r"\.(com|net|org)/", 1).alias("provider"))
    from pyspark.sql import Window as W

    return corpus.interleave(p.withColumn("pos", F.row_number().over(W.partitionBy("provider").orderBy("page_id"))), "provider", "pos")


def page_text(s, d):
    return page_texts(_t(s, d, "pages"))


def hydrated(s, d):
    p = _t(s, d, "pages")
    c = p.select("url", F.lit("t").alias("title"), F.lit("s").alias("snippet"), F.lit(None).cast("string").alias("source_text"))
    return corpus.hydrate(c, page_texts(p))


def diagnostics(s, d):
    e = _t(s, d, "events")
    bad = F.col("event_type") == "error"
    f = e.select(F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("provider"), F.lit(1).alias("attempted"), (~bad).cast("int").alias("succeeded"), bad.cast("int").alias("failed"), F.lit(0).alias("timed_out"), F.lit(1).alias("results"), F.when(bad, F.col("event_type")).alias("skipped_reason"), "event_id")
    return corpus.merge_diagnostics(f, "event_id")


def rate_limits(s, d):
    return state.rate_limit(_t(s, d, "events"), 1)


def job_states(s, d):
    return state.latest_state(_t(s, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")


def breaker(s, d):
    e = _t(s, d, "events")
    return state.circuit_breaker(e.select(F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("provider"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok")))


def _lookups(s, d) -> DataFrame:
    """Events as lookups: seven caches, a key a user, and values that are null after errors."""
    e = _t(s, d, "events")
    return e.select(F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("cache"), F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"), "event_type")


def cache_replay(s, d):
    """Which lookups a cache of eight entries for ten hours answers."""
    return state.bounded_cache(_lookups(s, d), 8, 36000.0)


def page_lookups(s, d):
    """Which views find what the last other event of their user left within the hour before."""
    e = _lookups(s, d)
    return state.as_of(e.where("event_type = 'view'"), e.where("event_type <> 'view'"), 3600)


def history(s, d):
    return corpus.newest(_t(s, d, "events").select("event_id", "ts", "event_type"), "ts", "event_id")


def report_keys(s, d):
    return _t(s, d, "documents").select("doc_id", T.report_key(F.col("text"), F.lit("balanced")).alias("key"))


def unlabelled(s, d):
    return _t(s, d, "documents").select("doc_id").join(_t(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


def rerank_cosine(s, d):
    v = _t(s, d, "embeddings")
    return corpus.rerank(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10).select("query_id", "vec_id", "rank")


def index_to_text(s, d):
    return corpus.text_of_index(corpus.word_index(_docs(s, d)))


def type_token_ratio(s, d):
    return _docs(s, d).select("doc_id", stylometry.mattr(T.tokens(F.col("text"), True)).alias("mattr"))


def stylometry_units(s, d):
    return stylometry.single_pass(_docs(s, d).select("doc_id", "text")).drop("text").withColumn("ranked", F.array_join("ranked", "; "))


def signals(s, d):
    return stylometry.signals(_docs(s, d)).drop("evidence")


def stylometry_verdicts(s, d):
    return stylometry.ensemble(_docs(s, d)).withColumn("segments", F.size("segments")).drop("upper", "strongest")


def reliability_reasons(s, d):
    """Why each verdict is as reliable as it is, as a sentence."""
    v = stylometry.ensemble(_docs(s, d))
    left = F.col("code_words") + F.col("quoted_words") + F.col("reference_words")
    return v.select("doc_id", stylometry.reason_text(F.col("reason"), F.col("percent"), F.col("word_count"), left).alias("reason"))


def suspicious_segments(s, d):
    v = stylometry.ensemble(_docs(s, d)).select("doc_id", F.posexplode("segments").alias("place", "x"))
    return v.select("doc_id", "place", "x.index", "x.start_word", "x.end_word", "x.score", "x.excerpt", F.array_join("x.evidence", "; ").alias("evidence"))


def report_signals(s, d):
    return stylometry.report_signals(_docs(s, d)).withColumn("evidence", F.array_join("evidence", "; "))


def task_outcomes(s, d):
    e = _t(s, d, "events")
    log = e.select(F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("provider"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 2 == 0).alias("timed_out"), F.lit(3).alias("results"))
    return state.outcomes(log)


def safe_pages(s, d):
    return _t(s, d, "pages").select("page_id", html.sanitized_rich(F.col("html")).alias("html"))


def verdict_by_label(s, d):
    return stylometry_verdicts(s, d).join(_t(s, d, "labels"), "doc_id").groupBy("quality", "verdict").agg(F.count(F.lit(1)).alias("n"))


def language_coverage(s, d):
    return prep.analysis_text(_docs(s, d), "lang").select("doc_id", stylometry.coverage(F.col("text"), F.col("lang")).alias("c")).select("doc_id", "c.code", "c.percent")


def _profiles(docs: DataFrame) -> dict:
    return language.profiles(docs.where(~language.held_out(F.col("doc_id"))))


def language_distances(s, d):
    """Each document's distance to each language's profile, learnt from four fifths of the documents."""
    docs = _docs(s, d)
    made = _profiles(docs)
    names = F.array(*map(F.lit, sorted(made)))
    far = docs.select("doc_id", F.posexplode(language.distances(F.col("text"), made)).alias("k", "distance"))
    return far.select("doc_id", F.get(names, F.col("k")).alias("language"), "distance")


def language_confusion(s, d):
    """Documents by language, by the language they are taken for, and by whether the profiles have seen them."""
    docs = _docs(s, d)
    found = language.identified(docs.select("doc_id", "text", "lang"), _profiles(docs), out="found")
    return found.groupBy("lang", "found", language.held_out(F.col("doc_id")).alias("held_out")).agg(F.count(F.lit(1)).alias("n"))


def prose_text(s, d):
    return prep.prose(_docs(s, d))


def prose_of_pages(s, d):
    """The sources of pages, which hold code, as text."""
    return prep.prose(_t(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", ">", ">\n").alias("text")))


def analysis_texts(s, d):
    return prep.analysis_text(_docs(s, d))


def document_texts(s, d):
    return prep.document_text(_docs(s, d))


def rewritten(s, d):
    r = rewrite.rewrite(_docs(s, d))
    changes = F.array_join(F.transform("changes", lambda x: F.concat(x["rule"], F.lit(":"), x["count"].cast("string"))), ", ")
    return r.select("doc_id", "revised", changes.alias("changes"), "original_words", "revised_words")


def revision_diff(s, d):
    c = _t(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    r = rewrite.rewrite(c).select("doc_id", "revised").join(c.select("doc_id", F.col("text").alias("original")), "doc_id")
    return align.word_diff(r).select("doc_id", F.size("parts").alias("n_parts"))


def probe_queries(s, d):
    return probe.search_queries(chunks(_docs(s, d)))


def deep_probe_queries(s, d):
    return probe.search_queries(chunks(_docs(s, d)), deep=True)


def recommended_settings(s, d):
    n = T.count_words(F.col("text"))
    p = _t(s, d, "documents").select("doc_id", report.recommended(n).alias("p")).select("doc_id", "p.*")
    return p.withColumn("duration", report.duration(F.col("seconds")))


def document_modes(s, d):
    from pyspark.sql import Window as W

    # only counts are shuffled: a text's words tell how many chunks it has
    per = _docs(s, d).where("doc_id IS NOT NULL").select("doc_id", T.count_words(F.col("text")).alias("n"))
    per = per.select("doc_id", "n", F.when(F.col("n") > 0, chunk_plan(F.col("n"))["last"] + 1).alias("c"))
    per = per.withColumn("n_chunks", F.sum("c").over(W.partitionBy("doc_id"))).where("n_chunks > 0")
    m = per.select("doc_id", report.document_mode(F.col("n"), F.col("n_chunks")).alias("m"))
    return m.select("doc_id", "m.long", "m.very_long", "m.search_limit", "m.page_limit", "m.concurrency")


def accepted_texts(s, d):
    return report.long_enough(_t(s, d, "documents")).select("doc_id", "accepted")


def _snippets(s, d) -> DataFrame:
    """Benchmark items as search results: snippets of thirty words, whose pages hold the whole."""
    short = F.array_join(F.slice(T.words(F.col("snippet")), 1, 30), " ")
    return _corpus(s, d).withColumn("snippet", short).withColumn("source_text", F.lit(None).cast("string"))


def scan_matches(s, d):
    """The scan in two phases: results by their snippets, then the pages of those that come near."""
    pages = _corpus(s, d).select("url", F.col("source_text").alias("text"))
    return report.scan(_docs(s, d), _snippets(s, d), pages).select("doc_id", "chunk_index", "url", "score", "longest_run", "confidence", "rank")


def searched_candidates(s, d):
    """Each chunk's candidates, found by its own queries."""
    docs = _docs(s, d)
    parts = chunks(docs)
    asked = kept(search.chunk_queries(parts, search.modes(docs, parts, False), False), "queries")
    return search.chunk_candidates(search.build(corpus.complete(_corpus(s, d))), asked)


def searched_matches(s, d):
    """The scan of each chunk against its own candidates: snippets, whose pages are read."""
    pages = _corpus(s, d).select("url", F.col("source_text").alias("text"))
    ranked, *_ = scan.searched_matches(_docs(s, d), _snippets(s, d), pages)
    return ranked.select("doc_id", "chunk_index", "url", "score", "longest_run", "confidence", "rank")


def document_scans(s, d):
    """Reports of prepared documents, with their notes."""
    pages = _corpus(s, d).select("url", F.col("source_text").alias("text"))
    whole = scan.scan_documents(_docs(s, d), _snippets(s, d), pages)
    told = whole.notes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "note"))), lambda x: x["note"]), " | ").alias("notes"))
    return whole.reports.join(told, "doc_id")


def scan_reports(s, d):
    docs = _docs(s, d)
    pages = _corpus(s, d).select("url", F.col("source_text").alias("text"))
    ranked = kept(report.scan(docs, _snippets(s, d), pages), "ranked")  # counted and scored
    return report.reports(docs, ranked, stylometry.ensemble(docs), _corpus(s, d), diagnostics(s, d))


def page_counters(s, d):
    e = _t(s, d, "events")
    reads = e.select((F.col("event_type") != "click").alias("attempted"), F.when(F.col("event_type") != "error", F.col("props")).alias("text"), (F.col("event_type") == "view").alias("cache_hit"), (F.col("event_type") == "error").alias("negative_hit"))
    return report.page_counters(reads)


def search_notes(s, d):
    return corpus.diagnostics_notes(diagnostics(s, d))


def labels_of_scores(s, d):
    return stylometry_verdicts(s, d).select("doc_id", T.risk_label(F.col("probability")).alias("label"), F.concat("verdict", F.lit("/"), "level").alias("caption"))


def plain_as_html(s, d):
    """Conversations as HTML, and the plain text of it."""
    c = _t(s, d, "conversations").select("conv_id", "turn", html.from_plain(F.col("text")).alias("html"))
    return c


def rich_round_trip(s, d):
    return plain_as_html(s, d).select("conv_id", "turn", html.text_of(F.col("html")).alias("text"))


def file_facts(s, d):
    t = _t(s, d, "documents").select("doc_id", report.file_evidence(F.octet_length("text"), T.count_words(F.col("text")), F.length("text"), F.lit("docx")).alias("e"))
    return t.select("doc_id", "e.size_kb", "e.density", "e.words", "e.chars", "e.format_score")


def match_excerpts(s, d):
    return _t(s, d, "documents").select("doc_id", T.search_excerpt(F.col("text")).alias("excerpt"))


def extracted(s, d):
    return _t(s, d, "documents").select("doc_id", T.extracted_text(F.col("text")).alias("text"))


OWN = (
    word_stats, chunk_settings, text_chunks, windows, fingerprints, candidate_pairs, ngram_containment, longest_runs, reuse_matches, reuse_scores, page_url_dedupe, page_interleave, page_text, hydrated, diagnostics, rate_limits,
    job_states, breaker, cache_replay, page_lookups, history, report_keys, unlabelled, rerank_cosine, index_to_text, type_token_ratio, stylometry_units, signals, stylometry_verdicts, reliability_reasons, suspicious_segments, verdict_by_label, language_coverage, language_distances, language_confusion, prose_text,
    prose_of_pages, analysis_texts, document_texts, rewritten, revision_diff, probe_queries, deep_probe_queries, recommended_settings, document_modes, accepted_texts, scan_matches, searched_candidates, searched_matches, document_scans, scan_reports, page_counters, search_notes,
    labels_of_scores, report_signals, task_outcomes, safe_pages, plain_as_html, rich_round_trip, file_facts, match_excerpts, extracted,
)


def queries() -> dict:
    return {f.__name__: f for f in OWN}


NORM, WORDS, TOKENS, STOP, FNV = O.norm("text"), O.words("text"), O.tokens(O.norm("text")), O.STOP, O.FNV
GRAMS = "CASE WHEN len(t) >= 5 THEN list_distinct(list_transform(range(1, len(t) - 3), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] || ' ' || t[i + 4])) ELSE [] END"
PAIRS = f"""td AS MATERIALIZED (SELECT doc_id, {TOKENS} AS t FROM documents), tb AS MATERIALIZED (SELECT item_id, {TOKENS} AS t FROM benchmark),
a AS (SELECT doc_id, unnest({GRAMS}) AS g FROM td), b AS (SELECT item_id, unnest({GRAMS}) AS g FROM tb),
p AS (SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "word_stats": f"SELECT doc_id, len({WORDS})::INT AS n_words, len({TOKENS})::INT AS n_tokens, len(list_distinct(list_filter({TOKENS}, lambda t: t NOT IN ({STOP}))))::INT AS n_distinct FROM documents",
        "windows": f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), n AS (SELECT *, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT *, CASE WHEN n <= 220 THEN [0] ELSE list_append(list_filter(range(0, n + 1, 165), lambda x: x + 220 < n), n - 220) END AS ss FROM n),
e AS (SELECT doc_id, w, n, unnest(ss) AS st, unnest(range(0, len(ss))) AS i FROM s)
SELECT doc_id, i::INT AS window_index, (st + 1)::INT AS start_word, least(st + 220, n)::INT AS end_word, array_to_string(list_slice(w, st + 1, st + 220), ' ') AS window_text FROM e""",
        "fingerprints": f"""WITH t AS (SELECT item_id, {TOKENS} AS t FROM benchmark), g AS (SELECT item_id, unnest(range(1, len(t) - 3)) AS i, t FROM t WHERE len(t) >= 5),
h AS (SELECT item_id, i, array_to_string(list_slice(t, i, i + 4), ' ') AS g FROM g), f AS (SELECT item_id, i, {FNV} AS h, count(*) OVER (PARTITION BY item_id) AS n FROM h),
m AS (SELECT item_id, i, n, min(h) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS fingerprint FROM f)
SELECT DISTINCT item_id, fingerprint FROM m WHERE i >= least(4, n)""",
        "candidate_pairs": f"WITH {PAIRS} SELECT doc_id, item_id, shared FROM p",
        "ngram_containment": f"WITH {PAIRS}, c AS (SELECT item_id, count(*) AS n FROM b GROUP BY ALL) SELECT doc_id, item_id, shared / n AS containment FROM p JOIN c USING (item_id)",
        "longest_runs": f"""WITH {PAIRS}, x AS (SELECT doc_id, item_id, unnest(t) AS t, unnest(range(0, len(t))) AS s FROM p JOIN td USING (doc_id)),
y AS (SELECT item_id, unnest(t) AS t, unnest(range(0, len(t))) AS c FROM tb),
h AS (SELECT doc_id, item_id, s, s - c AS d FROM x JOIN y USING (item_id, t)),
g AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY s) AS k FROM h),
r AS (SELECT doc_id, item_id, d, k, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, item_id, max(n)::INT AS longest_run FROM r GROUP BY ALL""",
        "page_url_dedupe": "SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') ORDER BY page_id) AS k FROM pages) WHERE k = 1",
        "page_interleave": """WITH p AS (SELECT page_id, regexp_extract(url, '\\.(com|net|org)/', 1) AS provider FROM pages),
q AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY page_id)::INT AS pos FROM p)
SELECT *, (row_number() OVER (ORDER BY pos, provider))::INT AS place FROM q""",
        "diagnostics": """SELECT 'p' || (user_id % 7) AS provider, count(*) AS attempted, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
0::BIGINT AS timed_out, count(*) AS results, arg_max(CASE WHEN event_type = 'error' THEN event_type END, CASE WHEN event_type = 'error' THEN event_id END) AS skipped_reason FROM events GROUP BY 1""",
        "rate_limits": "SELECT user_id, time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, count(*) AS requests, greatest(0, count(*) - 1)::BIGINT AS refused FROM events GROUP BY 1, 2",
        "job_states": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
        "page_lookups": """WITH l AS (SELECT user_id::VARCHAR AS key, ts, event_id AS seq FROM events WHERE event_type = 'view'), r AS (SELECT user_id::VARCHAR AS key, ts, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events WHERE event_type <> 'view'),
j AS (SELECT l.key, l.ts, l.seq, r.ts AS found, r.value, row_number() OVER (PARTITION BY l.seq ORDER BY r.ts DESC NULLS LAST, r.seq DESC) AS k FROM l LEFT JOIN r ON r.key = l.key AND r.ts <= l.ts AND l.ts < r.ts + INTERVAL 1 HOUR)
SELECT key, ts, seq, found IS NOT NULL AS hit, found IS NOT NULL AND value IS NULL AS negative, found AS read_at FROM j WHERE k = 1""",
        "breaker": O.breaker(),
        "task_outcomes": O.task_outcomes(),
        "document_texts": O.document_texts(),
        "scan_reports": O.scan_reports(),
        "extracted": O.extracted(),
        "rich_round_trip": O.rich_round_trip(),
        "history": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10",
        "report_keys": "SELECT doc_id, sha256(text) || ':balanced' AS key FROM documents",
        "unlabelled": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "rerank_cosine": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.v, q.v) AS c FROM e, (SELECT * FROM e WHERE vec_id % 100 = 0) q),
r AS (SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id))::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 10""",
        "index_to_text": f"SELECT doc_id, {NORM} AS text FROM documents WHERE {NORM} <> ''",
        "chunk_settings": f"WITH c AS (SELECT doc_id, {O.count_words('text')} AS n FROM documents), p AS (SELECT doc_id, n, {O.settings('n')} FROM c) SELECT doc_id, cw AS chunk_words, ov AS overlap, greatest(60, cw - ov) AS step, greatest(1, ceil(greatest(1, n - ov) / greatest(60, cw - ov)))::INT AS max_chunks FROM p",
        "text_chunks": f"WITH {O.chunk_ctes()} SELECT doc_id, chunk_index, len(cws)::INT AS word_count, array_to_string(cws, ' ') AS chunk_text FROM chunk",
        "reuse_matches": O.reuse(most=None) + " SELECT doc_id, chunk_index, url, score, overlap_percent, ngram_percent, hash_percent, full_text_rank, longest_run, confidence, excerpt, submitted_evidence, source_evidence, rank FROM matches",
        "reuse_scores": O.reuse(most=None) + " " + O.REUSE_SCORE,
        "scan_matches": O.scan(),
        "searched_candidates": O.searched_candidates(),
        "searched_matches": O.searched_scan(),
        "type_token_ratio": f"WITH d AS MATERIALIZED (SELECT doc_id, {TOKENS} AS t FROM documents) SELECT doc_id, CASE WHEN len(t) = 0 THEN 0.0 WHEN len(t) <= 50 THEN len(list_distinct(t)) / len(t) ELSE list_sum(list_transform(list_append(range(0, len(t) - 49, 25), len(t) - 50), lambda i: len(list_distinct(list_slice(t, i + 1, i + 50))) / 50)) / (len(range(0, len(t) - 49, 25)) + 1) END AS mattr FROM d",
        "stylometry_units": O.style_units(),
        "signals": O.signals(),
        "stylometry_verdicts": f"WITH {O.verdict_ctes()} SELECT * EXCLUDE (segs), least(5, len(segs))::INT AS segments FROM judged",
        "reliability_reasons": O.reasons(),
        "suspicious_segments": f"WITH {O.verdict_ctes()}, e AS (SELECT doc_id, unnest(list_slice(segs, 1, 5)) AS x, unnest(range(0, least(5, len(segs)))) AS place FROM judged) SELECT doc_id, place::INT AS place, x.index::INT AS index, x.start_word::INT AS start_word, x.end_word::INT AS end_word, x.score AS score, x.excerpt AS excerpt, array_to_string(x.evidence, '; ') AS evidence FROM e",
        "verdict_by_label": f"WITH {O.verdict_ctes()} SELECT quality, verdict, count(*) AS n FROM judged JOIN labels USING (doc_id) GROUP BY ALL",
        "language_coverage": f"WITH {O.verdict_ctes()} SELECT doc_id, language AS code, percent FROM judged",
        "labels_of_scores": f"WITH {O.verdict_ctes()} SELECT doc_id, CASE WHEN probability >= 70 THEN 'high' WHEN probability >= 38 THEN 'medium' ELSE 'low' END AS label, verdict || '/' || level AS caption FROM judged",
        "language_distances": f"WITH {O.language()} SELECT doc_id, language, distance FROM far",
        "language_confusion": f"WITH {O.language()}, best AS (SELECT doc_id, min({{'d': distance, 'l': language}}).l AS found FROM far GROUP BY doc_id) SELECT lang, found, held_out, count(*) AS n FROM lt LEFT JOIN best USING (doc_id) GROUP BY ALL",
        "prose_text": f"WITH src AS (SELECT doc_id, text AS raw FROM documents), {O.prose_ctes('src', 'doc_id')} SELECT doc_id, prose AS text, code_words, code_blocks FROM prosed",
        "prose_of_pages": f"WITH src AS (SELECT page_id AS doc_id, replace(html, '>', '>' || chr(10)) AS raw FROM pages), {O.prose_ctes('src', 'doc_id')} SELECT doc_id, prose AS text, code_words, code_blocks FROM prosed",
        "analysis_texts": f"WITH {O.prepared_ctes()} SELECT doc_id, text, analyzed_words, code_words, quoted_words, reference_words FROM ready",
        "rewritten": O.rewritten(),
        "probe_queries": O.probes(),
        "deep_probe_queries": O.probes(True),
        "document_modes": f"WITH {O.chunk_ctes()}, k AS (SELECT doc_id, count(*) AS c FROM chunk GROUP BY ALL), m AS (SELECT doc_id, n, c, n > 2000 OR c > 18 AS long, n > 8000 OR c > 45 AS very_long FROM c1 JOIN k USING (doc_id)) SELECT doc_id, long, very_long, CASE WHEN very_long THEN 3 WHEN long THEN 4 ELSE 8 END AS search_limit, CASE WHEN very_long THEN 32 WHEN long THEN 48 ELSE 80 END AS page_limit, CASE WHEN very_long THEN 8 ELSE 5 END AS concurrency FROM m",
        "recommended_settings": f"""WITH a AS (SELECT doc_id, {O.count_words('text')} AS n FROM documents), b AS (SELECT *, CASE WHEN n > 20000 THEN 520 WHEN n > 10000 THEN 460 WHEN n > 5000 THEN 380 WHEN n > 2000 THEN 240 ELSE 120 END AS cw FROM a),
c AS (SELECT *, least(floor(cw * 0.18), CASE WHEN n > 2000 THEN 44 ELSE 32 END)::INT AS ov FROM b), d AS (SELECT *, CASE WHEN n = 0 THEN 14 ELSE greatest(8, ceil(n / greatest(40, cw - ov)))::INT END AS most FROM c),
e AS (SELECT *, n > 2000 OR most > 18 AS long, n > 8000 OR most > 45 AS very FROM d),
f AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(18, 8 + greatest(1, ceil(most / CASE WHEN very THEN 8 ELSE 5 END)) * CASE WHEN very THEN 9 WHEN long THEN 12 ELSE 17 END) END::INT AS seconds FROM e)
SELECT doc_id, cw AS chunk_words, ov AS overlap_words, most AS max_chunks, seconds, CASE WHEN seconds <= 0 THEN 'після додавання тексту' WHEN seconds < 60 THEN '~' || seconds || ' с' WHEN seconds % 60 > 0 THEN '~' || (seconds // 60) || ' хв ' || (seconds % 60) || ' с' ELSE '~' || (seconds // 60) || ' хв' END AS duration FROM f""",
        "accepted_texts": "SELECT doc_id, length(coalesce(text, '')) >= 120 AS accepted FROM documents",
        "page_counters": "SELECT count(*) FILTER (event_type <> 'click') AS attempted, count(*) FILTER (event_type <> 'error' AND props IS NOT NULL) AS verified, count(*) FILTER (event_type = 'error' OR props IS NULL) AS unavailable, count(*) FILTER (event_type = 'view') AS cache_hits, count(*) FILTER (event_type = 'error') AS negative_hits FROM events",
        "search_notes": "SELECT 'p' || (user_id % 7) AS provider, 'p' || (user_id % 7) || ': ' || count(*) FILTER (event_type <> 'error') || '/' || count(*) || ', ' || count(*) || ' рез.' || CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN ', ' || count(*) FILTER (event_type = 'error') || ' пом.' ELSE '' END AS note FROM events GROUP BY 1",
        "plain_as_html": f"""SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda p: regexp_replace(p, '^{T.WS}+|{T.WS}+$', '', 'g')), lambda p: p <> ''), lambda p: '<p>' || replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</p>'), '') AS html FROM conversations""",
        "file_facts": f"WITH a AS (SELECT doc_id, strlen(text) AS b, {O.count_words('text')} AS words, length(text) AS chars FROM documents), k AS (SELECT *, greatest(1, round(b / 1024))::INT AS size_kb FROM a) SELECT doc_id, size_kb, round(words / size_kb * 10) / 10 AS density, words::INT AS words, chars::INT AS chars, 18 AS format_score FROM k",
        "match_excerpts": f"WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(w) <= 22 THEN w ELSE list_slice(w, len(w) // 2 - 10, len(w) // 2 + 11) END, ' ') AS excerpt FROM d",
    }
