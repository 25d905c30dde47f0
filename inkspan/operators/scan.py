"""The whole scan of documents: preparation, gates, search, two phases of scoring, style, notes, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import normalize_ws
from inkspan.operators import corpus as C
from inkspan.operators import match, prep, report, search, stylometry
from inkspan.operators.sequence import Settings, chunks
from inkspan.sources.tables import counted, kept


@dataclass
class Scan:
    """refused(doc_id, gate), matches, notes(doc_id, place, note), diagnostics(doc_id, provider, ...), reports; counters of the run."""

    refused: DataFrame
    matches: DataFrame
    notes: DataFrame
    diagnostics: DataFrame
    reports: DataFrame
    counters: dict[str, int]


PROVIDER = "local"


def candidate_pairs(candidates: DataFrame, parts: DataFrame, corpus: DataFrame) -> DataFrame:
    """The texts of each chunk and its candidates(doc_id, chunk_index, source), each pair of different rows once."""
    p = parts.withColumn("part", match.content_key("chunk_text")).dropDuplicates(["doc_id", "chunk_index", "part"]).drop("part")
    return candidates.select("doc_id", "chunk_index", "source").join(p, ["doc_id", "chunk_index"]).join(search.sources(corpus), "source").drop("source")


def searched_matches(docs: DataFrame, corpus: DataFrame, pages: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """(ranked matches, queries with results, pages read, counters) of documents whose chunks are looked for in a corpus(title, url, snippet, source_text).

    Candidates of documents that aren't long are read before they are scored; of the others those whose snippet comes
    near the threshold are read and scored once more. Of both the higher score counts.
    """
    deep = s.sensitivity == "deep"
    every = F.count(F.lit(1))
    parts, n_parts = counted(chunks(docs, s), "chunks", every.alias("chunks"))
    of = kept(search.planned_modes(docs, s), "modes")
    index = search.build(C.complete(corpus))
    queries, n_queries = counted(search.chunk_queries(parts, of, deep), "queries", every.alias("queries"))
    candidates, n_candidates = counted(search.chunk_candidates(index, queries, deep), "candidates", every.alias("candidates"))
    pairs = candidate_pairs(candidates, parts, corpus).join(of.select("doc_id", "long"), "doc_id")
    verified = F.length(F.coalesce("source_text", F.lit(""))) > 0
    read, n_read = counted(C.hydrate(pairs, pages).drop("url_key"), "read", F.count_if(verified).alias("verified"), F.count_if(~verified).alias("unavailable"))
    scored = lambda d: match.score_pairs(d, ["doc_id", "chunk_index"], match.SCANNED)
    first = kept(scored(read.where("NOT long").drop("long").unionByName(pairs.where("long").drop("long"))), "scored")
    targets = kept(report.hydration_targets(first, of, s).select("doc_id", "chunk_index", "url").distinct(), "targets")
    again = read.join(targets, ["doc_id", "chunk_index", "url"], "left_semi").drop("long")
    both = first.withColumn("phase", F.lit(0)).unionByName(scored(again).withColumn("phase", F.lit(1)))
    asked = read.where("NOT long").drop("long").unionByName(again).select("doc_id", F.col("url"), verified.alias("verified")).distinct()
    ranked = match.ranked_matches(match.unique_matches(both, "phase"), s).drop("phase")
    queries = queries.join(candidates.groupBy("doc_id", "chunk_index").agg(every.alias("results")), ["doc_id", "chunk_index"], "left")
    return ranked, queries, asked, n_parts | n_queries | n_candidates | n_read


def _note(when: Column, *parts) -> Column:
    return F.when(when, F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))


def notes_of(facts: DataFrame) -> DataFrame:
    """facts(doc_id, skipped_title_words, code_words, code_blocks, provider counters, page counters, long, n_chunks) -> (doc_id, place, note)."""
    c = F.col
    # The report's notes.
    issue = F.coalesce(_note(c("failed") > 0, ", ", c("failed"), " пом."), F.lit(""))
    every = F.array(
        _note(c("skipped_title_words") > 0, "Титульну або службову частину курсової роботи автоматично пропущено."),
        _note(c("code_words") > 0, "Код автоматично вилучено з перевірки: ", c("code_words"), " слів у ", c("code_blocks"), " блоках."),
        _note(F.lit(True), "Вебіндекси: ", F.coalesce(_note(c("attempted") == 0, c("provider"), ": пропущено"), F.concat(c("provider"), F.lit(": "), c("succeeded").cast("string"), F.lit("/"), c("attempted").cast("string"), F.lit(", "), c("results").cast("string"), F.lit(" рез."), issue)), "."),
        _note(c("pages") > 0, "Перевірка сторінок: підтверджено ", c("verified"), ", недоступно ", c("pages") - c("verified"), ", кеш-влучень 0, повторно не завантажувались 0."),
        _note(c("long"), "Повне покриття: перевірено ", c("n_chunks"), " фрагментів, включно з кінцем документа."),
        _note(c("long"), "Для довгого тексту застосовано двофазний пошук: швидкий прохід по всіх фрагментах і точне дочитування найсильніших збігів."),
    )
    return facts.select("doc_id", F.posexplode(F.array_compact(every)).alias("place", "note"))


def scan_documents(docs: DataFrame, corpus: DataFrame, pages: DataFrame, s: Settings = Settings(), profiles: dict | None = None) -> Scan:
    """Documents(doc_id, text, and lang unless profiles are given) scanned as the service does it.

    A text is refused if it is too short as it comes, or once code and title page are out. All that follows sees the
    prepared text: chunks, searches, matches, style. Documents of one id are one document.
    """
    raw = report.long_enough(docs)
    lang = ["lang"] if profiles is None else []
    made = prep.document_text(raw.where("accepted").select("doc_id", *lang, "text"), *lang).withColumn("text", normalize_ws(F.col("text")))
    ready = report.long_enough(made)
    refused = raw.where("NOT accepted").select("doc_id", F.lit("received").alias("gate")).unionByName(ready.where("NOT accepted").select("doc_id", F.lit("prepared").alias("gate")))
    ready, n_ready = counted(ready, "prepared", F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
    ready = ready.where("accepted").drop("accepted")
    ranked, queries, asked, n_found = searched_matches(ready.select("doc_id", "text"), corpus, pages, s)
    ranked, n_ranked = counted(ranked, "ranked", F.count(F.lit(1)).alias("matches"))
    of = kept(search.planned_modes(ready, s).select("doc_id", "n_words", "n_chunks", "long"), "lengths")  # for notes and reports
    per = queries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("attempted"))
    found = queries.select("doc_id", "chunk_index", "results").distinct().groupBy("doc_id").agg(F.coalesce(F.sum("results"), F.lit(0)).alias("results"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    diagnostics = ready.select("doc_id").distinct().join(per, "doc_id", "left").join(found, "doc_id", "left").select("doc_id", F.lit(PROVIDER).alias("provider"), zero("attempted"), F.coalesce("attempted", F.lit(0)).alias("succeeded"), F.lit(0).alias("failed"), F.lit(0).alias("timed_out"), zero("results"))
    reads = asked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("verified").alias("verified"))
    facts = ready.select("doc_id", "skipped_title_words", "code_words", "code_blocks").join(diagnostics, "doc_id").join(reads, "doc_id", "left").join(of, "doc_id").fillna(0, ["pages", "verified"])
    titles = search.sources(corpus).select("url", "title")
    made_reports = report.reports(ready, ranked, stylometry.ensemble(ready, profiles=profiles), titles, diagnostics.withColumn("skipped_reason", F.lit(None).cast("string")))
    made_reports = made_reports.join(of.select("doc_id", F.col("n_words").alias("word_count"), F.col("n_chunks").alias("chunks_checked")), "doc_id").join(ready.select("doc_id", "skipped_title_words"), "doc_id")
    return Scan(refused, ranked, notes_of(facts), diagnostics, made_reports, n_ready | n_found | n_ranked)
