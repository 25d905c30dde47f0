"""A local search engine: the probe queries of chunks against a positional inverted index of sources.

A source's terms are its lower-case runs of letters and digits. A query scores a source by the terms they share: each
counts its rarity (idf, in thousandths) times the binary digits of its count in the source. A query in quotation marks
finds only sources that hold its terms in a row; of any other the best sources are wanted, whatever terms they share.

- Phrases are looked up by their rarest term: its places give the starts that are possible, and the other terms are
  looked up by (term, source) and tested at their own places. So a frequent term costs what the rarest one leaves.
- For word queries sources are dealt into blocks, and the index knows the greatest count of each term in each block.
  That bounds every source of a block; the blocks with the highest bounds are scored first, and of the others only
  those that could still reach the k-th score found. The result is that of scoring all.

Equal queries are searched once. Sources are numbered by their URL without fragment and trailing slash; of rows with one
URL the first by content counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions.text import count_words, url_key
from inkspan.operators import probe, report
from inkspan.operators.match import scored_text
from inkspan.operators.sequence import Settings, chunk_plan
from inkspan.sources.tables import kept

#: Sources of a block, and blocks of a query that are scored before the others are bounded.
BLOCK_SOURCES, FIRST_BLOCKS = 64, 4


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass
class Index:
    """postings(term, source, block, count, places), words(term, df, idf), blocks(term, block, most); count and most in binary digits."""

    postings: DataFrame
    words: DataFrame
    blocks: DataFrame


def sources(corpus: DataFrame) -> DataFrame:
    """The first row of each URL, by content, with its key `source`."""
    first = F.min_by(F.struct(*corpus.columns), F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in ("title", "snippet", "source_text", "url")]))
    return corpus.groupBy(url_key(F.col("url")).alias("source")).agg(first.alias("row")).select("source", "row.*")


def build(corpus: DataFrame, block_sources: int = BLOCK_SOURCES) -> Index:
    """An index of corpus(title, url, snippet, source_text) over the text that is scored."""
    texts = kept(sources(corpus).select("source", terms(scored_text()).alias("t")), "sources")
    n = texts.count()
    block = F.pmod(F.xxhash64("source"), F.lit(-(-n // block_sources) or 1)).cast("int")
    each = texts.select("source", F.posexplode("t").alias("place", "term")).groupBy("term", "source")
    postings = each.agg(F.array_sort(F.collect_list("place")).alias("places")).select("term", "source", block.alias("block"), F.length(F.bin(F.size("places").cast("long"))).alias("count"), "places")
    postings = kept(postings, "postings")
    words = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    words = words.withColumn("idf", F.round(F.log(1 + F.lit(n) / F.col("df")) * 1000).cast("long"))
    return Index(postings, kept(words, "terms"), postings.groupBy("term", "block").agg(F.max("count").alias("most")))


def phrase_sources(index: Index, phrases: DataFrame) -> DataFrame:
    """phrases(query, offset, term), a row for each term of each phrase -> (query, source) of sources with all terms in a row."""
    known = phrases.join(index.words.select("term", "df"), "term", "left")
    facts = known.groupBy("query").agg(F.count(F.lit(1)).alias("size"), F.count("df").alias("found"), F.min(F.struct("df", "offset", "term")).alias("rare"))
    rare = facts.where("size = found").select("query", "size", F.col("rare.offset").alias("at"), F.col("rare.term").alias("term"))
    starts = rare.join(index.postings.select("term", "source", "places"), "term")
    starts = starts.select("query", "size", "at", "source", F.explode(F.transform("places", lambda p: p - F.col("at"))).alias("start")).where("start >= 0")
    alone = starts.where("size = 1").select("query", "source")
    others = starts.join(phrases, "query").where("offset <> at").select("query", "size", "source", "start", "offset", "term")
    met = others.join(index.postings.select("term", "source", "places"), ["term", "source"]).where(F.array_contains("places", F.col("start") + F.col("offset")))
    whole = met.groupBy("query", "source", "start", "size").agg(F.count(F.lit(1)).alias("met")).where("met = size - 1").select("query", "source")
    return whole.unionByName(alone).distinct()


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query").orderBy(F.desc("score"), "source")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_sources(index: Index, wanted: DataFrame, k: int, first: int = FIRST_BLOCKS) -> DataFrame:
    """wanted(query, term, idf), distinct -> (query, source, score, rank): the k best sources of each query, by blocks."""
    bounds = wanted.join(index.blocks, "term").groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
    bounds = bounds.withColumn("turn", F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), "block")))

    def scored(some: DataFrame) -> DataFrame:
        hits = some.select("query", "block").join(wanted, "query").join(index.postings.select("term", "block", "source", "count"), ["term", "block"])
        return hits.groupBy("query", "source").agg(F.sum(F.col("idf") * F.col("count")).alias("score"))

    bounds = kept(bounds, "bounds")
    begun = kept(scored(bounds.where(F.col("turn") <= first)), "begun")
    reached = _best(begun, k).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    rest = bounds.where(F.col("turn") > first).join(reached, "query", "left").where("least IS NULL OR bound >= least")
    return _best(begun.unionByName(scored(rest)), k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """queries(query) -> (query, source, score, rank): the k best sources of each distinct query."""
    q = queries.select("query").distinct().withColumn("exact", F.col("query").startswith('"'))
    each = kept(q.select("query", "exact", F.posexplode(terms(F.col("query"))).alias("offset", "term")), "asked")
    wanted = kept(each.select("query", "exact", "term").distinct().join(index.words.select("term", "idf"), "term"), "wanted")
    held = phrase_sources(index, each.where("exact").drop("exact"))
    phrased = held.join(wanted.where("exact").drop("exact"), "query").join(index.postings.select("term", "source", "count"), ["term", "source"])
    phrased = _best(phrased.groupBy("query", "source").agg(F.sum(F.col("idf") * F.col("count")).alias("score")), k)
    return phrased.unionByName(top_sources(index, wanted.where("NOT exact").drop("exact"), k))


def modes(docs: DataFrame, parts: DataFrame, deep: bool) -> DataFrame:
    """(doc_id, n_words, n_chunks, long, very_long, search_limit, query_limit, page_limit) of documents with chunks; of one id the longest counts."""
    per = parts.groupBy("doc_id").agg(F.countDistinct("chunk_index").alias("n_chunks"))
    words = docs.groupBy("doc_id").agg(F.max(count_words(F.col("text"))).alias("n_words"))
    return _with_modes(words.join(per, "doc_id"), deep)


def planned_modes(docs: DataFrame, s: Settings) -> DataFrame:
    """The `modes` of documents by the chunks that their words make, without cutting or reading any."""
    n = docs.select("doc_id", count_words(F.col("text")).alias("n")).withColumn("c", F.when(F.col("n") > 0, chunk_plan(F.col("n"), s)["last"] + 1))
    # rows of one id number their chunks alike, so as many differ as the row with the most of them has
    m = n.groupBy("doc_id").agg(F.max("n").alias("n_words"), F.max("c").cast("long").alias("n_chunks")).where("doc_id IS NOT NULL AND n_chunks > 0")
    return _with_modes(m, s.sensitivity == "deep")


def _with_modes(m: DataFrame, deep: bool) -> DataFrame:
    m = m.withColumn("m", report.document_mode(F.col("n_words"), F.col("n_chunks"), deep))
    return m.select("doc_id", "n_words", "n_chunks", "m.long", "m.very_long", "m.search_limit", "m.query_limit", "m.page_limit")


def chunk_queries(parts: DataFrame, modes_: DataFrame, deep: bool) -> DataFrame:
    """(doc_id, chunk_index, place, query, search_limit): the queries that a document's length allows."""
    every = probe.search_queries(parts, deep).join(modes_.select("doc_id", "query_limit", "search_limit"), "doc_id")
    return every.where(F.col("place") < F.coalesce("query_limit", F.lit(5 if deep else 3))).drop("query_limit")


def chunk_candidates(index: Index, queries: DataFrame, deep: bool = False) -> DataFrame:
    """(doc_id, chunk_index, place, source, score): each chunk's candidates.

    The results of its queries, 7 of each in a deep search and `search_limit` else, are interleaved by rank, the first of
    each source stays, and of these at most 18 or 10, and `search_limit`.
    """
    found = search(index, queries, 7 if deep else 8)
    rows = queries.withColumnRenamed("place", "turn").join(found, "query")
    if not deep:
        rows = rows.where("rank <= search_limit")
    first = rows.groupBy("doc_id", "chunk_index", "source").agg(F.min(F.struct("rank", "turn", "score")).alias("f"), F.max("search_limit").alias("search_limit"))
    listed = report.limited(first, ["doc_id", "chunk_index"], ["f"], deep, F.col("search_limit"))
    return listed.select("doc_id", "chunk_index", "place", "source", "f.score")
