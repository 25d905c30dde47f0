"""Chunks, windows and winnowed fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import let, ngrams, stable_hash, words


@dataclass(frozen=True)
class Settings:
    """Scan settings with their bounds; thresholds and limits follow from the sensitivity."""

    chunk_words: int = 120
    overlap_words: int = 32
    sensitivity: str = "balanced"

    def __post_init__(self) -> None:
        object.__setattr__(self, "chunk_words", min(520, max(70, self.chunk_words)))
        object.__setattr__(self, "overlap_words", min(180, max(0, self.overlap_words)))

    @property
    def threshold(self) -> int:
        return {"quick": 38, "balanced": 32, "deep": 24}[self.sensitivity]


def full_coverage(n: Column, s: Settings = Settings()) -> Column:
    """Struct of chunk_words, overlap, step and max_chunks that cover n words."""
    cw = F.when(n > 20000, 520).when(n > 10000, 460).when(n > 5000, 380).when(n > 2000, max(s.chunk_words, 240)).otherwise(s.chunk_words)
    ov = F.least(F.floor(cw * 0.18), F.greatest(F.lit(s.overlap_words), F.when(n > 5000, 56).otherwise(32))).cast("int")
    step = F.greatest(F.lit(60), cw - ov)
    most = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), n - ov) / step)).cast("int")
    return F.struct(cw.alias("chunk_words"), ov.alias("overlap"), step.cast("int").alias("step"), most.alias("max_chunks"))


def chunk_plan(n: Column, s: Settings = Settings()) -> Column:
    """Struct (cw, step, last): the words of a chunk, how far apart chunks begin, and the last one's index, for n words."""

    def steps(p: Column) -> Column:
        cw = F.greatest(F.lit(80), p["chunk_words"])
        step = cw - F.least(p["overlap"], F.floor(cw / 2).cast("int"))
        last = F.greatest(F.lit(0), F.ceil((n - cw) / step)).cast("int")
        return F.struct(cw.alias("cw"), step.alias("step"), F.least(last, p["max_chunks"] - 1).alias("last"))

    return let(full_coverage(n, s), steps)


def chunks(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, word_count, chunk_text): overlapping runs of words up to the last word."""
    base = docs.select("doc_id", words(F.col(text)).alias("w")).where("size(w) > 0").withColumn("n", F.size("w"))
    base = base.withColumn("p", chunk_plan(F.col("n"), s)).select("doc_id", "w", "p.*")
    out = base.select("doc_id", "w", "cw", "step", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * F.col("step") + 1, F.col("cw"))
    return out.select("doc_id", "chunk_index", F.size(part).alias("word_count"), F.array_join(part, " ").alias("chunk_text"))


SIZE, OVERLAP = 220, 55


def window_starts(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Starts of windows over n words, 0-based; the last window ends with the text."""
    step = max(80, size - overlap)
    regular = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0)), F.lit(step)), lambda x: x + size < n)
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(n - size))))


def analysis_windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """(doc_id, window_index, start_word, end_word, window_text), 1-based, the last window ending with the text."""
    base = docs.select("doc_id", words(F.col(text)).alias("w")).where("size(w) > 0").withColumn("n", F.size("w"))
    out = base.select("doc_id", "w", "n", F.posexplode(window_starts(F.col("n"), size, overlap)).alias("window_index", "s"))
    return out.select("doc_id", "window_index", (F.col("s") + 1).alias("start_word"), F.least(F.col("s") + size, F.col("n")).alias("end_word"), F.array_join(F.slice("w", F.col("s") + 1, size), " ").alias("window_text"))


def winnow(t: Column, gram: int = 5, window: int = 4) -> Column:
    """The set of fingerprints: the rightmost least hash of every window of gram hashes."""

    def least(h: Column) -> Column:
        w = F.least(F.lit(window), F.size(h))
        each = F.transform(F.sequence(F.lit(1), F.size(h) - w + 1), lambda i: F.least(*[F.get(h, i + (j - 1)) for j in range(window)]))
        return F.when(F.size(h) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(ngrams(t, gram), stable_hash), least)
