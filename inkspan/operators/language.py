"""Language identification by ranks of character trigrams.

A language's profile are its most frequent trigrams in labelled texts, learnt by one aggregation; a text's distance to it
is the sum, over the text's own most frequent trigrams, of how far apart both ranks are, or the length of a profile for a
trigram that it doesn't hold. The language of the least distance is the text's; of equal ones the first by name.

Trigrams are taken from whole texts: lower case, whatever isn't a letter as one space, a space at both ends. Equally
frequent ones rank by code points. A text without letters has no language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Trigrams of a profile, and bits of a code point in a packed trigram.
LENGTH, BITS = 300, 21
#: Characters, or trigrams, that are counted at a time.
PART = 1 << 18


def letters(c: Column) -> Column:
    """The text that trigrams are taken from; empty if there is no letter."""
    only = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", " "))
    return F.when(only == "", "").otherwise(F.concat(F.lit(" "), only, F.lit(" ")))


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several (trigrams, counts) as one, in order."""
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(packed trigrams in order, their counts); a long text is counted in parts."""
    if len(text) > PART:
        held = trigrams(text[:PART])
        for at in range(PART - 2, len(text) - 2, PART - 2):
            held = merged([held, trigrams(text[at : at + PART])])
        return held
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(p) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((p[:-2] << 2 * BITS) | (p[1:-1] << BITS) | p[2:], return_counts=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the trigrams of each label, combined within a batch."""
    for b in batches:
        held: dict[str, list] = {}
        waiting: Counter = Counter()
        for lang, text in zip(b.column(0), b.column(1)):
            name, found = lang.as_py(), trigrams(text.as_py())
            held.setdefault(name, []).append(found)
            waiting[name] += len(found[0])
            if waiting[name] > PART:  # what is held follows from the trigrams that differ, not from the texts of a batch
                held[name] = [merged(held[name])]
                waiting[name] = 0
        for lang, found in held.items():
            grams, n = merged(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", length: int = LENGTH) -> dict[str, np.ndarray]:
    """Each language's packed trigrams, the most frequent first: at most `length` of each come to the driver."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), letters(F.col(text)).alias("t")).where("t <> ''")
    counts = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= length).orderBy("lang", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in top:
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def text_distances(text: str, known: list[tuple[np.ndarray, np.ndarray]], length: int = LENGTH) -> list[int] | None:
    """The distance to each profile, given as (sorted trigrams, their ranks)."""
    grams, n = trigrams(text)
    if not len(grams):
        return None
    top = grams[np.lexsort((grams, -n))[:length]]
    place = np.arange(len(top))
    out = []
    for sorted_, rank in known:
        at = np.minimum(np.searchsorted(sorted_, top), len(sorted_) - 1)
        out.append(int(np.where(sorted_[at] == top, np.abs(rank[at] - place), length).sum()))
    return out


def distances(text: Column, made: dict[str, np.ndarray], length: int = LENGTH) -> Column:
    """An array of the distances to the profiles, in the order of the languages' names; null without letters."""
    known = [(np.sort(g), np.argsort(g)) for _, g in sorted(made.items()) if len(g)]

    @F.pandas_udf("array<long>")
    def go(t: pd.Series) -> pd.Series:
        return t.map(lambda x: text_distances(x, known, length))

    return go(letters(text))


def identified(docs: DataFrame, made: dict[str, np.ndarray], text: str = "text", out: str = "lang") -> DataFrame:
    """`docs` with the language of each text; null without letters or profiles."""
    names = sorted(k for k, g in made.items() if len(g))
    if not names:
        return docs.withColumn(out, F.lit(None).cast("string"))
    d = docs.withColumn("__far", distances(F.col(text), made))
    least = F.array_position("__far", F.array_min("__far")).cast("int")
    return d.withColumn(out, F.get(F.array(*map(F.lit, names)), least - 1)).drop("__far")


def held_out(key: Column, parts: int = 5) -> Column:
    """A fifth of the rows, by a digest of their key, for tests."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % parts == 0
