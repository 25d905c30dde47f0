"""Probe phrases: the queries by which a chunk would be looked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import ALNUM, let, middle, normalize_ws, words

#: (words of a phrase, phrases, key words) of an ordinary and of a deep search.
SHAPES = {False: (10, 2, 9), True: (12, 4, 12)}


def bare(word: Column) -> Column:
    return F.regexp_replace(word, f"[^{ALNUM}'\\-]", "")


def bare_words(normal: Column) -> Column:
    """The words of a text in normal white space, each `bare`, by one search of the whole."""
    return F.split(F.regexp_replace(normal, f"[^{ALNUM}' \\-]", ""), " ")


def informative(word: Column) -> Column:
    return (F.length(word) >= 7) | word.rlike("[0-9]")


def cleaned(normal: Column) -> Column:
    """Each word of a text in normal white space without marks, in lower case, and whether it is long or holds a digit."""
    return F.transform(bare_words(F.lower(normal)), lambda c: F.struct(c.alias("c"), informative(c).alias("told")))


def phrase_score(phrase: Column) -> Column:
    """How telling a phrase's `cleaned` words are: their variety, those that are long or hold a digit, and their mean length."""

    def scored(n: Column) -> Column:
        size = F.greatest(F.lit(1), F.size(n))
        letters = F.aggregate(n, F.lit(0), lambda s, x: s + F.length(x["c"]))
        return F.size(F.array_distinct(F.transform(n, lambda x: x["c"]))) / size * 10 + F.size(F.filter(n, lambda x: x["told"])) * 1.8 + letters / size

    return let(F.filter(phrase, lambda x: x["c"] != ""), scored)


def queries_of(text: Column, deep: bool = False) -> Column:
    """The distinct queries of a chunk: its best phrases, one of each quarter, its longest words, and its middle."""
    size, phrases, keys = SHAPES[deep]
    stride = max(5, size // 2)

    def starts(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(w) - size)
        return F.sequence(F.lit(0), last, F.lit(stride))

    def phrased(w: Column, normal: Column) -> Column:
        room = F.greatest(F.lit(1), F.size(w) - size)
        one = lambda s, c: let(F.slice(w, s + 1, size), lambda p: F.struct((-phrase_score(F.slice(c, s + 1, size))).alias("minus"), s.alias("s"), F.least(F.lit(3), F.floor(s / room * 4).cast("int")).alias("bucket"), F.array_join(p, " ").alias("phrase"), F.size(p).alias("n")))
        every = let(cleaned(normal), lambda c: F.transform(starts(w), lambda s: one(s, c)))
        return let(F.filter(every, lambda x: x["n"] >= min(7, size)), picked)

    def picked(every: Column) -> Column:
        of = lambda b: F.array_min(F.filter(every, lambda x: x["bucket"] == b))
        best = F.array_compact(F.array(*[of(b) for b in range(4)]))
        return let(F.array_sort(F.transform(best, lambda x: F.struct(x["minus"].alias("minus"), x["bucket"].alias("bucket"), x["phrase"].alias("phrase")))), single)

    def single(best: Column) -> Column:
        names = F.transform(best, lambda x: F.lower(x["phrase"]))
        first = F.filter(best, lambda x, i: F.array_position(names, F.lower(x["phrase"])) == i + 1)
        return F.transform(F.slice(first, 1, phrases), lambda x: F.concat(F.lit('"'), x["phrase"], F.lit('"')))

    def keyed(normal: Column) -> Column:
        own = F.array_distinct(F.filter(bare_words(normal), informative))
        order = F.array_sort(F.transform(own, lambda x, i: F.struct((-F.length(x)).alias("m"), i.alias("i"), x.alias("x"))))
        return F.array_join(F.transform(F.slice(order, 1, keys), lambda t: t["x"]), " ")

    def every(w: Column, normal: Column) -> Column:
        found = F.concat(phrased(w, normal), F.array(keyed(normal), F.concat(F.lit('"'), middle(w), F.lit('"'))))
        return F.array_distinct(F.filter(found, lambda q: F.length(F.trim(F.replace(q, F.lit('"'), F.lit("")))) > 20))

    made = lambda normal: let(words(normal, True), lambda w: F.when(F.size(w) > 0, every(w, normal)).otherwise(F.array().cast("array<string>")))
    return let(normalize_ws(text), made)


def search_queries(parts: DataFrame, deep: bool = False, text: str = "chunk_text") -> DataFrame:
    """(doc_id, chunk_index, place, query)."""
    return parts.select("doc_id", "chunk_index", F.posexplode(queries_of(F.col(text), deep)).alias("place", "query"))
