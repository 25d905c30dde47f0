"""Rewriting of formulaic prose by ordered rules, each a fold of replacements, with a count for every rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import ALNUM, count_words, cyrillic, folded, java, let, may_match, normalize_ws, trim_ws

A, Z = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
L, R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# Fixed values: (rule, ((pattern, replacement), ...)), in order. A rule with several outcomes has one pattern for each.
RULES = (
    ("chat", ((A + r"(?:great question|of course|certainly|i hope this helps|let me know if you(?:'|’)d like|here is an?|let'?s dive in|let'?s explore)" + Z + r"[.!?\s]*", ""),)),
    ("copula", ((A + "(?:serves as|stands as|acts as)" + Z, "is"),)),
    ("intro", ((A + "(?:it is important to note that|it is worth noting that)" + Z, ""), (A + "in order to" + Z, "to"), (A + "at this point in time" + Z, "now"), (A + "due to the fact that" + Z, "because"))),
    ("adverts", tuple((A + w + Z, r) for w, r in (("crucial|pivotal", "important"), ("vibrant", "active"), ("groundbreaking|innovative", "new"), ("transformative|valuable", "useful"), ("seamless", "simple"), ("robust", "stable"), ("comprehensive", "broad"), ("unique", "specific")))),
    ("templates", (
        (r"на основі проведеного аналізу встановлено,?\s*що", "аналіз показав, що"), (r"отримані результати дозволяють зробити висновок,?\s*що", "це дозволяє стверджувати, що"),
        (r"(?:варто зазначити,?\s*що|слід зазначити,?\s*що|важливо підкреслити,?\s*що|доцільно зазначити,?\s*що|необхідно зауважити,?\s*що|цікаво відзначити,?\s*що)", ""),
    )),
    ("aims", ((r"метою\s+(?:роботи|дослідження)\s+є", "Мета:"), (r"завданнями\s+(?:роботи|дослідження)\s+є", "Завдання:"), (r"актуальність\s+(?:обраної\s+)?теми\s+(?:полягає|зумовлена)\s+(?:у\s+тому,?\s*що|тим,?\s*що|у)", "Тема актуальна через те, що"), (r"предметом\s+дослідження\s+є", "Предмет дослідження:"), (r"об['’]єктом\s+дослідження\s+є", "Об'єкт дослідження:"), (r"робота\s+складається\s+з", "Структура роботи:"))),
    ("voice", ((L + r"у\s+(?:цій\s+)?роботі\s+розглянуто" + R, "робота описує"), (L + r"у\s+(?:цій\s+)?роботі\s+проаналізовано" + R, "робота аналізує"), (L + r"у\s+(?:цій\s+)?роботі\s+досліджено" + R, "робота досліджує"))),
    ("adjectives", ((L + r"(?:важлив(?:ий|а|е|і)|ключов(?:ий|а|е|і)|унікальн(?:ий|а|е|і)|інноваційн(?:ий|а|е|і))\s+(?:комплексн(?:ий|а|е|і)|ефективн(?:ий|а|е|і))\s+(підхід|аспект|блок|рішення|система|процес)" + R, "$1"),)),
    ("verbs", ((L + "сприяє підвищенню" + R, "підвищує"), (L + "забезпечує можливість" + R, "дає змогу"), (L + "розкриває потенціал" + R, "показує можливості"))),
    ("value", ((L + r"(?:(?:важливе|значне)\s+)?практичне значення" + R, "практична користь"), (L + r"(?:(?:важливе|значне)\s+)?теоретичне значення" + R, "теоретична користь"))),
    ("parallel", ((r"не\s+(?:лише|тільки)\s+([^,.]{3,90}?),\s*а\s+й\s+", "$1 і "),)),
    ("format", ((r"\*\*|__|[🚀✅💡🔥⭐️✨]", ""),)),
    ("synonyms", ((L + "(?:даний|вищезазначений|вищевказаний)" + R, "цей"), (L + "(?:дана|вищезазначена|вищевказана)" + R, "ця"), (L + "дане" + R, "це"))),
)


def paragraphs(c: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), "\n{2,}")
    return F.filter(F.transform(parts, normalize_ws), lambda p: p != "")


SOFT = ((r"([.!?])\s+(?:Отже|Таким чином),?\s+", "$1 Отже: "), (r"([.!?])\s+(?:Furthermore|Moreover|Additionally|Therefore|Крім того),?\s+", "$1 "))
VAGUE = L + "(?:експерти вважають|дослідження показують|багато джерел|experts argue|observers note|studies show|research suggests)" + R
SENTENCE = r"[^.!?]+[.!?]+|[^.!?]+$"


def sentence_key(sentence: Column) -> Column:
    # whatever is no letter, digit or # becomes one space; single spaces, by far the most, are left alone
    other = f"[^{ALNUM}#]"
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "[0-9]+", "#"), f"{other}(?:(?<! ){other}*|{other}+)", " "))


def without_repeats(paragraph: Column) -> Column:
    """Struct (text, count): a paragraph without later copies of its sentences of seven words or more."""
    every = F.transform(F.regexp_extract_all(paragraph, F.lit(SENTENCE), F.lit(0)), lambda x: trim_ws(x))
    every = F.when(F.size(every) > 0, every).otherwise(F.array(trim_ws(paragraph)))

    def kept(pair: Column) -> Column:
        keep = F.filter(pair["s"], lambda x, i: (F.size(F.split(F.get(pair["k"], i), " ")) < 7) | (F.array_position(pair["k"], F.get(pair["k"], i)) == i + 1))
        return let(keep, lambda x: F.struct(F.array_join(x, " ").alias("text"), (F.size(pair["s"]) - F.size(x)).alias("count")))

    return let(let(every, lambda x: F.struct(x.alias("s"), F.transform(x, sentence_key).alias("k"))), kept)


def tidy(paragraph: Column) -> Column:
    # in normal white space, where only single spaces stand
    p = F.regexp_replace(normalize_ws(paragraph), " ([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(p, ", ?,", ","))


def rewrite(docs: DataFrame) -> DataFrame:
    """(doc_id, revised, changes, original_words, revised_words, vague): texts of at least twenty words.

    changes has the count of every rule that changed something, in the rules' order; vague counts claims without a source.
    """
    # a filter on the count would be pushed down and the paragraphs made once more
    long_enough = lambda o: let(count_words(o), lambda n: F.when(n >= 20, F.array(F.struct(o.alias("original"), n.alias("original_words")))))
    d = docs.select("doc_id", F.explode(let(F.array_join(paragraphs(F.col("text")), "\n\n"), long_enough)).alias("x")).select("doc_id", "x.*")
    # most texts lack what a pattern needs; the folded text, which tells that, is made anew whenever a rule has changed something
    d = d.withColumn("t", F.col("original")).withColumn("low", folded(F.col("t"))).withColumn("cyr", cyrillic(F.col("low")))
    counts = []
    steps = [(name, [("(?iu)(?:" + p + ")", to) for p, to in parts]) for name, parts in RULES] + [("transitions", SOFT)]
    for name, parts in steps:
        n = F.lit(0)
        for k, (p, to) in enumerate(parts):
            able, p, hits = may_match(F.col("low"), p.removeprefix("(?iu)"), F.col("cyr")), java(p), F.col(f"n_{name}_{k}")
            d = d.withColumn(f"n_{name}_{k}", F.when(able, F.regexp_count("t", F.lit(p))).otherwise(0))
            d = d.withColumn("t", F.when(hits > 0, F.regexp_replace("t", p, to)).otherwise(F.col("t")))
            d = d.withColumn("low", F.when(hits > 0, folded(F.col("t"))).otherwise(F.col("low")))
            d = d.withColumn("cyr", F.when(hits > 0, cyrillic(F.col("low"))).otherwise(F.col("cyr")))
            n = n + hits
        counts.append((name, n))
    d = d.withColumn("parts", F.filter(F.transform(F.split("t", "\n{2,}"), without_repeats), lambda p: p["text"] != ""))
    counts.append(("repeats", F.aggregate("parts", F.lit(0), lambda s, p: s + p["count"])))
    changes = F.filter(F.array(*[F.struct(F.lit(name).alias("rule"), n.alias("count")) for name, n in counts]), lambda x: x["count"] > 0)
    revised = F.array_join(F.filter(F.transform("parts", lambda p: tidy(p["text"])), lambda p: p != ""), "\n\n")
    d = d.withColumn("revised", revised)
    return d.select("doc_id", "revised", changes.alias("changes"), "original_words", count_words(F.col("revised")).alias("revised_words"), F.regexp_count("original", F.lit("(?iu)" + VAGUE)).alias("vague"))
