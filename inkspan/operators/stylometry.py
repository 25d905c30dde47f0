"""Stylometric risk: one plan scores whole documents and their windows, then an ensemble per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions.text import ALNUM, STOP_WORDS, clamp_score, cyrillic, folded, found, java, let, may_match, ngrams, normalize_ws, sample_evidence, sentences, tokens, words
from inkspan.operators.language import identified
from inkspan.operators.prep import analysis_text
from inkspan.operators.sequence import SIZE, window_starts
from inkspan.sources.tables import kept

EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# Word lists, pattern groups (name, channel, weight, patterns), channel weights.
TRANSITIONS = "therefore however moreover furthermore additionally consequently overall важливо отже проте однак таким загалом водночас натомість по-перше по-друге насамкінець".split()
HEDGES = "may might could typically often може ймовірно зазвичай часто можливо потенційно".split()
GROUPS = (
    ("lexicon", "pattern", 0.7, (
        "crucial|pivotal|vibrant|valuable|seamless|robust|innovative|transformative|groundbreaking|comprehensive|meticulous|unwavering|versatile|alignment|synergy",
        "delve|leverage|utilize|enhance|underscore|showcase|foster|facilitate|optimize|navigate the complexities|tapestry of|testament to|evolving landscape|rapidly changing",
        "(?:ключов(?:ий|а|е|і)|важлив(?:ий|а|е|і)|комплексн(?:ий|а|е|і)|ефективн(?:ий|а|е|і)|інноваційн(?:ий|а|е|і))[^.!?]{0,70}(?:підхід|рішення|роль|значення|розвиток|система)",
        "підкреслює|відіграє ключову роль|розкриває потенціал|важливо розуміти|варто відмітити|варто зауважити|вимагає уваги",
    )),
    ("links", "pattern", 0.85, (
        "moreover|furthermore|additionally|nevertheless|in conclusion|to summarize|it is important to note|it is worth noting|lastly|first and foremost|on the other hand|consequently",
        "варто зазначити|слід зазначити|важливо підкреслити|таким чином|у підсумку|на завершення|з огляду на це|по-перше|зокрема|з іншого боку|крім того|водночас",
    )),
    ("syntax", "structure", 1.15, (
        r"not only\b[\s\S]{0,90}\bbut also",
        r"it's not just\b[\s\S]{0,90}\bit'?s",
        r"(?:не лише|не тільки)[\s\S]{0,90}(?:а й|але й)",
        "по-перше|по-друге|по-третє",
        "firstly|secondly|thirdly",
        r"\d\.\s.*\d\.\s.*\d\.\s",
    )),
    ("academic", "pattern", 0.55, (
        r"у\s+роботі\s+(?:розглянуто|проаналізовано|досліджено|визначено|узагальнено)",
        r"метою\s+(?:роботи|дослідження)\s+є|завданнями\s+(?:роботи|дослідження)\s+є|робота\s+складається\s+з",
        r"актуальність\s+(?:обраної\s+)?теми\s+(?:полягає|зумовлена)|предметом\s+дослідження\s+є|об['’]єктом\s+дослідження\s+є",
        r"на\s+основі\s+проведеного\s+аналізу|отримані\s+результати\s+дозволяють|доцільно\s+зазначити",
    )),
    ("leak", "pattern", 1.5, (
        "як штучний інтелект|я не можу|моя база знань|до моменту мого останнього оновлення|as an ai|as an artificial intelligence|i cannot|i don'?t have access|my knowledge cutoff",
        "важливо пам'ятати|важливо зазначити|однак варто пам'ятати|необхідно враховувати|слід зауважити|it is important to remember|it is crucial to note",
        "в епоху цифрових технологій|у сучасному світі|стрімкий розвиток|безперечно|підсумовуючи|бути свідченням|беззаперечно|яскравий приклад",
    )),
)
IMPERSONAL = "розглянуто|проаналізовано|досліджено|визначено|встановлено|узагальнено|систематизовано|обґрунтовано|виявлено|сформовано|запропоновано|охарактеризовано"
CITATION = r"\[[0-9]{1,3}\]|\([A-ZА-ЯІЇЄҐ][\p{L}'-]+,\s*20[0-9]{2}\)|https?://\S+|doi:\s*\S+"
NUMBER = r"\b\d+(?:[.,]\d+)?\s*(?:%|грн|uah|usd|км|м|року|р\.|рік|years?)?\b"
FIRST_PERSON = "я|мені|мою|моє|ми|наш|наша|i|my|we|our"
QUOTE = r"[\"“„«][^\"”»]{12,}[\"”»]"
PLACEHOLDER = "lorem ipsum|consectetur adipiscing|suspendisse potenti"
STRUCTURE = r"зміст|вступ|розділ\s+(?:[0-9]+|[ivx]+)|висновки|список\s+використаних\s+джерел"
HEADING = r"^(?:зміст|вступ|висновки|список використаних джерел|розділ\s+(?:[0-9]+|[ivx]+)(?:\s+.+)?|introduction|conclusion|references|chapter\s+(?:[0-9]+|[ivx]+)(?:\s+.+)?)$"
#: What every heading begins with, whatever its case.
HEADING_FIRST = "(?iu)^(?:зміст|вступ|висновки|список|розділ|introduction|conclusion|references|chapter)"
#: What the report calls each signal.
LABELS = {
    "rhythm": "Рівномірність речень (Low Burstiness)", "lexical": "Лексична одноманітність", "transition": "Часті формальні переходи", "hedge": "Обережні формулювання",
    "starts": "Повтори на початку речень", "impersonal": "Безособовий стиль", "punctuation": "Одноманітна пунктуація", "lexicon": "AI-лексика і канцелярит", "links": "Шаблонні переходи та зв'язки",
    "syntax": "Роботична структура та синтаксис", "academic": "Шаблон академічної генерації", "leak": "Prompt-leak та ШІ-відмови", "safeguard": "Запобіжники від false positive",
    "segments": "Сегментна узгодженість AI-ознак", "excluded": "Вилучений неавторський вміст",
}
#: Fixed values: (signal, least score, what is said from there on, what is said below); {cv}, {mattr} and {n} are filled in. For pattern groups it's the number of matches that counts.
DETAILS = (
    ("rhythm", 50, 'Текст має надто рівномірну структуру речень (CV: {cv}). Людський текст зазвичай чергує довгі й короткі речення, ШІ пише "гладко".', "Варіативність довжини речень виглядає природною."),
    ("lexical", 50, "Локальна різноманітність словника низька або є повторювані фрази (MATTR: {mattr}%).", "Локальна різноманітність словника не виглядає підозрілою (MATTR: {mattr}%)."),
    ("transition", 40, "Висока концентрація слів-зв'язок (тому, однак, крім того), що часто використовуються мовними моделями для логічної 'склейки'.", "Перехідні слова у нормі."),
    ("hedge", 40, "У тексті часто повторюються модальні або обережні слова; ця ознака враховується лише разом з іншими сигналами.", "Обережні формулювання не домінують."),
    ("starts", 40, "Виявлено шаблони у початку речень. ШІ схильний починати кілька речень поспіль однаковими конструкціями.", "Початки речень різноманітні."),
    ("impersonal", 45, "Стиль написання відсторонений та надто об'єктивізований. Хоча це типово для науки, надмірна кількість таких слів — маркер ШІ.", "Стиль подачі не виглядає шаблонно-академічним."),
    ("punctuation", 25, "Пунктуація надто проста або рівна. Людські автори частіше використовують дужки, крапки з комою, тире або окличні знаки (подвійні дефіси не рахуються).", "Пунктуаційний малюнок не виглядає шаблонним."),
)
GROUP_DETAIL = "Знайдено {n} маркерів. Вони часто зустрічаються у згенерованих текстах.", "Явних маркерів цієї групи не знайдено."
SAFEGUARD_DETAIL = "Контекстні фактори, що знижують надійність автоматичного висновку, але не доводять людське авторство."
#: The sentences for the reasons of a verdict's reliability, those of a language by its percentage, and what is added for what was left out.
REASONS = {
    "short": "Після вилучення коду, цитат і службових частин лишилося замало авторського тексту для стилометричного висновку.", "unsteady": "Текст надто короткий для стійкого стилометричного висновку.",
    "mixed-origin": "Сегменти сильно відрізняються між собою; документ може мати змішане походження або різні жанри.", "few-segments": "Для перевірки доступно мало незалежних сегментів.",
    "agreed": "Обсяг достатній, а сегментні оцінки узгоджені.", "moderate": "Оцінка має помірну доказовість і потребує ручної перевірки сигналів.",
}
LANGUAGE_REASONS = {0: "У тексті недостатньо мовного матеріалу для визначення покриття.", 30: "Російська мова має обмежену підтримку та не рекомендується для аналізу.", 35: "Мовне покриття детектора обмежене; результат слід читати як невизначений сигнал."}
LEFT_OUT = " Неавторський або технічний вміст вилучено: {n} слів."
CHANNELS = {"statistical": 0.38, "pattern": 0.42, "structure": 0.20}
#: Fixed values: (signal, channel, weight) of the drafts that aren't pattern groups.
DRAFTS = (("rhythm", "statistical", 1.0), ("lexical", "statistical", 0.8), ("transition", "pattern", 0.85), ("hedge", "pattern", 0.45), ("starts", "structure", 0.75), ("impersonal", "pattern", 0.95), ("punctuation", "structure", 0.5))


def matches(c: Column, pattern: str, low: Column | None = None, cyr: Column | None = None) -> Column:
    """How often a pattern matches, whatever the case. With the folded text, texts without its literals aren't searched."""
    n = F.regexp_count(c, F.lit("(?iu)" + java(pattern)))
    return n if low is None else F.when(may_match(low, _core(pattern), cyr), n).otherwise(0)


def bounded(pattern: str) -> str:
    return f"{EDGE_L}(?:{pattern}){EDGE_R}"


def _core(pattern: str) -> str:
    return pattern.removeprefix(EDGE_L).removesuffix(EDGE_R)


def holds(c: Column, pattern: str, low: Column, cyr: Column | None = None) -> Column:
    return may_match(low, _core(pattern), cyr) & c.rlike("(?iu)" + pattern)


def parted(low: Column) -> Column:
    """The words of a folded text, bounded as `bounded` bounds them."""
    return F.split(low, f"[^{ALNUM}_]+")


def among(parts: Column, names: str) -> Column:
    """The words of a parted text that are among the names."""
    return F.filter(parts, lambda w: w.isin(names.split("|")))


def listed(low: Column, names: str) -> Column:
    """The words of a folded text that are among the names."""
    return among(parted(low), names)


def token_runs(c: Column) -> Column:
    """`tokens` with stop words, for short texts: a pattern of runs is compiled once a task, one of a split for every text."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{ALNUM}'\\-]{{3,}}+"), F.lit(0))


def repeated_grams(content: Column, k: int = 4) -> Column:
    """How many runs of k tokens are repetitions. If all their hashes differ so do they; only else they are compared themselves."""

    def extra(c: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(c) - (k - 1)), lambda i: F.xxhash64(*[F.get(c, i + (j - 1)) for j in range(k)]))
        again = let(ngrams(c, k), lambda g: F.size(g) - F.size(F.array_distinct(g)))
        return F.when(F.size(c) <= k, 0).when(let(hashes, lambda h: F.size(h) == F.size(F.array_distinct(h))), 0).otherwise(again)

    return let(content, extra)


def mattr(t: Column, size: int = 50) -> Column:
    """Mean share of distinct tokens in windows of `size`; one that ends with the text is added, even if it is there already."""
    return let(t, lambda x: _mattr(x, size))


def _mattr(t: Column, size: int) -> Column:
    n = F.size(t)
    starts = F.concat(F.filter(F.sequence(F.lit(1), n, F.lit(size // 2)), lambda i: i + size - 1 <= n), F.array(n - size + 1))
    ratios = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(t, i, size))) / size)
    mean = let(ratios, lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / F.size(r))
    return F.when(n == 0, F.lit(0.0)).when(n <= size, F.size(F.array_distinct(t)) / n).otherwise(mean)


def variation(lengths: Column) -> Column:
    """Population deviation over mean; 1 for fewer than two values or a mean of zero."""
    n = F.size(lengths)
    mean = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / n
    var = let(mean, lambda m: F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n)
    return F.when((n < 2) | (mean == 0), F.lit(1.0)).otherwise(F.sqrt(var) / mean)


def repeats(a: Column) -> tuple[Column, Column]:
    """(elements that occur twice or more, with repeats; the same less one for each distinct), by sorting once."""
    again = let(F.sort_array(a), lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1) == x)) | ((i < F.size(s) - 1) & (F.get(s, i + 1) == x))))
    return F.size(again), let(again, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def filled(sentence: str, **values: Column) -> Column:
    """A sentence with its {names} replaced."""
    out = F.lit(sentence)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string")) if "{" + name + "}" in sentence else out
    return out


def reason_text(code: Column, percent: Column, word_count: Column, excluded: Column) -> Column:
    """The sentence for a reason of `ensemble`, and how many words were left out of a text that isn't too short."""
    told = F.when(code == "language", F.coalesce(*[F.when(percent == p, t) for p, t in LANGUAGE_REASONS.items()]))
    for name, sentence in REASONS.items():
        told = told.when(code == name, sentence)
    return F.concat(told, F.when((excluded > 0) & (word_count >= 80), filled(LEFT_OUT, n=excluded)).otherwise(""))


def drafts() -> list[tuple[str, str, float]]:
    return [*DRAFTS, *((n, c, w) for n, c, w, _ in GROUPS)]


def single_pass(units: DataFrame, text: str = "text", evidence: bool = False) -> DataFrame:
    """`units` with word_count, the score of every signal, safeguard, probability and the signals of 12 or more.

    With `evidence` also what each signal rests on, as columns e_<signal>, and what is said of it, as d_<signal>.
    """
    d = units.withColumn("norm", normalize_ws(F.col(text))).withColumn("sents", sentences(F.col("norm"), True))
    # a sentence's end parts tokens, so those of the text are those of its sentences
    d = d.withColumn("sent_words", F.transform("sents", token_runs)).withColumn("words", F.flatten("sent_words")).withColumn("content", F.filter("words", lambda w: ~w.isin(STOP_WORDS)))
    d = d.withColumn("wc", F.size("words")).withColumn("low", folded(F.col("norm")))
    # hardly a sentence begins like a heading
    heading = lambda s: s.rlike(HEADING_FIRST) & F.trim(F.regexp_replace(F.lower(s), "[.!?:;]+$", "")).rlike("(?iu)" + HEADING) & (F.size(tokens(s, True)) <= 8)
    d = d.withColumn("heads", F.transform("sents", heading)).withColumn("prose", F.filter("sents", lambda s, i: ~F.get("heads", i))).withColumn("prose_words", F.filter("sent_words", lambda s, i: ~F.get("heads", i)))
    d = d.withColumn("parted", parted(F.col("low"))).withColumn("cyr", cyrillic(F.col("low")))
    d = d.withColumn("lens", F.filter(F.transform("prose_words", lambda w: F.size(w).cast("double")), lambda n: n > 0))
    d = d.withColumn("cv", variation(F.col("lens"))).withColumn("mattr", mattr(F.col("words")))
    starts = F.filter(F.transform("prose_words", lambda w: F.array_join(F.slice(w, 1, 3), " ")), lambda s: F.length(s) > 4)
    d = d.withColumn("start_list", starts).withColumn("extra", repeated_grams(F.col("content")))
    same_starts, _ = repeats(F.col("start_list"))
    wc = F.col("wc")
    share = lambda names: F.size(F.filter("words", lambda w: w.isin(list(names)))) / F.greatest(F.lit(1), wc)
    marks = F.size(F.array_distinct(F.regexp_extract_all(F.regexp_replace("norm", "--|—|–", ""), F.lit(r"[;:!?()\[\]]"), F.lit(0))))
    d = d.withColumn("gram_score", clamp_score(F.col("extra") / F.greatest(F.lit(1.0), F.size("content") / 100) * 60)).withColumn("marks", marks)
    d = d.withColumns({
        "rhythm": clamp_score((1 - F.least(F.lit(1.0), F.col("cv") / 0.55)) * 100 * F.when(F.size("prose") >= 4, 1.0).otherwise(0.6)),
        "lexical": clamp_score(F.greatest(F.lit(0.0), F.lit(0.82) - F.col("mattr")) * 190 + F.col("gram_score") * 0.45),
        "transition": clamp_score(share(TRANSITIONS) * 3500),
        "hedge": clamp_score(share(HEDGES) * 3500),
        "starts": clamp_score(same_starts / F.greatest(F.lit(1), F.size("start_list")) * 170),
        "impersonal": clamp_score(F.least(F.lit(1.0), F.size(among(F.col("parted"), IMPERSONAL)) / F.greatest(F.lit(1.0), wc / 240) / 2.4) * 100),
        "punctuation": F.when((F.size("sents") >= 6) & (F.col("marks") <= 1), 25).otherwise(0),
        "placeholder": holds(F.col("norm"), PLACEHOLDER, F.col("low")),
    } | {f"m_{name}": sum(matches(F.col("norm"), p, F.col("low"), F.col("cyr")) for p in patterns) for name, _, _, patterns in GROUPS})
    d = d.withColumns({name: clamp_score(F.least(F.lit(1.0), F.col(f"m_{name}") / F.greatest(F.lit(1.0), wc / 100) / 2.0) * 100) for name, *_ in GROUPS})
    count = lambda p: matches(F.col("norm"), p, F.col("low"))
    d = d.withColumns({"n_cite": count(CITATION), "n_number": count(NUMBER), "n_first": F.size(among(F.col("parted"), FIRST_PERSON)), "n_quote": count(QUOTE), "structured": holds(F.col("norm"), bounded(STRUCTURE), F.col("low"), F.col("cyr"))})
    d = d.withColumn("safeguard", clamp_score(
        F.col("n_cite") * 12 + F.least(F.lit(20.0), F.col("n_number") * 2.5) + F.least(F.lit(15.0), F.col("n_first") * 3.5) + F.col("n_quote") * 10
        + F.when(wc < 180, 15).otherwise(0) + F.when(F.col("placeholder"), 85).otherwise(0) + F.when(F.col("structured"), 25).otherwise(0)
    ))
    names = drafts()
    for channel in CHANNELS:
        own = [F.when(F.col(n) > 0, F.col(n) * min(1.15, max(0.45, w))) for n, c, w in names if c == channel]
        top = F.reverse(F.array_sort(F.filter(F.array(*own), lambda x: x.isNotNull())))
        d = d.withColumn(f"c_{channel}", clamp_score(sum(F.coalesce(F.get(top, F.lit(k)), F.lit(0.0)) * w for k, w in enumerate((0.55, 0.30, 0.15)))))
    scores = F.array(*[F.col(n) for n, _, _ in names])
    strong, weak = F.reverse(F.array_sort(F.filter(scores, lambda x: x >= 30))), F.size(F.filter(scores, lambda x: x >= 12))
    d = d.withColumn("strong_list", strong).withColumn("weak", weak)
    active = sum(F.when(F.col(f"c_{c}") >= 14, 1).otherwise(0) for c in CHANNELS)
    weighted = sum(F.col(f"c_{c}") * w for c, w in CHANNELS.items())
    length = F.when(wc < 60, 0.6).when(wc < 120, 0.8).when(wc < 200, 0.95).otherwise(1.0)
    raw = weighted * F.when(active >= 3, 1.1).when(active == 2, 1.0).otherwise(0.78) * length
    raw = raw + F.greatest(F.lit(0), F.size("strong_list") - 1) * 4 + F.greatest(F.lit(0), F.col("weak") - 3) * 1.5
    best = F.slice("strong_list", 1, 3)
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x / F.greatest(F.lit(1), F.size(best)))
    floor = F.when(F.col("leak") >= 40, 45.0).when(F.size("strong_list") >= 3, F.greatest(F.lit(22.0), mean * 0.5)).when(F.col("weak") >= 5, 12.0).when(F.col("weak") >= 2, 5.0).otherwise(0.0)
    repeated = F.when(F.col("gram_score") > 60, F.col("gram_score") * 0.6).otherwise(0.0)
    d = d.withColumn("p", F.when(F.col("placeholder"), F.least(F.lit(10.0), weighted)).otherwise(F.greatest(raw, repeated, floor)))
    d = d.withColumn("probability", F.when(wc < 10, 0).otherwise(clamp_score(F.col("p"))))
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(n)).alias("minus"), F.lit(k).alias("k"), F.lit(LABELS[n]).alias("label")) for k, (n, _, _) in enumerate(names)]), lambda x: x["minus"] <= -12))
    ranked = F.transform(ranked, lambda x: F.concat(x["label"], F.lit(": "), (-x["minus"]).cast("string"), F.lit("%")))
    d = d.withColumn("ranked", F.when(wc < 10, F.array().cast("array<string>")).otherwise(ranked))
    own = _evidence(d) if evidence else {}
    return d.withColumns(own).select(*units.columns, wc.alias("word_count"), *[n for n, _, _ in names], "safeguard", F.size("strong_list").alias("strong"), "weak", "probability", "ranked", *own)


def counted(c: Column) -> Column:
    """Structs (first, x, n) of the elements that occur n >= 2 times, in the order of their first places: runs of the sorted places."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda e, i: F.when((i == 0) | (F.get(s, i - 1)["x"] != e["x"]), i)), lambda i: i.isNotNull())
        return let(heads, lambda h: F.transform(h, lambda p, k: F.struct(F.get(s, p)["i"].alias("first"), F.get(s, p)["x"].alias("x"), (F.coalesce(F.get(h, k + 1), F.size(s)) - p).alias("n"))))

    places = F.sort_array(F.transform(c, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.array_sort(F.filter(let(places, runs), lambda e: e["n"] >= 2))


def _evidence(d: DataFrame) -> dict[str, Column]:
    norm, none = F.col("norm"), F.array().cast("array<string>")
    where = lambda p: F.when(may_match(F.col("low"), _core(p), F.col("cyr")), found(norm, java(p))).otherwise(none)
    shown = lambda a: F.slice(F.transform(a, lambda e: F.concat(e["x"], F.lit(" ("), e["n"].cast("string"), F.lit("x)"))), 1, 4)
    by_count = lambda a: F.transform(F.array_sort(F.transform(a, lambda e, i: F.struct((-e["n"]).alias("m"), i.alias("i"), e.alias("e")))), lambda t: t["e"])
    rich = F.round(F.col("mattr") * 100).cast("int").cast("string")
    note = lambda when, *parts: F.when(when, F.concat(*parts))
    n = lambda c: F.col(c).cast("string")
    guards = [
        note(F.col("n_cite") > 0, n("n_cite"), F.lit(" посилань або бібліографічних маркерів")), note(F.col("n_number") >= 3, n("n_number"), F.lit(" числових/фактичних маркерів")),
        note(F.col("n_first") >= 2, n("n_first"), F.lit(" маркерів авторської позиції")), note(F.col("n_quote") > 0, n("n_quote"), F.lit(" довгих цитат")),
        note(F.col("wc") < 180, F.lit("короткий текст: нижча надійність AI-оцінки")), note(F.col("placeholder"), F.lit("lorem ipsum / шаблонний наповнювач")),
        note(F.col("structured"), F.lit("академічна структура: вступ, розділи або висновки не вважаються AI-ознакою")),
    ]
    out = {
        "rhythm": F.when(F.size("sents") >= 2, F.transform(F.slice("lens", 1, 8), lambda x: F.concat(x.cast("int").cast("string"), F.lit(" слів")))).otherwise(none),
        "lexical": F.concat(F.array(F.concat(F.lit("локальна унікальність словника "), rich, F.lit("%"))), shown(by_count(counted(F.when(F.col("extra") > 0, ngrams(F.col("content"), 4)).otherwise(none))))),
        "transition": sample_evidence(F.filter("words", lambda w: w.isin(list(TRANSITIONS)))),
        "hedge": sample_evidence(F.filter("words", lambda w: w.isin(list(HEDGES)))),
        "starts": shown(counted(F.col("start_list"))),
        "impersonal": sample_evidence(where(bounded(IMPERSONAL))),
        "punctuation": F.when(F.col("marks") > 0, F.array(F.concat(n("marks"), F.lit(" типів пунктуації")))).otherwise(none),
        "safeguard": F.array_compact(F.array(*guards)),
    } | {name: sample_evidence(F.concat(*[where(p) for p in patterns])) for name, _, _, patterns in GROUPS}
    said = {name: F.when(F.col(name) >= least, filled(high, cv=F.format_string("%.2f", "cv"), mattr=rich)).otherwise(filled(low, mattr=rich)) for name, least, high, low in DETAILS}
    said |= {name: F.when(F.col(f"m_{name}") > 0, filled(GROUP_DETAIL[0], n=F.col(f"m_{name}"))).otherwise(GROUP_DETAIL[1]) for name, *_ in GROUPS} | {"safeguard": F.lit(SAFEGUARD_DETAIL)}
    return {f"e_{k}": v for k, v in out.items()} | {f"d_{k}": v for k, v in said.items()}


def signals(units: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, place, label, category, score, detail, evidence): the visible signals of each text, the highest first, the safeguard last."""
    d = single_pass(units.select("doc_id", text), text, evidence=True)
    each = [F.struct((-F.col(n)).alias("minus"), F.lit(k).alias("k"), F.lit(LABELS[n]).alias("label"), F.lit(c).alias("category"), F.col(n).alias("score"), F.col(f"d_{n}").alias("detail"), F.col(f"e_{n}").alias("evidence")) for k, (n, c, _) in enumerate(drafts())]
    shown = F.slice(F.array_sort(F.filter(F.array(*each), lambda x: (x["score"] >= 5) | (F.size(x["evidence"]) > 0))), 1, 20)
    last = F.struct(F.lit(0).alias("minus"), F.lit(99).alias("k"), F.lit(LABELS["safeguard"]).alias("label"), F.lit("safeguard").alias("category"), F.col("safeguard").alias("score"), F.col("d_safeguard").alias("detail"), F.col("e_safeguard").alias("evidence"))
    every = F.concat(shown, F.array(last))
    # texts of fewer than ten words have no rows; a filter on the count would be pushed down and the text prepared once more
    d = d.select("doc_id", F.posexplode(F.when(F.col("word_count") >= 10, every)).alias("place", "s"))
    return d.select("doc_id", "place", "s.label", "s.category", "s.score", "s.detail", "s.evidence")


def coverage(text: Column, lang: Column) -> Column:
    """Struct (code, percent): which language a text is in, given its main language; other ones by their scripts' shares."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    total = F.greatest(F.lit(1), count(r"\p{L}{2,}"))
    cyrillic, latin = count(r"\p{IsCyrillic}{2,}") / total, count(r"\p{IsLatin}{2,}") / total
    as_ = lambda code, percent: F.struct(F.lit(code).alias("code"), (percent if isinstance(percent, Column) else F.lit(percent)).cast("int").alias("percent"))
    out = F.when(F.length(text) < 50, as_("limited", 0)).when(lang == "uk", as_("uk", 95)).when(lang == "en", as_("en", 95)).when(lang == "ru", as_("limited", 30))
    return out.when((cyrillic >= 0.18) & (latin >= 0.18), as_("mixed", F.round((cyrillic + latin) * 100))).otherwise(as_("limited", 35))


def ensemble(docs: DataFrame, lang: str = "lang", profiles: dict | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, word_count, probability, verdict, reliability, level, reason, language, percent,
    exclusions, spread, and the five most suspicious segments with their places.

    Texts are prepared first; documents and their windows are scored in one pass. With profiles the language is that of
    the prepared text by them, and `docs` needs no column of it.
    """
    return judged(analysis_text(docs, lang) if profiles is None else identified(analysis_text(docs), profiles, out=lang), lang)


def judged(prepared: DataFrame, lang: str = "lang") -> DataFrame:
    """The `ensemble` of texts that `analysis_text` has prepared."""
    made = prepared.withColumn("unit", F.monotonically_increasing_id())
    made = made.withColumn("cover", coverage(F.col("text"), F.col(lang)))
    facts = F.struct("doc_id", F.col("cover.code").alias("language"), F.col("cover.percent").alias("percent"), "code_words", "quoted_words", "reference_words")
    # the whole and the windows of a document come from one explode, so a text is prepared once; a text of one window is scored once
    n = F.size("w")
    wins = F.transform(window_starts(n), lambda st, i: F.struct(i.alias("window_index"), (st + 1).alias("start_word"), F.least(st + SIZE, n).alias("end_word"), F.array_join(F.slice("w", st + 1, SIZE), " ").alias("text")))
    all_ = F.struct(F.lit(-1).alias("window_index"), F.lit(0).alias("start_word"), F.lit(0).alias("end_word"), F.col("text").alias("text"))
    wins = F.when(n > SIZE, F.concat(F.array(all_), wins)).when(n > 0, wins).otherwise(F.array(all_))
    each = made.withColumn("w", words(F.col("text"))).select("unit", facts.alias("facts"), F.posexplode(wins).alias("at", "x"))
    each = each.select("unit", "x.*", F.when(F.col("at") == 0, F.col("facts")).alias("facts"))
    excerpt = F.when(F.length("text") > 280, F.concat(F.rtrim(F.substring("text", 1, 277)), F.lit("…"))).otherwise(F.col("text"))
    s = single_pass(each).select("unit", "window_index", "start_word", "end_word", excerpt.alias("excerpt"), "facts", "word_count", "probability", "strong", F.slice("ranked", 1, 4).alias("evidence"))
    is_doc, is_window = F.col("facts").isNotNull(), F.col("window_index") >= 0
    own = lambda c: F.max(F.when(is_doc, F.col(c)))
    seen = F.when(is_window & (F.col("probability") >= 18) & (F.size("evidence") > 0), F.struct((-F.col("probability")).alias("minus"), "window_index", "start_word", "end_word", "excerpt", "evidence"))
    placed = F.array_sort(F.collect_list(F.when(is_window, F.struct((-F.col("probability")).alias("minus"), F.col("window_index").alias("i")))))
    g = s.groupBy("unit").agg(placed.alias("placed"), own("facts").alias("facts"), own("probability").alias("doc"), own("word_count").alias("word_count"), own("strong").alias("strong"), F.array_sort(F.collect_list(F.when(is_window, F.col("probability")))).alias("ws"), F.array_sort(F.collect_list(seen)).alias("seen"))
    n = F.size("ws")
    rank = lambda r: F.get("ws", F.greatest(F.lit(0), F.ceil(n * r).cast("int") - 1))
    top = F.slice(F.reverse("ws"), 1, 3)
    mean3 = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1), F.size(top))
    low, high = F.coalesce(F.array_min("ws"), F.lit(0)), F.coalesce(F.array_max("ws"), F.lit(0))
    mixed = F.col("doc") * 0.36 + rank(0.5) * 0.14 + rank(0.75) * 0.20 + mean3 * 0.22 + F.size(F.filter("ws", lambda x: x >= 35)) / n * 100 * 0.08
    floor = F.when(high >= 35, high * 0.56).when(mean3 >= 24, mean3 * 0.48).otherwise(0.0)
    g = g.withColumn("probability", F.when(n <= 1, F.col("doc")).otherwise(clamp_score(F.greatest(mixed, floor)))).withColumn("spread", high - low)
    code, wc = F.col("facts.language"), F.col("word_count")
    scored = clamp_score(
        clamp_score(F.least(F.lit(1.0), F.greatest(F.lit(0), wc - 60) / 740) * 100) * 0.42 + clamp_score(F.least(F.lit(1.0), n / 6) * 100) * 0.2
        + clamp_score(100 - F.least(F.lit(100.0), F.col("spread") * 1.45)) * 0.23 + clamp_score(F.least(F.lit(1.0), F.col("strong") / 4) * 100) * 0.15
    )
    cap = F.when(wc < 80, 18).when(wc < 120, 30).when(wc < 240, 48).otherwise(100)
    g = g.withColumn("reliability", F.least(scored, cap, F.when(code == "limited", 28).when(code == "mixed", 58).otherwise(100)))
    g = g.withColumn("level", F.when(F.col("reliability") >= 72, "high").when(F.col("reliability") >= 45, "medium").otherwise("low"))
    reason = (
        F.when(wc < 80, "short").when(code == "limited", "language").when(wc < 120, "unsteady").when(F.col("spread") >= 45, "mixed-origin").when(n < 3, "few-segments")
        .when(F.col("level") == "high", "agreed").otherwise("moderate")
    )
    p = F.col("probability")
    lowest, highest = F.coalesce(F.array_min("ws"), p), F.coalesce(F.array_max("ws"), p)
    verdict = (
        F.when(wc < 80, "insufficient").when(code == "limited", "uncertain").when((highest >= 35) & (lowest <= 28) & (highest - lowest >= 28), "mixed").when(p >= 70, "high").when(p >= 45, "elevated")
        .when((F.col("level") == "low") | (p >= 12) | (F.size("seen") > 0), "uncertain").otherwise("low")
    )
    segments = F.transform(F.slice("seen", 1, 5), lambda x: F.struct(x["window_index"].alias("index"), x["start_word"].alias("start_word"), x["end_word"].alias("end_word"), (-x["minus"]).alias("score"), x["excerpt"].alias("excerpt"), x["evidence"].alias("evidence")))
    return g.select(F.col("facts.doc_id").alias("doc_id"), "word_count", "probability", verdict.alias("verdict"), "reliability", "level", reason.alias("reason"), code.alias("language"), "facts.percent", "facts.code_words", "facts.quoted_words", "facts.reference_words", n.alias("windows"), "spread", segments.alias("segments"), rank(0.75).alias("upper"), F.slice("placed", 1, 4).alias("strongest"))


def report_signals(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """(doc_id, place, label, category, score, evidence): the windows' agreement, the text's own signals, and what was left out; 22 at most."""
    # texts are prepared once and judged once: both ways lead from one table, and a verdict's two lines from one row
    prepared = kept(analysis_text(docs, lang), "prepared")
    own = signals(prepared).select("doc_id", (F.col("place") + 1).alias("place"), "label", "category", "score", "evidence")
    told = F.transform("strongest", lambda x: F.concat(F.lit("сегмент "), (x["i"] + 1).cast("string"), F.lit(": "), (-x["minus"]).cast("string"), F.lit("%")))
    left = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(t))) for c, t in (("code_words", " слів коду"), ("quoted_words", " слів у довгих цитатах"), ("reference_words", " слів у списку джерел"))]))
    line = lambda place, name, category, score, evidence: F.struct(F.lit(place).alias("place"), F.lit(LABELS[name]).alias("label"), F.lit(category).alias("category"), score.alias("score"), evidence.alias("evidence"))
    agreement = F.when(F.col("windows") > 1, line(0, "segments", "statistical", clamp_score(F.col("upper")), told))
    excluded = F.when(F.size(left) > 0, line(99, "excluded", "safeguard", F.lit(0), left))
    lines = judged(prepared, lang).select("doc_id", F.explode(F.array_compact(F.array(agreement, excluded))).alias("x")).select("doc_id", "x.*")
    every = own.unionByName(lines)
    return every.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("place")) - 1).where("place < 22")
