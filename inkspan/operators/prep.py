"""Preparation: code lines, title pages, reference tails, long quotations."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import count_normal, count_words, java, let, normalize_ws, trim_ws

# What marks a line of code, a title page, a body, a bibliography.
CODE_LINES = (
    r"^\s*(?:import\s+.+\s+from\s+|export\s+(?:default\s+)?(?:function|class|const|let|var)\b)",
    r"^\s*(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*(?:=|:)",
    r"^\s*(?:function\s+[A-Za-z_$][\w$]*\s*\(|class\s+[A-Za-z_$][\w$]*(?:\s+extends\s+[A-Za-z_$][\w$]*)?\s*\{|(?:interface|type|enum)\s+[A-Za-z_$][\w$]*\s*(?:\{|=))",
    r"^\s*(?:return\b|if\s*\(|else\s*\{|for\s*\(|while\s*\(|switch\s*\(|case\s+.+:|try\s*\{|catch\s*\()",
    r"^\s*(?:(?:public|private|protected)\s+(?:async\s+)?[A-Za-z_$][\w$]*\s*(?:\(|:|=)|def\s+[A-Za-z_][\w]*\s*\(|from\s+[\w.]+\s+import\s+|(?:package|using|namespace)\s+[\w.]+)",
    r"(?i)^\s*(?:end\s+(?:sub|function|with)|(?:private|public)\s+(?:sub|function)\s+\w+|(?:sub|function)\s+\w+\s*\(|dim\s+\w+(?:\s+as\b|\s*=)|set\s+\w+\s*=|call\s+\w+\s*\(|next\b|loop\b)",
    r"^\s*[{}()\[\];,.<>/]*\s*$",
    r"(?i)^\s*</?[a-z][^>]*>\s*$",
    r"^\s*[\"']?[A-Za-z0-9_$-]+[\"']?\s*:\s*[\"'{\[\d]",
    r"^\s*[.#]?[A-Za-z0-9_-]+\s*\{",
)
#: How every pattern of a line of code begins.
START = r"^\s*"
FENCE = r"^\s*```"
ASSIGNMENT = r"=>|===|!==|==|!=|\+\+|--|\.\w+\(|:\s*(?:string|number|boolean|unknown|void)\b"
SURE = r"\b(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=|=>|===|!==|\.\w+\(|^\s*(?:import|export|function|class|def)\b"
INLINE = (
    r"(?i)\b(?:end\s+sub|private\s+sub|public\s+sub|end\s+function|private\s+function|public\s+function)\b",
    r"(?i)\b(?:console\.log|document\.querySelector|addEventListener|return\s+false|return\s+true)\b",
    r"\b(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*(?:=|:\s*(?:string|number|boolean|unknown|object)\b)",
    r"\bfunction\s+[A-Za-z_$][\w$]*\s*\([^)]{0,80}\)",
    r"\b(?:class|interface)\s+[A-Za-z_$][\w$]*\s*(?:extends\s+[A-Za-z_$][\w$]*\s*)?\{",
    r"\btype\s+[A-Za-z_$][\w$]*\s*=",
    r"\b(?:[a-z_$][\w$]*\.[a-z_$][\w$]*|[a-z]+(?:[A-Z][A-Za-z0-9_$]*)+|[a-z_$][\w$]*_[a-z_$][\w$]*)\s*\([^)]{0,80}\)\s*(?:=>|\{)?",
)
#: What a text must hold, in lower case, for each of these to match: all of the groups, any of a group. Most texts need no search.
NEEDS = ((("sub", "function"),), (("console.log", "document.queryselector", "addeventlistener", "return"),), (("const", "let", "var"), ("=", ":")), (("function",), ("(",)), (("class", "interface"), ("{",)), (("type",), ("=",)), (("(",),))
TITLE = (r"міністерство\s+освіти", r"заклад\s+вищої\s+освіти", "університет", "кафедра", r"курсова\s+робота", r"кваліфікаційна\s+робота", "виконав(?:ець|ла|)", "керівник", "студент(?:ка|)")
BODY = r"(?iu)(?<![\p{L}\p{N}_])(вступ|розділ\s*1|розділ\s*i|chapter\s*1|introduction)(?![\p{L}\p{N}_])"
TAIL_FIRST = "(?=[сСᲃбБrRbB])"
TAIL = r"(?iu)(?<![\p{L}\p{N}_])(?:список\s+(?:використаних\s+)?джерел|бібліографія|references|bibliography)(?![\p{L}\p{N}_])"
LONG_QUOTE = r"[\"“„«][^\"”»]{40,}[\"”»]"


def code_line(line: Column) -> Column:
    return let(trim_ws(line), lambda t: _code_line(line, t))


def _code_line(line: Column, t: Column) -> Column:
    dense = F.regexp_count(t, F.lit(r"[{}()\[\];=<>`|]")) / F.greatest(F.lit(1), F.length(t)) > 0.16
    # what all patterns begin with stands before them, so they are tried at a line's start only; an assignment at its own characters only
    any_ = "|".join(f"(?i:{p[4:].removeprefix(START)})" if p.startswith("(?i)") else f"(?:{p.removeprefix(START)})" for p in CODE_LINES)
    return (t != "") & (line.rlike(java(f"{START}(?:{any_})")) | t.rlike(java(f"(?=[=!+.:-])(?:{ASSIGNMENT})")) | (dense & ~t.rlike("[А-Яа-яІіЇїЄєҐґ]{3,}")))


def prose_lines(raw: Column) -> Column:
    """Struct (text, code_words, blocks): without fenced code and runs of code lines, joined by spaces.

    A run of code lines goes if it has two lines or a sure one, so a line's neighbours tell what happens to it.
    """

    def parted(lines: Column) -> Column:
        fences = F.transform(lines, lambda x, i: F.when(x.rlike(java(FENCE)), i))
        code = F.transform(lines, lambda x: ~x.rlike(java(FENCE)) & code_line(x))
        return let(F.struct(lines.alias("lines"), fences.alias("fences"), code.alias("code")), judged)

    def judged(d: Column) -> Column:
        fences = F.filter(d["fences"], lambda x: x.isNotNull())
        return let(F.struct(d["lines"].alias("lines"), fences.alias("fences"), d["code"].alias("code")), marked)

    def marked(d: Column) -> Column:
        inside = lambda i: F.size(F.filter(d["fences"], lambda p: p <= i)) % 2 == 1
        code = F.transform(d["code"], lambda c, i: c & ~inside(i))
        return let(F.struct(d["lines"].alias("lines"), d["fences"].alias("fences"), code.alias("code"), F.transform(d["lines"], lambda x, i: inside(i)).alias("inside")), dropped)

    def dropped(d: Column) -> Column:
        at = lambda i: F.coalesce(F.get(d["code"], i), F.lit(False))
        goes = F.transform(d["lines"], lambda x, i: at(i) & (at(i - 1) | at(i + 1) | x.rlike(java(SURE))))
        return let(F.struct(*[d[n].alias(n) for n in ("lines", "fences", "code", "inside")], goes.alias("goes")), joined)

    def joined(d: Column) -> Column:
        fence = lambda i: F.array_contains(d["fences"], i)
        kept = F.filter(d["lines"], lambda x, i: ~fence(i) & ~F.get(d["inside"], i) & ~F.get(d["goes"], i))
        gone = F.filter(d["lines"], lambda x, i: ~fence(i) & (F.get(d["inside"], i) | F.get(d["goes"], i)))
        runs = F.size(F.filter(F.transform(d["goes"], lambda g, i: g & ~F.coalesce(F.get(d["code"], i - 1), F.lit(False))), lambda x: x))
        blocks = runs + F.ceil(F.size(d["fences"]) / 2).cast("int")
        return F.struct(F.array_join(kept, " ").alias("text"), count_words(F.array_join(gone, " ")).alias("code_words"), blocks.alias("blocks"))

    return let(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), "\r\n", "\n"), "\n"), parted)


def without_inline(d: Column) -> Column:
    """Struct (text, code_words, blocks) without the code within its lines; each step binds its text once."""

    def step(pattern: str, needs: tuple):
        def go(x: Column) -> Column:
            able = reduce(and_, [reduce(or_, [x["low"].contains(n) for n in any_of]) for any_of in needs])
            found = F.when(able, F.regexp_extract_all(x["text"], F.lit(java(pattern)), F.lit(0))).otherwise(F.array().cast("array<string>"))

            def cut(hits: Column) -> Column:
                left = F.when(F.size(hits) > 0, F.regexp_replace(x["text"], java(pattern), " ")).otherwise(x["text"])
                words = F.aggregate(F.transform(hits, count_words), F.lit(0), lambda s, h: s + h)
                return F.struct(left.alias("text"), x["low"].alias("low"), (x["code_words"] + words).alias("code_words"), x["blocks"].alias("blocks"))

            return let(found, cut)

        return go

    out = let(d, lambda x: F.struct(x["text"].alias("text"), F.lower(x["text"]).alias("low"), x["code_words"].alias("code_words"), x["blocks"].alias("blocks")))
    for pattern, needs in zip(INLINE, NEEDS):
        out = let(out, step(pattern, needs))
    return let(out, lambda x: F.struct(normalize_ws(x["text"]).alias("text"), x["code_words"].alias("code_words"), x["blocks"].alias("blocks")))


def with_prose(d: DataFrame, text: str) -> DataFrame:
    """`d` with prose, code_words and code_blocks: code lines and then code within lines are taken out."""
    d = d.withColumn("parted", without_inline(prose_lines(F.col(text))))
    return d.withColumn("prose", F.col("parted.text")).withColumn("code_words", F.col("parted.code_words")).withColumn("code_blocks", F.col("parted.blocks")).drop("parted")


def prose(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, code_words, code_blocks), one row per row of `docs`."""
    return with_prose(docs.select("doc_id", F.col(text).alias("raw")), "raw").select("doc_id", F.col("prose").alias("text"), "code_words", "code_blocks")


def document_text(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, kept columns, text, skipped_title_words, code_words, code_blocks): prose without the title page."""
    d = with_prose(docs.select("doc_id", *keep, F.col("text").alias("raw")), "raw").withColumn("body", without_title(F.col("prose")))
    skipped = count_words(F.substr("prose", F.lit(1), F.length("prose") - F.length("body")))
    return d.select("doc_id", *keep, F.col("body").alias("text"), skipped.alias("skipped_title_words"), "code_words", "code_blocks")


def without_title(c: Column) -> Column:
    head = F.substring(c, 1, 5000)
    marks = sum(head.rlike("(?iu)" + m).cast("int") for m in TITLE)
    at = F.regexp_instr(head, F.lit(BODY)) - 1
    rest = F.substr(c, at + 1)
    return F.when((marks >= 2) & (at > 40) & (F.length(rest) > 120), rest).otherwise(c)


def without_tail(c: Column) -> Column:
    """Cut at the first bibliography marker, unless it stands in the first 45 % of the text."""
    at = F.regexp_instr(c, F.lit(TAIL_FIRST + TAIL)) - 1
    return F.when((at >= 0) & (at >= F.length(c) * 0.45), F.substring(c, F.lit(1), at)).otherwise(c)


def may_quote(c: Column) -> Column:
    return reduce(or_, [c.contains(mark) for mark in LONG_QUOTE[1:].replace("\\", "").split("]")[0]])


def without_quotes(c: Column) -> Column:
    return F.when(may_quote(c), F.regexp_replace(c, LONG_QUOTE, " ")).otherwise(c)


def analysis_text(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, kept columns, text, analyzed_words, code_words, quoted_words, reference_words): what style is judged by."""
    d = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("t0")).withColumn("t1", without_tail(F.col("t0"))).withColumn("t2", without_quotes(F.col("t1")))
    quotes = F.when(may_quote(F.col("t1")), F.regexp_extract_all("t1", F.lit(LONG_QUOTE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    quoted = F.aggregate(F.transform(quotes, count_words), F.lit(0), lambda s, x: s + x)
    tail = F.substr("t0", F.length("t1") + 1)
    d = with_prose(d, "t2").withColumn("quoted_words", quoted).withColumn("reference_words", count_words(tail))
    return d.select("doc_id", *keep, F.col("prose").alias("text"), count_normal(F.col("prose")).alias("analyzed_words"), "code_words", "quoted_words", "reference_words")
