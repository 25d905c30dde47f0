"""Text functions as column expressions. Lengths are code points; equal to UTF-16 units within the BMP."""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import or_
from re import _parser as parsing
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the ECMAScript `\\s`, in a form that Java and RE2 read alike.
WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Its characters.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same class for Java alone: a character below its rare members is told by one range and one set of bits, not by each member.
BLANK = r"[[\x{1680}-\x{feff}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]]\t\n\x0B\f\r \x{00a0}]"
#: Runs of white space that aren't one space: the first character tells most positions apart.
RUNS = f"{BLANK}(?:(?<! ){BLANK}*|{BLANK}+)"
#: Inside of a class: letters and digits, the ASCII ones as a set of bits.
ALNUM = ascii_letters + digits + r"[\x{80}-\x{10ffff}&&[\p{L}\p{N}]]"
#: The stop words.
STOP_WORDS = "але або для про при що це цей ця цих так які який яка було були бути the and that with from this have are was were".split()
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's variable isn't inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The class of Cyrillic letters, for Java and for Python.
CYRILLIC, CYRILLIC_PY = r"[\x{400}-\x{4ff}]", "[\u0400-\u04ff]"
#: The word boundary of ASCII words, and its class, as ECMAScript has them; Java's own follows Unicode.
WORD = "[0-9A-Za-z_]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def java(pattern: str) -> str:
    r"""A pattern with `\b` and `\s` in the ECMAScript sense, for Java."""
    # a digit is told before what stands around it
    return pattern.replace(r"[\s\S]", "(?s:.)").replace(r"\b\d", rf"(?=\d)(?<!{WORD})\d").replace(r"\b", EDGE).replace(r"\s", BLANK)


def trim_ws(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def normalize_ws(c: Column) -> Column:
    """Runs of white space become one space; the ends are trimmed. Single spaces, by far the most, are left alone."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), RUNS, " "))


def words(c: Column, normal: bool = False) -> Column:
    """The space-separated words of a text, none for a blank one. `normal`: its white space is normal already."""
    split = lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))
    return split(c) if normal else let(normalize_ws(c), split)


def count_normal(c: Column) -> Column:
    """The words of a text whose white space is normal."""
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def count_words(c: Column) -> Column:
    """Runs of other characters than white space."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"[^{BLANK[1:]}++"))


def tokens(c: Column, keep_stop: bool = False) -> Column:
    """Lower-case tokens of letters, digits, apostrophes and hyphens, longer than two characters."""
    # every character that doesn't belong to a token parts it, and so does white space: one split does both
    out = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), f"[^{ALNUM}'\\-]+"), lambda t: F.length(t) > 2)
    return out if keep_stop else F.filter(out, lambda t: ~t.isin(STOP_WORDS))


def sentences(c: Column, normal: bool = False) -> Column:
    return F.filter(F.transform(F.split(c if normal else normalize_ws(c), " (?<=[.!?…] )"), lambda s: F.trim(s)), lambda s: s != "")


def clamp_score(x: Column) -> Column:
    """Rounded half up and held between 0 and 100; null counts as 0."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.round(x), F.lit(0)))).cast("int")


def stable_hash(s: Column) -> Column:
    """FNV-1a of 32 bits over characters, as a long."""
    chars = F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return F.aggregate(chars, F.lit(FNV_START).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(F.lit(MASK).cast("bigint")))


def ngrams(t: Column, k: int) -> Column:
    """Sliding runs of k tokens joined by spaces, repeats included; none if there are fewer."""

    def runs(x: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(x) - (k - 1)), lambda i: F.concat_ws(" ", *[F.get(x, i + (j - 1)) for j in range(k)]))
        return F.when(F.size(x) >= k, each).otherwise(F.array().cast("array<string>"))  # `slice` copies the whole array each time

    return let(t, runs)


def found(c: Column, pattern: str) -> Column:
    """All matches of a pattern without regard to case, in normal white space."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("(?iu)" + pattern), F.lit(0)), normalize_ws), lambda x: x != "")


def folded(c: Column) -> Column:
    """A text in which what a pattern finds without regard to case stands in lower case: each character's upper case's lower case."""
    # letters that a case mapping of whole strings treats otherwise: the dotted capital I, and rare forms of Cyrillic ones
    rare = "\u0130" + "".join(map(chr, range(0x1C80, 0x1C89)))
    plain = F.when(c.rlike(r"[\x{130}\x{1c80}-\x{1c88}]"), F.translate(c, rare, "iвдосттъѣꙋ")).otherwise(c)
    return F.lower(F.upper(plain))


@cache
def literals(pattern: str) -> tuple[str, ...] | None:
    """Lower-case strings of which every match of a pattern holds one, the longest that can be told; None if it can't be."""

    def of(items) -> set[str] | None:
        """The best of what the items of a sequence need: the longest least string, then the fewest strings."""
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is parsing.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append({run})
                run = ""
            if op is parsing.SUBPATTERN:
                found.append(of(value[-1]))
            elif op is parsing.BRANCH:
                each = [of(b) for b in value[1]]
                found.append(set().union(*each) if all(each) else None)
            elif op in (parsing.MAX_REPEAT, parsing.MIN_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
            elif op is parsing.IN:
                found.append({chr(v) if k is parsing.LITERAL else str(d) for k, v in value for d in (range(10) if k is parsing.CATEGORY else "x")} if all(k is parsing.LITERAL or v is parsing.CATEGORY_DIGIT for k, v in value) else None)
        return max(filter(None, found), key=lambda x: (min(map(len, x)), -len(x)), default=None)

    # letters of any kind stand for no literal, and a class is as good as a range of them
    need = of(parsing.parse(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")))
    return tuple(sorted({n.lower() for n in need})) if need else None


def cyrillic(low: Column) -> Column:
    """A text with Cyrillic letters; empty for any other, which a length in bytes tells of most."""
    return F.when((F.octet_length(low) > F.length(low)) & low.rlike(CYRILLIC), low).otherwise("")


def may_match(low: Column, pattern: str, cyr: Column | None = None) -> Column:
    """Whether a folded text holds what a pattern needs; most texts don't, and need no search for it.

    With `cyr`, the `cyrillic` of that text, strings with Cyrillic letters aren't looked for in texts without.
    """
    need = literals(pattern)
    return reduce(or_, [(low if cyr is None or not re.search(CYRILLIC_PY, n) else cyr).contains(n) for n in need]) if need else F.lit(True)


def sample_evidence(values: Column, most: int = 4) -> Column:
    """The first distinct values, of 120 characters each at most."""
    return F.slice(F.array_distinct(F.transform(values, lambda x: F.substring(x, 1, 120))), 1, most)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of a's distinct elements that b has; 0 if a has none."""
    return let(F.array_distinct(a), lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, b)) / F.size(x)).otherwise(F.lit(0.0)))


def middle(w: Column, size: int = 22) -> Column:
    return F.array_join(F.when(F.size(w) <= size, w).otherwise(F.slice(w, F.floor(F.size(w) / 2).cast("int") - size // 2 + 1, F.lit(size))), " ")


def search_excerpt(c: Column, size: int = 22) -> Column:
    return let(words(c), lambda w: middle(w, size))


def url_key(c: Column) -> Column:
    """A URL without its fragment and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/$", "")


def extracted_text(c: Column) -> Column:
    """Extracted text: LF line ends, single spaces, no more than one blank line, trimmed."""
    t = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), WS.replace(r"\n", "") + "+", " ")
    return F.trim(trim_ws(F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n")))


def repaired_name(c: Column) -> Column:
    """A file name whose UTF-8 bytes were read as Latin-1: each character's low byte, as UTF-8, what isn't valid replaced."""
    low = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.lpad(F.hex(F.ascii(x).bitwiseAND(F.lit(255))), 2, "0"))
    return F.when(c.rlike(r"[ÐÑÒÃÂ]|\x{fffd}"), F.make_valid_utf8(F.unhex(F.array_join(low, "")).cast("string"))).otherwise(c)


def redirect_target(c: Column) -> Column:
    """The address that a redirecting URL carries, or the URL."""
    return F.coalesce(F.try_url_decode(F.parse_url(c, F.lit("QUERY"), F.lit("uddg"))), c)


def grouped_number(c: Column) -> Column:
    """A whole number with no-break spaces between its groups of three digits."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("\u00a0"))


def report_key(text: Column, sensitivity: Column) -> Column:
    return F.concat(F.sha2(text, 256), F.lit(":"), sensitivity)


def search_key(provider: Column, query: Column, most: Column) -> Column:
    return F.concat_ws("::", provider, query, most.cast("string"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def risk_label(c: Column) -> Column:
    return F.when(c >= 70, "high").when(c >= 38, "medium").otherwise("low")


def error_sentence(c: Column) -> Column:
    """What a failed request is told as: by its kind, else the first 180 characters of its message."""
    kind = lambda p: c.rlike("(?i)" + p)
    # The report's sentences.
    told = (
        F.when(kind("rate.?limit|429"), "модель тимчасово обмежена лімітом запитів")
        .when(kind("out of credits|quota"), "у провайдера закінчилася квота")
        .when(kind("aborted|timeout"), "модель не відповіла вчасно")
        .when(kind("empty response"), "модель повернула порожню відповідь")
    )
    return F.coalesce(told.otherwise(F.substring(c, 1, 180)), F.lit(""))


def timed_out(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)abort|timeout"), F.lit(False))
