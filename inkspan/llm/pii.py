"""Personal data by candidate gradient boosting.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. Beyond them, high-recall
generators propose spans that may overlap; boosted trees judge each by its format and context, and a threshold for each
kind, calibrated for precision on held-out examples, selects. Of selected spans that overlap, the likelier stays. The
trees learn from examples made here from a seed: forms of personal data and secrets in neutral context, against look-alikes
(order numbers, versions, sums, dates, long words).

Defined results: a null text is empty and has no spans; every row of `docs` gives one row, also with a null or repeated id;
texts without digits or "@" have no base spans; a candidate within a base span is dropped, one that reaches beyond it is judged; very long runs of one class are scanned in linear time; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.boosting import Model, train

BASE = ("email", "ip", "card", "phone")
ADDED = ("phone_local", "ssn", "iban", "secret", "email_masked")
KINDS = BASE + ADDED
PRECISION = 0.98

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
#: What the generators need, besides secrets, which any long run may be.
DIGIT, MASK = re.compile(r"[0-9]"), re.compile(r"[\[(](?:at|AT)[\])]")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

GENERATORS = {
    "phone_local": re.compile(r"(?<![0-9])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{3,4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}(?![A-Za-z0-9_+/-])"),
    # possessive, and only from the start of a run, so that runs of any length are read once
    "email_masked": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z0-9-]++)+"),
}
CUES = {"phone_local": ("phone", "tel", "call", "mobile", "fax"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank"), "secret": ("token", "key", "secret", "password", "pwd", "api"), "email_masked": ("mail", "contact", "write")}
AGAINST = ("order", "invoice", "isbn", "version", "page", "part", "item", "serial", "build", "http", "www", "ref", "id", "date")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches, from each "@" outwards."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_SET:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1) if start == at else last
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind and start."""
    if not ANY.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, g in GENERATORS.items() if kind == "secret" or (MASK if kind == "email_masked" else DIGIT).search(text) for m in g.finditer(text)]


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a span."""
    s, before, after = text[a:b], text[max(0, a - 40) : a].lower(), text[b : b + 12].lower()
    n = len(s)
    share = [sum(map(f, s)) / n for f in (str.isdigit, str.isupper, str.islower)]
    counts = np.array([s.count(c) for c in set(s)]) / n
    digits = re.sub("[^0-9]", "", s)
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:])) / n
    mod97 = 0.0
    if kind == "iban":
        plain = s.replace(" ", "")
        mod97 = float(int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    return [
        float(ADDED.index(kind)), float(n), *share, float(-(counts * np.log2(counts)).sum()), turns, float(len(digits)), mod97,
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", s))), float(any(c in before for c in CUES[kind])), float(any(c in before[-16:] for c in AGAINST)),
        float(bool(re.search(r"""[=:]\s*["']?$""", before))), float(before[-1:] in "\"'"), float(after[:1] in "\"'"), float(before[-1:].isalnum()), float("/" in s), float("(" in s), float(s.count("-")), float(s.count(" ")),
    ]


def examples(seed: int = 7, each: int = 400) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): one example span in a made context."""
    r = random.Random(seed)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda n=0: "".join(r.choice("etaoinshrdlucmfw") for _ in range(n or r.randint(2, 9)))
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))

    def iban(good: bool) -> str:
        body = digit(r.choice((14, 18, 20)))
        land = r.choice(("DE", "FR", "ES", "GB", "NL"))
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        return f"{land}{check if good else (check + r.randint(1, 90)) % 97:02d}{body}"

    alpha = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    good = {
        "phone_local": lambda: r.choice((f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}", f"{digit(3)} {digit(3)} {digit(4)}")),
        "ssn": lambda: f"{digit(3)}-{digit(2)}-{digit(4)}",
        "iban": lambda: iban(True),
        "secret": lambda: r.choice((pick("0123456789abcdef", r.choice((32, 40, 64))), pick(alpha, r.randint(24, 60)), "sk_" + pick(alpha, 32))),
        "email_masked": lambda: f"{word()}.{word()} [at] {word()} [dot] com" if r.random() < 0.5 else f"{word()}(at){word()}.org",
    }
    bad = {
        "phone_local": lambda: r.choice((f"{digit(2)}.{digit(3)}.{digit(3)}", f"{digit(2)} {digit(3)} {digit(3)}", f"{digit(4)} {digit(3)} {digit(3)}", f"{digit(2)}-{digit(3)}-{digit(3)}")),
        "ssn": lambda: f"{digit(3)} {digit(2)} {digit(4)}",
        "iban": lambda: iban(False),
        "secret": lambda: r.choice((word(r.randint(20, 40)), f"{word()}-{word()}-{word()}-{word()}-{word()}", f"{word(8)}/{word(9)}/{word(7)}/{digit(4)}", digit(r.randint(20, 30)), "-" * r.randint(20, 40), word(1).upper() + word(r.randint(20, 30)), "=".join(()) + pick("_", 24))),
        "email_masked": lambda: f"{word()} (at) {word()}.{word()}",
    }
    lead = {k: [f"{c}: ", f"{c} = \"", f"{c} ", f"my {c} is "] for k, v in CUES.items() for c in [v[0]]}
    out = []
    for kind in ADDED:
        for k in range(2 * each):
            label = k % 2
            s = (good if label else bad)[kind]()
            if label:
                intro = r.choice([f"{r.choice(CUES[kind])}: ", f"{r.choice(CUES[kind])} = \"", f"{r.choice(CUES[kind])} ", f"{word()} ", f"{word()}, "] + [lead[kind][1]] * (kind == "secret"))
            else:
                intro = r.choice([f"{r.choice(AGAINST)} ", f"{r.choice(AGAINST)}: ", f"{word()} ", f"{word()}. "])
            text = f"{word()} {word()} {intro}"
            a = len(text)
            text += s + ("\"" if intro.endswith("\"") else "") + f" {word()} {word()}"
            out += [(text, g, x, y, label if g == kind else 0) for g, x, y in candidates(text) if g == kind and x < a + len(s) and y > a]
    return out


@cache
def trained() -> tuple[Model, tuple[float, ...]]:
    """The trees, and for each added kind the least threshold with the wanted precision on held-out examples."""
    learn, check = examples(7), examples(8)
    x = np.array([describe(t, k, a, b) for t, k, a, b, _ in learn])
    trees = train(x, np.array([e[4] for e in learn], float), trees=40, depth=4)
    kind = np.array([ADDED.index(e[1]) for e in check])
    y = np.array([e[4] for e in check])
    p = trees.probability(np.array([describe(t, k, a, b) for t, k, a, b, _ in check]))
    limits = []
    for k in range(len(ADDED)):
        order = np.argsort(-p[kind == k], kind="stable")
        right, score = np.cumsum(y[kind == k][order]), p[kind == k][order]
        enough = np.flatnonzero(right / np.arange(1, len(right) + 1) >= PRECISION)
        limits.append(float(max(0.5, score[enough[-1]])) if len(enough) else 1.1)
    return trees, tuple(limits)


def find_spans(text: str | None, trees: Model, limits: tuple[float, ...]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans), each (kind, start, end)."""
    text = text or ""
    base = base_spans(text)
    found = [c for c in candidates(text) if not any(a <= c[1] and c[2] <= b for _, a, b in base)]
    if not found:
        return base, []
    p = trees.probability(np.array([describe(text, *c) for c in found]))
    added: list[tuple[int, int, int]] = []
    for q, (kind, a, b) in sorted(zip(p.tolist(), found), key=lambda x: (-x[0], x[1][1], x[1][2], x[1][0])):
        k = ADDED.index(kind)
        if q >= limits[k] and not any(x < b and a < y for _, x, y in added):
            added.append((len(BASE) + k, a, b))
    return base, sorted(added)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch], trees: Model, limits: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, digests, spans = [], [], []
        for t in b.column(1):
            base, added = find_spans(t.as_py(), trees, limits)
            counts.append([sum(k == x for k, _, _ in base) for x in range(4)])
            digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
            spans.append(_join(base + added))
        n = np.array(counts, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: counts of base kinds, the digest of the base spans, and all spans as kind:start:end."""
    trees, limits = trained()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, trees, limits), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span of the text replaced by its kind in brackets."""
    trees, limits = trained()

    @F.pandas_udf("string")
    def clean(texts):
        def one(t):
            if t is None:
                return None
            out, last = [], 0
            for k, a, b in sorted((s for part in find_spans(t, trees, limits) for s in part), key=lambda s: (s[1], -s[2])):
                if b <= last:
                    continue
                out += [t[last : max(a, last)], f"[{KINDS[k]}]"]
                last = b
            return "".join(out) + t[last:]

        return texts.map(one)

    return docs.withColumn(text_col, clean(text_col))
