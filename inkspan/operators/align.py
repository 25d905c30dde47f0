"""Diffs and alignments of text pairs; dynamic programs over the two sides of one row, in Arrow batches."""

from __future__ import annotations

import bisect
import difflib
import re
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: LONG: characters from which a pair is parted before it is compared.
LONG, CELLS, GAP = 50_000, 4_000_000, 0.65
TOKEN = regex.compile(r"\s+|[\p{L}\p{M}\p{N}]+(?:['’.-][\p{L}\p{M}\p{N}]+)*|[^\s]")
WORDY, PARAGRAPH_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]"), regex.compile(r"[\p{L}\p{N}]{2,}")


def _opcodes(x: list[str], y: list[str]) -> list[tuple]:
    """Opcodes as of SequenceMatcher for long lists: tokens that both sides have once part them, until what lies between is small."""
    same, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and x[i] == y[k]:
            same.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and x[j - 1] == y[m - 1]:
            j, m = j - 1, m - 1
            same.append((j, m))
        if i == j or k == m:
            continue
        chain = _anchors(x, y, i, j, k, m) if (j - i) * (m - k) > CELLS else []
        if chain:
            for p, q in [*chain, (j, m)]:
                todo.append((i, p, k, q))
                i, k = p + 1, q + 1
            same += chain
        else:  # small, or nothing parts it
            same += [(i + p + t, k + q + t) for p, q, n in difflib.SequenceMatcher(None, x[i:j], y[k:m], autojunk=False).get_matching_blocks() for t in range(n)]
    out, i, k = [], 0, 0
    for p, q in [*sorted(same), (len(x), len(y))]:
        if i < p or k < q:
            out.append(("other", i, p, k, q))
        if p < len(x):
            if out and out[-1][0] == "equal":
                out[-1] = ("equal", out[-1][1], p + 1, out[-1][3], q + 1)
            else:
                out.append(("equal", p, p + 1, q, q + 1))
        i, k = p + 1, q + 1
    return out


def _anchors(x: list[str], y: list[str], i: int, j: int, k: int, m: int) -> list[tuple[int, int]]:
    """The longest rising chain of places of tokens that occur once on either side."""
    once = [{t for t, n in Counter(part).items() if n == 1} for part in (x[i:j], y[k:m])]
    place = {t: q for q, t in enumerate(y[k:m], k) if t in once[0] and t in once[1]}
    tops, last, chain = [], [], []
    for p in range(i, j):
        if (q := place.get(x[p])) is not None:
            at = bisect.bisect_left(tops, q)
            node = (p, q, last[at - 1] if at else None)
            tops[at : at + 1], last[at : at + 1] = [q], [node]
    node = last[-1] if last else None
    while node:
        chain.append(node[:2])
        node = node[2]
    return chain[::-1]


def diff_parts(a: str, b: str) -> list[dict]:
    """Word-level parts, each kept, added or removed; they give back both texts."""
    a, b = a or "", b or ""
    x, y = (re.findall(r"\s+|\w+|[^\w\s]", t) for t in (a, b))
    out = []
    for op, i, j, k, m in _opcodes(x, y) if max(len(a), len(b)) > LONG else difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out.append({"value": "".join(x[i:j]), "kind": "same"})
            continue
        out += [{"value": "".join(x[i:j]), "kind": "removed"}] * (i < j) + [{"value": "".join(y[k:m]), "kind": "added"}] * (k < m)
    return out


def word_diff(pairs: DataFrame) -> DataFrame:
    @F.pandas_udf("array<struct<value:string,kind:string>>")
    def go(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diff_parts(x, y) for x, y in zip(a, b)])

    return pairs.withColumn("parts", go("original", "revised"))


def part_tokens(text: str) -> list[str]:
    """Runs of white space, words with inner marks, and single other characters."""
    return TOKEN.findall(text)


def _kind(t: str) -> int:
    return 0 if t.isspace() else 1 if WORDY.match(t) else 2


def _codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the tokens, all white space being one, and their kinds."""
    ids: dict[str, int] = {}
    x, y = ([ids.setdefault(" " if t.isspace() else t, len(ids)) for t in side] for side in (a, b))
    return (*(np.array(v, np.int64) for v in (x, y)), *(np.array([_kind(t) for t in side], np.int64) for side in (a, b)))


def _directions(n: int, m: int, gap: float, diagonal) -> np.ndarray:
    """Which way each cell of the edit table comes from: 1 both, 2 the first side, 3 the second, in that order of choice.

    Cells of one anti-diagonal depend on the two before only, so each is a few array operations; diagonal(i, j) gives the
    costs of pairing items i with items j.
    """
    way = np.zeros((n + 1, m + 1), np.uint8)
    way[1:, 0], way[0, 1:] = 2, 3
    before, last = np.zeros(n + 1), np.zeros(n + 1)  # costs by row, of the two anti-diagonals before
    for d in range(1, n + m + 1):
        now = np.full(n + 1, np.inf)
        if d <= m:
            now[0] = d * gap
        if d <= n:
            now[d] = d * gap
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        if len(i):
            j = d - i
            both, drop, add = before[i - 1] + diagonal(i - 1, j - 1), last[i - 1] + gap, last[i] + gap
            pick = np.where((both <= drop) & (both <= add), 1, np.where(drop <= add, 2, 3)).astype(np.uint8)
            way[i, j] = pick
            now[i] = np.where(pick == 1, both, np.where(pick == 2, drop, add))
        before, last = last, now
    return way


def align_tokens(a: list[str], b: list[str]) -> list[int]:
    """For each token of b the place in a that it belongs to, an added one where the one before does; proportional beyond CELLS cells."""
    n, m = len(a), len(b)
    if (n + 1) * (m + 1) > CELLS:
        return [min(n - 1, k * n // m) for k in range(m)] if n else [0] * m
    if not n:
        return [0] * m
    x, y, kx, ky = _codes(a, b)
    way = _directions(n, m, 1.0, lambda i, j: np.where(x[i] == y[j], 0, np.where(kx[i] == ky[j], 1, 2)))
    out, i, j = [-1] * m, n, m
    while i or j:
        if way[i, j] == 1:
            i, j = i - 1, j - 1
            out[j] = i
        elif way[i, j] == 2:
            i -= 1
        else:
            j -= 1
    last = -1
    for k, p in enumerate(out):
        last = out[k] = p if p >= 0 else last
    following = n - 1
    for k in range(m - 1, -1, -1):
        following = out[k] = out[k] if out[k] >= 0 else following
    return out


def distribute(parts: list[str], revised: str) -> list[str]:
    """A revised text dealt out to the parts of the original, token by token."""
    own = [(t, k) for k, part in enumerate(parts) for t in part_tokens(part)]
    tokens = part_tokens(revised)
    places = align_tokens([t for t, _ in own], tokens)
    out = [""] * len(parts)
    for t, p in zip(tokens, places):
        if out:
            out[own[p][1] if own else 0] += t
    return out


def align_paragraphs(a: list[str], b: list[str]) -> list[str]:
    """For each paragraph of a its revision from b, or an empty text; by place if there are equally many.

    An added paragraph goes to the place before it, where a paragraph's own revision then replaces it, as in the reference.
    """
    if len(a) == len(b):
        return list(b)
    if not a:
        return []
    x, y = ([set(PARAGRAPH_WORD.findall(t.lower())) for t in side] for side in (a, b))
    n, m = len(a), len(b)
    apart = np.array([[1 - len(p & q) / max(len(p), len(q)) if p and q else 1.0 for q in y] for p in x], float).reshape(n, m)
    way = _directions(n, m, GAP, lambda i, j: apart[i, j])
    out, i, j = [""] * n, n, m
    while i or j:
        if way[i, j] == 1:
            i, j = i - 1, j - 1
            out[i] = b[j]
        elif way[i, j] == 2:
            i -= 1
        else:
            j -= 1
            to = max(0, i - 1)
            out[to] = f"{b[j]}\n{out[to]}" if out[to] else b[j]
    return out


def paragraph_alignment(pairs: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def go(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align_paragraphs(list(x), list(y)) for x, y in zip(a, b)])

    return pairs.withColumn("aligned", go("original", "revised"))


def distribution(pairs: DataFrame) -> DataFrame:
    """pairs(original array<string>, revised string) with the column parts, as many as in the original."""

    @F.pandas_udf("array<string>")
    def go(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distribute(list(x), y or "") for x, y in zip(a, b)])

    return pairs.withColumn("parts", go("original", "revised"))
