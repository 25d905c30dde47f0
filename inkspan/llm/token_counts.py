"""Word-piece counts by a linear longest-match automaton.

A trie of the vocabulary gets failure links and, for each node, the number of pieces that greedy longest-match has
certainly closed when it leaves the node by its link. One pass over a word's bytes then gives the number of pieces
without building any. Words end in an end mark, so pieces with the mark match only at an end. A word that the
vocabulary can't cover counts as one piece, the unknown one.

Defined results: a null or blank text has no words and no pieces; rows with null ids, repeated rows and very long words
count like any other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import batches_by_bytes
from inkspan.llm.words import RowCache, pieces, plain_words

END = 256
WIDTH = 257


class Automaton:
    """pieces: tuples of bytes, with END last in those that close a word."""

    def __init__(self, vocabulary: Iterable[tuple[int, ...]]):
        self.go: dict[int, int] = {}
        whole, self.link, self.popped = [False], [-1], [0]
        for piece in vocabulary:
            at = 0
            for c in piece:
                at = self.go.setdefault(at * WIDTH + c, len(whole))
                if at == len(whole):
                    whole.append(False)
                    self.link.append(-1)
                    self.popped.append(0)
            whole[at] = True
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.go.items():
            children.setdefault(key // WIDTH, []).append((key % WIDTH, to))
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in children.get(u, ()):
                todo.append(v)
                if whole[v]:
                    self.link[v], self.popped[v] = 0, 1
                    continue
                z, closed = self.link[u], self.popped[u]
                while z >= 0 and z * WIDTH + c not in self.go:
                    z, closed = self.link[z], closed + self.popped[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.go[z * WIDTH + c], closed

    def count(self, word: bytes) -> int:
        go, link, popped, at, n = self.go, self.link, self.popped, 0, 0
        for c in (*word, END):
            to = go.get(at * WIDTH + c)
            while to is None:
                if link[at] < 0:
                    return 1
                n += popped[at]
                at = link[at]
                to = go.get(at * WIDTH + c)
            at = to
        while at:
            if link[at] < 0:
                return 1
            n += popped[at]
            at = link[at]
        return n


def byte_characters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a tokenizers file with end-of-word marks, as bytes; its special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special, chars = {t["content"] for t in data["added_tokens"]}, byte_characters()
    out = []
    for t in data["model"]["vocab"]:
        if t not in special:
            body = t.removesuffix("</w>")
            out.append((*(chars[c] for c in body), *([END] if body != t else [])))
    return out


def any_words(text: str) -> list[str]:
    """The words of any text; what is beyond U+0250 goes by Unicode properties."""
    if (found := plain_words(text)) is None:
        import unicodedata

        import regex

        found = regex.findall(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", unicodedata.normalize("NFC", text).lower())
    return found


class Counter:
    def __init__(self, path: str):
        self.automaton = Automaton(load_vocabulary(path))
        self.words: dict[str, int] = {}
        self.parts = RowCache(self._learn, "<i8")

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers of each part: words, pieces."""
        if len(self.words) > self.parts.most:
            self.words.clear()
        out, known, count = [], self.words, self.automaton.count
        for p in parts:
            n = 0
            for w in (found := any_words(p)):
                if (k := known.get(w)) is None:
                    k = known[w] = count(w.encode("utf-8", "surrogatepass"))
                n += k
            out += (len(found), n)
        return np.array(out, np.int64), np.full(len(parts), 2, np.int64)

    def totals(self, texts: pa.Array) -> np.ndarray:
        coded, offsets, names = pieces(texts, lower=True)
        each = self.parts.expand(self.parts.rows_of(names)[coded])[0].reshape(-1, 2)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(each, axis=0)])
        return sums[offsets[1:]] - sums[offsets[:-1]]


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = counter(path)
    for b in batches_by_bytes(batches):
        n = c.totals(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n[:, 0]), pa.array(n[:, 1])], ["doc_id", "n_words", "n_pieces"])


def count_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_pieces."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _count(it, vocabulary), "doc_id long, n_words long, n_pieces long")
