"""Texts as words or pieces, and bounded caches of what each encodes to.

White space never joins two pieces in any tokenizer here, so a text's ids are those of its pieces in a row. The
lower-casing BPE tokenizer normalises (NFC, white space, lower case) and takes contractions, runs of letters, single
numbers and runs of other marks as words encoded one by one. Below U+0250 the same words are found here with explicit
character sets, and the library encodes each new word once; any other piece is left to the library whole, and so is a
text with the beginning of a special token.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces with characters from here on are left to the library.
LATIN_END = 0x250
#: Entries that a worker's cache holds at most; a full cache is emptied.
MOST = 700_000


@cache
def word_pattern() -> re.Pattern:
    """The tokenizer's pattern with its character classes spelled out below LATIN_END."""
    letters = "".join(map(chr, (c for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == "L")))
    numbers = "".join(map(chr, (c for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == "N")))
    space = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


@cache
def _beyond() -> re.Pattern:
    return re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]|İ")


def plain_words(text: str) -> list[str] | None:
    """The words of a text, or None if only the library knows them."""
    if not text.isascii() and (_beyond().search(text) or not unicodedata.is_normalized("NFC", text)):
        return None
    return word_pattern().findall(text.lower())


SPACE, LETTER, NUMBER, OTHER = range(4)
#: Lead bytes from here on, U+0240 and beyond, are not split here.
FOREIGN = 0xC9


def _class(c: int) -> int:
    if chr(c) in "\t\n\x0b\x0c\r \x85\xa0":
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of one-byte characters (other bytes: OTHER), and of two-byte ones below U+0240."""
    one = np.full(256, OTHER, np.int8)
    one[:128] = [_class(c) for c in range(128)]
    return one, np.array([_class(c) for c in range(0x80, 0x240)], np.int8)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word number of each word in the batch, offsets of the texts, distinct words in ASCII lower case); null texts are empty.

    Words are found in the bytes of all texts at once: a word begins where the class of characters changes, and at every
    number; a contraction that begins a word is one by itself. A piece with a character that isn't split here stays whole.
    """
    texts = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    joined = pc.binary_join_element_wise(texts, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))  # each text ends in a space
    _, where, data = joined.buffers()
    where = np.frombuffer(where, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(data, np.uint8)[where[0] : where[-1]] if len(joined) else np.zeros(0, np.uint8)
    where = where - where[0]
    one, two = _classes()
    kind, lead = one[data], (data & 0xC0) != 0x80
    at = np.flatnonzero((data >= 0xC2) & (data < FOREIGN))
    kind[at] = kind[at + 1] = two[(data[at].astype(np.int64) - 0xC2) * 64 + (data[at + 1] & 0x3F)]
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == NUMBER) & lead[1:])
    at = np.flatnonzero((data == ord("'")) & begin)
    if len(at):
        x, y = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        short = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        long = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | ((x == ord("l")) & (y == ord("l")))
        begin[at[short | long] + 1] = False
        begin[at[short] + 2] = True
        begin[at[long & ~short] + 3] = True
    kept = kind != SPACE
    foreign = data >= FOREIGN
    foreign[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)  # İ, whose lower case has two characters
    if foreign.any():
        first = kept.copy()
        first[1:] &= ~kept[:-1]
        piece = np.cumsum(first)
        whole = np.zeros(int(piece[-1]) + 1, bool)
        whole[piece[foreign]] = True
        begin &= first | ~whole[piece]
    begin &= kept
    count = np.concatenate([[0], np.cumsum(begin)])
    edges = np.append(np.flatnonzero(begin[kept]), int(kept.sum())).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data[kept])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), count[where], coded.dictionary.to_pylist()


def pieces(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(piece number of each piece in the batch, offsets of the texts, distinct pieces); null texts are empty."""
    texts = pc.fill_null(texts, "")
    if lower:  # before the cast: a slice that was cast comes out of ascii_lower with its letters shifted
        texts = pc.ascii_lower(texts)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], coded.dictionary.to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each row, one row after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


class RowCache:
    """Piece -> a row of numbers, all rows in one flat array."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: str, most: int = MOST):
        self.learn, self.kind, self.most = learn, kind, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.lengths, self.used, self.rows = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The row of each of these distinct words, learning the new ones."""
        if len(self.at) + len(words) > self.most:
            self.clear()
        got = list(map(self.at.get, words))
        if fresh := [w for w, r in zip(words, got) if r is None]:
            flat, lengths = self.learn(fresh)
            n, m = self.rows + len(fresh), self.used + len(flat)
            self.flat, self.starts, self.lengths = self._room(self.flat, m), self._room(self.starts, n), self._room(self.lengths, n)
            self.flat[self.used : m] = flat
            self.starts[self.rows : n] = self.used + np.cumsum(lengths) - lengths
            self.lengths[self.rows : n] = lengths
            self.at.update(zip(fresh, range(self.rows, n)))
            self.rows, self.used = n, m
            got = list(map(self.at.get, words))
        return np.array(got, np.int64)

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all rows in a row, and each row's length."""
        lengths = self.lengths[rows]
        return self.flat[ragged(self.starts[rows], lengths)], lengths


class WordEncoder:
    """Ids of texts by the lower-casing BPE tokenizer, equal to the library's without special tokens."""

    def __init__(self, path: str, most: int = MOST):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words = RowCache(self._learn, "<u4", most)

    def _learn(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "surrogatepass") for w in names]
        own = [k for k, t in enumerate(texts) if not t.isascii() and _beyond().search(t)]  # only the library can split these
        foreign = dict.fromkeys(own)
        words = [t.lower() for k, t in enumerate(texts) if k not in foreign] if own else [t if t.isascii() else t.lower() for t in texts]
        lines = [" ".join(words[j : j + 500]) for j in range(0, len(words), 500)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in self.bare.encode_batch_fast(lines, add_special_tokens=False))])
        lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        assert len(lengths) == len(words), "each word ends in one token with an end mark"
        if not own:
            return ids, lengths
        plain = iter(np.split(ids, np.cumsum(lengths)[:-1]) if words else ())
        rows = [np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") if k in foreign else next(plain) for k, t in enumerate(texts)]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in them)."""
        special = np.flatnonzero(pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False))
        coded, offsets, names = split_words(texts)
        ids, lengths = self.words.expand(self.words.rows_of(names)[coded])
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        if not len(special):
            return ids, ends
        rows = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for k in special:  # perhaps a special token, which also joins what white space parts
            rows[k] = np.array(self.whole.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker; it outlives tasks."""
    return WordEncoder(path)


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
