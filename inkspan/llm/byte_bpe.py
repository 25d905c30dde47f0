r"""Byte-level BPE, with pre-tokenisation as a scan of transition functions.

Texts are split as the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+` splits them,
without a regex. All characters of a batch become an array of code points, a table turns these into classes, and
shifted comparisons turn classes into symbols that know the little that the pattern looks ahead to (the letters of a
contraction, the end of a run of white space). An automaton of few states reads the symbols; what a symbol does is a
transition function, a table row from state to state, and the composition of functions is associative. So the array is
cut into blocks: each block's composed function is found, all blocks at once, the blocks' functions are scanned, and
each block is read again from the state it begins in. A token begins where symbol and state before it say so.

The slices between boundaries are bytes of the texts. Each distinct one is merged once, pairs by their ranks, and kept
in a cache of bounded size; the new ones of a piece are merged together, a pair of each in every round. Offsets are kept,
so that ids can be traced to bytes and texts decoded one by one.

Classes are those of the library's own regex engine, whose Unicode version others needn't share.

Defined results: a null or empty text has no ids and decodes to no bytes; texts of any length are read whole (in
pieces that end where a token must begin); rows that repeat, or have null ids, are encoded each; an empty table gives an
empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import batches_by_bytes, quoted, unused
from inkspan.llm.words import RowCache, ragged

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
# Symbols: the five classes (white space inside a run), the last white space before something else, a contraction's
# apostrophe with one or two letters to come, and the end of a text.
LAST_BLANK, LAST_SPACE, SHORT, LONG, END = range(5, 10)
# States: what came before.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, TWO_LEFT, ONE_LEFT = range(8)
#: Characters of a block of the scan.
BLOCK = 128
#: Distinct slices that a worker keeps, and the longest kept; a full cache is emptied.
MOST, LONGEST = 700_000, 64
#: Bytes that are split and merged at once; a few dozen bytes of memory go with each.
PIECE = 1 << 20
#: Slices from here on are merged with a heap.
HEAP_FROM = 48
#: Fewer new slices than these are merged one by one, and so many at once.
FEW, TOGETHER = 16, 1 << 13


@cache
def classes() -> np.ndarray:
    """The class of every code point, as the library's regex engine has them."""
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        bytes_only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for first in range(0, len(out), 1 << 14):  # what matches is encoded, the rest is left out
            some = "".join(map(chr, (c for c in range(first, first + (1 << 14)) if not 0xD800 <= c < 0xE000)))
            out[np.frombuffer(bytes_only.decode(bytes_only.encode_ordinary(some)).encode("utf-32-le"), np.uint32)] = kind
    out[ord(" ")] = SPACE
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) by symbol and state before."""
    step, begins = np.zeros((10, 8), np.uint8), np.zeros((10, 8), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: IN_BLANKS, SPACE: IN_BLANKS}
    for symbol, inside in runs.items():
        step[symbol] = inside
        begins[symbol] = True
        begins[symbol, inside] = False
    for symbol in (LETTER, NUMBER, OTHER):
        begins[symbol, AFTER_SPACE] = False  # the space before a run belongs to it
    step[LETTER, TWO_LEFT], step[LETTER, ONE_LEFT] = ONE_LEFT, FRESH
    begins[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    step[LAST_BLANK], step[LAST_SPACE] = FRESH, AFTER_SPACE
    begins[[LAST_BLANK, LAST_SPACE]] = True
    # an apostrophe begins a contraction unless it goes on with a run of its kind
    for symbol, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
        step[symbol], begins[symbol] = left, True
        for before in (IN_OTHERS, AFTER_SPACE):
            step[symbol, before], begins[symbol, before] = IN_OTHERS, False
    step[END], begins[END] = FRESH, True
    return step, begins


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point; `ends`: places of the marks that end the texts."""
    kind = classes()[points]
    kind[ends] = END
    blank = (kind == BLANK) | (kind == SPACE)
    last = blank[:-1] & ~blank[1:] & (kind[1:] != END)
    at = np.flatnonzero(last)
    quote = np.flatnonzero(points[:-1] == ord("'"))
    quote = quote[kind[quote] != END]
    out = kind.copy()
    out[at] = np.where(kind[at] == SPACE, LAST_SPACE, LAST_BLANK)
    if len(quote):
        one = np.append(points, [0, 0])[quote + 1]
        two = np.append(points, [0, 0])[quote + 2]
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        out[quote[pair]] = LONG
    return out


def boundaries(syms: np.ndarray) -> np.ndarray:
    """Whether a token begins, by character, from a blocked scan of the symbols' transition functions."""
    step, begins = automaton()
    n = len(syms)
    blocks = -(-n // BLOCK)
    # END leads to FRESH from every state, so the filling changes nothing
    grid = np.full(blocks * BLOCK, END, np.uint8)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat, width = step.reshape(-1), step.shape[1]
    whole = np.broadcast_to(np.arange(width, dtype=np.uint8), (blocks, width)).copy()
    for row in grid:  # every block's composed function
        whole = flat[(row.astype(np.intp) * width)[:, None] + whole]
    scanned = scan(whole)
    state = np.concatenate([[FRESH], scanned[:-1, FRESH]]).astype(np.intp)
    out = np.empty(grid.shape, bool)
    marks = begins.reshape(-1)
    for k, row in enumerate(grid):
        at = row.astype(np.intp) * width + state
        out[k] = marks[at]
        state = flat[at].astype(np.intp)
    return out.T.reshape(-1)[:n]


def scan(functions: np.ndarray) -> np.ndarray:
    """Row k: functions 0 to k composed, the first applied first; by doubling, as composition is associative."""
    out, reach = functions, 1
    while reach < len(out):
        later = np.take_along_axis(out[reach:], out[:-reach].astype(np.intp), axis=1)
        out, reach = np.concatenate([out[:reach], later]), reach * 2
    return out


def split(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the bytes where tokens begin, and the end; which tokens aren't marks); a line feed at every place in `ends`, the mark, ends a text."""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    where = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    marks = np.searchsorted(where, ends)
    first = boundaries(symbols(points, marks))
    is_mark = np.zeros(len(points), bool)
    is_mark[marks] = True
    return np.append(where[np.flatnonzero(first)], where[-1]), ~is_mark[first]  # the marks begin tokens of their own


class Merger:
    """Ids of slices by the ranks of their pairs, the lowest rank first and of equal ones the leftmost."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.none = len(self.words)
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        # the rank of what two parts make, by both parts' ids
        pairs, made, rank_of = [np.iinfo(np.int64).max], [self.none], self.ranks.get
        for w, r in self.ranks.items():
            for k in range(1, len(w)):
                if (x := rank_of(w[:k])) is not None and (y := rank_of(w[k:])) is not None:
                    pairs.append(x * self.none + y)
                    made.append(r)
        order = np.argsort(pairs)
        self.pairs, self.made = np.array(pairs, np.int64)[order], np.array(made, np.int64)[order]
        self.kept = RowCache(self._learn, "<u4", MOST)

    def _learn(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct slices in a row, how many each has)."""
        whole = list(map(self.ranks.get, slices))
        apart = [k for k, r in enumerate(whole) if r is None]
        short = [k for k in apart if len(slices[k]) < HEAP_FROM]
        alone = [k for k in apart if len(slices[k]) >= HEAP_FROM]
        if len(short) < FEW:
            alone, short = apart, []
        lengths = np.ones(len(slices), np.int64)
        groups = [self._together([slices[k] for k in short[a : a + TOGETHER]]) for a in range(0, len(short), TOGETHER)]
        flat, lengths[short] = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*groups) if groups else ((), ())))
        merged = [self._heap(slices[k]) if len(slices[k]) >= HEAP_FROM else self._plain(slices[k]) for k in alone]
        lengths[alone] = [len(m) for m in merged]
        out, at = np.zeros(int(lengths.sum()), "<u4"), np.cumsum(lengths) - lengths
        single = [k for k, r in enumerate(whole) if r is not None]
        out[at[single]] = [whole[k] for k in single]
        out[ragged(at[short], lengths[short])] = flat
        out[ragged(at[alone], lengths[alone])] = [i for m in merged for i in m]
        return out, lengths

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.none + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.made[at], self.none)

    def _together(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of slices in a row, how many each has): in every round each slice merges its lowest pair, of equal ones the leftmost."""
        lengths = np.array([len(w) for w in slices], np.int64)
        parts = self.of_byte[np.frombuffer(b"".join(slices), np.uint8)]
        if (parts < 0).any():
            raise KeyError("a byte has no rank")
        last = np.zeros(len(parts), bool)
        last[np.cumsum(lengths) - 1] = True
        rank = np.full(len(parts), self.none, np.int64)  # of each part with the next one
        inner = np.flatnonzero(~last)
        rank[inner] = self._rank(parts[inner], parts[inner + 1])
        which, size = np.arange(len(slices)), lengths.copy()
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which):
            begin = np.cumsum(size) - size
            # a rank and its place in one number, so that the least is the leftmost of the lowest
            low, at = np.divmod(np.minimum.reduceat((rank << 32) + np.arange(len(rank)), begin), 1 << 32)
            ended = low >= self.none
            keep = np.repeat(~ended, size)
            if ended.any():
                done.append((which[ended], size[ended], parts[~keep]))
            going = ~ended
            which, size, at, low, begin = which[going], size[going] - 1, at[going], low[going], begin[going]
            parts[at] = low
            rank[at] = np.where(at + 1 < begin + size, 0, self.none)  # overwritten below unless the part is the last now
            keep[at + 1] = False
            parts, rank = parts[keep], rank[keep]
            moved = np.cumsum(size) - size
            at += moved - begin
            behind, ahead = at[at + 1 < moved + size], at[at > moved]
            rank[behind] = self._rank(parts[behind], parts[behind + 1])
            rank[ahead - 1] = self._rank(parts[ahead - 1], parts[ahead])
        which, size, parts = (np.concatenate(x) for x in zip(*done))
        begin = np.cumsum(size) - size
        order = np.argsort(which)
        return parts[ragged(begin[order], size[order])], size[order]

    def _plain(self, word: bytes) -> list[int]:
        rank_of, none = self.ranks.get, len(self.words)
        parts = [word[k : k + 1] for k in range(len(word))]
        rank = [rank_of(a + b, none) for a, b in zip(parts, parts[1:])]
        while rank and (best := min(rank)) < none:
            at = rank.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del rank[at]
            if at < len(rank):
                rank[at] = rank_of(parts[at] + parts[at + 1], none)
            if at:
                rank[at - 1] = rank_of(parts[at - 1] + parts[at], none)
        return [self.ranks[p] for p in parts]

    def _heap(self, word: bytes) -> list[int]:
        """The same for long slices: parts in a linked list, their pairs in a heap with outdated ones skipped."""
        n = len(word)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda a: self.ranks.get(word[a : end[after[a]]]) if after[a] < n else None
        heap = [(r, a) for a in range(n) if (r := pair(a)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, a = heapq.heappop(heap)
            if gone[a] or pair(a) != r:
                continue
            b = after[a]
            gone[b], end[a], after[a] = 1, end[b], after[b]
            if after[a] < n:
                before[after[a]] = a
            for x in (before[a], a):
                if x >= 0 and (r := pair(x)) is not None:
                    heapq.heappush(heap, (r, x))
        out, a = [], 0
        while a < n:
            out.append(self.ranks[word[a : end[a]]])
            a = after[a]
        return out

    def ids(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct slices in a row, how many each has); all but long ones are kept."""
        if len(slices) > MOST:  # the cache stays within its bound
            some = [self.ids(slices[a : a + MOST]) for a in range(0, len(slices), MOST)]
            return np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
        if max(map(len, slices), default=0) <= LONGEST:
            return self.kept.expand(self.kept.rows_of(slices))
        long = np.array([len(w) > LONGEST for w in slices])
        lengths = np.zeros(len(slices), np.int64)
        a, lengths[~long] = self.kept.expand(self.kept.rows_of([w for w in slices if len(w) <= LONGEST]))
        b, lengths[long] = self._learn([w for w in slices if len(w) > LONGEST])
        of_long, out = np.repeat(long, lengths), np.zeros(len(a) + len(b), "<u4")
        out[~of_long], out[of_long] = a, b
        return out, lengths


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def pieces(data: bytes, ends: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` bytes that end with a text, or within one before the last white space of a run, where a token must begin."""
    a, n, marks = 0, len(data), iter(ends)
    mark = next(marks, n)
    while a < n:
        if n - a <= most:
            yield a, n
            return
        last = None
        while mark < a:  # behind a long text
            mark = next(marks, n)
        while mark < a + most:
            last, mark = mark, next(marks, n)
        if last is not None:
            yield a, last + 1
            a = last + 1
            continue
        b = a + most  # within a long text: ASCII space after and before something printable
        while b < mark and not (data[b] == 0x20 and 0x21 <= data[b + 1] < 0x7F and 0x21 <= data[b - 1] < 0x7F):
            b += 1
        b = b if b < mark else mark + 1
        yield a, b
        a = b


def encode_batch(texts: pa.Array, path: str, most: int = PIECE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(ids, byte offsets of the slices' first ids' ends) per text: ids as uint32, and for each id the end of its bytes."""
    m = merger(path)
    raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.binary())]
    data = b"\n".join([*raw, b""])
    lengths = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    del raw
    sizes = np.array([len(w) for w in m.words], np.int64)
    ids: list[list[np.ndarray]] = [[] for _ in lengths]
    for a, b in pieces(data, ends.tolist(), most):
        part = data[a:b]
        lo, hi = (int(k) for k in np.searchsorted(ends, [a, b]))
        marks = ends[lo:hi] - a
        inner = part if len(marks) and marks[-1] == len(part) - 1 else part + data[b : b + 1] + b"\n"
        # a piece that ends within a text sees one character more, for what the pattern looks ahead to
        all_marks = marks if inner is part else np.append(marks, len(inner) - 1)
        edges, own = split(inner, all_marks)
        if inner is not part:
            n = int(np.searchsorted(edges, len(part)))
            edges, own = edges[: n + 1], own[:n]
        slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(edges), pa.py_buffer(inner)]).dictionary_encode()
        flat, lengths = m.ids(slices.dictionary.to_pylist())
        coded = slices.indices.to_numpy()
        count = np.where(own, lengths[coded], 0)
        flat = flat[ragged((np.cumsum(lengths) - lengths)[coded], count)]
        for t, some in enumerate(np.split(flat, np.cumsum(count)[~own]), lo):
            if len(some):
                ids[t].append(some)
    whole = [np.concatenate(p) if p else np.zeros(0, np.uint32) for p in ids]
    return whole, [np.cumsum(sizes[w]) for w in whole]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    flat = np.concatenate([*values, np.zeros(0, np.int64)]).astype(kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))


def _encode(batches: Iterator[pa.RecordBatch], path: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    for b in batches_by_bytes(batches):
        ids, ends = encode_batch(b.column(1), path)
        cols = [b.column(0), _lists(ids, pa.int32()), *([_lists(ends, pa.int64())] if offsets else [])]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "ends"][: len(cols)])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(doc_id, ids, ends): a text's ids, and for each the place in the text's UTF-8 bytes where its own end."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, path, offsets), f"doc_id {rows.dtypes[0][1]}, ids array<int>" + ", ends array<long>" * offsets)


def _decode(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    words = pa.array(merger(path).words, pa.large_binary())
    sizes = np.array([len(w) for w in merger(path).words], np.int64)
    for b in batches:
        col = b.column(at)
        flat = pc.list_flatten(col)
        where = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], np.cumsum(sizes[flat.to_numpy(zero_copy_only=False)])])[where]
        data = words.take(flat).buffers()[2] or pa.py_buffer(b"")  # the bytes of all ids in a row
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(col), [None, pa.py_buffer(ends), data]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids; null ids give no bytes."""
    name = unused(out, encoded)
    at, fields = encoded.columns.index(ids_col), ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(lambda it: _decode(it, path, at), f"{fields}, {name} binary")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of what they decode to."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    # both in one worker a task: ids go from one to the other in batches
    both = rows.mapInArrow(lambda it: _decode(_encode(it, path, False), path, 1), f"doc_id {rows.dtypes[0][1]}, ids array<int>, decoded binary")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
