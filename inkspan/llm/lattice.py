"""SentencePiece encoding and decoding with distinct sampled segmentations.

A text is a row of units: a run of spaces, or a line break, with what follows up to the next. No piece of the model
spans two units (that is checked when it is read), so each unit has a lattice of its own, of all pieces of the model,
runs of spaces among them, and of byte pieces for characters that are not in the vocabulary. A segmentation's weight is the product of its pieces'
weights, which follow Zipf's law in the order in which the model learned them. `k` segmentations of the whole text are
drawn without replacement: best-first (A*) search over sets of segmentations, where a set's priority is a Gumbel
variable with the set's exact log-mass, known from backward sums over the lattices, as its place. The root holds all
segmentations. Taking a set off the queue draws the segmentation that attains its priority and leaves the sets "same up
to unit j, other at unit j", whose priorities are Gumbel variables cut off at the parent's. The priority of the next
set after the k-th is the threshold of the inclusion scores: log(1 - exp(-exp(log_prob - threshold))).

All draws are hashes of (row key, draw, unit, step): a row gives the same result wherever and however often it runs.
Units of an Arrow batch are numbered, and lattices and draws of a batch are arrays.

Defined results: a null text is empty; the empty text is one unit with one segmentation; a text with fewer than k
segmentations gives all it has; its last threshold is minus infinity and all its scores are 0; rows with null ids have
a key of their own; equal rows get equal results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import batches_by_bytes
from inkspan.llm.words import ragged

MARK = "▁"
#: Fixed by the model's layout: byte pieces <0x00> to <0xFF> have the ids 3 to 258.
FIRST_BYTE = 3
BYTE_WEIGHT = -12.0
SAMPLES = 2
#: Draws of a unit's other segmentation before its edges are weighed one by one.
TRIES = 64
#: Bytes of text that are worked on together; their arrays take some two hundred times as much.
BATCH_BYTES = 1 << 20


class Model:
    """Pieces by their bytes, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names, ids, self.bytes_of = [], [], [b""] * size
        for i in range(size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([i - FIRST_BYTE])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = p.replace(MARK, " ").encode()
                if " " in self.bytes_of[i].lstrip(b" ").decode() or "\n" in p:
                    raise ValueError(f"piece {i} spans two units: {p!r}")
                names.append(self.bytes_of[i])
                ids.append(i)
        self.child, self.piece_at = _trie(names, ids)
        self.weight = -np.log(np.arange(1.0, size + 1))
        self.weight[FIRST_BYTE : FIRST_BYTE + 256] = BYTE_WEIGHT
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.all = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def decode(self, ids) -> str:
        """Ids -> text: byte pieces become their bytes, and the leading space goes."""
        return self.decoded(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray) -> bytes:
        raw = self.all[ragged(self.starts[ids], self.lengths[ids])].tobytes()
        return raw.removeprefix(b" ")


def _trie(names: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(child by node and byte, or 0 if there is none; id of the piece that a node ends, or -1). The root is 0, leaves come last."""
    nodes: dict[bytes, int] = {b"": 0}
    for name in names:
        for k in range(1, len(name) + 1):
            nodes.setdefault(name[:k], 0)
    inner = {p[:-1] for p in nodes if p}
    order = sorted(nodes, key=lambda p: (p not in inner, len(p), p))
    nodes = {p: k for k, p in enumerate(order)}
    child = np.zeros((len(inner), 256), np.int32)
    for p, k in nodes.items():
        if p:
            child[nodes[p[:-1]], p[-1]] = k
    ends = np.full(len(nodes), -1, np.int32)
    ends[[nodes[name] for name in names]] = ids
    return child, ends


@cache
def model(path: str) -> Model:
    return Model(path)


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(unit number of each unit, offsets of the texts, distinct units as bytes). A text gets a space in front, as the model has it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    joined = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    _, where, data = joined.buffers()
    where = np.frombuffer(where, np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[where[0] : where[-1]] if len(joined) else np.zeros(0, np.uint8)
    where = where - where[0]
    begin = data == 0x20
    begin[1:] &= data[:-1] != 0x20
    begin |= data == 0x0A
    begin[where[:-1]] = True
    edges = np.append(np.flatnonzero(begin), len(data)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(edges, where), coded.dictionary


class Lattices:
    """The lattices of many units. A node is a byte offset of a unit; edges lie node by node."""

    def __init__(self, m: Model, names: pa.Array):
        _, ends, data = names.cast(pa.large_binary()).buffers()
        n = len(names)
        ends = np.frombuffer(ends, np.int64)[names.offset : names.offset + n + 1]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        size = np.diff(ends)
        self.raw, self.raw_start, self.raw_size = raw, ends[:-1], size
        unit = np.repeat(np.arange(n), size)
        place = np.arange(len(raw)) - ends[:-1][unit]
        node = np.arange(len(raw)) + unit  # a unit of s bytes has s + 1 nodes
        self.root, self.leaf = ends[:-1] + np.arange(n), ends[1:] + np.arange(n)
        begins = (raw & 0xC0) != 0x80
        left = size[unit] - place
        able = np.flatnonzero(begins)
        # all places walk down the pieces' trie together, a byte a round, until none is left on a path
        starts, lengths, pieces, single, width = [able[:0]], [able[:0]], [able[:0]], np.zeros(len(raw), bool), 0
        state = np.zeros(len(able), np.int32)
        while len(able):
            state = m.child[state, raw[able + width]]
            on = state > 0
            able, state, width = able[on], state[on], width + 1
            ends_here = m.piece_at[state]
            hit = ends_here >= 0
            starts.append(able[hit])
            lengths.append(np.full(len(starts[-1]), width, np.int64))
            pieces.append(ends_here[hit].astype(np.int64))
            on = (left[able] > width) & (state < len(m.child))
            able, state = able[on], state[on]
        start, length, piece = (np.concatenate(x) for x in (starts, lengths, pieces))
        # a character that is no piece by itself goes byte by byte
        nth = np.cumsum(begins) - 1
        width = np.diff(np.append(np.flatnonzero(begins), len(raw)))
        single[start[length == width[nth[start]]]] = True
        lone = np.flatnonzero(~single[np.flatnonzero(begins)][nth]) if len(raw) else np.zeros(0, np.int64)
        start, length = np.append(start, lone), np.append(length, np.ones(len(lone), np.int64))
        piece = np.append(piece, raw[lone].astype(np.int64) + FIRST_BYTE)
        order = np.argsort(start, kind="stable")
        start, length, self.piece = start[order], length[order], piece[order]
        weight = m.weight[self.piece]
        self.to = node[start] + length
        nodes = len(raw) + n
        first = np.searchsorted(start, np.arange(len(raw) + 1))
        # backward sums, from nodes close to their unit's end to those far from it; and each node's heaviest edge
        self.best = np.full(nodes, -1, np.int64)
        self.beta = np.full(nodes, -np.inf)
        self.beta[self.leaf] = 0.0
        order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")  # numpy sorts short numbers faster
        bounds = np.searchsorted(left[order], np.arange(1, (left.max() if len(left) else 0) + 2))
        for a, b in zip(bounds, bounds[1:]):
            at = order[a:b]
            count = first[at + 1] - first[at]
            at, count = at[count > 0], count[count > 0]
            if not len(at):
                continue
            edges = ragged(first[at], count)
            x = weight[edges] + self.beta[self.to[edges]]
            cuts = np.cumsum(count) - count
            top = np.maximum.reduceat(x, cuts)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                self.beta[node[at]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, count)), cuts))
            top = np.flatnonzero(x == np.repeat(top, count))[::-1]
            self.best[np.repeat(node[at], count)[top]] = edges[top]
        own = self.from_ = node[start]
        with np.errstate(invalid="ignore"):
            self.logp = weight + self.beta[self.to] - self.beta[own]
        self.logp[~np.isfinite(self.logp)] = -np.inf
        p = np.exp(self.logp)
        total = np.cumsum(p)
        before = np.concatenate([[0.0], total])[first[:-1]][start] if len(start) else total
        self.cum = own + np.minimum(total - before, 1.0)
        last = np.append(start[1:] != start[:-1], True) if len(start) else np.zeros(0, bool)
        self.cum[last] = own[last] + 1.0
        self._best_paths(n)

    def _best_paths(self, n: int) -> None:
        """The path along the heaviest edges of every unit, and the log-probability of that path's rest from each node on."""
        at, live, seen = self.root.copy(), np.arange(n), []
        while len(live):
            e = self.best[at[live]]
            seen.append((live, e))
            at[live] = self.to[e]
            live = live[at[live] != self.leaf[live]]
        self.tail = np.zeros(len(self.beta))
        count = np.zeros(n, np.int64)
        for who, _ in seen:
            count[who] += 1
        self.best_count, self.best_start = count, np.cumsum(count) - count
        self.best_edges = np.empty(int(count.sum()), np.int64)
        own = np.zeros(n)
        for k in range(len(seen) - 1, -1, -1):
            who, e = seen[k]
            self.best_edges[self.best_start[who] + k] = e
            own[who] += self.logp[e]
            self.tail[self.from_[e]] = own[who]
        self.best_logp = own


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _finish(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def extend(x: np.ndarray, key) -> np.ndarray:
    """The hash of one more integer key, a number or an array."""
    with np.errstate(over="ignore"):
        return _finish((x.view(np.uint64) ^ np.asarray(key, np.int64).view(np.uint64)) + GOLDEN).view(np.int64)


def scramble(*keys) -> np.ndarray:
    """A 64-bit hash of integer keys, each a number or an array."""
    x = np.zeros(1, np.int64)
    for k in keys:
        x = extend(x, k)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def mix(*keys) -> np.ndarray:
    """Uniform numbers in (0, 1) from integer keys."""
    return uniform(scramble(*keys))


def draw(lat: Lattices, unit: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One segmentation of each unit: (edges of all in a row, edges of each, log-probability of each).

    base: a hash of each draw. Its first number tells whether the path along the heaviest edges is drawn, as most are;
    the others go edge by edge, at first under the condition that they do leave that path.
    """
    base = base.view(np.uint64)
    count, logp = lat.best_count[unit], lat.best_logp[unit]
    live = np.flatnonzero(uniform(_finish(base)) >= np.exp(logp))
    at, leaf = lat.root[unit[live]], lat.leaf[unit[live]]
    where, away, seen, step = np.arange(len(live)), np.zeros(len(live), bool), [], 0
    n, p = np.zeros(len(live), np.int64), np.zeros(len(live))
    while len(where):
        step += 1
        with np.errstate(over="ignore"):
            v = _finish(base[live[where]] + GOLDEN * np.uint64(2 * step))
            u, w = uniform(v), uniform(_finish(v + GOLDEN))
        now = at[where]
        best = lat.best[now]
        q = np.exp(lat.logp[best])
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = ~away[where] & ~(u >= (1.0 - q) / -np.expm1(lat.tail[now]))
        low = np.where(lat.from_[best - 1] == now, lat.cum[best - 1] - now, 0.0) if len(best) else q
        x = w * (1.0 - q)
        x = np.where(x >= low, np.minimum(x + q, np.nextafter(1.0, 0.0)), x)
        e = np.searchsorted(lat.cum, now + np.where(leave, x, w), side="right")
        e = np.where(away[where] | leave, e, best)
        away[where] |= leave
        seen.append((where, e))
        n[where] += 1
        p[where] += lat.logp[e]
        at[where] = lat.to[e]
        where = where[at[where] != leaf[where]]
    count[live], logp[live] = n, p
    start = np.cumsum(count) - count
    plain = np.ones(len(unit), bool)
    plain[live] = False
    edges = np.empty(int(count.sum()), np.int64)
    edges[ragged(start[plain], count[plain])] = lat.best_edges[ragged(lat.best_start[unit[plain]], count[plain])]
    for k, (who, e) in enumerate(seen):
        edges[start[live[who]] + k] = e
    return edges, count, logp


def cut_gumbel(place: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at `place`, given that they are below `top`."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(place), -np.inf, place - np.log(np.exp(place - top) - np.log(u)))


def other_masses(lat: Lattices, unit: int, taken: list[tuple[int, ...]]) -> float:
    """Log of one minus the probability of some segmentations of a unit."""
    rest = 1.0 - sum(np.exp(lat.logp[list(t)].sum()) for t in taken)
    return np.log(rest) if rest > 1e-12 else -np.inf


class Path:
    """One emitted segmentation of a document, and the sets left around it."""

    def __init__(self, edges, counts, logp):
        self.edges, self.counts, self.logp = edges, counts, logp
        self.ends = np.concatenate([[0], np.cumsum(counts)])

    def unit(self, j: int) -> tuple[int, ...]:
        return tuple(self.edges[self.ends[j] : self.ends[j + 1]].tolist())


def sample(m: Model, texts: pa.Array, keys: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, bool]]:
    """(text, number of the draw, ids, log_prob, log_inclusion, whether the ids decode to the text)."""
    coded, offsets, names = units(texts)
    lat = Lattices(m, names)
    n = len(texts)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    number = np.arange(len(coded)) - offsets[:-1][doc]
    root = -np.log(-np.log(mix(keys, -7)))
    paths: list[list] = [[] for _ in range(n)]
    left: list[list[np.ndarray]] = [[] for _ in range(n)]
    bans: list[dict] = [{} for _ in range(n)]
    tops: list[list[float]] = [[] for _ in range(n)]
    for turn in range(k):
        begin = np.zeros(n, np.int64)  # units from here on are drawn anew
        alive, parents = [], {}
        for d in range(n):
            if turn == 0:
                alive.append(d)
                tops[d].append(float(root[d]))
                continue
            if len(paths[d]) < turn:
                continue
            best = [(float(g.max()), q, int(g.argmax())) for q, g in enumerate(left[d])]
            top, q, j = max(best)
            if np.isneginf(top):
                continue
            alive.append(d)
            tops[d].append(top)
            parents[d] = (q, j)
            begin[d] = j + 1
        if not alive:
            break
        on = np.zeros(n, bool)
        on[alive] = True
        fresh = np.flatnonzero(on[doc] & (number >= begin[doc]))
        edges, counts, logp = draw(lat, coded[fresh], scramble(scramble(keys, turn)[doc[fresh]], number[fresh]))
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.searchsorted(doc[fresh], np.arange(n + 1))
        tried = _tries(lat, coded, offsets, keys, parents, turn)
        parts = []
        for d in alive:
            a, b = bounds[d], bounds[d + 1]
            e, c, p = edges[ends[a] : ends[b]], counts[a:b], logp[a:b]
            if d in parents:
                q, j = parents[d]
                old = paths[d][q]
                banned = bans[d].setdefault((q, j), [old.unit(j)])
                new = _other(lat, int(coded[offsets[d] + j]), next(tried), banned, int(keys[d]), j, turn)
                e = np.concatenate([old.edges[: old.ends[j]], np.array(new, np.int64), e])
                c = np.concatenate([old.counts[:j], [len(new)], c])
                p = np.concatenate([old.logp[:j], [lat.logp[list(new)].sum()], p])
                banned.append(new)
            parts.append((e, c, p))
        # of all documents at once: the sets left around each new segmentation
        many, p = np.array([len(x[2]) for x in parts]), np.concatenate([x[2] for x in parts])
        begin = np.cumsum(many) - many
        before = np.concatenate([np.cumsum(x[2]) - x[2] for x in parts])
        with np.errstate(divide="ignore"):
            place = before + np.log(np.maximum(-np.expm1(p), 0.0))
        place[p > -1e-12] = -np.inf
        key = np.repeat(scramble(keys[alive], -1 - turn), many)
        gaps = cut_gumbel(place, np.repeat([tops[d][-1] for d in alive], many), uniform(extend(key, np.arange(len(p)) - np.repeat(begin, many))))
        for (e, c, p), d, a, b in zip(parts, alive, begin, begin + many):
            path, g = Path(e, c, p), gaps[a:b]
            if d in parents:
                q, j = parents[d]
                old, banned = paths[d][q], bans[d][q, j]
                g[: j + 1] = -np.inf  # those sets belong to the older path
                rest = other_masses(lat, int(coded[offsets[d] + j]), banned)
                left[d][q][j] = cut_gumbel(np.array([old.logp[:j].sum() + rest]), np.array([tops[d][-1]]), mix(keys[d], j, -1000 - turn))[0]
            paths[d].append(path)
            left[d].append(g)
    for d in range(n):
        source = (texts[d].as_py() or "").encode("utf-8", "surrogatepass")
        threshold = max(float(g.max()) for g in left[d])
        for turn, path in enumerate(paths[d]):
            ids = lat.piece[path.edges]
            gap = path.logp.sum() - threshold
            score = 0.0 if np.isneginf(threshold) else float(gap) if gap < -40 else float(np.log(-np.expm1(-np.exp(min(gap, 700.0)))))
            yield d, turn, ids, float(path.logp.sum()), score, m.decoded(ids) == source


def _tries(lat: Lattices, coded: np.ndarray, offsets: np.ndarray, keys: np.ndarray, parents: dict, turn: int) -> Iterator[Iterator[tuple[int, ...]]]:
    """For each document with a parent, TRIES draws of the unit that is to change."""
    if not parents:
        return
    docs, at = np.array(list(parents)), np.array([j for _, j in parents.values()])
    base = extend(np.repeat(scramble(keys[docs], at, turn), TRIES), np.tile(np.arange(TRIES), len(docs)))
    edges, count, _ = draw(lat, np.repeat(coded[offsets[docs] + at], TRIES), base)
    ends = np.concatenate([[0], np.cumsum(count)])
    for k in range(0, len(count), TRIES):
        cuts = ends[k : k + TRIES + 1].tolist()
        yield (tuple(edges[a:b].tolist()) for a, b in zip(cuts, cuts[1:]))


def _other(lat: Lattices, unit: int, tried: Iterator[tuple[int, ...]], banned: list[tuple[int, ...]], key: int, j: int, turn: int) -> tuple[int, ...]:
    """A segmentation of a unit in proportion to its weight, none of the banned ones."""
    for new in tried:
        if new not in banned:
            return new
    # the banned ones hold nearly all the mass: walk down, each time into the edges' masses without them
    path, at, leaf = [], int(lat.root[unit]), int(lat.leaf[unit])
    reach = 0.0
    while at != leaf:
        a, b = np.searchsorted(lat.cum, [at, at + 1.0], side="right")
        mass = []
        for e in range(int(a), int(b)):
            p = np.exp(reach + lat.logp[e])
            mass.append(max(0.0, p - sum(np.exp(lat.logp[list(t)].sum()) for t in banned if t[: len(path) + 1] == (*path, e))))
        u = float(mix(key, j, -5000 - turn, len(path))[0]) * sum(mass)
        pick = int(a) + min(int(np.searchsorted(np.cumsum(mass), u)), len(mass) - 1)
        path.append(pick)
        reach += lat.logp[pick]
        at = int(lat.to[pick])
    return tuple(path)


def _batches(batches: Iterator[pa.RecordBatch], path: str, k: int, digest: bool) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for b in batches_by_bytes(batches, most=BATCH_BYTES):
        got = list(sample(m, b.column(1), b.column(2).to_numpy(), k))
        doc = pa.array([g[0] for g in got], pa.int64())
        cols = {
            "doc_id": b.column(0).take(doc),
            "sample": pa.array([g[1] for g in got], pa.int32()),
            "n_pieces": pa.array([len(g[2]) for g in got], pa.int64()),
            "log_prob": pa.array([g[3] for g in got], pa.float64()),
            "log_inclusion": pa.array([g[4] for g in got], pa.float64()),
            "round_trip": pa.array([g[5] for g in got], pa.bool_()),
        }
        if digest:
            cols["ids_crc32"] = pa.array([zlib.crc32(g[2].astype("<u4").tobytes()) for g in got], pa.int64())
        else:
            ends = np.cumsum([0] + [len(g[2]) for g in got]).astype(np.int32)
            flat = np.concatenate([g[2] for g in got]).astype(np.int32) if got else np.zeros(0, np.int32)
            cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def encode_samples(docs: DataFrame, path: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Up to k rows per row of `docs`: doc_id, sample, n_pieces, log_prob, log_inclusion, round_trip, and the ids or their crc32."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id"))
    schema = "doc_id long, sample int, n_pieces long, log_prob double, log_inclusion double, round_trip boolean, "
    return rows.mapInArrow(lambda it: _batches(it, path, k, digest), schema + ("ids_crc32 long" if digest else "ids array<int>"))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`encoded` with the column text, decoded from the ids; null ids give a null text."""

    @F.pandas_udf("string")
    def text_of(ids):
        m = model(path)
        return ids.map(lambda x: None if x is None else m.decode(x))

    return encoded.withColumn("text", text_of(ids_col))
