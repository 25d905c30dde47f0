"""Product codes of vectors, each part's nearest entry found by a VA file.

A vector's components become integers, floor(scale * x), and it is cut into equal parts; each part position has a
codebook of entries. For every part of a batch the codebook is scanned as a VA file: entry coordinates are quantised to
cells of a few bits, each query fills a table of the least and greatest squared distance to every cell of every
dimension, and sums over the dimensions bound the distance to each entry from below and above. Only entries whose lower
bound doesn't exceed the least upper bound are refined with integer distances, so the nearest entry, and of equally near
ones the first, is exact.

Codebooks begin as the parts of the vectors with the smallest ids and are moved by rounds of assignment and
componentwise floor(sum / count). They are bounded (parts * entries * part length integers), so they go out with the
code and come back as sums; the sums are combined within tasks and then by Spark. Vectors never reach the driver, but
for those the codebooks begin with.

Defined results: vectors that are null, empty, or hold null or non-finite components are dropped, and so are vectors of
another length than that of the smallest kept id, or if the parts can't be equal; repeated rows are encoded each, and of
equal ids those with the smaller vector begin the codebooks first; null ids begin no codebook while others are left;
null labels are one label; with fewer vectors than entries the codebooks are smaller; an empty table gives an empty
result; other columns are not looked at; integers are held within +-2^26, so that no sum overflows a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, quoted, session

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a cell number, and the bound of an integer.
CELL_BITS, MOST = 3, 1 << 26
#: Numbers in a table of bounds, which limits the queries that are looked at together.
TABLE = 1 << 18
SALTS = 64


def to_integers(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the rows that are kept, their lengths, their integers in a row)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.cast(pc.list_flatten(vectors), pa.float64())
    bad = ~np.isfinite(pc.fill_null(x, float("nan")).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(lengths)), lengths)
    keep = lengths > 0
    keep[row[bad]] = False
    x = x.to_numpy(zero_copy_only=False)[keep[row]]
    return np.flatnonzero(keep), lengths[keep], np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int64)


def _integers(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, lengths, x = to_integers(b.column(1), scale)
        ints = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(x, pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), ints, b.column(2).take(pa.array(rows))], ["vec_id", "v", "label"])


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, v, label): the kept vectors as integers."""
    rows = vectors.select(quoted(id_col).alias("vec_id"), quoted(vector_col).cast("array<double>").alias("v"), quoted(label_col).alias("label"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lambda it: _integers(it, scale), f"vec_id {kinds['vec_id']}, v array<int>, label {kinds['label']}")


class VAFile:
    """Entries (entries x dimensions) of one part position, and the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS) -> None:
        self.entries = entries
        n, cells = len(entries), 1 << bits
        # cells of equal filling by rank; each keeps the least and greatest coordinate that lies in it
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = (rank * cells // n).T  # dimensions x entries
        self.low = np.zeros((entries.shape[1], cells), np.int64)
        self.high = np.zeros_like(self.low)
        for j, own in enumerate(self.cell):
            for c in np.unique(own):
                self.low[j, c], self.high[j, c] = entries[own == c, j].min(), entries[own == c, j].max()

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, queries x entries."""
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j, own in enumerate(self.cell):
            below, above = self.low[j] - queries[:, j, None], queries[:, j, None] - self.high[j]
            lower += np.take(np.maximum(np.maximum(below, above), 0) ** 2, own, axis=1)
            upper += np.take(np.maximum(np.abs(below), np.abs(above)) ** 2, own, axis=1)
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first nearest entry, its squared distance) of each query."""
        found, far = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        step = max(1, TABLE // len(self.entries))
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            lower, upper = self.bounds(q)
            i, e = np.nonzero(lower <= upper.min(axis=1)[:, None])  # in order of queries, then entries; no query is without
            d = ((q[i] - self.entries[e]) ** 2).sum(axis=1)
            first = np.flatnonzero(np.diff(i, prepend=-1))
            least = np.minimum.reduceat(d, first)
            hit = np.flatnonzero(d == least[i])
            found[a : a + len(q)] = e[hit[np.flatnonzero(np.diff(i[hit], prepend=-1))]]
            far[a : a + len(q)] = least
        return found, far


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows of that length, their integers)."""
    rows = np.flatnonzero(pc.list_value_length(vectors).to_numpy(zero_copy_only=False) == width)
    flat = pc.list_flatten(vectors.take(pa.array(rows))).to_numpy(zero_copy_only=False)
    return rows, flat.astype(np.int64).reshape(len(rows), width)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per task: counts and componentwise sums of the parts assigned to each entry."""
    parts, entries, size = books.shape
    files = [VAFile(b) for b in books]
    count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
    for b in batches:
        _, x = _matrix(b.column(0), parts * size)
        for p, f in enumerate(files):
            own = x[:, p * size : (p + 1) * size]
            e, _ = f.nearest(own)
            count[p] += np.bincount(e, minlength=entries)
            np.add.at(total[p], e, own)
    p, e = np.nonzero(count)
    sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * size, pa.int32()), pa.array(total[p, e].reshape(-1)))
    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), sums], ["part", "entry", "n", "sums"])


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """(parts x entries x part length) from the vectors with the smallest ids; None if there are none that can be cut."""
    rows = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    if not rows or len(rows[0].v) % parts:
        return None
    width = len(rows[0].v)
    rows = kept.where(F.size("v") == width).select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, width // parts).transpose(1, 0, 2)


def train(kept: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds; entries without a vector stay."""
    size = books.shape[2]
    for _ in range(rounds):
        one = kept.select("v").mapInArrow(lambda it, b=books: _sums(it, b), "part int, entry int, n long, sums array<long>")
        each = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size)]
        books = books.copy()
        for r in one.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # a row per entry at most
            books[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(size)]
    return books


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, size = books.shape
    files = [VAFile(b) for b in books]
    for b in batches:
        rows, x = _matrix(b.column(1), parts * size)
        code, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
        for p, f in enumerate(files):
            code[:, p], far = f.nearest(x[:, p * size : (p + 1) * size])
            error += far
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), b.column(2).take(take)], ["vec_id", "code", "error", "label"])


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label): a byte per part, and the squared distance of all parts."""
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(lambda it: _codes(it, books), f"vec_id {kinds['vec_id']}, code binary, error long, label {kinds['label']}")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_group_sum(rows: DataFrame, group: str, value: str, out: str, salts: int = SALTS) -> DataFrame:
    """`rows` with the sum of a value over equal groups, nulls together; a large group's rows are spread over salts."""
    sums = rows.groupBy(F.col(group).alias("of")).agg(F.sum(value).alias(out))
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    return rows.withColumn("own", own).join(salted, (F.col("own") == F.col("salt")) & F.col(group).eqNullSafe(F.col("of"))).drop("own", "salt", "of")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, code, error, label), codebooks). entries: 256 at most, as a code has a byte per part."""
    kept = cut(quantised(vectors, id_col, vector_col, label_col, scale), "integers")
    books = first_books(kept, parts, entries)
    if books is None:
        return kept.where("false").select("vec_id", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), "label"), None
    books = train(kept, books, rounds)
    return encode(kept, books), books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **how) -> DataFrame:
    """(vec_id, code in hex, error, label_error, codebooks_sha256), a row per kept vector."""
    rows, books = compress(vectors, id_col, vector_col, label_col, **how)
    rows = with_group_sum(cut(rows, "codes"), "label", "error", "label_error")
    sha = F.lit(books_digest(books) if books is not None else None).cast("string")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", sha.alias("codebooks_sha256"))


def _sql_assign(name: str, books: str) -> str:
    """CTE `name`(vec_id, label, p, x, e, d): each part's nearest entry of `books`(p, e, y)."""
    return f"""
{name} AS (
  SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := d, e := e)).e AS e, min(d) AS d
  FROM (SELECT q.*, b.e, list_sum(list_transform(list_zip(q.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts q JOIN {books} b ON b.p = q.p) GROUP BY r, vec_id, label, p)"""


def _sql_move(name: str, assigned: str, books: str) -> str:
    return f"""
{name} AS (
  SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM {books} b LEFT JOIN (
    SELECT p, e, list(v ORDER BY j) AS y FROM (
      SELECT p, e, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS v FROM {assigned}, range(1, 5) t(j) GROUP BY p, e, j)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""


#: For vectors of 64 components. Sums of so few integers are exact as doubles.
ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, vec_id, label, p, v[4 * p + 1 : 4 * p + 4] AS x FROM kept, range(16) t(p)),
books0 AS (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= 64),
{_sql_assign("a1", "books0")}, {_sql_move("books1", "a1", "books0")},
{_sql_assign("a2", "books1")}, {_sql_move("books2", "a2", "books1")},
{_sql_assign("a3", "books2")},
coded AS (SELECT vec_id, label, lower(string_agg(printf('%02x', e), '' ORDER BY p)) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM books2) AS codebooks_sha256
FROM coded
"""
