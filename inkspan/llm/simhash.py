"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts. Tiles hold fingerprints
with the same population counts in each 16-bit quarter; the sum of the four differences of two such count vectors is a
lower bound of the Hamming distance of their members, so a pair of tiles whose counts differ by more than the radius
is skipped and no link is lost. Pairs are made of tile numbers alone, from a small table of the tiles of each count
vector; then each side's members join by tile, so the many tiles of a common count vector meet in many tasks. Equal
fingerprints are compared once. A tile pair gives a star per local component
(at most one row per member), never all its pairs.

Defined results: a null or blank text has fingerprint zero and is linked like any other; fewer words than a shingle
make one shingle of the whole; a row with null id gets its fingerprint, a null component, and links nothing; repeated
rows stay; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, quoted, unused
from inkspan.llm.components import connected_components

RADIUS, SHINGLE, TILE = 3, 3, 4096
#: Members of either side that are compared at once.
SIDE = 1024
#: A quarter's count takes 0 to 16.
STEP = 17


def text_fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; bytes.lower and bytes.split know ASCII only, as the contract asks."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        one = xxhash.xxh64_intdigest
        hashes = [one(line[a : b - 1], 42) for a, b in zip([0, *ends[: len(words) - size]], ends[size - 1 :])]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.array(hashes[k : k + 4096], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([text_fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprint_batches(it, size), "doc_id long, print long")


def _neighbours(radius: int) -> list[int]:
    """Offsets of packed count vectors within the radius, one of each opposite pair."""
    found = set()
    for d in itertools.product(range(-radius, radius + 1), repeat=4):
        if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0):
            found.add(((d[0] * STEP + d[1]) * STEP + d[2]) * STEP + d[3])
    return sorted(found)


def _link(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Stars that hold the links of each pair of tiles."""
    for b in batches:
        from_, to = [], []
        cols = {n: b.column(n) for n in b.schema.names}
        off = {n: cols[n].offsets.to_numpy() for n in ("pa", "ia", "pb", "ib")}
        flat = {n: cols[n].values.to_numpy(zero_copy_only=False) for n in off}
        same = cols["same"].to_numpy(zero_copy_only=False)
        for k in range(b.num_rows):
            cut_ = {n: flat[n][off[n][k] : off[n][k + 1]] for n in off}
            x, y = cut_["pa"].view(np.uint64), cut_["pb"].view(np.uint64)
            ids = np.concatenate([cut_["ia"], cut_["ib"]])
            lab = ids.copy()
            for lo, up in itertools.product(range(0, len(x), SIDE), range(0, len(y), SIDE)):
                if same[k] and up < lo:
                    continue
                hit = np.bitwise_count(x[lo : lo + SIDE, None] ^ y[None, up : up + SIDE]) <= radius
                i, j = np.nonzero(hit)
                if same[k]:
                    i, j = (z[i + lo < j + up] for z in (i, j))
                if not len(i):
                    continue
                i, j = i + lo, j + up + (0 if same[k] else len(x))
                while True:  # least label over the links, until nothing changes
                    least = np.minimum(lab[i], lab[j])
                    if (least == lab[i]).all() and (least == lab[j]).all():
                        break
                    np.minimum.at(lab, i, least)
                    np.minimum.at(lab, j, least)
            moved = lab != ids
            from_.append(ids[moved])
            to.append(lab[moved])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (from_, to))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def linked_prints(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """distinct(print, rep) -> edges (u, v) between reps whose prints are within the radius, as stars."""
    quarter = [F.bit_count(F.shiftrightunsigned("print", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    cell = ((quarter[0] * STEP + quarter[1]) * STEP + quarter[2]) * STEP + quarter[3]
    rows = distinct.withColumn("cell", cell.cast("int"))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    # at most 17^4 cells of eight bytes each
    placed = rows.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    tiles = cut(
        placed.groupBy("cell", "tile").agg(F.collect_list(F.struct("print", "rep")).alias("m")).select("cell", "tile", "m.print", "m.rep"), "tiles"
    )
    # numbers of the tiles to compare: at most 17^4 rows are broadcast, and no members are copied for a neighbour that isn't there
    near = tiles.select("cell", F.col("tile").alias("ta"), F.explode(F.array(*[F.lit(d) for d in _neighbours(radius)])).alias("step"))
    near = near.withColumn("other", F.col("cell") + F.col("step")).join(F.broadcast(sizes.select(F.col("cell").alias("other"), "tiles")), "other")
    near = near.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("step <> 0 OR ta <= tb")
    a = tiles.select("cell", F.col("tile").alias("ta"), F.col("print").alias("pa"), F.col("rep").alias("ia"))
    b = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("tb"), F.col("print").alias("pb"), F.col("rep").alias("ib"))
    pairs = near.select("cell", "ta", "other", "tb", F.expr("step = 0 AND ta = tb").alias("same"))
    pairs = pairs.join(a.hint("merge"), ["cell", "ta"]).join(b.hint("merge"), ["other", "tb"]).select("pa", "ia", "pb", "ib", "same")
    return pairs.mapInArrow(lambda it: _link(it, radius), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut(fingerprints(docs, id_col, text_col, size), "prints")
    distinct = cut(prints.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep")), "distinct")
    comp = connected_components(linked_prints(distinct, radius, tile))
    of = distinct.join(comp, distinct.rep == comp.node, "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "print", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` whose id is the least of their component, and rows without id; all columns stay."""
    comp = simhash_components(docs, id_col, text_col, **how)
    name = unused("gone", docs)
    gone = comp.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, quoted(id_col).cast("long") == F.col(name), "left_anti")
