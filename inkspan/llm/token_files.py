"""Token ids in binary files, each id in the fewest bits that the vocabulary needs.

A file holds the documents of one range of ids, in order. 64 ids take exactly `bits` 64-bit words, so packing and
unpacking are 64 vector operations whatever the number of ids, and any id is found by its index. Layout, little-endian:

  "TPAK", version u16, bits u16            head
  blocks of BLOCK ids, the last one shorter but filled up to 64 ids
  doc ids i64[n], null flags u8[n], first id of each document u64[n+1], byte offset of each block u64[m+1]
  n u64, m u64, ids u64, place of the doc ids u64, "TPAK"    tail

A file is written under a name of its own attempt and then renamed, so a task that runs again replaces it by the same
bytes. Paths may lie in any store that pyarrow opens.

Defined results: a null text is empty and holds the end id alone; null ids come first; rows with equal ids are ordered
by their text and all kept; an empty table gives no file and an empty result; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkspan.llm.common import batches_by_bytes, cut, scratch, session
from inkspan.llm.words import encoder

MAGIC, HEAD, TAIL, BLOCK = b"TPAK", struct.Struct("<4sHH"), struct.Struct("<QQQQ4s"), 4096
#: Files of one group of the manifest; 100,000 files are 391 groups.
GROUP = 256
#: Bytes of text that are encoded at once: the more, the fewer times a common word is looked up.
WRITE_BYTES = 8 << 20
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, filled up with zeros to a multiple of 64, in `bits` bits each."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    cols = np.ascontiguousarray(rows.T)
    out = np.zeros((bits, cols.shape[1]), np.uint64)
    for i in range(64):
        word, off = divmod(i * bits, 64)
        out[word] |= cols[i] << np.uint64(off)
        if off + bits > 64:
            out[word + 1] |= cols[i] >> np.uint64(64 - off)
    return np.ascontiguousarray(out.T).astype("<u8").tobytes()


def unpack(raw: bytes, bits: int, first: int, last: int) -> np.ndarray:
    """Ids first..last of a run of packed groups of 64."""
    a, b = first // 64, -(-last // 64)
    words = np.ascontiguousarray(np.frombuffer(raw, "<u8", (b - a) * bits, a * bits * 8).reshape(-1, bits).T)
    out, mask = np.empty((64, b - a), np.uint64), np.uint64((1 << bits) - 1)
    for i in range(64):
        word, off = divmod(i * bits, 64)
        x = words[word] >> np.uint64(off)
        if off + bits > 64:
            x = x | words[word + 1] << np.uint64(64 - off)
        out[i] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1)[first - 64 * a : last - 64 * a].astype("<u4")


class Writer:
    """Writes a file block by block; holds one block and sixteen bytes a document."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.left = sink, bits, np.zeros(0, np.uint32)
        self.docs, self.nulls, self.starts, self.offsets, self.at, self.count = [], [], [0], [HEAD.size], HEAD.size, 0
        sink.write(HEAD.pack(MAGIC, 1, bits))

    def _put(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.sink.write(raw)
        whole = BLOCK * self.bits // 8
        self.offsets += [self.at + min(k + whole, len(raw)) for k in range(0, len(raw), whole)]
        self.at += len(raw)

    def add(self, doc_ids: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents of a batch: their ids in a row, and where each begins."""
        self.docs += [d or 0 for d in doc_ids]
        self.nulls += [d is None for d in doc_ids]
        self.starts += (offsets[1:] + self.count).tolist()
        self.count += len(ids)
        ids = np.concatenate([self.left, ids])
        full = len(ids) // BLOCK * BLOCK
        if full:
            self._put(ids[:full])
        self.left = ids[full:]

    def close(self) -> None:
        if len(self.left):
            self._put(self.left)
        for x, kind in ((self.docs, "<i8"), (self.nulls, "u1"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.sink.write(np.array(x, kind).tobytes())
        self.sink.write(TAIL.pack(len(self.docs), len(self.offsets) - 1, self.count, self.at, MAGIC))


class Reader:
    """Random access: the tail first, then only the blocks that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, m, self.count, place, magic = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        head, _, self.bits = HEAD.unpack(source.read_at(HEAD.size, 0))
        if magic != MAGIC or head != MAGIC:
            raise ValueError("not a packed token file")
        tail = source.read_at(size - TAIL.size - place, place)
        self.docs = np.frombuffer(tail, "<i8", n)
        self.nulls = np.frombuffer(tail, "u1", n, 8 * n).astype(bool)
        self.starts = np.frombuffer(tail, "<u8", n + 1, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(tail, "<u8", m + 1, 9 * n + 8 * (n + 1)).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        if first >= last:
            return np.zeros(0, "<u4")
        a, b = first // BLOCK, -(-last // BLOCK)
        raw = self.source.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        return unpack(raw, self.bits, first - a * BLOCK, last - a * BLOCK)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _write(batches: Iterator[pa.RecordBatch], out: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, task = encoder(tokenizer), TaskContext.get()
    bits = max(1, (enc.size - 1).bit_length())
    where, root = fs.FileSystem.from_uri(out)
    part = task.partitionId()
    name, own, writer, sink = f"{root}/part-{part:06d}.tpak", f"{root}/.part-{part:06d}-{task.taskAttemptId()}", None, None
    for b in batches_by_bytes(batches, most=WRITE_BYTES):
        if writer is None:
            where.create_dir(root, recursive=True)
            sink = where.open_output_stream(own)
            writer = Writer(sink, bits)
        ids, offsets = enc.encode(b.column(1))
        writer.add(b.column(0).to_pylist(), np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets)))
    if writer is not None:
        writer.close()
        sink.close()
        if not isinstance(where, fs.LocalFileSystem) and where.get_file_info(name).type != fs.FileType.NotFound:
            where.delete_file(name)
        where.move(own, name)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name.rsplit("/", 1)[1]], "docs": [len(writer.docs)], "ids": [writer.count]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))


def write_tokens(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, parts: int | None = None) -> DataFrame:
    """Write `docs` to files under `out` in ascending id order; returns the manifest (part, file, docs, ids, start)."""
    spark = session(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the hash parts rows of one repeated id among files; it follows the order within a file
    order = ["doc_id", F.xxhash64("text"), "text"]
    ranged = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    made = cut(ranged.mapInArrow(lambda it: _write(it, out, tokenizer, end_id), "part int, file string, docs long, ids long"), "manifest")
    return ids_before(made)


def ids_before(manifest: DataFrame, group: int = GROUP) -> DataFrame:
    """manifest(part, ids, ...) with start, the ids of all parts before: sums of groups of parts first, then within each group."""
    rows = manifest.withColumn("group", F.floor(F.col("part") / group))
    sums = rows.groupBy("group").agg(F.sum("ids").alias("ids"))
    earlier = sums.alias("a").join(sums.alias("b"), F.expr("b.group < a.group"), "left").groupBy(F.col("a.group").alias("group")).agg(F.coalesce(F.sum("b.ids"), F.lit(0)).alias("before"))
    within = F.sum("ids").over(W.partitionBy("group").orderBy("part")) - F.col("ids")
    return rows.withColumn("within", within).join(earlier, "group").withColumn("start", F.col("before") + F.col("within")).drop("group", "before", "within")


def _read(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    where, root = fs.FileSystem.from_uri(out)
    for b in batches:
        for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with where.open_input_file(f"{root}/{name}") as source:
                r = Reader(source)
                for lo in range(0, len(r.docs), 4096):
                    hi = min(lo + 4096, len(r.docs))
                    crc, k = [], lo
                    while k < hi:  # some documents at a time, at most about a million ids unless one holds more
                        m = max(k + 1, min(hi, int(np.searchsorted(r.starts, r.starts[k] + (1 << 20)))))
                        ids = r.ids(int(r.starts[k]), int(r.starts[m]))
                        at = r.starts[k : m + 1] - r.starts[k]
                        crc += [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(at, at[1:])]
                        k = m
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.docs[lo:hi], mask=r.nulls[lo:hi]), pa.array(start + r.starts[lo:hi]), pa.array(np.diff(r.starts[lo : hi + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )


def read_tokens(manifest: DataFrame, out: str) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    return manifest.select("file", "start").repartition(int(session(manifest).conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(lambda it: _read(it, out), READ_SCHEMA)


def token_round_trip(docs: DataFrame, tokenizer: str, out: str | None = None, **how) -> DataFrame:
    out = out or scratch(session(docs), "tokens")
    return read_tokens(write_tokens(docs, out, tokenizer, **how), out)
