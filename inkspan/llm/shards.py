"""Sharding by extendible hashing.

A row's key is hashed to 60 bits. A bucket is a prefix of them; one that holds more than the byte limit splits on its
next bit, and only that one, until every bucket fits. The sizes of all prefixes of the next LEVEL bits come from one
aggregate of a small table of hashes and sizes; only the rows of buckets that are still too large go on to the next
level. Keys that no bit parts go on with the bits of their content; rows that agree in key and content, and single rows
over the limit, are dealt out to numbered pages of a bucket. Rows find their shard by looking up their own bits in the
directory, so no row is ever matched with another one by its id.

Defined results: a null key hashes like the empty string, a null text has no bytes; a row larger than the limit has a
shard of its own; repeated rows are all kept; an empty table gives an empty result; other columns are not looked at and
are written as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructType

from inkspan.llm.common import cut, quoted, scratch, session, unused

LIMIT, BITS, LEVEL = 16 << 20, 60, 15
#: Entries of a directory that are broadcast at most, some 6 MB; a larger one is joined like any table.
SLIGHT = 100_000
OWN = ("node", "bits", "content", "n_bytes")


def hash_bits(text: Column) -> Column:
    """The first 60 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _leaves(rows: DataFrame, done: int, level: int, limit: int) -> DataFrame:
    """(node, cell, depth): where each prefix of done + level bits ends; depth is null if it goes on."""
    cells = rows.groupBy("node", F.shiftrightunsigned("bits", BITS - done - level).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("c"))
    cells = cut(cells, "cells")
    first = 0 if done == 0 else 1
    each = cells.select("node", F.explode(F.sequence(F.lit(first), F.lit(level))).alias("up"), "cell", "b", "c").withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {level} - up)"))
    fits = cut(each.groupBy("node", "up", "prefix").agg(F.sum("b").alias("b"), F.sum("c").alias("c")).where((F.col("b") <= limit) | (F.col("c") == 1)), "fits")
    # a bucket is a prefix that fits while the next shorter one doesn't; each cell lies in one at most
    shorter = fits.select("node", (F.col("up") + 1).alias("up"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    buckets = fits.join(shorter.hint("merge"), ["node", "up", "prefix"], "left_anti")
    wide = f"shiftleft(1L, {level} - up)"
    inside = buckets.select("node", (F.col("up") + done).alias("depth"), F.explode(F.expr(f"sequence(prefix * {wide}, (prefix + 1) * {wide} - 1)")).alias("cell"))
    return cells.select("node", "cell").join(inside.hint("merge"), ["node", "cell"], "left").select("node", "cell", "depth")


def _look_up(rows: DataFrame, leaves: DataFrame, done: int) -> DataFrame:
    small = leaves.count() <= SLIGHT
    return rows.withColumn("cell", F.shiftrightunsigned("bits", BITS - done - LEVEL)).join(F.broadcast(leaves) if small else leaves, ["node", "cell"], "left").drop("cell")


def _directory(rows: DataFrame, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The leaves of each level, and the rows that all 60 bits don't part."""
    out, done = [], 0
    while done < BITS:
        leaves = cut(_leaves(rows, done, LEVEL, limit), "leaves")
        out.append(leaves)
        if leaves.where("depth IS NULL").isEmpty():
            return out, None
        rows = cut(_look_up(rows, leaves, done).where("depth IS NULL").select(*OWN), "deeper")
        done += LEVEL
    return out, rows


def _named(rows: DataFrame, levels: list[DataFrame], mark: str) -> DataFrame:
    """`rows` with found, the name of their bucket by the levels of a directory; null if none parts them."""
    rows = rows.withColumn("found", F.lit(None).cast("string"))
    for k, leaves in enumerate(levels):
        rows = _look_up(rows, leaves, k * LEVEL)
        name = F.concat(F.col("node"), F.lit(mark), F.expr(f"left(lpad(bin(bits), {BITS}, '0'), depth)"))
        rows = rows.withColumn("found", F.coalesce("found", F.when(F.col("depth").isNotNull(), name))).drop("depth")
    return rows


def place(docs: DataFrame, limit: int = LIMIT, key_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_bytes, shard_id): every row of `docs` as a struct, with its shard."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    key = F.coalesce(quoted(key_col).cast("string"), F.lit(""))
    content = hash_bits(F.concat_ws("\x00", quoted(id_col).cast("string"), text))
    full = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.octet_length(text).cast("bigint").alias("n_bytes"), content.alias("content"), hash_bits(key).alias("bits"), F.lit("").alias("node"))
    levels, left = _directory(cut(full.select(*OWN), "rows"), limit)
    out = _named(full, levels, "")
    if left is None:
        return out.select("row", "n_bytes", F.col("found").alias("shard_id"))
    # keys of one hash: the bits of the content part them
    whole = lambda d: d.withColumn("node", F.lpad(F.bin("bits"), BITS, "0")).withColumn("bits", F.col("content"))
    levels, left = _directory(whole(left), limit)
    tied = _named(whole(out.where("found IS NULL").drop("found")), levels, ".")
    parts = out.where("found IS NOT NULL").select("row", "n_bytes", F.col("found").alias("shard_id"))
    if left is not None:  # equal rows, or a large one beside others of its hash: pages of a bucket
        pid = cut(tied.where("found IS NULL").select("row", "n_bytes", "node", "bits", F.spark_partition_id().alias("pid")), "pages")
        own = W.partitionBy("node", "bits", "n_bytes", "pid").orderBy(F.lit(0))
        counts = pid.groupBy("node", "bits", "n_bytes", "pid").agg(F.count(F.lit(1)).alias("c"))
        before = counts.withColumn("before", F.sum("c").over(W.partitionBy("node", "bits", "n_bytes").orderBy("pid")) - F.col("c")).drop("c")
        numbered = pid.withColumn("k", F.row_number().over(own) - 1).join(before, ["node", "bits", "n_bytes", "pid"])
        each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
        page = F.floor((F.col("k") + F.col("before")) / each)
        name = F.concat("node", F.lit("."), F.lpad(F.bin("bits"), BITS, "0"), F.lit("#"), F.col("n_bytes").cast("string"), F.lit("-"), page.cast("string"))
        parts = parts.unionByName(numbered.select("row", "n_bytes", name.alias("shard_id")))
    return parts.unionByName(tied.where("found IS NOT NULL").select("row", "n_bytes", F.col("found").alias("shard_id")))


def write_shards(docs: DataFrame, path: str | None = None, limit: int = LIMIT, key_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the rows of `docs`, one folder and one file a shard, and return the path. The folders' column is `shard`, with underscores if there is one."""
    path, name = path or scratch(session(docs), "shards"), unused("shard", docs)
    placed = place(docs, limit, key_col, id_col, text_col).select("row.*", F.col("shard_id").alias(name))
    # a shard lies in one task; more tasks than usual keep few shards from meeting in one
    placed.repartition(4 * int(session(docs).conf.get("spark.sql.shuffle.partitions")), name).write.partitionBy(name).parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, schema: StructType, text_col: str = "text") -> DataFrame:
    """The rows of written shards, whose schema was `schema`, with n_bytes, shard_id, depth (bits of the bucket) and shard_bytes."""
    name = "shard"
    while name in {f.name.lower() for f in schema.fields}:
        name += "_"
    kind = StructType([*schema.fields]).add(name, StringType())
    rows = spark.read.schema(kind).parquet(path).withColumn(name, F.coalesce(F.col(name), F.lit("")))  # an empty name is a null folder
    rows = rows.select(F.struct(*[quoted(f.name) for f in schema.fields]).alias("row"), F.coalesce(F.octet_length(quoted(text_col).cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(name).alias("shard_id"))
    sums = rows.groupBy("shard_id").agg(F.sum("n_bytes").alias("shard_bytes"))
    rest = F.substring_index("shard_id", ".", -1)
    depth = F.when(F.col("shard_id").contains("#"), 2 * BITS).when(F.col("shard_id").contains("."), BITS + F.length(rest)).otherwise(F.length("shard_id"))
    return rows.join(sums, "shard_id").select("row", "n_bytes", "shard_id", depth.cast("int").alias("depth"), "shard_bytes")


def shard(docs: DataFrame, limit: int = LIMIT, key_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write shards and read them back: one row per row of `docs`: doc_id, n_bytes, shard_id (the bucket's bits), depth, shard_bytes."""
    path = write_shards(docs, path, limit, key_col, id_col, text_col)
    back = read_shards(session(docs), path, docs.schema, text_col)
    return back.select(F.col("row")[id_col].alias("doc_id"), "n_bytes", "shard_id", "depth", "shard_bytes")


def oracle(limit: int = LIMIT) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
p AS (SELECT d.*, u.depth, substr(bits, 1, u.depth) AS prefix FROM d, (SELECT unnest(range(0, 61))::INT AS depth) u),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS c FROM p GROUP BY ALL),
f AS (SELECT p.doc_id, p.n_bytes, p.prefix AS shard_id, p.depth, s.shard_bytes,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
      FROM p JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {limit} OR s.c = 1)
SELECT doc_id, n_bytes, shard_id, depth, shard_bytes FROM f WHERE k = 1
"""
