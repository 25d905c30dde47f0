"""Benchmark decontamination by SimHash item-sized windows, with DataFrame functions only.

Words are runs of letters and digits in lower case; features are shingles of five words, weighted by how often they
occur. For each benchmark item the windows of its own length are compared with it: fingerprints that agree within
`radius` bits meet by equal Hamming blocks (radius + 1 blocks, so at least one agrees), and a candidate counts if the
exact weighted Jaccard similarity of shingles reaches the threshold.

A window of w shingles that reaches the threshold t with an item of m holds at least t (w + m) / (1 + t) of the item's
shingles, in whatever order. Windows are laid wherever that many lie close enough together: at every such shingle, and
at the last place of the document. Any other window of that similarity begins with a foreign shingle, and the next one
is no less similar; so the best window of every pair is among those laid. The radius of 19 bits is the method's own
limit: a similarity of 0.8 differs in 10 bits on average, and in over 19 with a chance of about 0.03 %.

Documents are read once for the places of shared shingles and, only those that hold enough of them, once more for the
windows of every 200 000 found pairs. Text is never shuffled, as the found pairs of a block are few enough to broadcast.

Defined results: null texts are empty; an item without words matches nothing; one of fewer than five words is one
shingle of all its words; a document shorter than the item is one window; equal items each match; rows with null ids
give pairs with a null id; repeated rows give one pair; of equally similar windows the first counts; an empty benchmark
or empty documents give an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, quoted, unused

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 19
#: Rows of four numbers that are broadcast at most, some 12 MB; a larger index of shingles is joined like any table.
SLIGHT = 200_000


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(h: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of `size` words; fewer words give one of all; none give none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(size)]))
    return F.when(F.size(h) >= size, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(s: Column) -> Column:
    """SimHash of weighted features: a bit is one if it is set in over half of them."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(s, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int")))
    picked = F.transform(bits, lambda n, b: F.when(n * 2 > F.size(s), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(picked, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def blocks(print_: Column, radius: int) -> Column:
    """The fingerprint's radius + 1 blocks of bits, each with its number."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    parts = [F.struct(F.lit(k).alias("no"), F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return F.array(*parts)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of lesser counts by sum of greater counts, over all shingles."""
    count = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def short_runs(h: Column, n: int) -> Column:
    """Hashes of all runs of n words, as `shingles` hashes an item of n words."""
    each = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n)))
    return F.when(F.size(h) >= n, each).otherwise(F.array().cast("array<bigint>"))


def _key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))


def _hits(rows: DataFrame, grams: Column, index: DataFrame, slight: bool) -> DataFrame:
    """(doc_id, content, grams, item_id, places): where a document has shingles of an item."""
    # the row number keeps the optimizer from computing the arrays once more in a filter below the explode
    each = rows.withColumn("s", grams).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "content", F.size("s").alias("grams"), "row", F.posexplode("s").alias("p", "shingle"))
    found = each.join(F.broadcast(index) if slight else index, "shingle")
    return found.groupBy("doc_id", "content", "grams", "row", "item_id", "n").agg(F.sort_array(F.collect_list("p")).alias("ps")).drop("row")


def laid_starts(places: Column, grams: Column, own: Column, threshold: float) -> Column:
    """Places of windows of `own` shingles that hold enough of an item's, which lie at `places` among `grams`."""
    width = F.least(own, grams)
    least = F.ceil((own + width) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    last = grams - width
    near = lambda p, k: (p <= last) & (F.get(places, k + least - 1) <= p + width - 1)
    at = F.filter(places, near)
    tail = F.when(F.size(F.filter(places, lambda p: p >= last)) >= least, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(at, tail))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, block: int = SLIGHT) -> DataFrame:
    """Pairs of a document and an item that it holds: doc_id, item_id, start (word of the best window), similarity."""
    item = items.select(quoted(item_id).cast("long").alias("item_id"), word_hashes(quoted(item_text)).alias("h")).where("size(h) > 0")
    # written between shingles and fingerprints, or the optimizer would compute the shingles anew for each bit
    item = cut(item.withColumn("s", shingles(F.col("h"))).select("item_id", F.size("h").alias("n"), "s").distinct(), "shingles")
    item = cut(item.withColumn("print", fingerprint(F.col("s"))), "items")
    index = cut(item.select("item_id", "n", F.explode("s").alias("shingle")).distinct(), "index")
    slight = index.count() <= block
    rows = _key(docs, id_col, text_col).select("doc_id", "content", word_hashes(F.col("text")).alias("h"), F.monotonically_increasing_id().alias("line"))
    found = [_hits(rows, shingles(F.col("h")), index.where(f"n >= {SHINGLE}"), slight).withColumn("own", F.col("n") - (SHINGLE - 1))]
    for r in item.where(f"n < {SHINGLE}").select("n").distinct().collect():  # at most SHINGLE - 1 rows
        found.append(_hits(rows, short_runs(F.col("h"), r.n), index.where(f"n = {r.n}"), slight).withColumn("own", F.lit(1)))
    hits = reduce(DataFrame.unionByName, found)
    laid = hits.withColumn("starts", laid_starts(F.col("ps"), F.col("grams"), F.col("own"), threshold)).where("size(starts) > 0")
    laid = cut(laid.select("doc_id", "content", "item_id", "n", "starts"), "laid")
    parts = max(1, -(-laid.count() // block))
    windows = []
    for k in range(parts):  # so many found pairs that one broadcast can't hold them are looked up in blocks
        mine = laid.where(F.pmod(F.xxhash64("content"), F.lit(parts)) == k) if parts > 1 else laid
        mine = mine.select(F.col("doc_id").alias("id"), F.col("content").alias("same"), "item_id", "n", "starts")
        own = _key(docs, id_col, text_col).join(F.broadcast(mine), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("same")))
        own = own.select("doc_id", "content", "item_id", "n", "starts", word_hashes(F.col("text")).alias("h"), F.monotonically_increasing_id().alias("line"))
        each = own.select("doc_id", "item_id", "n", "h", "line", F.explode("starts").alias("start"))
        windows.append(each.select("doc_id", "item_id", "start", F.slice("h", F.col("start") + 1, F.col("n")).alias("w"), "line"))
    windows = reduce(DataFrame.unionByName, windows)
    # windows of the same words are one, the first
    windows = windows.withColumn("s", shingles(F.col("w"))).groupBy("doc_id", "item_id", "s").agg(F.min("start").alias("start"))
    windows = cut(windows, "windows")
    prints = windows.withColumn("print", fingerprint(F.col("s"))).withColumn("block", F.explode(blocks(F.col("print"), radius)))
    theirs = item.select("item_id", F.col("s").alias("item_s"), F.col("print").alias("item_print")).withColumn("block", F.explode(blocks(F.col("item_print"), radius)))
    near = (
        prints.join(theirs, ["item_id", "block"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select("doc_id", "start", "item_id", "s", "item_s")
        .distinct()
    )
    good = near.withColumn("similarity", weighted_jaccard(F.col("s"), F.col("item_s"))).where(F.col("similarity") >= threshold - 1e-12)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back")))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", (-F.col("b.back")).cast("int").alias("start"), "b.similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns. A row with a null id is judged with the other such rows."""
    name = unused("gone", docs)
    gone = contaminated(docs, items, id_col, text_col, **how).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, quoted(id_col).cast("long").eqNullSafe(F.col(name)), "left_anti")
