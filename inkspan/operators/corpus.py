"""Candidate sources: canonical URLs, interleaving, hydration, diagnostics, reranking, histories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkspan.functions.text import let, trim_ws, url_key, words
from inkspan.sources.tables import kept, spread

#: Query vectors of a block and vectors of a tile, on average; how far a product may be off, and the norms for which that holds.
BLOCK, TILE, SLACK, SAFE = 1000, 2048, 1e-9, (1e-100, 1e100)


def dedupe_by_url(candidates: DataFrame, *order: str) -> DataFrame:
    """The first row of every canonical URL by `order`, combined before the shuffle."""
    first = F.min_by(F.struct(*candidates.columns), F.struct(*order))
    return candidates.groupBy(url_key(F.col("url")).alias("by")).agg(first.alias("row")).select("row.*")


def interleave(candidates: DataFrame, group: str, pos: str, block: int = 1024) -> DataFrame:
    """Round robin over groups, as a place in the whole list. (group, pos) are unique; pos counts from 1.

    A place is the rows of all groups before this row's block of positions, and the place within the block, so no task
    sees more than a block of every group. The rows before a block are running sums in two steps: over blocks of blocks,
    whose number alone goes to one task, and over the blocks within each.
    """
    rows = candidates.withColumn("at_block", F.floor(F.col(pos) / block))
    sums = rows.groupBy("at_block").agg(F.count(F.lit(1)).alias("rows")).withColumn("wide", F.floor(F.col("at_block") / block))
    within_wide = W.partitionBy("wide").orderBy("at_block")
    wide = sums.groupBy("wide").agg(F.sum("rows").alias("wide_rows")).withColumn("wide_before", F.sum("wide_rows").over(W.orderBy("wide")) - F.col("wide_rows"))
    before = sums.withColumn("own_before", F.sum("rows").over(within_wide) - F.col("rows")).join(wide, "wide")
    before = before.select("at_block", (F.col("wide_before") + F.col("own_before")).alias("before"))
    within = F.row_number().over(W.partitionBy("at_block").orderBy(pos, group))
    return rows.withColumn("within", within).join(before, "at_block").withColumn("place", (F.col("before") + F.col("within")).cast("int")).drop("at_block", "before", "within")


def complete(candidates: DataFrame) -> DataFrame:
    return candidates.where(" AND ".join(f"coalesce({c}, '') <> ''" for c in ("title", "url", "snippet")))


def hydrate(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates with the text of their page where they hold none of their own."""
    p = pages.select(url_key(F.col("url")).alias("url_key"), F.col("text").alias("page_text"))
    p = p.groupBy("url_key").agg(F.max("page_text").alias("page_text"))
    own = F.when(F.length(F.coalesce("source_text", F.lit(""))) > 160, F.col("source_text"))
    return candidates.withColumn("url_key", url_key(F.col("url"))).join(p, "url_key", "left").withColumn("source_text", F.coalesce(own, "page_text", "source_text")).drop("page_text")


def merge_diagnostics(facts: DataFrame, seq: str) -> DataFrame:
    """Counters summed by provider, and the last reason for a skip."""
    sums = [F.sum(c).alias(c) for c in ("attempted", "succeeded", "failed", "timed_out", "results")]
    return facts.groupBy("provider").agg(*sums, F.max_by(F.col("skipped_reason"), F.when(F.col("skipped_reason").isNotNull(), F.col(seq))).alias("skipped_reason"))


def diagnostics_notes(merged: DataFrame) -> DataFrame:
    """(provider, note): what each provider did; the parts of the note that counts all providers."""
    issue = F.when(F.col("failed") > 0, F.format_string(", %d пом.", "failed")).otherwise("")
    told = F.concat(F.format_string("%s: %d/%d, %d рез.", "provider", "succeeded", "attempted", "results"), issue)
    return merged.select("provider", F.when(F.col("attempted") == 0, F.concat("provider", F.lit(": пропущено"))).otherwise(told).alias("note"))


def near_ids(tile: pa.StructArray, queries: pa.StructArray, most: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(query ids, vector ids, cosines) of a tile of vectors(id, e): for each query all that could be among its `most` best in the tile.

    Cosines are off by rounding, so all within SLACK of the last count. Pairs whose cosine is null, as their lengths
    differ or a component is null, come last and by id, so the first ids do; lengths out of SAFE are all taken (NaN).
    """

    def parts(rows: pa.StructArray) -> tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        ids, arrays, by = rows.field(0), rows.field(1), {}
        whole = np.array([a is not None and None not in a for a in arrays.to_pylist()], bool) if arrays.null_count or arrays.flatten().null_count else np.ones(len(rows), bool)
        size = pc.fill_null(pc.list_value_length(arrays), -1).to_numpy(zero_copy_only=False)
        for n in np.unique(size[whole]):
            at = np.flatnonzero(whole & (size == n))
            x = arrays.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(1))
                by[int(n)] = at, x / norm[:, None], (norm > SAFE[0]) & (norm < SAFE[1])
        return ids, by

    (ids, vs), (q_ids, qs) = parts(tile), parts(queries)
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)
    found_q, found_v, found_c = [], [], []

    def add(q: np.ndarray, v: np.ndarray, c: np.ndarray) -> None:
        found_q.append(q), found_v.append(v), found_c.append(c)

    of_query = {int(k): n for n, (at, _, _) in qs.items() for k in at}
    for n, (q_at, q, q_safe) in qs.items():
        if n not in vs:
            continue
        v_at, v, v_safe = vs[n]
        with np.errstate(all="ignore"):
            c = q[q_safe] @ v[v_safe].T
        if c.size:
            least = np.partition(c, -most, axis=1)[:, -most] if c.shape[1] > most else np.full(len(c), -np.inf)
            i, j = np.nonzero(c >= (least - SLACK)[:, None])
            add(q_at[q_safe][i], v_at[v_safe][j], c[i, j])
        for some, others in ((q_at, v_at[~v_safe]), (q_at[~q_safe], v_at[v_safe])):
            add(np.repeat(some, len(others)), np.tile(others, len(some)), np.full(len(some) * len(others), np.nan))
    for k in range(len(queries)):
        at = vs[of_query[k]][0] if of_query.get(k) in vs else np.zeros(0, int)
        if len(at) < len(tile):
            first = order[~np.isin(order, at)][:most]
            add(np.full(len(first), k), first, np.full(len(first), np.nan))
    if found_q:
        q, v, c = map(np.concatenate, (found_q, found_v, found_c))
        yield q_ids.take(pa.array(q)), ids.take(pa.array(v)), c


def rerank(vectors: DataFrame, query: DataFrame, most: int) -> DataFrame:
    """Vectors by cosine similarity to each query vector, the best first.

    Vectors are dealt into tiles, queries into blocks; a tile meets a block as two matrices and leaves only what could be
    among a query's best. The cosines of these alone are computed by Spark and ranked, so rounding decides nothing.
    """
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    tile = F.pmod(F.monotonically_increasing_id(), F.lit(max(1, -(-vectors.count() // TILE))))
    tiles = kept(vectors.select(tile.alias("tile"), F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("e")).alias("v")).groupBy("tile").agg(F.collect_list("v").alias("vs")).drop("tile"), "tiles")
    n = max(1, -(-query.count() // BLOCK))
    blocks = query.groupBy(F.pmod(F.monotonically_increasing_id(), F.lit(n))).agg(F.collect_list(F.struct(F.col("query_id").alias("id"), F.col("q").alias("e"))).alias("qs")).select("qs")
    kinds = {f.name: f.dataType for f in [*vectors.schema, *query.schema]}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                for q, v, c in near_ids(b.column(0)[k].values, b.column(1)[k].values, most):
                    yield pa.RecordBatch.from_arrays([q, v, pa.array(c)], ["query_id", "vec_id", "about"])

    # a tile and a block are some MB; both sides grow, so neither is broadcast whole
    pairs = spread(tiles).crossJoin(blocks).select("vs", "qs").mapInArrow(near, StructType([StructField("query_id", kinds["query_id"]), StructField("vec_id", kinds["vec_id"]), StructField("about", DoubleType())]))
    sure = F.when(~F.isnan("about"), F.col("about"))
    per = W.partitionBy("query_id")
    pairs = pairs.withColumn("about", sure).withColumn("turn", F.row_number().over(per.orderBy(F.desc("about"))))
    pairs = pairs.withColumn("least", F.max(F.when(F.col("turn") == most, F.col("about"))).over(per)).where(F.coalesce(F.col("about") >= F.col("least") - SLACK, F.lit(True)))
    pairs = pairs.select(F.col("query_id").alias("of"), F.col("vec_id").alias("id")).distinct()
    both = pairs.join(vectors, F.col("id").eqNullSafe(F.col("vec_id"))).join(query, F.col("of").eqNullSafe(F.col("query_id"))).withColumn("cosine", dot / (norm("embedding") * norm("q")))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "vec_id", "rank", "cosine")


def text_of_index(index: DataFrame) -> DataFrame:
    """(doc_id, map of word -> places) -> the words in order."""
    each = F.flatten(F.transform(F.map_entries("places"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("word")))))
    text = let(F.sort_array(each), lambda at: F.when(F.size(at) > 0, F.array(F.array_join(F.transform(at, lambda x: x["word"]), " "))))
    return index.select("doc_id", F.explode(text).alias("text"))


def word_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, map of word -> places), a row for each row with words: an index belongs to one text, so it is made beside it, without a shuffle."""

    def places(w: Column) -> Column:
        def runs(s: Column) -> Column:
            heads = F.filter(F.transform(s, lambda e, i: F.when((i == 0) | (F.get(s, i - 1)["word"] != e["word"]), i)), lambda i: i.isNotNull())
            of = lambda h: F.transform(h, lambda p, k: F.struct(F.get(s, p)["word"].alias("word"), F.transform(F.sequence(p, F.coalesce(F.get(h, k + 1), F.size(s)) - 1), lambda j: F.get(s, j)["p"]).alias("ps")))
            return F.map_from_entries(let(heads, of))

        at = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("p"))))
        return F.when(F.size(w) > 0, F.array(let(at, runs)))

    return docs.select("doc_id", F.explode(let(words(F.col(text)), places)).alias("places"))


def unlike_labels(opinions: DataFrame, local: DataFrame) -> DataFrame:
    """Opinion signals whose label no local signal has."""
    key = lambda d: F.lower(trim_ws(d.label))
    return opinions.join(local.select(F.col("doc_id").alias("d"), key(local).alias("l")), (F.col("doc_id") == F.col("d")) & (key(opinions) == F.col("l")), "left_anti")


def newest(reports: DataFrame, ts: str, tie: str, most: int = 10) -> DataFrame:
    return reports.orderBy(F.desc(ts), F.desc(tie)).limit(most)
