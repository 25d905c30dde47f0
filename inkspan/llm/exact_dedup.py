"""Exact de-duplication by skew-safe combining.

Equal texts are found in three combining steps, each of which compares the digest and the full content:

1. each map task combines the equal texts of its own partition (the partial half of the salted aggregate),
2. the partial groups meet by (digest, content, salt), so the copies of one text are spread over `salts` tasks,
3. the salt winners, at most `salts` per text, are combined globally by (digest, content).

Only small rows are joined back to the documents, by digest and salt: the winner of a digest goes to every salt that has
copies (a list of at most `salts` numbers), so a group is spread over as many tasks here, too. No list of group members
is ever built.

Defined results: a null text counts as empty; null ids never win while another id is in the group; of rows that agree
in id and text, the first in the order of all their columns stays; an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import ascii_lower, cut, quoted

SALTS = 64


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.coalesce(quoted(text_col).cast("string"), F.lit("")))
    return docs.select(quoted(id_col).alias("doc_id"), text.alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")


def _groups(keyed: DataFrame, salts: int) -> DataFrame:
    """(digest, content, keep_id, group_size, at): the winner and the size of each group, and the salts that have copies."""
    salted = keyed.groupBy("text_sha256", "norm", _salt(salts).alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("text_sha256", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("at"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = _keyed(docs, id_col, text_col)
    groups = _groups(keyed, salts).groupBy("text_sha256")
    groups = groups.agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    groups = cut(groups, "dedup")
    each_salt = lambda g: g.withColumn("salt", F.explode("at")).drop("at")
    ids = keyed.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies")).withColumn("salt", _salt(salts))
    joined = ids.join(each_salt(groups.drop("contents")), ["text_sha256", "salt"])
    clashing = groups.where("contents > 1").select("text_sha256")
    if not clashing.isEmpty():  # two contents with one digest: these few are joined by content
        apart = keyed.join(clashing, "text_sha256", "left_semi")
        exact = apart.groupBy("doc_id", "text_sha256", "norm").agg(F.count(F.lit(1)).alias("copies")).withColumn("salt", _salt(salts))
        joined = joined.join(clashing, "text_sha256", "left_anti").unionByName(
            exact.join(each_salt(_groups(apart, salts)), ["text_sha256", "norm", "salt"]).drop("norm")
        )
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def _first(docs: DataFrame) -> Column:
    """The least `row` in column order; maps, which have none, count as JSON."""
    unordered = [c for c, kind in docs.dtypes if "map<" in kind or kind == "variant"]
    if not unordered:
        return F.min("row")
    return F.min_by("row", F.struct(*[F.to_json(F.struct(F.col("row")[c])) if c in unordered else F.col("row")[c] for c in docs.columns]))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Of rows that agree in id and text, the first in column order stays, nulls before others."""
    kept = exact_dedup(docs, id_col, text_col, salts).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    text = ascii_lower(F.coalesce(quoted(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("own"), F.sha2(text, 256).alias("key"))
    staying = rows.join(kept, F.col("own").eqNullSafe(F.col("id")) & (F.col("key") == F.col("sha")), "left_semi")
    return staying.groupBy("own", "key").agg(_first(docs).alias("row")).select("row.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
