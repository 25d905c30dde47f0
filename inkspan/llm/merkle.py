"""Merkle manifest of a dataset by iterative DataFrame levels.

Each row is a leaf. Within its group (source) leaves get row numbers, each level divides them by the fanout, and every
run of children, sorted, is hashed into its parent, until a group has one node left: its subroot. The subroots, in the
order of their groups, make the root in the same way. Proofs then go down: per level, the runs are joined with the path
of their parent, and each child appends its siblings before it. A level has a fanout-th of the rows of the one below,
so all levels together cost half as much as the leaves alone (fanout 3), both ways.

No task sees a whole group: row numbers come from a range partitioning of (group, order), counted within each range and
shifted by the rows of the ranges before it, and runs are spread by (group, run). What reaches the driver is the size of
the largest group and the root.

A digest H is the lowercase hex SHA-256 of its inputs in a row, digests as hex text. A leaf is H of the fields, each `-`
if null, else its number of UTF-8 bytes, `:` and its value.

Defined results: null groups are one group, the first; leaves with null ids come first in theirs; rows that agree in id
are ordered by their digest, and equal rows are leaves of their own; an empty text is `0:`; an empty table gives an
empty result; other columns are not looked at, whatever their names; a table without one of the fields is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.llm.common import cut, quoted

FIELDS, FANOUT = ("doc_id", "source", "lang", "n_chars", "text"), 3
#: Nodes of a file of a level, about a megabyte.
FILE_NODES = 10_000
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """One field of a leaf: `-`, or byte count, `:` and value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(children: Column) -> Column:
    """H of an array of digests."""
    return F.sha2(F.array_join(children, ""), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, int, int]:
    """`rows` with idx, their 0-based place in their group by `order`, and n, the size of the group; the largest n; how many rows there are.

    Rows are dealt out by ranges of (group, order) and written; a row's place is its row number within its range, and
    the rows of its group in the ranges before. A group has at most as many counts as there are ranges.
    """
    number = F.monotonically_increasing_id()
    at = cut(rows.withColumn("tie", number).repartitionByRange(group, *order, "tie").drop("tie").withColumn("range", F.spark_partition_id()), "ranges")
    counts = at.groupBy(group, "range").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("before", F.sum("rows").over(W.partitionBy(group).orderBy("range")) - F.col("rows"))
    counts = cut(counts.withColumn("n", F.sum("rows").over(W.partitionBy(group))), "counts")
    place = F.row_number().over(W.partitionBy(group, "range").orderBy(*order))
    placed = at.withColumn("row", place).join(counts.drop("rows"), [group, "range"]).withColumn("idx", F.col("before") + F.col("row") - 1).drop("range", "row", "before")
    largest, every = counts.agg(F.max("n"), F.sum("rows")).first()
    return placed, largest or 0, every or 0


@dataclass
class Tree:
    """levels[k]: (grp, run, n, kids) of level k; level 0 has all groups, the others those with several nodes there. tops: (grp, level, node)."""

    levels: list[DataFrame]
    tops: DataFrame
    fanout: int


def _runs(nodes: DataFrame, fanout: int, level: int, most: int) -> DataFrame:
    """One level's runs, written in files of some size: `most` is a bound of its nodes."""
    kids = F.array_sort(F.collect_list(F.struct("idx", *[c for c in nodes.columns if c not in ("grp", "idx", "n")])))
    runs = nodes.groupBy("grp", F.floor(F.col("idx") / fanout).alias("run")).agg(F.max("n").alias("n"), kids.alias("kids"))
    return cut(runs.coalesce(-(-most // FILE_NODES) or 1), f"level{level}")


def climb(nodes: DataFrame, largest: int, every: int, fanout: int = FANOUT) -> Tree:
    """nodes(grp, idx, n, node, extra...): each level's runs hashed into parents until every group has one node.

    The number of levels follows from the size of the largest group, and that of their files from the number of nodes.
    """
    levels = [_runs(nodes, fanout, 0, every)]
    tops = levels[0].where("n = 1").select("grp", F.lit(0).alias("level"), F.col("kids")[0]["node"].alias("node"))
    while largest > 1:
        up = F.floor((F.col("n") + (fanout - 1)) / fanout)
        parents = levels[-1].where("n > 1").select("grp", F.col("run").alias("idx"), up.alias("n"), digest(F.col("kids.node")).alias("node"))
        largest, level = -(-largest // fanout), len(levels)
        tops = tops.unionByName(parents.where("n = 1").select("grp", F.lit(level).alias("level"), "node"))
        if largest > 1:
            # a group with several nodes has at most half as many runs
            levels.append(_runs(parents.where("n > 1"), fanout, level, every // 2**level))
    return Tree(levels, tops, fanout)


def descend(tree: Tree, tops: DataFrame) -> DataFrame:
    """Each node of level 0 with its path: structs of the siblings left and right of it, level by level, then its top's.

    tops: (grp, level, path, carried...), one row per group; what it carries goes to all nodes of the group.
    """
    carried = [c for c in tops.columns if c not in ("grp", "level", "path")]
    down = None
    for level in range(len(tree.levels) - 1, -1, -1):
        parents = tops.where(F.col("level") == level + 1).select("grp", F.lit(0).cast("long").alias("run"), "path", *carried)
        if down is not None:
            parents = parents.unionByName(down.select("grp", F.col("idx").alias("run"), "path", *carried))
        kid = tree.levels[level].where("n > 1").select("grp", "run", "kids").join(parents, ["grp", "run"]).select("grp", "kids", "path", *carried, F.posexplode("kids").alias("pos", "kid"))
        beside = lambda first, count: F.array_join(F.slice("kids.node", first, count), "")
        own = F.struct(beside(F.lit(1), F.col("pos")).alias("left"), beside(F.col("pos") + 2, F.lit(tree.fanout)).alias("right"))
        down = kid.select("grp", "kid.*", F.concat(F.array(own), "path").alias("path"), *carried)
    lone = tree.levels[0].where("n = 1").select("grp", F.col("kids")[0].alias("kid")).join(tops.where("level = 0"), "grp")
    return down.unionByName(lone.select("grp", "kid.*", "path", *carried))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def manifest(docs: DataFrame, also: Column | None = None, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT) -> DataFrame:
    """One row per row of `docs`: its id (`order`), leaf, subroot, root, and path, an array of (left, right) siblings.

    also: a further column of `docs` to keep, as `also`, such as the leaf that a changed copy of the row has.
    """
    key = F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit(""))  # null before all others
    leaves = docs.select(key.alias("grp"), quoted(order).alias("id"), leaf_digest([quoted(f) for f in fields]).alias("node"), (also if also is not None else F.lit(None).cast("string")).alias("also"))
    low = climb(*numbered(cut(leaves, "leaves"), "grp", "id", "node"), fanout=fanout)
    tops = cut(low.tops.withColumnRenamed("grp", "own").withColumn("grp", F.lit(0)), "subroots")
    high = climb(*numbered(tops, "grp", "own"), fanout=fanout)
    peak = high.tops.first()
    start = high.tops.select("grp", "level", F.array().cast(PATH).alias("path"))
    of = descend(high, start).select(F.col("own").alias("grp"), "level", F.col("node").alias("subroot"), "path")
    rows = descend(low, cut(of, "paths"))
    root = F.lit(peak.node if peak else None).cast("string")
    return rows.select(F.col("id").alias(order), F.col("node").alias("leaf"), "subroot", root.alias("root"), "path", "also")


def proofs(docs: DataFrame, order: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS, **how) -> DataFrame:
    """The manifest, a digest of each proof, and a test of it: in rows whose id's crc32 is even, the text loses its line feeds."""
    tampered = leaf_digest([F.replace(quoted(text), F.lit("\n"), F.lit("")) if f == text else quoted(f) for f in fields])
    changed = F.when(F.crc32(quoted(order).cast("string").cast("binary")) % 2 == 0, tampered)
    m = manifest(docs, changed, order=order, fields=fields, **how)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    m = m.withColumn("folded_root", folded(F.coalesce("also", "leaf"), F.col("path")))
    return m.select(order, "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of a decimal number's digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda r, one: xor(r >> 1, 3988292384 * (r & one)))), 4294967295)"


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _sql_tree(name: str, leaves: str) -> str:
    """CTEs: `name`(grp, lvl, idx, n, node) with all nodes, and `name`_path(grp, lvl, idx, lefts, rights), from tops down."""
    return f"""
{name}(grp, lvl, idx, n, node) AS (
  SELECT grp, 0, idx, n, node FROM {leaves}
  UNION ALL
  SELECT grp, max(lvl) + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY grp, idx // 3),
{name}_side AS (
  SELECT grp, lvl, idx, n, node,
         coalesce(string_agg(node, '' ORDER BY idx) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '' ORDER BY idx) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WINDOW run AS (PARTITION BY grp, lvl, idx // 3 ORDER BY idx)),
{name}_path(grp, lvl, idx, lefts, rights) AS (
  SELECT grp, lvl, idx, []::VARCHAR[], []::VARCHAR[] FROM {name} WHERE n = 1
  UNION ALL
  SELECT s.grp, s.lvl, s.idx, list_prepend(s.l, p.lefts), list_prepend(s.r, p.rights)
  FROM {name}_path p JOIN {name}_side s ON s.grp = p.grp AND s.lvl = p.lvl - 1 AND s.idx // 3 = p.idx AND s.n > 1)"""


_LEAF = "sha256(" + " || ".join(map(_sql_field, FIELDS)) + ")"
_TAMPERED = "sha256(" + " || ".join(_sql_field("replace(text, chr(10), '')" if f == "text" else f) for f in FIELDS) + ")"

ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {_LEAF} AS node,
         CASE WHEN ({_CRC.format("doc_id::VARCHAR")}) & 1 = 0 THEN {_TAMPERED} END AS also
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d),
{_sql_tree("low", "leaves")},
subroots AS (SELECT 0 AS grp, grp AS own, node, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
{_sql_tree("high", "subroots")},
proof AS (
  SELECT l.doc_id, l.node AS leaf, l.also, s.node AS subroot, (SELECT node FROM high WHERE n = 1) AS root,
         p.lefts || q.lefts AS lefts, p.rights || q.rights AS rights
  FROM leaves l JOIN low_path p ON p.grp = l.grp AND p.lvl = 0 AND p.idx = l.idx
  JOIN subroots s ON s.own = l.grp JOIN high_path q ON q.lvl = 0 AND q.idx = s.idx),
fold(doc_id, leaf, also, subroot, root, lefts, rights, k, h) AS (
  SELECT *, 0, coalesce(also, leaf) FROM proof
  UNION ALL
  SELECT doc_id, leaf, also, subroot, root, lefts, rights, k + 1, sha256(lefts[k + 1] || h || rights[k + 1]) FROM fold WHERE k < len(lefts))
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(list_zip(lefts, rights), lambda x: x[1] || x[2]), '')) AS proof_sha256,
       h AS folded_root, h = root AS verified
FROM fold WHERE k = len(lefts)
"""
