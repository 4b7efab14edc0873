"""Trees in Newick text as (name, parent, dist_root) rows.

The parse is relational: tokens carry their nesting depth (a running sum of brackets), and a node's parent is the
bracket that closes next at its depth. Quoted names keep their quotes; unnamed inner nodes are named by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospan.operators.lineage import root_distances
from phylospan.operators.periods import assign_periods
from phylospan.session import materialise

TILE = 1 << 16
_TOKENS = r"'(?:[^']|'')*'(?::[0-9.eE+\-]+)?|[(),;]|[^(),;\s]+"


def _running_sum(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` up to and with each row in order of `order`, a bigint: sums of tiles of the order first,
    then sums within tiles, so that only one row a tile is in one task."""
    tiled = rows.withColumn("_tile", F.expr(f"{order} div {TILE}"))
    before = F.sum("_all").over(Window.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1))
    starts = tiled.groupBy("_tile").agg(F.sum(value).alias("_all")).select("_tile", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.sum(value).over(Window.partitionBy("_tile").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return tiled.withColumn("_within", within).join(starts, "_tile").withColumn(name, F.col("_start") + F.col("_within")).drop("_tile", "_within", "_start")


def newick_edges(trees: DataFrame, text: str = "line", order: str = "line_no") -> DataFrame:
    """(name, parent, branch, pos): one row a node of the tree; the root's parent is null, a missing branch length is 0.

    A tree may be written over several lines, which `order` puts in order (without such a column there must be one line);
    no token goes over the end of a line. Several trees one after another are a forest. Names must be unique.
    """
    if order not in trees.columns:
        trees = trees.withColumn(order, F.lit(0).cast("bigint"))
    found = trees.where(F.col(text).isNotNull()).select(F.col(order).cast("bigint").alias("_line"), F.regexp_extract_all(F.col(text), F.lit(_TOKENS), F.lit(0)).alias("_tokens"))
    placed = _running_sum(found.withColumn("_n", F.size("_tokens").cast("bigint")), "_line", "_n", "_upto")
    tokens = placed.select((F.col("_upto") - F.col("_n")).alias("_from"), F.posexplode("_tokens").alias("_k", "token")).select((F.col("_from") + F.col("_k")).alias("pos"), "token")
    signs = materialise(_running_sum(tokens.withColumn("_step", F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0).cast("bigint")), "pos", "_step", "depth").drop("_step"))
    beside = lambda shift, name: signs.select((F.col("pos") + shift).alias("pos"), F.col("token").alias(name))
    marks = signs.join(beside(1, "before"), "pos", "left").join(beside(-1, "after"), "pos", "left")
    punctuation = F.col("token").isin("(", ")", ",", ";")
    # A closing bracket stands for its inner node; a label right after it names that node.
    nodes = marks.where(~punctuation & (F.coalesce(F.col("before"), F.lit("(")) != ")") | (F.col("token") == ")"))
    label = F.when(F.col("token") == ")", F.when(~F.col("after").isin("(", ")", ",", ";"), F.col("after"))).otherwise(F.col("token"))
    named = nodes.select(
        "pos", "depth", (F.col("token") == ")").alias("closes"),
        F.regexp_extract(F.coalesce(label, F.lit("")), r"^('(?:[^']|'')*'|[^:]*)", 1).alias("name"),
        F.coalesce(F.regexp_extract(F.coalesce(label, F.lit("")), r":([0-9.eE+\-]+)$", 1).try_cast("double"), F.lit(0.0)).alias("branch"),
    ).withColumn("name", F.when(F.col("name") == "", F.concat(F.lit("node_"), F.col("pos").cast("string"))).otherwise(F.col("name")))
    named = materialise(named)
    # Children at depth d belong to the next bracket whose depth after closing is d - 1: the last one before them backwards.
    forever = F.lit(1 << 62).cast("bigint")
    closing = named.where("closes").select((F.col("depth") + 1).alias("level"), (-F.col("pos")).alias("seg_start"), forever.alias("seg_end"), F.col("name").alias("parent"))
    children = named.select(F.col("depth").alias("level"), (-F.col("pos")).alias("back"), "pos", "name", "branch")
    # A node's own bracket closes at its own level, so it is never its own parent; roots stand at depth 0.
    inner = assign_periods(children.where("level > 0"), closing, ["level"], "back").select("name", "parent", "branch", "pos")
    return inner.unionByName(children.where("level <= 0").select("name", F.lit(None).cast("string").alias("parent"), "branch", "pos"))


def newick_nodes(trees: DataFrame, text: str = "line", max_depth: int = 64) -> DataFrame:
    """(name, parent, dist_root, order): the tree's nodes with their distance from the root (pointer jumping).

    max_depth is the expected depth; deeper trees take further steps until all nodes have reached the root.
    """
    nodes = root_distances(materialise(newick_edges(trees, text)), max_depth)
    return nodes.select("name", "parent", "dist_root", F.col("pos").alias("order"))
