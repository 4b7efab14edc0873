"""Tree operators: ancestor paths, divergence of two leaves at their lowest common ancestor, and name resolution.

A tree is a DataFrame (name, parent, dist_root); the root's parent is null. Names are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospan.functions.text import NULL_WORDS
from phylospan.session import materialise

UNKNOWN_LEAF = "NA"
NOT_IN_TREE = "unk:unable_to_find_ref_species_in_tree"
UNCLASSIFIED_SPECIES = "unk:unclassified_species"


def reached_root(nodes: DataFrame, reach: int) -> bool:
    """Whether no node (name, next) has further ancestors; a circle of parents, which never ends, is an error."""
    if nodes.where("next is not null").isEmpty():
        return True
    if reach > nodes.count():
        raise ValueError("the parents of the tree form a circle")
    return False


def root_distances(edges: DataFrame, expected: int = 64) -> DataFrame:
    """edges (name, parent, branch and others) with dist_root, the sum of the branches up to the root, and depth, their number.

    Pointer jumping: each step doubles the reach, with a row a node, until all nodes have reached a root; from `expected`
    levels on each step is looked at. A parent that is no name ends a path like a root.
    """
    nodes = edges.withColumns({"dist_root": F.col("branch"), "depth": F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint"), "_next": F.col("parent")})
    reach = 1
    while True:
        if reach >= expected or reach in (4, 16, 64, 256):
            nodes = materialise(nodes)  # each doubling reads the plan twice
        if reach >= expected and reached_root(nodes.withColumn("next", F.col("_next")), reach):
            return nodes.drop("_next")
        further = nodes.select(F.col("name").alias("_next"), F.col("dist_root").alias("_more"), F.col("depth").alias("_deeper"), F.col("_next").alias("_after"))
        nodes = nodes.join(further, "_next", "left").withColumns({
            "dist_root": F.col("dist_root") + F.coalesce("_more", F.lit(0.0)), "depth": F.col("depth") + F.coalesce("_deeper", F.lit(0)), "_next": F.col("_after"),
        }).drop("_more", "_deeper", "_after")
        reach *= 2


def ancestor_paths(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """(name, path): each node's names and root distances from itself up to the root.

    Paths double in length with every join (pointer jumping), so a tree of depth d takes log2(d) joins; every second
    step is written to the shared folder, so that the plan doesn't double as well. max_depth is the expected depth: from
    there on, each step is written and looked at, and it goes on until all paths end at a root.
    """
    paths = nodes.select(
        "name", F.col("parent").alias("next"), F.array(F.struct(F.col("name").alias("name"), F.col("dist_root").alias("dist"))).alias("path")
    )
    reach = 1
    while True:
        if reach >= max_depth or reach in (4, 16, 64, 256):
            paths = materialise(paths)  # each doubling reads the plan twice
        if reach >= max_depth and reached_root(paths, reach):
            return paths.select("name", "path")
        further = paths.select(F.col("name").alias("next"), F.col("path").alias("further"), F.col("next").alias("after"))
        paths = paths.join(further, "next", "left").select(
            "name", F.col("after").alias("next"), F.when(F.col("further").isNull(), F.col("path")).otherwise(F.concat("path", "further")).alias("path")
        )
        reach *= 2


def _names(path: Column) -> Column:
    return F.transform(path, lambda x: x["name"])


def divergence_of_paths(left: Column, right: Column) -> Column:
    """Half the path length between two leaves, from their ancestor paths; null where either path is null or they have no common ancestor."""
    common = F.get(F.array_intersect(_names(left), _names(right)), 0)
    at = F.get(F.filter(left, lambda x: x["name"] == common), 0)["dist"]
    return (F.element_at(left, 1)["dist"] + F.element_at(right, 1)["dist"] - 2 * at) / 2


def pair_divergence(pairs: DataFrame, paths: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with `divergence` (null when unknown) and `divergence_reason` (null when known).

    Each distinct unordered pair of leaves is computed once. NA leaves give a reason; a name that isn't in the tree too.
    """
    both = F.col(left).isNotNull() & F.col(right).isNotNull()  # least and greatest would skip a null
    low, high = F.when(both, F.least(left, right)), F.when(both, F.greatest(left, right))
    distinct = pairs.select(low.alias("leaf_lo"), high.alias("leaf_hi")).where("leaf_lo is not null and leaf_hi is not null").distinct()
    known = (
        distinct.join(paths.select(F.col("name").alias("leaf_lo"), F.col("path").alias("path_lo")), "leaf_lo")
        .join(paths.select(F.col("name").alias("leaf_hi"), F.col("path").alias("path_hi")), "leaf_hi")
        .select("leaf_lo", "leaf_hi", divergence_of_paths(F.col("path_lo"), F.col("path_hi")).alias("divergence"))
    )
    keyed = pairs.withColumns({"leaf_lo": low, "leaf_hi": high}).join(known, ["leaf_lo", "leaf_hi"], "left").drop("leaf_lo", "leaf_hi")
    return keyed.withColumn("divergence_reason", F.when(F.col("divergence").isNull(), F.lit(NOT_IN_TREE)))


def resolve_names(names: DataFrame, nodes: DataFrame, column: str = "species") -> DataFrame:
    """Distinct (species, leaf_name): the tree node that a species name stands for, NA when none.

    Tried in order: 'Genus_species_rest' as a whole, 'Genus_species' (names of three words or more), 'Genus', then the
    first node (by order) whose name contains 'Genus with its opening quote. nodes: name (quoted), order (preorder).
    A one-word name is matched as a whole only. The last step joins on the first quoted word, an equality.
    """
    wanted = names.select(F.col(column).alias("species")).where("species is not null").distinct()
    words = F.split(F.trim("species"), r"\s+")
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    keyed = wanted.select(
        "species",
        quoted(F.array_join(words, "_")).alias("whole"),
        F.when(F.size(words) >= 3, quoted(F.array_join(F.slice(words, 1, 2), "_"))).alias("two"),
        F.when(F.size(words) >= 2, quoted(words.getItem(0))).alias("genus"),
        F.when(F.size(words) >= 2, words.getItem(0)).alias("prefix"),
    )
    plain = nodes.select("name", "order").where("name is not null")
    first_words = plain.select(F.regexp_extract("name", r"^'([^_']+)", 1).alias("prefix"), "name", "order").where("prefix <> ''")
    by_prefix = first_words.groupBy("prefix").agg(F.min_by("name", "order").alias("by_prefix"))
    out = keyed
    for key in ("whole", "two", "genus"):
        out = out.join(plain.select(F.col("name").alias(key), F.col("name").alias(f"by_{key}")), key, "left")
    out = out.join(by_prefix, "prefix", "left")
    unclassified = F.lower(F.trim("species")).isin("unclassified", *NULL_WORDS)
    found = F.coalesce("by_whole", "by_two", "by_genus", "by_prefix", F.lit(UNKNOWN_LEAF))
    return out.select("species", F.when(unclassified, F.lit(UNKNOWN_LEAF)).otherwise(found).alias("leaf_name"))
