"""The reference index and lookups in it, and tables of similar pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phylospan.functions.text import normalise_label
from phylospan.operators.lineage import UNKNOWN_LEAF, resolve_names


def build_index(lengths: DataFrame, species: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq_id, species, seq_length, leaf_name) of every sequence with a length.

    lengths: seq_id, seq_length. species: seq_id, species, one row an id; a sequence without one is unclassified. Labels
    that mean nothing are unclassified too, and get the leaf NA.
    """
    labelled = lengths.join(species.select("seq_id", "species"), "seq_id", "left").withColumn("species", normalise_label(F.col("species")))
    leaves = resolve_names(labelled, nodes)
    return labelled.join(leaves, "species", "left").select("seq_id", "species", "seq_length", F.coalesce("leaf_name", F.lit(UNKNOWN_LEAF)).alias("leaf_name"))


def with_reference(hits: DataFrame, index: DataFrame, column: str = "t_name") -> DataFrame:
    """hits with ref_species, ref_length, ref_leaf; unclassified, 0 and NA for an id that the index doesn't have."""
    looked = index.select(F.col("seq_id").alias(column), F.col("species").alias("ref_species"), F.col("seq_length").alias("ref_length"), F.col("leaf_name").alias("ref_leaf"))
    return hits.join(looked, column, "left").withColumns({
        "ref_species": F.coalesce("ref_species", F.lit("unclassified")),
        "ref_length": F.coalesce("ref_length", F.lit(0)),
        "ref_leaf": F.coalesce("ref_leaf", F.lit(UNKNOWN_LEAF)),
    })


def missing_references(hits: DataFrame, index: DataFrame, column: str = "t_name") -> DataFrame:
    """(id, n_hits) of the reference ids that hits name and the index lacks; a caller may fail on any row."""
    return hits.join(index.select(F.col("seq_id").alias(column)), column, "left_anti").where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_hits"))


def closest_pairs(edges: DataFrame, least: float = 95.0, left: str = "id1", right: str = "id2", value: str = "ani") -> DataFrame:
    """(id_lo, id_hi, ani): the largest value of each unordered pair at or above `least`; pairs of one id with itself are dropped."""
    return (
        edges.where((F.col(value) >= least) & (F.col(left) != F.col(right)))
        .groupBy(F.least(left, right).alias("id_lo"), F.greatest(left, right).alias("id_hi"))
        .agg(F.max(value).alias("ani"))
    )


def lookup_pair(rows: DataFrame, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """rows with `ani` of the unordered pair, null when the table lacks it."""
    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    keyed = rows.withColumns({"id_lo": F.when(both, F.least(left, right)), "id_hi": F.when(both, F.greatest(left, right))})
    return keyed.join(pairs, ["id_lo", "id_hi"], "left").drop("id_lo", "id_hi")


def in_pairs(rows: DataFrame, pairs: DataFrame, on: dict[str, str], flag: str) -> DataFrame:
    """rows with a boolean `flag`: whether the pair table has the row's key. on: column of rows -> column of pairs."""
    keys = pairs.select(*(F.col(p).alias(r) for r, p in on.items())).distinct().withColumn(flag, F.lit(True))
    return rows.join(keys, list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def is_unclassified(label: Column) -> Column:
    return F.coalesce(label.isin("unclassified", UNKNOWN_LEAF), F.lit(True))


def query_species(queries: DataFrame, listed: DataFrame | None = None, detected: DataFrame | None = None, single: str | None = None) -> DataFrame:
    """queries (seq_id) with q_species: the one given name, else the listed one, else the detected one, else unclassified.

    listed and detected: (seq_id, species), one row an id. Words that mean no label count as none.
    """
    if single:
        return queries.withColumn("q_species", F.lit(single))
    out = queries
    choices = []
    for k, table in enumerate(t for t in (listed, detected) if t is not None):
        label = normalise_label(F.col("species"))
        out = out.join(table.select("seq_id", F.when(label != "unclassified", label).alias(f"_species_{k}")), "seq_id", "left")
        choices.append(f"_species_{k}")
    return out.withColumn("q_species", F.coalesce(*choices, F.lit("unclassified"))).drop(*choices)
