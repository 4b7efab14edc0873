"""The hit filter: identity, then divergence of query and reference, with a similarity fallback where it is unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.functions import intervals as iv
from phylospan.operators.lineage import UNCLASSIFIED_SPECIES, pair_divergence
from phylospan.operators.reference import in_pairs, is_unclassified, with_reference

SHORT_BP = 500
CLOSE = 95.0


def filter_identity(hits: DataFrame, least) -> DataFrame:
    """Hits with an identity of at least `least` percent (a number or a column of hits), with pct_identity.

    The five-digit rounded value is compared, so 89.999996 passes 90; an empty interval has no identity and is dropped.
    """
    least = F.col(least) if isinstance(least, str) else F.lit(least)
    identity = iv.percent_identity(F.col("n_match"), F.col("q_start"), F.col("q_end"))
    return hits.withColumn("pct_identity", identity).where(F.col("pct_identity") >= least)


def with_divergence(hits: DataFrame, paths: DataFrame) -> DataFrame:
    """hits (q_leaf, ref_leaf, ref_species) with divergence and, where it is unknown, divergence_reason."""
    out = pair_divergence(hits, paths, "q_leaf", "ref_leaf")
    blank = is_unclassified(F.col("q_leaf")) | is_unclassified(F.col("ref_species"))
    return out.withColumns({
        "divergence": F.when(~blank, F.col("divergence")),
        "divergence_reason": F.when(blank, F.lit(UNCLASSIFIED_SPECIES)).otherwise(F.col("divergence_reason")),
    })


def keep_divergent(hits: DataFrame, close_refs: DataFrame, least: float = 1.0) -> DataFrame:
    """Hits with a divergence of at least `least`, and those of unknown divergence that aren't similar to the query.

    Unknown divergence: with a query or reference under 500 bp, the crude identity must be in 0..95 (without 95; -1, a
    zero length, discards); else the pair must be absent from close_refs (q_name, t_name). ani_lt_95 is True for hits
    kept by similarity, null for the others.
    """
    known = hits.where(F.col("divergence").isNotNull() & (F.col("divergence") >= least)).withColumn("ani_lt_95", F.lit(None).cast("boolean"))
    unknown = in_pairs(hits.where(F.col("divergence").isNull()), close_refs, {"q_name": "q_name", "t_name": "t_name"}, "is_close")
    crude = iv.crude_identity(F.col("q_size"), F.col("ref_length"), F.col("n_match"))
    short = (F.col("q_size") < SHORT_BP) | (F.col("ref_length") < SHORT_BP)
    keep = F.when(short, (crude >= 0) & (crude < CLOSE)).otherwise(~F.col("is_close"))
    return known.unionByName(unknown.where(keep).drop("is_close").withColumn("ani_lt_95", F.lit(True)))


def filter_hits(hits: DataFrame, index: DataFrame, leaves: DataFrame, paths: DataFrame, close_refs: DataFrame, least_identity) -> DataFrame:
    """The whole filter. hits: 21 hit columns and q_species; leaves: (species, leaf_name) of the query species."""
    good = filter_identity(hits, least_identity)
    q_leaf = leaves.select(F.col("species").alias("q_species"), F.col("leaf_name").alias("q_leaf"))
    named = with_reference(good, index).join(q_leaf, "q_species", "left").withColumn("q_leaf", F.coalesce("q_leaf", F.lit("NA")))
    return keep_divergent(with_divergence(named, paths), close_refs)
