"""Per-key results when a few keys hold most rows (problem 3).

All results are algebraic SQL aggregates: every task keeps a bounded hash table of key states that spills, and only one
compact partial state a task and key is shuffled, however many rows a key has. Distinct counts go through one more
level, (key, value) pairs first, so that a hot key's values are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.functions.text import clean_id


def key_counts(rows: DataFrame, key: str = "q_name") -> DataFrame:
    """(key, n_rows) of every query id; null and blank ids are left out."""
    return rows.select(clean_id(F.col(key)).alias(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def heavy_keys(rows: DataFrame, key: str = "q_name", percent: int = 2) -> DataFrame:
    """The ids with at least `percent` of all rows; null and blank ids count in the total only. No rows, no ids."""
    total = rows.select(F.count(F.lit(1)).alias("total")).scalar()
    return key_counts(rows, key).where(F.col("n_rows") * 100 >= total * percent).select(key)


def hit_summary(hits: DataFrame) -> DataFrame:
    """One complete row a query id: hits, references, matched bases, extent and mean identity.

    Null and blank ids are left out; a null q_end or pct_identity is ignored by its aggregate only. Means are taken over
    five-digit decimals, so that they don't depend on the order of the rows. Extra columns are ignored.
    """
    rows = hits.select(
        clean_id(F.col("q_name")).alias("q_name"), "t_name", "n_match", "q_start", "q_end",
        F.col("pct_identity").cast("decimal(12,5)").alias("pct_identity"),
    ).where(F.col("q_name").isNotNull())
    by_reference = rows.groupBy("q_name", "t_name").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum("n_match").alias("n_match"), F.min("q_start").alias("min_start"),
        F.max("q_end").alias("max_end"), F.sum("pct_identity").alias("identity_sum"), F.count("pct_identity").alias("identity_n"),
    )
    return by_reference.groupBy("q_name").agg(
        F.sum("n_hits").alias("n_hits"), F.count("t_name").alias("n_references"), F.sum("n_match").alias("n_match"),
        F.min("min_start").alias("min_start"), F.max("max_end").alias("max_end"),
        (F.sum("identity_sum").cast("double") / F.nullif(F.sum("identity_n"), F.lit(0))).alias("mean_identity"),
    )
