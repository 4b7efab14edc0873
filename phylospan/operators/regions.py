"""Regions: merge of overlap pairs across chunks, size filter, clustering and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.operators.periods import assign_periods, periods_and_gaps
from phylospan.session import materialise

META = ["t_name", "t_size", "t_start", "t_end", "pct_identity", "t_species", "divergence_time", "ani_lt_95", "ref_divergence", "ref_ani_lt_95"]


def compress(rows: DataFrame, keys: list[str], start: str = "q_start", end: str = "q_end") -> DataFrame:
    """rows with region, the start of the period they belong to: each next start is at most 1 after the largest end so far."""
    periods = periods_and_gaps(rows, keys, start, end).where("kind = 'period'").drop("kind")
    return assign_periods(rows, periods, keys, start).withColumnRenamed("period_start", "region").drop("period_end")


def region_bounds(rows: DataFrame, keys: list[str], region: str = "region", start: str = "q_start", end: str = "q_end") -> DataFrame:
    """(keys, region, region_start, region_end, n_rows)."""
    return rows.groupBy(*keys, region).agg(F.min(start).alias("region_start"), F.max(end).alias("region_end"), F.count(F.lit(1)).alias("n_rows"))


def size_filter(regions: DataFrame, least) -> DataFrame:
    """Regions of at least `least` (a number or a column) base pairs."""
    return regions.where(F.col("region_end") - F.col("region_start") >= (F.col(least) if isinstance(least, str) else F.lit(least)))


def cluster_gap(regions: DataFrame, keys: list[str], gap) -> DataFrame:
    """regions (disjoint in a key) with cluster_start and cluster_end: neighbours whose gap is at most `gap` (a number, or a
    column that is constant in a key) are one cluster; a gap of 0 or less leaves each on its own."""
    wide = regions.withColumn("_gap", (F.col(gap) if isinstance(gap, str) else F.lit(gap)).cast("bigint"))
    # Ends are moved out by the gap, so that what it joins overlaps or touches, and back again afterwards.
    reaching = wide.where("_gap > 0").select(*keys, "_gap", "region_start", (F.col("region_end") + F.col("_gap")).alias("_reach_end"))
    joined = periods_and_gaps(reaching, [*keys, "_gap"], "region_start", "_reach_end", reach=0).where("kind = 'period'")
    clusters = joined.select(*keys, "seg_start", (F.col("seg_end") - F.col("_gap")).alias("seg_end"))
    found = assign_periods(wide.where("_gap > 0"), clusters, keys, "region_start").withColumnsRenamed({"period_start": "cluster_start", "period_end": "cluster_end"})
    alone = wide.where("_gap is null or _gap <= 0").withColumns({"cluster_start": F.col("region_start"), "cluster_end": F.col("region_end")})
    return found.unionByName(alone).drop("_gap")


def process(rows: DataFrame, keys: list[str], least, gap) -> DataFrame:
    """rows with region, region_start, region_end of the final region they belong to: merge, then size filter, then
    clustering, in this order. Rows of small regions go.

    least and gap are numbers, or columns of rows that are constant in a key. A region's number is its start. Merging and
    assignment work on tiles of the position axis, so no key has to fit one task; rows are assigned once.
    """
    column = lambda x, name: (F.col(x) if isinstance(x, str) else F.lit(x)).cast("bigint").alias(name)
    bounds = rows.select(*keys, "q_start", "q_end", column(least, "_least"), column(gap, "_width"))
    merged = periods_and_gaps(bounds, [*keys, "_least", "_width"], "q_start", "q_end").where("kind = 'period'")
    # Written once: the clustering reads the kept regions several times, which are few beside the rows.
    kept = materialise(merged.where("seg_end - seg_start >= _least").select(*keys, "_width", F.col("seg_start").alias("region_start"), F.col("seg_end").alias("region_end")))
    final = cluster_gap(kept, keys, "_width").select(*keys, F.col("region_start").alias("seg_start"), F.col("region_end").alias("seg_end"), "cluster_start", "cluster_end")
    inside = assign_periods(rows, final, keys, "q_start").drop("period_start", "period_end")
    return inside.withColumn("region", F.col("cluster_start")).withColumnsRenamed({"cluster_start": "region_start", "cluster_end": "region_end"})


def summarise(members: DataFrame, index: DataFrame, keys: list[str], order: list[str], least_species: int = 2) -> DataFrame:
    """One row a region: first q_size and q_species, number of pairs, distinct leaves and mean divergence.

    members: keys, region, region_start, region_end, and the pair columns (t_name and divergence_time hold left,right).
    An id that the index lacks counts as its own leaf. Regions of fewer than `least_species` leaves are dropped. The mean
    is over all tokens that are numbers, four digits; null when there are none.
    """
    first = F.struct(*order)
    region = [*keys, "region"]
    numbers = F.filter(F.transform(F.split("divergence_time", ","), lambda x: F.trim(x).try_cast("decimal(18,4)")), lambda x: x.isNotNull())
    total = F.aggregate(numbers, F.lit(0).cast("decimal(28,4)"), lambda a, x: (a + x).cast("decimal(28,4)"))
    # One row a region and reference first, in one pass: its pairs' numbers are kept on the row of their first reference.
    ids = F.transform(F.split(F.coalesce("t_name", F.lit("")), ","), lambda x: F.trim(x))
    parts = members.select(*region, "region_start", "region_end", "q_size", "q_species", first.alias("_first"), total.alias("_sum"), F.size(numbers).alias("_n"), F.posexplode(ids).alias("_k", "seq_id"))
    head = F.col("_k") == 0
    by_id = parts.groupBy(*region, "seq_id").agg(
        F.first("region_start").alias("q_start"), F.first("region_end").alias("q_end"), F.min(F.struct("_first", "q_size", "q_species")).alias("_least"),
        F.sum(head.cast("bigint")).alias("n_pairs"), F.sum(F.when(head, F.col("_sum"))).alias("_sum"), F.sum(F.when(head, F.col("_n"))).alias("_n"),
    )
    out = by_id.join(index.select("seq_id", "leaf_name"), "seq_id", "left").groupBy(*region).agg(
        F.first("q_start").alias("q_start"), F.first("q_end").alias("q_end"), F.min("_least").alias("_least"), F.sum("n_pairs").alias("n_pairs"),
        F.count_distinct(F.coalesce("leaf_name", "seq_id")).alias("n_species"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"),
    )
    mean = F.when(F.col("_n") > 0, F.col("_sum").cast("double") / F.col("_n"))
    out = out.where(F.col("n_species") >= least_species)
    return out.select(*region, "q_start", "q_end", "_least.q_size", "_least.q_species", "n_pairs", "n_species", mean.alias("mean_divergence"))


def joined_members(members: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row a region with q_size and q_species of its first row, and each of `columns` joined by | in row order; a null
    becomes an empty piece."""
    columns = columns or [c for c in META if c in members.columns]
    entry = F.struct(*order, F.col("q_size").alias("m_q_size"), F.col("q_species").alias("m_q_species"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"m_{c}") for c in columns))
    rows = members.groupBy(*keys, "region").agg(
        F.first("region_start").alias("q_start"), F.first("region_end").alias("q_end"), F.sort_array(F.collect_list(entry)).alias("members")
    )
    of_first = [F.col("members")[0][f"m_{c}"].alias(c) for c in ("q_size", "q_species")]
    return rows.select(*keys, "q_start", "q_end", *of_first, *(F.array_join(F.col(f"members.m_{c}"), "|").alias(c) for c in columns))
