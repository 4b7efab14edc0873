"""Runs of overlapping hits: generic gaps and islands, and the merge of neighbouring hits of one species.

Everything is window functions over sorted groups. Groups are one chunk of one query, never a whole query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCLASSIFIED = "unclassified"


def number_islands(rows: DataFrame, keys: list[str], order: list[str], start: str, end: str, gap: Column | int = 0, name: str = "island", inclusive: bool = True) -> DataFrame:
    """rows with the number of their island within the key: a new one begins where start > largest end so far + gap.

    With inclusive=False a row that only touches the island (start == end + gap) begins a new one.
    """
    along = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    limit = F.col("_reach") + gap
    begins = F.col("_reach").isNull() | (F.col(start) > limit if inclusive else F.col(start) >= limit)
    return (
        rows.withColumn("_reach", reach)
        .withColumn("_begins", begins.cast("int"))
        .withColumn(name, F.sum("_begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_reach", "_begins")
    )


def sessions(rows: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """(keys, session, first, last, n_rows): stretches of values of `order` at most `gap` apart."""
    numbered = number_islands(rows, keys, [order], order, order, gap, "session")
    return numbered.groupBy(*keys, "session").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n_rows"))


#: The columns of a hit that the merge carries, beside the group's keys.
CARE = ["q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end", "pct_identity", "q_species", "t_species", "divergence", "ani_lt_95"]


def merge_islands(hits: DataFrame, keys: list[str], columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Merged hits of each group: keys, the carried columns and emit_key, the order in which they come out.

    Equal rows count once. Groups of one row give nothing. In order of (q_start, q_end, t_name, rest), a classified hit
    joins the current island if it has its species and overlaps it by more than 0; only q_end grows, the rest stays the
    first row's. Unclassified hits come out as they are and don't break an island. strict=True also repeats two rows as
    the original procedure does: the first classified hit after leading unclassified ones comes out once unmerged, and
    in a group without classified hits the last row comes out twice.
    """
    columns = columns or [c for c in CARE if c in hits.columns]
    order = ["q_start", "q_end", "t_name", *(c for c in columns if c not in ("q_start", "q_end", "t_name"))]
    group = Window.partitionBy(*keys)
    sorted_group = group.orderBy(*order)
    so_far = sorted_group.rowsBetween(Window.unboundedPreceding, 0)
    blank = F.coalesce(F.col("t_species") == UNCLASSIFIED, F.lit(True))
    rows = hits.select(*keys, *columns).distinct()
    rows = rows.withColumns({"rn": F.row_number().over(sorted_group), "size": F.count(F.lit(1)).over(group), "blank": blank}).where("size > 1")
    classified = rows.where("not blank")
    along = Window.partitionBy(*keys).orderBy("rn")
    run_so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.lag("t_species").over(along) == F.col("t_species"), 0).otherwise(1)).over(run_so_far)
    classified = classified.withColumn("run", run)
    in_run = Window.partitionBy(*keys, "run").orderBy("rn")
    reach = F.max("q_end").over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("reach") > F.col("q_start"), 0).otherwise(1)
    classified = classified.withColumn("reach", reach).withColumn("island", F.sum(begins).over(run_so_far))
    merged = classified.groupBy(*keys, "island").agg(
        F.min_by(F.struct(*columns), "rn").alias("first"), F.max("q_end").alias("island_end"), F.min("rn").alias("rn")
    )
    # An island comes out when the next one begins, the last one at the end of the group.
    emit = F.coalesce(F.lead("rn").over(Window.partitionBy(*keys).orderBy("island")), F.lit(1 << 40))
    carried = [F.col(f"first.{c}").alias(c) if c != "q_end" else F.col("island_end").alias("q_end") for c in columns]
    merged = merged.withColumn("emit_key", emit.cast("bigint")).select(*keys, *carried, "emit_key")
    out = merged.unionByName(rows.where("blank").select(*keys, *columns, F.col("rn").cast("bigint").alias("emit_key")))
    if strict:
        marked = rows.withColumns({"n_classified": F.sum((~F.col("blank")).cast("int")).over(so_far), "any_classified": F.max((~F.col("blank")).cast("int")).over(group)})
        again = marked.where("(not blank and n_classified = 1 and rn > 1) or (any_classified = 0 and rn = size)")
        out = out.unionByName(again.select(*keys, *columns, F.when(F.col("blank"), F.lit(1 << 40)).otherwise(F.col("rn")).cast("bigint").alias("emit_key")))
    return out
