"""Fixed-width chunks of sequences and the restoration of coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.functions.text import strip_quotes


def explode_chunks(sequences: DataFrame, width: int, seq_id: str = "seq_id", seq: str = "seq") -> DataFrame:
    """(seq_id, chunk_idx, chunk_offset, chunk_seq): windows of `width`; the last may be short, an empty sequence has one.

    Ids lose their quote characters; a null sequence gives no row.
    """
    offsets = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(width))
    return (
        sequences.where(F.col(seq).isNotNull())
        .select(strip_quotes(F.col(seq_id).cast("string")).alias("seq_id"), F.col(seq).alias("_seq"), F.posexplode(offsets).alias("chunk_idx", "chunk_offset"))
        .select("seq_id", "chunk_idx", "chunk_offset", F.substring(F.col("_seq"), F.col("chunk_offset") + 1, F.lit(width)).alias("chunk_seq"))
    )


def restore_offsets(rows: DataFrame, width, columns: tuple[str, ...] = ("q_start", "q_end"), default: int | None = None) -> DataFrame:
    """rows with chunk_idx * width added to the coordinates. A value that is no number stays null, or becomes `default`
    before the offset is added. width: a number or a column of rows."""
    offset = F.col("chunk_idx").cast("bigint") * (F.col(width) if isinstance(width, str) else F.lit(width))
    value = lambda c: F.col(c).cast("string").try_cast("bigint")
    fixed = lambda c: value(c) if default is None else F.coalesce(value(c), F.lit(default))
    return rows.withColumns({c: fixed(c) + offset for c in columns})
