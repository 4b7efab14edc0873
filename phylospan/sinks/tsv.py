"""Tab-separated outputs with '#' headers, and FASTA text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def config_header(settings: dict[str, object]) -> list[str]:
    """'# key: value' lines of a run's settings, in the given order; None is written as an empty value."""
    return [f"# {key}: {'' if value is None else value}" for key, value in settings.items()]


def render(column: str, kind: str) -> Column:
    """A column as text: True/False for booleans, NA for null, plain decimals for doubles, comma-packed arrays."""
    c = F.col(column)
    if kind == "boolean":
        text = F.when(c, "True").otherwise("False")
    elif kind in ("double", "float"):
        text = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    elif kind.startswith("array"):
        text = F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("NA")).otherwise(text).alias(column)


def to_lines(rows: DataFrame) -> DataFrame:
    """(line): each row's rendered columns joined by tabs."""
    return rows.select(F.concat_ws("\t", *(render(c, kind) for c, kind in rows.dtypes)).alias("line"))


def write_tsv(rows: DataFrame, path: str, header: list[str] | None = None, single_file: bool = False) -> None:
    """Writes text files with a '#' header line of column names, after `header` lines, at the top of every file.

    Every part file carries the header, so each can be read alone; readers skip '#' lines. single_file=True makes one
    file, for small results only.
    """
    top = [*(header or []), "#" + "\t".join(rows.columns)]
    lines = to_lines(rows)
    out = lines.coalesce(1) if single_file else lines

    def with_header(batches):
        import pandas as pd

        first = True
        for batch in batches:
            if first:
                yield pd.DataFrame({"line": top})
                first = False
            yield batch
        if first:
            yield pd.DataFrame({"line": top})

    out.mapInPandas(with_header, "line string").write.mode("overwrite").text(path)


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    """(line): FASTA text of (seq_id, description, seq), sequence lines of `width` letters."""
    parts = F.filter(F.split(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n"), lambda x: x != "")
    head = F.concat(F.lit(">"), F.when(F.startswith("description", "seq_id"), F.col("description")).otherwise(F.concat_ws(" ", "seq_id", F.nullif("description", F.lit("")))))
    return sequences.select(F.explode(F.concat(F.array(head), parts)).alias("line"))
