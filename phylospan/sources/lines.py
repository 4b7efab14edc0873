"""Parsers of line-based formats. Each takes a DataFrame of lines, so that files, tables and streams share them.

Lines come as (line, line_no, file); read_lines gives these for text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phylospan.functions.text import first_token, is_digits, normalise_label, strip_space
from phylospan.operators.malformed import HIT_COLUMNS, N_FIELDS


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, line_no, file) of text files. line_no orders the lines of a file (its value is not the line's number)."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("line_no"), F.col("_metadata.file_path").alias("file"))


def chunk_index(file: Column) -> Column:
    """The chunk number in a file name like chunk_12_rest; null when there is none."""
    return F.regexp_extract(F.element_at(F.split(file, "/"), -1), r"^[^_]*_([0-9]+)", 1).try_cast("int")


def tolerant_hits(lines: DataFrame, line: str = "line") -> DataFrame:
    """The other columns of lines and `fields`: stripped lines of exactly 21 tab-separated columns that aren't a header."""
    fields = F.split(strip_space(F.col(line)), "\t")
    return lines.withColumn("fields", fields).where((F.size("fields") == N_FIELDS) & (F.col("fields")[0] != "match") & ~F.startswith(F.col(line), F.lit("#"))).drop(line)


def typed_hits(parsed: DataFrame) -> DataFrame:
    """`fields` as the 21 typed columns; a value that isn't of its type becomes null."""
    def typed(k: int, kind: str) -> Column:
        field = F.col("fields")[k]
        if kind == "string":
            return field
        if kind == "array<int>":
            return F.transform(F.filter(F.split(field, ","), lambda x: x != ""), lambda x: x.try_cast("int"))
        return field.try_cast(kind)

    rest = [c for c in parsed.columns if c != "fields"]
    return parsed.select(*rest, *(typed(k, kind).alias(name) for k, (name, kind) in enumerate(HIT_COLUMNS)))


def tsv_rows(lines: DataFrame, columns: list[str], numeric: str | None = None, line: str = "line") -> DataFrame:
    """String columns of tab-separated lines: '#' lines and short ones are skipped, and rows whose `numeric` isn't digits."""
    rows = lines.where(F.col(line).isNotNull() & ~F.startswith(F.col(line), F.lit("#"))).withColumn("_f", F.split(line, "\t")).where(F.size("_f") >= len(columns))
    rest = [c for c in lines.columns if c != line]
    out = rows.select(*rest, *(F.col("_f")[k].alias(c) for k, c in enumerate(columns)))
    return out.where(is_digits(F.col(numeric))) if numeric else out


def named_table(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """String columns of tab-separated files whose '#' header names them; NA is null. A missing required column is an error.

    The header is the '#' line that holds tabs; files whose headers differ are an error.
    """
    text = spark.read.text(path)
    heads = [r[0] for r in text.where("startswith(value, '#') and contains(value, '\t')").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError(f"{path} needs one and the same header line in all files")
    columns = heads[0].lstrip("#").split("\t")
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    rows = tsv_rows(text, columns, line="value")
    return rows.select(*(F.nullif(F.col(c), F.lit("NA")).alias(c) for c in columns))


def species_rows(lines: DataFrame, line: str = "line", order: str = "line_no", normalise: bool = True) -> DataFrame:
    """(seq_id, species): blank and '#' lines skipped, a line without a label or with a word for none is unclassified
    (normalise=False keeps words and drops lines without a label), the last line of an id wins."""
    text = strip_space(F.col(line))
    fields = F.split(text, "\t")
    rows = lines.where((text != "") & ~F.startswith(text, F.lit("#"))).select(fields.alias("f"), F.col(order).alias("_order"))
    label = F.try_element_at("f", F.lit(2))
    rows = rows.select(F.trim(F.col("f")[0]).alias("seq_id"), (normalise_label(label) if normalise else F.trim(label)).alias("species"), "_order").where("species is not null")
    return rows.groupBy("seq_id").agg(F.max_by("species", "_order").alias("species"))


def similarity_rows(lines: DataFrame, least: float = 95.0, line: str = "line") -> DataFrame:
    """(q_id, t_id, ani) of query search tables. Each file's header names the columns ANI, Query_name and Ref_name; a column that
    it doesn't name is the third, seventh or sixth. Names are cut to their first word.
    """
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.lit(""))
    fields = F.split(F.col(line), "\t")
    at = lambda name, default: F.when(F.array_position("f", name) > 0, F.array_position("f", name)).otherwise(F.lit(default)).cast("int")
    heads = lines.select("file", fields.alias("f")).where(F.array_contains("f", "ANI")).groupBy("file").agg(F.min(F.struct(at("ANI", 3).alias("a"), at("Query_name", 7).alias("q"), at("Ref_name", 6).alias("r"))).alias("h"))
    rows = lines.select("file", fields.alias("f")).join(heads, "file", "left")
    pick = lambda part, default: F.try_element_at("f", F.coalesce(F.col(f"h.{part}"), F.lit(default)))
    rows = rows.select(pick("a", 3).try_cast("double").alias("ani"), first_token(pick("q", 7)).alias("q_id"), first_token(pick("r", 6)).alias("t_id"))
    return rows.where((F.col("ani") >= least) & F.col("q_id").isNotNull() & F.col("t_id").isNotNull()).select("q_id", "t_id", "ani")


def edge_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """(id1, id2, ani) of an all-against-all edge list with ANI at 2 and names at 5 and 6; the header isn't numeric and falls out."""
    fields = F.split(F.col(line), "\t")
    rows = lines.where(F.size(fields) >= 7).select(first_token(fields.getItem(5)).alias("id1"), first_token(fields.getItem(6)).alias("id2"), fields.getItem(2).try_cast("double").alias("ani"))
    return rows.where("ani is not null")


def taxon_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """Distinct (seq_id, species) of per-sequence classifier output: column 1 the id, column 2 the name up to '('."""
    fields = F.split(F.col(line), "\t")
    name = F.trim(F.split(fields.getItem(2), r"\(").getItem(0))
    return lines.where(F.size(fields) >= 3).select(fields.getItem(1).alias("seq_id"), name.alias("species")).distinct()


def report_labels(lines: DataFrame, file: str = "file", order: str = "line_no", line: str = "line") -> DataFrame:
    """(file, species): of each report's last line, the words from the sixth on joined by _; unclassified when there are none."""
    last = lines.groupBy(file).agg(F.max_by(line, order).alias("_last"))
    words = F.filter(F.split(F.trim("_last"), r"\s+"), lambda w: w != "")
    label = F.array_join(F.slice(words, 6, F.greatest(F.size(words) - 5, F.lit(0))), "_")
    return last.select(file, F.when((F.size(words) > 5), label).otherwise(F.lit("unclassified")).alias("species"))


def fasta_records(lines: DataFrame, line: str = "line", file: str = "file", order: str = "line_no") -> DataFrame:
    """(file, seq_id, description, seq, length) of FASTA lines of a table or a stream's batch: each record's lines joined in
    order, white space dropped. Files are better read by read_fasta, which needs no order.

    Lines before a file's first '>' are ignored. The id is the header's first word.
    """
    head = F.startswith(F.col(line), F.lit(">"))
    along = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_n", F.sum(head.cast("int")).over(along)).where("_n > 0")
    parts = rows.groupBy(file, "_n").agg(
        F.max(F.when(head, F.col(line))).alias("_head"), F.sort_array(F.collect_list(F.when(~head, F.struct(F.col(order).alias("o"), F.regexp_replace(F.trim(line), r"\s+", "").alias("s"))))).alias("_parts")
    )
    return parts.select(
        file, F.coalesce(first_token(F.expr("substring(_head, 2)")), F.lit("")).alias("seq_id"), F.trim(F.expr("substring(_head, 2)")).alias("description"), F.array_join("_parts.s", "").alias("seq")
    ).withColumn("length", F.length("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, seq_id, description, seq, length) of FASTA files, a record a row; a file is split over tasks.

    Records are cut at line feeds before '>', so no task needs a record's neighbours. `place` orders the records of all
    files. White space within sequences is dropped. Text before a file's first '>' must be blank; otherwise it makes
    a record with an empty id, which callers can look for.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("value"), F.monotonically_increasing_id().alias("place"), F.col("_metadata.file_path").alias("file"))
    first = F.startswith("value", F.lit(">"))
    text = F.when(first, F.expr("substring(value, 2)")).otherwise(F.col("value"))
    cut = F.locate("\n", F.col("_text"))
    head = F.when(cut > 0, F.expr("substring(_text, 1, locate('\n', _text) - 1)")).otherwise(F.col("_text"))
    rest = F.when(cut > 0, F.expr("substring(_text, locate('\n', _text) + 1)")).otherwise(F.lit(""))
    rows = raw.where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "").withColumn("_text", text)
    rows = rows.select("file", "place", strip_space(head).alias("description"), F.regexp_replace(rest, r"\s+", "").alias("seq"))
    return rows.select("file", "place", F.coalesce(first_token(F.col("description")), F.lit("")).alias("seq_id"), "description", "seq").withColumn("length", F.length("seq"))


def length_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """(seq_id, seq_length) of headerless lines 'id<tab>length'; lines without a whole number of base pairs are left out."""
    fields = F.split(F.col(line), "\t")
    rows = lines.where(F.size(fields) >= 2).select(F.trim(fields.getItem(0)).alias("seq_id"), F.trim(fields.getItem(1)).try_cast("bigint").alias("seq_length"))
    return rows.where("seq_id <> '' and seq_length is not null")


def count_fasta(lines: DataFrame, line: str = "line") -> DataFrame:
    """(n_records): lines that begin with '>'."""
    return lines.where(F.startswith(F.col(line), F.lit(">"))).agg(F.count(F.lit(1)).alias("n_records"))
