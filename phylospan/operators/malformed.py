"""Separation of rows that fail to parse (problem 1).

Record blocks are parsed in bulk with Arrow kernels. A block with any irregular record fails as a whole and is
bisected until the failing part is a few records, which are then diagnosed one by one with the full quoting rules.
Every input partition is handled on its own: no shuffle, no state beyond one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phylospan.functions.text import NULL_WORDS

N_FIELDS, Q_NAME, Q_SIZE, Q_START, Q_END = 21, 9, 10, 11, 12
PREAMBLE_LINES = 5
MAX_BULK_DIGITS = 18  # longer digit runs go to the strict parser, which has no integer limit

#: The columns of a hit, in file order: (name, Spark type).
HIT_COLUMNS = [
    ("n_match", "int"), ("n_mismatch", "int"), ("n_rep_match", "int"), ("n_ns", "int"),
    ("q_gap_count", "int"), ("q_gap_bases", "int"), ("t_gap_count", "int"), ("t_gap_bases", "int"),
    ("strand", "string"), ("q_name", "string"), ("q_size", "bigint"), ("q_start", "bigint"), ("q_end", "bigint"),
    ("t_name", "string"), ("t_size", "bigint"), ("t_start", "bigint"), ("t_end", "bigint"), ("block_count", "int"),
    ("block_sizes", "array<int>"), ("q_starts", "array<int>"), ("t_starts", "array<int>"),
]


class IrregularBlock(ValueError):
    """The bulk parser met a block that holds at least one record it can't read."""


def _all(mask: pa.Array) -> bool:
    return bool(pc.all(mask, min_count=0).as_py())


def parse_block(block: pa.Array) -> pa.ListArray:
    """The 21 fields of every record of a regular block; raises IrregularBlock when any record is not plain and valid."""
    if bool(pc.any(pc.match_substring(block, '"')).as_py()):
        raise IrregularBlock("quote")
    fields = pc.split_pattern(block, "\t")
    if not _all(pc.equal(pc.list_value_length(fields), N_FIELDS)):
        raise IrregularBlock("columns")
    pick = lambda k: pc.utf8_trim(pc.list_element(fields, k), characters=" ")
    name = pick(Q_NAME)
    if not _all(pc.match_substring_regex(name, "^[!-~]+$")) or bool(
        pc.any(pc.is_in(pc.utf8_lower(name), value_set=pa.array(NULL_WORDS))).as_py()
    ):
        raise IrregularBlock("q_name")
    numbers = [pick(k) for k in (Q_SIZE, Q_START, Q_END)]
    if not all(_all(pc.match_substring_regex(x, f"^[0-9]{{1,{MAX_BULK_DIGITS}}}$")) for x in numbers):
        raise IrregularBlock("q_end")
    size, start, end = (x.cast(pa.int64()) for x in numbers)
    if not _all(pc.and_(pc.less(start, end), pc.less_equal(end, size))):
        raise IrregularBlock("q_end")
    return fields


def split_quoted(line: str) -> list[str] | None:
    """The unquoted fields of a line under the strict quoting rule; None when the quoting is broken."""
    fields, at, end = [], 0, len(line)
    while True:
        if line.startswith('"', at):
            close = at + 1
            while True:
                close = line.find('"', close)
                if close < 0:
                    return None
                if line.startswith('"', close + 1):
                    close += 2
                    continue
                break
            fields.append(line[at + 1 : close].replace('""', '"'))
            at = close + 1
            if at < end and line[at] != "\t":
                return None
        else:
            close = line.find("\t", at)
            close = end if close < 0 else close
            field = line[at:close]
            if '"' in field:
                return None
            fields.append(field)
            at = close
        if at >= end:
            return fields
        at += 1


def _magnitude(digits: str) -> tuple[int, str]:
    """Orders numbers written in digits, of any length."""
    plain = digits.lstrip("0")
    return len(plain), plain


def diagnose(line: str) -> tuple[list[str] | None, str | None]:
    """(fields, None) of a sound record, else (None, the first reason that applies)."""
    fields = split_quoted(line)
    if fields is None:
        return None, "quoting"
    if len(fields) != N_FIELDS:
        return None, "columns"
    name = fields[Q_NAME].strip(" ")
    if not name or any(not "!" <= c <= "~" for c in name) or name.lower() in NULL_WORDS:
        return None, "q_name"
    numbers = [fields[k].strip(" ") for k in (Q_SIZE, Q_START, Q_END)]
    if not all(x and x.isascii() and x.isdigit() for x in numbers):
        return None, "q_end"
    size, start, end = (_magnitude(x) for x in numbers)
    return (fields, None) if start < end <= size else (None, "q_end")


def _bisect(block: pa.Array, low: int, high: int, leaf: int, out: list) -> None:
    """Append (low, high, fields) of regular stretches and (low, high, None) of stretches to diagnose."""
    if high <= low:
        return
    try:
        out.append((low, high, parse_block(block.slice(low, high - low))))
    except IrregularBlock:
        if high - low <= leaf:
            out.append((low, high, None))
        else:
            middle = (low + high) // 2
            _bisect(block, low, middle, leaf, out)
            _bisect(block, middle, high, leaf, out)


def _parser(block_rows: int, leaf: int, keep: str):
    schema = pa.schema([("line_id", pa.int64()), ("reason", pa.string()), ("fields", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = batch.column(0), batch.column(1)
            for first in range(0, len(lines), block_rows):
                block, block_ids = lines.slice(first, block_rows), ids.slice(first, block_rows)
                parts: list = []
                _bisect(block, 0, len(block), leaf, parts)
                kept_ids, reasons, kept_fields = [], [], []
                for low, high, fields in parts:
                    if fields is not None:
                        if keep != "rejects":
                            yield pa.RecordBatch.from_arrays(
                                [block_ids.slice(low, high - low), pa.nulls(high - low, pa.string()), fields.cast(schema.field("fields").type)],
                                schema=schema,
                            )
                        continue
                    for line_id, line in zip(block_ids.slice(low, high - low).to_pylist(), block.slice(low, high - low).to_pylist()):
                        found, reason = diagnose(line)
                        if keep == "rejects" and reason is None:
                            continue
                        kept_ids.append(line_id)
                        reasons.append(reason)
                        kept_fields.append(found)
                if kept_ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kept_ids, pa.int64()), pa.array(reasons, pa.string()), pa.array(kept_fields, schema.field("fields").type)],
                        schema=schema,
                    )

    return run


def data_lines(lines: DataFrame) -> DataFrame:
    """line_id and text of the lines that should be hits.

    Left out: null lines, lines 1-5 of a file (the preamble), blank lines and those starting with '#'. One carriage
    return at the end doesn't count. A null line_no is taken as no preamble. Repeated lines stay, each under its id.
    """
    text = F.regexp_replace(F.col("raw_line"), r"\r\z", "")
    return (
        lines.where(F.col("raw_line").isNotNull() & (F.coalesce(F.col("line_no"), F.lit(PREAMBLE_LINES + 1)) > PREAMBLE_LINES))
        .select(F.col("line_id").cast("bigint").alias("line_id"), text.alias("text"))
        .where((F.trim("text") != "") & ~F.startswith("text", F.lit("#")))
    )


def parse_lines(lines: DataFrame, block_rows: int = 1024, leaf: int = 4, keep: str = "all") -> DataFrame:
    """line_id, reason (null when sound), fields (the 21 unquoted fields, null when not sound) of every data line.

    keep="rejects" gives the failing lines only. Extra columns of `lines` are ignored. An empty table gives no rows;
    very long lines are handled like others (a field has no length limit).
    """
    return data_lines(lines).mapInArrow(
        _parser(block_rows, leaf, keep), T.StructType.fromDDL("line_id bigint, reason string, fields array<string>")
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of every data line that can't be read as a hit."""
    return parse_lines(lines, keep="rejects").where("reason is not null").select("line_id", "reason")


def _typed(field: Column, kind: str) -> Column:
    if kind == "string":
        return F.trim(field)
    if kind == "array<int>":
        parts = F.filter(F.split(field, ","), lambda x: F.trim(x) != "")
        return F.transform(parts, lambda x: F.trim(x).try_cast("int"))
    return F.trim(field).try_cast(kind)


def sound_hits(lines: DataFrame) -> DataFrame:
    """line_id, the 21 typed columns and too_large of every sound line; an unchecked field that isn't of its type becomes null.

    too_large names the checked numbers that a bigint can't hold, which are null in their columns; it is empty otherwise.
    """
    parsed = parse_lines(lines).where("reason is null")
    typed = parsed.select(
        "line_id", *(_typed(F.element_at("fields", k + 1), kind).alias(name) for k, (name, kind) in enumerate(HIT_COLUMNS))
    )
    return typed.withColumn("too_large", F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("q_size", "q_start", "q_end")))))
