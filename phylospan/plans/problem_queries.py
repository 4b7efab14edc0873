"""Queries of problems 1, 3 and 4 with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.operators import hot_keys, malformed, periods
from phylospan.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.rejected_lines(table(spark, sf_dir, "raw_psl_lines"))


def p1_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = malformed.sound_hits(table(spark, sf_dir, "raw_psl_lines")).drop("too_large")
    lists = [name for name, kind in malformed.HIT_COLUMNS if kind.startswith("array")]
    return hits.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "?") for c in lists})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys.heavy_keys(table(spark, sf_dir, "first_div_output"))


def p3_key_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys.hit_summary(table(spark, sf_dir, "first_div_output"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.query_periods(table(spark, sf_dir, "overlap_div"), table(spark, sf_dir, "run_log"))


_P1_FIELDS = r"""
data AS (
  SELECT line_id, s FROM (
    SELECT line_id, regexp_replace(raw_line, '\r\z', '') AS s FROM raw_psl_lines
    WHERE raw_line IS NOT NULL AND coalesce(line_no, 6) > 5)
  WHERE trim(s) <> '' AND NOT starts_with(s, '#')),
quoted AS (
  SELECT line_id, s, regexp_full_match(s, '("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*') AS ok FROM data),
parts AS (
  SELECT line_id, ok, CASE WHEN ok THEN regexp_extract_all(chr(9) || s, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) END AS f FROM quoted),
fields AS (
  SELECT line_id, ok, [CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END FOR x IN f] AS f
  FROM parts),
judged AS (
  SELECT line_id, f, CASE
    WHEN NOT ok THEN 'quoting'
    WHEN len(f) <> 21 THEN 'columns'
    WHEN NOT regexp_full_match(trim(f[10]), '[!-~]+')
      OR lower(trim(f[10])) IN ('none', 'null', 'na', 'n/a', 'empty', 'unknown') THEN 'q_name'
    WHEN NOT (regexp_full_match(trim(f[11]), '[0-9]+') AND regexp_full_match(trim(f[12]), '[0-9]+') AND regexp_full_match(trim(f[13]), '[0-9]+')) THEN 'q_end'
    WHEN NOT (try_cast(trim(f[12]) AS hugeint) < try_cast(trim(f[13]) AS hugeint) AND try_cast(trim(f[13]) AS hugeint) <= try_cast(trim(f[11]) AS hugeint)) THEN 'q_end'
  END AS reason FROM fields)
"""


def _typed_sql() -> str:
    out = []
    for k, (name, kind) in enumerate(malformed.HIT_COLUMNS, start=1):
        field = f"trim(f[{k}])"
        if kind == "string":
            out.append(f"{field} AS {name}")
        elif kind.startswith("array"):
            number = "CASE WHEN regexp_full_match(trim(x), '[+-]?[0-9]+') THEN try_cast(trim(x) AS integer) END"
            out.append(f"array_to_string([coalesce(({number})::varchar, '?') FOR x IN string_split(f[{k}], ',') IF trim(x) <> ''], ',') AS {name}")
        else:
            out.append(f"CASE WHEN regexp_full_match({field}, '[+-]?[0-9]+') THEN try_cast({field} AS {kind}) END AS {name}")
    return ",\n  ".join(out)


_CLEAN = "nullif(trim(replace(replace({0}, '''', ''), '\"', '')), '')"

SQL: dict[str, str] = {
    "p1_found": f"WITH {_P1_FIELDS} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_hits": f"WITH {_P1_FIELDS} SELECT line_id, {_typed_sql()} FROM judged WHERE reason IS NULL",
    "p3_found": f"""
SELECT q_name FROM (SELECT {_CLEAN.format('q_name')} AS q_name FROM first_div_output)
WHERE q_name IS NOT NULL GROUP BY q_name
HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM first_div_output)""",
    "p3_key_summary": f"""
SELECT q_name, count(*) AS n_hits, count(DISTINCT t_name) AS n_references, sum(n_match)::bigint AS n_match,
  min(q_start) AS min_start, max(q_end) AS max_end,
  sum(pct_identity::decimal(12,5))::double / nullif(count(pct_identity), 0) AS mean_identity
FROM (SELECT * REPLACE ({_CLEAN.format('q_name')} AS q_name) FROM first_div_output)
WHERE q_name IS NOT NULL GROUP BY q_name""",
    "p4_found": f"""
WITH iv AS (
  SELECT o.run_id, {_CLEAN.format('q_name')} AS q_name, q_start + chunk_idx * chunk_bp AS s, q_end + chunk_idx * chunk_bp AS e
  FROM overlap_div o JOIN run_log r ON o.run_id = r.run_id
  WHERE q_start >= 0 AND q_start < q_end),
ok AS (SELECT * FROM iv WHERE q_name IS NOT NULL AND s IS NOT NULL),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY run_id, q_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY run_id, q_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM reach),
periods AS (SELECT run_id, q_name, k, min(s) AS s, max(e) AS e FROM numbered GROUP BY run_id, q_name, k),
gaps AS (SELECT run_id, q_name, e AS s, lead(s) OVER (PARTITION BY run_id, q_name ORDER BY s) AS e FROM periods)
SELECT run_id, q_name, 'period' AS kind, s AS seg_start, e AS seg_end FROM periods
UNION ALL SELECT run_id, q_name, 'gap', s, e FROM gaps WHERE e IS NOT NULL""",
}

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_hits": p1_hits,
    "p3_found": p3_found,
    "p3_key_summary": p3_key_summary,
    "p4_found": p4_found,
}
