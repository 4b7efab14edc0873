"""Derived views that several queries start from, in Spark and, as CTEs, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.functions.text import clean_id, normalise_label
from phylospan.operators import reference
from phylospan.session import table

GROUP = ["run_id", "chunk_idx", "q_name"]


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable hits: a query id, a non-empty query interval, labels trimmed with words for missing as unclassified."""
    return table(spark, sf_dir, "first_div_output").select(
        "hit_id", "run_id", "chunk_idx", clean_id(F.col("q_name")).alias("q_name"), "q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end", "n_match",
        normalise_label(F.col("q_species")).alias("q_species"), normalise_label(F.col("t_species")).alias("t_species"),
        F.col("divergence_time").alias("divergence"), (F.col("ani_lt_95") == "True").alias("ani_lt_95"),
    ).where("q_name is not null and q_start < q_end")


def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the index's leaves: root, genera, leaves; (name, parent, dist_root, order)."""
    genus = F.regexp_extract("leaf_name", r"^'([^_']+)", 1)
    leaves = table(spark, sf_dir, "ref_index").where("leaf_name <> 'NA'").select("leaf_name", F.concat(F.lit("'"), genus, F.lit("'")).alias("genus")).distinct()
    genera = leaves.select(F.col("genus").alias("name")).distinct()
    nodes = (
        leaves.where("leaf_name <> genus").select(F.col("leaf_name").alias("name"), F.col("genus").alias("parent"), (F.length("leaf_name") * 7.0 + 1000).alias("dist_root"))
        .unionByName(genera.select("name", F.lit("root").alias("parent"), (F.length("name") * 10.0 + 100).alias("dist_root")))
        .unionByName(spark.range(1).select(F.lit("root").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("dist_root")))
    )
    return nodes.withColumn("order", F.col("name"))


def close_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_name, t_name) of queries and references that some long hit shows to be nearly the same."""
    return hits(spark, sf_dir).where("n_match * 1000 >= (q_end - q_start) * 995 and q_end - q_start >= 400").select("q_name", "t_name").distinct()


def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id1, id2, ani): the two references of every overlap row, with the lower of their identities."""
    ids, identity = F.split("t_name", ","), F.split("pct_identity", ",")
    value = F.least(identity.getItem(0).try_cast("double"), identity.getItem(1).try_cast("double"))
    return table(spark, sf_dir, "overlap_div").where("t_name like '%,%'").select(ids.getItem(0).alias("id1"), ids.getItem(1).alias("id2"), value.alias("ani"))


def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.closest_pairs(reference_edges(spark, sf_dir))


CLEAN = "nullif(trim(replace(replace({0}, '''', ''), '\"', '')), '')"
_LABEL = "CASE WHEN {0} IS NULL OR trim({0}) = '' OR lower(trim({0})) IN ('none', 'null', 'na', 'n/a', 'empty', 'unknown') THEN 'unclassified' ELSE trim({0}) END"

HITS_SQL = f"""
hits AS (
  SELECT hit_id, run_id, chunk_idx, {CLEAN.format('q_name')} AS q_name, q_size, q_start, q_end, t_name, t_size, t_start, t_end, n_match,
    {_LABEL.format('q_species')} AS q_species, {_LABEL.format('t_species')} AS t_species,
    divergence_time AS divergence, ani_lt_95 = 'True' AS ani_lt_95
  FROM first_div_output WHERE {CLEAN.format('q_name')} IS NOT NULL AND q_start < q_end)"""

NODES_SQL = """
leaves AS (SELECT DISTINCT leaf_name, '''' || regexp_extract(leaf_name, '^''([^_'']+)', 1) || '''' AS genus FROM ref_index WHERE leaf_name <> 'NA'),
nodes_ AS (
  SELECT leaf_name AS name, genus AS parent, length(leaf_name) * 7.0::double + 1000 AS dist_root FROM leaves WHERE leaf_name <> genus
  UNION ALL SELECT DISTINCT genus, 'root', length(genus) * 10.0::double + 100 FROM leaves
  UNION ALL SELECT 'root', NULL, 0.0::double),
nodes AS (SELECT *, row_number() OVER (ORDER BY name) AS ord FROM nodes_)"""

# A leaf's lowest common ancestor with another is itself, its genus or the root: three levels.
DIVERGENCE_SQL = """
CASE WHEN a.name IS NULL OR b.name IS NULL THEN NULL
  WHEN a.name = b.name THEN 0.0
  WHEN a.parent = b.parent AND a.parent <> 'root' THEN (a.dist_root + b.dist_root - 2 * g.dist_root) / 2
  WHEN a.parent = b.name OR b.parent = a.name THEN abs(a.dist_root - b.dist_root) / 2
  ELSE (a.dist_root + b.dist_root) / 2 END"""

CLOSE_REFS_SQL = "close_refs AS (SELECT DISTINCT q_name, t_name FROM hits WHERE n_match * 1000 >= (q_end - q_start) * 995 AND q_end - q_start >= 400)"

CLOSE_PAIRS_SQL = """
edges AS (
  SELECT split_part(t_name, ',', 1) AS id1, split_part(t_name, ',', 2) AS id2,
    least(try_cast(split_part(pct_identity, ',', 1) AS double), try_cast(split_part(pct_identity, ',', 2) AS double)) AS ani
  FROM overlap_div WHERE t_name LIKE '%,%'),
close_pairs AS (
  SELECT least(id1, id2) AS id_lo, greatest(id1, id2) AS id_hi, max(ani) AS ani FROM edges WHERE ani >= 95 AND id1 <> id2 GROUP BY 1, 2)"""
