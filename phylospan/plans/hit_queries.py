"""Queries of the hit filter, the lineage and the reference index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.functions import intervals as iv
from phylospan.operators import divergence, lineage, reference
from phylospan.plans import views as v
from phylospan.session import table

Query = Callable[[SparkSession, str], DataFrame]


def q01_hit_scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = F.col("q_end") - F.col("q_start")
    return v.hits(spark, sf_dir).select(
        "hit_id", "q_name", "t_name", aligned.alias("aligned"), F.floor(F.col("n_match").cast("bigint") * 1_000_000 / aligned).alias("identity_ppm")
    )


def q02_identity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "run_log").select("run_id", "min_identity")
    hits = v.hits(spark, sf_dir).join(runs, "run_id")
    return hits.where(iv.identity_at_least(F.col("n_match").cast("bigint"), F.col("q_start"), F.col("q_end"), F.col("min_identity"))).select("hit_id", "run_id", "min_identity")


def q03_species_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reference.with_reference(v.hits(spark, sf_dir).select("hit_id", "t_name"), table(spark, sf_dir, "ref_index"))
    return found.select("hit_id", "ref_species", "ref_length", "ref_leaf")


def q04_lca_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "ref_index").select("seq_id", "leaf_name")
    pairs = v.reference_edges(spark, sf_dir).select("id1", "id2").distinct()
    pairs = pairs.join(index.select(F.col("seq_id").alias("id1"), F.col("leaf_name").alias("leaf1")), "id1").join(
        index.select(F.col("seq_id").alias("id2"), F.col("leaf_name").alias("leaf2")), "id2"
    )
    paths = lineage.ancestor_paths(v.lineage_nodes(spark, sf_dir), max_depth=4)
    return lineage.pair_divergence(pairs, paths, "leaf1", "leaf2").select("id1", "id2", "divergence", "divergence_reason")


def q05_name_resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = v.hits(spark, sf_dir)
    names = hits.select(F.explode(F.array("q_species", "t_species")).alias("species"))
    return lineage.resolve_names(names, v.lineage_nodes(spark, sf_dir))


def _with_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hits with the reference's columns and the query's leaf."""
    hits = reference.with_reference(v.hits(spark, sf_dir).drop("divergence", "ani_lt_95"), table(spark, sf_dir, "ref_index"))
    leaves = lineage.resolve_names(hits.select("q_species"), v.lineage_nodes(spark, sf_dir), "q_species")
    return hits.join(leaves.select(F.col("species").alias("q_species"), F.col("leaf_name").alias("q_leaf")), "q_species")


def q06_divergence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = lineage.ancestor_paths(v.lineage_nodes(spark, sf_dir), max_depth=4)
    hits = divergence.with_divergence(_with_leaves(spark, sf_dir), paths)
    return hits.where("divergence is null or divergence >= 1").select("hit_id", "divergence", "divergence_reason")


def q07_query_ani_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = v.hits(spark, sf_dir).select("hit_id", "q_name", "t_name")
    flagged = reference.in_pairs(hits, v.close_refs(spark, sf_dir), {"q_name": "q_name", "t_name": "t_name"}, "is_close")
    return flagged.where("not is_close").select("hit_id", "q_name", "t_name")


def q08_crude_ani(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = reference.with_reference(v.hits(spark, sf_dir).select("hit_id", "t_name", "q_size", "n_match"), table(spark, sf_dir, "ref_index"))
    return hits.select("hit_id", iv.crude_identity(F.col("q_size"), F.col("ref_length"), F.col("n_match")).alias("crude_identity"))


def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole hit filter with each run's least identity."""
    hits = v.hits(spark, sf_dir).drop("divergence", "ani_lt_95").join(table(spark, sf_dir, "run_log").select("run_id", "min_identity"), "run_id")
    nodes = v.lineage_nodes(spark, sf_dir)
    leaves = lineage.resolve_names(hits.select("q_species"), nodes, "q_species")
    return divergence.filter_hits(hits, table(spark, sf_dir, "ref_index"), leaves, lineage.ancestor_paths(nodes, max_depth=4), v.close_refs(spark, sf_dir), "min_identity")


def q09_first_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_divergence(spark, sf_dir).select("hit_id", "divergence", "divergence_reason", "ani_lt_95", "ref_species")


def q10_symmetric_pair_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.close_pairs(spark, sf_dir)


def q40_reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built anew: lengths of the index's sequences, species as the hits name them, last hit winning."""
    lengths = table(spark, sf_dir, "ref_index").select("seq_id", "seq_length")
    named = table(spark, sf_dir, "first_div_output").where("t_name is not null and t_species is not null")
    species = named.groupBy(F.col("t_name").alias("seq_id")).agg(F.max_by("t_species", "hit_id").alias("species"))
    return reference.build_index(lengths, species, v.lineage_nodes(spark, sf_dir))


def q41_missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference.missing_references(v.hits(spark, sf_dir), table(spark, sf_dir, "ref_index"))


def q42_pair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.reference_edges(spark, sf_dir).select("id1", "id2").distinct()
    return reference.lookup_pair(rows, v.close_pairs(spark, sf_dir), "id1", "id2")


_CASCADE = """
names AS (SELECT DISTINCT s AS species, regexp_split_to_array(trim(s), '\\s+') AS w FROM (SELECT q_species AS s FROM hits UNION SELECT t_species FROM hits)),
firsts AS (SELECT regexp_extract(name, '^''([^_'']+)', 1) AS prefix, min_by(name, ord) AS name FROM nodes GROUP BY 1),
resolved AS (
  SELECT species, CASE WHEN lower(trim(species)) IN ('unclassified', 'none', 'null', 'na', 'n/a', 'empty', 'unknown') THEN 'NA' ELSE coalesce(
    (SELECT name FROM nodes WHERE name = '''' || array_to_string(w, '_') || ''''),
    (SELECT name FROM nodes WHERE len(w) >= 3 AND name = '''' || w[1] || '_' || w[2] || ''''),
    (SELECT name FROM nodes WHERE len(w) >= 2 AND name = '''' || w[1] || ''''),
    (SELECT name FROM firsts WHERE len(w) >= 2 AND prefix = w[1] AND prefix <> ''), 'NA') END AS leaf_name
  FROM names)"""

_FILTERED = f"""
base AS (
  SELECT h.*, r.min_identity, coalesce(i.species, 'unclassified') AS ref_species, coalesce(i.seq_length, 0) AS ref_length, coalesce(i.leaf_name, 'NA') AS ref_leaf, n.leaf_name AS q_leaf
  FROM hits h LEFT JOIN run_log r ON h.run_id = r.run_id LEFT JOIN ref_index i ON h.t_name = i.seq_id JOIN resolved n ON h.q_species = n.species),
judged AS (
  SELECT x.*, q_leaf IN ('unclassified', 'NA') OR ref_species IN ('unclassified', 'NA') AS blank, {v.DIVERGENCE_SQL} AS d
  FROM base x LEFT JOIN nodes a ON a.name = x.q_leaf LEFT JOIN nodes b ON b.name = x.ref_leaf LEFT JOIN nodes g ON g.name = a.parent),
known AS (
  SELECT *, CASE WHEN NOT blank THEN d END AS div_, CASE WHEN blank THEN 'unk:unclassified_species' WHEN d IS NULL THEN 'unk:unable_to_find_ref_species_in_tree' END AS reason FROM judged)"""

_WITH = f"WITH {v.HITS_SQL}"
_CRUDE = "CASE WHEN least(q_size, ref_length) = 0 THEN -1.0 ELSE n_match * 100.0::double / least(q_size, ref_length) END"

SQL: dict[str, str] = {
    "q01_hit_scan_project": f"{_WITH} SELECT hit_id, q_name, t_name, q_end - q_start AS aligned, (n_match::bigint * 1000000) // (q_end - q_start) AS identity_ppm FROM hits",
    "q02_identity_filter": f"{_WITH} SELECT hit_id, h.run_id, min_identity FROM hits h JOIN run_log r ON h.run_id = r.run_id WHERE n_match::bigint * 100 >= min_identity * (q_end - q_start)",
    "q03_species_lookup": f"""{_WITH} SELECT hit_id, coalesce(species, 'unclassified') AS ref_species, coalesce(seq_length, 0) AS ref_length, coalesce(leaf_name, 'NA') AS ref_leaf
FROM hits LEFT JOIN ref_index ON t_name = seq_id""",
    "q04_lca_divergence": f"""WITH {v.NODES_SQL}, {v.CLOSE_PAIRS_SQL}, p AS (
  SELECT DISTINCT id1, id2, i1.leaf_name AS leaf1, i2.leaf_name AS leaf2 FROM edges JOIN ref_index i1 ON id1 = i1.seq_id JOIN ref_index i2 ON id2 = i2.seq_id)
SELECT id1, id2, d AS divergence, CASE WHEN d IS NULL THEN 'unk:unable_to_find_ref_species_in_tree' END AS divergence_reason FROM (
  SELECT p.*, {v.DIVERGENCE_SQL} AS d FROM p LEFT JOIN nodes a ON a.name = leaf1 LEFT JOIN nodes b ON b.name = leaf2 LEFT JOIN nodes g ON g.name = a.parent)""",
    "q05_name_resolution_cascade": f"{_WITH}, {v.NODES_SQL}, {_CASCADE} SELECT species, leaf_name FROM resolved",
    "q06_divergence_filter": f"""{_WITH}, {v.NODES_SQL}, {_CASCADE}, {_FILTERED}
SELECT hit_id, div_ AS divergence, reason AS divergence_reason FROM known WHERE div_ IS NULL OR div_ >= 1""",
    "q07_query_ani_antijoin": f"""{_WITH}, {v.CLOSE_REFS_SQL}
SELECT hit_id, q_name, t_name FROM hits h WHERE NOT EXISTS (SELECT 1 FROM close_refs c WHERE c.q_name = h.q_name AND c.t_name = h.t_name)""",
    "q08_crude_ani": f"""{_WITH} SELECT hit_id, {_CRUDE} AS crude_identity
FROM (SELECT h.*, coalesce(seq_length, 0) AS ref_length FROM hits h LEFT JOIN ref_index ON t_name = seq_id)""",
    "q09_first_div": f"""{_WITH}, {v.NODES_SQL}, {v.CLOSE_REFS_SQL}, {_CASCADE}, {_FILTERED},
final AS (
  SELECT k.*, EXISTS (SELECT 1 FROM close_refs c WHERE c.q_name = k.q_name AND c.t_name = k.t_name) AS is_close, {_CRUDE} AS crude
  FROM known k WHERE round_even(n_match * 100.0::double / (q_end - q_start)::double, 5) >= min_identity)
SELECT hit_id, div_ AS divergence, reason AS divergence_reason, CASE WHEN div_ IS NULL THEN true END AS ani_lt_95, ref_species FROM final
WHERE div_ >= 1 OR (div_ IS NULL AND CASE WHEN q_size < 500 OR ref_length < 500 THEN crude >= 0 AND crude < 95 ELSE NOT is_close END)""",
    "q10_symmetric_pair_max": f"WITH {v.CLOSE_PAIRS_SQL} SELECT id_lo, id_hi, ani FROM close_pairs",
    "q40_reference_index": f"""{_WITH}, {v.NODES_SQL},
last AS (SELECT t_name AS seq_id, max_by(t_species, hit_id) AS s FROM first_div_output WHERE t_name IS NOT NULL AND t_species IS NOT NULL GROUP BY 1),
labelled AS (SELECT r.seq_id, r.seq_length, {v._LABEL.format('s')} AS species FROM ref_index r LEFT JOIN last l ON r.seq_id = l.seq_id),
{_CASCADE.replace('SELECT q_species AS s FROM hits UNION SELECT t_species FROM hits', 'SELECT species AS s FROM labelled')}
SELECT seq_id, l.species, seq_length, leaf_name FROM labelled l JOIN resolved n ON l.species = n.species""",
    "q41_missing_references": f"{_WITH} SELECT t_name, count(*) AS n_hits FROM hits WHERE t_name IS NOT NULL AND t_name NOT IN (SELECT seq_id FROM ref_index) GROUP BY 1",
    "q42_pair_lookup": f"""WITH {v.CLOSE_PAIRS_SQL} SELECT DISTINCT e.id1, e.id2, c.ani FROM edges e
LEFT JOIN close_pairs c ON c.id_lo = least(e.id1, e.id2) AND c.id_hi = greatest(e.id1, e.id2)""",
}

QUERIES: dict[str, Query] = {name: globals()[name] for name in SQL}
