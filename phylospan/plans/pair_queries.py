"""Queries of island merging, pairing and regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.functions.text import clean_id
from phylospan.operators import chunks, islands, lineage, pairing, regions
from phylospan.plans import pipeline
from phylospan.plans import views as v
from phylospan.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]

TIE = ["emit_key", "t_name", "t_start", "t_end", "t_size", "q_size", "q_species", "t_species", "divergence"]
CARE = ["q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end", "q_species", "t_species", "divergence"]


def _islands(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    return islands.merge_islands(v.hits(spark, sf_dir), v.GROUP, CARE, strict)


def q11_island_merge_same_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir, strict=False).select(*v.GROUP, "q_start", "q_end", "t_name", "t_species")


def q12_leading_unclassified_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir, strict=True).select(*v.GROUP, "emit_key", "q_start", "q_end", "t_name", "t_species")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands with their place in the group. A stage: later steps read it several times, so it is written once."""
    return materialise(_number(spark, sf_dir))


def _number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.number_hits(_islands(spark, sf_dir, strict=True), v.GROUP, TIE)


def q14_pruned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.candidate_pairs(_numbered(spark, sf_dir), v.GROUP).drop("stretch")


def _reference(spark: SparkSession, sf_dir: str) -> pipeline.Reference:
    return pipeline.Reference(table(spark, sf_dir, "ref_index"), v.lineage_nodes(spark, sf_dir), v.close_pairs(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str, numbered: DataFrame) -> DataFrame:
    ref = _reference(spark, sf_dir)
    return pipeline.judge_candidates(numbered, ref, lineage.ancestor_paths(ref.nodes, max_depth=4), v.GROUP)


def q15_pair_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, _numbered(spark, sf_dir)).select(*v.GROUP, "i", "j", "divergence", "ref_ani_lt_95", "accepted")


def _matches(spark: SparkSession, sf_dir: str, numbered: DataFrame) -> DataFrame:
    judged = materialise(_judged(spark, sf_dir, numbered).where("accepted").select(*v.GROUP, "stretch", "i", "j", "overlap", "divergence", "ref_ani_lt_95"))
    matched = pairing.greedy_match(judged, v.GROUP)
    return matched.join(judged.select(*v.GROUP, "i", "j", F.col("divergence").alias("ref_divergence"), "ref_ani_lt_95"), [*v.GROUP, "i", "j"])


def q16_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, _numbered(spark, sf_dir)).select(*v.GROUP, "i", "j", "overlap")


def q13_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matched pairs as rows with left,right columns."""
    numbered = _numbered(spark, sf_dir)
    out = pairing.overlap_pairs(numbered, _matches(spark, sf_dir, numbered), v.GROUP)
    return out.select(*v.GROUP, "q_start", "q_end", "q_species", "t_name", "t_species", "t_start", "ref_divergence")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overlap_div over all chunks of a query: clean ids, restored coordinates, the run's settings (null ones as 150 and 0)."""
    runs = table(spark, sf_dir, "run_log").select("run_id", "chunk_bp", F.coalesce("size_filter", F.lit(150)).alias("least"), F.coalesce("cluster_size", F.lit(0)).alias("gap"))
    rows = table(spark, sf_dir, "overlap_div").withColumn("q_name", clean_id(F.col("q_name"))).where("q_name is not null and q_start >= 0 and q_start < q_end")
    return chunks.restore_offsets(rows.join(runs, "run_id"), "chunk_bp").drop("chunk_bp").where("q_start is not null")


KEYS, ORDER = ["run_id", "q_name"], ["q_start", "q_end", "pair_id"]


def q17_region_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_bounds(regions.compress(overlaps(spark, sf_dir), KEYS), KEYS).drop("region")


def q18_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.size_filter(q17_region_compress(spark, sf_dir), 150)


def q19_gap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = regions.cluster_gap(q17_region_compress(spark, sf_dir), KEYS, 50)
    return clustered.groupBy(*KEYS, F.col("cluster_start").alias("region_start"), F.col("cluster_end").alias("region_end")).agg(F.sum("n_rows").alias("n_rows"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.process(overlaps(spark, sf_dir), KEYS, "least", "gap")


def q20_region_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).groupBy(*KEYS, "region_start", "region_end").agg(F.count(F.lit(1)).alias("n_rows"))


def q21_region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.summarise(_members(spark, sf_dir), table(spark, sf_dir, "ref_index"), KEYS, ORDER).drop("region")


def q22_region_members_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.joined_members(_members(spark, sf_dir), KEYS, ORDER, ["t_name", "pct_identity", "t_species", "divergence_time", "ref_ani_lt_95"])


def q43_pipeline_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered hits to region summaries: islands, matching, offsets, regions of more than one lineage."""
    ref = _reference(spark, sf_dir)
    settings = table(spark, sf_dir, "run_log").select("run_id", "chunk_bp", F.coalesce("size_filter", F.lit(150)).alias("least"), F.coalesce("cluster_size", F.lit(0)).alias("gap"))
    hits = v.hits(spark, sf_dir).drop("ani_lt_95")
    out = pipeline.regions_of_hits(hits, settings, ref, lineage.ancestor_paths(ref.nodes, max_depth=4), lambda name, build: materialise(build()))
    return out["summary"].drop("region", "mean_divergence")


_G = ", ".join(v.GROUP)
_CARE = ", ".join(CARE)
_ORDER = "q_start, q_end, t_name, q_size, t_size, t_start, t_end, q_species, t_species, divergence NULLS FIRST"

_ISLANDS = f"""
care AS (SELECT DISTINCT {_G}, {_CARE} FROM hits),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY {_G}) AS size, t_species = 'unclassified' AS blank FROM care),
rows_ AS (SELECT *, sum((NOT blank)::int) OVER (PARTITION BY {_G} ORDER BY rn) AS n_classified, max((NOT blank)::int) OVER (PARTITION BY {_G}) AS any_classified FROM numbered WHERE size > 1),
lagged AS (SELECT *, lag(t_species) OVER (PARTITION BY {_G} ORDER BY rn) AS before_ FROM rows_ WHERE NOT blank),
runs_ AS (SELECT *, sum(CASE WHEN before_ = t_species THEN 0 ELSE 1 END) OVER (PARTITION BY {_G} ORDER BY rn) AS run FROM lagged),
reached AS (SELECT *, max(q_end) OVER (PARTITION BY {_G}, run ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs_),
parted AS (SELECT *, sum(CASE WHEN reach > q_start THEN 0 ELSE 1 END) OVER (PARTITION BY {_G} ORDER BY rn) AS island FROM reached),
heads AS (SELECT {_G}, island, min(rn) AS rn, max(q_end) AS island_end FROM parted GROUP BY {_G}, island),
merged AS (SELECT h.*, coalesce(lead(h.rn) OVER (PARTITION BY {', '.join('h.' + c for c in v.GROUP)} ORDER BY island), 1099511627776) AS emit_key FROM heads h),
plain AS (
  SELECT {', '.join('p.' + c for c in v.GROUP)}, {', '.join('m.island_end AS q_end' if c == 'q_end' else 'p.' + c for c in CARE)}, m.emit_key
  FROM merged m JOIN parted p ON p.run_id = m.run_id AND p.chunk_idx = m.chunk_idx AND p.q_name = m.q_name AND p.rn = m.rn
  UNION ALL SELECT {_G}, {_CARE}, rn FROM rows_ WHERE blank),
strict_ AS (
  SELECT * FROM plain
  UNION ALL SELECT {_G}, {_CARE}, CASE WHEN blank THEN 1099511627776 ELSE rn END FROM rows_
  WHERE (NOT blank AND n_classified = 1 AND rn > 1) OR (any_classified = 0 AND rn = size))"""

_PAIRS = f"""
n AS (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY q_start, q_end, {', '.join(TIE)} NULLS FIRST) AS i FROM strict_),
overlapping AS (
  SELECT a.run_id, a.chunk_idx, a.q_name, a.i AS i, b.i AS j, least(a.q_end, b.q_end) - greatest(a.q_start, b.q_start) AS overlap,
    a.q_end - a.q_start AS whole, a.q_end - b.q_start AS still
  FROM n a JOIN n b ON a.run_id = b.run_id AND a.chunk_idx = b.chunk_idx AND a.q_name = b.q_name AND b.i > a.i AND b.q_start < a.q_end AND a.q_start < b.q_end
  WHERE NOT (a.t_species = b.t_species AND a.t_species <> 'unclassified')),
swept AS (SELECT *, max(overlap) OVER (PARTITION BY {_G}, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM overlapping),
candidates AS (SELECT {_G}, i, j, overlap FROM swept WHERE best IS NULL OR (best < whole AND still >= best))"""

_JUDGED = f"""
sides AS (SELECT n.*, coalesce(x.seq_length, 0) AS ref_length, coalesce(x.leaf_name, 'NA') AS leaf FROM n LEFT JOIN ref_index x ON n.t_name = x.seq_id),
sided AS (
  SELECT c.*, l.t_species AS ls, r.t_species AS rs, l.leaf AS ll, r.leaf AS rl, l.ref_length AS la, r.ref_length AS ra, l.t_name AS lt, r.t_name AS rt
  FROM candidates c
  JOIN sides l ON l.run_id = c.run_id AND l.chunk_idx = c.chunk_idx AND l.q_name = c.q_name AND l.i = c.i
  JOIN sides r ON r.run_id = c.run_id AND r.chunk_idx = c.chunk_idx AND r.q_name = c.q_name AND r.i = c.j),
measured AS (
  SELECT s.*, {v.DIVERGENCE_SQL} AS d, p.ani IS NOT NULL AS in_close FROM sided s
  LEFT JOIN nodes a ON a.name = ll LEFT JOIN nodes b ON b.name = rl LEFT JOIN nodes g ON g.name = a.parent
  LEFT JOIN close_pairs p ON p.id_lo = least(lt, rt) AND p.id_hi = greatest(lt, rt)),
apart_ AS (
  SELECT *, CASE WHEN la <= 500 OR ra <= 500 THEN (CASE WHEN overlap <= 0 OR least(la, ra) = 0 THEN -1.0 ELSE overlap * 100.0::double / least(la, ra) END) < 95 ELSE NOT in_close END AS apart FROM measured),
judged AS (
  SELECT *, CASE WHEN d IS NULL THEN apart END AS ref_ani_lt_95,
    NOT (ls <> 'unclassified' AND rs <> 'unclassified' AND (ll = rl OR ls = rs)) AND CASE WHEN d IS NULL THEN apart ELSE d >= 1 END AS accepted FROM apart_)"""

_MATCHED = f"""
ranked AS (SELECT {_G}, i, j, overlap, d, ref_ani_lt_95, row_number() OVER (PARTITION BY {_G} ORDER BY overlap DESC, i, j) AS k FROM judged WHERE accepted),
fold AS (
  SELECT {_G}, k, i, j, overlap, true AS free, [i, j] AS used FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.run_id, r.chunk_idx, r.q_name, r.k, r.i, r.j, r.overlap, NOT list_contains(f.used, r.i) AND NOT list_contains(f.used, r.j),
    CASE WHEN list_contains(f.used, r.i) OR list_contains(f.used, r.j) THEN f.used ELSE list_concat(f.used, [r.i, r.j]) END
  FROM fold f JOIN ranked r ON r.run_id = f.run_id AND r.chunk_idx = f.chunk_idx AND r.q_name = f.q_name AND r.k = f.k + 1),
matched AS (
  SELECT f.run_id, f.chunk_idx, f.q_name, f.i, f.j, f.overlap, r.d AS ref_divergence FROM fold f
  JOIN ranked r ON r.run_id = f.run_id AND r.chunk_idx = f.chunk_idx AND r.q_name = f.q_name AND r.k = f.k WHERE f.free),
pairs_ AS (
  SELECT m.run_id, m.chunk_idx, m.q_name, greatest(l.q_start, r.q_start) AS q_start, least(l.q_end, r.q_end) AS q_end, l.q_size, l.q_species,
    coalesce(l.t_name, 'NA') || ',' || coalesce(r.t_name, 'NA') AS t_name, l.t_species || ',' || r.t_species AS t_species,
    l.t_start || ',' || r.t_start AS t_start, l.t_end || ',' || r.t_end AS t_end, ref_divergence
  FROM matched m
  JOIN n l ON l.run_id = m.run_id AND l.chunk_idx = m.chunk_idx AND l.q_name = m.q_name AND l.i = m.i
  JOIN n r ON r.run_id = m.run_id AND r.chunk_idx = m.chunk_idx AND r.q_name = m.q_name AND r.i = m.j)"""

_CHAIN = f"WITH RECURSIVE {v.HITS_SQL}, {v.NODES_SQL}, {v.CLOSE_PAIRS_SQL}, {_ISLANDS}, {_PAIRS}, {_JUDGED}, {_MATCHED}"


def _regions_sql(source: str) -> str:
    """CTEs from `rows_r` (keys, q_start, q_end, ord, least, gap) to `members` (with region_start, region_end)."""
    key = "run_id, q_name"
    return f"""
rows_r AS ({source}),
r1 AS (SELECT *, max(q_end) OVER (PARTITION BY {key} ORDER BY q_start, q_end, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_r FROM rows_r),
r2 AS (SELECT *, sum(CASE WHEN before_r IS NULL OR q_start > before_r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY q_start, q_end, ord ROWS UNBOUNDED PRECEDING) AS region FROM r1),
bounds AS (SELECT {key}, region, min(q_start) AS region_start, max(q_end) AS region_end, count(*) AS n_rows, max(least) AS least, max(gap) AS gap FROM r2 GROUP BY {key}, region),
kept AS (SELECT *, lag(region_end) OVER (PARTITION BY {key} ORDER BY region_start) AS before_k FROM bounds WHERE region_end - region_start >= least),
clustered AS (SELECT *, sum(CASE WHEN gap > 0 AND region_start - before_k <= gap THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY region_start ROWS UNBOUNDED PRECEDING) AS cluster FROM kept),
spans AS (SELECT {key}, cluster, min(region_start) AS region_start, max(region_end) AS region_end FROM clustered GROUP BY {key}, cluster),
members AS (
  SELECT r2.* EXCLUDE (region, least, gap, before_r), s.cluster AS region, s.region_start, s.region_end
  FROM r2 JOIN clustered c ON r2.run_id = c.run_id AND r2.q_name = c.q_name AND r2.region = c.region
  JOIN spans s ON s.run_id = c.run_id AND s.q_name = c.q_name AND s.cluster = c.cluster)"""


_OVERLAPS = f"""
SELECT o.* REPLACE ({v.CLEAN.format('q_name')} AS q_name, q_start + chunk_idx * chunk_bp AS q_start, q_end + chunk_idx * chunk_bp AS q_end), pair_id AS ord,
  coalesce(size_filter, 150) AS least, coalesce(cluster_size, 0) AS gap
FROM overlap_div o JOIN run_log r ON o.run_id = r.run_id
WHERE {v.CLEAN.format('q_name')} IS NOT NULL AND o.q_start >= 0 AND o.q_start < o.q_end AND chunk_idx IS NOT NULL AND chunk_bp IS NOT NULL"""

_REGIONS = f"WITH {_regions_sql(_OVERLAPS)}"
_SPECIES = """
leaf_n AS (
  SELECT run_id, q_name, region, count(DISTINCT coalesce(leaf_name, tok)) AS n_species
  FROM (SELECT run_id, q_name, region, trim(unnest(string_split(t_name, ','))) AS tok FROM members) LEFT JOIN ref_index ON tok = seq_id GROUP BY 1, 2, 3)"""

SQL: dict[str, str] = {
    "q11_island_merge_same_species": f"WITH {v.HITS_SQL}, {_ISLANDS} SELECT {_G}, q_start, q_end, t_name, t_species FROM plain",
    "q12_leading_unclassified_dup": f"WITH {v.HITS_SQL}, {_ISLANDS} SELECT {_G}, emit_key, q_start, q_end, t_name, t_species FROM strict_",
    "q13_overlap_pairs": f"{_CHAIN} SELECT {_G}, q_start, q_end, q_species, t_name, t_species, t_start, ref_divergence FROM pairs_",
    "q14_pruned_candidates": f"WITH {v.HITS_SQL}, {_ISLANDS}, {_PAIRS} SELECT {_G}, i, j, overlap FROM candidates",
    "q15_pair_quality": f"WITH {v.HITS_SQL}, {v.NODES_SQL}, {v.CLOSE_PAIRS_SQL}, {_ISLANDS}, {_PAIRS}, {_JUDGED} SELECT {_G}, i, j, d AS divergence, ref_ani_lt_95, accepted FROM judged",
    "q16_greedy_match": f"{_CHAIN} SELECT {_G}, i, j, overlap FROM matched",
    "q17_region_compress": f"{_REGIONS} SELECT run_id, q_name, region_start, region_end, n_rows FROM bounds",
    "q18_size_filter": f"{_REGIONS} SELECT run_id, q_name, region_start, region_end, n_rows FROM bounds WHERE region_end - region_start >= 150",
    "q19_gap_cluster": f"""{_REGIONS},
k50 AS (SELECT *, lag(region_end) OVER (PARTITION BY run_id, q_name ORDER BY region_start) AS b FROM bounds),
c50 AS (SELECT *, sum(CASE WHEN region_start - b <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, q_name ORDER BY region_start ROWS UNBOUNDED PRECEDING) AS c FROM k50)
SELECT run_id, q_name, min(region_start) AS region_start, max(region_end) AS region_end, sum(n_rows)::bigint AS n_rows FROM c50 GROUP BY run_id, q_name, c""",
    "q20_region_process": f"{_REGIONS} SELECT run_id, q_name, region_start, region_end, count(*) AS n_rows FROM members GROUP BY ALL",
    "q21_region_summary": f"""{_REGIONS}, {_SPECIES},
base AS (
  SELECT run_id, q_name, region, min(region_start) AS q_start, max(region_end) AS q_end, count(*) AS n_pairs,
    first(q_size ORDER BY q_start, q_end, ord) AS q_size, first(q_species ORDER BY q_start, q_end, ord) AS q_species FROM members GROUP BY 1, 2, 3),
tokens AS (SELECT run_id, q_name, region, try_cast(trim(unnest(string_split(divergence_time, ','))) AS decimal(18,4)) AS x FROM members),
means AS (SELECT run_id, q_name, region, sum(x)::double / count(x) AS mean_divergence FROM tokens WHERE x IS NOT NULL GROUP BY 1, 2, 3)
SELECT b.run_id, b.q_name, q_start, q_end, q_size, q_species, n_pairs, n_species, mean_divergence
FROM base b JOIN leaf_n l ON b.run_id = l.run_id AND b.q_name = l.q_name AND b.region = l.region
LEFT JOIN means m ON b.run_id = m.run_id AND b.q_name = m.q_name AND b.region = m.region WHERE n_species >= 2""",
    "q22_region_members_joined": f"""{_REGIONS}
SELECT run_id, q_name, min(region_start) AS q_start, max(region_end) AS q_end,
  first(q_size ORDER BY q_start, q_end, ord) AS q_size, first(q_species ORDER BY q_start, q_end, ord) AS q_species,
  {', '.join(f"string_agg(coalesce({c}, ''), '|' ORDER BY q_start, q_end, ord) AS {c}" for c in ('t_name', 'pct_identity', 't_species', 'divergence_time', 'ref_ani_lt_95'))}
FROM members GROUP BY run_id, q_name, region""",
    "q43_pipeline_regions": f"""{_CHAIN}, {_regions_sql('''
SELECT p.run_id, p.q_name, p.q_start + p.chunk_idx * r.chunk_bp AS q_start, p.q_end + p.chunk_idx * r.chunk_bp AS q_end, p.t_name, p.q_size, p.q_species, p.t_start, p.t_end, p.t_name AS ord,
  coalesce(r.size_filter, 150) AS least, coalesce(r.cluster_size, 0) AS gap FROM pairs_ p JOIN run_log r ON p.run_id = r.run_id''')}, {_SPECIES}
SELECT m.run_id, m.q_name, min(region_start) AS q_start, max(region_end) AS q_end, count(*) AS n_pairs, max(n_species) AS n_species,
  first(m.q_size ORDER BY m.q_start, m.q_end, m.t_name, m.t_start, m.t_end) AS q_size, first(m.q_species ORDER BY m.q_start, m.q_end, m.t_name, m.t_start, m.t_end) AS q_species
FROM members m JOIN leaf_n l ON m.run_id = l.run_id AND m.q_name = l.q_name AND m.region = l.region WHERE n_species >= 2 GROUP BY m.run_id, m.q_name, m.region""",
}

QUERIES: dict[str, Query] = {name: globals()[name] for name in SQL}
