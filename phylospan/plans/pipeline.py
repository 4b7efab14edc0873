"""The three entries: a query run over hit tables, the build of a reference database, and the re-filtering of pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.functions.text import clean_id
from phylospan.operators import chunks, divergence, islands, kmers, lineage, next_fit, pairing, reference, regions
from phylospan.plans.stages import stage
from phylospan.session import materialise

GROUP = ["run_id", "chunk_idx", "q_name"]
TIE = ["emit_key", "t_name", "t_start", "t_end", "t_size", "q_size", "q_species", "t_species", "divergence"]


CARRIED = ["q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end", "pct_identity", "q_species", "t_species", "divergence", "ani_lt_95"]


@dataclass(frozen=True)
class Reference:
    """A reference database: the index, ancestor paths and preorder of its tree, and its pairs of similar sequences."""

    index: DataFrame
    nodes: DataFrame
    close_pairs: DataFrame


def judge_candidates(numbered: DataFrame, ref: Reference, paths: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate pairs of numbered hits with divergence, ref_ani_lt_95 and accepted."""
    named = reference.with_reference(numbered, ref.index)
    wanted = {"q_start": "q_start", "q_end": "q_end", "t_species": "t_species", "t_name": "t_name", "ref_length": "ref_length", "ref_leaf": "leaf"}
    side = lambda p, k: named.select(*keys, F.col("i").alias(k), *(F.col(c).alias(f"{p}_{a}") for c, a in wanted.items()))
    pairs = pairing.candidate_pairs(numbered, keys).join(side("l", "i"), [*keys, "i"]).join(side("r", "j"), [*keys, "j"])
    known = lineage.pair_divergence(pairs, paths, "l_leaf", "r_leaf")
    close = reference.lookup_pair(known, ref.close_pairs, "l_t_name", "r_t_name").withColumn("in_close", F.col("ani").isNotNull())
    return pairing.judge_pair(close)


def run_query(spark: SparkSession, folder: str, hits: DataFrame, runs: DataFrame, ref: Reference, close_refs: DataFrame, parameters: dict[str, object], max_depth: int = 64) -> dict[str, DataFrame]:
    """All stages from raw hits to regions: first_div, islands, pairs, regions, summary.

    hits: run_id, chunk_idx, the hit columns and q_species. runs: run_id, chunk_bp, min_identity, size_filter,
    cluster_size. Stages are kept under `folder` by a hash of `parameters` (which must name the inputs) and reused.
    """
    keep = lambda name, build: stage(spark, folder, name, parameters, build)
    settings = runs.select("run_id", "min_identity", "chunk_bp", F.coalesce("size_filter", F.lit(150)).alias("least"), F.coalesce("cluster_size", F.lit(0)).alias("gap"))

    def first_div() -> DataFrame:
        usable = hits.withColumn("q_name", clean_id(F.col("q_name"))).where("q_name is not null and q_start < q_end").join(settings.select("run_id", "min_identity"), "run_id")
        leaves = lineage.resolve_names(usable.select("q_species"), ref.nodes, "q_species")
        return divergence.filter_hits(usable, ref.index, leaves, paths, close_refs, "min_identity")

    paths = materialise(lineage.ancestor_paths(ref.nodes, max_depth))
    filtered = keep("first_div", first_div)
    return {"first_div": filtered} | regions_of_hits(filtered.withColumn("t_species", F.col("ref_species")), settings, ref, paths, keep)


def regions_of_hits(hits: DataFrame, settings: DataFrame, ref: Reference, paths: DataFrame, keep: Callable[[str, Callable[[], DataFrame]], DataFrame]) -> dict[str, DataFrame]:
    """islands, pairs, regions and summary of hits that have passed the filter; `keep` stores a stage's table and gives it back."""
    carried = [c for c in CARRIED if c in hits.columns]
    numbered = keep("islands", lambda: pairing.number_hits(islands.merge_islands(hits, GROUP, carried), GROUP, TIE))
    judged = keep("judged", lambda: judge_candidates(numbered, ref, paths, GROUP).where("accepted").select(*GROUP, "stretch", "i", "j", "overlap", F.col("divergence").alias("ref_divergence"), "ref_ani_lt_95"))

    def pairs() -> DataFrame:
        matched = pairing.greedy_match(judged, GROUP).join(judged.select(*GROUP, "i", "j", "ref_divergence", "ref_ani_lt_95"), [*GROUP, "i", "j"])
        return pairing.overlap_pairs(numbered, matched, GROUP)

    matched = keep("pairs", pairs)
    return {"islands": numbered, "pairs": matched} | refilter(matched, settings, ref.index)


def refilter(pairs: DataFrame, settings: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    """regions and summary of overlap pairs, or of filtered hits, with local coordinates; settings: run_id, chunk_bp, least, gap."""
    keys, order = ["run_id", "q_name"], ["q_start", "q_end", "t_name", "t_start", "t_end"]
    placed = chunks.restore_offsets(pairs.join(settings.select("run_id", "chunk_bp", "least", "gap"), "run_id"), "chunk_bp").withColumnRenamed("divergence", "divergence_time")
    members = regions.process(placed.where("q_start is not null and q_start < q_end"), keys, "least", "gap")
    summary = regions.summarise(members, index, keys, order)
    kept = members.join(summary.select(*keys, "region"), [*keys, "region"], "left_semi")
    return {"regions": regions.joined_members(kept, keys, order), "summary": summary}


def build_database(sequences: DataFrame, species: DataFrame, nodes: DataFrame, max_bp: int, k: int = 21, scale: int = 100, short: int = 20_000, repeats: int = 1024, least_ani: float = 90.0) -> dict[str, DataFrame]:
    """files, index, heavy_seeds, sketches, close_pairs of sequences (seq_id, record_no, seq).

    files: the next-fit grouping at max_bp. close_pairs: pairs of an estimated identity of 95 or more.
    heavy_seeds are a list for aligners; sketches and close pairs are made of all seeds: one in `scale` of them, and all of
    a sequence that has fewer than `short`.
    """
    lengths = sequences.select("seq_id", "record_no", F.length("seq").cast("bigint").alias("seq_length"))
    grouped = lengths.withColumns({"build_id": F.lit(1).cast("bigint"), "max_bp": F.lit(max_bp).cast("bigint")})
    table = kmers.seeds(sequences, k, "seq_id", "seq")
    heavy = kmers.heavy_seeds(table, repeats)
    hashed = materialise(table.select("seq_id", F.xxhash64("seed").alias("h")).distinct())
    edges = kmers.all_against_all(hashed, k, least_ani, scale, short)
    return {
        "files": next_fit.next_fit(grouped).drop("build_id"), "index": reference.build_index(lengths.select("seq_id", "seq_length"), species, nodes),
        "heavy_seeds": heavy, "sketches": kmers.scaled_sketches(hashed, scale, short), "close_pairs": reference.closest_pairs(edges),
    }


def is_complete_split(files: DataFrame, sequences: DataFrame) -> bool:
    """Whether every sequence, and at least one, is in a file."""
    placed, there = files.count(), sequences.where("length(seq) > 0").count()
    return placed == there and there > 0
