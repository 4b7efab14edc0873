"""Greedy matching of the largest overlaps between hits of divergent references, within one chunk of a query.

Only overlapping hits interact, so each stretch of hits that hang together by overlap is matched on its own. The
candidate rule is part of the result, not only a saving: for each hit, later ones are taken in order of start while they
begin before its end and could still overlap it by as much as the best so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospan.functions import intervals as iv
from phylospan.operators.islands import UNCLASSIFIED, number_islands

SHORT_REF = 500
CLOSE = 95.0


def number_hits(hits: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """hits with i, their place by (q_start, q_end, tie), and stretch, the part of the group they hang together with."""
    order = ["q_start", "q_end", *tie]
    rows = hits.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number_islands(rows, keys, ["i"], "q_start", "q_end", 0, "stretch", inclusive=False)


def _sweep(keys: list[str]):
    """The sweep over hits that come sorted by (keys, stretch, i): each hit waits until its end or its best overlap rules out more."""
    group = [*keys, "stretch"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, waiting = None, []
        for batch in batches:
            found: list[tuple] = []
            columns = (batch[c].tolist() for c in (*group, "i", "q_start", "q_end", "t_species"))
            for *key, i, start, end, species in zip(*columns):
                if key != current:
                    current, waiting = key, []
                still = []
                for hit in waiting:
                    first, low, high, label, best = hit
                    if start > high or high - start < best:
                        continue
                    shared = min(high, end) - start
                    if shared > 0 and (label != species or label is None or label == UNCLASSIFIED):
                        found.append((*key, first, i, shared))
                        hit[4] = best = max(best, shared)
                        if best == high - low:
                            continue
                    still.append(hit)
                still.append([i, start, end, species, 0])
                waiting = still
            yield pd.DataFrame(found, columns=[*group, "i", "j", "overlap"])

    return run


def candidate_pairs(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stretch, i, j, overlap) of the pairs that the sweep looks at.

    For hit i and later j: overlap above 0, not the same classified species; then the sweep's stops: j counts only while
    no earlier candidate of i covers i whole and i's end less j's start is at least the best overlap so far. Hits stream
    through in order and only candidates come out, so a deep pile of hits never becomes all of its pairs.
    """
    types = dict(numbered.dtypes)
    ddl = ", ".join(f"{c} {types[c]}" for c in [*keys, "stretch"]) + ", i int, j int, overlap bigint"
    rows = numbered.select(*keys, "stretch", "i", "q_start", "q_end", "t_species").where("q_start < q_end")
    return rows.repartition(*keys, "stretch").sortWithinPartitions(*keys, "stretch", "i").mapInPandas(_sweep(keys), ddl)


def judge_pair(pair: DataFrame, least: float = 1.0) -> DataFrame:
    """pair with ref_ani_lt_95 and accepted.

    pair: l_/r_ columns leaf, t_species, ref_length, q_start, q_end, and divergence (null when unknown), in_close (whether
    the two references are in the table of close pairs). Rejected: equal classified leaves or species; a known divergence
    under `least`; with unknown divergence, references that are close (by crude overlap identity where one has 500 bp or
    fewer; its -1 keeps the pair).
    """
    classified = (F.col("l_t_species") != UNCLASSIFIED) & (F.col("r_t_species") != UNCLASSIFIED)
    same = classified & ((F.col("l_leaf") == F.col("r_leaf")) | (F.col("l_t_species") == F.col("r_t_species")))
    short = (F.col("l_ref_length") <= SHORT_REF) | (F.col("r_ref_length") <= SHORT_REF)
    crude = iv.crude_overlap_identity(F.col("l_q_start"), F.col("l_q_end"), F.col("r_q_start"), F.col("r_q_end"), F.col("l_ref_length"), F.col("r_ref_length"))
    apart = F.when(short, crude < CLOSE).otherwise(~F.col("in_close"))
    unknown = F.col("divergence").isNull()
    return pair.withColumn("ref_ani_lt_95", F.when(unknown, apart)).withColumn(
        "accepted", ~F.coalesce(same, F.lit(False)) & F.when(unknown, apart).otherwise(F.col("divergence") >= least)
    )


def greedy_match(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, overlap) of the matching that takes edges by (largest overlap, i, j) and uses each hit once.

    The edges of a stretch stream through in this order; a task remembers only the hits of one stretch that are used.
    """
    group = [*keys, "stretch"]
    types = dict(edges.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = None, set()
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for k, (*key, i, j) in enumerate(zip(*(batch[c].tolist() for c in (*group, "i", "j")))):
                if key != current:
                    current, used = key, set()
                if i not in used and j not in used:
                    used.update((i, j))
                    keep[k] = True
            yield batch.loc[keep, [*keys, "i", "j", "overlap"]]

    columns = [*keys, "i", "j", "overlap"]
    placed = edges.select(*group, "i", "j", "overlap").repartition(*group).sortWithinPartitions(*group, F.desc("overlap"), "i", "j")
    return placed.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in columns))


def overlap_pairs(numbered: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """One row a match: the shared interval, and the two references' columns side by side as left,right."""
    both = ("t_name", "t_size", "t_start", "t_end", "pct_identity", "t_species", "divergence", "ani_lt_95")
    columns = [c for c in both if c in numbered.columns]
    side = lambda p, k: numbered.select(*keys, F.col("i").alias(k), F.struct("q_size", "q_start", "q_end", "q_species", *columns).alias(p))
    rows = matches.join(side("l", "i"), [*keys, "i"]).join(side("r", "j"), [*keys, "j"])
    text = lambda p, c: F.coalesce(F.col(f"{p}.{c}").cast("string"), F.lit("NA"))
    return rows.select(
        *keys, F.col("l.q_size").alias("q_size"), F.greatest("l.q_start", "r.q_start").alias("q_start"), F.least("l.q_end", "r.q_end").alias("q_end"),
        F.col("l.q_species").alias("q_species"), *(F.concat_ws(",", text("l", c), text("r", c)).alias(c) for c in columns),
        *(c for c in ("ref_divergence", "ref_ani_lt_95") if c in matches.columns),
    )
