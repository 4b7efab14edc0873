"""Seed-based similarity: k-mer counts, over-represented seeds, seed joins, diagonals, sketches and labels by vote.

Native counterparts of an aligner's, a sketcher's and a classifier's first steps, by published methods (seed and
extend, bottom-k sketches, k-mer votes); approximations, not the external programs' results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospan.operators.islands import number_islands
from phylospan.session import materialise


WINDOW = 64
#: Seeds of the smaller side that are broadcast at once.
BLOCK_SEEDS = 1_000_000


def seeds(sequences: DataFrame, k: int, seq_id: str, seq: str, step: int = 1) -> DataFrame:
    """(seq_id, pos, seed): every k letters at each step; sequences shorter than k and null ones give none.

    Long texts are first cut into short overlapping windows, since taking letters out of the middle of a string costs
    its whole length.
    """
    stride = WINDOW * step
    windows = (
        sequences.where(F.length(seq) >= k)
        .select(F.col(seq_id).alias("seq_id"), F.col(seq).alias("_seq"), F.explode(F.sequence(F.lit(0), F.length(seq) - k, F.lit(stride))).alias("_first"))
        .select("seq_id", "_first", F.substring(F.col("_seq"), F.col("_first") + 1, F.lit(stride - step + k)).alias("_window"))
    )
    inner = F.explode(F.sequence(F.lit(0), F.length("_window") - k, F.lit(step)))
    return windows.select("seq_id", "_first", "_window", inner.alias("_at")).select(
        "seq_id", (F.col("_first") + F.col("_at")).alias("pos"), F.substring(F.col("_window"), F.col("_at") + 1, F.lit(k)).alias("seed")
    )


def seed_counts(table: DataFrame) -> DataFrame:
    """(seed, n) over all sequences."""
    return table.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


def number_of_seeds(sequences: DataFrame, k: int, seq: str) -> int:
    """How many seeds there are at a step of 1, from the lengths alone."""
    return sequences.select(F.sum(F.greatest(F.length(seq) - (k - 1), F.lit(0)).cast("bigint"))).first()[0] or 0


def heavy_seeds(table: DataFrame, above: int, expected: int | None = None) -> DataFrame:
    """(seed, n) of seeds that occur more than `above` times; they are left out of seed joins, which also takes away their skew.

    Nearly all seeds of a corpus occur once. So hash buckets are counted first, about four for each `above` of the
    `expected` seeds (counted when not given), and only seeds of buckets above the limit are shuffled and counted exactly.
    """
    expected = table.count() if expected is None else expected
    buckets = 1 << max(8, (4 * expected // max(1, above)).bit_length())
    placed = table.select("seed", F.pmod(F.xxhash64("seed"), F.lit(buckets)).alias("_bucket"))
    full = materialise(placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > above).select("_bucket"))
    return seed_counts(placed.join(full, "_bucket", "left_semi")).where(F.col("n") > above)


def seeds_among(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a seed table whose seed occurs in another, smaller one: by hash first, so that long strings aren't compared."""
    hashes = materialise(wanted.select(F.xxhash64("seed").alias("_h")).distinct())
    near = table.withColumn("_h", F.xxhash64("seed")).join(hashes, "_h", "left_semi").drop("_h")
    return near.join(wanted.select("seed").distinct(), "seed", "left_semi").select("seq_id", "pos", "seed")


def seed_hits(queries: DataFrame, references: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """(q_id, t_id, q_pos, t_pos) of equal seeds in two seed tables, without the heavy ones."""
    q = queries.select(F.col("seq_id").alias("q_id"), F.col("pos").alias("q_pos"), "seed")
    t = references.select(F.col("seq_id").alias("t_id"), F.col("pos").alias("t_pos"), "seed")
    if heavy is not None:
        t = t.join(heavy.select("seed"), "seed", "left_anti")
    return q.join(t, "seed").select("q_id", "t_id", "q_pos", "t_pos")


def every_seed_hit(queries: DataFrame, references: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(q_id, t_id, q_pos, t_pos) of all equal seeds in two seed tables, however often a seed occurs.

    The references are the smaller side: their seeds are broadcast in blocks, each block against all queries. The queries'
    seeds are not shuffled, so a frequent one is no burden to a single task.
    """
    q = queries.select(F.col("seq_id").alias("q_id"), F.col("pos").alias("q_pos"), "seed")
    t = references.select(F.col("seq_id").alias("t_id"), F.col("pos").alias("t_pos"), "seed")
    blocks = max(1, -(-t.count() // block_seeds))
    found = None
    for b in range(blocks):
        part = t.where(F.pmod(F.xxhash64("t_id", "t_pos"), F.lit(blocks)) == b) if blocks > 1 else t
        one = q.join(F.broadcast(part), "seed").select("q_id", "t_id", "q_pos", "t_pos")
        found = one if found is None else found.unionByName(one)
    return found


def diagonal_islands(hits: DataFrame, k: int, gap: int, least_seeds: int = 1) -> DataFrame:
    """(q_id, t_id, diagonal, q_start, q_end, n_seeds): seeds on one diagonal at most `gap` apart; islands of fewer than
    `least_seeds` are left out."""
    placed = hits.select("q_id", "t_id", (F.col("q_pos") - F.col("t_pos")).alias("diagonal"), F.col("q_pos").alias("q_start"), (F.col("q_pos") + k).alias("q_end")).distinct()
    numbered = number_islands(placed, ["q_id", "t_id", "diagonal"], ["q_start"], "q_start", "q_end", gap)
    out = numbered.groupBy("q_id", "t_id", "diagonal", "island").agg(F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end"), F.count(F.lit(1)).alias("n_seeds")).drop("island")
    return out.where(F.col("n_seeds") >= least_seeds)


def score_islands(islands: DataFrame, queries: DataFrame, references: DataFrame, q: tuple[str, str], t: tuple[str, str]) -> DataFrame:
    """Ungapped hits: islands with t_start, t_end, n_match and n_mismatch, letter by letter along the diagonal.

    q and t name the id and text columns of queries and references.
    """
    length = F.col("q_end") - F.col("q_start")
    placed = islands.withColumns({"t_start": F.col("q_start") - F.col("diagonal"), "t_end": F.col("q_end") - F.col("diagonal")})
    both = placed.join(queries.select(F.col(q[0]).alias("q_id"), F.col(q[1]).alias("_q")), "q_id").join(references.select(F.col(t[0]).alias("t_id"), F.col(t[1]).alias("_t")), "t_id")
    letters = lambda text, at: F.split(F.substring(F.col(text), F.col(at) + 1, length), "")
    same = F.size(F.filter(F.zip_with(letters("_q", "q_start"), letters("_t", "t_start"), lambda a, b: a == b), lambda x: x))
    return both.withColumn("n_match", same).withColumn("n_mismatch", length - F.col("n_match")).drop("_q", "_t")


def reverse_complement(seq: str) -> Column:
    """The other strand of a nucleotide text; letters other than A, C, G, T and U stay as they are."""
    return F.translate(F.reverse(F.col(seq)), "ACGTUacgtu", "TGCAAtgcaa")


def align(queries: DataFrame, references: DataFrame, k: int = 11, gap: int = 8, least_score: int = 30) -> DataFrame:
    """Ungapped hits of sequences (seq_id, seq) on both strands, with the columns of a hit table.

    Every seed counts. A hit is a run of seeds on one diagonal at most `gap` apart, compared letter by letter; its score
    is its matches less its mismatches. Positions of the query are those of its given strand, as hit tables have them.
    Gaps within a hit aren't bridged: an insertion makes two hits.
    """
    targets = seeds(references, k, "seq_id", "seq")
    out = None
    for strand in ("+", "-"):
        texts = queries.select("seq_id", (F.col("seq") if strand == "+" else reverse_complement("seq")).alias("seq"))
        found = diagonal_islands(every_seed_hit(seeds(texts, k, "seq_id", "seq"), targets), k, gap)
        hits = score_islands(found, texts, references, ("seq_id", "seq"), ("seq_id", "seq")).withColumn("strand", F.lit(strand))
        out = hits if out is None else out.unionByName(hits)
    sizes = lambda df, key, name: df.select(F.col("seq_id").alias(key), F.length("seq").cast("bigint").alias(name))
    sized = out.where(F.col("n_match") - F.col("n_mismatch") >= least_score).join(sizes(queries, "q_id", "q_size"), "q_id").join(sizes(references, "t_id", "t_size"), "t_id")
    forward = F.col("strand") == "+"
    return sized.select(
        "n_match", "n_mismatch", "strand", F.col("q_id").alias("q_name"), "q_size",
        F.when(forward, F.col("q_start")).otherwise(F.col("q_size") - F.col("q_end")).cast("bigint").alias("q_start"),
        F.when(forward, F.col("q_end")).otherwise(F.col("q_size") - F.col("q_start")).cast("bigint").alias("q_end"),
        F.col("t_id").alias("t_name"), "t_size", F.col("t_start").cast("bigint").alias("t_start"), F.col("t_end").cast("bigint").alias("t_end"),
    )


def sketches(table: DataFrame, size: int) -> DataFrame:
    """(seq_id, h): the `size` smallest distinct seed hashes of each sequence. The hash is of the seed alone."""
    hashed = table.select("seq_id", F.xxhash64("seed").alias("h")).distinct()
    # Within parts of a sequence first, so that a long one isn't sorted in one task; then its parts' smallest.
    first = F.row_number().over(Window.partitionBy("seq_id", "part").orderBy("h"))
    some = hashed.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(64))).withColumn("rank", first).where(F.col("rank") <= size)
    last = F.row_number().over(Window.partitionBy("seq_id").orderBy("h"))
    return some.withColumn("rank", last).where(F.col("rank") <= size).select("seq_id", "h")


def scaled_sketches(hashed: DataFrame, scale: int, short: int) -> DataFrame:
    """(seq_id, h) of distinct hashes: one in `scale` by the hash's value, and all of a sequence with fewer than `short`."""
    small = hashed.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < short).select("seq_id")
    sampled = F.pmod("h", F.lit(scale)) == 0
    return hashed.join(small.withColumn("whole", F.lit(True)), "seq_id", "left").where(F.coalesce("whole", sampled)).select("seq_id", "h")


def all_against_all(hashed: DataFrame, k: int, least: float, scale: int = 100, short: int = 20_000) -> DataFrame:
    """(id1, id2, ani): both orders of the pairs of sequences with an estimated identity of at least `least`.

    hashed: (seq_id, h), all distinct hashes. The sketch of one sequence is held against all hashes of the other, so the
    shared part doesn't shrink with the other's length; the better order of a pair is that of the smaller sequence.
    Sequences with the same hashes are held against the others once, and are pairs of identity 100 themselves.
    """
    marks = hashed.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("a"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("b"))
    members = materialise(marks.select("seq_id", F.min("seq_id").over(Window.partitionBy("n", "a", "b")).alias("class")))
    one = hashed.join(members.where(F.col("seq_id") == F.col("class")).select("seq_id"), "seq_id", "left_semi")
    near = sketch_similarity(scaled_sketches(one, scale, short), one, k, least).where("q_id <> t_id").select("q_id", "t_id", "ani")
    left, right = members.select(F.col("seq_id").alias("id1"), F.col("class").alias("q_id")), members.select(F.col("seq_id").alias("id2"), F.col("class").alias("t_id"))
    same = left.join(right.withColumnRenamed("t_id", "q_id"), "q_id").where("id1 <> id2").select("id1", "id2", F.lit(100.0).alias("ani"))
    return near.join(left, "q_id").join(right, "t_id").select("id1", "id2", "ani").unionByName(same)


def sketch_similarity(queries: DataFrame, references: DataFrame, k: int, least: float) -> DataFrame:
    """(q_id, t_id, shared, containment, ani): pairs whose estimated identity, containment^(1/k) in percent, is at least `least`."""
    sizes = queries.groupBy("seq_id").agg(F.count(F.lit(1)).alias("size"))
    shared = (
        queries.select(F.col("seq_id").alias("q_id"), "h").join(references.select(F.col("seq_id").alias("t_id"), "h"), "h")
        .groupBy("q_id", "t_id").agg(F.count(F.lit(1)).alias("shared"))
    )
    scored = shared.join(sizes.withColumnRenamed("seq_id", "q_id"), "q_id").withColumn("containment", F.col("shared") / F.col("size"))
    return scored.withColumn("ani", F.pow("containment", F.lit(1.0 / k)) * 100).where(F.col("ani") >= least).drop("size")


def vote_labels(table: DataFrame, labelled: DataFrame) -> DataFrame:
    """(seq_id, label, votes): the label with most of a sequence's seeds, the smaller label on a tie.

    labelled: (seed, label), a seed that has several labels is no evidence and is left out.
    """
    sure = labelled.distinct().groupBy("seed").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("labels")).where("labels = 1").drop("labels")
    votes = table.select("seq_id", "seed").distinct().join(sure, "seed").groupBy("seq_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("seq_id").agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("label"), F.max("votes").alias("votes"))
