import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from phylospan.llm import packing


def optimal(sizes, capacity):
    """Fewest containers, by trying all assignments."""
    for n in range(len(sizes) + 1):
        for places in itertools.product(range(n), repeat=len(sizes)):
            fill = [0] * n
            for p, s in zip(places, sizes):
                fill[p] += s
            if all(f <= capacity for f in fill):
                return n
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=6))
def test_bound_and_packing(sizes):
    array = np.array(sizes, np.int64)
    best = optimal(sizes, 10)
    place, left = packing.best_fit_decreasing(array, 10)
    assert packing.lower_bound(array, 10) <= best <= len(left)
    for k, room in enumerate(left):
        assert room == 10 - array[place == k].sum() >= 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 35), max_size=30))
def test_part(sizes):
    ids = [f"s{k}" for k in range(len(sizes))]
    rows, bins, bound = packing.pack_part(ids, np.array(sizes, np.int64), 10)
    assert bound <= bins
    fill, total, pieces = {}, {}, {}
    for place, name, piece, size in rows:
        fill[place] = fill.get(place, 0) + size
        total[name] = total.get(name, 0) + size
        pieces.setdefault(name, []).append(piece)
    assert total == dict(zip(ids, sizes)) and all(0 < f <= 10 for f in fill.values()) and len(fill) == bins
    for name, size in zip(ids, sizes):
        assert sorted(pieces[name]) == list(range(1, len(pieces[name]) + 1))
        assert len(pieces[name]) == 1 or size > 10


def check(rows, wanted, limits):
    fill, total = {}, {}
    for r in rows:
        fill[r.build_id, r.container_no] = fill.get((r.build_id, r.container_no), 0) + r.piece_bp
        total[r.build_id, r.seq_id] = total.get((r.build_id, r.seq_id), 0) + r.piece_bp
    assert total == wanted and all(f <= limits[b] for (b, _), f in fill.items())
    return len(fill)


def test_pack_sequences(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{k}", 1 + k % 2, k, int(n), 0) for k, n in enumerate(rng.integers(1, 140, 600))]
    wanted = {(b, s): n for s, b, _, n, _ in rows}
    dirty = [*rows, *rows[:50], ("n", 1, 0, None, 0), ("z", 1, 0, 0, 0), ("m", 1, 0, -5, 0), ("x", 3, 0, 5, 0), ("y", None, 0, 5, 0), ("w", 4, 0, 5, 0)]
    df = spark.createDataFrame(dirty, "seq_id string, build_id bigint, record_no bigint, seq_length bigint, bin int")
    limits = {1: 100, 2: 60}
    builds = spark.createDataFrame([(1, 100), (2, 60), (3, None), (4, 0)], "build_id bigint, max_bp bigint")
    used = {}
    for items in (10_000, 40):
        used[items] = check(packing.pack_sequences(df, builds, part_items=items).collect(), wanted, limits)
    volume = sum(-(-sum(n for (b, _), n in wanted.items() if b == build) // most) for build, most in limits.items())
    assert volume <= used[10_000] <= volume + 3 and used[40] <= volume * 1.05
    assert packing.pack_sequences(df.where("false"), builds).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=40))
def test_bound_of_a_whole_build(sizes):
    """The summed bound holds, and is the parts' own bound at the grid's thresholds."""
    import pandas as pd

    capacity = 100
    rows = [(2 * (packing.GRID + 1) if n > capacity else 2 * (n * packing.GRID // capacity) + (n * packing.GRID % capacity > 0), 1, n) for n in sizes]
    bound = packing.bound_of_histogram(pd.DataFrame(rows, columns=["slot", "n", "bp"]), capacity)
    array = np.array([n for n in sizes if n <= capacity], np.int64)
    assert -(-sum(sizes) // capacity) <= bound <= packing.lower_bound(array, capacity, sum(n for n in sizes if n > capacity))


def test_tiny_items_fill_one_container(spark):
    from pyspark.sql import functions as F

    df = spark.range(100_000).select(F.lit(1).cast("bigint").alias("build_id"), F.col("id").cast("string").alias("seq_id"), F.lit(10).cast("bigint").alias("seq_length"))
    df = df.unionByName(spark.range(30_000).select(F.lit(2).cast("bigint").alias("build_id"), F.col("id").cast("string").alias("seq_id"), (F.col("id") % 7 + 1).alias("seq_length")))
    builds = spark.createDataFrame([(1, 1_000_000), (2, 9_000)], "build_id bigint, max_bp bigint")
    rows = packing.pack_sequences(df, builds, part_items=20_000)
    fills = {(r.build_id, r.container_no): r.fill for r in rows.groupBy("build_id", "container_no").agg(F.sum("piece_bp").alias("fill")).collect()}
    assert rows.count() == 130_000 and sum(fills.values()) == 1_000_000 + sum(k % 7 + 1 for k in range(30_000))
    assert [f for (b, _), f in fills.items() if b == 1] == [1_000_000]
    two = [f for (b, _), f in fills.items() if b == 2]
    assert max(two) <= 9_000 and len(two) == -(-sum(two) // 9_000)
