import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from phylospan.operators import hot_keys, periods


def test_heavy_keys(spark):
    rows = [("a",)] * 4 + [("'a'",), (' "a" ',), (None,), ("  ",), ("b",)] + [("c%d" % k,) for k in range(91)]
    df = spark.createDataFrame(rows, "q_name string").selectExpr("q_name", "1 as n_rows")
    assert {r.q_name for r in hot_keys.heavy_keys(df, percent=2).collect()} == {"a"}
    assert {r.q_name for r in hot_keys.heavy_keys(df, percent=1).collect()} >= {"a", "b"}
    assert hot_keys.heavy_keys(df.where("false")).count() == 0
    counts = {r.q_name: r.n_rows for r in hot_keys.key_counts(df).collect()}
    assert counts["a"] == 6 and len(counts) == 93


def test_hit_summary_nulls(spark):
    schema = "q_name string, t_name string, run_id bigint, n_match int, q_start bigint, q_end bigint, pct_identity double, n_hits int"
    df = spark.createDataFrame([("a", "t", 1, 5, 1, None, None, 0), ("'a'", None, 1, 7, 3, 9, 50.0, 0), (None, "t", 1, 1, 1, 1, 1.0, 0)], schema)
    (row,) = hot_keys.hit_summary(df).collect()
    assert (row.q_name, row.n_hits, row.n_references, row.n_match, row.min_start, row.max_end, row.mean_identity) == ("a", 2, 1, 12, 1, 9, 50.0)


def brute(intervals):
    """Periods and gaps by the definition."""
    found = []
    for s, e in sorted(intervals):
        if found and s <= found[-1][1] + 1:
            found[-1][1] = max(found[-1][1], e)
        else:
            found.append([s, e])
    out = [("period", s, e) for s, e in found]
    return out + [("gap", a[1], b[0]) for a, b in zip(found, found[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=8), max_size=6))
def test_tree_merge(parts):
    tree = periods.IntervalTree()
    for part in parts:
        rows = sorted((s, s + n + 1) for s, n in part)
        a, b = np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64)
        tree.add(periods.union_sorted(a, b))
    start, stop = tree.result()
    flat = [(s, s + n) for part in parts for s, n in part]
    assert [("period", a, b - 1) for a, b in zip(start, stop)] == [x for x in brute(flat) if x[0] == "period"]


def test_periods_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = []
    for key in range(12):
        n = int(rng.integers(1, 60))
        starts = rng.integers(-50, 900, n)
        lengths = np.where(rng.random(n) < 0.1, rng.integers(100, 700, n), rng.integers(1, 12, n))
        data += [(f"k{key % 6}", key // 6, int(s), int(s + l)) for s, l in zip(starts, lengths)]
    data += data[:20]
    df = spark.createDataFrame(data, "name string, run bigint, start bigint, end bigint")
    expected = {}
    for name, run, s, e in data:
        expected.setdefault((name, run), []).append((s, e))
    want = sorted((*k, *x) for k, v in expected.items() for x in brute(v))
    for tile in (1, 7, 64, 1 << 18):
        got = periods.periods_and_gaps(df.repartition(5), ["name", "run"], tile_bp=tile)
        assert sorted(tuple(r) for r in got.collect()) == want, tile


def test_periods_edge_cases(spark):
    schema = "q_name string, run_id bigint, kind string, start bigint, end bigint"
    rows = [("a", 1, "x", 5, 5), ("a", 1, "x", 9, 3), ("a", 1, "x", None, 3), (None, 1, "x", 1, 3), ("a", 1, "x", 1, 3), ("a", 1, "x", 4, 6), ("a", 1, "x", 8, 10), ("b", 1, "x", 0, 1 << 60)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in periods.periods_and_gaps(df, ["run_id", "q_name"]).collect())
    assert got == [(1, "a", "gap", 6, 8), (1, "a", "period", 1, 6), (1, "a", "period", 8, 10), (1, "b", "period", 0, 1 << 60)]
    assert periods.periods_and_gaps(df.where("false"), ["run_id", "q_name"]).count() == 0


def test_long_intervals_change_nothing_for_others(spark):
    """Intervals of up to 2^60 beside a hot key of many small ones, and small ones inside, across and at the ends of long ones."""
    hot = [("hot", k * 40, k * 40 + 9) for k in range(4000)]
    far = [("far", -(1 << 60), 1 << 60), ("far", (1 << 60) + 2, (1 << 60) + 5), ("far", 7, 9)]
    wide = 1 << 18
    rng = np.random.default_rng(3)
    mixed = [("mix", int(s), int(s + n)) for s, n in zip(rng.integers(-wide * 50, wide * 50, 300), 1 << rng.integers(1, 24, 300))]
    mixed += [("mix", wide * 60, wide * 64), ("mix", wide * 64 + 1, wide * 64 + 5), ("mix", wide * 61 + 5, wide * 61 + 9), ("mix", wide * 66, wide * 66 + 1), ("mix", wide * 62, wide * 70)]
    rows = [*hot, *far, *mixed, ("one", 0, 1 << 60)]
    df = spark.createDataFrame(rows, "q_name string, start bigint, end bigint")
    expected = sorted((key, *x) for key in ("hot", "far", "mix", "one") for x in brute([(s, e) for k, s, e in rows if k == key]))
    for tile in (64, wide):
        assert sorted(tuple(r) for r in periods.periods_and_gaps(df, ["q_name"], tile_bp=tile).collect()) == expected, tile
    # No more than two pieces a row and level, whatever stands beside it.
    starts = np.arange(4000) * 40
    assert len(periods._tiled(starts, starts + 10, 1024)[0]) < 4200
    assert len(periods._tiled(np.array([0]), np.array([1 << 60]), 1024)[0]) <= 8


def test_assign_periods(spark):
    held = spark.createDataFrame([("a", 0, 10, "x"), ("a", 20, 1 << 50, "y"), ("b", 5, 6, "z")], "k string, seg_start bigint, seg_end bigint, tag string")
    rows = [("a", p) for p in (-1, 0, 10, 15, 20, 1 << 20, 1 << 49, (1 << 50) + 1)] + [("b", 5), ("c", 5), (None, 5), ("a", None)]
    df = spark.createDataFrame(rows, "k string, at bigint")
    got = sorted((r.k, r.at, r.period_start, r.tag) for r in periods.assign_periods(df, held, ["k"], "at").collect())
    assert got == [("a", 0, 0, "x"), ("a", 10, 0, "x"), ("a", 20, 20, "y"), ("a", 1 << 20, 20, "y"), ("a", 1 << 49, 20, "y"), ("b", 5, 5, "z")]
    assert periods.assign_periods(df, held.where("false"), ["k"], "at").count() == 0


def test_query_periods_restores(spark):
    pairs = spark.createDataFrame([(1, 0, " 'q' ", 5, 20), (1, 1, "q", 0, 4), (1, 3, "q", 1, 2), (2, 0, "q", 1, 2), (1, None, "q", 1, 2), (1, 0, "q", -1, 2), (1, 0, " ", 1, 2)], "run_id bigint, chunk_idx int, q_name string, q_start bigint, q_end bigint")
    runs = spark.createDataFrame([(1, 20)], "run_id bigint, chunk_bp bigint")
    got = sorted(tuple(r) for r in periods.query_periods(pairs, runs).collect())
    assert got == [(1, "q", "gap", 24, 61), (1, "q", "period", 5, 24), (1, "q", "period", 61, 62)]
