"""Golden micro-cases of the hit filter, islands, pairing and regions, worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from phylospan.operators import chunks, divergence, islands, kmers, lineage, next_fit, pairing, reference, regions
from phylospan.plans import pipeline, sequence_queries

HITS = "n_match bigint, q_start bigint, q_end bigint, q_size bigint, q_name string, t_name string, ref_length bigint, divergence double, id int"


def test_hit_filter(spark):
    rows = [
        (89, 0, 100, 1000, "q", "t", 1000, 50.0, 1), (90, 0, 100, 1000, "q", "t", 1000, 0.99, 2), (90, 0, 100, 1000, "q", "c", 1000, 1.0, 3),
        (400, 0, 400, 499, "q", "c", 1000, None, 4), (390, 0, 390, 400, "q", "t", 1000, None, 5), (400, 0, 400, 499, "q", "t", 0, None, 6),
        (450, 0, 450, 500, "q", "c", 500, None, 7), (450, 0, 450, 500, "q", "t", 500, None, 8), (9, 5, 5, 500, "q", "t", 500, None, 9),
    ]
    close = spark.createDataFrame([("q", "c")], "q_name string, t_name string")
    kept = divergence.keep_divergent(divergence.filter_identity(spark.createDataFrame(rows, HITS), 90), close)
    assert {(r.id, r.ani_lt_95) for r in kept.collect()} == {(3, None), (4, True), (8, True)}


def island_rows(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "g string, q_start bigint, q_end bigint, t_species string, t_name string")


def merged(spark, rows, strict=True):
    out = islands.merge_islands(island_rows(spark, rows), ["g"], ["q_start", "q_end", "t_name", "t_species"], strict)
    return [(r.q_start, r.q_end, r.t_name) for r in sorted(out.collect(), key=lambda r: (r.emit_key, r.q_end))]


U = "unclassified"


def test_islands(spark):
    rows = [(0, 100, "A", "t1"), (50, 150, "A", "t2"), (60, 70, U, "u1"), (140, 200, "A", "t3"), (200, 250, "A", "t4"), (210, 220, "B", "b1"), (215, 300, "A", "t5")]
    assert merged(spark, rows) == [(60, 70, "u1"), (0, 200, "t1"), (200, 250, "t4"), (210, 220, "b1"), (215, 300, "t5")]
    assert merged(spark, [(0, 10, U, "u1"), (5, 50, "A", "a1"), (20, 80, "A", "a2")]) == [(0, 10, "u1"), (5, 50, "a1"), (5, 80, "a1")]
    assert merged(spark, [(0, 10, U, "u1"), (5, 50, "A", "a1"), (20, 80, "A", "a2")], strict=False) == [(0, 10, "u1"), (5, 80, "a1")]
    assert merged(spark, [(0, 10, U, "u1"), (5, 20, U, "u2")]) == [(0, 10, "u1"), (5, 20, "u2"), (5, 20, "u2")]
    assert merged(spark, [(0, 10, "A", "a")]) == [] and merged(spark, [(0, 10, "A", "a")] * 3) == []


def numbered(spark, rows):
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, q_start bigint, q_end bigint, t_species string")
    return pairing.number_hits(df, ["g"], ["t_species"])


def test_candidates_are_pruned(spark):
    got = pairing.candidate_pairs(numbered(spark, [(0, 100, "A"), (0, 100, "B"), (10, 100, "C")]), ["g"]).collect()
    assert {(r.i, r.j, r.overlap) for r in got} == {(1, 2, 100), (2, 3, 90)}
    got = pairing.candidate_pairs(numbered(spark, [(0, 60, "A"), (10, 100, "B"), (20, 100, "C"), (300, 400, "D"), (100, 200, "A")]), ["g"]).collect()
    assert {(r.i, r.j, r.overlap) for r in got} == {(1, 2, 50), (2, 3, 80)}


def test_greedy_takes_largest_first(spark):
    edges = spark.createDataFrame([("g", 1, 1, 2, 50), ("g", 1, 2, 3, 80), ("g", 1, 3, 4, 80), ("g", 2, 7, 8, 1)], "g string, stretch bigint, i int, j int, overlap bigint")
    assert {(r.i, r.j) for r in pairing.greedy_match(edges, ["g"]).collect()} == {(2, 3), (7, 8)}
    assert pairing.greedy_match(edges.where("false"), ["g"]).count() == 0


def test_judge_pair(spark):
    schema = "id int, l_t_species string, r_t_species string, l_leaf string, r_leaf string, l_ref_length bigint, r_ref_length bigint, l_q_start bigint, l_q_end bigint, r_q_start bigint, r_q_end bigint, divergence double, in_close boolean"
    rows = [
        (1, "A", "B", "a", "b", 900, 900, 0, 9, 0, 9, 0.5, False), (2, "A", "B", "a", "b", 900, 900, 0, 9, 0, 9, 1.0, True), (3, "A", "A", "a", "b", 900, 900, 0, 9, 0, 9, 9.0, False),
        (4, U, U, "NA", "NA", 900, 900, 0, 9, 0, 9, None, False), (5, U, "B", "NA", "b", 900, 900, 0, 9, 0, 9, None, True), (6, U, "B", "NA", "b", 500, 900, 0, 490, 0, 490, None, False),
        (7, U, "B", "NA", "b", 0, 900, 0, 490, 0, 490, None, True), (8, "A", "B", "a", "a", 900, 900, 0, 9, 0, 9, 9.0, False),
    ]
    got = {r.id: (r.accepted, r.ref_ani_lt_95) for r in pairing.judge_pair(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (False, None), 2: (True, None), 3: (False, None), 4: (True, True), 5: (False, False), 6: (False, False), 7: (True, True), 8: (False, None)}


def test_regions_in_order(spark):
    rows = spark.createDataFrame([("q", s, e) for s, e in ((0, 100), (120, 260), (261, 300), (340, 600))], "q string, q_start bigint, q_end bigint")
    spans = lambda gap: {(r.region_start, r.region_end, r.n) for r in regions.process(rows, ["q"], 150, gap).groupBy("region_start", "region_end").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert spans(50) == {(120, 600, 3)} and spans(0) == {(120, 300, 2), (340, 600, 1)}


def test_summary(spark):
    members = spark.createDataFrame([("q", 1, 5, 90, 5, 50, "r1,r2", "10,unk:unclassified_species", 99, "S"), ("q", 1, 5, 90, 6, 60, "r3,r1", "20,10", 98, "S")], "q string, region int, region_start bigint, region_end bigint, q_start bigint, q_end bigint, t_name string, divergence_time string, q_size bigint, q_species string")
    index = spark.createDataFrame([("r1", "X"), ("r2", "Y"), ("r3", "NA")], "seq_id string, leaf_name string")
    (row,) = regions.summarise(members, index, ["q"], ["q_start"]).collect()
    assert (row.n_pairs, row.n_species, round(row.mean_divergence, 4), row.q_size) == (2, 3, 13.3333, 99)
    assert regions.summarise(members, index.withColumn("leaf_name", F.lit("NA")), ["q"], ["q_start"]).count() == 0
    (text,) = regions.joined_members(members.withColumn("t_species", F.lit(None).cast("string")), ["q"], ["q_start"], ["t_name", "t_species"]).collect()
    assert text.t_name == "r1,r2|r3,r1" and text.t_species == "|"


def test_closest_pairs(spark):
    edges = spark.createDataFrame([("b", "a", 96.0), ("a", "b", 97.0), ("a", "a", 99.0), ("a", "c", 94.9)], "id1 string, id2 string, ani double")
    pairs = reference.closest_pairs(edges)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 97.0)]
    asked = spark.createDataFrame([("b", "a"), ("a", "c")], "x string, y string")
    assert {(r.x, r.ani) for r in reference.lookup_pair(asked, pairs, "x", "y").collect()} == {("b", 97.0), ("a", None)}


def test_chunks(spark):
    df = spark.createDataFrame([("'a'", "x" * 250), ("b", "y" * 100), ("c", ""), ("d", None)], "seq_id string, seq string")
    got = {(r.seq_id, r.chunk_idx, r.chunk_offset, len(r.chunk_seq)) for r in chunks.explode_chunks(df, 100).collect()}
    assert got == {("a", 0, 0, 100), ("a", 1, 100, 100), ("a", 2, 200, 50), ("b", 0, 0, 100), ("c", 0, 0, 0)}
    rows = spark.createDataFrame([("2", "5", "40"), ("1", "x", None)], "chunk_idx string, q_start string, q_end string")
    assert [(r.q_start, r.q_end) for r in chunks.restore_offsets(rows, 100).collect()] == [(205, 240), (None, None)]
    assert [(r.q_start, r.q_end) for r in chunks.restore_offsets(rows, 100, default=0).collect()] == [(205, 240), (100, 100)]


def test_name_cascade(spark):
    nodes = spark.createDataFrame([("'Aaa_bbb'", 1), ("'Ccc'", 2), ("'Ddd_eee_fff'", 3)], "name string, order int")
    names = spark.createDataFrame([("Aaa bbb strain 1",), ("Ccc zzz",), ("Ddd zzz",), ("Ddd",), (U,), (None,), ("Aaa bbb",)], "species string")
    got = {r.species: r.leaf_name for r in lineage.resolve_names(names, nodes).collect()}
    assert got == {"Aaa bbb strain 1": "'Aaa_bbb'", "Ccc zzz": "'Ccc'", "Ddd zzz": "'Ddd_eee_fff'", "Ddd": "NA", U: "NA", "Aaa bbb": "'Aaa_bbb'"}


def test_divergence(spark):
    nodes = spark.createDataFrame([("r", None, 0.0), ("g", "r", 10.0), ("a", "g", 30.0), ("b", "g", 50.0), ("c", "r", 40.0)], "name string, parent string, dist_root double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "a"), ("a", "NA"), (None, "a")], "x string, y string")
    paths = lineage.ancestor_paths(nodes, 4)
    assert {r.name: [p["name"] for p in r.path] for r in paths.collect()}["a"] == ["a", "g", "r"]
    got = {(r.x, r.y): r.divergence for r in lineage.pair_divergence(pairs, paths, "x", "y").collect()}
    assert got == {("a", "b"): 30.0, ("b", "a"): 30.0, ("a", "c"): 35.0, ("a", "a"): 0.0, ("a", "NA"): None, (None, "a"): None}


def test_next_fit(spark):
    rows = spark.createDataFrame([(1, k, f"s{k}", n, 10) for k, n in enumerate((4, 5, 12, 1, 6))] + [(2, 1, "x", 3, 10), (2, 2, "y", None, 10)], "build_id bigint, record_no bigint, seq_id string, seq_length bigint, max_bp bigint")
    got = {(r.build_id, r.seq_id): r.file_no for r in next_fit.next_fit(rows).collect()}
    assert got == {(1, "s0"): 1, (1, "s1"): 1, (1, "s2"): 2, (1, "s3"): 1, (1, "s4"): 3, (2, "x"): 1}


def _plain_next_fit(rows):
    """file numbers by the definition, a build at a time"""
    out = {}
    for build in {r[0] for r in rows}:
        files, now, used = 0, 0, 0
        for _, no, seq, size, limit in sorted((r for r in rows if r[0] == build and r[3]), key=lambda r: (r[1], r[2])):
            if size > limit:
                files += 1
                out[build, seq] = files
                continue
            if not now or used + size > limit:
                files += 1
                now, used = files, 0
            used += size
            out[build, seq] = now
    return out


@pytest.mark.parametrize("most", [12, 900, 100_000])
def test_next_fit_over_tiles(spark, most):
    """Builds over several tiles, tiles without a beginning file, tiles of long records only, a null build."""
    draw = random.Random(most)
    rows = [(1, k, f"a{k}", draw.choice((1, 2, 3, 5, 8, 13, 50)), most) for k in range(400)]
    rows += [(2, k, f"b{k}", most + 1 if k < 60 or 100 < k < 160 else draw.randint(1, most), most) for k in range(200)]
    rows += [(None, k, f"c{k}", draw.randint(1, most), most) for k in range(5)] + [(3, 1, "d", None, most), (4, 1, "e", 1, most)]
    frame = spark.createDataFrame(rows, "build_id bigint, record_no bigint, seq_id string, seq_length bigint, max_bp bigint")
    want = _plain_next_fit(rows)
    for tiles in (1, 6):
        got = next_fit.next_fit(frame, tiles=tiles).collect()
        assert len(got) == len(want) and {(r.build_id, r.seq_id): r.file_no for r in got} == want
    assert next_fit.next_fit(frame.limit(0)).collect() == []


def test_seeds_match_plain_windows(spark):
    text = "".join(chr(97 + (k * k) % 7) for k in range(300))
    df = spark.createDataFrame([(1, text), (2, "abc"), (3, None), (4, "abcdefgh")], "seq_id bigint, seq string")
    for k, step in ((5, 1), (8, 3)):
        got = {(r.seq_id, r.pos, r.seed) for r in kmers.seeds(df, k, "seq_id", "seq", step).collect()}
        want = {(i, p, t[p : p + k]) for i, t in ((1, text), (4, "abcdefgh")) for p in range(0, len(t) - k + 1, step)}
        assert got == want


def test_frequent_seeds_are_hits(spark, tmp_path):
    """An item copied into 250 documents: every seed of it is over-represented."""
    item = "".join(chr(97 + (k * k + k // 7) % 23) for k in range(60))
    spark.createDataFrame([(k, f"{k:04d} {item} {k:04d}") for k in range(250)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "y" * 40)], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = sequence_queries.q47_all_seed_join(spark, str(tmp_path)).collect()
    assert {(r.q_id, r.t_id, r.n_hits, r.first_pos) for r in got} == {(k, 1, 29, 5) for k in range(250)}
    scored = sequence_queries.q49_all_scored_islands(spark, str(tmp_path)).collect()
    assert {(r.q_id, r.t_id, r.q_start, r.q_end, r.t_start, r.t_end, r.n_match, r.n_mismatch) for r in scored} == {(k, 1, 5, 65, 0, 60, 60, 0) for k in range(250)}
    seeds = lambda name, key: kmers.seeds(spark.read.parquet(f"{tmp_path}/{name}.parquet"), 32, key, "text")
    assert kmers.every_seed_hit(seeds("documents", "doc_id"), seeds("eval_items", "item_id"), block_seeds=10).count() == 250 * 29


def test_sketch_similarity(spark):
    df = spark.createDataFrame([("a", "ACGTACGTTGCA"), ("b", "ACGTACGTTGCA"), ("c", "TTTTTTTTTTTT")], "seq_id string, seq string")
    sketch = kmers.sketches(kmers.seeds(df, 4, "seq_id", "seq"), 100)
    got = kmers.sketch_similarity(sketch, sketch, 4, 95.0).where("q_id < t_id").collect()
    assert [(r.q_id, r.t_id, r.containment) for r in got] == [("a", "b", 1.0)]


def test_close_pairs_of_frequent_and_contained_sequences(spark):
    """All seeds of the group are over-represented; `long` contains one of them and is eight times as long."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = letters(400)
    group = {f"s{k}": base[:399] + "ACGT"[k % 4] for k in range(8)}
    rows = [*group.items(), ("long", letters(1400) + base + letters(1400)), ("other", letters(3000))]
    sequences = spark.createDataFrame([(i, k, s) for k, (i, s) in enumerate(rows)], "seq_id string, record_no bigint, seq string")
    species = spark.createDataFrame([(i, "Aaa bbb") for i, _ in rows], "seq_id string, species string")
    nodes = spark.createDataFrame([("'Aaa_bbb'", None, 0.0, 1)], "name string, parent string, dist_root double, order int")
    near = [*group, "long"]
    want = {(x, y) for x in near for y in near if x < y}
    for settings in ({"repeats": 3}, {"repeats": 3, "scale": 4, "short": 0}):
        built = pipeline.build_database(sequences, species, nodes, 10_000, **settings)
        got = {tuple(r)[:2] for r in built["close_pairs"].collect()}
        assert got == want and built["heavy_seeds"].count() > 0
    assert built["sketches"].where("seq_id = 'other'").count() < 1500


def test_score_islands(spark):
    q = spark.createDataFrame([(1, "xxACGTACGTAA")], "id bigint, s string")
    t = spark.createDataFrame([(2, "ACGAACGTAA")], "id bigint, s string")
    island = spark.createDataFrame([(1, 2, 2, 2, 12, 3)], "q_id bigint, t_id bigint, diagonal int, q_start int, q_end int, n_seeds bigint")
    (row,) = kmers.score_islands(island, q, t, ("id", "s"), ("id", "s")).collect()
    assert (row.t_start, row.t_end, row.n_match, row.n_mismatch) == (0, 10, 9, 1)


def test_align_both_strands(spark):
    rng = __import__("random").Random(8)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core, other = letters(60), letters(50)
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    changed = core[:30] + ("A" if core[30] != "A" else "C") + core[31:]
    q = spark.createDataFrame([("q", letters(20) + core + letters(15) + other), ("short", "ACG"), ("none", None)], "seq_id string, seq string")
    t = spark.createDataFrame([("t", letters(7) + changed + letters(9)), ("u", letters(5) + back(other))], "seq_id string, seq string")
    got = {(r.q_name, r.t_name, r.strand): r for r in kmers.align(q, t).collect()}
    plus, minus = got["q", "t", "+"], got["q", "u", "-"]
    assert len(got) == 2 and plus.q_start <= 20 and plus.q_end >= 80 and plus.n_mismatch >= 1 and plus.t_start - plus.q_start == 7 - 20 and plus.q_size == 145
    assert minus.q_start <= 95 and minus.q_end == 145 and minus.t_start == 5 and minus.n_match >= 50
    assert kmers.align(q.where("false"), t).count() == 0


def test_heavy_seeds_and_sketches(spark):
    rows = spark.createDataFrame([(1, "ab" * 300 + "cdefgh"), (2, "xyzuvw" * 3)], "id bigint, text string")
    table = kmers.seeds(rows, 4, "id", "text")
    assert kmers.number_of_seeds(rows, 4, "text") == table.count()
    want = {r.seed: r.n for r in kmers.seed_counts(table).collect() if r.n > 50}
    assert {r.seed: r.n for r in kmers.heavy_seeds(table, 50).collect()} == want and len(want) == 2
    whole = sorted(r.h for r in table.where("seq_id = 1").selectExpr("xxhash64(seed) AS h").distinct().collect())
    assert sorted(r.h for r in kmers.sketches(table, 3).where("seq_id = 1").collect()) == whole[:3]
    assert kmers.seeds_among(table, table.where("seq_id = 2")).where("seq_id = 1").count() == 0


def test_query_species(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",)], "seq_id string")
    listed = spark.createDataFrame([("a", "A x"), ("b", "NA")], "seq_id string, species string")
    detected = spark.createDataFrame([("a", "Z z"), ("b", "B y")], "seq_id string, species string")
    got = lambda *a, **k: {r.seq_id: r.q_species for r in reference.query_species(queries, *a, **k).collect()}
    assert got(listed, detected) == {"a": "A x", "b": "B y", "c": U} and got() == dict.fromkeys("abc", U) and got(single="S s")["c"] == "S s"


def test_missing_references(spark):
    hits = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "t_name string")
    index = spark.createDataFrame([("y", "S", 5, "L")], "seq_id string, species string, seq_length bigint, leaf_name string")
    assert [tuple(r) for r in reference.missing_references(hits, index).collect()] == [("x", 2)]
    assert {(r.t_name, r.ref_species, r.ref_length) for r in reference.with_reference(hits, index).collect()} == {("x", U, 0), ("y", "S", 5), (None, U, 0)}


@pytest.mark.parametrize("empty", [True])
def test_empty_tables(spark, empty):
    rows = island_rows(spark, []).limit(0)
    assert islands.merge_islands(rows, ["g"], ["q_start", "q_end", "t_name", "t_species"]).count() == 0
    assert regions.process(rows.select("g", "q_start", "q_end"), ["g"], 0, 0).count() == 0
