import pytest

from phylospan.config import merge_settings, parse_settings_file
from phylospan.operators import lineage
from phylospan.plans.stages import stage, stage_path
from phylospan.sinks import tsv
from phylospan.sources import lines as src
from phylospan.sources import newick


def as_lines(spark, texts, file="f"):
    return spark.createDataFrame([(t, k, file) for k, t in enumerate(texts)], "line string, line_no bigint, file string")


def test_fasta_roundtrip(spark, tmp_path):
    text = ["junk", ">a first one", "ACGT", "AC GT", ">b", ">c x", "TTTT", ""]
    records = src.fasta_records(as_lines(spark, text))
    got = {r.seq_id: (r.description, r.seq, r.length) for r in records.collect()}
    assert got == {"a": ("a first one", "ACGTACGT", 8), "b": ("b", "", 0), "c": ("c x", "TTTT", 4)}
    assert src.count_fasta(as_lines(spark, text)).first().n_records == 3
    path = str(tmp_path / "f.fasta")
    tsv.fasta_lines(records, 3).coalesce(1).write.text(path)
    back = src.fasta_records(src.read_lines(spark, path))
    assert {r.seq_id: (r.description, r.seq) for r in back.collect()} == {k: v[:2] for k, v in got.items()}


def test_species_lines(spark):
    text = ["s1\tNA", "s2", "# x", "", None, "s3\t Foo ", "s4\tA", "s4\tB", "s5\t"]
    assert {r.seq_id: r.species for r in src.species_rows(as_lines(spark, text)).collect()} == {"s1": "unclassified", "s2": "unclassified", "s3": "Foo", "s4": "B", "s5": "unclassified"}
    assert {r.seq_id for r in src.species_rows(as_lines(spark, text), normalise=False).collect()} == {"s1", "s3", "s4"}


def test_similarity_tables(spark):
    text = ["h\th\tANI\th\th\tRef\tQuery", "x\tx\t96.5\tx\tx\tr1 more\tq1 more", "x\tx\t94\tx\tx\tr2\tq2", "short", "x\tx\t95\tx\tx\tr3\tq3"]
    assert {tuple(r) for r in src.similarity_rows(as_lines(spark, text)).collect()} == {("q1", "r1", 96.5), ("q3", "r3", 95.0)}
    assert src.edge_rows(as_lines(spark, text)).count() == 3


def test_classifier_outputs(spark):
    text = ["C\ta\tFoo bar (taxid 9)\t1", "U\tb\tunclassified (taxid 0)", "C\ta\tFoo bar (taxid 9)\t2", "bad"]
    assert {tuple(r) for r in src.taxon_rows(as_lines(spark, text)).collect()} == {("a", "Foo bar"), ("b", "unclassified")}
    report = as_lines(spark, ["100 1 1 R 1 root", "  50.0 5 5 S 77   Foo bar baz"]).unionByName(as_lines(spark, ["1 2 3"], "g"))
    assert {tuple(r) for r in src.report_labels(report).collect()} == {("f", "Foo_bar_baz"), ("g", "unclassified")}


def test_tolerant_and_tsv(spark):
    good = "\t".join(["7"] + ["0"] * 7 + ["+", "q", "90", "1", "8", "t", "99", "2", "9", "1", "7,", "1,", "2,"])
    parsed = src.typed_hits(src.tolerant_hits(as_lines(spark, [good, "#" + good, good + "\tx", "match" + good[1:], None, ""])))
    (row,) = parsed.collect()
    assert row.q_name == "q" and row.block_sizes == [7] and row.q_end == 8
    rows = src.tsv_rows(as_lines(spark, ["#h\tx", "1\ta", "x\tb", "2", "3\tc\tmore"]), ["n", "v"], numeric="n")
    assert {(r.n, r.v) for r in rows.collect()} == {("1", "a"), ("3", "c")}
    files = spark.createDataFrame([("/x/chunk_12_a.tsv",), ("/x/other.tsv",)], "f string")
    assert [r[0] for r in files.select(src.chunk_index(files.f)).collect()] == [12, None]


def test_newick(spark):
    tree = as_lines(spark, ["((a:1,'b c':2)g:3,(d:4,(e:1,f:1):2)h:1)r;"])
    nodes = {r.name: (r.parent, r.dist_root) for r in newick.newick_nodes(tree, max_depth=8).collect()}
    inner = nodes["e"][0]
    assert nodes.pop(inner) == ("h", 3.0)
    assert nodes == {"r": (None, 0.0), "g": ("r", 3.0), "a": ("g", 4.0), "'b c'": ("g", 5.0), "h": ("r", 1.0), "d": ("h", 5.0), "e": (inner, 4.0), "f": (inner, 4.0)}


def test_tsv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 1e7 + 0.5, True, [1, 2], "x"), (2, None, False, None, None), (3, 99.12345, None, [], "")], "a int, b double, c boolean, d array<int>, e string")
    path = str(tmp_path / "out")
    tsv.write_tsv(df, path, tsv.config_header({"query": "q.fa", "species": None}), single_file=True)
    text = [r.value for r in spark.read.text(path).collect()]
    assert text[:3] == ["# query: q.fa", "# species: ", "#a\tb\tc\td\te"]
    assert set(text[3:]) == {"1\t10000000.5\tTrue\t1,2,\tx", "2\tNA\tFalse\tNA\tNA", "3\t99.12345\tNA\t,\t"}
    back = src.tsv_rows(src.read_lines(spark, path), df.columns, numeric="a")
    assert back.count() == 3


def test_settings():
    values = parse_settings_file("query: q.fa\n# note\noutput: 'out'\ndatabase: db\ntree: t.nwk\nchunk: 500 # short\n")
    settings = merge_settings(values, {"chunk": None, "min_identity": "95"})
    assert (settings.chunk, settings.min_identity, settings.size_filter, settings.mode, settings.index_path) == (500, 95, 150, "auto", "db/ref_index.parquet")
    for bad in ({"nope": 1}, {"chunk": "x"}, {"chunk": -1}, {"species": "a", "species_file": "b"}):
        with pytest.raises(ValueError):
            merge_settings(values, bad)
    with pytest.raises(ValueError):
        merge_settings({}, {})


def test_stage_is_reused(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for parameters in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert stage(spark, str(tmp_path), "s", parameters, build).count() == 3
    assert len(calls) == 2 and stage_path("x", "s", {"a": 1}) != stage_path("x", "s", {"a": 2})


def test_tree_over_several_lines_and_forest(spark):
    """Lines in any order of rows, a label and its bracket on two lines, and two trees."""
    text = ["((a:1,b:2)g:3,", "(d:4,e:1)", "h:1)r;", "(x:1,y:2)z;"]
    lines = spark.createDataFrame([(t, (1 << 33) * (k // 2) + k, "f") for k, t in reversed(list(enumerate(text)))], "line string, line_no bigint, file string")
    nodes = {r.name: (r.parent, r.dist_root) for r in newick.newick_nodes(lines).collect()}
    assert nodes == {"r": (None, 0.0), "g": ("r", 3.0), "a": ("g", 4.0), "b": ("g", 5.0), "h": ("r", 1.0), "d": ("h", 5.0), "e": ("h", 2.0), "z": (None, 0.0), "x": ("z", 1.0), "y": ("z", 2.0)}


def test_read_fasta_and_lengths(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a first one\nACGT\nAC GT\n>b\n>c x\r\nTT\r\nTT\r\n" + ">" + "h" * 2_000_000 + " long\nA\n")
    (tmp_path / "b.fa").write_text("\n>d\nGG")
    rows = {r.seq_id: r for r in src.read_fasta(spark, str(tmp_path)).collect()}
    assert {k: (r.description, r.seq, r.length) for k, r in rows.items() if len(k) < 9} == {"a": ("a first one", "ACGTACGT", 8), "b": ("b", "", 0), "c": ("c x", "TTTT", 4), "d": ("d", "GG", 2)}
    assert sorted(map(len, rows)) == [1, 1, 1, 1, 2_000_000] and rows["a"].place < rows["b"].place < rows["c"].place
    lengths = src.length_rows(as_lines(spark, ["a\t12", "b\tx", "c", None, " d \t 7 "]))
    assert {tuple(r) for r in lengths.collect()} == {("a", 12), ("d", 7)}
    named = as_lines(spark, ["Ref_name\tQuery_name\tANI", "r1 x\tq1 y\t99", "r2\tq2\t90"])
    assert {tuple(r) for r in src.similarity_rows(named).collect()} == {("q1", "r1", 99.0)}


def test_checkpoint_folder_is_needed_on_a_cluster(monkeypatch, spark):
    from types import SimpleNamespace

    from phylospan.session import ensure_checkpoint_dir

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://x:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(cluster)


def test_tree_deeper_than_expected(spark):
    """A ladder of 1,000 levels, each a branch of 1 with a leaf of 1."""
    text = "'l0':1"
    for k in range(1, 1001):
        text = f"({text},'l{k}':1)n{k}:1"
    nodes = newick.newick_nodes(as_lines(spark, [f"{text.removesuffix(':1')};"]))
    dist = {r.name: r.dist_root for r in nodes.collect()}
    assert (dist["'l0'"], dist["'l1'"], dist["'l1000'"], dist["n1"], dist["n1000"]) == (1000.0, 1000.0, 1.0, 999.0, 0.0)
    paths = lineage.ancestor_paths(nodes)
    assert {r.n for r in paths.where("name = \"'l0'\"").selectExpr("size(path) AS n").collect()} == {1001}
    pairs = spark.createDataFrame([("'l0'", "'l1000'"), ("'l0'", "'l1'"), ("'l0'", "'l100'")], "x string, y string")
    got = {r.y: r.divergence for r in lineage.pair_divergence(pairs, paths, "x", "y").collect()}
    assert got == {"'l1000'": 500.5, "'l1'": 1.0, "'l100'": 50.5}
    circle = spark.createDataFrame([("a", "b", 0.0), ("b", "a", 0.0)], "name string, parent string, dist_root double")
    with pytest.raises(ValueError):
        lineage.ancestor_paths(circle, 4)
