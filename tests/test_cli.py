from phylospan import cli
from phylospan.sources import lines as src

A = "ACGTTGCAAGGCTTAACCGTTGACCATGCATTTGGGCCATTAGC" * 4


def psl(q, start, end, t, length):
    return "\t".join(map(str, [end - start, 0, 0, 0, 0, 0, 0, 0, "+", q, 1000, start, end, t, length, 0, end - start, 1, f"{end - start},", f"{start},", "0,"]))


def test_build_run_refilter(spark, tmp_path):
    (tmp_path / "db.fa").write_text(f">r1\n{A * 6}\n>r2 x\n{A[::-1] * 6}\n>r3\n{A * 6}\n")
    (tmp_path / "species.tsv").write_text("r1\tAaa bbb\nr2\tCcc ddd\nr3\tEee fff\n")
    (tmp_path / "tree.nwk").write_text("(('Aaa_bbb':5,'Eee_fff':5):5,('Ccc_ddd':9,'Qqq_rrr':9):1);")
    cli.main(["build-database", str(tmp_path / "db.fa"), str(tmp_path / "species.tsv"), str(tmp_path / "tree.nwk"), str(tmp_path / "db")])
    index = {r.seq_id: r.leaf_name for r in spark.read.parquet(str(tmp_path / "db/ref_index.parquet")).collect()}
    assert index == {"r1": "'Aaa_bbb'", "r2": "'Ccc_ddd'", "r3": "'Eee_fff'"}
    hits = tmp_path / "hits"
    hits.mkdir()
    head = "psLayout version 3\n\nmatch\tx\n\n----\n"
    (hits / "chunk_0_q1.psl").write_text(head + "\n".join([psl("q1", 100, 400, "r1", 1056), psl("q1", 150, 420, "r2", 1056), psl("q1", 600, 650, "r3", 1056)]) + "\n")
    (hits / "chunk_2_q1.psl").write_text(head + "\n".join([psl("q1", 10, 300, "r1", 1056), psl("q1", 10, 320, "r2", 1056)]) + "\n")
    out = tmp_path / "out"
    cli.main(["run", str(hits), "--query", "q", "--output", str(out), "--database", str(tmp_path / "db"), "--tree", str(tmp_path / "tree.nwk"), "--species", "Qqq rrr", "--chunk", "1000"])
    rows = [r.value.split("\t") for r in spark.read.text(str(out / "summary")).collect() if not r.value.startswith("#")]
    header = next(r.value for r in spark.read.text(str(out / "summary")).collect() if r.value.startswith("#run_id")).lstrip("#").split("\t")
    got = {(d["q_name"], d["q_start"], d["q_end"], d["n_species"]) for d in (dict(zip(header, r)) for r in rows)}
    assert got == {("q1", "150", "400", "2"), ("q1", "2010", "2300", "2")}
    pairs = next((out / "stages").glob("pairs-*"))
    cli.main(["refilter", str(pairs), str(tmp_path / "db/ref_index.parquet"), str(tmp_path / "again"), "--size-filter", "260", "--chunk", "1000"])
    assert len([r for r in spark.read.text(str(tmp_path / "again/summary")).collect() if not r.value.startswith("#")]) == 1


    first = {tuple(r) for r in spark.read.parquet(str(next((out / "stages").glob("first_div-*")))).select("q_name", "t_name").collect()}
    table = [r.value for r in spark.read.text(str(out / "first_div")).collect() if not r.value.startswith("#")]
    assert len(table) == 5 and {t for _, t in first} == {"r1", "r2", "r3"} and len(spark.read.text(str(out / "species")).where("not startswith(value, '#')").collect()) == 1
    for name, extra in (("pairs", ["--size-filter", "260"]), ("first_div", [])):
        cli.main(["refilter", str(out / name), str(tmp_path / "db/ref_index.parquet"), str(tmp_path / f"tsv_{name}"), "--tsv", "--chunk", "1000", *extra])
        lines = [r.value for r in spark.read.text(str(tmp_path / f"tsv_{name}/regions")).collect()]
        head = next(x for x in lines if x.startswith("#run_id")).lstrip("#").split("\t")
        rows = [dict(zip(head, x.split("\t"))) for x in lines if not x.startswith("#")]
        assert {(r["q_name"], r["q_species"], r["q_size"]) for r in rows} == {("q1", "Qqq rrr", "1000")} and len(rows) == (1 if extra else 2)


def test_align_then_run_lines(spark, tmp_path):
    (tmp_path / "q.fa").write_text(f">q\n{A}\n")
    (tmp_path / "r.fa").write_text(f">r\nGG{A[20:120]}\n")
    cli.main(["align", str(tmp_path / "q.fa"), str(tmp_path / "r.fa"), str(tmp_path / "hits"), "--min-score", "90"])
    rows = src.typed_hits(src.tolerant_hits(src.read_lines(spark, str(tmp_path / "hits")))).collect()
    assert rows and all(r.q_name == "q" and r.t_size == 102 and r.block_sizes == [r.q_end - r.q_start] for r in rows)
    assert any(r.strand == "+" and r.n_match >= 100 and r.q_start - r.t_start == 18 for r in rows)


def test_split_chunks(spark, tmp_path):
    (tmp_path / "q.fa").write_text(">'q1' some\n" + "A" * 250 + "\n")
    cli.main(["split-chunks", str(tmp_path / "q.fa"), str(tmp_path / "chunks"), "--chunk", "100"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "chunks")).collect()]
    assert sorted(x for x in lines if x.startswith(">")) == [">chunk_0_q1", ">chunk_1_q1", ">chunk_2_q1"] and sum(len(x) for x in lines if x[0] != ">") == 250
