"""The registered queries against their SQL on the smallest tables, the pipeline, and streams."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from phylospan.operators.malformed import parse_lines
from phylospan.plans import hit_queries, pair_queries, pipeline, problem_queries, sequence_queries
from phylospan.plans import views as v
from phylospan.session import table
from phylospan.streaming import hits as streaming

CORE = {name: (query, module.SQL.get(name)) for module in (problem_queries, hit_queries, pair_queries, sequence_queries) for name, query in module.QUERIES.items()}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    query, sql = CORE[name]
    df = query(spark, sf_dir)
    got = Counter(tuple(plain(x) for x in row) for row in df.collect())
    result = oracle.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert got == Counter(tuple(plain(row[k]) for k in at) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_run_query_resumes(spark, sf_dir, tmp_path):
    nodes = v.lineage_nodes(spark, sf_dir)
    ref = pipeline.Reference(table(spark, sf_dir, "ref_index"), nodes, v.close_pairs(spark, sf_dir))
    hits = v.hits(spark, sf_dir).drop("divergence", "ani_lt_95")
    run = lambda: pipeline.run_query(spark, str(tmp_path), hits, table(spark, sf_dir, "run_log"), ref, v.close_refs(spark, sf_dir), {"data": sf_dir}, max_depth=4)
    out = run()
    counts = {k: df.count() for k, df in out.items()}
    assert counts["first_div"] > counts["pairs"] > 0 and counts["regions"] == counts["summary"]
    before = sorted(os.listdir(tmp_path))
    assert {k: df.count() for k, df in run().items()} == counts and sorted(os.listdir(tmp_path)) == before


def test_build_database(spark):
    seqs = [("a", 1, "ACGTTGCAAGGCTTAACCGT" * 6), ("b", 2, "ACGTTGCAAGGCTTAACCGT" * 6), ("c", 3, "TTGACCATGCATTTGGGCCA" * 3)]
    species = spark.createDataFrame([("a", "Aaa bbb"), ("b", "NA")], "seq_id string, species string")
    nodes = spark.createDataFrame([("'Aaa_bbb'", 1)], "name string, order int")
    built = pipeline.build_database(spark.createDataFrame(seqs, "seq_id string, record_no bigint, seq string"), species, nodes, 200, k=11)
    assert {(r.seq_id, r.file_no) for r in built["files"].collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert {(r.seq_id, r.species, r.leaf_name) for r in built["index"].collect()} == {("a", "Aaa bbb", "'Aaa_bbb'"), ("b", "unclassified", "NA"), ("c", "unclassified", "NA")}
    assert [(r.id_lo, r.id_hi) for r in built["close_pairs"].collect()] == [("a", "b")]


def test_stream_split(spark, sf_dir, tmp_path):
    lines = table(spark, sf_dir, "raw_psl_lines")
    folder = str(tmp_path / "in")
    lines.repartition(3).write.parquet(folder)
    stream = streaming.read_line_stream(spark, folder, lines.schema, max_files=1)
    streaming.start_split(stream, str(tmp_path / "hits"), str(tmp_path / "rejects"), str(tmp_path / "state")).awaitTermination(120)
    want = parse_lines(lines)
    assert spark.read.parquet(str(tmp_path / "hits")).count() == want.where("reason is null").count()
    assert {(r.line_id, r.reason) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()} == {(r.line_id, r.reason) for r in want.where("reason is not null").collect()}


def test_stream_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type")
    folder = str(tmp_path / "events")
    events.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    for name, counted in (("windows", streaming.windowed_counts(stream, "ts", "event_type", late="400 days")), ("sessions", streaming.session_counts(stream, "ts", "event_type", late="400 days"))):
        query = counted.writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "complete").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert spark.table(name).selectExpr("sum(n)").first()[0] == events.count()
