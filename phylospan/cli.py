"""Command line: python -m phylospan.cli run|refilter|build-database ...

run             hit lines (PSL) of a query, a reference database and settings -> tables and tab-separated files
refilter        a table of overlap pairs or of filtered hits -> regions and summary, with other thresholds
align           FASTA queries against FASTA references -> hit lines, both strands, without gaps
build-database  FASTA, species file and Newick tree -> index, sketches, close pairs, heavy seeds, file grouping
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from phylospan.config import as_header, merge_settings, parse_settings_file
from phylospan.operators import chunks, kmers, reference
from phylospan.plans import pipeline
from phylospan.session import ensure_checkpoint_dir, ship_package
from phylospan.sinks import tsv
from phylospan.sources import lines as src
from phylospan.sources import newick


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("phylospan").getOrCreate()
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def run(args: argparse.Namespace) -> None:
    given = {k: v for k, v in vars(args).items() if k not in ("command", "settings", "hits", "close_refs")}
    values = parse_settings_file("\n".join(r.value for r in _session().read.text(args.settings).collect())) if args.settings else {}
    settings = merge_settings(values, given)
    spark = _session()
    parsed = src.typed_hits(src.tolerant_hits(src.read_lines(spark, args.hits)))
    hits = parsed.withColumns({"chunk_idx": F.coalesce(src.chunk_index(F.col("file")), F.lit(0)), "run_id": F.lit(1).cast("bigint")})
    listed = src.species_rows(src.read_lines(spark, settings.species_file)) if settings.species_file else None
    named = reference.query_species(hits.select(F.col("q_name").alias("seq_id")).distinct(), listed, single=settings.species)
    hits = hits.join(named.withColumnRenamed("seq_id", "q_name"), "q_name")
    runs = spark.range(1).select(
        F.lit(1).cast("bigint").alias("run_id"), F.lit(settings.chunk).cast("bigint").alias("chunk_bp"), F.lit(settings.min_identity).alias("min_identity"),
        F.lit(settings.size_filter).alias("size_filter"), F.lit(settings.cluster_size).alias("cluster_size"),
    )
    database = pipeline.Reference(spark.read.parquet(settings.index_path), newick.newick_nodes(src.read_lines(spark, settings.tree)), spark.read.parquet(f"{settings.database}/close_pairs.parquet"))
    empty = spark.range(0).select(F.lit("").alias("q_id"), F.lit("").alias("t_id"), F.lit(0.0).alias("ani"))
    close = src.similarity_rows(src.read_lines(spark, args.close_refs)) if args.close_refs else empty
    close_refs = close.select(F.col("q_id").alias("q_name"), F.col("t_id").alias("t_name"))
    out = pipeline.run_query(spark, f"{settings.output}/stages", hits, runs, database, close_refs, as_header(settings) | {"hits": args.hits, "close_refs": args.close_refs})
    out |= {"hits": hits, "species": named}
    for name in ("hits", "species", "first_div", "pairs", "regions", "summary"):
        tsv.write_tsv(out[name].drop("region", "stretch"), f"{settings.output}/{name}", tsv.config_header(as_header(settings)))


def refilter(args: argparse.Namespace) -> None:
    spark = _session()
    settings = spark.range(1).select(F.lit(1).cast("bigint").alias("run_id"), F.lit(args.chunk).cast("bigint").alias("chunk_bp"), F.lit(args.size_filter).alias("least"), F.lit(args.cluster).alias("gap"))
    if args.tsv:
        pairs = src.named_table(spark, args.pairs, required=("chunk_idx", "q_name", "q_size", "q_start", "q_end", "q_species", "t_name", "t_start", "t_end", "divergence"))
        pairs = pairs.withColumns({c: F.col(c).try_cast("bigint") for c in ("chunk_idx", "q_size", "q_start", "q_end")})
    else:
        pairs = spark.read.parquet(args.pairs)
    out = pipeline.refilter(pairs.withColumn("run_id", F.lit(1).cast("bigint")), settings, spark.read.parquet(args.index))
    for name, df in out.items():
        tsv.write_tsv(df.drop("region"), f"{args.output}/{name}")


def build_database(args: argparse.Namespace) -> None:
    spark = _session()
    records = src.read_fasta(spark, args.fasta).withColumnRenamed("place", "record_no")
    species = src.species_rows(src.read_lines(spark, args.species), normalise=False)
    built = pipeline.build_database(records.select("seq_id", "record_no", "seq"), species, newick.newick_nodes(src.read_lines(spark, args.tree)), args.max_bp)
    for name, df in built.items():
        df.write.mode("overwrite").parquet(f"{args.output}/{'ref_index' if name == 'index' else name}.parquet")


def align(args: argparse.Namespace) -> None:
    """Native hits of two FASTA inputs on both strands, as lines of a hit table; the query may be cut into chunks first."""
    spark = _session()
    queries, references = (src.read_fasta(spark, p).select("seq_id", "seq") for p in (args.query, args.reference))
    hits = kmers.align(queries, references, least_score=args.min_score)
    zero, block = F.lit(0), lambda c: F.concat(c.cast("string"), F.lit(","))
    length = F.col("q_end") - F.col("q_start")
    line = F.concat_ws(
        "\t", "n_match", "n_mismatch", zero, zero, zero, zero, zero, zero, "strand", "q_name", "q_size", "q_start", "q_end", "t_name", "t_size", "t_start", "t_end",
        F.lit(1), block(length), block(F.when(F.col("strand") == "+", F.col("q_start")).otherwise(F.col("q_size") - F.col("q_end"))), block(F.col("t_start")),
    )
    hits.select(line.alias("line")).write.mode("overwrite").text(args.output)


def split_chunks(args: argparse.Namespace) -> None:
    spark = _session()
    records = src.read_fasta(spark, args.fasta)
    chunked = chunks.explode_chunks(records, args.chunk).select(F.concat_ws("_", F.lit("chunk"), F.col("chunk_idx").cast("string"), "seq_id").alias("seq_id"), F.lit("").alias("description"), F.col("chunk_seq").alias("seq"))
    tsv.fasta_lines(chunked).write.mode("overwrite").text(args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phylospan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("run")
    one.add_argument("hits")
    one.add_argument("--settings")
    one.add_argument("--close-refs")
    for name in ("query", "output", "database", "tree", "index", "species", "species-file", "chunk", "min-identity", "size-filter", "cluster-size"):
        one.add_argument(f"--{name}")
    two = commands.add_parser("refilter")
    for name in ("pairs", "index", "output"):
        two.add_argument(name)
    two.add_argument("--tsv", action="store_true", help="the pairs (or the first_div table) are tab-separated text with a header")
    two.add_argument("--size-filter", type=int, default=0)
    two.add_argument("--cluster", type=int, default=0)
    two.add_argument("--chunk", type=int, default=100_000)
    three = commands.add_parser("build-database")
    for name in ("fasta", "species", "tree", "output"):
        three.add_argument(name)
    three.add_argument("--max-bp", type=int, default=1_000_000_000)
    five = commands.add_parser("align")
    for name in ("query", "reference", "output"):
        five.add_argument(name)
    five.add_argument("--min-score", type=int, default=30)
    four = commands.add_parser("split-chunks")
    four.add_argument("fasta")
    four.add_argument("output")
    four.add_argument("--chunk", type=int, default=100_000)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    {"run": run, "refilter": refilter, "build-database": build_database, "split-chunks": split_chunks, "align": align}[args.command](args)


if __name__ == "__main__":
    main()
