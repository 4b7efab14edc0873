"""Queries of chunks, seeds, line formats, packing in order, sets and sessions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phylospan.functions.text import clean_id
from phylospan.operators import chunks, close_pairs, islands, kmers, lineage, next_fit, regions
from phylospan.plans import views as v
from phylospan.session import ensure_checkpoint_dir, materialise, table
from phylospan.sinks import tsv
from phylospan.sources import lines as src

Query = Callable[[SparkSession, str], DataFrame]

CHUNK, SEED, HEAVY, VOTE, LEAST_SEEDS = 500, 32, 200, 6, 16


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def q23_chunk_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.explode_chunks(_documents(spark, sf_dir), CHUNK, "doc_id", "text")


def q24_chunk_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "run_log").select("run_id", "chunk_bp")
    rows = table(spark, sf_dir, "overlap_div").select("pair_id", "run_id", "chunk_idx", "q_start", "q_end").join(runs, "run_id")
    return chunks.restore_offsets(rows, "chunk_bp", default=0).select("pair_id", "q_start", "q_end")


def _seeds(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return kmers.seeds(_documents(spark, sf_dir), k, "doc_id", "text")


def _item_seeds(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return kmers.seeds(table(spark, sf_dir, "eval_items"), k, "item_id", "text")


def q25_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct seeds occur how often."""
    return kmers.seed_counts(_seeds(spark, sf_dir, SEED)).groupBy("n").agg(F.count(F.lit(1)).alias("n_seeds"))


def q26_heavy_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.heavy_seeds(_seeds(spark, sf_dir, SEED), HEAVY, kmers.number_of_seeds(_documents(spark, sf_dir), SEED, "text"))


def _item_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _item_seeds(spark, sf_dir, SEED)
    documents = _seeds(spark, sf_dir, SEED)
    # Only seeds that occur in an item can be joined, so only these are counted.
    relevant = materialise(kmers.seeds_among(documents, items))
    return kmers.seed_hits(relevant, items, kmers.seed_counts(relevant).where(F.col("n") > HEAVY))


def q27_seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_hits(spark, sf_dir).groupBy("q_id", "t_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("q_pos").alias("first_pos"))


def q28_seed_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.diagonal_islands(_item_hits(spark, sf_dir), SEED, 8, LEAST_SEEDS)


def _scored(spark: SparkSession, sf_dir: str, islands_: DataFrame) -> DataFrame:
    scored = kmers.score_islands(islands_, _documents(spark, sf_dir), table(spark, sf_dir, "eval_items"), ("doc_id", "text"), ("item_id", "text"))
    return scored.select("q_id", "t_id", "q_start", "q_end", "t_start", "t_end", "n_match", "n_mismatch")


def q46_scored_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungapped hits of items in documents, with their matching letters."""
    return _scored(spark, sf_dir, q28_seed_islands(spark, sf_dir))


def _all_item_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.every_seed_hit(_seeds(spark, sf_dir, SEED), _item_seeds(spark, sf_dir, SEED))


def q47_all_seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q27 with every seed, the over-represented ones too."""
    return _all_item_hits(spark, sf_dir).groupBy("q_id", "t_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("q_pos").alias("first_pos"))


def q48_all_seed_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q28 with every seed."""
    return kmers.diagonal_islands(_all_item_hits(spark, sf_dir), SEED, 8, LEAST_SEEDS)


def q49_all_scored_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q46 with every seed."""
    return _scored(spark, sf_dir, q48_all_seed_islands(spark, sf_dir))


def q30_containment_ani(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against documents with whole sketches (all hashes), which are exact k-mer sets."""
    whole = 1 << 30
    items = kmers.sketches(_item_seeds(spark, sf_dir, SEED), whole)
    documents = _seeds(spark, sf_dir, SEED).withColumn("h", F.xxhash64("seed")).join(items.select("h").distinct(), "h", "left_semi").select("seq_id", "h").distinct()
    return kmers.sketch_similarity(items, documents, SEED, 95.0).select("q_id", "t_id", "shared", F.round("ani", 4).alias("ani"))


def q50_close_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against documents with whole sketches: pairs of an identity of 95 or more, by the smaller one's seeds."""
    pairs = close_pairs.close_pairs(_documents(spark, sf_dir), "doc_id", "text", 95.0)
    return pairs.select("id1", "id2", F.round("ani", 4).alias("ani"))


def q31_kmer_vote_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by votes of the items' seeds."""
    items = table(spark, sf_dir, "eval_items")
    labelled = kmers.seeds(items, VOTE, "item_id", "text").join(items.select(F.col("item_id").alias("seq_id"), F.col("lang").alias("label")), "seq_id").select("seed", "label")
    return kmers.vote_labels(_seeds(spark, sf_dir, VOTE), labelled)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_psl_lines").select("line_id", "file_name", F.col("raw_line").alias("line"))


def q29_tolerant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = src.typed_hits(src.tolerant_hits(_lines(spark, sf_dir)))
    return parsed.select("line_id", src.chunk_index(F.col("file_name")).alias("chunk_idx"), "n_match", "strand", "q_name", "q_start", "q_end", "t_name", "block_count")


def q32_safe_cast_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four treatments of a start that is no number make of each tolerant line's file."""
    start = F.col("fields")[11].try_cast("bigint")
    rows = src.tolerant_hits(_lines(spark, sf_dir)).withColumn("start", start)
    return rows.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("start").alias("n_skip"), F.sum(F.coalesce("start", F.lit(0))).alias("sum_zero"),
        F.sum("start").alias("sum_null"), F.max(F.coalesce("start", F.lit(-1))).alias("max_minus"),
    )


def q33_species_file_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "first_div_output").where("t_name is not null")
    text = hits.select(F.concat_ws("\t", "t_name", "t_species").alias("line"), F.col("hit_id").alias("line_no"))
    return src.species_rows(text)


def q34_taxon_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "first_div_output").where("t_name is not null and t_species is not null")
    return src.taxon_rows(hits.select(F.concat_ws("\t", F.lit("C"), "t_name", F.concat("t_species", F.lit(" (taxid "), F.col("run_id").cast("string"), F.lit(")"))).alias("line")))


def q44_report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "first_div_output")
    report = hits.select(F.col("run_id").alias("file"), F.col("hit_id").alias("line_no"), F.concat(F.lit("  1.50\t10\t10\tS\t77\t    "), F.coalesce("t_species", F.lit(""))).alias("line"))
    return src.report_labels(report)


def q35_next_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "seq_lengths").where("seq_length > 0").groupBy("build_id", "record_no", "seq_id").agg(F.max("seq_length").alias("seq_length"))
    return next_fit.next_fit(records.join(table(spark, sf_dir, "db_builds").select("build_id", "max_bp"), "build_id"))


def q36_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name: table(spark, sf_dir, name).select("run_id", clean_id(F.col("q_name")).alias("q_name")).where("q_name is not null")
    return ids("first_div_output").unionByName(ids("overlap_div")).distinct()


def q37_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after each stage, a row a stage."""
    raw = table(spark, sf_dir, "first_div_output").agg(F.count(F.lit(1)).alias("n")).select(F.lit("raw").alias("stage"), "n")
    hits = v.hits(spark, sf_dir)
    usable = hits.agg(F.count(F.lit(1)).alias("n")).select(F.lit("usable").alias("stage"), "n")
    queries = hits.select("q_name").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("queries").alias("stage"), "n")
    pairs = table(spark, sf_dir, "overlap_div").agg(F.count(F.lit(1)).alias("n")).select(F.lit("pairs").alias("stage"), "n")
    return raw.unionByName(usable).unionByName(queries).unionByName(pairs)


def q51_deep_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth of each revision below its page's first one: a tree of hundreds of levels."""
    pages = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("name")).agg(F.max("parent_doc_id").alias("parent"))
    known = pages.select(F.col("name").alias("parent"), F.lit(True).alias("known"))
    edges = pages.join(known, "parent", "left").select("name", F.when(F.col("known"), F.col("parent")).alias("parent"))
    return lineage.root_distances(edges.withColumn("branch", F.when(F.col("parent").isNotNull(), 1.0).otherwise(0.0))).select("name", "parent", "depth", "dist_root")


def q52_fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as FASTA text to the shared folder and read back by records."""
    letters = F.regexp_replace("text", r"[\s>]+", "")
    records = _documents(spark, sf_dir).where("text is not null").select(F.col("doc_id").cast("string").alias("seq_id"), F.lit("of the corpus").alias("description"), letters.alias("seq"))
    path = f"{ensure_checkpoint_dir(spark)}/fasta-{uuid.uuid4().hex}"
    tsv.fasta_lines(records).write.text(path)
    back = src.read_fasta(spark, path)
    return back.select("seq_id", "description", F.col("length").cast("bigint").alias("length"), F.md5("seq").alias("digest"))


def q53_length_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "seq_lengths").select(F.concat_ws("\t", "seq_id", F.coalesce(F.col("seq_length").cast("string"), F.lit("NA"))).alias("line"))
    return src.length_rows(rows).groupBy("seq_id").agg(F.max("seq_length").alias("seq_length"), F.count(F.lit(1)).alias("n_rows"))


def q54_similarity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tables with named columns, one file a run, made of the pairs' identities."""
    hits = table(spark, sf_dir, "first_div_output").where("t_name is not null and q_name is not null and pct_identity is not null")
    body = hits.select(F.col("run_id").alias("file"), F.concat_ws("\t", F.concat("t_name", F.lit(" ref")), F.col("pct_identity").cast("decimal(20,3)").cast("string"), F.regexp_replace("q_name", r"\s", "")).alias("line"))
    heads = hits.select(F.col("run_id").alias("file")).distinct().withColumn("line", F.lit("Ref_name\tANI\tQuery_name"))
    return src.similarity_rows(body.unionByName(heads), 97.0).groupBy("q_id", "t_id").agg(F.count(F.lit(1)).alias("n_rows"))


def q38_event_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return islands.sessions(events, ["user_id"], "second", 1800).drop("session")


def q39_tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits rendered as text lines, kept in the shared folder, and read back."""
    columns = ["hit_id", "q_name", "q_start", "q_end", "t_name", "divergence", "ani_lt_95"]
    text = materialise(tsv.to_lines(v.hits(spark, sf_dir).select(*columns)))
    back = src.tsv_rows(text, columns, numeric="hit_id")
    return back.select(
        F.col("hit_id").cast("bigint"), "q_name", F.col("q_start").cast("bigint"), F.col("q_end").cast("bigint"), F.nullif("t_name", F.lit("NA")).alias("t_name"),
        F.col("divergence").try_cast("double").alias("divergence"), F.nullif("ani_lt_95", F.lit("NA")).alias("ani_lt_95"),
    )


def q45_build_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of raw hits (the first-stage table), merged and filtered with the standalone defaults of 0 and 0."""
    return regions.region_bounds(regions.process(v.hits(spark, sf_dir), ["run_id", "chunk_idx", "q_name"], 0, 0), ["run_id", "chunk_idx", "q_name"]).drop("region")


def _seed_sql(source: str, key: str, k: int) -> str:
    return f"SELECT {key} AS seq_id, p AS pos, substring(text, p::int + 1, {k}) AS seed FROM (SELECT {key}, text, unnest(range(0, length(text) - {k} + 1)) AS p FROM {source} WHERE length(text) >= {k})"


_ITEM_HITS = f"""
it AS ({_seed_sql('eval_items', 'item_id', SEED)}),
doc AS (SELECT * FROM ({_seed_sql('documents', 'doc_id', SEED)}) WHERE seed IN (SELECT seed FROM it)),
heavy AS (SELECT seed FROM doc GROUP BY 1 HAVING count(*) > {HEAVY}),
h AS (SELECT doc.seq_id AS q_id, it.seq_id AS t_id, doc.pos AS q_pos, it.pos AS t_pos FROM doc JOIN it ON doc.seed = it.seed WHERE doc.seed NOT IN (SELECT seed FROM heavy))"""

_ALL_ITEM_HITS = f"""
it AS ({_seed_sql('eval_items', 'item_id', SEED)}),
doc AS ({_seed_sql('documents', 'doc_id', SEED)}),
h AS (SELECT doc.seq_id AS q_id, it.seq_id AS t_id, doc.pos AS q_pos, it.pos AS t_pos FROM doc JOIN it ON doc.seed = it.seed)"""

_TOLERANT = r"""
t AS (SELECT line_id, file_name, string_split(regexp_replace(raw_line, '^\s+|\s+\z', '', 'g'), chr(9)) AS f FROM raw_psl_lines WHERE NOT starts_with(raw_line, '#')),
ok AS (SELECT * FROM t WHERE len(f) = 21 AND f[1] <> 'match')"""


def _int(field: str, kind: str = "bigint") -> str:
    return f"CASE WHEN regexp_full_match(trim({field}), '[+-]?[0-9]+') THEN try_cast(trim({field}) AS {kind}) END"


SQL: dict[str, str] = {
    "q23_chunk_explode": f"""SELECT doc_id::varchar AS seq_id, (o // {CHUNK})::int AS chunk_idx, o::int AS chunk_offset, substring(text, o::int + 1, {CHUNK}) AS chunk_seq
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), {CHUNK})) AS o FROM documents WHERE text IS NOT NULL)""",
    "q24_chunk_restore": """SELECT pair_id, coalesce(q_start, 0) + chunk_idx * chunk_bp AS q_start, coalesce(q_end, 0) + chunk_idx * chunk_bp AS q_end
FROM overlap_div o JOIN run_log r ON o.run_id = r.run_id""",
    "q25_kmer_counts": f"SELECT n, count(*) AS n_seeds FROM (SELECT count(*) AS n FROM ({_seed_sql('documents', 'doc_id', SEED)}) GROUP BY seed) GROUP BY n",
    "q26_heavy_kmers": f"SELECT seed, count(*) AS n FROM ({_seed_sql('documents', 'doc_id', SEED)}) GROUP BY seed HAVING count(*) > {HEAVY}",
    "q27_seed_join": f"WITH {_ITEM_HITS} SELECT q_id, t_id, count(*) AS n_hits, min(q_pos)::int AS first_pos FROM h GROUP BY 1, 2",
    "q28_seed_islands": f"""WITH {_ITEM_HITS},
d AS (SELECT DISTINCT q_id, t_id, q_pos - t_pos AS diagonal, q_pos AS s, q_pos + {SEED} AS e FROM h),
r AS (SELECT *, max(e) OVER (PARTITION BY q_id, t_id, diagonal ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY q_id, t_id, diagonal ORDER BY s) AS k FROM r)
SELECT q_id, t_id, diagonal::int AS diagonal, min(s)::int AS q_start, max(e)::int AS q_end, count(*) AS n_seeds FROM i GROUP BY q_id, t_id, diagonal, k HAVING count(*) >= 16""",
    "q46_scored_islands": f"""WITH {_ITEM_HITS},
d AS (SELECT DISTINCT q_id, t_id, q_pos - t_pos AS diagonal, q_pos AS s, q_pos + {SEED} AS e FROM h),
r AS (SELECT *, max(e) OVER (PARTITION BY q_id, t_id, diagonal ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY q_id, t_id, diagonal ORDER BY s) AS k FROM r),
j AS (SELECT q_id, t_id, diagonal, min(s) AS s, max(e) AS e FROM i GROUP BY q_id, t_id, diagonal, k HAVING count(*) >= 16),
x AS (SELECT j.*, substring(a.text, s::int + 1, (e - s)::int) AS qt, substring(b.text, (s - diagonal)::int + 1, (e - s)::int) AS tt FROM j JOIN documents a ON a.doc_id = q_id JOIN eval_items b ON b.item_id = t_id),
m AS (SELECT *, len([1 FOR p IN range(1, length(qt) + 1) IF substring(qt, p::int, 1) = substring(tt, p::int, 1)]) AS n FROM x)
SELECT q_id, t_id, s::int AS q_start, e::int AS q_end, (s - diagonal)::int AS t_start, (e - diagonal)::int AS t_end, n::int AS n_match, (e - s - n)::int AS n_mismatch FROM m""",
    "q29_tolerant_lines": f"""WITH {_TOLERANT} SELECT line_id, try_cast(nullif(regexp_extract(file_name, '^[^_]*_([0-9]+)', 1), '') AS int) AS chunk_idx, {_int('f[1]', 'int')} AS n_match, f[9] AS strand,
  f[10] AS q_name, {_int('f[12]')} AS q_start, {_int('f[13]')} AS q_end, f[14] AS t_name, {_int('f[18]', 'int')} AS block_count FROM ok""",
    "q30_containment_ani": f"""
WITH it AS (SELECT DISTINCT seq_id, seed FROM ({_seed_sql('eval_items', 'item_id', SEED)})),
doc AS (SELECT DISTINCT seq_id, seed FROM ({_seed_sql('documents', 'doc_id', SEED)}) WHERE seed IN (SELECT seed FROM it)),
size AS (SELECT seq_id, count(*) AS n FROM it GROUP BY 1),
s AS (SELECT it.seq_id AS q_id, doc.seq_id AS t_id, count(*) AS shared FROM it JOIN doc ON it.seed = doc.seed GROUP BY 1, 2)
SELECT q_id, t_id, shared, round(pow(shared::double / n, 1.0 / {SEED}) * 100, 4) AS ani FROM s JOIN size ON q_id = seq_id WHERE pow(shared::double / n, 1.0 / {SEED}) * 100 >= 95""",
    "q50_close_documents": f"""
WITH doc AS (SELECT DISTINCT seq_id, seed FROM ({_seed_sql('documents', 'doc_id', SEED)})),
size AS (SELECT seq_id, count(*) AS n FROM doc GROUP BY 1),
s AS (SELECT a.seq_id AS id1, b.seq_id AS id2, count(*) AS shared FROM doc a JOIN doc b ON a.seed = b.seed AND a.seq_id < b.seq_id GROUP BY 1, 2),
i AS (SELECT id1, id2, pow(shared::double / least(x.n, y.n), 1.0 / {SEED}) * 100 AS ani FROM s JOIN size x ON x.seq_id = id1 JOIN size y ON y.seq_id = id2)
SELECT id1, id2, round(ani, 4) AS ani FROM i WHERE ani >= 95""",
    "q31_kmer_vote_label": f"""
WITH it AS (SELECT DISTINCT seed, lang AS label FROM ({_seed_sql('eval_items', 'item_id', VOTE)}) JOIN eval_items ON seq_id = item_id),
sure AS (SELECT seed, min(label) AS label FROM it GROUP BY 1 HAVING count(*) = 1),
doc AS (SELECT DISTINCT seq_id, seed FROM ({_seed_sql('documents', 'doc_id', VOTE)})),
votes AS (SELECT seq_id, label, count(*) AS votes FROM doc JOIN sure ON doc.seed = sure.seed GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY votes DESC, label) AS k FROM votes)
SELECT seq_id, label, votes FROM ranked WHERE k = 1""",
    "q32_safe_cast_policies": f"""WITH {_TOLERANT}, s AS (SELECT file_name, {_int('f[12]')} AS start FROM ok)
SELECT file_name, count(*) AS n_rows, count(start) AS n_skip, sum(coalesce(start, 0))::bigint AS sum_zero, sum(start)::bigint AS sum_null, max(coalesce(start, -1)) AS max_minus FROM s GROUP BY 1""",
    "q33_species_file_normalise": f"""
WITH l AS (SELECT trim(t_name) AS seq_id, t_species AS s, hit_id FROM first_div_output WHERE t_name IS NOT NULL AND t_name <> '' AND NOT starts_with(trim(t_name), '#'))
SELECT seq_id, {v._LABEL.format('s')} AS species FROM (SELECT seq_id, coalesce(max_by(coalesce(s, ''), hit_id), '') AS s FROM l GROUP BY 1)""",
    "q34_taxon_name_parse": "SELECT DISTINCT t_name AS seq_id, trim(split_part(t_species || ' (taxid', '(', 1)) AS species FROM first_div_output WHERE t_name IS NOT NULL AND t_species IS NOT NULL",
    "q44_report_labels": r"""
SELECT run_id AS file, CASE WHEN s = '' THEN 'unclassified' ELSE array_to_string(regexp_split_to_array(s, '\s+'), '_') END AS species
FROM (SELECT run_id, trim(coalesce(max_by(coalesce(t_species, ''), hit_id), '')) AS s FROM first_div_output GROUP BY 1)""",
    "q35_next_fit_packing": """
WITH RECURSIVE rec AS (
  SELECT s.build_id, record_no, seq_id, max(seq_length) AS len, any_value(max_bp) AS most FROM seq_lengths s JOIN db_builds b ON s.build_id = b.build_id
  WHERE seq_length > 0 AND max_bp > 0 GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY build_id ORDER BY record_no, seq_id) AS k FROM rec),
f AS (
  SELECT build_id, k, 1::bigint AS file_no, 1::bigint AS files, CASE WHEN len > most THEN 0 ELSE 1 END::bigint AS open_file, CASE WHEN len > most THEN 0 ELSE len END::bigint AS used FROM n WHERE k = 1
  UNION ALL
  SELECT n.build_id, n.k,
    CASE WHEN len > most OR open_file = 0 OR used + len > most THEN files + 1 ELSE open_file END,
    CASE WHEN len > most OR open_file = 0 OR used + len > most THEN files + 1 ELSE files END,
    CASE WHEN len > most THEN open_file WHEN open_file = 0 OR used + len > most THEN files + 1 ELSE open_file END,
    CASE WHEN len > most THEN used WHEN open_file = 0 OR used + len > most THEN len ELSE used + len END
  FROM f JOIN n ON n.build_id = f.build_id AND n.k = f.k + 1)
SELECT n.build_id, record_no, seq_id, len AS seq_length, file_no FROM f JOIN n ON n.build_id = f.build_id AND n.k = f.k""",
    "q36_union_distinct": f"""SELECT run_id, q_name FROM (SELECT run_id, {v.CLEAN.format('q_name')} AS q_name FROM first_div_output
UNION SELECT run_id, {v.CLEAN.format('q_name')} FROM overlap_div) WHERE q_name IS NOT NULL""",
    "q37_stage_counts": f"""WITH {v.HITS_SQL} SELECT 'raw' AS stage, count(*) AS n FROM first_div_output UNION ALL SELECT 'usable', count(*) FROM hits
UNION ALL SELECT 'queries', count(DISTINCT q_name) FROM hits UNION ALL SELECT 'pairs', count(*) FROM overlap_div""",
    "q38_event_islands": """
WITH e AS (SELECT user_id, floor(epoch(ts))::bigint AS t FROM events),
l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM e),
s AS (SELECT *, sum(CASE WHEN t - b <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n_rows FROM s GROUP BY user_id, k""",
    "q51_deep_lineage": """
WITH RECURSIVE pages AS (SELECT doc_id AS name, max(parent_doc_id) AS p FROM documents GROUP BY 1),
e AS (SELECT a.name, b.name AS parent FROM pages a LEFT JOIN pages b ON a.p = b.name),
t AS (SELECT name, parent, 0::bigint AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.name, e.parent, t.depth + 1 FROM t JOIN e ON e.parent = t.name)
SELECT name, parent, depth, depth::double AS dist_root FROM t""",
    "q52_fasta_roundtrip": r"""
SELECT doc_id::varchar AS seq_id, doc_id::varchar || ' of the corpus' AS description, length(s)::bigint AS length, md5(s) AS digest
FROM (SELECT doc_id, regexp_replace(text, '[\s>]+', '', 'g') AS s FROM documents WHERE text IS NOT NULL)""",
    "q53_length_lines": "SELECT seq_id, max(seq_length) AS seq_length, count(*) AS n_rows FROM seq_lengths WHERE seq_length IS NOT NULL AND seq_id <> '' GROUP BY 1",
    "q54_similarity_lines": r"""
SELECT q_id, t_id, count(*) AS n_rows FROM (
  SELECT regexp_replace(q_name, '\s', '', 'g') AS q_id, t_name AS t_id, pct_identity FROM first_div_output WHERE t_name IS NOT NULL AND q_name IS NOT NULL AND pct_identity IS NOT NULL)
WHERE pct_identity::decimal(20,3) >= 97 AND q_id <> '' GROUP BY 1, 2""",
    "q39_tsv_roundtrip": f"WITH {v.HITS_SQL} SELECT hit_id, q_name, q_start, q_end, t_name, divergence, CASE WHEN ani_lt_95 THEN 'True' WHEN NOT ani_lt_95 THEN 'False' END AS ani_lt_95 FROM hits",
    "q45_build_regions": f"""WITH {v.HITS_SQL},
r AS (SELECT run_id, chunk_idx, q_name, q_start, q_end, max(q_end) OVER (PARTITION BY run_id, chunk_idx, q_name ORDER BY q_start, q_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM hits),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR q_start > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, chunk_idx, q_name ORDER BY q_start, q_end ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT run_id, chunk_idx, q_name, min(q_start) AS region_start, max(q_end) AS region_end, count(*) AS n_rows FROM i GROUP BY run_id, chunk_idx, q_name, k""",
}

SQL |= {
    new: SQL[old].replace(_ITEM_HITS, _ALL_ITEM_HITS)
    for old, new in (("q27_seed_join", "q47_all_seed_join"), ("q28_seed_islands", "q48_all_seed_islands"), ("q46_scored_islands", "q49_all_scored_islands"))
}

QUERIES: dict[str, Query] = {name: globals()[name] for name in SQL}
