"""Next-fit grouping of sequences into files, in record order, by tiles.

Range partitions in record order are the tiles; a build may lie in several. Where a file begins, the next file's first
record follows from prefix sums, so each tile knows for every record with which a file could be the first to begin in
it how many files follow and where the last of them begins. These few entries point to entries of later tiles; pointer
jumping finds those that the build's first record leads to, at most one a tile. With them each tile numbers its records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phylospan.session import materialise

GROUP = ["_key", "_tile"]


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Sorted rows in frames that end with a (_key, _tile), and the bounds of each of them."""

    def bounded(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
        rows = pd.concat(parts, ignore_index=True)
        key, tile = rows["_key"].to_numpy(), rows["_tile"].to_numpy()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1), len(rows)]
        return rows, list(zip(edges[:-1], edges[1:]))

    held: list[pd.DataFrame] = []
    group = None
    for batch in batches:
        if not len(batch):
            continue
        last = (batch["_key"].iloc[-1], batch["_tile"].iloc[-1])
        cut = len(batch) - int(((batch["_key"] == last[0]) & (batch["_tile"] == last[1])).sum())
        if held and (cut or group != last):
            yield bounded([*held, batch.iloc[:cut]])
            held = []
        elif cut:
            yield bounded([batch.iloc[:cut]])
        held.append(batch.iloc[cut:])
        group = last
    if held:
        yield bounded(held)


def _following(length: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which records fit into a file at all, where each of these begins, and the place of the one that begins the next file."""
    small = np.flatnonzero(length <= limit)
    end = np.cumsum(length[small])
    begin = end - length[small]
    return small, begin, np.searchsorted(end, begin + limit, side="right")


def _entries(length: str, limit: str, columns: list[str]):
    """Each record with begin, its place in the tile (null if it fits into no file), and for a possible entry with files and the last one's last_begin, last_long."""
    added = ["_begin", "_files", "_last_begin", "_last_long"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, groups in _whole_groups(batches):
            lengths, limits = rows[length].to_numpy(np.int64), rows[limit].to_numpy(np.int64)
            out = {c: np.full(len(rows), -1, np.int64) for c in added}
            for a, b in groups:
                small, begin, following = _following(lengths[a:b], limits[a])
                n = len(small)
                files, jump = np.append(np.ones(n, np.int64), 0), np.append(following, n)
                last = np.where(following < n, following, np.arange(n))
                while (jump[:n] < n).any():
                    files, jump, last = files + files[jump], jump[jump], last[last]
                out["_begin"][a + small] = begin
                entry = begin <= limits[a]
                at = a + small[entry]
                out["_files"][at], out["_last_begin"][at], out["_last_long"][at] = files[:n][entry], begin[last[entry]], (small - np.arange(n))[last[entry]]
            yield rows.assign(**{c: pd.Series(x).astype("Int64").mask(x < 0) for c, x in out.items()})[[*columns, *added]]

    return run


def _links(bounds, limit: str):
    """Entries with places counted from the build's first record, and the tile in which the next file begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = bounds.value
        for batch in batches:
            for key, rows in batch.groupby("_key", sort=False):
                tiles = known[key]
                at = np.searchsorted(tiles["tile"], rows["_tile"].to_numpy())
                before, n_long = tiles["begin"][at], tiles["n_long"][at]
                target = before + rows["_last_begin"].to_numpy() + rows[limit].to_numpy()
                to = np.searchsorted(tiles["end"], target, side="right")
                begin = before + rows["_begin"].to_numpy()
                yield pd.DataFrame({
                    "_key": key, "_tile": rows["_tile"], "begin": begin, "end": begin + rows["_length"].to_numpy(), "files": rows["_files"],
                    "open_long": n_long + rows["_last_long"].to_numpy(), "target": target, "to_tile": np.append(tiles["tile"], -1)[to],
                })

    return run


def _path(entries: DataFrame, tiles: int) -> DataFrame:
    """(_key, begin, before): the entries that each build's first record leads to, and the files begun before them."""
    ends = entries.select("_key", "_tile", F.col("end").alias("at"), F.lit(1).alias("kind"), "begin")
    targets = entries.where("to_tile >= 0").select("_key", F.col("to_tile").alias("_tile"), F.col("target").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("begin")).distinct()
    # A file begins with the first record that ends after the target.
    later = Window.partitionBy(*GROUP).orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    landing = ends.unionByName(targets).withColumn("to", F.min("begin").over(later)).where("kind = 0").select("_key", F.col("at").alias("target"), "to")
    links = materialise(entries.join(landing, ["_key", "target"]).select("_key", "begin", "to", "files"))
    path = entries.where("begin = 0").select("_key", "begin", F.lit(0).cast("bigint").alias("before"))
    for more in range(math.ceil(math.log2(tiles)), 0, -1):
        path = materialise(path.unionByName(path.join(links, ["_key", "begin"]).select("_key", F.col("to").alias("begin"), (F.col("before") + F.col("files")).alias("before"))))
        if more > 1:
            second = links.select("_key", F.col("begin").alias("to"), F.col("to").alias("_to"), F.col("files").alias("_files"))
            links = materialise(links.join(second, ["_key", "to"]).select("_key", "begin", F.col("_to").alias("to"), (F.col("files") + F.col("_files")).alias("files")))
    return path


def _numbered(bounds, paths, length: str, limit: str, columns: list[str]):
    """Each record with its file's number, from the tile's entry and the file that is open before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, groups in _whole_groups(batches):
            lengths, limits = rows[length].to_numpy(np.int64), rows[limit].to_numpy(np.int64)
            keys, tiles = rows["_key"].to_numpy(), rows["_tile"].to_numpy()
            number = np.empty(len(rows), np.int64)
            for a, b in groups:
                small, begin, following = _following(lengths[a:b], limits[a])
                place, before, n_long, is_open = 0, 0, 0, 0
                if keys[a] in bounds.value:
                    known, path = bounds.value[keys[a]], paths.value[keys[a]]
                    at = np.searchsorted(known["tile"], tiles[a])
                    n_long = known["n_long"][at]
                    k = np.searchsorted(path["tile"], tiles[a])
                    if k:
                        before, is_open = path["after"][k - 1], path["open"][k - 1]
                    entered = k < len(path["tile"]) and path["tile"][k] == tiles[a]
                    place = int(np.searchsorted(begin, path["begin"][k] - known["begin"][at])) if entered else len(small)
                starts = np.zeros(b - a, np.int64)
                while place < len(small):
                    starts[small[place]] = 1
                    place = following[place]
                begun = before + np.cumsum(starts)
                longer = np.cumsum(lengths[a:b] > limits[a]) + n_long
                opened = np.maximum.accumulate(np.where(starts == 1, begun + longer, is_open))
                number[a:b] = np.where(lengths[a:b] > limits[a], begun + longer, opened)
            yield rows[columns].assign(file_no=number)

    return run


def next_fit(records: DataFrame, build: str = "build_id", order: str = "record_no", seq_id: str = "seq_id", length: str = "seq_length", limit: str = "max_bp", tiles: int | None = None) -> DataFrame:
    """(build_id, record_no, seq_id, seq_length, file_no): each record in the open file, or in a new one when it doesn't fit.

    A record longer than the limit, which is one a build, gets a file of its own and leaves the open file open. Numbers
    start at 1 in order of opening. Records without a length or limit above 0 are left out; a null build is a build;
    repeated records count each. `tiles` is the number of range partitions (by default the session's); a task holds one
    at a time. To the driver come sums and entries of builds that lie in several tiles: at most two rows a tile.
    """
    spark = records.sparkSession
    columns = [build, order, seq_id, length]
    rows = records.select(*columns, limit).where(f"{length} > 0 and {limit} > 0").withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(build).cast("string")), F.lit("")))
    types = dict(rows.dtypes)
    ddl = lambda names: ", ".join(f"`{c}` {types[c]}" for c in names)
    along = ["_key", order, seq_id]
    ranged = rows.repartitionByRange(tiles, *along) if tiles else rows.repartitionByRange(*along)
    ranged = ranged.sortWithinPartitions(*along, length).withColumn("_tile", F.spark_partition_id())
    kept = [*columns, limit, *GROUP]
    types["_tile"] = "int"
    laid = materialise(ranged.mapInPandas(_entries(length, limit, kept), ddl(kept) + ", _begin bigint, _files bigint, _last_begin bigint, _last_long bigint"))

    fits = F.col(length) <= F.col(limit)
    sums = laid.groupBy(*GROUP).agg(F.sum(F.when(fits, F.col(length)).otherwise(0)).alias("bp"), F.sum(F.when(fits, 0).otherwise(1)).alias("n_long"))
    # Builds in several tiles: at most two rows a tile.
    split = sums.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_tile", "bp", "n_long"))).alias("tiles")).where(F.size("tiles") > 1).collect()
    bounds, paths = {}, {}
    for row in split:
        tile, bp, n_long = (np.array([t[k] for t in row["tiles"]], np.int64) for k in range(3))
        bounds[row["_key"]] = {"tile": tile, "begin": np.cumsum(bp) - bp, "end": np.cumsum(bp), "n_long": np.cumsum(n_long) - n_long}
    shared = spark.sparkContext.broadcast(bounds)
    if bounds:
        several = sums.groupBy("_key").count().where("count > 1").select("_key")
        entries = laid.where("_files is not null").select(*GROUP, "_begin", "_files", "_last_begin", "_last_long", F.col(length).cast("bigint").alias("_length"), limit).join(several, "_key")
        linked = materialise(entries.mapInPandas(_links(shared, limit), "_key string, _tile int, begin bigint, end bigint, files bigint, open_long bigint, target bigint, to_tile int"))
        path = _path(linked, max(len(b["tile"]) for b in bounds.values()))
        steps = path.join(linked, ["_key", "begin"]).select("_key", "_tile", "begin", (F.col("before") + F.col("files")).alias("after"), "open_long")
        found = steps.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_tile", "begin", "after", "open_long"))).alias("steps")).collect()
        none = np.empty(0, np.int64)
        paths = {key: {"tile": none, "begin": none, "after": none, "open": none} for key in bounds}
        for row in found:
            tile, begin, after, n_long = (np.array([s[k] for s in row["steps"]], np.int64) for k in range(4))
            paths[row["_key"]] = {"tile": tile, "begin": begin, "after": after, "open": after + n_long}
    placed = laid.select(*kept).repartition(*GROUP).sortWithinPartitions(*GROUP, order, seq_id, length)
    number = _numbered(shared, spark.sparkContext.broadcast(paths), length, limit, columns)
    return placed.mapInPandas(number, ddl(columns) + ", file_no bigint")
