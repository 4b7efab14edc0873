"""Continuous periods and gaps of overlapping intervals (problem 4).

A mergeable aggregate: each task folds its intervals into sorted disjoint lists, one a key and tile of the position
axis; only these lists are shuffled, and merged linearly in a balanced tree. Tiles bound what one task holds of a hot
key. An interval longer than a tile leaves its two ends in tiles and its middle, which is whole tiles, to the next
level, whose tiles are 2^18 times as wide; so one long interval changes nothing for the others. Every tile gives its
inner periods and gaps at once and one edge row; edge rows and middles alone are joined up along a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phylospan.functions.text import clean_id

TILE_BP = 1 << 18
LEVEL_BITS = 18
#: Tiles in which rows look for their period.
ASSIGN_BP = 1 << 14
FOLD_ROWS = 200_000
MERGE_LISTS = 256  # lists of one group and tile that a task holds before it merges them


def union_sorted(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The disjoint union of half-open intervals that are sorted by start; touching ones become one."""
    if len(start) == 0:
        return start, stop
    reach = np.maximum.accumulate(stop)
    first = np.concatenate(([True], start[1:] > reach[:-1]))
    begin = np.flatnonzero(first)
    return start[begin], reach[np.concatenate((begin[1:] - 1, [len(start) - 1]))]


def merge_lists(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union of two sorted disjoint lists, by one linear merge."""
    if not len(a[0]) or not len(b[0]):
        return b if not len(a[0]) else a
    into = np.searchsorted(a[0], b[0], side="right") + np.arange(len(b[0]))
    size = len(a[0]) + len(b[0])
    mask = np.ones(size, bool)
    mask[into] = False
    start, stop = np.empty(size, np.int64), np.empty(size, np.int64)
    start[into], stop[into] = b
    start[mask], stop[mask] = a
    return union_sorted(start, stop)


class IntervalTree:
    """A reduction tree of lists: lists of about equal depth are merged first, so each interval is merged log(n) times."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray] | None] = []

    def add(self, part: tuple[np.ndarray, np.ndarray]) -> None:
        for k, held in enumerate(self.levels):
            if held is None:
                self.levels[k] = part
                return
            part, self.levels[k] = merge_lists(held, part), None
        self.levels.append(part)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        out = (np.empty(0, np.int64), np.empty(0, np.int64))
        for held in self.levels:
            if held is not None:
                out = merge_lists(out, held)
        return out


def _tiled(start: np.ndarray, stop: np.ndarray, tile_bp: int) -> tuple[np.ndarray, ...]:
    """(row, level, tile, start, stop) of each interval's pieces: its ends in its first and last tile, the rest a level higher.

    At most two pieces a level; above the last level one piece takes all that is left.
    """
    row = np.arange(len(start))
    pieces = []
    widths = [w for w in (tile_bp << (LEVEL_BITS * k) for k in range(4)) if w <= 1 << 54]
    for level, width in enumerate(widths):
        first, last = start // width, (stop - 1) // width
        pieces.append((row, np.full(len(row), level), first, start, np.minimum(stop, (first + 1) * width)))
        two = last > first
        pieces.append((row[two], np.full(two.sum(), level), last[two], last[two] * width, stop[two]))
        more = last - first > 1
        row, start, stop = row[more], (first[more] + 1) * width, last[more] * width
    pieces.append((row, np.full(len(row), len(widths)), np.zeros(len(row), np.int64), start, stop))
    return tuple(np.concatenate(x) for x in zip(*pieces))


def _fold(keys: list[str], tile_bp: int):
    """Tasks' partial aggregate: rows (keys, start, stop) to rows (keys, level, tile, starts, stops)."""

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        row, level, tile, start, stop = _tiled(rows["start"].to_numpy(np.int64), rows["stop"].to_numpy(np.int64), tile_bp)
        code = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()[row]
        order = np.lexsort((start, tile, level, code))
        row, code, level, tile, start, stop = (x[order] for x in (row, code, level, tile, start, stop))
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(code) != 0) | (np.diff(level) != 0) | (np.diff(tile) != 0))))
        edges = [*begin, len(code)]
        lists = [union_sorted(start[a:b], stop[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        out = rows.iloc[row[begin]][keys].reset_index(drop=True)
        out["level"], out["tile"] = level[begin], tile[begin]
        out["starts"], out["stops"] = [x[0] for x in lists], [x[1] for x in lists]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= FOLD_ROWS:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _combine(keys: list[str], reach: int, edges: bool):
    """Merges the lists of each (keys, level, tile), which come sorted.

    edges=True gives an edge row a tile, and a row for every interval of the levels above, which are whole tiles.
    edges=False gives the inner periods and gaps of each tile that has any.
    """
    group = [*keys, "level", "tile"]
    Done = list[tuple[tuple, np.ndarray, np.ndarray]]

    def edge_rows(done: Done) -> pd.DataFrame:
        out: list[tuple] = []
        for (*key, level, tile), start, stop in done:
            if level:
                out += [(*key, tile, True, a, b, a, b, 1) for a, b in zip(start.tolist(), stop.tolist())]
            else:
                out.append((*key, tile, False, int(start[0]), int(stop[0]), int(start[-1]), int(stop[-1]), len(start)))
        return pd.DataFrame(out, columns=[*keys, "tile", "whole", "first_start", "first_stop", "last_start", "last_stop", "n"])

    def inner_rows(done: Done) -> pd.DataFrame:
        inner = [(key, start, stop) for key, start, stop in done if not key[-2] and len(start) > 1]
        out = {c: [key[k] for key, _, _ in inner] for k, c in enumerate(keys)} | {"tile": [key[-1] for key, _, _ in inner]}
        out["stops"] = [np.concatenate((stop[1:-1], start[1:])) for _, start, stop in inner]
        out["starts"] = [np.concatenate((start[1:-1], stop[:-1])) for _, start, stop in inner]
        return pd.DataFrame(out, columns=[*keys, "tile", "starts", "stops"])

    emit = edge_rows if edges else inner_rows

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        tree = IntervalTree()
        for part in parts:
            tree.add(part)
        return tree.result()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts = None, []
        done: Done = []
        pending = 0
        for batch in batches:
            for *now, starts, stops in zip(*(batch[c].tolist() for c in group), batch["starts"], batch["stops"]):
                now = tuple(now)
                if now != key:
                    if key is not None:
                        done.append((key, *merge(parts)))
                        pending += len(done[-1][1])
                        if pending >= 50_000:
                            yield from filter(len, [emit(done)])
                            done, pending = [], 0
                    key, parts = now, []
                parts.append((np.asarray(starts, np.int64), np.asarray(stops, np.int64)))
                if len(parts) == MERGE_LISTS:
                    parts = [merge(parts)]
        if key is not None:
            done.append((key, *merge(parts)))
        if done:
            yield from filter(len, [emit(done)])

    return run


def _floor(position: str, width: int) -> Column:
    """The number of the tile that holds a position; rounds down below zero too."""
    return F.expr(f"(({position}) - pmod({position}, {width}L)) div {width}L")


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", tile_bp: int = TILE_BP, reach: int = 1) -> DataFrame:
    """(keys, kind, seg_start, seg_end): the continuous periods of each key and the gaps between neighbouring ones.

    Two intervals belong to one period when the next starts at most `reach` after the largest end so far. A gap runs from the
    end of a period to the start of the next. Rows with a null key, a null, reversed or empty interval, or a position of
    2^61 or more give nothing; repeated rows change nothing; extra columns are ignored. Keys are bigint or string columns.
    """
    types = dict(intervals.dtypes)
    clean = intervals.select(*keys, F.col(start).cast("bigint").alias("start"), (F.col(end).cast("bigint")).alias("end"))
    for k in keys:
        clean = clean.where(F.col(k).isNotNull())
    limit = 1 << 61
    clean = clean.where((F.col("start") < F.col("end")) & (F.col("start") > -limit) & (F.col("end") < limit))
    usable = clean.select(*keys, "start", (F.col("end") + reach).alias("stop"))
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    group = [*keys, "level", "tile"]
    partial = usable.mapInPandas(_fold(keys, tile_bp), f"{key_ddl}, level int, tile bigint, starts array<bigint>, stops array<bigint>")
    placed = partial.repartition(*group).sortWithinPartitions(*group)
    edges = placed.mapInPandas(
        _combine(keys, reach, True), f"{key_ddl}, tile bigint, whole boolean, first_start bigint, first_stop bigint, last_start bigint, last_stop bigint, n bigint"
    )
    inner = placed.mapInPandas(_combine(keys, reach, False), f"{key_ddl}, tile bigint, starts array<bigint>, stops array<bigint>")
    # A tile that lies within a whole run has nothing to say: its edge row is dropped, and its inner rows too.
    along = Window.partitionBy(*keys).orderBy("first_start", F.desc("whole"), F.desc("last_stop"))
    over = F.max(F.when(F.col("whole"), F.col("last_stop"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    hidden = F.when(F.col("whole"), F.col("over") >= F.col("last_stop")).otherwise(F.col("over") > F.col("tile") * tile_bp)
    marked = edges.withColumn("over", over).withColumn("hidden", F.coalesce(hidden, F.lit(False)))
    covered = marked.where("hidden and not whole").select(*keys, "tile")
    seen = inner.join(covered, [*keys, "tile"], "left_anti")
    # The first half of a list, and one more, are gaps.
    half = ((F.size("starts") - 1) / 2).cast("int")
    segment = F.transform(F.arrays_zip("starts", "stops"), lambda x, k: F.struct(
        F.when(k < half, "period").otherwise("gap").alias("kind"), F.when(k < half, x["starts"]).otherwise(x["starts"] - reach).alias("seg_start"),
        F.when(k < half, x["stops"] - reach).otherwise(x["stops"]).alias("seg_end")))
    finished = seen.select(*keys, F.explode(segment).alias("s")).select(*keys, "s.*")
    return finished.unionByName(_stitch(marked.where("not hidden"), keys, reach))


def _stitch(rows: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Joins up the edge rows and whole runs of each key: what touches or overlaps the largest stop so far goes on."""
    along = Window.partitionBy(*keys).orderBy("first_start", F.desc("whole"), F.desc("last_stop"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"far": F.max("last_stop").over(before), "next_start": F.lead("first_start").over(along)})
    rows = rows.withColumn("joined", F.coalesce(F.col("first_start") <= F.col("far"), F.lit(False)))
    opened = F.when(~((F.col("n") == 1) & F.col("joined")), F.col("last_start"))
    rows = rows.withColumn("opened", opened).withColumn("carried", F.last("opened", ignorenulls=True).over(before))
    begun = F.when(F.col("joined"), F.col("carried")).otherwise(F.col("first_start"))
    goes_on = F.coalesce(F.col("next_start") <= F.col("last_stop"), F.lit(False))

    def segment(kind: str, condition: Column, low: Column, high: Column) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), low.alias("seg_start"), high.alias("seg_end")))

    found = F.array(
        segment("period", F.col("n") > 1, begun, F.col("first_stop") - reach),
        segment("period", ~goes_on, F.when(F.col("n") == 1, begun).otherwise(F.col("last_start")), F.col("last_stop") - reach),
        segment("gap", F.col("far").isNotNull() & ~F.col("joined"), F.col("far") - reach, F.col("first_start")),
    )
    return rows.select(*keys, F.explode(F.array_compact(found)).alias("s")).select(*keys, "s.kind", "s.seg_start", "s.seg_end")


def assign_periods(rows: DataFrame, periods: DataFrame, keys: list[str], position: str, tile_bp: int = ASSIGN_BP) -> DataFrame:
    """rows with period_start, period_end of the period of their key that holds `position`; rows outside all are dropped.

    periods: keys, seg_start, seg_end, disjoint in a key; its other columns are carried along. Each tile that holds rows
    gets the periods that begin in it and the last one before it, so that the rows meet them by an equality, which
    splits where a tile is hot; only one entry a tile passes through a key's window.
    """
    extra = [c for c in periods.columns if c not in (*keys, "seg_start", "seg_end")]
    mark = F.struct("seg_start", "seg_end", *extra)
    placed = rows.withColumn("_tile", _floor(f"cast(`{position}` as bigint)", tile_bp))
    begins = periods.select(*keys, _floor("seg_start", tile_bp).alias("_tile"), mark.alias("_mark"))
    asked = placed.where(F.col("_tile").isNotNull()).select(*keys, "_tile").distinct().withColumn("_mark", F.lit(None).cast(begins.schema["_mark"].dataType))
    tiles = begins.unionByName(asked).groupBy(*keys, "_tile").agg(F.sort_array(F.collect_list("_mark")).alias("_own"))
    earlier = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.try_element_at("_own", F.lit(-1)), ignorenulls=True).over(earlier)
    lists = tiles.select(*keys, "_tile", F.concat(F.array_compact(F.array(carried)), "_own").alias("_marks")).where(F.size("_marks") > 0)
    here = F.try_element_at(F.filter("_marks", lambda m: m["seg_start"] <= F.col(position)), F.lit(-1))
    found = placed.join(lists, [*keys, "_tile"]).withColumn("_mark", here).where(F.col(position) <= F.col("_mark.seg_end"))
    return found.select(*rows.columns, F.col("_mark.seg_start").alias("period_start"), F.col("_mark.seg_end").alias("period_end"), *(F.col(f"_mark.{c}").alias(c) for c in extra))


def restored_intervals(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, q_name, start, end) of overlap rows, with the chunk's offset added; unusable rows are left out.

    An offset that overflows, or a run without a known chunk length, gives no position and so no row.
    """
    offset = F.try_multiply(F.col("chunk_idx").cast("bigint"), F.col("chunk_bp"))
    good = (F.col("q_start") >= 0) & (F.col("q_start") < F.col("q_end"))
    rows = pairs.select("run_id", clean_id(F.col("q_name")).alias("q_name"), "chunk_idx", "q_start", "q_end").where(good & F.col("q_name").isNotNull())
    return (
        rows.join(runs.select("run_id", "chunk_bp"), "run_id")
        .select("run_id", "q_name", F.try_add("q_start", offset).alias("start"), F.try_add("q_end", offset).alias("end"))
    )


def query_periods(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Periods and gaps a run and query id, over all of its chunks."""
    return periods_and_gaps(restored_intervals(pairs, runs), ["run_id", "q_name"])
