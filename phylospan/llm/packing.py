"""Filling fixed-capacity containers (problem 5).

Each group (a build) is dealt to parts of bounded size. A part is packed by best-fit decreasing, and sequences longer
than a container, which alone may be split, are poured into the space that is left. Dual-feasible-function bounds, summed
over all parts, say how many containers the whole build needs at least; a build that takes no more is certified and
done. In the others, all containers with at least half the build's mean gap hand their contents back, small items in bundles,
so that a part of bounded size holds many containers; they are dealt anew across the build's parts and packed again.
This goes on while it saves containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospan.session import materialise

PART_ITEMS = 50_000
#: Thresholds of the whole build's bound, as parts of the capacity.
GRID = 64
#: In a container that is opened again, items below this part of the capacity move in bundles of up to twice the size.
BUNDLE = 1024
MAX_ROUNDS = 12


def lower_bound(sizes: np.ndarray, capacity: int, pourable: int = 0) -> int:
    """Containers that whole items of these sizes need at least, by dual feasible functions and by volume.

    For every threshold k up to half the capacity, items above capacity-k count as full containers, items below k as
    nothing, and the rest by volume beside the items above half. `pourable` base pairs may go anywhere.
    """
    volume = -(-(int(sizes.sum()) + pourable) // capacity)
    if not len(sizes):
        return volume
    ordered = np.sort(sizes)
    total = np.concatenate(([0], np.cumsum(ordered, dtype=np.int64)))
    half = capacity // 2
    ks = np.unique(np.concatenate(([0], ordered[ordered <= half])))
    above = np.searchsorted(ordered, capacity - ks, side="right")
    over_half = int(np.searchsorted(ordered, half, side="right"))
    over_half = np.minimum(over_half, above)
    from_k = np.minimum(np.searchsorted(ordered, ks, side="left"), over_half)
    n_full, n_big = len(ordered) - above, above - over_half
    beside = n_big.astype(np.int64) * capacity - (total[above] - total[over_half])
    rest = total[over_half] - total[from_k] - beside
    return max(volume, int((n_full + n_big + np.maximum(0, -(-rest // capacity))).max()))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """(container of each item, space left in each container)."""
    place = np.empty(len(sizes), np.int64)
    space: list[tuple[int, int]] = []
    left: list[int] = []
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        at = bisect_left(space, (size, -1))
        if at < len(space):
            room, bin_no = space.pop(at)
        else:
            room, bin_no = capacity, len(left)
            left.append(capacity)
        place[k] = bin_no
        left[bin_no] = room - size
        if room > size:
            insort(space, (room - size, bin_no))
    return place, left


def pack_part(ids: list, sizes: np.ndarray, capacity: int) -> tuple[list[tuple], int, int]:
    """([(container, id, piece_no, piece_bp, fill)], containers, lower bound) of one part."""
    whole = np.flatnonzero(sizes <= capacity)
    place, left = best_fit_decreasing(sizes[whole], capacity)
    rows = [(int(b), ids[k], 1, int(sizes[k])) for b, k in zip(place, whole)]
    room = sorted(((r, b) for b, r in enumerate(left) if r > 0))
    poured = 0
    for k in sorted(np.flatnonzero(sizes > capacity), key=lambda k: (-int(sizes[k]), str(ids[k]))):
        rest, piece = int(sizes[k]), 0
        poured += rest
        while rest:
            if room:
                space, bin_no = room.pop()
            else:
                space, bin_no = capacity, len(left)
                left.append(capacity)
            used = min(space, rest)
            piece += 1
            rows.append((bin_no, ids[k], piece, used))
            rest -= used
            left[bin_no] -= used
            if space > used:
                insort(room, (space - used, bin_no))
    return rows, len(left), lower_bound(sizes[whole], capacity, poured)


def bound_of_histogram(sizes: pd.DataFrame, capacity: int) -> int:
    """The bound of lower_bound for a whole build, from counts and sums a class of sizes; thresholds are the grid's.

    sizes: slot (twice the size's grid place, rounded down, and one more where it lies between two), n, bp of items up to
    the capacity; slots above the grid are items longer than a container, whose pieces may go anywhere.
    """
    slot, n, bp = (sizes[c].to_numpy(np.int64) for c in ("slot", "n", "bp"))
    best = -(-int(bp.sum()) // capacity)
    whole = slot <= 2 * GRID
    for j in range(GRID // 2 + 1):
        full, big = whole & (slot > 2 * (GRID - j)), whole & (slot > GRID) & (slot <= 2 * (GRID - j))
        rest = whole & (slot >= 2 * j) & (slot <= GRID)
        beside = int(n[big].sum()) * capacity - int(bp[big].sum())
        best = max(best, int(n[full].sum() + n[big].sum()) + max(0, -(-(int(bp[rest].sum()) - beside) // capacity)))
    return best


def build_bounds(items: DataFrame) -> DataFrame:
    """(build_id, bound): the containers that each build needs at least."""
    scaled = F.col("seq_length").cast("decimal(20,0)") * F.lit(GRID).cast("decimal(3,0)")
    low = F.expr(f"cast(seq_length as decimal(20,0)) * {GRID} div max_bp")
    low = F.when(F.col("seq_length") > F.col("max_bp"), F.lit(GRID + 1)).otherwise(low)
    between = (F.col("seq_length") <= F.col("max_bp")) & (scaled > low.cast("decimal(3,0)") * F.col("max_bp").cast("decimal(20,0)"))
    slots = items.groupBy("build_id", "max_bp", (2 * low + between.cast("int")).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("seq_length").alias("bp"))

    def bound(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"build_id": group["build_id"].iloc[:1], "bound": [bound_of_histogram(group, int(group["max_bp"].iloc[0]))]})

    return slots.groupBy("build_id").applyInPandas(bound, "build_id bigint, bound bigint")


_PACKED = "build_id bigint, part bigint, bin bigint, unit bigint, seq_id string, piece_no int, piece_bp bigint"
_PLACED = "build_id bigint, part bigint, unit bigint, unit_bp bigint, new_part bigint, new_bin bigint"


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """Packs a part. unit numbers what moves together when a container is opened: an item, a piece or a bundle of small items."""
    group = group.sort_values(["seq_length", "seq_id"], ascending=[False, True], kind="stable")
    sizes, ids = group["seq_length"].to_numpy(np.int64), group["seq_id"].tolist()
    capacity = int(group["max_bp"].iloc[0])
    rows, _, _ = pack_part(ids, sizes, capacity)
    out = pd.DataFrame(rows, columns=["bin", "seq_id", "piece_no", "piece_bp"]).sort_values("bin", kind="stable")
    small = out["piece_bp"] * BUNDLE < capacity
    filled = out["piece_bp"].where(small, 0).groupby(out["bin"]).cumsum() * BUNDLE // capacity
    alone = pd.Series(np.arange(len(out)), index=out.index)
    out["unit"] = pd.DataFrame({"bin": out["bin"], "of": filled.where(small, -1 - alone)}).groupby(["bin", "of"], sort=False).ngroup()
    out["build_id"], out["part"] = int(group["build_id"].iloc[0]), int(group["part"].iloc[0])
    return out[[x.split()[0] for x in _PACKED.split(", ")]]


def _repack(group: pd.DataFrame) -> pd.DataFrame:
    """Packs the units of a part of the exchange, none of which is longer than a container."""
    group = group.sort_values(["unit_bp", "part", "unit"], ascending=[False, True, True], kind="stable")
    place, _ = best_fit_decreasing(group["unit_bp"].to_numpy(np.int64), int(group["max_bp"].iloc[0]))
    out = group[["build_id", "part", "unit", "unit_bp", "new_part"]].copy()
    out["new_bin"] = place
    return out


def _parts(rows: DataFrame, part_items: int, name: str, *hashed: object) -> DataFrame:
    """Adds to each row the number of its part: about part_items rows of a build to a part, by a hash."""
    count = rows.groupBy("build_id").agg(F.count(F.lit(1)).alias("_rows"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_rows") / part_items)).cast("bigint")
    return rows.join(count, "build_id").withColumn(name, F.pmod(F.xxhash64(*hashed), parts)).drop("_rows")


def sequences_to_pack(sequences: DataFrame, builds: DataFrame) -> DataFrame:
    """(build_id, seq_id, seq_length, max_bp) of each distinct sequence of a build with a known length above 0."""
    lengths = sequences.where("seq_length > 0 and build_id is not null").groupBy("build_id", "seq_id").agg(F.max("seq_length").cast("bigint").alias("seq_length"))
    limits = builds.where("max_bp > 0").groupBy("build_id").agg(F.max("max_bp").cast("bigint").alias("max_bp"))
    return lengths.join(limits, "build_id")


def pack_sequences(sequences: DataFrame, builds: DataFrame, part_items: int = PART_ITEMS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(build_id, container_no, seq_id, piece_no, piece_bp): every sequence in containers of at most max_bp.

    Repeated records count once (with their largest length); null, zero and negative lengths, a null build and builds
    without a positive max_bp give no row. Container numbers are unique within a build. Extra columns are ignored.
    Exchange rounds end when all builds are certified, when one saves nothing, or after max_rounds.
    """
    items = sequences_to_pack(sequences, builds)
    dealt = _parts(items, part_items, "part", F.lit(0), "seq_id")
    packed = materialise(dealt.groupBy("build_id", "part").applyInPandas(_pack, _PACKED))
    limits = materialise(build_bounds(items).join(builds.where("max_bp > 0").groupBy("build_id").agg(F.max("max_bp").cast("bigint").alias("max_bp")), "build_id"))
    units = packed.groupBy("build_id", "part", "unit").agg(F.sum("piece_bp").alias("unit_bp"), F.first("bin").alias("bin"))
    units = units.select("build_id", "part", "unit", "unit_bp", F.lit(0).alias("round"), F.col("part").alias("in_part"), F.col("bin").alias("in_bin"))
    place = ["build_id", "round", "in_part", "in_bin"]
    moved = False
    for k in range(1, max_rounds + 1):
        containers = units.groupBy(*place).agg(F.sum("unit_bp").alias("fill"))
        means = containers.groupBy("build_id").agg(F.count(F.lit(1)).alias("bins"), F.avg("fill").alias("mean"))
        uncertified = means.join(limits, "build_id").where("bins > bound").select("build_id", "mean", "max_bp")
        loose = materialise(containers.join(uncertified, "build_id").where("max_bp - fill >= (max_bp - mean) / 2").select(*place, "max_bp"))
        if loose.isEmpty():
            break
        pool = _parts(units.join(loose, place), part_items, "new_part", F.lit(k), "part", "unit")
        anew = materialise(pool.groupBy("build_id", "new_part").applyInPandas(_repack, _PLACED))
        was = loose.groupBy("build_id").agg(F.count(F.lit(1)).alias("was"))
        now = anew.select("build_id", "new_part", "new_bin").distinct().groupBy("build_id").agg(F.count(F.lit(1)).alias("now"))
        better = was.join(now, "build_id").where("now < was").select("build_id")
        changed = anew.join(better, "build_id", "left_semi")
        if changed.isEmpty():
            break
        unit = ["build_id", "part", "unit"]
        units = units.join(changed.select(*unit, "new_part", "new_bin"), unit, "left")
        anywhere = F.col("new_bin").isNotNull()
        units = materialise(units.select(
            *unit, "unit_bp", F.when(anywhere, F.lit(k)).otherwise(F.col("round")).alias("round"),
            F.coalesce("new_part", "in_part").alias("in_part"), F.coalesce("new_bin", "in_bin").alias("in_bin"),
        ))
        moved = True
    if moved:
        packed = packed.join(units.select("build_id", "part", "unit", "round", "in_part", "in_bin"), ["build_id", "part", "unit"])
    else:
        packed = packed.withColumns({"round": F.lit(0), "in_part": F.col("part"), "in_bin": F.col("bin")})
    number = (F.col("in_part") * F.lit(max_rounds + 1) + F.col("round")) * F.lit(1 << 32) + F.col("in_bin")
    return packed.select("build_id", number.alias("container_no"), "seq_id", "piece_no", "piece_bp")
