"""Distance to the nearest point of interest of each type.

The globe is cut into a quadtree of squares in degrees.  A leaf keeps every point that can be nearest to something in it: a point is
ruled out once the whole leaf lies on the other side of the bisector between it and the point nearest to the leaf's middle.
Leaves are split until few points are left, so they are small where points are dense and grow with the distance from them.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import POI_AVENUE, POI_CENTER, POI_METRO
from ..functions.geo import haversine_km, usable_coordinates
from ..session import cut_lineage
from .lookup import fits, lookup

DISTANCES = {"DISTANCE_TO_METRO": POI_METRO, "DISTANCE_TO_CASTELLANA": POI_AVENUE}
BROADCAST_POINTS = 5_000
# Points of a leaf; points that one task splits further; the last level, of about 15 centimetres.
LEAF_POINTS, TASK_POINTS, DEEPEST = 24, 20_000, 26
# A leaf with more points than FEW_POINTS is split on while it spans more than this share of the way to its nearest point: beyond, points
# as good as equally far would be told apart in ever smaller squares.
FEW_POINTS, SHARE = 6, 1 / 2
# Level of the squares that tasks start from where points are few.
FIRST = 2
_POINT = "struct<lat: double, lon: double, x: double, y: double, z: double>"
LEAF_SCHEMA = f"tipo string, level int, i long, j long, near array<{_POINT}>"
_XYZ = ("x", "y", "z")


def _unit(lat: Column, lon: Column) -> list[Column]:
    """The point on the unit sphere, as x, y, z."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _square(lat: Column, lon: Column, level: Column | int) -> tuple[Column, Column]:
    """Row and column of a place at a level, whose squares have sides of 90 / 2 ** level degrees; the far ends belong to the last ones."""
    n = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return (F.least(F.floor((lat + 90) * n / 90), n * 2 - 1).cast("long"), F.least(F.floor((lon + 180) * n / 90), n * 4 - 1).cast("long"))


def _reach(level: int) -> float:
    """No point of a square is farther than this from its middle, in radii of the globe."""
    return math.radians(90 / 2 ** level) * math.sqrt(0.5) * (1 + 1e-9)


def _middle(level: int, i: int, j: int) -> np.ndarray:
    """A square's middle on the unit sphere."""
    side = 90 / 2 ** level
    lat, lon = math.radians((i + 0.5) * side - 90), math.radians((j + 0.5) * side - 180)
    return np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])


def can_be_nearest(points: np.ndarray, level: int, i: int, j: int) -> np.ndarray:
    """Which of the points (lat, lon, x, y, z) no other rules out for the square."""
    xyz = points[:, 2:]
    along = xyz @ _middle(level, i, j)
    best = int(along.argmax())
    return (along[best] - along) < _reach(level) * np.linalg.norm(xyz[best] - xyz, axis=1) + 1e-13


def _is_leaf(points: np.ndarray, level: int, i: int, j: int) -> bool:
    if len(points) <= FEW_POINTS or level >= DEEPEST:
        return True
    return len(points) <= LEAF_POINTS and _reach(level) < SHARE * np.linalg.norm(points[:, 2:] - _middle(level, i, j), axis=1).min()


def leaves(points: np.ndarray, level: int, i: int, j: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Leaves of one square with their points."""
    open_ = [(level, i, j, points)]
    while open_:
        level, i, j, points = open_.pop()
        points = points[can_be_nearest(points, level, i, j)]
        if _is_leaf(points, level, i, j):
            yield level, i, j, points
        else:
            open_ += [(level + 1, 2 * i + a, 2 * j + b, points) for a in (0, 1) for b in (0, 1)]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squares with bounded points, split to leaves."""
    names = ("lat", "lon", *_XYZ)
    for batch in batches:
        for r in range(batch.num_rows):
            kind, level, i, j = (batch.column(c)[r].as_py() for c in range(4))
            held = batch.column(4)[r].values
            points = np.column_stack([held.field(n).to_numpy(zero_copy_only=False) for n in names])
            points = points[np.lexsort((points[:, 1], points[:, 0]))]
            found = list(leaves(points, level, i, j))
            flat = np.concatenate([f[3] for f in found])
            near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f[3]) for f in found])]), pa.int32()),
                                            pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(5)], names))
            yield pa.record_batch([pa.array([kind] * len(found)), *[pa.array([f[c] for f in found], t) for c, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))], near],
                                  ["tipo", "level", "i", "j", "near"])


def quadtree(points: DataFrame, task_points: int = TASK_POINTS, few: bool = False) -> DataFrame:
    """(tipo, level, i, j, near) of every leaf over the globe, from distinct points (tipo, Lat, Lon); near is in order of places.

    Squares with more points than one task takes are split by passes over (square, point) rows, in which each square learns its nearest
    point by a combined aggregate; the others are split inside tasks.  A square of the last level that is still too full becomes
    several rows, of which the least distance counts.  few: known to be no more than one task takes.
    """
    xyz = [c.alias(n) for n, c in zip(_XYZ, _unit(F.col("Lat"), F.col("Lon")))]
    rows = points.select("tipo", F.col("Lat").alias("lat"), F.col("Lon").alias("lon"), *xyz)
    squares = F.expr(f"explode(flatten(transform(sequence(0L, {2 * 2 ** FIRST - 1}L), i -> transform(sequence(0L, {4 * 2 ** FIRST - 1}L), j -> struct(i, j)))))").alias("s")
    point = F.struct("lat", "lon", *_XYZ)
    key = ["tipo", "level", "i", "j"]
    if few or fits(points, task_points):
        gathered = rows.groupBy("tipo").agg(F.collect_list(point).alias("near"))
        gathered = gathered.select("tipo", F.lit(FIRST).alias("level"), squares, "near").select("tipo", "level", "s.i", "s.j", "near")
        return gathered.repartition(8, "i", "j").mapInArrow(_split, LEAF_SCHEMA)
    open_, closed = rows.select("*", F.lit(0).alias("level"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"))
                                                                                for i in (0, 1) for j in range(4)])).alias("s")).select(*rows.columns, "level", "s.i", "s.j"), []
    for level in range(DEEPEST + 1):
        side = 90 / 2 ** level
        middle = _unit((F.col("i") + 0.5) * side - 90, (F.col("j") + 0.5) * side - 180)
        along = sum((F.col(n) * m for n, m in zip(_XYZ[1:], middle[1:])), F.col("x") * middle[0])
        placed = open_.withColumn("along", along)
        best = placed.groupBy(key).agg(F.max(F.struct("along", *_XYZ)).alias("best"))
        away = F.sqrt(sum(((F.col(f"best.{n}") - F.col(n)) * (F.col(f"best.{n}") - F.col(n)) for n in _XYZ[1:]),
                          (F.col("best.x") - F.col("x")) * (F.col("best.x") - F.col("x"))))
        kept = cut_lineage(lookup(placed, best, key).where((F.col("best.along") - F.col("along")) < _reach(level) * away + 1e-13).drop("best", "along"))
        sizes = kept.groupBy(key).agg(F.count("*").alias("n"))
        marked = lookup(kept, sizes, key)
        full = (F.col("n") > task_points) & F.lit(level < DEEPEST)
        closed.append(marked.where(~full))
        quarters = F.explode(F.array(*[F.struct((F.col("i") * 2 + a).alias("i"), (F.col("j") * 2 + b).alias("j")) for a in (0, 1) for b in (0, 1)])).alias("s")
        open_ = marked.where(full).select("tipo", "lat", "lon", *_XYZ, (F.col("level") + 1).alias("level"), quarters).select(*rows.columns, "level", "s.i", "s.j")
        if open_.limit(1).count() == 0:
            break
    ready = closed[0]
    for c in closed[1:]:
        ready = ready.unionByName(c)
    block = F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col("n") / task_points).cast("long"))
    return ready.groupBy(*key, block.alias("block")).agg(F.collect_list(point).alias("near")).select(*key, "near").mapInArrow(_split, LEAF_SCHEMA)


@dataclass(frozen=True)
class PoiIndex:
    """Leaves of the quadtree.  starts: where they begin along the curve through all squares, for a tree that is broadcast."""
    leaves: DataFrame
    starts: dict[str, list[int]] | None
    levels: dict[str, tuple[int, int]]
    center: tuple[float, float]


#: Steps that set the bits of a number apart, each followed by a free place.
_SPACING = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _along_curve(df: DataFrame, i: Column, j: Column, name: str) -> DataFrame:
    """Add the place of square (i, j) on the curve through all squares. Each step is a column of its own, as it names the one before twice."""
    df = df.withColumns({"__si": i, "__sj": j})
    for shift, mask in _SPACING:
        df = df.withColumns({c: F.shiftleft(c, shift).bitwiseOR(F.col(c)).bitwiseAND(F.lit(mask)) for c in ("__si", "__sj")})
    return df.withColumn(name, F.shiftleft("__si", 1).bitwiseOR(F.col("__sj"))).drop("__si", "__sj")


def index_pois(pois: DataFrame, max_points: int = BROADCAST_POINTS, task_points: int = TASK_POINTS) -> PoiIndex:
    """Measure the table and build its leaves, to be broadcast or shuffled.  The centre is the first of its type: by `poi_no`, or as stored."""
    first = F.col("poi_no") if "poi_no" in pois.columns else F.monotonically_increasing_id()
    center = (pois.select("tipo", "Lat", "Lon", first.alias("no")).filter(F.col("tipo") == POI_CENTER)
              .select(F.min(F.struct("no", "Lat", "Lon")).alias("p")).select("p.Lat", "p.Lon").first())
    points = (pois.filter(F.col("tipo").isin(*DISTANCES.values()) & usable_coordinates(F.col("Lat"), F.col("Lon"))).select("tipo", "Lat", "Lon").distinct()).persist()
    small = fits(points, max_points)
    found = quadtree(points, task_points, small and max_points <= task_points)
    at = center["Lat"], center["Lon"]
    if not small:
        found = cut_lineage(found)
        levels = {r["tipo"]: (r["low"], r["high"]) for r in found.groupBy("tipo").agg(F.min("level").alias("low"), F.max("level").alias("high")).collect()}
        return PoiIndex(found, None, levels, at)
    up = F.pow(F.lit(2.0), F.lit(DEEPEST) - F.col("level")).cast("long")
    found = _along_curve(found, F.col("i") * up, F.col("j") * up, "start").select("tipo", "start", "near").persist()
    starts: dict[str, list[int]] = {}
    for r in found.select("tipo", "start").collect():
        starts.setdefault(r["tipo"], []).append(r["start"])
    return PoiIndex(found, {k: sorted(v) for k, v in starts.items()}, {}, at)


def _with_distance(df: DataFrame, name: str) -> DataFrame:
    """Add the exact distance to the point of `__near` with the shortest chord, which is also the nearest along the sphere.

    Plain numbers are compared, not structs; points lie in order of places, so of equal chords the first is that of the least place.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    x, y, z = F.col("__ux"), F.col("__uy"), F.col("__uz")

    def chord2(p: Column) -> Column:
        dx, dy, dz = x - p["x"], y - p["y"], z - p["z"]
        return dx * dx + dy * dy + dz * dz

    # A column of its own, as it is named twice.
    out = df.withColumn("__chords", F.transform("__near", chord2))
    best = F.get("__near", F.array_position("__chords", F.array_min("__chords")).cast("int") - 1)
    out = out.withColumn("__best", best)
    return out.withColumn(name, haversine_km(lat, lon, F.col("__best.lat"), F.col("__best.lon"))).drop("__chords", "__best")


def _with_unit(df: DataFrame) -> DataFrame:
    return df.withColumns(dict(zip(("__ux", "__uy", "__uz"), _unit(F.col("latitude"), F.col("longitude")))))


def _on_globe(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The same place within the usual range; NULL where a coordinate is missing or not finite."""
    x, y, z = _unit(lat, lon)
    finite = (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))
    usable = usable_coordinates(lat, lon)
    return (F.when(usable, lat).when(finite, F.degrees(F.asin(z))), F.when(usable, lon).when(finite, F.degrees(F.atan2(y, x))))


def _leaf_start(at: Column, starts: list[int]) -> Column:
    """The last start that is not beyond `at`, by halving."""
    # One literal, which the optimizer parses once; a literal a start would be planned one by one.
    held, steps = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<long>"), max(1, (len(starts) - 1).bit_length())

    def halve(low: Column, step: Column) -> Column:
        ahead = low + step
        return F.when((ahead < len(starts)) & (F.get(held, ahead) <= at), ahead).otherwise(low)
    low = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), halve)
    return F.get(held, low)


def _by_broadcast(df: DataFrame, index: PoiIndex) -> DataFrame:
    """One leaf row per listing and type; a missing coordinate has no leaf and so no distance."""
    lat, lon = F.col("latitude"), F.col("longitude")
    placed = df.withColumns(dict(zip(("__lat", "__lon"), _on_globe(lat, lon))))
    out = _with_unit(_along_curve(placed, *_square(F.col("__lat"), F.col("__lon"), DEEPEST), "__at").drop("__lat", "__lon"))
    for name, kind in DISTANCES.items():
        starts = index.starts.get(kind)
        if not starts:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        rows = index.leaves.where(F.col("tipo") == kind).select(F.col("start").alias("__start"), F.col("near").alias("__near"))
        out = out.withColumn("__start", F.when(F.col("__at").isNotNull(), _leaf_start(F.col("__at"), starts))).join(F.broadcast(rows), "__start", "left")
        out = _with_distance(out, name).drop("__start", "__near")
    return out.drop("__at", "__ux", "__uy", "__uz")


def _by_shuffle(df: DataFrame, index: PoiIndex) -> DataFrame:
    """For point sets too large to broadcast: distinct coordinates ask for their square of every level in use, of which one is a leaf; crowded
    leaves are split by skew joins."""
    lat, lon = F.col("latitude"), F.col("longitude")
    where = df.select("latitude", "longitude").distinct().withColumns(dict(zip(("__lat", "__lon"), _on_globe(lat, lon))))
    where = _with_unit(where.where("__lat is not null"))
    out = df
    for name, kind in DISTANCES.items():
        if kind not in index.levels:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        low, high = index.levels[kind]
        asked = where.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(high))))
        asked = asked.withColumns(dict(zip("ij", _square(F.col("__lat"), F.col("__lon"), F.col("level")))))
        met = asked.join(index.leaves.where(F.col("tipo") == kind).drop("tipo").hint("shuffle_merge"), ["level", "i", "j"])
        nearest = _with_distance(met.withColumnRenamed("near", "__near"), name).groupBy("latitude", "longitude").agg(F.min(name).alias(name))
        out = out.join(nearest.hint("shuffle_merge"), ["latitude", "longitude"], "left")
    return out


def nearest_poi(df: DataFrame, index: PoiIndex) -> DataFrame:
    """Add the distance in kilometres to the city centre and to the nearest point of each type."""
    lat, lon = F.col("latitude"), F.col("longitude")
    near = _by_broadcast(df, index) if index.starts is not None else _by_shuffle(df, index)
    return near.withColumn("DISTANCE_TO_CITY_CENTER",
                           haversine_km(lat, lon, F.lit(index.center[0]), F.lit(index.center[1])))
