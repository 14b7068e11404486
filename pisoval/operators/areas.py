"""Polygon assignment: strictly inside, else nearest within a radius.

The layer is cut into square cells.  A cell near an area's boundary keeps whether its corner lies inside the area and the edges within
the radius; a point is inside if its corner is and the way from the corner to it, up and then across, crosses the
boundary an even number of times.  Only edges in the cell can be crossed, so an edge is kept where it runs, and nowhere else.
Cells that lie in an area away from its boundary are kept as runs along rows.  So the index grows with the length of
boundaries, and a point needs two equality lookups.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed_values import RESCUE_METRES
from ..functions.geo import on_edge, project_utm, segment_distance
from ..session import cut_lineage
from .lookup import fits

CELL_METRES = 500.0
BROADCAST_EDGES = 2_000_000
EDGE_BLOCK = 512
# Cells begin off any round coordinate, so that no boundary runs along their sides.
ORIGIN = 0.271828
# Runs are kept by groups of this many cells of a row.
RUN_CELLS = 64
_SLACK = 1e-6


def _cell(c: Column, size: float) -> Column:
    return F.floor((c - ORIGIN) / size).cast("int")


def _side(cell: Column, size: float) -> Column:
    return ORIGIN + cell * size


def _reach(low: Column, high: Column) -> tuple[Column, Column]:
    """Least and greatest x of the edge between two heights."""
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    bottom, top = F.least("y1", "y2"), F.greatest("y1", "y2")
    ends = [F.col("x1") + (F.least(F.greatest(h, bottom), top) - F.col("y1")) * slope for h in (low, high)]
    return (F.coalesce(F.least(*ends), F.least("x1", "x2")) - _SLACK, F.coalesce(F.greatest(*ends), F.greatest("x1", "x2")) + _SLACK)


def edge_cells(edges: DataFrame, max_m: float = RESCUE_METRES, cell_m: float = CELL_METRES) -> DataFrame:
    """(cx, cy, area_code, ring_no, block, edge): every edge once per cell that it runs through or passes within the radius;
    edge.own tells the first from the second.  Rows are gone through one by one, so a slanted edge has as many cells as it is long."""
    rows = edges.withColumn("cy", F.explode(F.sequence(_cell(F.least("y1", "y2") - max_m, cell_m), _cell(F.greatest("y1", "y2") + max_m, cell_m))))
    floor, ceiling = _side(F.col("cy"), cell_m), _side(F.col("cy") + 1, cell_m)
    west, east = _reach(floor - max_m, ceiling + max_m)
    own_west, own_east = _reach(floor - _SLACK, ceiling + _SLACK)
    touches = (F.least("y1", "y2") <= ceiling + _SLACK) & (F.greatest("y1", "y2") >= floor - _SLACK)
    met = rows.withColumn("cx", F.explode(F.sequence(_cell(west - max_m, cell_m), _cell(east + max_m, cell_m))))
    own = touches & (own_west <= _side(F.col("cx") + 1, cell_m)) & (own_east >= _side(F.col("cx"), cell_m))
    return met.select("cx", "cy", "area_code", "ring_no", F.floor(F.col("edge_no") / EDGE_BLOCK).cast("int").alias("block"),
                      F.struct("x1", "y1", "x2", "y2", own.alias("own")).alias("edge"))


def corner_sides(edges: DataFrame, cells: DataFrame, cell_m: float = CELL_METRES) -> tuple[DataFrame, DataFrame]:
    """(cx, cy, area_code, odd) of every cell near a boundary: 1 if its corner is inside; and (cy, first, last, area_code): the cells
    between such cells that lie inside.

    A corner is inside if the boundary crosses its row's line an odd number of times to the east of it.  Crossings and corners of an
    area's row are put in order together.
    """
    y = _side(F.col("cy"), cell_m)
    crossed = (edges.withColumn("cy", F.explode(F.sequence(_cell(F.least("y1", "y2"), cell_m), _cell(F.greatest("y1", "y2"), cell_m) + 1)))
               .where((F.col("y1") > y) != (F.col("y2") > y))
               .select("area_code", "cy", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"),
                       F.lit(1).alias("crossing"), F.lit(None).cast("int").alias("cx"), F.lit(None).cast("int").alias("last")))
    row = W.partitionBy("area_code", "cy")
    near = cells.select("area_code", "cy", "cx").distinct().withColumn("next", F.lead("cx").over(row.orderBy("cx")))
    # A cell asks for its own corner and, where others follow at a distance, for the first one's between.
    asked = F.array(F.struct("cx", F.lit(None).cast("int").alias("last")), F.struct((F.col("cx") + 1).alias("cx"), (F.col("next") - 1).alias("last")))
    corners = near.select("area_code", "cy", F.posexplode(asked).alias("n", "a")).where("n = 0 or a.last >= a.cx").select(
        "area_code", "cy", _side(F.col("a.cx"), cell_m).alias("x"), F.lit(0).alias("crossing"), "a.cx", "a.last")
    east = row.orderBy(F.desc("x"), "crossing").rowsBetween(W.unboundedPreceding, W.currentRow)
    sides = crossed.union(corners).withColumn("odd", (F.sum("crossing").over(east) % 2).cast("int")).where("crossing = 0")
    runs = sides.where("last is not null and odd = 1").select("cy", F.col("cx").alias("first"), "last", "area_code")
    return sides.where("last is null").select("cx", "cy", "area_code", "odd"), runs


def _crossings(x: Column, y: Column, x0: Column, y0: Column, e: Column) -> Column:
    """How often the way from the corner up to the point's height, and then across to it, meets the edge."""
    at_y = e["y1"] + F.try_divide((x0 - e["x1"]) * (e["y2"] - e["y1"]), e["x2"] - e["x1"])
    at_x = e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
    up = ((e["x1"] > x0) != (e["x2"] > x0)) & (at_y > y0) & (at_y <= y)
    across = ((e["y1"] > y) != (e["y2"] > y)) & (at_x > x0) & ~(x < at_x)
    return F.when(up, 1).otherwise(0) + F.when(across, 1).otherwise(0)


def _parity(x: Column, y: Column, x0: Column, y0: Column, odd: Column, edges: Column) -> Column:
    """0 outside, 1 inside; 2 once the point lies on an edge."""
    return F.aggregate(edges, odd, lambda acc, e: F.when(~e["own"], acc).when((acc >= 2) | on_edge(x, y, e), F.lit(2))
                       .otherwise((acc + _crossings(x, y, x0, y0, e)) % 2))


def _nearest(x: Column, y: Column, edges: Column) -> Column:
    return F.array_min(F.transform(edges, lambda e: segment_distance(x, y, e)))


_PLACE = ["__x", "__y", "__x0", "__y0", "cx", "cy", "cg"]


def _with_cells(points: DataFrame, cell_m: float) -> DataFrame:
    x, y = project_utm(F.col("latitude"), F.col("longitude"))
    return (points.withColumns({"__x": x, "__y": y})
            .withColumns({"cx": _cell(F.col("__x"), cell_m), "cy": _cell(F.col("__y"), cell_m)})
            .withColumns({"cg": F.floor(F.col("cx") / RUN_CELLS).cast("int"), "__x0": _side(F.col("cx"), cell_m), "__y0": _side(F.col("cy"), cell_m)}))


@dataclass(frozen=True)
class AreaIndex:
    """Cells and runs of a polygon layer, built once and used by every batch."""
    cells: DataFrame
    runs: DataFrame
    broadcast: bool
    max_m: float
    cell_m: float


def index_areas(edges: DataFrame, max_m: float = RESCUE_METRES, cell_m: float = CELL_METRES,
                max_edges: int = BROADCAST_EDGES) -> AreaIndex:
    """Measure the layer and shape its cells: whole cells to broadcast, else bounded edge blocks to shuffle."""
    cells = edge_cells(edges, max_m, cell_m).persist()
    small = fits(cells, max_edges)
    sides, runs = corner_sides(edges, cells, cell_m)
    group = F.explode(F.sequence(F.floor(F.col("first") / RUN_CELLS).cast("int"), F.floor(F.col("last") / RUN_CELLS).cast("int")))
    runs = runs.withColumn("cg", group)
    keys = ["cx", "cy", "area_code"]
    if small:
        own = F.collect_list(F.when(F.col("edge.own"), F.col("edge")))
        met = cells.groupBy(keys).agg(F.collect_list("edge").alias("edges"), own.alias("own")).join(sides, keys)
        shaped = met.groupBy("cx", "cy").agg(F.collect_list(F.struct("area_code", "odd", "edges", "own")).alias("__areas"))
        runs = runs.groupBy("cy", "cg").agg(F.collect_list(F.struct("first", "last", "area_code")).alias("__runs"))
    else:
        blocks = cells.groupBy(*keys, "ring_no", "block").agg(F.collect_list("edge").alias("edges"))
        # A corner's side comes once, in a row without edges.
        none = F.slice(F.array(F.lit(None).cast(cells.schema["edge"].dataType)), 1, 0)
        shaped = blocks.select(*keys, F.lit(0).alias("odd"), "edges").union(sides.select(*keys, "odd", none.alias("edges")))
    index = AreaIndex(cut_lineage(shaped), cut_lineage(runs), small, max_m, cell_m)
    cells.unpersist()
    return index


def _by_broadcast(df: DataFrame, index: AreaIndex) -> DataFrame:
    """One cell row and one row of runs per listing: no shuffle of the listings and no extra rows."""
    x, y, x0, y0, cx = (F.col(c) for c in ("__x", "__y", "__x0", "__y0", "cx"))
    inside = F.array_min(F.transform(
        F.filter("__areas", lambda a: _parity(x, y, x0, y0, a["odd"], a["own"]) == 1), lambda a: a["area_code"]))
    within = F.array_min(F.transform(F.filter("__runs", lambda r: cx.between(r["first"], r["last"])), lambda r: r["area_code"]))
    near = F.array_min(F.filter(
        F.transform("__areas", lambda a: F.struct(_nearest(x, y, a["edges"]).alias("d"), a["area_code"].alias("code"))),
        lambda s: s["d"] <= index.max_m))["code"]
    return (_with_cells(df, index.cell_m).join(F.broadcast(index.cells), ["cx", "cy"], "left").join(F.broadcast(index.runs), ["cy", "cg"], "left")
            .withColumn("__inside", F.least(inside, within))
            .withColumn("barrio_code", F.coalesce(F.col("__inside"), near))
            .withColumn("barrio_rescatado", F.col("__inside").isNull() & F.col("barrio_code").isNotNull())
            .drop(*_PLACE, "__areas", "__runs", "__inside"))


def _by_shuffle(df: DataFrame, index: AreaIndex) -> DataFrame:
    """For layers too large to broadcast: distinct points meet edge blocks by cell, and runs by row.

    Only coordinates travel; partial parities and minima combine before the shuffle,
    and a point shared by many listings is worked on once.  Crowded cells and points
    are split by the adaptive skew join.
    """
    # Cells pass through the grouping, so that conditions on them are not expanded into the projection formula.
    points = (_with_cells(df.select("latitude", "longitude"), index.cell_m).groupBy("latitude", "longitude")
              .agg(*[F.max(c).alias(c) for c in _PLACE]))
    x, y, x0, y0 = (F.col(c) for c in ("__x", "__y", "__x0", "__y0"))
    place = ["latitude", "longitude", "area_code"]
    met = (points.join(index.cells.hint("shuffle_merge"), ["cx", "cy"])
           .select(*place, _parity(x, y, x0, y0, F.col("odd"), F.col("edges")).alias("p"), _nearest(x, y, F.col("edges")).alias("d")))
    within = (points.join(index.runs.hint("shuffle_merge"), ["cy", "cg"]).where("cx between first and last")
              .select(*place, F.lit(1).alias("p"), F.lit(None).cast("double").alias("d")))
    per_area = met.union(within).groupBy(place).agg((F.sum("p") % 2).alias("odd"), F.max("p").alias("most"), F.min("d").alias("d"))
    inside = (F.col("odd") == 1) & (F.col("most") < 2)
    best = (per_area.groupBy("latitude", "longitude")
            .agg(F.min(F.when(inside, F.col("area_code"))).alias("__inside"),
                 F.min(F.when(F.col("d") <= index.max_m, F.struct("d", "area_code"))).alias("__near"))
            .select("latitude", "longitude",
                    F.coalesce("__inside", F.col("__near.area_code")).alias("barrio_code"),
                    (F.col("__inside").isNull() & F.col("__near").isNotNull()).alias("barrio_rescatado")))
    return (df.join(best.hint("shuffle_merge"), ["latitude", "longitude"], "left")
            .withColumn("barrio_rescatado", F.coalesce("barrio_rescatado", F.lit(False))))


def assign_area(df: DataFrame, index: AreaIndex) -> DataFrame:
    """Add `barrio_code`, `distrito_code` and `barrio_rescatado` for `latitude`, `longitude`.

    Points on a boundary are outside and so are rescued at distance zero.  The
    radius is inclusive and ties go to the lowest code.
    """
    out = _by_broadcast(df, index) if index.broadcast else _by_shuffle(df, index)
    return out.withColumn("distrito_code", F.substring("barrio_code", 1, 2))
