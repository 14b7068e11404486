"""Polygon layers: WKB geometry to an edge table in projected metres, and back."""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.geo import project_utm

_POLYGON, _MULTI, _Z_FLAG, _M_FLAG, _SRID_FLAG = 3, 6, 0x80000000, 0x40000000, 0x20000000
EDGE_SCHEMA = "area_code string, ring_no int, edge_no int, x1 double, y1 double, x2 double, y2 double"


def _header(wkb: bytes, at: int) -> tuple[str, int, int, int]:
    """Byte order, kind, ordinates of a point, and where the content begins."""
    order = "<" if wkb[at] else ">"
    code = struct.unpack_from(order + "I", wkb, at + 1)[0]
    base = code & 0x0FFFFFFF
    width = 2 + max(bool(code & _Z_FLAG) + bool(code & _M_FLAG), {0: 0, 1: 1, 2: 1, 3: 2}[base // 1000])
    return order, base % 1000, width, at + 5 + (4 if code & _SRID_FLAG else 0)


def _rings(wkb: bytes) -> Iterator[np.ndarray]:
    """Rings of a polygon or multipolygon as (points, 2) views of its bytes, any byte order, extra ordinates skipped."""
    order, kind, _, at = _header(wkb, 0)
    polygons = 1
    if kind == _MULTI:
        polygons, at = struct.unpack_from(order + "I", wkb, at)[0], at + 4
    else:
        at = 0
    for _ in range(polygons):
        order, kind, width, at = _header(wkb, at)
        if kind != _POLYGON:
            raise ValueError(f"geometry type {kind} is not a polygon")
        count, at = struct.unpack_from(order + "I", wkb, at)[0], at + 4
        for _ in range(count):
            n = struct.unpack_from(order + "I", wkb, at)[0]
            yield np.frombuffer(wkb, order + "f8", n * width, at + 4).reshape(n, width)[:, :2]
            at += 4 + 8 * n * width


def _edges_of(codes: pa.Array, shapes: pa.Array) -> pa.RecordBatch:
    """Edges of a batch of shapes: points of all rings side by side, ring ends by cumulative sums; an edge joins neighbours of a ring."""
    rings, of, number = [], [], []
    for row, wkb in enumerate(shapes):
        for ring_no, ring in enumerate(_rings(wkb.as_py())):
            rings.append(ring)
            of.append(row)
            number.append(ring_no)
    sizes = np.array([len(r) for r in rings], np.int64)
    points = np.concatenate([*rings, np.empty((0, 2))]).astype(np.float64)
    first = np.ones(len(points), bool)
    first[np.cumsum(sizes[sizes > 0]) - 1] = False  # the last point of a ring begins no edge
    begins = np.flatnonzero(first)
    ring = np.repeat(np.arange(len(rings)), sizes)[begins]
    place = (np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[begins]
    ends = points[begins + 1] if len(begins) else points[:0]
    columns = [codes.take(pa.array(np.array(of, np.int64)[ring])), pa.array(np.array(number, np.int32)[ring]), pa.array(place.astype(np.int32)),
               *(pa.array(np.ascontiguousarray(c)) for c in (points[begins, 0], points[begins, 1], ends[:, 0], ends[:, 1]))]
    return pa.record_batch(columns, ["area_code", "ring_no", "edge_no", "x1", "y1", "x2", "y2"])


def polygon_edges(df: DataFrame, code: str = "barrio_code", geometry: str = "geometry",
                  degrees: bool = False) -> DataFrame:
    """(area_code, ring_no, edge_no, x1, y1, x2, y2), one row per edge.

    Metres are taken as they are; with `degrees`, x is longitude and y latitude
    and the ends are projected, so that edges are straight in metres.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _edges_of(part.column(0), part.column(1))

    edges = df.select(F.col(code).cast("string"), F.col(geometry)).filter(F.col(geometry).isNotNull()).mapInArrow(decode, EDGE_SCHEMA)
    if not degrees:
        return edges
    (x1, y1), (x2, y2) = project_utm(F.col("y1"), F.col("x1")), project_utm(F.col("y2"), F.col("x2"))
    return edges.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})


def polygon_shapes(edges: DataFrame) -> DataFrame:
    """(barrio_code, geometry): edge tables as WKB polygons, one row an area, rings by number."""
    ring = F.sort_array(F.collect_list(F.struct("edge_no", "x1", "y1")))
    rings = edges.groupBy("area_code", "ring_no").agg(ring.alias("ring"))
    areas = rings.groupBy("area_code").agg(F.sort_array(F.collect_list(F.struct("ring_no", "ring"))).alias("rings"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rings in batch.column(1):
                points = [np.column_stack([r["ring"].values.field(n).to_numpy(zero_copy_only=False) for n in ("x1", "y1")]) for r in rings]
                closed = [np.vstack([p, p[:1]]) for p in points]
                out.append(struct.pack("<BII", 1, _POLYGON, len(closed)) + b"".join(struct.pack("<I", len(p)) + p.astype("<f8").tobytes() for p in closed))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["barrio_code", "geometry"])
    return areas.mapInArrow(encode, "barrio_code string, geometry binary")
