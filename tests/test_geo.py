"""Areas and points against brute force on small fixtures."""
import math
import random
import struct

from pyspark.sql import functions as F

from pisoval.functions.geo import project_utm, unproject_utm
from pisoval.functions.numeric import coerce_numeric, parse_floor
from pisoval.operators.areas import assign_area, index_areas
from pisoval.operators.coverage import interior_points
from pisoval.operators.poi import index_pois, nearest_poi
from pisoval.sources.polygons import polygon_edges
from pyspark.sql import types as T

SQUARE = [(440000, 4474000), (442000, 4474000), (442000, 4476000), (440000, 4476000)]
HOLE = [(440500, 4474500), (440500, 4475500), (441500, 4475500), (441500, 4474500)]
NEXT = [(442000, 4474000), (444000, 4475000), (442000, 4476000)]


def ring_edges(code, ring_no, ring):
    return [(code, ring_no, i, float(a[0]), float(a[1]), float(b[0]), float(b[1]))
            for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))]


EDGES = ring_edges("011", 0, SQUARE) + ring_edges("011", 1, HOLE) + ring_edges("021", 0, NEXT)
SCHEMA = "area_code string, ring_no int, edge_no int, x1 double, y1 double, x2 double, y2 double"


def located(spark, points):
    lat, lon = unproject_utm(F.col("x"), F.col("y"))
    df = spark.createDataFrame([("b", i, float(x), float(y)) for i, (x, y) in enumerate(points)], "batch_id string, row_id long, x double, y double")
    return df.select("batch_id", "row_id", lat.alias("latitude"), lon.alias("longitude"))


def brute(x, y):
    best = {}
    for code in ("011", "021"):
        odd, dist = False, math.inf
        for _, _, _, x1, y1, x2, y2 in (e for e in EDGES if e[0] == code):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
            u = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            dist = min(dist, math.hypot(x - x1 - u * (x2 - x1), y - y1 - u * (y2 - y1)))
        best[code] = (odd, dist)
    inside = sorted(c for c, (odd, _) in best.items() if odd)
    near = sorted((d, c) for c, (_, d) in best.items() if d <= 500)
    return (inside[0], False) if inside else (near[0][1], True) if near else (None, False)


def test_assignment_equals_brute_force_both_ways(spark):
    rnd = random.Random(5)
    points = [(rnd.uniform(438900, 445100), rnd.uniform(4472900, 4477100)) for _ in range(400)]
    points += [(439501.0, 4475000.0), (439499.0, 4475000.0), (441000.0, 4475000.0)]
    edges, df = spark.createDataFrame(EDGES, SCHEMA), located(spark, points)
    expected = {i: brute(*p) for i, p in enumerate(points)}
    for index in (index_areas(edges), index_areas(edges, max_edges=0), index_areas(edges, cell_m=130.0)):
        rows = assign_area(df, index).collect()
        assert {r["row_id"]: (r["barrio_code"], r["barrio_rescatado"]) for r in rows} == expected
        assert all(r["distrito_code"] == (r["barrio_code"] or "")[:2] or r["barrio_code"] is None for r in rows)


def test_bad_coordinates_and_hot_point(spark):
    df = spark.createDataFrame([("b", 0, None, -3.7), ("b", 1, float("nan"), -3.7), ("b", 2, 91.0, -3.7), ("b", 3, 40.4, 179.0)]
                               + [("b", 10 + i, 40.42, -3.70) for i in range(500)], "batch_id string, row_id long, latitude double, longitude double")
    edges = spark.createDataFrame(EDGES, SCHEMA)
    for index in (index_areas(edges), index_areas(edges, max_edges=0)):
        rows = {r["row_id"]: r for r in assign_area(df, index).collect()}
        assert len(rows) == 504 and all(rows[i]["barrio_code"] is None and not rows[i]["barrio_rescatado"] for i in range(4))
        assert len({rows[10 + i]["barrio_code"] for i in range(500)}) == 1


def test_projection_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(40.4168, -3.7038), (0.0, -3.0), (-33.5, 1.25)], "latitude double, longitude double")
    x, y = project_utm(F.col("latitude"), F.col("longitude"))
    rows = df.withColumns({"x": x, "y": y}).withColumns(dict(zip(("la", "lo"), unproject_utm(F.col("x"), F.col("y"))))).collect()
    assert all(abs(r["la"] - r["latitude"]) < 1e-10 and abs(r["lo"] - r["longitude"]) < 1e-10 for r in rows)
    assert abs(rows[1]["x"] - 500000) < 1e-6 and abs(rows[1]["y"]) < 1e-6
    assert abs(rows[0]["x"] - 440289) < 5 and abs(rows[0]["y"] - 4474257) < 5


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def test_nearest_points_both_ways(spark):
    rnd = random.Random(9)
    pois = [(0, "City_Center", -3.70, 40.42)] + [
        (i, rnd.choice(["Metro", "Castellana"]), rnd.uniform(-3.8, -3.6), rnd.uniform(40.35, 40.5)) for i in range(1, 200)]
    table = spark.createDataFrame(pois, "poi_no int, tipo string, Lon double, Lat double")
    where = [(rnd.uniform(40.3, 40.55), rnd.uniform(-3.85, -3.55)) for _ in range(80)] + [(41.4, 2.17), (-20.0, 170.0)]
    rows = [("b", i, a, b) for i, (a, b) in enumerate(where)] + [("b", 999, None, -3.7)]
    df = spark.createDataFrame(rows, "batch_id string, row_id long, latitude double, longitude double")
    for index in (index_pois(table), index_pois(table, max_points=0)):
        got = {r["row_id"]: r for r in nearest_poi(df, index).collect()}
        assert len(got) == len(rows) and got[999]["DISTANCE_TO_METRO"] is None
        for i, (a, b) in enumerate(where):
            assert abs(got[i]["DISTANCE_TO_CITY_CENTER"] - haversine(a, b, 40.42, -3.70)) < 1e-9
            for name, kind in (("DISTANCE_TO_METRO", "Metro"), ("DISTANCE_TO_CASTELLANA", "Castellana")):
                want = min(haversine(a, b, p[3], p[2]) for p in pois if p[1] == kind)
                assert abs(got[i][name] - want) < 1e-7


def wkb(rings, order="<", multi=False):
    def polygon(rs):
        return struct.pack(order + "BII", 1 if order == "<" else 0, 3, len(rs)) + b"".join(
            struct.pack(order + "I", len(r) + 1) + b"".join(struct.pack(order + "dd", *p) for p in r + r[:1]) for r in rs)
    return struct.pack(order + "BII", 1 if order == "<" else 0, 6, 1) + polygon(rings) if multi else polygon(rings)


def test_polygon_edges_from_wkb(spark):
    df = spark.createDataFrame([("011", wkb([SQUARE, HOLE])), ("021", wkb([NEXT], ">", True))], "barrio_code string, geometry binary")
    assert sorted(map(tuple, polygon_edges(df).collect())) == sorted(EDGES)


def test_interior_points_are_inside(spark):
    points = interior_points(spark.createDataFrame(EDGES, SCHEMA)).collect()
    assert sorted(p["area_code"] for p in points) == ["011", "021"]
    assert all(brute(p["x"], p["y"]) == (p["area_code"], False) for p in points)


def test_floor_and_number_texts(spark):
    floors = [("bj", 0), (" EN ", 0), ("ss", -1), ("st", -1), ("3", 3), ("+1_0", 10), ("-2", -2), ("2.0", None), ("x", None), (None, None), ("٣", 3), ("1__0", None)]
    got = spark.createDataFrame([(a,) for a, _ in floors], "t string").select(parse_floor(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == [b for _, b in floors]
    numbers = [("12", 12.0), (" 1e2 ", 100.0), (".5", 0.5), ("12d", None), ("inf", None), ("nan", None), ("1_0", None), ("", None)]
    got = spark.createDataFrame([(a,) for a, _ in numbers], "t string").select(coerce_numeric(F.col("t"), T.StringType()).alias("v")).collect()
    assert [r["v"] for r in got] == [b for _, b in numbers]
    flags = spark.createDataFrame([(float("nan"), True), (2.5, False)], "d double, b boolean").select(
        coerce_numeric(F.col("d"), T.DoubleType()).alias("d"), coerce_numeric(F.col("b"), T.BooleanType()).alias("b")).collect()
    assert [tuple(r) for r in flags] == [(None, 1.0), (2.5, 0.0)]
