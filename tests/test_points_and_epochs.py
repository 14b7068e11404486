"""The adaptive point index, epochs of a stream, and a package's hash tree."""
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pisoval.operators.poi import DEEPEST, LEAF_POINTS, can_be_nearest, index_pois, leaves, nearest_poi, quadtree
from pisoval.streaming.valuation import committed, drop_uncommitted, read_stream_output, value_micro_batch, value_stream
from pisoval.sources.listings import lines_of
from test_contract import BASE
from test_geo import haversine


def unit(lat, lon):
    a, b = np.radians(lat), np.radians(lon)
    return np.column_stack([lat, lon, np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def test_leaves_keep_every_nearest_point_and_cover_the_globe():
    r = np.random.default_rng(3)
    lat, lon = np.concatenate([r.normal(40.4, 0.05, 900), r.uniform(-80, 80, 60)]), np.concatenate([r.normal(-3.7, 0.05, 900), r.uniform(-180, 180, 60)])
    points = unit(lat, lon)
    found = [x for i in (0, 1) for j in range(4) for x in leaves(points, 0, i, j)]
    assert abs(sum((90 / 2 ** level) ** 2 for level, *_ in found) - 180 * 360) < 1e-6
    assert len(found) < 20 * len(points) and max(len(x[3]) for x in found) <= LEAF_POINTS
    sizes = {level for level, i, j, _ in found}
    assert max(sizes) - min(sizes) > 8  # small where points are dense, large far away
    for level, i, j, near in r.permutation(np.array(found, object))[:400]:
        side = 90 / 2 ** level
        x = unit((i + r.uniform(size=8)) * side - 90, (j + r.uniform(size=8)) * side - 180)[:, 2:]
        assert np.allclose((x @ points[:, 2:].T).max(1), (x @ near[:, 2:].T).max(1), atol=1e-12)


def test_points_on_a_circle_end_at_the_last_level():
    a = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    points = unit(40 + 0.01 * np.sin(a), -3 + 0.01 * np.cos(a) / math.cos(math.radians(40)))
    found = list(leaves(points, 3, *(int(v // (90 / 8)) for v in (130, 177))))
    assert max(level for level, *_ in found) <= DEEPEST and len(found) < 5000
    assert can_be_nearest(points[:1], 3, 0, 0).all()


@pytest.mark.parametrize("more", [{}, {"max_points": 0}, {"max_points": 0, "task_points": 40}])
def test_nearest_points_of_clusters_and_far_places(spark, more):
    r = random.Random(4)
    pois = [("City_Center", -3.70, 40.42)] + [(r.choice(["Metro", "Castellana"]), r.gauss(-3.7, 0.02), r.gauss(40.42, 0.02)) for _ in range(250)]
    pois += [("Metro", 2.17, 41.38), ("Metro", 179.99, -17.0), ("Castellana", -179.99, 65.0), ("Metro", 0.0, 90.0), ("Metro", None, 40.0), ("Metro", -3.7, float("nan"))]
    table = spark.createDataFrame(pois, "tipo string, Lon double, Lat double")
    where = [(r.gauss(40.42, 0.03), r.gauss(-3.7, 0.03)) for _ in range(120)] + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(120)]
    where += [(90.0, 180.0), (-90.0, -180.0), (0.0, 180.0), (91.0, -3.7), (40.4, 400.0)]
    df = spark.createDataFrame([("b", i, a, b) for i, (a, b) in enumerate(where)] + [("b", 999, None, 1.0)], "batch_id string, row_id long, latitude double, longitude double")
    got = {x["row_id"]: x for x in nearest_poi(df, index_pois(table, **more)).collect()}
    assert len(got) == len(where) + 1 and got[999]["DISTANCE_TO_METRO"] is None
    for i, (a, b) in enumerate(where):
        for name, kind in (("DISTANCE_TO_METRO", "Metro"), ("DISTANCE_TO_CASTELLANA", "Castellana")):
            want = min(haversine(a, b, p[2], p[1]) for p in pois if p[0] == kind and p[1] is not None and p[2] == p[2])
            assert abs(got[i][name] - want) < 1e-6, (i, name)


def test_a_type_without_points_has_no_distance(spark):
    table = spark.createDataFrame([("City_Center", -3.70, 40.42), ("Metro", -3.7, 40.4)], "tipo string, Lon double, Lat double")
    df = spark.createDataFrame([(40.4, -3.7)], "latitude double, longitude double")
    for more in ({}, {"max_points": 0}):
        row = nearest_poi(df, index_pois(table, **more)).first()
        assert row["DISTANCE_TO_METRO"] == 0 and row["DISTANCE_TO_CASTELLANA"] is None


def test_split_by_passes_gives_the_same_leaves(spark):
    r = random.Random(5)
    points = spark.createDataFrame([("Metro", r.gauss(-3.7, 0.05), r.gauss(40.4, 0.05)) for _ in range(300)], "tipo string, Lon double, Lat double")

    def area(df):
        return sum((90 / 2 ** x["level"]) ** 2 for x in df.select("level").collect())
    assert abs(area(quadtree(points)) - 180 * 360) < 1e-6 and abs(area(quadtree(points, 30)) - 180 * 360) < 1e-6


def test_only_committed_epochs_are_read(spark, refs, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"f{i}.jsonl").write_text("\n".join(json.dumps({**BASE, "propertyCode": f"c{i}-{k}"}) for k in range(3)))
    out = str(tmp_path / "out")
    good, bad = read_stream_output(spark, out, refs)
    assert good.count() == bad.count() == 0 and "precio_estimado" in good.columns
    value_stream(spark, str(tmp_path / "in"), refs, out, str(tmp_path / "state"), max_files=1).awaitTermination()
    assert sorted(r["epoch"] for r in committed(spark, out).collect()) == [0, 1]
    # One attempt broke off before its commit, one in the middle of a file.
    broken = tmp_path / "out" / "data" / "epoch=2" / "attempt=x" / "tipo=resultado"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"PAR1 half")
    good, bad = read_stream_output(spark, out, refs)
    assert good.count() == 6 and bad.count() == 0
    # A replayed epoch adds nothing, a new one is read once it is committed.
    lines = lines_of(spark.read.text(str(tmp_path / "in" / "f0.jsonl")))
    value_micro_batch(lines, 1, refs, out)
    assert read_stream_output(spark, out, refs)[0].count() == 6
    value_micro_batch(lines, 2, refs, out)
    assert read_stream_output(spark, out, refs)[0].count() == 9
    assert drop_uncommitted(spark, out) == ["data/epoch=2/attempt=x"]
    assert not broken.exists() and read_stream_output(spark, out, refs)[0].count() == 9


def test_leaves_hold_points_in_order_of_places(spark):
    from pyspark.sql import functions as F
    from pisoval.operators.poi import index_pois
    rows = [(n, "City_Center" if n == 0 else "Metro" if n % 2 else "Castellana", (n * 37) % 50 / 100 - 3.7, 40.3 + (n * 13) % 40 / 100) for n in range(60)]
    pois = spark.createDataFrame(rows, "poi_no long, tipo string, Lon double, Lat double")
    for most in (5000, 0):
        near = index_pois(pois, max_points=most).leaves.select(F.transform("near", lambda p: F.struct(p["lat"], p["lon"])).alias("n"))
        kept = near.select((F.col("n") == F.array_sort("n")).alias("ordered"), F.size("n").alias("n")).collect()
        assert kept and all(r["ordered"] for r in kept) and max(r["n"] for r in kept) > 1


def test_leaves_hold_few_points_unless_they_are_as_good_as_equally_far():
    rnd = np.random.default_rng(8)
    for lat, lon, most in ((rnd.uniform(40.3, 40.5, 900), rnd.uniform(-3.8, -3.6, 900), 6), (40.4 + np.sin(np.arange(20)) / 20, -3.7 + np.cos(np.arange(20)) / 20, 20)):
        a, b = np.radians(lat), np.radians(lon)
        points = np.column_stack([lat, lon, np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])
        found = [x for i in (0, 1) for j in range(4) for x in leaves(points, 0, i, j)]
        assert np.mean([len(x[3]) for x in found]) < 6 and len(found) < 40 * len(points) and max(x[0] for x in found) < 22
