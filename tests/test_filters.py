"""Filters and duplicates beyond a broadcast, exact quantiles, and an index that grows with boundaries."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from pisoval.operators import filters
from pisoval.operators.areas import assign_area, corner_sides, edge_cells, index_areas
from pisoval.operators.duplicates import flag_duplicates, mark_duplicates, repeated_filter
from pisoval.operators.profile import training_profile
from pisoval.operators.quantiles import order_statistics, ranked_values
from pisoval.plans import contract
from pisoval.sources import driver_tables as d
from test_geo import located


@pytest.fixture(scope="module")
def coded(spark):
    r = random.Random(2)
    rows = [(f"b{r.randrange(3)}", f"c{r.randrange(20_000)}" if i % 9 else None, "long text") for i in range(30_000)] + [("b0", "hot", "x")] * 15_000 + [(None, "c1", "y")] * 2
    return spark.createDataFrame(rows, "batch_id string, codigo string, description string").cache()


def copies(df):
    return sorted(((r["batch_id"], r["codigo"], r["copias"]) for r in df.select("batch_id", "codigo", "copias").collect()), key=str)


@pytest.mark.parametrize("more", [{"max_rows": 0, "listed": 0}, {"max_rows": 0}, {"max_rows": 0, "max_bytes": 0}])
def test_duplicates_agree_whatever_way(spark, coded, more):
    keyed = coded.where("batch_id is not null")
    want = copies(mark_duplicates(keyed))
    assert len(want) == 45_000 and ("b0", "hot", 15_000) in want and all(n == 1 for _, c, n in want if c is None)
    assert copies(mark_duplicates(keyed, **more)) == want
    flagged = flag_duplicates(coded, **more).select("batch_id", "codigo", "repetido").collect()
    assert len(flagged) == 45_002 and sum(r["repetido"] for r in flagged) == sum(n > 1 for _, _, n in want)


def test_cascade_is_exact_and_small(spark):
    rows = spark.range(200_000).select(F.lit("b").alias("batch_id"), F.col("id").cast("string").alias("codigo"))
    repeated = rows.where("codigo % 7 = 0").withColumn("copias", F.lit(2).cast("long"))
    found = repeated_filter(rows, repeated, ["batch_id", "codigo"], listed=0)
    assert len(found.filters) > 1 and found.listed.count() == 0
    sizes = [f.size for f in found.filters]
    assert sizes[0] < 4 * 200_000 / 7 and sum(sizes[1:]) < 0.1 * sizes[0] + 4096
    got = found.mark(rows, "member")
    assert got.where("member <> (codigo % 7 = 0)").count() == 0
    assert filters.cascade(repeated.select("batch_id", "codigo"), lambda f: rows.limit(0), ["batch_id", "codigo"], max_bytes=10) is None
    empty = repeated_filter(rows, repeated.limit(0), ["batch_id", "codigo"])
    assert empty.mark(rows, "member").where("member").count() == 0


def test_no_description_is_shuffled(spark):
    """Rows keep their place while copies are told by filters: no exchange but a broadcast of filters, codes and lists."""
    marked = contract.validate_batch(d.raw_listings(spark, SF), max_rows=0, listed=0)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if re.search(r"\bExchange (hash|range|single|roundrobin)", line, re.I)]
    listings = d.raw_listings(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(exchanges) == len(re.findall(r"\bExchange (?:hash|range|single|roundrobin)", listings, re.I))
    assert "BloomFilter" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("Scan")[0].split("Join LeftOuter")[0]


def test_order_statistics_of_any_doubles(spark):
    r = np.random.default_rng(1)
    data = {"a": np.concatenate([r.normal(size=3000), [np.inf, -np.inf, 0.0, -0.0]]), "b": 10.0 ** r.uniform(-300, 300, 3000) * r.choice([-1, 1], 3000),
            "c": np.round(r.exponential(3, 3000)), "d": np.array([5.0]), "e": np.array([1e308, -1e308, 1.0, np.nextafter(1, 2)])}
    rows = [(n, float(v), 1 + i % 3) for n, x in data.items() for i, v in enumerate(x)] + [("a", None, 1), ("b", float("nan"), 1)]
    df = spark.createDataFrame(rows, "variable string, valor double, veces int")
    for weight in (None, "veces"):
        whole = {n: np.sort(np.repeat(x, [1 + i % 3 for i in range(len(x))]) if weight else x) for n, x in data.items()}
        ranks = {n: [0, len(x) // 2, int(len(x) * 0.99), len(x) - 1, len(x)] for n, x in whole.items()}
        got = ranked_values(df, ranks, weight=weight)
        assert all(got[n].get(k) == (x[k] if k < len(x) else None) for n, x in whole.items() for k in ranks[n])
    assert order_statistics(df.limit(0), "valor", [0]) == [None]


def test_profile_without_a_gather(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1000 / 8).alias("x"), F.when(F.col("id") > 4990, F.col("id")).alias("y"), F.lit(None).cast("double").alias("z"))
    got = {r["variable"]: r for r in training_profile(df, ["x", "y", "z"]).collect()}
    want = df.agg(F.percentile("x", 0.5), F.percentile("x", 0.99), F.percentile("y", 0.5), F.percentile("y", 0.99)).first()
    assert (got["x"]["mediana"], got["x"]["p99"], got["y"]["mediana"], got["y"]["p99"]) == tuple(want)
    assert got["x"]["n"] == 5000 and got["y"]["minimo"] == 4991 and "z" not in got
    assert "percentile" not in training_profile(df, ["x"])._jdf.queryExecution().toString()


def ring(points, code="1", ring_no=0):
    return [(code, ring_no, i, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for i, (a, b) in enumerate(zip(points, points[1:] + points[:1]))]


SCHEMA = "area_code string, ring_no int, edge_no int, x1 double, y1 double, x2 double, y2 double"


def test_index_grows_with_the_boundary(spark):
    """A province of 200 km by 200 km, cut on a slant: cells along the boundary and one run a row, not cells all over."""
    sizes = {}
    for side in (50_000, 100_000, 200_000):
        shape = [(400_000, 4_400_000), (400_000 + side, 4_400_000 + side // 10), (400_000 + side - side // 10, 4_400_000 + side), (400_000 - side // 20, 4_400_000 + side)]
        edges = spark.createDataFrame(ring(shape), SCHEMA)
        cells = edge_cells(edges).cache()
        _, runs = corner_sides(edges, cells)
        length = sum(math.dist(a, b) for a, b in zip(shape, shape[1:] + shape[:1]))
        sizes[side] = cells.count() / (length / 500), runs.count() / (side / 500)
    assert all(a < 6 and b <= 1.1 for a, b in sizes.values()), sizes


def test_corners_and_runs_against_brute_force(spark):
    r = random.Random(6)

    def star(cx, cy, n, size):
        return [(cx + size * (0.3 + r.random()) * math.cos(2 * math.pi * i / n), cy + size * (0.3 + r.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    rings = {"11": [star(440_000, 4_474_000, 40, 9_000)], "12": [[(436_000, 4_470_000), (444_000, 4_470_000), (444_000, 4_478_000), (436_000, 4_478_000)],
             [(438_000, 4_472_000), (438_000, 4_476_000), (442_000, 4_476_000), (442_000, 4_472_000)]], "13": [star(452_000, 4_474_000, 300, 4_000)]}
    rows = [e for code, rs in rings.items() for k, x in enumerate(rs) for e in ring(x, code, k)]
    points = [(r.uniform(428_000, 458_000), r.uniform(4_464_000, 4_484_000)) for _ in range(1500)]

    def brute(x, y):
        odd, near = {}, {}
        for code, _, _, x1, y1, x2, y2 in rows:
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd[code] = not odd.get(code, False)
            u = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            near[code] = min(near.get(code, math.inf), math.hypot(x - x1 - u * (x2 - x1), y - y1 - u * (y2 - y1)))
        inside = min((c for c, v in odd.items() if v), default=None)
        d_, c = min((d_, c) for c, d_ in near.items())
        return inside or (c if d_ <= 500 else None)
    want = {i: brute(*p) for i, p in enumerate(points)}
    edges, df = spark.createDataFrame(rows, SCHEMA), located(spark, points)
    for more in ({}, {"max_edges": 0}, {"cell_m": 77.0}, {"cell_m": 5000.0}):
        got = {r["row_id"]: r["barrio_code"] for r in assign_area(df, index_areas(edges, **more)).collect()}
        assert got == want, more


@pytest.mark.parametrize("copies", [flag_duplicates, mark_duplicates])
def test_filters_read_the_keys_of_the_rows_once(spark, copies):
    """What the codes are read from is worked through once for the filters, however often these ask, and once for each part of the outcome."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def code(i):
        seen.add(1)
        return None if i % 50 == 7 else f"L{i % 400}"

    rows = spark.range(0, 500, 1, 2).select(F.lit("b").alias("batch_id"), F.col("id").alias("row_id"), code.asNondeterministic()("id").alias("codigo"))
    out = copies(rows, max_rows=0, listed=0)
    assert seen.value == 500
    found = {r["row_id"]: r[-1] for r in out.collect()}
    codes = {i: None if i % 50 == 7 else f"L{i % 400}" for i in range(500)}
    counts = Counter(c for c in codes.values() if c)
    one = (lambda n: n > 1) if copies is flag_duplicates else (lambda n: max(n, 1))
    assert found == {i: one(counts[c] if c else 0) for i, c in codes.items()}
