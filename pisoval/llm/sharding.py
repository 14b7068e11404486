"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

#: Bits of a coordinate and of the group's fingerprint that follows it in a split key; bits read in one pass over the points.
COORDINATE, FINGERPRINT, STEP = 24, 38, 12
_BITS = COORDINATE + FINGERPRINT


def _coordinates(points: DataFrame, dims: Sequence[str]) -> dict:
    """Each dimension as an integer of 24 bits: numbers by their place between the extremes, other types by hash; null is 0."""
    numeric = [d for d in dims if points.schema[d].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    value = {d: F.when(F.isnan(F.col(f"`{d}`").cast("double")), None).otherwise(F.col(f"`{d}`").cast("double")) for d in numeric}
    ends = points.agg(*[f(value[d]).alias(f"{i}{f.__name__}") for i, d in enumerate(numeric) for f in (F.min, F.max)]).first() if numeric else {}
    out = {}
    for d in dims:
        if d in numeric:
            low, high = (ends[f"{numeric.index(d)}{f}"] for f in ("min", "max"))
            width = (high - low) if low is not None and math.isfinite(high - low) and high > low else 1.0
            place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value[d] - F.lit(low or 0.0)) / F.lit(width)))
            out[d] = F.coalesce(F.floor(place * (2 ** COORDINATE - 2)).cast("long") + 1, F.lit(0).cast("long"))
        else:
            out[d] = F.coalesce(F.pmod(F.xxhash64(F.col(f"`{d}`").cast("string")), F.lit(2 ** COORDINATE - 1)) + F.when(F.col(f"`{d}`").isNotNull(), 1), F.lit(0)).cast("long")
    return out


def _cuts(work: DataFrame, nodes: dict, key: str, exact: dict | None, tolerance: float) -> dict:
    """For each node {node: (dim, goal)}: (cut, base, weight, bits, prefix). Weight below `cut` of `key` is as near `goal` as
    whole bins of at most `tolerance` allow, or bits have run out. exact: only points whose split key has this value."""
    spark = work.sparkSession
    state = {n: [0, 0, 0.0, None] for n in nodes}  # prefix, bits, weight before, done
    while open_ := [n for n in nodes if state[n][3] is None]:
        rows = [(n, nodes[n][0], state[n][0], state[n][1], float(nodes[n][1] - state[n][2]), exact[n] if exact else 0) for n in open_]
        small = F.broadcast(spark.createDataFrame(rows, "node int, dim int, prefix long, bits int, goal double, exact long"))
        at = work.join(small, "node")
        split = F.element_at("keys", F.col("dim") + 1)
        at = at.where(split == F.col("exact")) if exact else at
        k = F.col("ident") if key == "ident" else split
        step = F.least(F.lit(STEP), _BITS - F.col("bits"))
        at = at.select("node", "goal", "w", "prefix", "bits", k.alias("k"), step.alias("step")) \
            .where(F.expr(f"shiftright(k, {_BITS} - bits) = prefix or bits = 0")) \
            .withColumn("bin", F.expr(f"shiftright(k, {_BITS} - bits - step) & (shiftleft(1L, step) - 1)"))
        sums = at.groupBy("node", "goal", "bits", "step", "bin").agg(F.sum("w").cast("double").alias("w"), F.count("*").alias("n"), F.min("k").alias("k"), F.max("k").alias("most"))
        sums = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        crossing = F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("bin", "upto", "w", "n", "k", "most")))
        last = F.max(F.struct("bin", "upto", "w", "n", "k", "most"))
        for r in sums.groupBy("node", "goal", "step").agg(F.coalesce(crossing, last).alias("c")).collect():
            prefix, bits, before, _ = state[r["node"]]
            c, below = r["c"], r["c"]["upto"] - r["c"]["w"]
            prefix, bits = (prefix << r["step"]) | c["bin"], bits + r["step"]
            state[r["node"]] = [prefix, bits, before + below, None]
            alone = c["k"] == c["most"]  # one value of the key
            if c["w"] <= tolerance or alone:
                heavy = alone and c["w"] > tolerance and c["n"] > 1
                nearer = 0 if heavy else int(c["upto"] - r["goal"] <= r["goal"] - below)
                state[r["node"]][3] = c["k"] + nearer if alone else (prefix + nearer) << (_BITS - bits), heavy
                state[r["node"]][0] = c["k"] if alone else prefix
    return {n: (*s[3], s[0], s[2]) for n, s in state.items()}


def kd_shards(points: DataFrame, weight: str, dims: Sequence[str], group: str, ident: Sequence[str], shards: int | None = None,
              target: int | None = None) -> DataFrame:
    """points with `shard` and a gapless `slot` from 0 in each shard.

    points holds metadata, one row a document; texts stay where they are. A node of the tree that stands for n shards is cut at
    the weighted median (for odd n at the weight share of its halves) of the dimension in which its points lie furthest apart,
    until each leaf is one shard: `shards` of them, or as many as leave about `target` weight in each. Points of one `group`
    value have one place in each dimension only if the dimensions are properties of the group; then they stay together unless
    the group is above 1% of a shard's weight and a cut falls into it, in which case it is cut by `ident` (a list of columns that
    tells its points apart), so that hot groups spread and weights stay near equal. Null weights count 0, null dimensions lie
    below all others. An empty table gives no rows. The driver sees one row per node and pass, never points.
    """
    kept = points.columns
    total, rows = points.agg(F.coalesce(F.sum(f"`{weight}`"), F.lit(0)), F.count("*")).first()
    shards = shards or max(1, math.ceil(total / target))
    places = _coordinates(points, dims)
    mark = F.xxhash64(F.col(f"`{group}`")).bitwiseAND(2 ** FINGERPRINT - 1)
    keys = F.array(*[F.shiftleft(c, FINGERPRINT).bitwiseOR(mark) for c in places.values()])
    ids = F.xxhash64(*[F.col(f"`{c}`") for c in ident]).bitwiseAND(2 ** _BITS - 1)
    work = points.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(f"`{weight}`"), F.lit(0)).cast("long").alias("w"),
                         keys.alias("keys"), ids.alias("ident"), F.lit(0).alias("node"))
    work, tolerance = cut_lineage(work), 0.01 * float(total) / shards
    live, leaves, number = {0: (0, shards)}, {}, 1
    while live:
        leaves |= {n: s[0] for n, s in live.items() if s[1] - s[0] == 1}
        live = {n: s for n, s in live.items() if s[1] - s[0] > 1}
        extents = [F.max(F.shiftright(F.col("keys")[i], FINGERPRINT)) - F.min(F.shiftright(F.col("keys")[i], FINGERPRINT)) for i in range(len(dims))]
        stats = {r["node"]: r for r in work.where(F.col("node").isin(list(live))).groupBy("node")
                 .agg(F.sum("w").alias("w"), *[e.alias(f"e{i}") for i, e in enumerate(extents)]).collect()} if live else {}
        nodes = {}
        for n, (low, high) in live.items():
            if n in stats:
                widest = max(range(len(dims)), key=lambda i: stats[n][f"e{i}"])
                nodes[n] = (widest, float(stats[n]["w"]) * ((low + high) // 2 - low) / (high - low))
        if not nodes:
            break
        cuts = _cuts(work, nodes, "split", None, tolerance)
        heavy = {n: (nodes[n][0], nodes[n][1] - c[3]) for n, c in cuts.items() if c[1]}
        inner = _cuts(work, heavy, "ident", {n: cuts[n][2] for n in heavy}, tolerance / 100) if heavy else {}
        rows_, following = [], {}
        for n in nodes:
            low, high = live[n]
            following |= {number: (low, (low + high) // 2), number + 1: ((low + high) // 2, high)}
            rows_.append((n, nodes[n][0], cuts[n][0], inner[n][0] if n in inner else 0, number, number + 1))
            number += 2
        level = F.broadcast(work.sparkSession.createDataFrame(rows_, "node int, dim int, cut long, inner long, l int, r int"))
        key = F.element_at("keys", F.col("dim") + 1)
        left = (key < F.col("cut")) | ((key == F.col("cut")) & (F.col("ident") < F.col("inner")))
        work = cut_lineage(work.join(level, "node", "left").select("row", "w", "keys", "ident", F.when(F.col("cut").isNull(), F.col("node")).when(left, F.col("l")).otherwise(F.col("r")).alias("node")))
        live = following
    spark = work.sparkSession
    final = F.broadcast(spark.createDataFrame(list(leaves.items()) or [(0, 0)], "node int, shard int"))
    # Slots: a shard's points in buckets of some 20,000; each bucket starts where those before it end.
    dealt = work.join(final, "node").withColumn("bucket", F.pmod("ident", F.lit(max(1, math.ceil(rows / shards / 20_000)))))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("ident", *[F.col(f"row.`{c}`") for c in ident]))
    return dealt.join(starts, ["shard", "bucket"]).select("row.*", "shard", (F.col("start") + inside - 1).alias("slot"))
