"""Exact order statistics by refining bins: every pass returns bounded counts, and no value column is gathered or sorted."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BINS = 1024
#: More than the logarithm to base 2 of any finite double can be away from 0.
_FAR = 1200.0


def _level(v: Column) -> Column:
    """A number that grows with v and spreads magnitudes evenly."""
    size = F.least(F.log2(F.abs(v)) + _FAR, F.lit(2 * _FAR))
    return F.when(v == 0, 0.0).when(v > 0, size).otherwise(-size)


def _bin(v: Column, low: Column, high: Column, by_level: bool) -> Column:
    """Bin of v between low and high; the ends have bins of their own, so that a pass always splits what differs."""
    if by_level:
        v_, low_, high_ = _level(v), _level(low), _level(high)
    else:
        # Halved, as the distance of two finite numbers can overflow.
        v_, low_, high_ = v / 2, low / 2, high / 2
    part = F.try_divide(v_ - low_, high_ - low_)
    inner = F.coalesce(F.when(~F.isnan(part), part), F.lit(0.5))
    place = 1 + F.floor(F.least(F.greatest(inner, F.lit(0.0)), F.lit(1.0)) * (BINS - 3)).cast("int")
    return F.when(v == low, 0).when(v == high, BINS - 1).otherwise(place)


def ranked_values(pairs: DataFrame, ranks: dict[str, Sequence[int]], name: str = "variable", value: str = "valor", weight: str | None = None) -> dict[str, dict[int, float]]:
    """Per name, the values at the given ranks (from 0, in ascending order) among rows (name, value), each counted `weight` times.

    A pass counts the rows of every open interval in BINS bins, alternately of equal width and of equal spread of magnitude, and
    keeps the bin that holds the rank, shrunk to the values found in it; an interval ends when its least and greatest value agree.
    So the number of passes follows from the precision of a double (about eight at the most), not from the number of rows, and
    what comes back is bounded by names, ranks and bins. Null and NaN values don't count.
    """
    spark = pairs.sparkSession
    v = F.col(value).cast("double")
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = pairs.select(F.col(name).alias("n"), v.alias("v"), times.alias("w")).where("v is not null and not isnan(v)")
    found: dict[str, dict[int, float]] = {n: {} for n in ranks}
    # Open intervals by (name, low, high): rows below them, and the ranks looked for inside.
    ends = rows.groupBy("n").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("all"))
    open_ = [(r["n"], r["low"], r["high"], 0, [k for k in ranks[r["n"]] if 0 <= k < r["all"]]) for r in ends.collect() if r["n"] in ranks]
    turn = 0
    while open_:
        for n, low, _, _, inside in (x for x in open_ if x[1] == x[2]):
            found[n].update({k: low for k in inside})
        open_ = [x for x in open_ if x[1] != x[2] and x[4]]
        if not open_:
            break
        limits = spark.createDataFrame([(n, low, high, i) for i, (n, low, high, _, _) in enumerate(open_)], "n string, low double, high double, i int")
        infinite = any(math.isinf(x) for o in open_ for x in o[1:3])
        met = rows.join(F.broadcast(limits), (rows["n"] == limits["n"]) & rows["v"].between(limits["low"], limits["high"]))
        bins = met.groupBy("i", _bin(F.col("v"), F.col("low"), F.col("high"), infinite or turn % 2 == 1).alias("b")).agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("count"))
        parts: dict[int, list] = {}
        for r in sorted(bins.collect(), key=lambda r: (r["i"], r["low"])):
            parts.setdefault(r["i"], []).append(r)
        narrower = []
        for i, (n, _, _, below, inside) in enumerate(open_):
            for r in parts[i]:
                here = [k for k in inside if below <= k < below + r["count"]]
                if here:
                    narrower.append((n, r["low"], r["high"], below, here))
                below += r["count"]
        open_, turn = narrower, turn + 1
    return found


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int]) -> list[float | None]:
    """The values of one column at the given ranks; None beyond the last."""
    found = ranked_values(df.select(F.lit("").alias("variable"), F.col(f"`{value}`").alias("valor")), {"": list(ranks)})
    return [found[""].get(k) for k in ranks]


def quantile_ranks(n: int, share: float) -> tuple[int, int, float]:
    """Ranks around a continuous quantile of n values and the upper one's share."""
    at = share * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def between(low: float, high: float, share: float) -> float:
    """The value at `share` of the way from low to high."""
    return low if low == high else (1 - share) * low + share * high
