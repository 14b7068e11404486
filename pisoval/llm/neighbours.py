"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

A rotation is learned on a bounded sample (principal axes, then the rotation that best aligns the vectors with the corners of
a cube); a vector's code is the signs of its rotated components. Each shard of rows indexes every substring of its codes. A
query probes, in each substring, the values within floor(radius / substrings) flips: by the pigeonhole principle these hold
every code within the radius. Codes found are checked for the whole radius, and the inner products of the original vectors, in
double precision, rank what is left. Shards find their own nearest; one more step merges them.

Codes know directions only, so a shard keeps an index for each band of lengths, each reaching down to half its longest vector. A query
goes from the longest band to the shortest. What it has found bounds the cosine by which a band's vectors could still be among
the nearest: no band is searched that would need more than 1, and a band is searched again by the radius that this cosine asks for
where the common radius was smaller. A query that finds fewer than k in a shard widens its radius there until it has k or has
seen the whole shard.
"""
from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .vectors import checked, matrix

#: Vectors the rotation is learned on, bits of a substring, rows of a shard, queries of a block.
SAMPLE, SUBSTRING, SHARD, BLOCK = 20_000, 8, 8192, 4096
#: Share of a code's bits that the radius spans. Vectors at cosine 0.3 differ in about 40 of 100 bits.
RADIUS = 0.47
#: Deviations of a code's distance beyond its mean that a radius made for a cosine allows.
DEVIATIONS = 1.3


def learn_rotation(x: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Principal axes of x, rotated so that signs lose as little as possible. Deterministic."""
    d = x.shape[1]
    _, axes = np.linalg.eigh(x.T @ x / max(len(x), 1))
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(7).standard_normal((d, d)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """(rows, substrings) of the sign bits."""
    return np.packbits(x @ rotation >= 0, axis=1)


@lru_cache(64)
def _flips(within: int) -> np.ndarray:
    """Masks of a substring with at most so many bits set."""
    return np.array([sum(1 << b for b in c) for n in range(min(within, SUBSTRING) + 1) for c in combinations(range(SUBSTRING), n)], np.uint8)


class Index:
    """One shard: for every substring, rows ordered by its value and where each value begins."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes(x, rotation)
        self.order = [np.argsort(c, kind="stable") for c in self.codes.T]
        self.first = [np.searchsorted(c[o], np.arange((1 << SUBSTRING) + 1)) for c, o in zip(self.codes.T, self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most `radius` bits."""
        seen = np.zeros(len(self.ids), bool)
        masks = _flips(radius // len(self.order))
        if len(masks) == 1 << SUBSTRING or len(seen) <= len(masks):
            seen[:] = True  # as many probes as values, or as rows
        else:
            for c, order, first in zip(code, self.order, self.first):
                probe = masks ^ c
                for a, b in zip(first[probe], first[probe.astype(int) + 1]):
                    seen[order[a:b]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1, dtype=np.int64) <= radius]


class Shard:
    """Indexes of a shard's bands of lengths, the longest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray):
        lengths = np.linalg.norm(x, axis=1)
        band = np.frexp(lengths.max() / lengths)[1] if len(x) else np.empty(0, int)
        # Equal lengths that differ by rounding are one band: quotients from 1 to below 2 have the same exponent.
        rows = [np.flatnonzero(band == b) for b in np.unique(band)]
        self.bands = [(float(lengths[r].max()), Index(ids[r], x[r], rotation)) for r in rows]
        self.bits = rotation.shape[1] // SUBSTRING * SUBSTRING + (SUBSTRING if rotation.shape[1] % SUBSTRING else 0)

    def search(self, q: np.ndarray, own: int, code: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        size = float(np.linalg.norm(q))
        best = (np.empty(0, np.int64), np.empty(0))
        done = [-1] * len(self.bands)
        held: list[tuple[np.ndarray, np.ndarray]] = [best] * len(self.bands)

        def look(at: int, within: int) -> None:
            nonlocal best
            index = self.bands[at][1]
            rows = index.within(code, within)
            rows = rows[index.ids[rows] != own]
            held[at], done[at] = (index.ids[rows], index.x[rows] @ q), within
            ids, scores = (np.concatenate(c) for c in zip(*held))
            first = np.lexsort((ids, -scores))[:k]
            best = ids[first], scores[first]

        def needed(at: int) -> int:
            """The radius for what may still be among the nearest; below 0 if nothing may."""
            if len(best[0]) < k:
                return radius
            cosine = best[1][-1] / (size * self.bands[at][0])
            if cosine > 1 + 1e-9:
                return -1
            share = np.arccos(np.clip(cosine, -1, 1)) / np.pi
            return min(self.bits, int(self.bits * share + DEVIATIONS * np.sqrt(self.bits * share * (1 - share))))

        for at in range(len(self.bands)):
            if needed(at) >= 0:
                look(at, radius)
        for at in range(len(self.bands)):
            if needed(at) > done[at]:
                look(at, needed(at))
        while len(best[0]) < k and radius < self.bits:
            radius = min(self.bits, radius + max(1, self.bits // 16))
            for at in range(len(self.bands)):
                if radius > done[at]:
                    look(at, radius)
        return best


def nearest(df: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", radius: float = RADIUS) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found by inner product, ties to the smaller id; all other rows if fewer.

    queries: a condition on `id`. Vectors that are null or zero, hold a null or non-finite component or have another length than
    most take no part. Copies of a vector under other ids are candidates like any other. Rows with a null id take no part. Rows
    that repeat an id are one candidate with the first of their vectors (by bytes), as an id can be returned only once. Rows
    fall into shards by hash, queries into blocks; each task holds one shard of about 8,192 rows and one block of 4,096 queries.
    """
    base = checked(df, id_col, vector_col).where("vec is not null and id is not null").groupBy("id").agg(F.min("vec").alias("vec"))
    base = cut_lineage(base)
    count = base.count()
    sample = matrix(r["vec"] for r in base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect())
    bits = sample.shape[1] if len(sample) else 0
    rotation = learn_rotation(sample) if bits else np.empty((0, 0))
    # Code bits are as many as dimensions; substrings are whole bytes, the last one padded with zeros in all codes alike.
    reach = int(radius * bits)
    asked = base.where(queries)
    shards, blocks = max(1, -(-count // SHARD)), max(1, -(-asked.count() // BLOCK))
    put = lambda c, n, salt: F.pmod(F.xxhash64(F.col(c), F.lit(salt)), F.lit(n)).cast("int")
    rows = base.withColumn("shard", put("id", shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", put("id", blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            mine = mine.sort_values("id")
            index = Shard(mine["id"].to_numpy(), matrix(mine["vec"]), rotation)
            q = matrix(theirs["vec"])
            for own, x, code in zip(theirs["id"].to_numpy(), q, codes(q, rotation)):
                ids, scores = index.search(x, own, code, k, reach)
                out.append(pd.DataFrame({"query_id": own, "id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    found = rows.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
