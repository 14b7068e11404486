"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a code of 60 random-hyperplane bits; vectors are ordered by it across the cluster, and each is
compared with the neighbours in a bounded window. The number of passes follows from the number of vectors, so that a pair at the
threshold shares its first bits in no pass about once in 100,000 times, however the vectors lie. Vectors that share these bits
are a run; a window spans the usual run. Longer runs, which dense groups make, are compared whole, block against block, unless
the windows have already brought all their vectors together; only pairs that join components leave the task. Verified
neighbours are united across passes. The links of each component are then counted whole, block against block, which emits
counts and no pairs. All cosines are in double precision on the original vectors.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .graph import components
from .vectors import checked, matrix

THRESHOLD, WINDOW, BITS, MISS, CHUNK, BLOCK, WIDE = 0.95, 64, 60, 1e-5, 512, 1024, 2048


def prefix_for(n: int) -> int:
    """First bits of a code by which evenly spread vectors fall into runs of half a window."""
    return min(BITS, max(1, math.ceil(math.log2(max(2, n) / (WINDOW / 2)))))


def passes_for(n: int, threshold: float = THRESHOLD) -> int:
    """Passes after which a pair at the threshold has shared a run but for a chance of MISS."""
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    hit = agree ** prefix_for(n)
    return max(4, math.ceil(math.log(MISS) / math.log(1 - min(hit, 0.999))))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def _code(passes: int, prefix: int | None = None):
    """The codes of every pass, with the vectors; with a prefix, the runs of that many bits without them."""
    def run(batches):
        planes = None
        for b in batches:
            x = matrix(b.column(1).to_pylist())
            if not len(x):
                continue
            if planes is None:
                planes = np.random.default_rng(11).standard_normal((x.shape[1], passes * BITS))
            for lo in range(0, len(x), 2048):
                bits = unit(x[lo:lo + 2048]) @ planes >= 0
                for p in range(passes):
                    own = bits[:, p * BITS:(p + 1) * BITS]
                    code = own @ (np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1])
                    part = b.slice(lo, len(own))
                    if prefix:
                        yield pa.record_batch([pa.array(np.full(len(own), p, np.int32)), pa.array(code >> (BITS - prefix)), part.column(0)], ["pass", "run", "v"])
                        continue
                    yield pa.record_batch([pa.array(np.full(len(own), p, np.int32)), pa.array(code), part.column(0), part.column(1)], ["pass", "code", "v", "vec"])
    return run


def _spanning(v: np.ndarray, x: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Enough verified pairs of rows at most WINDOW apart to hold together what all of them hold together."""
    near = np.triu(x @ x.T >= threshold, 1)
    i, j = np.nonzero(near)
    ok = j - i <= WINDOW
    i, j = i[ok], j[ok]
    if not len(i):
        return []
    label = np.arange(len(v))
    pairs = []
    for a, b in zip(i, j):  # union by relabelling: rows of a chunk are few
        if label[a] != label[b]:
            pairs.append((v[a], v[b]))
            label[label == label[b]] = label[a]
    return pairs


def _windows(threshold: float):
    """Sorted rows of a partition: verified pairs, and the rows at both ends for the comparison across partitions."""
    names = ["a", "b", "border", "vec"]

    def pack(pairs):
        a, b = ([p[i] for p in pairs] for i in (0, 1))
        none = [None] * len(pairs)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], names)

    def border(rows, at):
        v, raw, order = rows
        return pa.record_batch([pa.array(v, pa.int64()), pa.array(order, pa.int64()), pa.array([at] * len(v), pa.int64()), pa.array(raw, pa.binary())], names)

    def run(batches):
        at = TaskContext.get().partitionId()
        tail, turn, head = ([], [], None), None, ([], [])
        for batch in batches:
            turns = batch.column(0).to_numpy()
            v, raw = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cuts = np.flatnonzero(np.diff(turns)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(turns)]):
                if turns[lo] != turn:
                    if turn is None:
                        head = ([], [], int(turns[lo]))
                    tail, turn = ([], [], None), turns[lo]
                for a in range(lo, hi, CHUNK):
                    rv, rr = tail[0] + v[a:min(a + CHUNK, hi)], tail[1] + raw[a:min(a + CHUNK, hi)]
                    if pairs := _spanning(np.array(rv), unit(matrix(rr)), threshold):
                        yield pack(pairs)
                    tail = (rv[-WINDOW:], rr[-WINDOW:], None)
                    if turn == head[2] and len(head[0]) < WINDOW:
                        need = WINDOW - len(head[0])
                        head[0].extend(rv[-(min(a + CHUNK, hi) - a):][:need])
                        head[1].extend(rr[-(min(a + CHUNK, hi) - a):][:need])
        if turn is not None:
            # Order within a border: the rows before it, then those after it.
            yield border((head[0], head[1], [head[2] * 1000 + 500 + i for i in range(len(head[0]))]), at - 1)
            yield border((tail[0], tail[1], [int(turn) * 1000 + i for i in range(len(tail[0]))]), at)
    return run


def _joining(pdf: pd.DataFrame, at: int, to: int, threshold: float) -> list[tuple[int, int]]:
    """Verified pairs of two blocks (or of one with itself) that join components; of pairs that join the same ones, one."""
    v, c, x = pdf["v"].to_numpy(), pdf["c"].to_numpy().copy(), unit(matrix(pdf["vec"]))
    first, second = (np.flatnonzero(pdf["block"].to_numpy() == k) for k in (at, to))
    names, many = np.unique(c, return_counts=True)
    rest = c != names[many.argmax()]  # a joining pair has an end outside the commonest component
    pairs = []
    for left, right in ((first[rest[first]], second), (second[rest[second]], first)):
        if not len(left):
            continue
        near = x[left] @ x[right].T >= threshold
        for i, row in zip(left, near):
            js = right[row]
            while len(js := js[c[js] != c[i]]):
                pairs.append((v[i], v[js[0]]))
                c[c == c[js[0]]] = c[i]
    return pairs


def _whole_runs(classes: DataFrame, labels: DataFrame, passes: int, prefix: int, threshold: float) -> DataFrame:
    """Pairs (a, b) that join components and share a run longer than a window spans. Each run is a group of its own, cut into blocks
    whose pairs are separate tasks, or all vectors of such runs are one group, if that is fewer pairs."""
    coded = classes.select("v", "vec").mapInArrow(_code(passes, prefix), "pass int, run long, v long")
    long = cut_lineage(coded.groupBy("pass", "run").agg(F.count("*").alias("size")).where(F.col("size") > WINDOW + 1))
    own = cut_lineage(coded.join(long.select("pass", "run"), ["pass", "run"]).join(labels, "v", "left").select("pass", "run", "v", F.coalesce("component", "v").alias("c")))
    mixed = own.groupBy("pass", "run").agg(F.count("*").alias("size"), F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most")
    mixed = cut_lineage(mixed.select("pass", "run", "size"))
    own = cut_lineage(own.join(mixed, ["pass", "run"]))
    each = mixed.agg(F.sum(F.col("size").cast("double") * F.col("size"))).first()[0] or 0.0
    all_of = own.select("v", "c").distinct()
    if (most := all_of.count()) ** 2 <= each:
        own = all_of.select(F.lit(0).alias("pass"), F.lit(0).cast("long").alias("run"), "v", "c", F.lit(most).cast("long").alias("size"))
    own = own.withColumn("blocks", F.ceil(F.col("size") / WIDE).cast("int")).withColumn("block", F.pmod(F.xxhash64("v", F.lit(5)), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(classes.select("v", "vec"), "v") \
        .select("pass", "run", F.least("block", "other").alias("at"), F.greatest("block", "other").alias("to"), "block", "v", "c", "vec")

    def run(key, pdf):
        return pd.DataFrame(_joining(pdf, key[2], key[3], threshold), columns=["a", "b"]).astype("int64")

    return dealt.groupBy("pass", "run", "at", "to").applyInPandas(run, "a long, b long").distinct()


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of df: (id, n_links, component_id, kept).

    n_links counts other rows within the threshold, copies and rows that repeat an id included; component_id is the smallest id
    that links reach; kept: the row's id is that. A vector that is null, zero, of unusual length or holds a null or non-finite
    component links with nothing and is kept. A null id is compared like the rest and names no component that has another.
    """
    rows = cut_lineage(checked(df, id_col, vector_col))
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = cut_lineage(classes.select(F.xxhash64("vec").alias("v"), "vec", "id", "n"))
    n, spark = classes.count(), df.sparkSession
    passes = passes_for(n, threshold)
    parts = max(1, min(n * passes // (8 * WINDOW), max(spark.sparkContext.defaultParallelism, n * passes // 100_000)))
    coded = classes.select("v", "vec").mapInArrow(_code(passes), "pass int, code long, v long, vec binary").select("pass", "code", "v", "vec")
    ordered = coded.repartitionByRange(parts, "pass", "code", "v").sortWithinPartitions("pass", "code", "v")
    found = cut_lineage(ordered.mapInArrow(_windows(threshold), "a long, b long, border long, vec binary"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("b"), []
        for _, one in pdf.groupby(pdf["b"] // 1000):
            out += _spanning(one["a"].to_numpy(), unit(matrix(one["vec"])), threshold)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    borders = found.where("border is not null").groupBy("border").applyInPandas(across, "a long, b long")
    links = found.where("border is null").select("a", "b").union(borders).distinct()
    links = cut_lineage(links)
    labels = cut_lineage(components(links))
    more = cut_lineage(_whole_runs(classes, labels, passes, prefix_for(n), threshold))
    if not more.isEmpty():
        labels = cut_lineage(components(links.union(more)))

    # Whole count of links: every block of a component against every block of it.
    members = classes.join(labels, "v").withColumn("blocks", F.lit(1))
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    members = classes.join(labels, "v").join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")) \
        .withColumn("at", F.pmod(F.xxhash64("v", F.lit(3)), F.col("blocks")).cast("int"))
    members = cut_lineage(members.select("component", "blocks", "at", "v", "vec", "n"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = members.select("component", "at", other.alias("to"), "v", "vec", "n")
    right = members.select("component", other.alias("at"), F.col("at").alias("to"), "v", "vec", "n")

    def count(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"v": [], "links": []}).astype("int64")
        near = unit(matrix(a["vec"])) @ unit(matrix(b["vec"])).T >= threshold
        near[a["v"].to_numpy()[:, None] == b["v"].to_numpy()[None, :]] = False
        return pd.DataFrame({"v": a["v"], "links": near @ b["n"].to_numpy(np.int64)})

    keys = ["component", "at", "to"]
    counts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(count, "v long, links long").groupBy("v").agg(F.sum("links").alias("links"))
    whole = classes.join(labels, "v", "left").join(counts, "v", "left").withColumn("c", F.coalesce("component", "v"))
    whole = cut_lineage(whole.select("vec", "id", "n", "c", F.coalesce("links", F.lit(0)).alias("links")))
    least = whole.groupBy("c").agg(F.min("id").alias("component_id"))
    whole = whole.join(least, "c").select("vec", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    joined = rows.join(whole, "vec", "left")
    root = F.when(F.col("vec").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"),
                         F.col("id").eqNullSafe(root).alias("kept"))
