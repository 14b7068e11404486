"""Scoring a boosted-tree ensemble held as a table of nodes."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .lookup import fits

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.StringType()), T.StructField("threshold", T.FloatType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("default_left", T.BooleanType()), T.StructField("leaf", T.FloatType())])

# Up to this many nodes the ensemble becomes one code-generated expression.
EXPRESSION_NODES = 400
# Trees of one Arrow pass; more nodes mean more passes that carry the running sum.
NODES_PER_PASS = 2_000_000


@dataclass(frozen=True)
class TreeModel:
    """Node table, feature order and the score every row starts from."""
    nodes: DataFrame
    features: list[str]
    base_score: float


def load_model(spark: SparkSession, path: str) -> TreeModel:
    """Read a model in the boosted-tree library's JSON format into a node table."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    head = doc.select(
        F.expr("variant_get(v, '$.learner.feature_names', 'array<string>')").alias("names"),
        F.regexp_replace(F.expr("variant_get(v, '$.learner.learner_model_param.base_score', 'string')"),
                         r"[\[\]]", "").cast("double").alias("base")).first()
    trees = doc.select("v", F.posexplode(F.expr(
        "variant_get(v, '$.learner.gradient_booster.model.trees', 'array<variant>')")).alias("tree", "t"))
    columns = {"left": ("left_children", "array<int>"), "right": ("right_children", "array<int>"),
               "index": ("split_indices", "array<int>"), "value": ("split_conditions", "array<float>"),
               "default": ("default_left", "array<int>")}
    arrays = trees.select("tree", *[F.expr(f"variant_get(t, '$.{name}', '{kind}')").alias(c)
                                    for c, (name, kind) in columns.items()])
    split = F.col("n.left") >= 0
    names = F.array(*[F.lit(n) for n in head["names"]])
    nodes = (arrays.select("tree", F.posexplode(F.arrays_zip(*columns)).alias("node", "n"))
             .select(F.col("tree"), F.col("node"),
                     F.when(split, F.get(names, F.col("n.index"))).alias("feature"),
                     F.when(split, F.col("n.value")).alias("threshold"),
                     F.when(split, F.col("n.left")).alias("left"), F.when(split, F.col("n.right")).alias("right"),
                     F.when(split, F.col("n.default") != 0).alias("default_left"),
                     F.when(~split, F.col("n.value")).alias("leaf")))
    return TreeModel(nodes, list(head["names"]), float(head["base"]))


def check_model(model: TreeModel, expected_trees: int | None, columns: list[str]) -> None:
    """Refuse a model whose tree count, names or order differ from the metadata."""
    found = model.nodes.agg(F.count_distinct("tree").alias("n"),
                            F.array_sort(F.collect_set("feature")).alias("used")).first()
    if expected_trees is not None and found["n"] != expected_trees:
        raise ValueError(f"model has {found['n']} trees, metadata says {expected_trees}")
    if model.features != list(columns):
        raise ValueError("model features differ from the metadata columns")
    unknown = sorted(set(found["used"]) - set(columns))
    if unknown:
        raise ValueError(f"model splits on unknown features: {unknown}")


def tree_check(model: TreeModel, columns: list[str]) -> DataFrame:
    """One row: tree and node counts, and split features the column list lacks."""
    known = F.array(*[F.lit(c) for c in columns])
    return model.nodes.agg(F.count_distinct("tree").alias("trees"), F.count("*").alias("nodes"),
                           F.count("leaf").alias("leaves"),
                           F.concat_ws(",", F.array_sort(F.array_except(F.collect_set("feature"), known))).alias("unknown_features"))


def _tree_expression(nodes: dict[int, T.Row], at: int) -> Column:
    n = nodes[at]
    if n["feature"] is None:
        return F.lit(n["leaf"]).cast("float")
    left, right = _tree_expression(nodes, n["left"]), _tree_expression(nodes, n["right"])
    x, threshold = F.col(n["feature"]).cast("float"), F.lit(n["threshold"]).cast("float")
    # A missing number is below nothing, and NaN lies beyond infinity; one test a split keeps the generated method small enough to be compiled.
    if n["default_left"]:
        return F.when(x.between(threshold, F.lit(float("inf")).cast("float")), right).otherwise(left)
    return F.when(x < threshold, left).otherwise(right)


def _score_expression(rows: list[T.Row], base_score: float) -> Column:
    trees: dict[int, dict[int, T.Row]] = {}
    for r in rows:
        trees.setdefault(r["tree"], {})[r["node"]] = r
    total = F.lit(base_score).cast("float")
    for tree in sorted(trees):
        total = total + _tree_expression(trees[tree], 0)
    return total


class _Forest:
    """Nodes of all trees one after another, so memory follows their number and not the widest tree; walked a level at a time for a whole
    Arrow batch."""

    def __init__(self, nodes: pd.DataFrame, features: list[str]):
        nodes = nodes.sort_values(["tree", "node"])
        order = {name: i for i, name in enumerate(features)}
        tree = nodes["tree"].to_numpy(np.int64)
        key = (tree << 32) | nodes["node"].to_numpy(np.int64)
        split = nodes["feature"].notna().to_numpy()

        def places(children: pd.Series) -> np.ndarray:
            # Leaves point to themselves, so walking past them changes nothing.
            out = np.arange(len(key), dtype=np.int32)
            out[split] = np.searchsorted(key, (tree[split] << 32) | children.to_numpy(np.float64, na_value=0)[split].astype(np.int64))
            return out

        self.left, self.right = places(nodes["left"]), places(nodes["right"])
        self.feature = nodes["feature"].map(order).fillna(0).to_numpy(np.int32)
        self.threshold = nodes["threshold"].fillna(0).to_numpy(np.float32)
        self.default_left = nodes["default_left"].eq(True).to_numpy(bool)
        self.leaf = nodes["leaf"].fillna(0).to_numpy(np.float32)
        self.roots = np.flatnonzero(np.diff(tree, prepend=-1)).astype(np.int32)
        self.depths = self._depths(split)

    def _depths(self, split: np.ndarray) -> np.ndarray:
        """Levels below each root, all trees gone down together."""
        level, owner, depths = self.roots, np.arange(len(self.roots)), np.zeros(len(self.roots), np.int32)
        while (inner := split[level]).any():
            level, owner = level[inner], owner[inner]
            depths[np.unique(owner)] += 1
            level, owner = np.concatenate([self.left[level], self.right[level]]), np.concatenate([owner, owner])
        return depths

    def add_to(self, total: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Add every tree's leaf in tree order, in single precision."""
        values, first = x.ravel(), np.arange(len(x)) * x.shape[1]
        for root, depth in zip(self.roots, self.depths):
            node = np.full(len(x), root, np.int32)
            for _ in range(depth):
                v = values[first + self.feature[node]]
                go_left = (v < self.threshold[node]) | (np.isnan(v) & self.default_left[node])
                node = np.where(go_left, self.left[node], self.right[node])
            total = total + self.leaf[node]
        return total


def _arrow_pass(spark: SparkSession, nodes: pd.DataFrame, features: list[str]):
    shared = spark.sparkContext.broadcast(_Forest(nodes, features))

    @F.pandas_udf(T.FloatType())
    def add_trees(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest = shared.value
        for start, wanted, *columns in batches:
            total = start.to_numpy(np.float32, na_value=np.nan).copy()
            mask = wanted.to_numpy(bool)
            x = np.column_stack([c.to_numpy(np.float32, na_value=np.nan)[mask] for c in columns])
            total[mask] = forest.add_to(total[mask], x)
            yield pd.Series(np.where(mask, total, np.float32(np.nan)))

    return add_trees


Scorer = Callable[[DataFrame, str, Column], DataFrame]


def prepare_scorer(model: TreeModel, expression_nodes: int = EXPRESSION_NODES,
                   nodes_per_pass: int = NODES_PER_PASS) -> Scorer:
    """Measure the ensemble once and choose how to score it.

    The scorer adds the FLOAT score; rows failing the condition get NULL and are
    not walked.  Small ensembles stay inside code generation.  Larger ones go
    through Arrow batches with the nodes broadcast, in as many passes of bounded
    size as the ensemble needs; the running single-precision sum keeps tree order.
    """
    if fits(model.nodes, expression_nodes):
        total = _score_expression(model.nodes.collect(), model.base_score)
        return lambda df, output, wanted: df.withColumn(output, F.when(wanted, total))
    sizes = model.nodes.groupBy("tree").agg(F.count("*").alias("n")).orderBy("tree").toPandas()
    passes = []
    for _, part in sizes.groupby(sizes["n"].cumsum() // nodes_per_pass):
        nodes = model.nodes.filter(F.col("tree").between(int(part["tree"].min()), int(part["tree"].max()))).toPandas()
        passes.append(_arrow_pass(model.nodes.sparkSession, nodes, model.features))

    def by_arrow(df: DataFrame, output: str, wanted: Column) -> DataFrame:
        out = df.withColumns({"__wanted": wanted, output: F.lit(model.base_score).cast("float")})
        for add in passes:
            out = out.withColumn(output, add(F.col(output), F.col("__wanted"),
                                             *[F.col(f).cast("float") for f in model.features]))
        return out.withColumn(output, F.when(F.col("__wanted"), F.col(output))).drop("__wanted")

    return by_arrow


def score_trees(df: DataFrame, model: TreeModel, output: str = "score", where: Column | None = None,
                **bounds: int) -> DataFrame:
    """Score a frame once; `prepare_scorer` serves repeated use."""
    return prepare_scorer(model, **bounds)(df, output, F.lit(True) if where is None else where)
