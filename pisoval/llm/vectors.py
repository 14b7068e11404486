"""Checked vectors as bytes, shared by the operators on embeddings."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def checked(df: DataFrame, id_col: str, vector_col: str, *keep: str) -> DataFrame:
    """(id, vec, *keep): vec holds the components as bytes (doubles), null where the vector takes no part: it is null, empty or
    zero, holds a null or non-finite component, or hasn't the length that most vectors have (the smaller one, if tied)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    lengths = df.select(F.size(v).alias("n")).where("n > 0").groupBy("n").count()
    usual = lengths.orderBy(F.desc("count"), "n").limit(1).first()
    fits = F.size(v) == (usual["n"] if usual else -1)
    ok = fits & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(ok, v).alias("v"), *[F.col(f"`{c}`") for c in keep])

    def run(batches):
        for b in batches:
            lists = b.column(1)
            values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            raw = [values[e - k:e].tobytes() if k else None for e, k in zip(ends, n)]
            yield pa.record_batch([b.column(0), pa.array(raw, pa.binary()), *b.columns[2:]], ["id", "vec", *keep])
    extra = "".join(f", `{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(run, f"id long, vec binary{extra}")


def matrix(raw) -> np.ndarray:
    """Rows of bytes as a matrix of doubles."""
    raw = list(raw)
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.empty((0, 0))
