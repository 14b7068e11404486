"""Quality of documents: a Bradley-Terry ranking learned from preference pairs, cut at a quantile of its scores.

A document is described by its writing, not its words: how often each kind of character follows each other kind, how words and lines
run, how much of a stretch repeats itself. Every document labelled 1 is preferred to every one labelled 0; the model's worth of
a document is linear in its description and makes the preferred one of a pair win with the logistic function of the difference
of worths. The cut is the worth below which the labelled rows leave as large a share as bears the label 0, and a document's
score is its chance to win against a document at the cut.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.quantiles import order_statistics
from ..session import cut_lineage
from .words import mix, pieces

#: Bounds of the fit: labelled documents of either label that are described, and pairs that are drawn of them.
SAMPLE, PAIRS = 5000, 60_000
#: Bytes of a stretch of a text that is looked at for repeats, and of stretches described together.
STRETCH, TOGETHER = 1 << 14, 1 << 19
RIDGE, STEPS = 20.0, 30
#: Kinds of bytes; what isn't named is a letter beyond ASCII.
KINDS = {"space": b" \t", "line": b"\n\r\v\f", "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789",
         "stop": b".!?", "pause": b",;:", "quote": b"'\"`", "bar": b"|/\\", "hyphen": b"-_", "open": b"([{<", "close": b")]}>",
         "dollar": b"$&@%", "hash": b"#*+=~^", "other": bytes([*range(9), *range(14, 32), 127])}
_KIND = np.full(256, len(KINDS), np.int64)
for _n, _set in enumerate(KINDS.values()):
    _KIND[list(_set)] = _n
K = len(KINDS) + 1
_SPACE, _LINE = 0, 1
#: Counts of a text: pairs of kinds, then bytes, words, short and long words, distinct words, lines, distinct lines, lines without a stop at the end.
COUNTS = K * K + 8
FEATURES = K * K + K + 8


def _runs(between: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that don't part; a run also ends where a stretch begins."""
    inside = ~between
    before = np.concatenate([[False], inside[:-1]]) & ~first
    after = np.concatenate([inside[1:] & ~first[1:], [False]])
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _distinct(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, stretch: np.ndarray, n: int) -> np.ndarray:
    """Distinct runs in each stretch, told apart by length and bytes."""
    key = mix((sums[ends] - sums[starts]) * np.uint64(31) + (ends - starts).astype(np.uint64))
    seen = np.unique(np.column_stack([stretch.astype(np.uint64), key]), axis=0)[:, 0]
    return np.bincount(seen.astype(np.int64), minlength=n)


def _counts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of each stretch of data; first marks where stretches begin."""
    kind, stretch = _KIND[data], np.cumsum(first) - 1
    n = int(stretch[-1]) + 1
    out = np.zeros((n, COUNTS))
    follows = np.flatnonzero(~first[1:])
    place = stretch[follows] * (K * K) + kind[follows] * K + kind[follows + 1]
    out[:, :K * K] = np.bincount(place, minlength=n * K * K).reshape(n, -1)
    out[:, K * K] = np.bincount(stretch, minlength=n)
    begin = np.flatnonzero(first)
    at = np.arange(len(data)) - begin[stretch]
    for column, parts in ((1, kind <= _LINE), (5, kind == _LINE)):
        starts, ends = _runs(parts, first)
        if not len(starts):
            continue
        # A run's sum: each byte times a multiplier of its place in the run.
        run = np.zeros(len(data), np.int64)
        run[starts] = 1
        run = np.cumsum(run) - 1
        place = (np.arange(len(data)) - starts[np.maximum(run, 0)]).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(place * np.uint64(257) + data))])
        of, length = stretch[starts], ends - starts
        out[:, K * K + column] = np.bincount(of, minlength=n)
        if column == 1:
            out[:, K * K + 2] = np.bincount(of, length <= 3, minlength=n)
            out[:, K * K + 3] = np.bincount(of, length >= 12, minlength=n)
            out[:, K * K + 4] = _distinct(sums, starts, ends, of, n)
        else:
            out[:, K * K + 6] = _distinct(sums, starts, ends, of, n)
            out[:, K * K + 7] = np.bincount(of, kind[ends - 1] != list(KINDS).index("stop"), minlength=n)
    return out


def describe(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text. A null text is described like an empty one. Texts are counted in stretches from their own start,
    so that neither what stands beside a text nor its length changes how much is held."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    sums = np.zeros((len(texts), COUNTS))
    size = np.diff(offsets)
    stretches = -(-size // STRETCH)
    of = np.repeat(np.arange(len(texts)), stretches)
    begin = offsets[of] + (np.arange(len(of)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * STRETCH
    end = np.minimum(begin + STRETCH, offsets[of + 1]) if len(of) else begin
    for a in range(0, len(of), TOGETHER // STRETCH):
        b = min(len(of), a + TOGETHER // STRETCH)
        first = np.zeros(end[b - 1] - begin[a], bool)
        first[begin[a:b] - begin[a]] = True
        np.add.at(sums, of[a:b], _counts(data[begin[a]:end[b - 1]], first))
    return _features(sums)


def _features(c: np.ndarray) -> np.ndarray:
    pairs, (size, words, short, long, distinct, lines, different, open_) = c[:, :K * K], c[:, K * K:].T
    follow = np.maximum(pairs.sum(1), 1)[:, None]
    out = np.zeros((len(c), FEATURES))
    out[:, :K * K] = np.sqrt(pairs / follow)
    out[:, K * K:K * K + K] = np.sqrt(pairs.reshape(-1, K, K).sum(2) / follow)
    w, n = np.maximum(words, 1), np.maximum(lines, 1)
    out[:, K * K + K:] = np.column_stack([np.log1p(size), np.log1p(words), size / w / 8, short / w, long / w, distinct / w, different / n, open_ / n])
    return out


@dataclass(frozen=True)
class Model:
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def worth(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.middle) / self.scale, -8, 8) @ self.weights


def train(features: np.ndarray, labels: np.ndarray) -> Model:
    """Newton steps on the logistic loss of differences between a preferred and another document. Each document meets partners of the
    other label in turn, by a fixed draw. Without documents of both labels all worths are 0."""
    features = np.asarray(features, float).reshape(len(labels), FEATURES)
    middle = features.mean(0) if len(labels) else np.zeros(FEATURES)
    scale = features.std(0) if len(labels) else np.ones(FEATURES)
    model = Model(middle, np.where(scale > 1e-4, scale, np.inf), np.zeros(FEATURES))
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return model
    z = np.clip((features - model.middle) / model.scale, -8, 8)
    rng = np.random.default_rng(11)
    n = min(PAIRS, len(good) * len(bad))
    won, lost = (rng.permutation(np.resize(x, n)) for x in (good, bad))
    w = np.zeros(FEATURES)
    for _ in range(STEPS):
        slope, curve = -RIDGE * w, RIDGE * np.eye(FEATURES)
        for a in range(0, n, 4096):
            d = z[won[a:a + 4096]] - z[lost[a:a + 4096]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            slope += d.T @ p
            curve += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.middle, model.scale, w)


def in_held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from; a null id has none to learn."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y) to learn from: of unequal labels of a document the lower one counts; null labels and ids teach nothing."""
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    return rows.where(~in_held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Trained on at most SAMPLE documents of each label that aren't held out, the first by a hash of their ids. Tasks describe them; the driver
    gets descriptions alone, of a fixed width. Null texts teach nothing; of rows that repeat an id the one with the least description
    teaches."""
    known = _known(labels, id_col, label_col).withColumn("h", F.xxhash64("id"))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy("h", "id").limit(SAMPLE).collect()]
    chosen = docs.sparkSession.createDataFrame(chosen, known.schema)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            f = describe(b.column(2)).astype(np.float32)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x.tobytes() for x in f], pa.binary())], ["h", "y", "f"])
    # The sample's bound keeps the broadcast ids few.
    found = rows.join(F.broadcast(chosen), "id").select("h", "y", "text").mapInArrow(run, "h long, y int, f binary")
    taken = found.groupBy("h", "y").agg(F.min("f").alias("f")).toPandas().sort_values(["h", "f"])
    return train(np.frombuffer(b"".join(taken.f), np.float32).reshape(len(taken), FEATURES), taken.y.to_numpy())


def worths(df: DataFrame, model: Model, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, worth) of each row's whole text; only the key travels with it."""
    rows = df.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.record_batch([b.column(0), pa.array(model.worth(describe(b.column(1))))], ["key", "worth"])
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, worth double")


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, worth, score, predicted) for every row of docs: score from 0 to 1, predicted 1 from 0.5.

    Null and empty texts are rated like any other description; repeated rows are rated alike; other columns are not looked at. The
    cut is a quantile over all labelled documents that aren't held out, found by exact selection. With no label 0 (or none
    at all) no document lies below the cut; with no label 1 none above.
    """
    known = _known(labels, id_col, label_col)
    model = fit(docs, labels, id_col, text_col, label_col)
    rated = cut_lineage(worths(docs, model, id_col, text_col))
    share = known.agg(F.avg(1.0 - F.col("y"))).first()[0]
    cut = 0.0
    if share:
        marked = rated.join(known.withColumnRenamed("id", "key"), "key").groupBy("key").agg(F.min("worth").alias("worth"))
        # Halfway between the last worth below the share and the first above.
        n = marked.count()
        at = max(1, min(n - 1, round(share * n)))
        low, high = order_statistics(marked, "worth", [at - 1, at]) if n > 1 else (0.0, 0.0)
        cut = (low + high) / 2 if share < 1 else float("inf")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("worth") - cut))))
    return rated.select(F.col("key").alias("id"), in_held_out(F.col("key")).alias("held_out"), "worth", score.alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
