"""Compression of vectors to codes: integer k-means in every part, with bounds that keep their round.

A vector is cut into parts; each part has a codebook, improved over rounds that assign every part to its nearest entry and
move the entries to the floored means. Arithmetic is on integers, so results don't depend on how rows are dealt.

A part keeps its entry and one bound: how far every other entry was at least when the part was last held against all of them, and
the number of that round. The codebooks of all rounds are kept, so in a later round the other entries can have come nearer by no more than
the farthest of them lies from where it stood in the bound's round. That net displacement (the norm of the sum of the moves) is
never more than the sum of the moves' norms, so fewer parts lose their bound than with accumulated drifts. Only a part whose own entry
isn't nearer than its bound allows is held against all entries again.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_dir, drop_folder, spread

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this after scaling are taken as it, so that squared distances stay within 64 bits.
MOST = 1 << 27
#: Up to here squared distances of a part are whole numbers that doubles hold exactly.
_EXACT = 1 << 21
_ROWS = 4096


@dataclass(frozen=True)
class Codes:
    """rows: (id, label, code, error), one for each vector that takes part; code has one byte a part."""
    rows: DataFrame
    codebooks: np.ndarray           # (parts, entries, width), after the last round
    rescans: list[int] = field(default_factory=list)   # parts held against all entries, in each round

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries), exact."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) <= _EXACT:
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)


def _below(x: np.ndarray) -> np.ndarray:
    """Single precision, never above x."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def moved(history: list[np.ndarray]) -> np.ndarray:
    """(rounds, parts, entries): the farthest that any entry but this one lies from its place in that round."""
    now = history[-1]
    net = np.sqrt(np.stack([((now - then) ** 2).sum(2).astype(float) for then in history]))
    k = net.shape[2]
    if k == 1:
        return np.zeros(net.shape)
    order = np.sort(net, 2)
    return np.where(net == order[:, :, -1:], np.where((net == order[:, :, -1:]).sum(2, keepdims=True) > 1, order[:, :, -1:], order[:, :, -2:-1]), order[:, :, -1:])


def assign(x: np.ndarray, history: list[np.ndarray], code: np.ndarray | None, stamp: np.ndarray | None, bound: np.ndarray | None):
    """Entries of the newest codebooks for rows x (n, parts, width): (code, stamp, bound, squared distance, rescans).

    Equal distances go to the lower index: a part keeps its entry without a look at the others only if all are farther."""
    n, parts, _ = x.shape
    now, t = history[-1], len(history) - 1
    if code is None:
        code, stamp, bound = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.uint8), np.full((n, parts), -1, np.float32)
        far = None
    else:
        code, stamp, bound, far = code.copy(), stamp.copy(), bound.copy(), moved(history)
    distance, rescans = np.zeros((n, parts), np.int64), 0
    for p in range(parts):
        if far is None:
            open_ = np.arange(n)
        else:
            distance[:, p] = ((x[:, p] - now[p][code[:, p]]) ** 2).sum(1)
            least = bound[:, p] - far[stamp[:, p], p, code[:, p]] * (1 + 1e-9) - 1e-6
            open_ = np.flatnonzero(~(np.sqrt(distance[:, p].astype(float)) * (1 + 1e-9) < least))
        if not len(open_):
            continue
        d = _distances(x[open_, p], now[p])
        best = d.argmin(1)
        code[open_, p], stamp[open_, p], distance[open_, p] = best, t, d[np.arange(len(open_)), best]
        if d.shape[1] > 1:
            bound[open_, p] = _below(np.sqrt(np.partition(d, 1, 1)[:, 1].astype(float)))
        else:
            bound[open_, p] = np.inf
        rescans += len(open_)
    return code, stamp, bound, distance, rescans


def sums_of(x: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sums (parts, entries, width) and counts (parts, entries)."""
    n, parts, width = x.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        np.add.at(sums[p], code[:, p], x[:, p])
        counts[p] = np.bincount(code[:, p], minlength=entries)
    return sums, counts


def _whole(lists: pa.Array, scale: int, parts: int, width: int) -> np.ndarray:
    """Vectors as floored integers, filled up with zeros to parts x width."""
    n = len(lists)
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values * float(scale)), -MOST, MOST).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, parts * width - whole.shape[1]))).reshape(n, parts, width)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes for every vector of df but those that are null or empty, hold a null or non-finite component, or haven't the length that most
    vectors have (the smaller one, if tied).

    Each component becomes floor(scale * x); one beyond MOST counts as MOST. A length that parts doesn't divide is filled up with
    zeros. Codebooks begin with the vectors of the smallest ids (null ids last, equal ids by their vectors); of fewer than `entries`
    vectors there are as many entries. Repeated rows count as often as they occur. Other columns are not looked at; an empty table gives no rows.

    Every round reads what the last one wrote into the shared folder, and returns sums of a fixed size for each task.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    lengths = df.select(F.size(v).alias("n")).where("n > 0").groupBy("n").count()
    usual = lengths.orderBy(F.desc("count"), "n").limit(1).first()
    usual = usual["n"] if usual else 0
    width = -(-usual // parts)
    fits = F.coalesce((F.size(v) == usual) & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    kept = df.where(fits).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    label = kept.schema["label"].dataType.simpleString()
    first = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = _whole(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale, parts, width) if first else np.zeros((0, parts, 0), np.int64)
    history = [np.ascontiguousarray(start.transpose(1, 0, 2))]
    if not first:
        return Codes(kept.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), history[-1])
    k = len(first)
    folder = f"{checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    state, rescans = spread(kept), []
    schema = f"id long, label {label}, vec binary, code binary, stamp binary, bound binary, sums array<long>"

    def step(history: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts, looked, kind = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64), 0, None
            for x, b, old in _rows(batches, scale, parts, width):
                kind = b.schema.field("label").type
                code, stamp, bound, _, n = assign(x, history, *old)
                more = sums_of(x, code, k)
                sums, counts, looked = sums + more[0], counts + more[1], looked + n
                columns = [b.column("id"), b.column("label"), *(_binary(a) for a in (x.astype(np.int32), code, stamp, bound)), pa.nulls(len(x), pa.list_(pa.int64()))]
                yield pa.record_batch(columns, ["id", "label", "vec", "code", "stamp", "bound", "sums"])
            if kind is not None:
                total = [sums.ravel().tolist() + counts.ravel().tolist() + [looked]]
                blank = [pa.nulls(1, t) for t in (pa.int64(), kind, *[pa.binary()] * 4)]
                yield pa.record_batch([*blank, pa.array(total, pa.list_(pa.int64()))], ["id", "label", "vec", "code", "stamp", "bound", "sums"])
        return run

    for t in range(rounds):
        state.mapInArrow(step(history), schema).write.parquet(path := f"{folder}/{t}")
        written = spark.read.schema(schema).parquet(path)
        totals = written.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        flat = np.zeros(len(totals), np.int64)
        for r in totals:
            flat[r["pos"]] = r["n"]
        sums, counts = flat[:parts * k * width].reshape(parts, k, width), flat[parts * k * width:-1].reshape(parts, k)
        rescans.append(int(flat[-1]))
        history = [*history, np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], history[-1])]
        state = written.where("sums is null").drop("sums")
        if t:
            drop_folder(spark, f"{folder}/{t - 1}")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, b, old in _rows(batches, scale, parts, width):
            code, _, _, distance, _ = assign(x, history, *old)
            yield pa.record_batch([b.column("id"), b.column("label"), _binary(code), pa.array(distance.sum(1))], ["id", "label", "code", "error"])

    kinds = f"id long, label {label}, code binary, error long"
    state.mapInArrow(last, kinds).write.parquet(path := f"{folder}/codes")
    drop_folder(spark, f"{folder}/{rounds - 1}")
    return Codes(spark.read.schema(kinds).parquet(path), history[-1], rescans)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows).reshape(len(rows), -1)
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, len(rows) * size + 1, size, dtype=np.int32) if size else np.zeros(len(rows) + 1, np.int32)), pa.py_buffer(rows)])


def _rows(batches: Iterator[pa.RecordBatch], scale: int, parts: int, width: int):
    """(vectors, batch, (code, stamp, bound)) in batches of bounded size; the latter are None before the first round."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            b = whole.slice(at, _ROWS)
            if "v" in b.schema.names:
                yield _whole(b.column("v"), scale, parts, width), b, (None, None, None)
            else:
                shaped = [np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(b.num_rows, parts, *shape)
                          for c, kind, shape in (("vec", np.int32, (width,)), ("code", np.uint8, ()), ("stamp", np.uint8, ()), ("bound", np.float32, ()))]
                yield shaped[0].astype(np.int64), b, tuple(shaped[1:])


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error: error summed over rows of an equal label, nulls together. Sums combine before the shuffle, and the rows of a hot
    label, measured as they are written, are split by the skew join."""
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(totals, codes["label"].eqNullSafe(totals["of"]), "left").drop("of")
