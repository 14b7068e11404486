"""Near-duplicate texts by BagMinHash signatures of their shingle multisets.

A text is the multiset of its five-word shingles (lower case, words parted by ASCII white space). Each shingle carries a
Poisson process over (time, component, weight); the weight axis is cut hierarchically into [0, 1), [1, 2), [2, 4), [4, 8) ...,
so a shingle seen w times owns the points below w. The earliest point that falls into a component is its signature value, and
two texts agree in a component with the probability of their weighted Jaccard similarity. Points after a time by which all
components are almost surely filled are never made; a text left with an empty component is done again with twice the time.

Signatures are cut into bands. In each (band, value) bucket every text is compared with one centre, chosen by a hash that
differs from band to band, so a bucket costs its size and not its square. In buckets whose texts did not all come together by
that, texts of different components are then held against each other, block by block inside tasks, by size
and elements; only pairs that join components leave the task. All links are verified on the exact multisets before they count.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .graph import components
from .words import mix, multisets, pieces, shingles, text_keys, word_hashes

WORDS, SIMILARITY, COMPONENTS, BANDS = 5, 0.8, 64, 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, texts: int, m: int = COMPONENTS) -> np.ndarray:
    """(texts, m) signature values; texts without shingles keep zeros."""
    out = np.zeros((texts, m), np.uint64)
    totals = np.bincount(text, weights, texts)
    todo, slack = np.flatnonzero(totals), 3.0
    while len(todo):
        chosen = np.zeros(texts, bool)
        chosen[todo] = True
        own = chosen[text]
        limit = (np.log(m) + slack) / np.maximum(totals, 1)
        filled = _earliest(hashes[own], text[own], weights[own], limit, texts, m, out)
        todo, slack = todo[~filled[todo].all(1)], slack * 2 + np.log(m)
    return out


def _earliest(hashes, text, weights, limit, texts, m, out) -> np.ndarray:
    """Fills `out` for the given elements with points up to `limit`; tells which components got one."""
    level, at, found = 0, np.arange(len(hashes)), []
    while len(at):
        low, length = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        at = at[weights[at] > low]
        live, time = at, np.zeros(len(at))
        state = mix(hashes[live] + np.full(1, level, np.uint64) * _GOLD)
        while len(live):
            state = mix(state + _GOLD)
            time = time - np.log(_uniform(state)) / (m * length)
            on = time < limit[text[live]]
            live, time, state = live[on], time[on], state[on]
            place = mix(state ^ _GOLD)
            hit = low + _uniform(mix(place)) * length < weights[live]
            found.append((text[live][hit] * m + (place[hit] % np.uint64(m)).astype(np.int64), time[hit], state[hit]))
        level += 1
    slot, time, value = (np.concatenate(x) if found else np.empty(0) for x in zip(*found))
    first = np.full(texts * m, np.inf)
    np.minimum.at(first, slot.astype(np.int64), time)
    best = time == first[slot.astype(np.int64)]
    out.reshape(-1)[slot[best].astype(np.int64)] = value[best]
    return np.isfinite(first).reshape(texts, m)


def _bands(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    keys = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        keys = mix(keys * _GOLD + sig[:, j:rows * bands:rows])
    return keys.astype(np.int64)


def _key_of(hashes, counts, texts: pa.Array, ids: pa.Array) -> np.ndarray:
    """64-bit key of the word sequence. A null text is like no other: its key comes from the row's id."""
    keys = text_keys(hashes, counts)
    null = texts.is_null().to_numpy(zero_copy_only=False)
    if null.any():
        from_id = mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64) + _GOLD)
        keys = np.where(null, mix(from_id ^ _GOLD), keys)
    return keys.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 1 << 20):
        ids, texts = b.column(0), b.column(1)
        hashes, counts = word_hashes(texts)
        sig = signatures(*multisets(*shingles(hashes, counts, WORDS)), b.num_rows)
        full = counts > 0
        keys = _bands(sig, BANDS)
        prints = (sig & np.uint64(0xFFFF)).astype(np.uint16)
        yield pa.record_batch([
            ids, pa.array(_key_of(hashes, counts, texts, ids)),
            pa.array([list(k) if f else None for k, f in zip(keys, full)], pa.list_(pa.int64())),
            pa.array([p.tobytes() if f else None for p, f in zip(prints, full)], pa.binary())], ["id", "v", "bands", "prints"])


def with_text_key(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """df with the key that near_duplicates gives the row's text."""
    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            hashes, counts = word_hashes(b.column("text"))
            key = pa.array(_key_of(hashes, counts, b.column("text"), b.column("id")))
            yield pa.record_batch([b.column("row"), key], ["row", "v"])
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.lower(F.col(f"`{text_col}`")).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, v long").select("row.*", F.col("v").alias(name))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as (sorted hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum()
    return both / (a[1].sum() + b[1].sum() - both)


def _verify(threshold: float):
    def bag(text: str):
        h, c = word_hashes(pa.array([text]))
        h, _, w = multisets(*shingles(h, c, WORDS))
        return h, w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            links = []
            for a, v, ta, tb in zip(*(b.column(i) for i in range(4))):
                if a.as_py() != last:
                    last, own = a.as_py(), bag(ta.as_py())
                if similarity(own, bag(tb.as_py())) >= threshold:
                    links.append((last, v.as_py()))
            yield pa.record_batch([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])
    return run


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough; texts: (v, text), one row a class."""
    held = pairs.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
    held = held.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return cut_lineage(held.mapInArrow(_verify(threshold), "a long, b long"))


def _elements(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multisets as sets: 32 bits of every shingle and how many equal ones came before it, sorted within each text."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    low = (mix(h + (np.arange(len(h)) - first).astype(np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((low, t))
    return low[order], t


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 1 << 20):
        low, text = _elements(*shingles(*word_hashes(b.column(1)), WORDS))
        edges = np.searchsorted(text, np.arange(b.num_rows + 1))
        yield pa.record_batch([b.column(0), pa.array([low[x:y].tobytes() for x, y in zip(edges, edges[1:])], pa.binary())], ["v", "bag"])


def _cross(keys: list, own: dict, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of one bucket's two blocks (or of one with itself) that join components: similar by size and elements, not met in an earlier band. Of the pairs that join the same components one is enough."""
    band, _, at, to = keys
    v, block, c = (np.array(own[k]) for k in ("v", "block", "c"))
    bands = np.frombuffer(b"".join(own["bits"]), np.int64).reshape(len(v), -1)
    bags = [np.frombuffer(x, np.uint32) for x in own["bag"]]
    sizes = np.array([len(x) for x in bags])
    for i in np.flatnonzero(block == at):
        other = (c != c[i]) & (block == to)
        if at == to:
            other[:i + 1] = False
        js = np.flatnonzero(other)
        js = js[(bands[js] == bands[i]).argmax(1) == band] if len(js) else js
        js = js[np.minimum(sizes[js], sizes[i]) >= threshold * np.maximum(sizes[js], sizes[i])]
        if not len(js):
            continue
        many = np.concatenate([bags[j] for j in js])
        hit = bags[i][np.minimum(np.searchsorted(bags[i], many), sizes[i] - 1)] == many
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[js]) - sizes[js])
        for j in js[both >= (threshold - 1e-9) * (sizes[js] + sizes[i] - both)]:
            if c[j] != c[i]:
                yield int(v[i]), int(v[j])
                c[c == c[j]] = c[i]


def _across(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """Similar pairs between different components of a bucket. members: (band, value, v). A bucket's texts are dealt out in blocks,
    and each pair of blocks is a group of its own, so that none holds more than two blocks."""
    own = members.join(labels, "v", "left").select("band", "value", "v", F.coalesce("component", "v").alias("c"))
    whole = own.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most")
    mixed = own.join(whole.select("band", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")), ["band", "value"])
    mixed = cut_lineage(mixed.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")))
    facts = mixed.select("v").distinct().join(texts, "v").select("v", "text").mapInArrow(_bags, "v long, bag binary")
    facts = facts.join(classes.select("v", "prints", "bands"), "v")
    dealt = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(facts, "v") \
        .select("band", "value", F.least("block", "other").alias("at"), F.greatest("block", "other").alias("to"), "v", "c", "block", "prints", "bands", "bag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, names = None, {}, ["v", "c", "block", "prints", "bits", "bag"]

        def found() -> pa.RecordBatch:
            pairs = list(_cross(now, own, threshold)) if now and len(own["v"]) > 1 else []
            return pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            lists = b.column(8)
            bits = np.ascontiguousarray(lists.flatten().to_numpy(), np.int64).reshape(b.num_rows, -1)
            columns = [*(b.column(i).to_pylist() for i in (4, 5, 6, 7)), [x.tobytes() for x in bits], b.column(9).to_pylist()]
            for key, *values in zip(keys, *columns):
                if key != now:
                    if now:
                        yield found()
                    now, own = key, {n: [] for n in names}
                for n, x in zip(names, values):
                    own[n].append(x)
        if now:
            yield found()

    grouped = dealt.repartition("band", "value", "at", "to").sortWithinPartitions("band", "value", "at", "to", "v")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of df: (id, text_key, class_id, kept); ids and class_id are the smallest id that links reach.

    Texts with the same words in the same order are one class from the start, whatever their white space and case. A text
    shorter than five words counts as one shingle; texts without words are copies of each other; a null text is like no other
    row unless that has the same id. A null id is compared like the rest and never names a class that has another id. kept
    marks one id of each class: of repeated rows with that id and text all are marked (see the pipeline's stage). Other
    columns are not looked at.
    """
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("text"))
    signed = cut_lineage(source.mapInArrow(_sign, "id long, v long, bands array<long>, prints binary"))
    classes = signed.groupBy("v").agg(F.min("id").alias("rep"), F.first(F.struct("bands", "prints")).alias("s"))
    classes = cut_lineage(classes.select("v", "rep", "s.bands", "s.prints"))
    bucketed = classes.where("bands is not null").select("v", F.posexplode("bands").alias("band", "value"))
    centres = bucketed.groupBy("band", "value").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("v", "band").alias("h"), "v")).alias("c"))
    centres = cut_lineage(centres.where("n > 1").select("band", "value", F.col("c.v").alias("centre")))
    members = cut_lineage(bucketed.join(centres, ["band", "value"]))
    pairs = members.where("v <> centre").select(F.col("centre").alias("a"), F.col("v").alias("b")).distinct()
    wanted = members.select("v").distinct().join(classes.select("v", "rep"), "v").select(F.col("rep").alias("id"), "v")
    texts = source.join(wanted, source["id"].eqNullSafe(wanted["id"])).select(wanted["v"], source["id"], source["text"])
    texts = cut_lineage(with_text_key(texts, "id", "text", "own").where("own = v").groupBy("v").agg(F.first("text").alias("text")))
    links = _links(pairs, texts, threshold)
    labels = components(links)
    more = cut_lineage(_across(members.select("band", "value", "v"), labels, classes, texts, threshold))
    if not more.isEmpty():
        labels = components(links.union(_links(more, texts, threshold)))
    owned = signed.select("id", "v").join(labels, "v", "left").select("id", "v", F.coalesce("component", "v").alias("c"))
    owned = cut_lineage(owned)
    names = owned.groupBy("c").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id", "v"))["v"].alias("first_v"))
    return owned.join(names, "c").select("id", F.col("v").alias("text_key"), "class_id",
                                         (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("v") == F.col("first_v"))).alias("kept"))
