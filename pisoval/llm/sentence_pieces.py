"""SentencePiece encoding and decoding with a public BPE model, as a max-plus scan.

A segmentation scores 0 where every two neighbouring pieces are a pair that merging leaves apart, and minus infinity elsewhere; the
best path is then the encoding, because merges across a boundary depend on its two pieces alone. No piece of the model crosses
from text into a following word mark or over a character that the model spells in bytes, so paths through such places
are independent, and a word's path is computed once while its task has room for it.

A giant text is cut into chunks anywhere. A boundary state is the piece that covers the character before the cut; a chunk yields the
transfer matrix from the states at its left cut to those at its right one (scores 0 or minus infinity, kept sparse). Matrices are
combined associatively, in a tree, which gives the one state at every cut that lies on the best path; then each chunk traces back
its own part on its own.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .words import pieces as slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; about how many bytes a task keeps of words' paths, and of pairs.
CHUNK, WORDS_KEPT, PAIRS_KEPT = 32_768, 160 << 20, 40 << 20
#: What an entry takes beside its word and path, and what a pair takes.
_ENTRY, _PAIR = 200, 100
MARK = "▁"
BEGIN, END = -1, -2


def load(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """(pieces, scores, kinds) of a model file; kinds: 0 piece, 1 byte, 2 neither."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = range(len(p))
    kinds = [1 if p.is_byte(i) else 2 if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else 0 for i in n]
    return [p.id_to_piece(i) for i in n], [p.get_score(i) for i in n], kinds


class Codec:
    def __init__(self, names: list[str], scores: list[float], kinds: list[int]):
        self.names, self.size = names, len(names)
        self.ids = {n: i for i, n in enumerate(names) if kinds[i] == 0}
        order = sorted(self.ids.values(), key=lambda i: (-scores[i], i))
        self.rank = {names[i]: r for r, i in enumerate(order)}
        self.longest = max(map(len, self.ids))
        self.byte = {int(names[i][3:5], 16): i for i in range(self.size) if kinds[i] == 1}
        self.single = {n for n in self.ids if len(n) == 1}
        self._pairs: dict[int, bool] = {}
        # Words' paths, newer and older ones: those not met again while the newer fill up go first.
        self.known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._held = 0
        # Pieces that merging makes at all, and -1 at what only begins one.
        self.found = {n[:k]: -1 for n in self.ids for k in range(1, len(n) + 1)}
        self.found |= {n: i for n, i in self.ids.items() if self.merge(n) == [n]}
        raw = [b"" if k == 2 else bytes([int(n[3:5], 16)]) if k == 1 else n.replace(MARK, " ").encode() for n, k in zip(names, kinds)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length

    def merge(self, s: str) -> list[str]:
        """Merges of one short string, best first, leftmost of equals."""
        parts, rank = list(s), self.rank
        while len(parts) > 1:
            ranks = [rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b as they are, side by side."""
        key = a * self.size + b
        got = self._pairs.get(key)
        if got is None:
            x, y = self.names[a], self.names[b]
            # Together they may be a piece that merging makes; else merging tells.
            got = self._pairs[key] = self.found.get(x + y, -1) < 0 and self.merge(x + y) == [x, y]
        return got

    def paths(self, s: str, at: int, last: int, end: int) -> list[int]:
        """For each place of s up to `end`: the last piece of the best path from `at`, where the piece `last` ends (-1: any
        may follow), to there; -1 if none gets there."""
        got = [-1] * (end + 1)
        found, n = self.found, len(s)
        for j in range(at, end):
            before = last if j == at else got[j]
            if j > at and before < 0:
                continue
            for k in range(j + 1, min(n, j + self.longest) + 1):
                b = found.get(s[j:k])
                if b is None:
                    break
                if 0 <= b and k <= end and (before < 0 or self.apart(before, b)):
                    got[k] = b
        return got

    def word(self, s: str) -> list[int]:
        """Ids of a string without barriers inside: the only path that scores 0, looked for depth first, longest pieces first.
        A place that no path leads on from is not tried again."""
        found, pairs, size, n = self.found, self._pairs, self.size, len(s)
        if (whole := found.get(s, -1)) >= 0:
            return [whole]
        out, ends, open_, dead, j, before = [], [], [], set(), 0, -1
        while True:
            options = []
            for k in range(j + 1, n + 1):
                b = found.get(s[j:k])
                if b is None:
                    break
                if b >= 0:
                    options.append((k, b))
            while True:
                while options:
                    k, b = options.pop()
                    if k in dead:
                        continue
                    if before >= 0:
                        ok = pairs.get(before * size + b)
                        if not (self.apart(before, b) if ok is None else ok):
                            continue
                    break
                else:
                    # Only one piece can end a path to a place, so a place with no way on is dead for good.
                    dead.add(j)
                    options = open_.pop()
                    out.pop()
                    ends.pop()
                    j, before = (ends[-1], out[-1]) if out else (0, -1)
                    continue
                break
            out.append(b)
            ends.append(k)
            if k == n:
                return out
            open_.append(options)
            j, before = k, b

    def spelled(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]

    def parts(self, s: str) -> list[str]:
        """s cut at its barriers: before each word mark that follows other text, and around characters spelled in bytes."""
        if "\x1e" in s or MARK * 2 in s:  # runs of marks stay together
            return self._cut.findall(s)
        for c in set(s) - self.single:
            s = s.replace(c, f"\x1e{c}\x1e")
        return [p for p in s.replace(MARK, "\x1e" + MARK).split("\x1e") if p]

    @property
    def _cut(self):
        return _cutter(tuple(sorted(self.single)))

    def encode_parts(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each text, given in parts, as bytes of 32-bit integers."""
        if self._held > WORDS_KEPT // 2:
            self._older, self.known, self._held = self.known, {}, 0
        known, older = self.known, self._older
        new = set().union(*texts).difference(known) if texts else set()
        if len(self._pairs) * _PAIR > PAIRS_KEPT:
            self._pairs.clear()
        for s in new:
            got = older.get(s)
            if got is None:
                got = np.array(self.spelled(s) if len(s) == 1 and s not in self.single else self.word(s), np.int32).tobytes()
            known[s] = got
            self._held += _ENTRY + 2 * len(s) + len(got)
        return [b"".join(map(known.__getitem__, t)) for t in texts]

    def forget(self) -> None:
        """Drop words and pairs, at the end of a task; the vocabulary stays."""
        self.known.clear()
        self._older.clear()
        self._pairs.clear()
        self._held = 0

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Whole texts. An empty text has no pieces; a null one gives null."""
        out = self.encode_parts([self.parts(normal(t)) if t else [] for t in texts])
        return [None if t is None else o for t, o in zip(texts, out)]

    # Chunks

    def states(self, s: str, cut: int) -> list[tuple[int, int]]:
        """Pieces (start, end) that can cover the character before the cut."""
        out = []
        for a in range(max(0, cut - self.longest), cut):
            for b in range(a + 1, min(len(s), a + self.longest) + 1):
                i = self.found.get(s[a:b])
                if i is None:
                    break
                if i >= 0 and b >= cut:
                    out.append((a, b))
        if s[cut - 1] not in self.single:
            out.append((cut - 1, cut))
        return out

    def barriers(self, s: str) -> list[int]:
        """Places of s where a part begins."""
        return [m.start() for m in self._cut.finditer(s)]

    def trace(self, s: str, barriers: list[int], left: tuple[int, int] | None, rights: list[tuple[int, int] | None], ids: bool = True) -> dict:
        """For each piece of `rights` (None: the end of s) to which a path leads from the piece `left` (None: the start of s): the
        ids after left, up to and with the right one. Between the first barrier after left and the last one before the rights lie
        whole parts, which have their paths whatever stands around them; without `ids` these are left out."""
        at, last = (left[1], self._id(s, left)) if left else (0, -1)
        first = min((r[0] for r in rights if r), default=len(s))
        i, j = bisect_left(barriers, at), bisect_right(barriers, first) - 1
        before: list[int] = []
        if i <= j:
            head = self._stretch(s, at, barriers[i], last)
            if head is None:
                return {}
            middle = self.encode_parts([self.parts(s[barriers[i]:barriers[j]])])[0] if ids else b""
            before, at, last = head + np.frombuffer(middle, np.int32).tolist(), barriers[j], -1
        out = {}
        for r in rights:
            stop = r[0] if r else len(s)
            if r and r[0] < at:
                if left and r == left:
                    out[r] = []
                continue
            tail = self._stretch(s, at, stop, last) if stop > at else []
            if tail is None:
                continue
            if r:
                previous, own = (tail[-1] if tail else last), self._id(s, r)
                if previous >= 0 and not self._follows(s, previous, r, own):
                    continue
                tail = tail + ([own] if own >= 0 else self.spelled(s[r[0]]))
            out[r] = before + tail
        return out

    def _id(self, s: str, span: tuple[int, int]) -> int:
        """Id of the piece at span; of a character spelled in bytes, -1, as anything may follow it."""
        return self.ids.get(s[span[0]:span[1]], -1)

    def _follows(self, s: str, before: int, span: tuple[int, int], own: int) -> bool:
        return own < 0 or s[span[0] - 1] not in self.single or self.apart(before, own)

    def _stretch(self, s: str, a: int, b: int, last: int) -> list[int] | None:
        """Ids of s[a:b] after the piece `last`; None if no path ends exactly at b."""
        out: list[int] = []
        while a < b and s[a] not in self.single:
            out += self.spelled(s[a])
            a, last = a + 1, -1
        if a == b:
            return out
        end = a
        while end < b and s[end] in self.single:
            end += 1
        got = self.paths(s[a:end], 0, last, end - a)
        own, at = [], end - a
        while at:
            if got[at] < 0:
                return None
            own.append(got[at])
            at -= len(self.names[got[at]])
        rest = self._stretch(s, end, b, -1) if end < b else []
        return None if rest is None else out + own[::-1] + rest

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: pieces side by side, word marks as spaces, the space put before the text taken away."""
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = self.raw_length[flat]
        ends = np.cumsum(lengths)
        at = np.repeat(self.raw_start[flat] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.raw[at]
        stops = np.concatenate([[0], np.cumsum(counts)])
        edges = np.concatenate([[0], ends])[stops]
        begins, behind = edges[:-1].copy(), edges[1:]
        spaced = (begins < behind) & (data[np.minimum(begins, max(0, len(data) - 1))] == 32) if len(data) else np.zeros(len(begins), bool)
        begins += spaced
        keep = np.ones(len(data), bool)
        keep[edges[:-1][spaced]] = False
        offsets = np.concatenate([[0], np.cumsum(behind - begins)]).astype(np.int64)
        out = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes())])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that don't spell UTF-8
            raw = data[keep].tobytes()
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])], pa.large_string())
        null = ids.is_null()
        return pc.if_else(null, None, out).cast(pa.string()) if null.true_count else out.cast(pa.string())


@lru_cache(4)
def _cutter(single: tuple[str, ...]) -> re.Pattern:
    known = "".join(re.escape(c) for c in single if c != MARK)
    return re.compile(f"{MARK}*[{known}]+|{MARK}+|.", re.S)


@lru_cache(2)
def codec(names: tuple, scores: tuple, kinds: tuple) -> Codec:
    """One codec in each Python worker."""
    return Codec(list(names), list(scores), list(kinds))


@contextmanager
def one_task(shared) -> Iterator[Codec]:
    """The worker's codec, for one task."""
    c = codec(*shared.value)
    try:
        yield c
    finally:
        c.forget()


def normal(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def _code(cut: int, span: tuple[int, int]) -> int:
    return (cut - span[0]) * 64 + span[1] - cut


def compose(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Max-plus product of two sparse matrices whose scores are 0 where there is an entry."""
    by = {}
    for l, r in b:
        by.setdefault(l, []).append(r)
    return sorted({(l, r) for l, m in a for r in by.get(m, ())})


def cut_states(matrices: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """(left, right) state of every chunk on the best path, from the chunks' matrices: products up a tree of halves, then, from the
    ends known of a span, the one state at its middle."""
    spans: dict[tuple[int, int], list] = {}

    def up(a: int, b: int) -> list:
        if b - a == 1:
            spans[a, b] = matrices[a]
        else:
            m = (a + b) // 2
            spans[a, b] = compose(up(a, m), up(m, b))
        return spans[a, b]

    up(0, len(matrices))
    out = [(0, 0)] * len(matrices)
    todo = [(0, len(matrices), BEGIN, END)]
    while todo:
        a, b, l, r = todo.pop()
        if b - a == 1:
            out[a] = (l, r)
            continue
        m = (a + b) // 2
        right = {x for x, y in spans[m, b] if y == r}
        middle = next(y for x, y in spans[a, m] if x == l and y in right)
        todo += [(a, m, l, middle), (m, b, middle, r)]
    return out


def _span(cut: int, code: int) -> tuple[int, int]:
    return cut - code // 64, cut + code % 64


def encode(df: DataFrame, path: str = MODEL, text_col: str = "text", name: str = "token_ids", chunk: int = CHUNK,
           check: str | None = None) -> DataFrame:
    """df with `name`: array<int>, and, if asked for, `check`: whether the ids decode to the text again. The ids are the model's of the whole text, equal to the public library's. An empty text has none, a null
    one null. A literal word mark reads as a space, as in the library. Repeated rows have equal ids; a column of that name
    is replaced. Texts above `chunk` characters go chunk by chunk through the scan; their ids meet again in their row."""
    names, scores, kinds = map(tuple, load(path))
    shared = df.sparkSession.sparkContext.broadcast((names, scores, kinds))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (name, check)]).alias("row")
    text = F.col(f"`{text_col}`")
    giant = F.coalesce(F.length(text) > chunk, F.lit(False))
    schema = f"row {df.select(row).schema['row'].dataType.simpleString()}, ids array<int>, same boolean"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with one_task(shared) as c:
            for b in slices(batches, "text", 1 << 20):
                yield with_check(c, b.column(0), b.column(1), _lists(c.encode(b.column(1).to_pylist())))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with one_task(shared) as c:
            for b in slices(batches, "text", 1 << 20):
                yield with_check(c, b.column(0), b.column(1), b.column(2))

    def with_check(c: Codec, rows: pa.Array, texts: pa.Array, ids: pa.Array) -> pa.RecordBatch:
        same = pc.fill_null(pc.equal(c.decode(ids), texts), pc.is_null(texts)) if check else pa.nulls(len(ids), pa.bool_())
        return pa.record_batch([rows, ids, same], ["row", "ids", "same"])

    plain = df.where(~giant).select(row, text.alias("text")).mapInArrow(short, schema)
    large = df.where(giant).select(row, F.md5(text).alias("key"), text.alias("text"))
    joined = large.join(_encode_long(large.select("key", "text"), shared, chunk), "key").select("row", "text", "ids").mapInArrow(long, schema)
    return plain.union(joined).select("row.*", F.col("ids").alias(name), *([F.col("same").alias(check)] if check else []))


def _lists(ids: list[bytes | None]) -> pa.Array:
    flat = np.frombuffer(b"".join(x or b"" for x in ids), np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in ids])]).astype(np.int32)
    mask = pa.array([x is None for x in ids])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=mask if any(x is None for x in ids) else None)


def _encode_long(texts: DataFrame, shared, chunk: int) -> DataFrame:
    """(key, ids) of each distinct giant text."""
    once = texts.groupBy("key").agg(F.first("text").alias("text"))
    marked = once.select("key", F.concat(F.lit(MARK), F.replace("text", F.lit(" "), F.lit(MARK))).alias("s"))
    margin = 64
    count = F.ceil(F.length("s") / chunk).cast("int")
    cut = marked.select("key", "s", count.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    low = F.greatest(F.col("k") * chunk - margin, F.lit(0))
    cut = cut.select("key", "k", "n", (F.col("k") * chunk - low).alias("left"),
                     F.expr(f"substring(s, greatest(k * {chunk} - {margin}, 0) + 1, least(k * {chunk}, {margin}) + {chunk + margin})").alias("s"))
    cut = cut_lineage(cut.repartition("key", "k"))

    def ends(c: Codec, s: str, left: int, k: int, n: int):
        a = left if k else None
        b = left + chunk if k < n - 1 else None
        return a, b, (c.states(s, a) if k else [None]), (c.states(s, b) if b else [None])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())]))
        with one_task(shared) as c:
            for batch in slices(batches, "s", 1 << 20):
                out = []
                for r in batch.to_pylist():
                    a, b, lefts, rights = ends(c, r["s"], r["left"], r["k"], r["n"])
                    at = c.barriers(r["s"])
                    entries = [(_code(a, x) if x else BEGIN, _code(b, y) if y else END) for x in lefts for y in c.trace(r["s"], at, x, rights, ids=False)]
                    out.append((r["key"], r["k"], [{"l": x, "r": y} for x, y in entries]))
                yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pair))], ["key", "k", "m"])

    def scan(pdf):
        import pandas as pd

        pdf = pdf.sort_values("k")
        found = cut_states([[(e["l"], e["r"]) for e in m] for m in pdf["m"]])
        return pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "l": [x[0] for x in found], "r": [x[1] for x in found]})

    made = cut_lineage(cut.mapInArrow(matrices, "key string, k int, m array<struct<l: int, r: int>>"))
    states = made.groupBy("key").applyInPandas(scan, "key string, k int, l int, r int")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with one_task(shared) as c:
            for batch in slices(batches, "s", 1 << 20):
                out = []
                for r in batch.to_pylist():
                    a, b, _, _ = ends(c, r["s"], r["left"], r["k"], r["n"])
                    right = _span(b, r["r"]) if b else None
                    out.append((r["key"], r["k"], c.trace(r["s"], c.barriers(r["s"]), _span(a, r["l"]) if r["k"] else None, [right])[right]))
                yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.int32())))], ["key", "k", "ids"])

    traced = cut.join(states, ["key", "k"]).select("key", "k", "n", "left", "s", "l", "r").mapInArrow(back, "key string, k int, ids array<int>")
    return traced.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def decode(df: DataFrame, path: str = MODEL, ids_col: str = "token_ids", name: str = "decoded") -> DataFrame:
    """df with `name`: the text that the ids spell. Ids that spell no valid UTF-8 give replacement characters; null gives null."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(map(tuple, load(path))))
    columns = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.record_batch([part.column(0), c.decode(part.column(1))], ["row", "text"])

    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string").select("row.*", F.col("text").alias(name))
