"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

A word (between its end marks) is described by its subsequences of three characters within five places, each gap inside costing a
factor, so that an insult with a character put in between, left out or exchanged still shares most of them. The kernel of
two words is the inner product of these descriptions over their lengths. The machine sees a word through its kernel values with
the landmarks, whitened by the landmarks' own kernel matrix. Because that map is linear in the description, a trained machine
folds into one weight per (hashed) subsequence, and scoring a word needs no landmark.

Labels mark whole documents, so training follows the multiple-instance scheme: of the sentences of a toxic document at least one
holds an offending word, of those of a clean one none does. Each round takes the likeliest word of every toxic document as its
witness and adds the clean documents' likeliest words to the negatives. A document's score comes from its highest words by a
logistic function fitted on labelled documents that the words were not fitted on.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .words import pieces

#: Bounds of the fit: labelled documents of either kind, characters of all of them.
TOXIC, CLEAN, CHARACTERS = 2500, 4000, 16_000_000
#: A document beyond this part of its kind's characters is learned from only where shorter ones leave room.
LARGE = 1 / 20
LANDMARKS, NEGATIVES, ROUNDS, GAP = 256, 6000, 3, 0.6
#: Buckets of subsequence hashes; characters of a word's window and its step, for words beyond one window.
BUCKETS, WIDTH, STEP = 1 << 15, 24, 12
_SPANS = [(a, b, GAP ** (b - 2)) for b in range(2, 5) for a in range(1, b)]
_SENTENCE = re.compile(r"[.!?\n]+")
_SPELLED = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")
#: About how many bytes a task keeps of words and their scores.
KNOWN = 32 << 20


def tokens(text: str) -> set[str]:
    """Distinct words of a lower-case text; letters set apart by single spaces also count as one word."""
    words = set(text.split())
    if sum(len(w) == 1 for w in words) > 2:
        words.update(re.sub(r"\s", "", m) for m in _SPELLED.findall(text))
    return words


def _windows(words: list[str]) -> tuple[list[str], np.ndarray | None]:
    """Words in windows with end marks, and the word of each window (None: one each)."""
    if max(map(len, words), default=0) <= WIDTH:
        return ["^" + w + "$" for w in words], None
    out, of = [], []
    for i, w in enumerate(words):
        w = "^" + w + "$"
        for at in range(0, max(1, len(w) - WIDTH - 2 + STEP), STEP):
            out.append(w[at:at + WIDTH + 2])
            of.append(i)
    return out, np.array(of)


def describe(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every span: (bucket of each place's subsequence, whether there is one, weight), as matrices of a row per window."""
    chars = np.array(words, f"U{WIDTH + 2}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    x, y, z = (chars * np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    for a, b, weight in _SPANS:
        n = chars.shape[1] - b
        h = x[:, :n] ^ (y[:, a:a + n] + (x[:, :n] >> np.uint64(29))) ^ (z[:, b:b + n] >> np.uint64(1))
        h ^= h >> np.uint64(31)
        yield (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49)).astype(np.int32), chars[:, b:b + n] != 0, weight


def _project(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Descriptions times weights (buckets, k), over the descriptions' lengths."""
    out, length = np.zeros((len(words), weights.shape[1]), np.float32), np.zeros(len(words))
    for bucket, there, weight in describe(words):
        length += weight ** 2 * there.sum(1)
        for column in range(bucket.shape[1]):
            on = np.flatnonzero(there[:, column])
            out[on] += np.float32(weight) * weights[bucket[on, column]]
    return out / np.sqrt(np.maximum(length, 1e-9))[:, None]


def _sums(words: list[str], weights: np.ndarray) -> np.ndarray:
    out, length = np.zeros(len(words)), np.zeros(len(words))
    for bucket, there, weight in describe(words):
        length += weight ** 2 * there.sum(1)
        out += weight * np.where(there, weights[bucket], 0).sum(1)
    return out / np.sqrt(np.maximum(length, 1e-9))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray   # of each bucket
    bias: float
    link: np.ndarray      # of the document's features

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            short, of = _windows(part)
            got = _sums(short, self.weights) + self.bias
            if of is not None:
                best = np.full(len(part), -np.inf)
                np.maximum.at(best, of, got)
                got = best
            out[at:at + 20_000] = got
        return out

    def document_scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_expand(features) @ self.link, -30, 30)))


def disguised(word: str) -> list[str]:
    """Ways in which an insult is hidden: a character put in, put between all letters, or in a letter's place."""
    m = len(word) // 2
    return [word[:m] + "-" + word[m:], word[:2] + "*" + word[2:], ".".join(word), word[:m] + "1" + word[m + 1:]] if 4 <= len(word) <= WIDTH // 2 else []


def _features(scores: np.ndarray) -> list[float]:
    """Highest three word scores and the number of words."""
    top = np.sort(scores)[-3:] if len(scores) > 3 else np.sort(scores)
    top = np.concatenate([np.full(3 - len(top), -2.0), top])
    return [*np.clip(top[::-1], -2, 2), np.log1p(len(scores))]


def _expand(f: np.ndarray) -> np.ndarray:
    """The document's features for the logistic function: a high word means less in a long text."""
    return np.column_stack([f[:, :3], np.maximum(f[:, :3], 0), f[:, 3], f[:, 3:] * np.maximum(f[:, :3], 0), np.ones(len(f))])


def _machine(z: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared-hinge machine in the primal by Newton steps on its support vectors; the last column of z is 1."""
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(20):
        on = (y * (z @ w) < 1) if w.any() else np.ones(len(y), bool)
        zc = z[on] * c[on, None]
        new = np.linalg.solve(ridge + zc.T @ z[on], zc.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w, x = np.zeros(x.shape[1]), np.asarray(x, float)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.3 * np.eye(len(w)), x.T @ (y - p) - 0.3 * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _nystroem(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, landmarks) descriptions and the whitening of their kernel matrix."""
    phi = np.zeros((BUCKETS, len(landmarks)), np.float32)
    length = np.zeros(len(landmarks))
    for bucket, there, weight in describe(landmarks):
        length += weight ** 2 * there.sum(1)
        row, column = np.nonzero(there)
        np.add.at(phi, (bucket[row, column], row), weight)
    phi /= np.sqrt(np.maximum(length, 1e-9)).astype(np.float32)
    values, vectors = np.linalg.eigh((phi.T @ phi).astype(float))
    keep = values > 1e-5 * values.max()
    return phi, vectors[:, keep] / np.sqrt(values[keep])


def train(texts: list[str], toxic: list[int]) -> Model:
    """The machine from labelled texts (lower case). With one kind of label only, every score is that kind's share."""
    y = np.array(toxic, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    constant = np.zeros(_expand(np.zeros((1, 4))).shape[1])
    constant[-1] = np.log(share / (1 - share))
    blank = Model(np.zeros(BUCKETS, np.float32), 0.0, constant)
    # A document's words are gathered sentence by sentence; each sentence has its document's label.
    bags = [sorted({w for s in _SENTENCE.split(t) for w in tokens(s)}) for t in texts]
    vocabulary = sorted({w for b in bags for w in b})
    number = {w: i for i, w in enumerate(vocabulary)}
    bags = [np.fromiter((number[w] for w in b), np.int64, len(b)) for b in bags]
    fit = np.arange(len(y)) % 10 < 7
    positive, negative = [np.flatnonzero(fit & (y == v)) for v in (1, 0)]
    if min(len(positive), len(negative)) < 3 or not vocabulary:
        return blank
    held = np.zeros((2, len(vocabulary)))
    for i in np.flatnonzero(fit):
        held[int(y[i]), bags[i]] += 1
    odds = np.log((held[1] + 0.02) / len(positive)) - np.log((held[0] + 0.3) / len(negative)) + np.where(held[1] < 2, -1.5, 0.0)
    rng = np.random.default_rng(5)
    clean = np.flatnonzero(held[0] > 0)
    hard = np.empty(0, np.int64)
    scores = odds
    for turn in range(ROUNDS):
        witness = Counter(int(bags[i][np.argmax(scores[bags[i]])]) for i in positive if len(bags[i]) and scores[bags[i]].max() > (0.5 if turn == 0 else -0.5))
        if turn == 0:  # words that tell the classes apart best, beyond one a document
            witness.update({int(w): 1 for w in np.argsort(-odds)[:LANDMARKS] if odds[w] > 1.5})
        if not witness:
            return blank
        plus = np.array([w for w in sorted(witness) if held[0][w] <= max(2, 0.25 * held[1][w])], np.int64)
        if not len(plus):
            return blank
        minus = np.union1d(rng.choice(clean, min(NEGATIVES, len(clean)), replace=False), hard)
        minus = np.setdiff1d(minus, plus)
        best = sorted(plus, key=lambda w: (-witness.get(int(w), 0), w))[:LANDMARKS // 2]
        others = rng.choice(minus, min(LANDMARKS - len(best), len(minus)), replace=False)
        landmarks = [_windows([vocabulary[w]])[0][0] for w in [*best, *others]]
        phi, white = _nystroem(landmarks)
        hidden = sorted({h for w in plus if witness.get(int(w), 0) > 1 for h in disguised(vocabulary[w])}.difference(number))
        short = [_windows([w])[0][0] for w in [*(vocabulary[w] for w in plus), *hidden, *(vocabulary[w] for w in minus)]]
        z = np.column_stack([_project(short, phi) @ white, np.ones(len(short))])
        target = np.where(np.arange(len(short)) < len(plus) + len(hidden), 1.0, -1.0)
        often = np.array([np.sqrt(witness.get(int(w), 1)) for w in plus])
        cost = np.concatenate([often / often.sum(), np.full(len(hidden), 0.5 / max(1, len(hidden))), np.full(len(minus), 2.0 / len(minus))]) * 2000
        w = _machine(z, target, cost)
        model = Model((phi @ (white @ w[:-1]).astype(np.float32)), float(w[-1]), constant)
        scores = model.word_scores(vocabulary)
        hard = clean[np.argsort(-scores[clean])[:NEGATIVES // 3]]
        hard = hard[held[1][hard] <= held[0][hard] * 3]
    apart = np.flatnonzero(~fit)
    apart = apart if 0 < y[apart].sum() < len(apart) else np.arange(len(y))
    link = _logistic(_expand(np.array([_features(scores[bags[i]]) for i in apart])), y[apart])
    return Model(model.weights, model.bias, link)


def in_held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from; a null id has none to learn."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trained on at most TOXIC and CLEAN labelled documents, the first by a hash of their ids, up to CHARACTERS characters, of
    which each kind has its share and what the other leaves. Long documents come last, the shorter ones first, and one that
    doesn't fit is passed over, so none takes the others' place (one beyond CHARACTERS teaches nothing). A document labelled twice counts as toxic if one label says
    so; null labels and texts teach nothing; the rows of an id are one document here. The texts meet the chosen ids, which the
    bound keeps few, by a broadcast, so that only ids and lengths are shuffled."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(~in_held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("text")).where("text is not null")
    sizes = rows.select("id", F.length("text").cast("long").alias("size")).groupBy("id").agg(F.sum("size").alias("size"))
    sized = cut_lineage(known.join(sizes, "id"))
    share = CHARACTERS * TOXIC // (TOXIC + CLEAN)

    def first(kind: int, n: int, own: int) -> list:
        late = F.when(F.col("size") > int(own * LARGE), F.col("size")).otherwise(0)
        return sized.where((F.col("y") == kind) & (F.col("size") <= CHARACTERS)).orderBy(late, "h", "id").limit(n).collect()

    def filled(found: list, left: int) -> list:
        out = []
        for r in found:
            if r["size"] <= left:
                left -= r["size"]
                out.append(r)
        return out

    toxic, clean = first(1, TOXIC, share), first(0, CLEAN, CHARACTERS - share)
    taken = filled(toxic, max(share, CHARACTERS - sum(r["size"] for r in clean)))
    taken += filled(clean, CHARACTERS - sum(r["size"] for r in taken))
    chosen = docs.sparkSession.createDataFrame(taken, sized.schema).select("id", "y", "h")
    rows = rows.join(F.broadcast(chosen), "id").orderBy("h", "id", "text").select("text", "y")
    texts, marks = [], []
    for r in rows.toLocalIterator():
        texts.append(r["text"])
        marks.append(r["y"])
    return train(texts, marks)


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, score): df's rows (or their columns `keep`) in one struct, and the toxicity of the whole text from 0 to 1. Null and empty texts have
    the score of a text without words. Rows are scored one by one, so repeated rows and clashing names don't matter. Only texts
    go to Python; a task keeps the scores of about KNOWN bytes of words and drops them at its end."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, model = _Known(), shared.value
        for texts in batches:
            slices = pieces(iter([pa.record_batch([texts], ["text"])]), "text", 1 << 20)
            yield pa.array(np.concatenate([np.empty(0), *(model.document_scores(known.features(model, b.column(0))) for b in slices)]))

    columns = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    return df.select(F.struct(*columns).alias("row"), scored(F.lower(F.col(f"`{text_col}`"))).alias("score"))


class _Known:
    """Word scores that a task has computed."""

    def __init__(self):
        self.scores: dict[str, float] = {}
        self.held = 0

    def features(self, model: Model, texts: pa.Array) -> np.ndarray:
        known = self.scores
        bags = [tokens(t) if t else set() for t in texts.to_pylist()]
        new = list(set().union(*bags).difference(known))
        if self.held > KNOWN:
            known.clear()
            self.held = 0
            new = list(set().union(*bags))
        known.update(zip(new, model.word_scores(new).tolist()) if new else ())
        self.held += sum(map(len, new)) + 170 * len(new)
        return np.array([_features(np.fromiter(map(known.__getitem__, bag), float, len(bag))) for bag in bags])
