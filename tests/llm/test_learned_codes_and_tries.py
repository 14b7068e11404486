"""Quality ranking against held-out labels, vector codes and the conversation trie against brute force, and odd input of each."""
import hashlib
import math
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pisoval.llm import conversation_trie as trie, quality, vector_codes as codes
from pisoval.llm.queries import QUERIES

R = random.Random(8)
WORDS = ["".join(R.choices("abcdefghilmnoprstu", k=R.randint(2, 8))) for _ in range(300)]
SF = "/root/testdata/sf0.001"


# 11 Quality

def page(good, seed):
    r = random.Random(seed)
    if good:
        return " ".join(" ".join(r.choices(WORDS, k=r.randint(6, 14))).capitalize() + "." for _ in range(r.randint(2, 20)))
    return (" | " if seed % 2 else "## ").join(r.choices(WORDS, k=r.randint(20, 150)))


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, page(i % 5 > 0, i)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "x", 1, 0.5, "r") for i, t in rows], "doc_id long, text string, key string, y int, worth double, h string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)], "doc_id long, quality int")
    return docs, labels


def test_quality_ranks_held_out_documents(spark, judged):
    got = quality.rate(*judged).toPandas().set_index("id")
    assert len(got) == 400 and got.score.between(0, 1).all()
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sorted(got.index[got.held_out]) == held
    assert np.mean([got.predicted[i] == int(i % 5 > 0) for i in held]) > 0.97
    assert (got.predicted == (got.score >= 0.5).astype(int)).all()


def test_quality_uses_no_held_out_label(spark, judged):
    docs, labels = judged
    turned = labels.withColumn("quality", F.when(quality.in_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    turned = turned.union(spark.createDataFrame([(None, 1), (7, None)], labels.schema))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights)


def test_quality_cut_is_the_quantile_of_the_labelled_rows(spark, judged):
    docs, labels = judged
    got = quality.rate(docs, labels).toPandas().set_index("id")
    known = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    share = np.mean([i % 5 == 0 for i in known])
    assert (got.predicted[known] == 0).sum() == round(share * len(known))


def test_quality_of_odd_rows(spark, judged):
    docs, labels = judged
    odd = spark.createDataFrame([(None, None), (1000, ""), (1000, ""), (1001, None), (1002, page(True, 1) * 3000), (1003, "\x00\n|\t"), (1, page(True, 5))], "doc_id long, text string")
    got = quality.rate(docs.select("doc_id", "text").union(odd), labels).where("id is null or id >= 1000").toPandas()
    assert len(got) == 6 and got.score.between(0, 1).all() and not got.held_out[got.id.isna()].any()
    assert got.score[got.id == 1000].nunique() == 1 and got.score[got.id == 1000].iloc[0] == got.score[got.id == 1001].iloc[0]
    assert got.predicted[got.id == 1002].iloc[0] == 1
    assert quality.rate(docs.limit(0), labels).count() == 0
    none = quality.rate(docs, labels.limit(0))
    assert none.where("score <> 0.5 or predicted <> 1").count() == 0 and none.count() == 400
    assert quality.rate(docs, labels.where("quality = 0")).where("predicted = 1").count() == 0
    assert quality.rate(docs, labels.where("quality = 1")).where("predicted = 0").count() == 0


def test_pairs_win_by_the_logistic_of_the_difference():
    r = np.random.default_rng(1)
    good, bad = (r.normal(m, 1, (300, quality.FEATURES)) for m in (0.0, 0.0))
    good[:, 3] += 1.0
    model = quality.train(np.vstack([good, bad]), np.r_[np.ones(300), np.zeros(300)])
    w = model.worth(np.vstack([good, bad]))
    assert (w[:300][:, None] > w[300:]).mean() > 0.7 and np.argmax(np.abs(model.weights)) == 3
    assert not quality.train(good, np.ones(300)).weights.any() and not quality.train(np.empty((0, quality.FEATURES)), np.empty(0)).weights.any()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), min_size=1, max_size=6))
def test_descriptions_do_not_depend_on_neighbours(texts):
    together = quality.describe(pa.array(texts, pa.string()))
    alone = np.vstack([quality.describe(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone, atol=1e-12)
    long = quality.describe(pa.array(["ab cd. " * 30_000, "x"]))
    assert np.allclose(long[0], quality.describe(pa.array(["ab cd. " * 30_000]))[0])


# 12 Vector codes

def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, components) that take part, in order of ids."""
    x = np.array([[math.floor(4096 * v) for v in e] for _, e in rows], object)
    w = x.shape[1] // parts
    book = [[list(x[e, p * w:(p + 1) * w]) for e in range(min(entries, len(x)))] for p in range(parts)]

    def nearest(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book[p]]
        return d.index(min(d)), min(d)
    for t in range(rounds + 1):
        found = [[nearest(p, row[p * w:(p + 1) * w]) for p in range(parts)] for row in x]
        if t == rounds:
            break
        for p in range(parts):
            for e in range(len(book[p])):
                own = [row[p * w:(p + 1) * w] for row, f in zip(x, found) if f[p][0] == e]
                if own:
                    book[p][e] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(v) for b in book for e in b for v in e).encode()).hexdigest()
    return {r[0]: ("".join(f"{f[p][0]:02x}" for p in range(parts)), sum(f[p][1] for p in range(parts))) for r, f in zip(rows, found)}, sha


def result_of(df, **more):
    found = codes.compress(df, **more)
    return {r["id"]: (bytes(r["code"]).hex(), r["error"]) for r in found.rows.collect()}, found


def test_codes_equal_plain_rounds_and_skip_scans(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=16) + 4 * (i % 5)).tolist(), i % 3) for i in range(700)]
    got, found = result_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want, sha = brute_codes([r[:2] for r in rows])
    assert got == want and found.sha256() == sha
    assert found.rescans[0] == 700 * 8 and found.rescans[-1] < 0.8 * 700 * 8
    errors = codes.with_label_errors(found.rows).toPandas()
    assert all(g.label_error.eq(g.error.sum()).all() for _, g in errors.groupby("label"))


def test_codes_of_odd_vectors(spark):
    r = np.random.default_rng(4)
    base = [(i, np.round(r.normal(size=16), 1).tolist()) for i in range(60)]
    odd = [(100, None), (101, [None] + [1.0] * 15), (102, [math.nan] + [1.0] * 15), (103, [math.inf] + [1.0] * 15), (104, [1.0]), (105, [])]
    zero, same = [(200, [0.0] * 16)], [(i, base[0][1]) for i in (300, 301)]
    df = spark.createDataFrame([(i, e, None if i % 2 else i, "x", i) for i, e in base + odd + zero + same], "vec_id long, embedding array<double>, label int, code string, sums int")
    got, found = result_of(df)
    want, sha = brute_codes(base + zero + same)
    assert got == want and found.sha256() == sha
    out = codes.with_label_errors(found.rows).toPandas()
    none = out[out.label.isna()]
    assert len(none) > 1 and (none.label_error == none.error.sum()).all()
    few, found = result_of(df.where("vec_id < 3"))
    want, sha = brute_codes(base[:3])
    assert few == want and found.sha256() == sha
    assert result_of(df.limit(0))[0] == {} and codes.with_label_errors(codes.compress(df.limit(0)).rows).count() == 0
    huge = spark.createDataFrame([(i, [1e300 * (-1) ** i] + [float(i)] * 15, 0) for i in range(20)] + [(None, [0.5] * 16, 1)] * 2, "vec_id long, embedding array<double>, label int")
    assert codes.compress(huge).rows.count() == 22
    ragged = spark.createDataFrame([(i, [float(i), 1.0, 2.0], 0) for i in range(5)], "vec_id long, embedding array<double>, label int")
    assert codes.compress(ragged, parts=2, entries=2).codebooks.shape == (2, 2, 2)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_bounds_never_change_an_assignment(seed):
    r = np.random.default_rng(seed)
    x = r.integers(-6, 7, (50, 2, 3)).astype(np.int64)
    history, state = [r.integers(-6, 7, (2, 5, 3))], (None, None, None)
    for _ in range(5):
        code, stamp, bound, d, _ = codes.assign(x, history, *state)
        plain = ((x[:, :, None] - history[-1][None]) ** 2).sum(3)
        assert (code == plain.argmin(2)).all() and (d == plain.min(2)).all()
        state = (code, stamp, bound)
        history = [*history, history[-1] + r.integers(-1, 2, history[-1].shape)]


def test_net_displacement_excludes_the_own_entry():
    book = np.array([[[0, 0], [10, 0], [0, 10]]])
    far = codes.moved([book, book + np.array([[[0, 3], [0, 0], [4, 0]]])])
    assert far[0, 0].tolist() == [4, 4, 3] and not far[1].any()


# 13 Conversation trie

def brute_trie(rows, lend=True):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), x or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in conv.items()}
    full = own
    if lend:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        full = {c: own.get(c - int(math.fmod(c, 100)), [])[:h[c]] + v[h[c]:] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(df, **more):
    c = F.col("conv_id")
    strings = trie.sequences(trie.turns_of(df), c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
    return sorted((tuple(r) for r in trie.prefix_trie(strings, **more).collect()), key=str)


@pytest.mark.parametrize("most, partitions", [(1, 1), (2, 7), (5, 3), (20_000, 9)])
def test_trie_equals_all_prefixes_whatever_its_pieces(spark, most, partitions):
    r = random.Random(most)
    rows = [(c, r.choice([t, t, None]), r.choice(["u", "a", None]), r.choice(["a", "b", "é", None]) if t > 2 or r.random() < 0.8 else "same")
            for c in r.sample(range(-150, 450), 200) for t in range(r.choice([1, 2, 3, 5, 9, 20]))]
    rows += rows[:30] + [(None, 1, "u", "x")] + [(600 + i, 0, "u", "copy") for i in range(60)]
    df = spark.createDataFrame([(*x, "k", 5, b"s") for x in rows], "conv_id long, turn long, role string, text string, place string, size int, string binary")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert nodes_of(df, most=most) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_trie_of_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert nodes_of(spark.createDataFrame([], schema)) == [] == nodes_of(spark.createDataFrame([(None, 1, "u", "x")], schema))
    borrowed = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)  # its two own turns are replaced by nothing
    rows = [(borrowed, 0, "u", "x"), (borrowed, 1, "u", "y")]
    assert nodes_of(spark.createDataFrame(rows, schema)) == brute_trie(rows) and len(brute_trie(rows)) == 1
    rows = [(1000, t, "u", f"{t}" * 2000) for t in range(900)] + [(1001, t, "u", f"{t}" * 2000) for t in range(700)]
    assert nodes_of(spark.createDataFrame(rows, schema)) == brute_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=9), max_size=25))
def test_exit_nodes_by_fat_binary_search(strings):
    t = trie.ZFastTrie()
    spell = lambda s: b"".join(bytes([x]) * trie.TURN for x in s)
    for n, s in enumerate(strings):
        node, agree = t.exit(spell(s))
        best = max((next((i for i, (a, b) in enumerate(zip(s, o)) if a != b), min(len(s), len(o))) for o in strings[:n]), default=0)
        assert agree == best and node.above <= agree <= node.depth
        t.insert_batch([(spell(s), array("i", [1] * len(s)), (1, n, str(n)))])
        assert all(t.handles[v.string[:trie.fattest(v.above, v.depth) * trie.TURN]] is v for v in t.nodes[1:])


def test_ids_of_a_hot_string_are_hashed_in_order(spark, monkeypatch):
    df = spark.range(50_000).select((F.lit(10) - F.col("id")).alias("conv_id"), F.lit(b"p" * 16).alias("place"))
    got = trie.ends_of(df).collect()
    want = ",".join(str(10 - i) for i in range(49_999, -1, -1))
    assert [(r["n"], r["least"], r["ends_sha256"]) for r in got] == [(50_000, 10 - 49_999, hashlib.sha256(want.encode()).hexdigest())]


# The registered queries

def test_registered_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rated = QUERIES["op11_bradley_terry_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = rated[rated.held_out]
    assert QUERIES["op11_bradley_terry_quality"](spark, SF).count() == docs.count() and (held.predicted == held.quality).mean() > 0.85
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    want, sha = brute_codes([(r["vec_id"], r["embedding"]) for r in vectors])
    got = QUERIES["op12_vector_codes"](spark, SF).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {sha}
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nodes = QUERIES["op13_conversation_trie"](spark, SF)
    assert sorted((tuple(r) for r in nodes.collect()), key=str) == brute_trie(turns)
