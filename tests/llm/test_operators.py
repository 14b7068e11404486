"""Each operator against brute force, round trips or held-out labels, and on nulls, empties, ties, repeats and clashing names."""
import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pisoval.llm import chat, html_text, licenses, sentence_pieces as sp, toxicity
from pisoval.llm.graph import components
from pisoval.llm.mixing import mix_documents, mix_sizes, mixed_rows, split_quotas
from pisoval.llm.near_text import _cross, near_duplicates, signatures
from pisoval.llm.near_vectors import near_vectors
from pisoval.llm.neighbours import nearest
from pisoval.llm.sharding import kd_shards
from pisoval.llm.template import TemplateError, compile_template, fold, parse
from pisoval.llm.words import mix, shingles, text_keys, word_hashes

R = random.Random(4)
WORDS = ["".join(R.choices("abcdefghilmnoprstu", k=R.randint(2, 7))) for _ in range(400)]
#: Names that the operators use inside.
CLASH = {"row": "x", "k": 1, "v": 2, "id": "y", "score": 0.5, "shard": 9, "component": 3, "takes": "t", "key": "z", "ids": 4}


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def documents(spark, rows):
    """rows: (doc_id, text, source); with columns whose names clash."""
    schema = "doc_id long, text string, source string, row string, k int, v int, id string, score double, shard int, component int, takes string, key string, ids int"
    return spark.createDataFrame([(*r, *CLASH.values()) for r in rows], schema)


# Words

def test_word_hashes_follow_words_not_places():
    h, n = word_hashes(pa.array(["ab  cd", None, "", " cd\tab\n", "x" * 5000]))
    assert n.tolist() == [2, 0, 0, 2, 1] and h[0] == h[3] and h[1] == h[2]
    assert len(set(text_keys(h, n)[[0, 3, 4]])) == 3
    values, text = shingles(*word_hashes(pa.array(["a b c d e f", "a b", ""])))
    assert text.tolist() == [0, 0, 1]


# 1 Sharding

def test_kd_shards_balance_and_keep_groups(spark):
    rows = [(i, f"g{i % 700}", 5 + (i * 37) % 900, f"l{i % 4}") for i in range(4000)] + [(9000 + i, "hot", 300, "l1") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, g string, w long, lang string").withColumn("extent", F.xxhash64("g") % 1000)
    df = df.withColumn("lang", F.substring(F.md5("g"), 1, 1))
    out = kd_shards(df, "w", ["lang", "extent"], "g", ["doc_id"], shards=24).toPandas()
    assert sorted(out.doc_id) == sorted(r[0] for r in rows)
    load = out.groupby("shard").w.sum()
    assert len(load) == 24 and load.max() / load.mean() < 1.1 and load.min() / load.mean() > 0.9
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard").slot)
    parted = out.groupby("g").shard.nunique()
    assert (parted[parted.index != "hot"] > 1).sum() <= 23 and parted["hot"] >= 6  # a cut parts one group at the most


def test_kd_shards_edges(spark):
    schema = "doc_id long, g string, w long, lang string, x double, node int, keys string"
    assert kd_shards(spark.createDataFrame([], schema), "w", ["lang", "x"], "g", ["doc_id"], shards=4).count() == 0
    rows = [(1, None, None, None, None, 1, "k"), (1, None, None, None, float("nan"), 1, "k"), (None, "a", 3, "b", math.inf, 2, None)] * 3
    out = kd_shards(spark.createDataFrame(rows, schema), "w", ["lang", "x"], "g", ["doc_id"], target=4).toPandas()
    assert len(out) == 9 and all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard").slot)


# 2 Toxicity

@pytest.fixture(scope="module")
def insulted():
    r = random.Random(1)
    texts, labels = [], []
    for i in range(400):
        words = r.choices(WORDS, k=r.randint(5, 120))
        if i % 4 == 0:
            words[r.randrange(len(words))] = r.choice(["grumbolt", "snarkwit", "drivelpod"])
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_toxicity_learns_words_and_their_disguises(insulted):
    model = toxicity.train(*insulted)
    bad = model.word_scores(["grumbolt", "snarkwit", "drivelpod", "grum-bolt", "snark1wit", "g.r.u.m.b.o.l.t", "drivelpods"])
    assert bad.min() > model.word_scores(WORDS).max()
    one = model.word_scores(["x" * 500 + "grumbolt" + "y" * 500, "z" * 1000])
    assert one[0] > one[1]  # windows cover words of any length
    assert "grumbolt" in toxicity.tokens("oh g r u m b o l t you")


def test_toxicity_scores_rows(spark, insulted):
    model = toxicity.train(*insulted)
    df = documents(spark, [(1, "grumbolt", "a"), (1, "grumbolt", "a"), (2, None, None), (None, "", "a"), (3, prose(20000, 3), "b"), (4, prose(20000, 3) + " snarkwit", "b")])
    out = toxicity.score(df, model)
    got = out.select("row.*", F.col("score").alias("tox")).toPandas()
    assert list(got.columns) == [*df.columns, "tox"] and len(got) == 6 and got.tox.between(0, 1).all()
    assert got.tox[got.text == "grumbolt"].min() > 0.5 > got.tox[got.text.isna() | (got.text == "")].max()
    assert got.tox[got.doc_id == 4].iloc[0] > got.tox[got.doc_id == 3].iloc[0]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_fit_uses_no_held_out_label(spark, insulted):
    texts, labels = insulted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    turned = known.withColumn("toxic", F.when(toxicity.in_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, known), toxicity.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.link, b.link)
    scored = toxicity.score(docs, a).select("row.doc_id", "score").toPandas()
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(scored.score[scored.doc_id == i].iloc[0] >= 0.5) == bool(labels[i]) for i in held]
    assert np.mean(right) > 0.95
    assert toxicity.fit(docs.limit(0), known).document_scores(np.zeros((1, 4))).shape == (1,)


@pytest.mark.parametrize("label, words", [(1, 80_000), (0, 80_000), (1, 30_000), (0, 30_000)])
def test_toxicity_fit_is_not_decided_by_one_long_text(spark, insulted, monkeypatch, label, words):
    texts, labels = insulted
    monkeypatch.setattr(toxicity, "CHARACTERS", 300_000)
    order = spark.range(20_000).where((F.col("id") < 400) | ~toxicity.in_held_out(F.col("id"))).orderBy(F.xxhash64("id"))
    giant = order.first()["id"]
    assert giant >= 400  # the long text is the first by hash
    docs = spark.createDataFrame([*enumerate(texts), (giant, prose(words, 2))], "doc_id long, text string")
    known = spark.createDataFrame([*enumerate(labels), (giant, label)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, known)).select("row.doc_id", "score").toPandas().set_index("doc_id").score
    assert np.mean([(scored[i] >= 0.5) == bool(y) for i, y in enumerate(labels)]) > 0.95


# 3 Page text

def test_extracts_layouts_never_seen():
    page = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><div id=page><div class="site-header">Daily</div>
    <ul class="menu"><li><a href=/>Home</a><li><a href=/x>News about things</a></ul><div class="cookie-banner">We use cookies, please agree now.</div>
    <main class="story"><h1>A &amp; B</h1><p>First <b>bold
    words<p>Second&nbsp;one.<br>Still   it.<ul><li>Item one<li>Item two, a bit longer than one</ul><!-- <p>hidden</p> --></main>
    <form class=newsletter><label>Your mail</label><button>Go</button></form><section id="comments"><div class="comment"><p>I do not agree at all with this.</p></div></section>
    <aside class="related"><a href=/1>Other story</a></aside><footer>&copy; 2020 Daily</footer></div></body>"""
    assert html_text.main_text(page) == "A & B\n\nFirst bold words\n\nSecond one. Still it.\n\nItem one\n\nItem two, a bit longer than one"


def test_extract_model_holds_out(spark):
    from pisoval.llm.html_samples import labelled_pages
    model, right, n = html_text.trained(), 0, 0
    for source in labelled_pages(80, seed=77):
        page = html_text.Page(source, labels=True)
        for label, own, p in zip(page.label, page.own, model.marginals(page)):
            if own and label in "bc":
                n, right = n + 1, right + ((p >= 0.5) == (label == "c"))
    assert right / n > 0.97


def test_marginals_equal_brute_force():
    from itertools import product
    model, page = html_text.trained(), html_text.Page("<html><body><article><p>a b c</p></article><footer>x</footer></body></html>")
    evidence, total, content = page.evidence(), 0.0, np.zeros(len(page.tag))
    for states in product(range(3), repeat=len(page.tag)):
        p = model.root[states[0]]
        for i, s in enumerate(states):
            p *= math.prod(model.kinds[k].get(evidence[i][k], [1.0] * 3)[s] for k in range(4)) * (model.step[states[page.parent[i]]][s] if i else 1)
        total += p
        content += p * (np.array(states) == 1)
    assert np.allclose(content / total, model.marginals(page))


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, "u", "<p>" * 3000 + "deep"), (None, "u", "plain words only"), (4, "u", "<a href=\"unclosed " * 2000)], "page_id long, url string, html string")
    out = html_text.extract(df).toPandas()
    assert len(out) == 5 and out.text[out.page_id == 1].iloc[0] == "" and (out.text.str.len() == out.n_chars).all()
    assert html_text.extract(df.limit(0)).count() == 0


# 4 Chat

@pytest.mark.parametrize("tag", "svg noscript template select math object".split())
def test_skipped_elements_end_with_their_parent(tag):
    words = "plain words of an article, many enough to be content, and more of them follow here. " * 4
    frame = "<html><body><article><h1>T</h1>{}<p>second {}</p></article><footer>legal</footer></body></html>"
    unclosed = [f"<p>{words}<{tag}> x</p>", f"<p>{words}</p><{tag}>", f"<{tag}><p>{words}</p>"]
    for page in unclosed:
        text = html_text.main_text(frame.format(page, words))
        assert text.count("plain words") == 8 and "second plain" in text and "legal" not in text
    # An element of the same name later on doesn't lengthen one that its parent ended.
    text = html_text.main_text(frame.format(f"<p>{words}<{tag}> x</p>", words) + f"<{tag}></{tag}>")
    assert text.count("plain words") == 8
    closed = html_text.main_text(frame.format(f"<p>{words}<{tag}><b>inner</b></{tag}> tail</p>", words))
    assert ("inner" in closed) == (tag in ("math", "object")) and "tail" in closed and closed.count("plain words") == 8


def test_deep_pages_take_time_by_length():
    for tag in ("div", "b", "li"):
        start = time.perf_counter()
        html_text.main_text("<html><body><article>" + f"<{tag}>x " * 60_000 + f"</{tag}>" * 60_000 + "</article></body></html>")
        assert time.perf_counter() - start < 20


def test_template_language():
    source = "{% set a = 'x' ~ 1 %}{{ a }}{% for i in list %}{{ loop.index }}{% if loop.last %}!{% elif i.b is defined %}-{{ i['b'] | upper }}-{% else %},{% endif %}{% endfor %}{# c #}{{ none }}{{ 'y' if 1 + 1 == 2 else q }}"
    run = compile_template(source)
    assert "".join(t for t, _ in run({"list": iter([{}, {"b": "z"}, {}])})) == "x11,2-Z-3!y"
    assert fold(parse("{{ 'a' ~ 'b' }}{% if 1 > 2 %}no{% else %}c{% endif %}d"), {}) == [("text", "abcd")]
    assert list(compile_template("{% generation %}a{{ x }}{% endgeneration %}b")({"x": 1})) == [("a", True), ("1", True), ("b", False)]
    assert "".join(t for t, _ in compile_template("{{ x.__class__ }}{{ x.upper }}")({"x": "s"})) == ""  # mappings only
    for bad in ("{{ x", "{% if %}", "{% for x %}{% endfor %}", "{% endif %}", "{{ f() }}", "{% if a %}", "{{ 'a' | nope }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "/", "[", "a", "é\n", "s>", "|"]), max_size=8).map("".join)), max_size=6), st.integers(1, 30))
def test_chat_round_trip(turns, size):
    render = compile_template(chat.TEMPLATE, {"guard": chat.guard})
    whole = list(render({"messages": ({"role": r, "text": t} for r, t in turns)}))
    reader, old = chat.Reader(), chat.CHUNK
    chat.CHUNK = size
    try:
        for text, spans in chat.chunks(iter(whole)):
            reader.feed(text, [{"start": a, "end": b} for a, b in spans])
    finally:
        chat.CHUNK = old
    assert reader.n == len(turns) and reader.turns.hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert reader.loss.hexdigest() == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
    assert reader.loss_chars == sum(len(t) for r, t in turns if r == "assistant") and reader.length == sum(len(t) for t, _ in whole)


def test_chat_rows(spark):
    schema = "conv_id long, turn long, role string, text string, chunk int, formatted string"
    rows = [(1, 1, "assistant", "b", 0, ""), (1, 0, "user", "a", 0, ""), (2, None, None, None, 0, ""), (2, 0, "tool", "x" * 200_000, 0, ""), (None, 3, "user", "", 0, None), (3, 0, "assistant", "r", 1, ""), (3, 0, "assistant", "r", 1, "")]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1]["turns_sha256"] == digest("user\na\nassistant\nb\n") and out[1]["loss_sha256"] == digest("b")
    assert out[2]["turns_sha256"] == digest("\n\ntool\n" + "x" * 200_000 + "\n") and out[2]["n_turns"] == 2 and out[2]["loss_chars"] == 0
    assert out[None]["n_turns"] == 1 and out[3]["loss_sha256"] == digest("rr")
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


# 5 and 7 Vectors

def vectors(n=900, d=24, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    x[50:170] = x[49] + 0.08 * r.standard_normal((120, d))  # a group of near copies
    x[200], x[201] = x[199], 3 * x[199]
    return x


def frame(spark, x, more=()):
    return spark.createDataFrame([(i, [float(c) for c in v], 1, b"x") for i, v in enumerate(x)] + list(more), "vec_id long, embedding array<double>, shard int, vec binary")


ODD = [(2000, None, 1, None), (2001, [], 1, None), (2002, [0.0] * 24, 1, None), (2003, [1.0] * 23 + [None], 1, None), (2004, [math.nan] + [1.0] * 23, 1, None), (2005, [1.0] * 5, 1, None), (2006, [math.inf] * 24, 1, None)]


def test_nearest_recall_and_order(spark):
    x = vectors()
    out = nearest(frame(spark, x, [*ODD, (None, [1.0] * 24, 1, None)]), "id % 20 = 0").toPandas()
    s = x @ x.T
    hit = 0
    for q in range(0, 900, 20):
        got = out[out.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 21)) and q not in set(got.id)
        assert np.allclose(got.score, s[q, got.id]) and got.score.is_monotonic_decreasing
        best = [i for i in np.lexsort((np.arange(900), -s[q])) if i != q][:20]
        hit += len(set(best) & set(got.id))
    assert set(out.query_id) == set(range(0, 900, 20)) and hit / (45 * 20) >= 0.9


@pytest.mark.parametrize("spread", [0.0, 0.4, 0.7, 1.0])
def test_nearest_recall_for_varied_lengths(spark, spread):
    g = np.random.default_rng(11)
    x = g.standard_normal((6000, 64))
    x *= np.exp(spread * g.standard_normal(len(x)))[:, None] / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("id") % 40 == 0).toPandas().groupby("query_id").id.agg(set)
    hits = 0
    for q in range(0, len(x), 40):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 150 and hits >= 0.9 * 20 * 150


def test_nearest_few_and_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in (20, 3, 1, 7)] + [(40, [1.0, 0.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    out = nearest(df, "id % 20 = 0").orderBy("query_id", "rank").toPandas()
    assert out[out.query_id == 20].id.tolist() == [1, 3, 7, 40] and out[out.query_id == 40].id.tolist() == [1, 3, 7, 20]
    assert nearest(df.limit(0), "id % 20 = 0").count() == 0


def test_near_vectors_equal_brute_force(spark):
    x = vectors()
    out = near_vectors(frame(spark, x, [*ODD, (5, [float(c) for c in x[5]], 1, None)])).toPandas()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(900)
    for _ in range(200):
        label = np.minimum(label, np.where(near, label[None, :], 10**6).min(1))
    links = near.sum(1)
    links[5] += 1
    assert len(out) == 900 + len(ODD) + 1 and near.sum() > 10_000
    got = out[out.id < 900].drop_duplicates().set_index("id")
    assert (got.n_links.to_numpy() == links[got.index]).all() and (got.component_id.to_numpy() == label[got.index]).all()
    odd = out[out.id >= 2000]
    assert (odd.n_links == 0).all() and (odd.component_id == odd.id).all() and odd.kept.all() and len(odd) == len(ODD)
    assert near_vectors(frame(spark, x[:0])).count() == 0


def test_near_vectors_find_all_pairs_inside_a_dense_group(spark):
    """A third of all rows at cosine 0.9 to each other, with pairs at 0.951 among them: a window is full of group mates."""
    r, n, d, planted = np.random.default_rng(4), 6000, 64, 700

    def across(z, *axes):
        for a in axes:
            z = z - (z * a).sum(1, keepdims=True) * a
        return z / np.linalg.norm(z, axis=1, keepdims=True)

    x, centre = across(r.standard_normal((n, d))), across(r.standard_normal((1, d)))
    own = across(r.standard_normal((n // 3, d)), centre)
    first, q = own[:planted], (0.951 - 0.9) / 0.1
    own[planted:2 * planted] = q * first + np.sqrt(1 - q * q) * across(r.standard_normal((planted, d)), centre, first)
    x[:n // 3] = np.sqrt(0.9) * centre + np.sqrt(0.1) * own
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(n)
    for _ in range(12):
        label = np.minimum(label, np.where(near, label[None, :], n).min(1))
    got = near_vectors(frame(spark, x)).toPandas().set_index("id").sort_index()
    assert near.sum() >= 2 * planted and (got.n_links.to_numpy() == near.sum(1)).all()
    assert (got.component_id.to_numpy() == label).all() and (got.kept.to_numpy() == (label == np.arange(n))).all()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(500, 501), (501, 500), (7, 7), (900, 900), (None, 1)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500, 900: 900}


# 6 Near-duplicate texts

def bags(text):
    w = text.lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    h, a = np.sort(mix(np.arange(300, dtype=np.uint64))), r.integers(1, 12, 300)
    b = np.where(r.random(300) < 0.6, a, r.integers(1, 12, 300))
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    rows = [signatures(np.tile(mix(h + np.uint64(i * 7919)), 2), np.repeat([0, 1], 300), np.concatenate([a, b]), 2) for i in range(80)]
    assert abs(np.mean([(s[0] == s[1]).mean() for s in rows]) - true) < 0.02


def test_similar_texts_of_unlike_signatures_are_held_against_each_other():
    bag, r = np.arange(90, dtype=np.uint32), np.random.default_rng(1)
    prints = [r.integers(0, 1000, 64).astype(np.uint16) for _ in range(2)]
    own = {"v": [1, 2], "block": [0, 0], "c": [1, 2], "prints": [x.tobytes() for x in prints], "bits": [np.zeros(16, np.int64).tobytes()] * 2,
           "bag": [bag.tobytes(), (bag + 10).astype(np.uint32).tobytes()]}
    assert list(_cross([0, 7, 0, 0], own, 0.8)) == [(1, 2)]


def test_near_duplicates_equal_brute_force(spark):
    r, rows = random.Random(8), []
    for g in range(60):
        words = prose(r.randint(30, 200), g).split()
        for c in range(r.choice([1, 1, 2, 3, 12])):
            own = words[:]
            for _ in range(r.randint(0, max(1, len(own) // 60)) if c else 0):
                own[r.randrange(len(own))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(own), "s"))
    base = prose(150, 999).split()
    for c in range(150):  # a large group whose members are nearer to its first than to each other
        own = base[:]
        own[(c * 7) % 150] = f"edit{c}"
        rows.append((len(rows), " ".join(own), "s"))
    rows += [(5000, None, "s"), (5001, None, None), (5002, "", "s"), (5003, " \n", "s"), (5004, "Two  words", "s"), (5005, "two words", "s"), (3, rows[3][1], "s"), (None, rows[0][1], "s"), (5006, prose(30000, 5), "s")]
    out = near_duplicates(documents(spark, rows)).toPandas()
    assert len(out) == len(rows)
    own = [(i, t) for i, t, _ in rows if i is not None and t and t.split()]
    sets = [(i, bags(t)) for i, t in own]
    label = {i: i for i, _ in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if top(i) != top(j):
                both = sum((a & b).values())
                if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                    lo, hi = sorted((top(i), top(j)))
                    label[hi] = lo
    got = out.dropna(subset=["id"]).drop_duplicates("id").set_index("id").class_id
    assert {i: top(i) for i in label} == {i: int(got[i]) for i in label}
    assert got[5000] == 5000 and got[5001] == 5001 and got[5003] == 5002 and got[5005] == 5004
    assert out.class_id[out.id.isna()].iloc[0] == 0
    kept = out[out.kept].drop_duplicates()
    assert sorted(kept.class_id) == sorted(set(out.class_id))
    assert near_duplicates(documents(spark, [])).count() == 0


# 8 Mixing

def test_mix_meets_targets(spark):
    r = random.Random(3)
    rows = [(i, prose(r.randint(0, 90), i), r.choice(["a"] * 6 + ["b", "c", None])) for i in range(1500)]
    rows += [(2000, None, "a"), (2001, "", "zero"), (2002, prose(30000, 1), "b"), (1, rows[1][1], rows[1][2])]
    df = documents(spark, rows)
    out = mix_documents(df).select("row.*", "size", "source_size", "target", F.size("takes").alias("times")).toPandas()
    assert len(out) == len(rows) and out.times.fillna(0).between(-1, 3).all()
    out["taken"] = out["size"] * out.times.clip(lower=0)
    by = out.assign(source=out.source.fillna("~")).groupby("source").agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"))
    total = by["size"].sum()
    weight = {"a": 1, "b": 2, "c": 3, "zero": 1, "~": 2}
    target, free = {}, dict(by["size"])
    left = float(total)
    while True:  # shares by weight; what would pass three times a source's size stops there
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * free[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * free.pop(s)
            left -= target[s]
    target |= {s: level * weight[s] for s in free}
    for s, row in by.iterrows():
        assert row.target == pytest.approx(target[s]) and abs(row.taken - row.target) <= max(40, 0.01 * row.target), s
    again = mix_documents(df.repartition(7)).select("row.doc_id", "size", "takes").toPandas()
    key = lambda f: sorted((i, n, str(t)) for i, n, t in zip(f["doc_id"], f["size"], f["takes"]))
    assert key(again) == key(mix_documents(df).select("row.doc_id", "size", "takes").toPandas())
    copies = mixed_rows(df)
    assert copies.columns == df.columns and copies.count() == out.times.clip(lower=0).sum()
    assert mix_documents(df.limit(0)).count() == 0 and mixed_rows(df.limit(0)).count() == 0


def test_split_quotas_are_exact_and_spread(spark):
    quotas = {"a": 400, "b": 37, "c": 1, "d": 0}
    out = split_quotas(spark.createDataFrame(list(quotas.items()), "k string, quota long"), 7).toPandas()
    assert out.groupby("k").quota.sum().to_dict() == quotas
    per = out.groupby("shard").quota.sum()
    assert len(per) == 7 and per.max() - per.min() <= 1 and (out.quota >= 0).all()
    for _, own in out.groupby("k"):
        own = own.sort_values("shard")
        assert own.start.tolist() == (own.quota.cumsum() - own.quota).tolist()
    draws = [split_quotas(spark.createDataFrame([("a", 30), ("b", 70)], "k string, quota long"), 2, seed).where("shard = 0 and k = 'a'").first()["quota"] for seed in range(25)]
    assert abs(np.mean(draws) - 15) < 2 and 1 < np.std(draws) < 4  # hypergeometric: mean 15, deviation 2.3


def test_mix_plan_runs_no_python(spark):
    df = documents(spark, [(1, "a b", "x")])
    plan = mix_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_mix_is_the_same_with_a_broadcast_or_shuffled_plan(spark):
    rows = [(i, prose(i % 40, i), "abc"[i % 7 % 3]) for i in range(400)] + [(5, prose(5, 5), "c"), (None, None, None), (None, "", None)]
    df = documents(spark, rows).withColumn("k", F.lit("own")).withColumn("takes", F.lit(7))
    key = lambda f: sorted((str(i), n, s, t, str(x)) for i, n, s, t, x in f.collect())
    sizes = key(mix_sizes(df))
    assert len(sizes) == len(rows)
    for most in (0, 1 << 20):
        whole = mix_documents(df, max_bytes=most)
        assert key(mix_sizes(df, max_bytes=most)) == sizes == key(whole.select("row.doc_id", "size", "source_size", "target", "takes"))
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (most == 0) and ("BroadcastHashJoin" in plan) == (most > 0)
    assert mix_sizes(df.limit(0)).count() == 0


# 9 Licenses

def test_licenses_planted(spark):
    near = licenses.TEMPLATES["MIT (full)"].replace("any person", "every person")
    rows = [(1, prose(50, 1) + "\nReleased under the MIT  license!\n" + prose(400, 2) + " released under the MIT License " + prose(3, 4), "s"), (2, near, "s"), (3, prose(3000, 3), "s"), (4, None, "s"), (5, "", "s"),
            (6, "all rights reserved", "s"), (6, "all rights reserved", "s"), (None, "Licensed under CC BY-NC 4.0", "s"), (7, "licensed under the other terms of a license version 3", "s"),
            (8, "x " * 40000 + licenses.TEMPLATES["GPL-3.0"], "s")]
    out = licenses.scan_licenses(documents(spark, rows)).toPandas()
    got = sorted((-1 if math.isnan(i) else int(i), n, m) for i, n, m in zip(out.id, out.license, out.matches))
    assert got == [(-1, "CC-BY-NC-4.0", 1), (1, "MIT", 2), (2, "MIT (full)", 1), (6, "All rights reserved", 1), (6, "All rights reserved", 1), (8, "GPL-3.0", 1)]
    assert out.first_word[out.id == 1].iloc[0] == 50 and out.first_word[out.id == 8].iloc[0] == 40000
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_bands_find_what_all_windows_hold():
    library = licenses.Library(licenses.TEMPLATES)
    for seed in range(40):
        r = random.Random(seed)
        words = r.choices(WORDS, k=60)
        name = r.choice(sorted(licenses.TEMPLATES))
        at = r.randrange(60)
        text = " ".join(words[:at] + [licenses.TEMPLATES[name].lower()] + words[at:])
        values, _ = shingles(*word_hashes(pa.array([text]), licenses.MARKS), licenses.WORDS)
        assert name in {m[0] for m in library.scan(values)} and len(library.candidates(values, np.zeros(len(values), int))) == 1


def test_adjacent_notices_are_counted(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0 (notice)"]
    altered = gpl.replace("redistribute", "share").replace("published", "issued")
    rows = [(1, mit + " " + mit, "s"), (2, mit * 3 + licenses.TEMPLATES["MIT (license)"], "s"), (3, prose(40, 1) + gpl + " " + altered + prose(40, 2), "s"),
            (4, mit + " " + gpl + " " + mit, "s"), (5, (mit + " ") * 3000, "s")]
    out = licenses.scan_licenses(documents(spark, rows)).toPandas()
    assert sorted(zip(out.id, out.license, out.matches)) == [
        (1, "MIT", 2), (2, "MIT", 3), (2, "MIT (license)", 1), (3, "GPL-3.0 (notice)", 2), (4, "GPL-3.0 (notice)", 1), (4, "MIT", 2), (5, "MIT", 3000)]


def test_passages_equal_brute_force_over_all_windows():
    library = licenses.Library(licenses.TEMPLATES)
    templates = {t.name: t for ts in library.by_length.values() for t in ts}
    for seed in range(30):
        r = random.Random(seed)
        words = r.choices(WORDS, k=40)
        for _ in range(r.randrange(1, 5)):
            own = licenses.TEMPLATES[r.choice(sorted(templates))].lower().split()
            own = [w for w in own if r.random() > r.choice([0, 0.05, 0.15])]
            at = r.randrange(len(words))
            words[at:at] = own
        values, _ = shingles(*word_hashes(pa.array([" ".join(words)]), licenses.MARKS), licenses.WORDS)
        found = library.scan(values)
        for name, a, b, share in found:
            assert share >= licenses.CONTAINMENT and share == len(np.intersect1d(values[a:b], templates[name].values)) / len(templates[name].values)
        for name in {m[0] for m in found}:
            own = sorted(m[1:3] for m in found if m[0] == name)
            assert all(x[1] <= y[0] for x, y in zip(own, own[1:]))
        for t in templates.values():
            n = len(t.values)
            for i in range(len(values)):
                share = len(np.intersect1d(values[i:i + n], t.values)) / n
                if share >= licenses.CONTAINMENT:  # told, or a better passage of this or another template lies across it
                    score = lambda m: 2 * m[3] * len(templates[m[0]].values) - (m[2] - m[1])
                    assert any(m[1] < i + n and i < m[2] and (m[3] >= share or m[0] == t.name and score(m) >= 2 * share * n - n) for m in found), (seed, t.name, share)


# 10 SentencePiece

@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL), sp.Codec(*sp.load())


def scanned(codec, text, chunk, margin=64):
    s = sp.normal(text)
    n, matrices, parts = -(-len(s) // chunk), [], []
    for k in range(n):
        low = max(k * chunk - margin, 0)
        left, part = k * chunk - low, s[low:k * chunk + chunk + margin]
        a, b = left if k else None, left + chunk if k < n - 1 else None
        lefts, rights = (codec.states(part, a) if k else [None]), (codec.states(part, b) if b else [None])
        at = codec.barriers(part)
        matrices.append([(sp._code(a, x) if x else sp.BEGIN, sp._code(b, y) if y else sp.END) for x in lefts for y in codec.trace(part, at, x, rights, ids=False)])
        parts.append((part, a, b))
    out = []
    for (part, a, b), (l, r) in zip(parts, sp.cut_states(matrices)):
        right = sp._span(b, r) if b else None
        out += codec.trace(part, codec.barriers(part), sp._span(a, l) if a is not None else None, [right])[right]
    return out


def test_encodes_as_the_library(library):
    processor, codec = library
    r = random.Random(1)
    alphabet = "abcdehilnorst  \n\tÄéß€日①<>0129.,'\"_%$#▁"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(600)] + ["".join(r.choices(sorted(codec.ids), k=6)) for _ in range(600)] + ["", " ", "\n", "a\x00b", "<s></s>", "👩‍👧", "aaaa" * 50]
    got = codec.encode(texts)
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == processor.encode(texts)
    for t, chunk in [(t, 97) for t in ("".join(r.choices("abcdehilnorst", k=700)), "".join(r.choices(alphabet, k=700)), "a" * 500, " " * 400, "\n" * 300, "ab" * 300)]:
        assert scanned(codec, t, chunk) == processor.encode(t)


def test_composition_is_associative():
    r = random.Random(2)
    for _ in range(50):
        a, b, c = ([(r.randrange(4), r.randrange(4)) for _ in range(6)] for _ in range(3))
        assert sp.compose(sp.compose(a, b), c) == sp.compose(a, sp.compose(b, c))


def test_encode_decode_rows(spark, library):
    processor, _ = library
    rows = [(1, "Hello  world\n", "s"), (1, "Hello  world\n", "s"), (2, None, None), (3, "", "s"), (None, prose(3000, 7) + "q" * 3000, "s"), (4, prose(3000, 7) + "q" * 3000, "s"), (5, " lead", "s")]
    df = documents(spark, rows)
    out = sp.decode(sp.encode(df, chunk=1000, check="same"))
    assert out.columns == [*df.columns, "token_ids", "same", "decoded"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["decoded"] == r["text"] and r["same"] for r in got)
    assert all((r["token_ids"] is None) if r["text"] is None else list(r["token_ids"]) == processor.encode(r["text"]) for r in got)
    assert sp.encode(df.limit(0)).count() == 0
