"""The pipeline's stages against brute force, on odd input, and in a row."""
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from pisoval.llm import sentence_pieces as sp, toxicity

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
    words = [w for w in words if w]
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def kept_by_brute_force(rows):
    """Smallest id of each class of texts of which a chain of pairs overlaps by 0.8 or more."""
    bags = {i: shingles(t) for i, t in rows if t}
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(i for i in bags if bags[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = sum((bags[a] & bags[b]).values())
            if both and both / sum((bags[a] | bags[b]).values()) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i for i in ids if root(i) == i}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_toxic_documents_go_by_their_score(spark, docs):
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.score(docs, model, keep=["doc_id"]).select("row.doc_id", "score").collect() if r["score"] < 0.5}
    got = cp.drop_toxic(spark, docs, SF)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {i: toxicity.tokens((t or "").lower()) for i, t in texts.items()}
    for i in list(texts)[:40]:  # one by one, without slices or what a task keeps
        scores = model.word_scores(sorted(words[i])) if words[i] else []
        import numpy as np
        alone = model.document_scores(np.array([toxicity._features(np.array(scores, float))]))[0]
        assert (alone < 0.5) == (i in want)


def test_one_document_of_each_class_stays(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = cp.near_dedup(spark, docs, SF)
    worded = {i for i, t in rows if t and t.strip()}
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} & worded == kept_by_brute_force(rows)


def test_mix_and_pieces(spark, docs):
    mixed = cp.mix(spark, docs, SF)
    words = docs.withColumn("n", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))
    total = words.agg(F.sum("n")).first()[0]
    taken = mixed.withColumn("n", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).agg(F.sum("n")).first()[0]
    assert abs(taken - total) < 0.05 * total and set(docs.columns) <= set(mixed.columns)
    from sentencepiece import SentencePieceProcessor
    p = SentencePieceProcessor(model_file=sp.MODEL)
    for r in cp.tokenize(spark, docs.limit(60), SF).collect():
        assert (r["token_ids"], r["n_tokens"]) == ((p.encode(r["text"]), len(p.encode(r["text"]))) if r["text"] is not None else (None, None))


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, v long, key string, text_key string, ids int"


def test_stages_take_odd_rows(spark):
    clash = ("r", 0.1, 1, "k", "t", 2)
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, " \n\t", "de", "b", 3),
            (4, "one two three four five six seven", "en", "a", 33), (5, "one two three four five six seven", "en", "b", 33), (None, "one two", "en", "a", 7),
            (6, "x" * 40_000, "en", "a", 40_000), (7, "w " * 30_000, "en", "c", 60_000)]
    odd = spark.createDataFrame([(*r, *clash) for r in rows], ODD)
    for name, stage in cp.STAGES:
        out = stage(spark, odd, SF)
        found = out.collect()
        assert set(odd.columns) <= set(out.columns), name
        counts = defaultdict(int)
        for r in found:
            counts[r["doc_id"], r["text"]] += 1
        if name in ("drop_toxic", "tokenize"):
            assert len(found) == len(rows), name
        if name == "near_dedup":
            assert counts[4, rows[5][1]] == 1 and counts[5, rows[6][1]] == 0 and counts[1, None] == 1 and counts[2, ""] == 1
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_run_is_the_stages_in_a_row(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "text", "token_ids", "n_tokens"} <= set(out.columns) and 0 < out.count() <= 3 * 200
    assert out.where("n_tokens <> size(token_ids)").count() == 0
