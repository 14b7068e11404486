"""Identity of batches and rows, whole comparisons, and input that no switch or size may lose."""
import json

from pyspark.sql import functions as F

from pisoval.operators.manifest import file_hashes, manifest_fingerprint
from pisoval.operators.reconcile import compare_results, reconcile
from pisoval.operators.trees import NODE_SCHEMA, TreeModel, score_trees
from pisoval.sources.listings import from_raw, parse_values, read_raw, unwrap_envelopes
from test_contract import BASE

from pisoval.streaming.valuation import read_stream_output, value_stream


def test_comparison_sees_copies_and_nulls(spark):
    schema = "k long, a double, b double, t string"
    left = spark.createDataFrame([(1, 1.0, 5.0, "x"), (1, 2.0, 6.0, "x"), (2, None, 1.0, "x"), (3, 1.0, 1.0, "x"), (4, 1.0, 1.0, "x")], schema)
    right = spark.createDataFrame([(1, 1.0, 6.0, "x"), (1, 2.0, 5.0, "x"), (2, 9.0, 1.0, "x"), (3, 1.0 + 1e-10, 1.0, "x"), (4, 1.0, 1.0, "x")], schema)
    got = {r["k"]: r for r in compare_results(left, right, "k", ["a", "b", "t"]).collect()}
    assert [got[k]["comparacion"] for k in (1, 2, 3, 4)] == ["distinto", "distinto", "distinto", "igual"]
    assert [got[k]["solo_numerico"] for k in (1, 2, 3, 4)] == [False, False, True, True]

    def within(k):
        return reconcile(left.filter(F.col("k").isin(k)), right.filter(F.col("k").isin(k)), "k", ["a", "b", "t"]).first()["dentro_de_tolerancia"]
    assert within([3, 4]) and not within([1]) and not within([2])
    assert not reconcile(left.filter("k = 4"), right.filter("k = 3"), "k", ["a", "b", "t"]).first()["dentro_de_tolerancia"]


def test_odd_envelopes_stay(spark):
    values = ['{"anuncios": 5}', '{"anuncios": null}', '{"anuncios": {"a": 1}}', '{"anuncios": 5, "elementList": [{"propertyCode": 77}]}', '{"elementList": []}', '{"propertyCode": 1.5}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, value string")
    rows = unwrap_envelopes(parse_values(df).drop("value"))
    assert {r["n"]: r["c"] for r in rows.groupBy("n").agg(F.count("*").alias("c")).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 5: 1}
    assert rows.filter("n < 3 and raw is not null").count() == 0
    assert {r["n"]: r["propertyCode"] for r in from_raw(rows).collect() if r["n"] > 2} == {3: "77", 5: "1.5"}


def test_lines_know_their_place(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"propertyCode": f"p{i:04d}"}) if i != 7 else '{"anuncios": [{"propertyCode": "in"}]}' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = from_raw(read_raw(spark, str(tmp_path), lines=True)).select("batch_id", "row_id", "propertyCode").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["batch_id"] for r in rows}) == 2 and len(rows) == 3000
    assert all(r["propertyCode"] == f"p{r['row_id']:04d}" or (r["propertyCode"], r["row_id"]) == ("in", 0) for r in rows)


def test_missing_values_score_alike(spark):
    nodes = spark.createDataFrame([(0, 0, "x", 1.0, 1, 2, True, None), (0, 1, None, None, None, None, None, 10.0), (0, 2, None, None, None, None, None, 20.0)],
                                  "tree int, node int, feature string, threshold float, left int, right int, default_left boolean, leaf float")
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (2.0,)], "x double")
    model = TreeModel(nodes, ["x"], 0.0)
    both = [[r["score"] for r in score_trees(df, model, expression_nodes=n).collect()] for n in (400, 0)]
    assert both[0] == both[1] == [10.0, 10.0, 10.0, 20.0]


def test_stream_takes_batches_from_files(spark, refs, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):  # the code `s` is in every file, twice in the last
        values = [{**BASE, "propertyCode": "s"}, {**BASE, "propertyCode": f"own{i}"}] + [{**BASE, "propertyCode": "s"}] * (i == 4)
        (tmp_path / "in" / f"f{i}.jsonl").write_text("\n".join(map(json.dumps, values)))
    seen = []
    for n in (1, 1000):
        value_stream(spark, str(tmp_path / "in"), refs, str(tmp_path / f"out{n}"), str(tmp_path / f"state{n}"), max_files=n).awaitTermination()
        good, bad = read_stream_output(spark, str(tmp_path / f"out{n}"), refs)
        seen.append((sorted((r["batch_id"], r["row_id"], r["propertyCode"], r["precio_estimado"]) for r in good.collect()),
                     sorted((r["batch_id"], r["indice"], r["detalle"]) for r in bad.collect())))
    assert seen[0] == seen[1] and len(seen[0][0]) == 9 and [b[1] for b in seen[0][1]] == [0, 2]


def test_file_names_hold_their_folder(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part-0").write_text(folder)
    assert sorted(r["nombre"] for r in file_hashes(spark, str(tmp_path)).collect()) == ["a/part-0", "b/part-0"]
    entries = spark.createDataFrame([("p", "b", "2"), ("p", "a", "1"), (None, "c", "3")], "g string, nombre string, sha256 string")
    import hashlib
    want = {"p": '{"a":"1","b":"2"}', None: '{"c":"3"}'}
    assert {r["g"]: r["paquete_sha256"] for r in manifest_fingerprint(entries, "g").collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_long_files_stream_through_a_digest(spark, tmp_path):
    import gzip
    import hashlib
    import random
    r = random.Random(3)
    mark = b"\xef\xbb\xbf"
    contents = {"bytes": r.randbytes(200_000), "lines": b"a\n" * 5000 + b"\n", "open end": b"a\r\nb\xff\n\nc", "m+%1": mark + b"x\ny", "m2": mark + b"x\n", "m3": mark,
                "empty": b"", "feed": b"\n", "one": b"z", "p.gz": gzip.compress(b"a\nb" * 99)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = {n: hashlib.sha256(c).hexdigest() for n, c in contents.items() if c}  # readers list no empty file
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        for bound in (0, 5000, 1 << 30):
            assert {r["nombre"]: r["sha256"] for r in file_hashes(spark, str(tmp_path), bound).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_files_are_never_read_whole(spark, tmp_path):
    import gzip
    import hashlib
    content = {"short": b"abc\n", "long": b"0123456789\n" * 900, "packed.gz": gzip.compress(b"q" * 99, mtime=0)}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        for bound in (10, 1000):
            got = {r["nombre"]: r["sha256"] for r in file_hashes(spark, str(tmp_path), bound).collect()}
            assert got == {n: hashlib.sha256(data).hexdigest() for n, data in content.items()}
    finally:
        spark.conf.set(key, before)


def test_packed_forest_walks_like_nodes(spark):
    """Trees of unlike depth, gaps between node numbers, a lone leaf; missing values; passes of few nodes."""
    rows = [(0, 0, "a", 1.0, 7, 900, True, None), (0, 7, None, None, None, None, None, 0.25), (0, 900, "b", 2.0, 901, 950, False, None),
            (0, 901, "a", 5.0, 960, 970, False, None), (0, 950, None, None, None, None, None, -1.5), (0, 960, None, None, None, None, None, 3.0),
            (0, 970, None, None, None, None, None, 4.0), (3, 0, None, None, None, None, None, 0.5),
            (8, 0, "b", 0.0, 2, 1, True, None), (8, 1, None, None, None, None, None, 8.0), (8, 2, None, None, None, None, None, 16.0)]
    nodes = spark.createDataFrame(rows, "tree int, node int, feature string, threshold float, left int, right int, default_left boolean, leaf float")
    places = {(r[0], r[1]): r for r in rows}

    def walk(tree, values):
        r = places[tree, 0]
        while r[2] is not None:
            v = values[r[2]]
            r = places[tree, r[4] if (r[6] if v is None else v < r[3]) else r[5]]
        return r[7]

    given = [(a, b) for a in (None, 0.5, 1.0, 4.0, 9.0) for b in (None, -1.0, 0.0, 1.0, 2.0)]
    df = spark.createDataFrame(given, "a double, b double")
    want = {g: 1.0 + sum(walk(t, dict(zip("ab", g))) for t in (0, 3, 8)) for g in given}
    for bounds in ({"expression_nodes": 0}, {"expression_nodes": 0, "nodes_per_pass": 4}, {}):
        assert {(r["a"], r["b"]): r["score"] for r in score_trees(df, TreeModel(nodes, ["a", "b"], 1.0), **bounds).collect()} == want


def test_a_small_ensemble_leaves_its_method_room(spark):
    """The virtual machine leaves methods beyond 8,000 bytes uncompiled, and a valuation's stage holds more than the ensemble."""
    import re
    from pisoval.sources.driver_tables import META, small_model
    df = spark.range(10).select(*[(F.col("id") / (i + 1)).alias(c) for i, c in enumerate(META.columnas)])
    out = score_trees(df, small_model(spark), "score")
    text = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 6000


def test_missing_values_go_either_default_way(spark):
    rows = [(t, n, *rest) for t, default in ((0, True), (1, False)) for n, *rest in (
        (0, "x", 1.0, 1, 2, default, None), (1, None, None, None, None, None, 10.0 * (t + 1)), (2, None, None, None, None, None, 1.0 * (t + 1)))]
    model = TreeModel(spark.createDataFrame(rows, NODE_SCHEMA), ["x"], 0.0)
    df = spark.createDataFrame([(v,) for v in (None, float("nan"), float("inf"), -float("inf"), 1.0, 0.5, -0.0)], "x double")
    both = [[r["score"] for r in score_trees(df, model, expression_nodes=n).collect()] for n in (400, 0)]
    assert both[0] == both[1] == [12.0, 12.0, 3.0, 30.0, 3.0, 30.0, 30.0]
