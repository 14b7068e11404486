"""Readers, packages, trees, reports and registered queries."""
import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from oracle_check import TABLES, compare
from pisoval.operators import manifest
from pisoval.operators.reconcile import reconcile
from pisoval.operators.trees import check_model, score_trees
from pisoval.sources import driver_tables as d
from pisoval.sources.listings import canonical, flatten, read_listings, read_raw
from pisoval.sources.packages import load_package, package_manifest, write_package
from pisoval.sources.polygons import polygon_shapes
from pisoval.sources.reference import read_metadata, read_references
from pisoval.sources.sinks import CSV, json_rows, write_native, write_report


def test_envelopes_and_lines(spark, tmp_path):
    one = {"propertyCode": "a", "size": "70", "rooms": 2, "detailedType": {"subTypology": "duplex"}, "hasLift": None}
    docs = {"k1.json": {"anuncios": [one, one]}, "k2.json": {"elementList": [one]}, "k3.json": one, "k4.json": [one, 5], "k5.json": {"anuncios": []}}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc))
    rows = read_raw(spark, str(tmp_path)).groupBy("batch_id").agg(F.count("*").alias("n"), F.max("row_id").alias("last")).collect()
    assert {r["batch_id"].rsplit("/", 1)[1]: (r["n"], r["last"]) for r in rows} == {"k1.json": (2, 1), "k2.json": (1, 0), "k3.json": (1, 0), "k4.json": (2, 1)}
    first = read_listings(spark, str(tmp_path / "k3.json")).first()
    assert (first["size"], first["rooms"], first["detailedType_subTypology"], first["hasLift"]) == (70.0, 2.0, "duplex", None)
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.jsonl").write_text("\n".join(json.dumps(v) for v in (one, one, {"anuncios": [one, one, one]})))
    lines = read_raw(spark, str(tmp_path / "l"), lines=True).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in lines) == [2, 3]


def test_frames_nested_and_flat(spark):
    nested = spark.createDataFrame([("a", (None, "studio"))], "propertyCode string, detailedType struct<typology:string,subTypology:string>")
    flat = flatten(nested)
    assert flat.columns == ["propertyCode", "detailedType.typology", "detailedType.subTypology"]
    for df in (nested, flat):
        row = canonical(df).first()
        assert row["detailedType_subTypology"] == "studio" and row["price"] is None


def model_json(rows, names, base):
    trees = []
    for t in sorted({r[0] for r in rows}):
        nodes = sorted(r for r in rows if r[0] == t)
        trees.append({"left_children": [-1 if n[2] is None else n[4] for n in nodes], "right_children": [-1 if n[2] is None else n[5] for n in nodes],
                      "split_indices": [0 if n[2] is None else names.index(n[2]) for n in nodes],
                      "split_conditions": [n[7] if n[2] is None else n[3] for n in nodes], "default_left": [int(bool(n[6])) for n in nodes]})
    return {"learner": {"feature_names": names, "learner_model_param": {"base_score": f"[{base}E0]"}, "gradient_booster": {"model": {"trees": trees}}}}


def test_package_round_trip_and_tampering(spark, refs, tmp_path):
    rows, names = d.tree_rows(), d.META.columnas
    (tmp_path / "modelo.json").write_text(json.dumps(model_json(rows, names, d.BASE_SCORE)))
    meta = {"version_paquete": 3, "columnas": names, "smearing": 1.0173, "mediana_planta_train": 2.0, "area_max_dominio": 240.0,
            "arboles": len(d.TREES), "nombre": "x", "rangos_train": {"ROOMNUMBER": {"min": 0, "max": 5}}}
    (tmp_path / "metadatos.json").write_text(json.dumps(meta))
    for name, df in (("barrios", polygon_shapes(refs.edges)), ("pois", refs.pois), ("variables_barrio", refs.area_features), ("indices_distrito", refs.district_index)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    package = read_references(spark, str(tmp_path))
    assert package.meta.rangos_train == {"ROOMNUMBER": (0.0, 5.0)} and package.model.base_score == d.BASE_SCORE
    assert sorted(map(tuple, package.model.nodes.collect()), key=lambda r: r[:2]) == sorted(map(tuple, refs.model.nodes.collect()), key=lambda r: r[:2])
    for wrong in ({**meta, "version_paquete": 2}, {**meta, "arboles": 9}, {**meta, "columnas": names[::-1]}, {**meta, "ano_precio": 2025}):
        (tmp_path / "metadatos.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            read_references(spark, str(tmp_path))
    files = manifest.file_hashes(spark, str(tmp_path / "pois.parquet")).cache()
    files.count()
    manifest.require_intact(files, files)
    with pytest.raises(ValueError):
        manifest.require_intact(files, files.withColumn("sha256", F.lit("0")))


def test_package_is_what_its_manifest_says(spark, refs, tmp_path):
    folder = str(tmp_path / "p")
    write_package(refs, folder)
    manifest_ = package_manifest(refs, folder)
    loaded = load_package(spark, folder, manifest_)
    assert (loaded.meta.paquete_sha256, len(loaded.meta.modelo_sha256)) == (manifest_["paquete_sha256"], 64)
    order = ["area_code", "ring_no", "edge_no"]
    assert loaded.edges.orderBy(order).collect() == refs.edges.orderBy(order).collect()
    assert sorted(map(tuple, loaded.model.nodes.collect()), key=lambda r: r[:2]) == sorted(map(tuple, refs.model.nodes.collect()), key=lambda r: r[:2])
    assert "poi_no" not in loaded.pois.columns and loaded.points.center == refs.points.center
    for wrong in ({**manifest_, "paquete_sha256": "0"}, {**manifest_, "trees": 3}, {**manifest_, "periodos": {"ano_base": 2017}}):
        with pytest.raises(ValueError):
            load_package(spark, folder, wrong)
    part = next((tmp_path / "p" / "modelo.json").glob("part-*"))
    part.write_text(part.read_text().replace("0.5", "0.6", 1))
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="modelo.json"):
        load_package(spark, folder, manifest_)


def test_scoring_ways_agree(spark, refs):
    rows = spark.range(500).select(*[F.when(F.col("id") % (7 + i) != 0, (F.col("id") * (13 + i) % 300) / 2.0).alias(c)
                                     for i, c in enumerate(refs.meta.columnas)], (F.col("id") % 5 != 0).alias("ok"), "id")
    ways = [score_trees(rows, refs.model, "s", F.col("ok")), score_trees(rows, refs.model, "s", F.col("ok"), expression_nodes=0),
            score_trees(rows, refs.model, "s", F.col("ok"), expression_nodes=0, nodes_per_pass=20)]
    a, b, c = [{r["id"]: r["s"] for r in w.select("id", "s").collect()} for w in ways]
    assert a == b == c and a[0] is None and a[1] is not None
    with pytest.raises(ValueError):
        check_model(refs.model, 11, refs.meta.columnas)


def test_sinks_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, None, float("nan")), (1, "x", 1.5)], "n int, t string, v double")
    write_native(df, str(tmp_path / "r.parquet"), "n")
    write_native(df, str(tmp_path / "r.csv"))
    assert spark.read.parquet(str(tmp_path / "r.parquet")).columns == ["t", "v"]
    assert spark.read.option("header", True).csv(str(tmp_path / "r.csv")).columns == ["n", "t", "v"]
    assert sorted(r[0] for r in json_rows(df).collect()) == ['{"n":1,"t":"x","v":1.5}', '{"n":2,"t":null,"v":null}']
    report = reconcile(df, df.filter("n = 1"), "n", ["t", "v"])
    write_report(report, str(tmp_path / "rep"))
    got = spark.read.json(str(tmp_path / "rep")).first()
    assert (got["iguales"], got["solo_izquierda"]) == (1, 1)


def test_metadata_version(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version_paquete": 4}')
    with pytest.raises(ValueError):
        read_metadata(spark, str(tmp_path / "m.json"))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_registered_query(spark, con, name):
    result = compare(spark, con, name, SF)
    assert result.startswith(("ok", "rows-only")), result


def test_csv_keeps_quotes_breaks_and_spaces(spark, tmp_path):
    values = ['a "b", c', "first\nsecond", "  at both ends ", "back\\slash", "", None, '"']
    rows = spark.createDataFrame(list(enumerate(values)), "n int, v string")
    write_native(rows.withColumn("order", F.col("n")), str(tmp_path / "rows"), "order")
    back = spark.read.schema("n int, v string").options(**CSV, multiLine=True).csv(str(tmp_path / "rows"))
    assert [r["v"] for r in back.orderBy("n").collect()] == [v or None for v in values]  # an empty text comes back as NULL


def test_listings_make_as_many_even_tasks_as_their_rows_need(spark, monkeypatch):
    from pyspark.sql import functions as F
    from pisoval import session
    from pisoval.sources import driver_tables
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    dealt = driver_tables.listings(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id().alias("p")).count()
    sizes = [r["count"] for r in dealt.collect()]
    assert sum(sizes) == 1500 and len(sizes) >= 25 and max(sizes) < 100
