"""The strict row contract, duplicates and the batch outcome."""
import json

import pytest
from pyspark.sql import functions as F

from pisoval.operators.duplicates import mark_duplicates
from pisoval.plans.batch import errors, read_outcome, results, value_batch, write_outcome
from pisoval.plans.contract import validate
from pisoval.plans.native import value_native
from pisoval.sources.listings import from_raw
from pisoval.streaming.valuation import read_stream_output, value_stream

# A point inside the area of nation 6, whose district has an index and a rent factor.
BASE = dict(propertyCode="s-1", operation="sale", municipality="Madrid", propertyType="flat", size=80, rooms=2, bathrooms=1,
            latitude=40.4168, longitude=-3.7214, floor="2", hasLift=True, price=450000,
            description="Cocina nueva, terraza de doce metros y trastero en el sótano.",
            parkingSpace={"hasParkingSpace": True})


def raw(spark, values, batch="b"):
    texts = [(batch, i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(texts, "batch_id string, row_id long, value string").select(
        "batch_id", "row_id", F.try_parse_json("value").alias("raw"))


def without(key):
    return {k: v for k, v in BASE.items() if k != key}


FIELDS = "Revisa los campos requeridos y sus tipos: "
CASES = [
    (BASE, None), ({**BASE, "operation": "rent", "price": 1500}, None), ({**BASE, "extra": [1]}, None),
    ({**BASE, "municipality": " MADRID　"}, None), ({**BASE, "size": 367}, None), ({**BASE, "size": 80.5}, None),
    ({**BASE, "propertyType": "homes", "detailedType": {"typology": "flat"}}, None), ({**BASE, "detailedType": None}, None),
    ({**BASE, "latitude": None}, "coordenadas"), ({**BASE, "latitude": 91}, "coordenadas"),
    ({**BASE, "hasLift": "false"}, FIELDS + "hasLift"), ({**BASE, "newDevelopment": "false"}, FIELDS + "newDevelopment"),
    ({**BASE, "rooms": 2.5}, FIELDS + "rooms"), ({**BASE, "rooms": 2.0}, FIELDS + "rooms"), ({**BASE, "rooms": True}, FIELDS + "rooms"),
    ({**BASE, "rooms": 10**400}, FIELDS + "rooms"), ({**BASE, "bathrooms": 2**31}, FIELDS + "bathrooms"), ({**BASE, "size": 10**400}, FIELDS + "size"),
    ({**BASE, "propertyType": "office"}, "Tipología"), ({**BASE, "propertyType": "chalet"}, "Tipología"),
    ({**BASE, "propertyType": "homes"}, "Tipología"), ({**BASE, "detailedType": {"subTypology": "terracedHouse"}}, "Tipología"),
    ({**BASE, "size": 368}, "367"), ({**BASE, "size": 0}, "superficie positiva"), ({**BASE, "bathrooms": None}, "superficie positiva"),
    ({**BASE, "operation": "unknown"}, FIELDS + "operation"), ({**BASE, "municipality": "Barcelona"}, "Madrid capital"),
    ({**BASE, "price": 0}, FIELDS + "price"), ({**BASE, "propertyCode": " \t "}, FIELDS + "propertyCode"), ({**BASE, "propertyCode": "x" * 81}, FIELDS + "propertyCode"),
    ({**BASE, "propertyCode": " "}, FIELDS + "propertyCode"), ({**BASE, "floor": "1" * 21}, FIELDS + "floor"), ({**BASE, "description": "x" * 12001}, FIELDS + "description"),
    ({**BASE, "detailedType": {"typology": 7}, "price": "1"}, FIELDS + "detailedType, price"), ({**BASE, "parkingSpace": []}, FIELDS + "parkingSpace"),
    (without("operation"), FIELDS + "operation"), (without("propertyType"), FIELDS + "propertyType"), (without("municipality"), FIELDS + "municipality"),
    ("null", "objeto JSON"), ("false", "objeto JSON"), ("123", "objeto JSON"), ("[]", "objeto JSON"), ('"anuncio"', "objeto JSON"), ("{", "objeto JSON"), ("{}", FIELDS + "municipality, operation, propertyCode, propertyType"),
]


def test_first_failing_step(spark):
    got = {r["row_id"]: r["error"] for r in validate(raw(spark, [c[0] for c in CASES])).collect()}
    for i, (value, detail) in enumerate(CASES):
        if detail is None:
            assert got[i] is None, (value, got[i])
        elif detail.startswith(FIELDS):
            assert got[i]["detalle"] == detail
        else:
            assert detail in got[i]["detalle"], (value, got[i])


def test_repeated_keys_keep_the_last(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    row = from_raw(raw(spark, ['{"propertyCode":"a","propertyCode":"b"}'])).first()
    assert row["propertyCode"] == "b"


def test_hot_code_is_counted_without_one_task_holding_it(spark):
    rows = spark.range(6000).select(F.lit("b").alias("batch_id"), F.col("id").alias("row_id"),
                                    F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("c"), "id")).alias("codigo"))
    expected = {("hot", 2000): 2000, (None, 1): 2000}
    for bound in (500_000, 0):
        got = mark_duplicates(rows, max_rows=bound).groupBy("codigo", "copias").count()
        counts = {(r["codigo"], r["copias"]): r["count"] for r in got.filter("codigo IS NULL OR codigo = 'hot' OR copias > 1").collect()}
        assert counts == expected


def outcome(spark, refs, values):
    out = value_batch(raw(spark, values), refs)
    return results(out, refs.meta).orderBy("row_id").collect(), errors(out).orderBy("indice").collect()


@pytest.fixture(scope="module")
def batch(spark, refs):
    values = [BASE, {**BASE, "propertyCode": "rent", "operation": "rent", "price": 1500}, {**BASE, "propertyCode": "high", "price": 900000},
              {**BASE, "propertyCode": "no-price", "price": None}, {**BASE, "propertyCode": "new", "newDevelopment": True},
              {**BASE, "propertyCode": "bare", "description": None, "parkingSpace": None, "floor": None, "hasLift": None},
              {**BASE, "propertyCode": "missing", "latitude": None}, {**BASE, "propertyCode": "chalet", "propertyType": "chalet"},
              {**BASE, "propertyCode": "far", "latitude": 41.3851, "longitude": 2.1734}, {**BASE, "propertyCode": "both", "description": "Piso a reformar y ocupado."},
              {**BASE, "propertyCode": "twice"}, {**BASE, "propertyCode": "twice"}, {**BASE, "propertyCode": "twice", "size": 368}, "null"]
    return values, *outcome(spark, refs, values)


def test_batch_outcome(batch):
    values, rows, bad = batch
    assert [r["propertyCode"] for r in rows] == ["s-1", "rent", "high", "no-price", "new", "bare"]
    assert [(e["indice"], e["estado"]) for e in bad] == [
        (6, "datos_insuficientes"), (7, "fuera_ambito"), (8, "fuera_ambito"), (9, "fuera_ambito"), (10, "datos_insuficientes"),
        (11, "datos_insuficientes"), (12, "fuera_ambito"), (13, "datos_insuficientes")]
    assert bad[3]["detalle"] == "a_reformar;ocupada" and bad[4]["detalle"].startswith("propertyCode duplicado")
    sale, rent, high, unpriced, new, bare = rows
    assert len({r["precio_estimado"] for r in (sale, rent, high, unpriced, new)}) == 1
    assert sale["unidad_comparacion"] == "EUR" and rent["unidad_comparacion"] == "EUR/mes"
    assert rent["precio_comparacion"] == rent["renta_mensual_estimada"]
    assert abs(rent["brecha_pct"] - (1500 / rent["renta_mensual_estimada"] - 1) * 100) < 1e-9 and unpriced["brecha_pct"] is None
    assert new["calidad"]["obra_nueva"] and any("promoción" in w for w in new["advertencias"])
    assert bare["calidad"]["sin_descripcion"] and bare["calidad"]["planta_imputada"] and bare["calidad"]["ascensor_desde_descripcion"]
    assert bare["advertencias"][-1].startswith("Garaje no informado") and rent["intervalo"] is None and not rent["alquiler_validado"]


def test_order_and_partitions_do_not_matter(spark, refs, batch):
    values, rows, _ = batch
    again = results(value_batch(raw(spark, values).repartition(5, "row_id"), refs), refs.meta).orderBy("row_id").collect()
    assert again == rows


def test_native_layer_agrees_and_written_outcome_splits(spark, refs, batch, tmp_path):
    values, rows, bad = batch
    native = {r["row_id"]: r for r in value_native(from_raw(raw(spark, values)), refs, include_features=True).collect()}
    for r in rows:
        assert native[r["row_id"]]["valido"] and native[r["row_id"]]["precio_estimado"] == r["precio_estimado"]
    assert native[9]["motivo_no_valido"] == "a_reformar;ocupada" and native[9]["x_HASTERRACE"] == 0
    out = value_batch(raw(spark, values), refs)
    write_outcome(out, str(tmp_path / "o"))
    back = read_outcome(out, str(tmp_path / "o"))
    assert results(back, refs.meta).count() == len(rows) and errors(back).count() == len(bad)


def test_stream_equals_batch(spark, refs, batch, tmp_path):
    values, rows, bad = batch
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(v if isinstance(v, str) else json.dumps(v) for v in values))
    value_stream(spark, str(tmp_path / "in"), refs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got, wrong = read_stream_output(spark, str(tmp_path / "out"), refs)
    assert {r["propertyCode"]: r["precio_estimado"] for r in got.collect()} == {r["propertyCode"]: r["precio_estimado"] for r in rows}
    assert sorted(e["detalle"] for e in wrong.collect()) == sorted(e["detalle"] for e in bad)


def test_raw_listings_are_made_by_compiled_methods(spark, tmp_path):
    """The virtual machine leaves methods beyond 8,000 bytes uncompiled; rows of every fault come out as their patterns say."""
    import re
    from pyspark.sql import functions as F
    from pisoval.sources import driver_tables as d
    spark.range(80).select(F.col("id").alias("o_orderkey"), F.lit(100.0).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, "texto")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows no methods before it has run
    try:
        raw = d.raw_listings(spark, str(tmp_path))
        text = raw._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000
    rows = {r["row_id"]: r["value"] for r in d.raw_texts(spark, str(tmp_path)).collect()}
    assert len(rows) == 80 and [rows[n] for n, _ in d.RAW_OTHERS] == [other for _, other in d.RAW_OTHERS]
    assert '"rooms":"3"' in rows[5] and "texto" in rows[5] and rows[12].startswith("{{") and '"propertyCode":" \\t "' in rows[11] and '"price":0,' in rows[16]
    assert rows[25].startswith('{"propertyCode":"L25"') and rows[72] == "123"
