"""Documents cut at the elements of their arrays hold the same rows as documents read whole."""
import json
import random

import pytest
from pyspark.sql import functions as F

from pisoval.sources.documents import read_documents
from pisoval.sources.listings import read_raw

ODD = ['a"b', "x\\", "}{][,", '\\"}', "ñ€😀", "", " } \n", '"},{"']


def value(r: random.Random, depth: int = 0):
    kind = r.randrange(7 if depth < 3 else 5)
    if kind < 5:
        return [r.choice(ODD), r.randrange(100), None, True, 1.5][kind]
    if kind == 5:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(ODD) + str(i): value(r, depth + 1) for i in range(r.randrange(4))}


def listing(r: random.Random) -> dict:
    return {"propertyCode": r.choice(ODD), "description": r.choice(ODD) * r.randrange(4), "detailedType": {"typology": value(r)}, "more": value(r)}


def texts() -> dict[str, str]:
    r = random.Random(5)
    made = {}
    for i in range(12):
        held = [listing(r) if r.random() < 0.8 else value(r) for _ in range(r.randrange(1, 30))]
        shape = [held, {"anuncios": held}, {"total": 5, "other": {"x": [1, {"y": 2}]}, "elementList": held, "end": [1, 2]},
                 {"elementList": [1], "anuncios": held}, {"anuncios": {"no": 1}, "elementList": held}, listing(r)][i % 6]
        made[f"r{i}"] = json.dumps(shape, ensure_ascii=i % 2 == 0, indent=i % 3 or None)
    fixed = ["[]", "{}", " [ ] ", '{"anuncios":[]}', '{"anuncios":[],"elementList":[{"a":1}]}', '{"anuncios":{"a":1}}', '{"anuncios":5}', "5", '"a}b"', "null",
             '[{"a":1}', '[{"a":1},]', '[{"a":1},,{"b":2}]', '{"anuncios":[{"a":1}', '[{"a":]}', '[{"a":1}]\n', '\n\n{"a":{"b":[1,2,{"c":"}"}]},"d":1}\n',
             '[[1,2],[{"a":[3]}],null,"x, y"]', '{"anuncios":[1 2]}', '[[],{}]', '{"elementList":[{}]}', "nonsense", '{"x":[],"anuncios":[{"a":1},{"a":2}]}']
    return made | {f"f{i}": t for i, t in enumerate(fixed)}


def rows(df):
    return sorted((r["batch_id"].rsplit("/", 1)[1], r["row_id"], r["js"] or "") for r in df.select("batch_id", "row_id", F.to_json("raw").alias("js")).collect())


@pytest.mark.parametrize("split", ["97", "128m"])
def test_cut_documents_equal_whole_ones(spark, tmp_path, split):
    for name, text in texts().items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    whole = rows(read_raw(spark, str(tmp_path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        cut = rows(read_documents(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in sorted({r[0] for r in whole + cut}):
        assert [r for r in cut if r[0] == name] == [r for r in whole if r[0] == name], name


def test_no_document(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    assert read_documents(spark, str(tmp_path)).count() == 0


def test_a_byte_order_mark_is_skipped(spark, tmp_path):
    (tmp_path / "bom").write_bytes(b'\xef\xbb\xbf[{"a":1},{"a":2}]')
    assert [r[2] for r in rows(read_documents(spark, str(tmp_path)))] == ['{"a":1}', '{"a":2}']
