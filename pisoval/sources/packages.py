"""Packages on disk: tables, model and metadata in one folder, named and hashed by a manifest that is checked at load."""
from __future__ import annotations

import hashlib
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.manifest import file_hashes, require_intact
from ..operators.trees import TreeModel
from .polygons import polygon_shapes
from .reference import PACKAGE_VERSION, Metadata, References, read_references

#: Facts of a manifest that must agree with the metadata, where it states them.
PERIODS = ["ano_base", "ano_precio", "ano_renta"]


def model_document(model: TreeModel) -> DataFrame:
    """The model as one JSON text, in the boosted-tree library's layout."""
    index = F.create_map(*[x for i, n in enumerate(model.features) for x in (F.lit(n), F.lit(i))])
    split = F.col("feature").isNotNull()
    node = F.struct("node", F.when(split, F.col("left")).otherwise(-1).alias("l"), F.when(split, F.col("right")).otherwise(-1).alias("r"),
                    F.coalesce(F.element_at(index, F.col("feature")), F.lit(0)).alias("i"),
                    F.when(split, F.col("threshold")).otherwise(F.col("leaf")).alias("v"), F.coalesce(F.col("default_left"), F.lit(False)).cast("int").alias("d"))
    trees = model.nodes.groupBy("tree").agg(F.sort_array(F.collect_list(node)).alias("n"))
    arrays = {"left_children": "l", "right_children": "r", "split_indices": "i", "split_conditions": "v", "default_left": "d"}
    tree = F.struct(*[F.col(f"n.{c}").alias(name) for name, c in arrays.items()])
    whole = trees.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", tree.alias("t")))), lambda x: x["t"]).alias("trees"))
    learner = F.struct(F.array(*[F.lit(n) for n in model.features]).alias("feature_names"),
                       F.struct(F.lit(f"[{model.base_score!r}]").alias("base_score")).alias("learner_model_param"),
                       F.struct(F.struct("trees").alias("model")).alias("gradient_booster"))
    return whole.select(F.to_json(F.struct(learner.alias("learner"))).alias("value"))


def write_package(refs: References, folder: str) -> None:
    """Tables, model and metadata of a package under the names that `read_references` looks for."""
    spark, meta = refs.pois.sparkSession, refs.meta
    order = ["poi_no"] if "poi_no" in refs.pois.columns else []
    pois = refs.pois.orderBy(*order).select("tipo", "Lon", "Lat") if order else refs.pois.select("tipo", "Lon", "Lat")
    tables = {"barrios": polygon_shapes(refs.edges), "pois": pois, "variables_barrio": refs.area_features, "indices_distrito": refs.district_index}
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    model_document(refs.model).coalesce(1).write.mode("overwrite").text(f"{folder}/modelo.json")
    facts = {"version_paquete": PACKAGE_VERSION, "columnas": meta.columnas, "smearing": meta.smearing, "mediana_planta_train": meta.mediana_planta_train,
             "area_max_dominio": meta.area_max_dominio, "arboles": meta.arboles, "nombre": meta.nombre, "ano_base": meta.ano_base, "ano_precio": meta.ano_precio,
             "ano_renta": meta.ano_renta, "rangos_train": {k: {"min": a, "max": b} for k, (a, b) in meta.rangos_train.items()}}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadatos.json")


def package_manifest(refs: References, folder: str) -> dict:
    """Manifest of a written package: hashes of its files, their fingerprint, and the facts a load holds against it."""
    hashes = {r["nombre"]: r["sha256"] for r in file_hashes(refs.pois.sparkSession, folder).collect()}
    meta = refs.meta
    return {"model_id": meta.model_id, "model_version": meta.model_version, "sha256": hashes, "paquete_sha256": fingerprint_of(hashes),
            "trees": meta.arboles, "periodos": {p: getattr(meta, p) for p in PERIODS}, "temporalidad": meta.temporalidad}


def fingerprint_of(hashes: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(hashes, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def load_package(spark: SparkSession, folder: str, manifest: dict) -> References:
    """References of a package that is what its manifest says; anything else is refused. Responses then carry the manifest's identity."""
    hashes = manifest["sha256"]
    if fingerprint_of(hashes) != manifest["paquete_sha256"]:
        raise ValueError("package identity differs from its manifest")
    require_intact(file_hashes(spark, folder), spark.createDataFrame(sorted(hashes.items()), "nombre string, sha256 string"))
    refs = read_references(spark, folder)
    meta = refs.meta
    if meta.arboles is not None and meta.arboles != manifest["trees"]:
        raise ValueError("number of trees differs from the manifest")
    wrong = sorted(p for p, year in manifest["periodos"].items() if hasattr(meta, p) and getattr(meta, p) != year)
    if wrong:
        raise ValueError("periods differ from the manifest: " + ", ".join(wrong))
    model = [h for name, h in hashes.items() if name.split("/")[0] == "modelo.json"]
    stamped: Metadata = replace(meta, model_id=manifest["model_id"], model_version=manifest["model_version"], temporalidad=dict(manifest["temporalidad"]),
                                modelo_sha256=model[0], paquete_sha256=manifest["paquete_sha256"])
    return replace(refs, meta=stamped)
