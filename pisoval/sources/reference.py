"""Reference tables, metadata and the bundle every valuation needs."""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed_values import AREA_FEATURES, MODEL_FEATURES, RESCUE_METRES
from ..functions.numeric import nan_to_null
from ..operators.areas import AreaIndex, index_areas
from ..operators.lookup import LookupTable, measure
from ..operators.poi import PoiIndex, index_pois
from ..operators.trees import Scorer, TreeModel, check_model, load_model, prepare_scorer
from .polygons import polygon_edges

PACKAGE_VERSION = 3
YEARS = ["ano_base", "ano_precio", "ano_renta"]


@dataclass
class Metadata:
    """Constants of one trained package; they enter plans as literals."""
    columnas: list[str] = field(default_factory=lambda: list(MODEL_FEATURES))
    mediana_planta_train: float = 2.0
    area_max_dominio: float = 367.0
    smearing: float = 1.0
    rangos_train: dict[str, tuple[float, float]] = field(default_factory=dict)
    ano_base: int = 2018
    ano_precio: int = 2026
    ano_renta: int = 2026
    nombre: str = "modelo"
    model_id: str = "modelo"
    model_version: str = "1"
    modelo_sha256: str = ""
    paquete_sha256: str = ""
    arboles: int | None = None
    temporalidad: dict[str, object] = field(default_factory=lambda: {
        "ultimo_ano_venta": 2025, "ultimo_ano_alquiler": 2024, "ano_inicio_tendencia": 2018, "ajuste_proyectado": True})


@dataclass
class References:
    """Tables of a package.  Indexes over them are built on first use and kept."""
    edges: DataFrame
    pois: DataFrame
    area_features: DataFrame
    district_index: DataFrame
    model: TreeModel
    meta: Metadata
    max_m: float = RESCUE_METRES

    @cached_property
    def areas(self) -> AreaIndex:
        return index_areas(self.edges, self.max_m)

    @cached_property
    def area_table(self) -> LookupTable:
        columns = [nan_to_null(F.col(c)).alias(c) for c in AREA_FEATURES]
        return measure(self.area_features.select("barrio_code", *columns).persist(), ["barrio_code"])

    @cached_property
    def index_table(self) -> LookupTable:
        columns = ["distrito_code", "indice_venta", "factor_renta_mensual"]
        return measure(self.district_index.select(columns).persist(), ["distrito_code"])

    @cached_property
    def scorer(self) -> Scorer:
        return prepare_scorer(self.model)

    @cached_property
    def points(self) -> PoiIndex:
        return index_pois(self.pois)


def read_metadata(spark: SparkSession, path: str) -> Metadata:
    """One JSON document; another package version is refused."""
    row = spark.read.json(path, multiLine=True).first().asDict(recursive=True)
    if row.get("version_paquete") != PACKAGE_VERSION:
        raise ValueError(f"package version {row.get('version_paquete')}, expected {PACKAGE_VERSION}")
    ranges = {k: (float(v["min"]), float(v["max"])) for k, v in (row.get("rangos_train") or {}).items() if v}
    known = {k: v for k, v in row.items() if k in Metadata.__dataclass_fields__ and k != "rangos_train" and v is not None}
    return Metadata(**known, rangos_train=ranges)


def read_references(spark: SparkSession, folder: str) -> References:
    """A package folder: metadata and model as JSON, tables as Parquet, areas as polygons in metres; checked before use."""
    meta = read_metadata(spark, f"{folder}/metadatos.json")
    model = load_model(spark, f"{folder}/modelo.json")
    check_model(model, meta.arboles, meta.columnas)
    index = spark.read.parquet(f"{folder}/indices_distrito.parquet")
    check_years(index, meta)
    return References(polygon_edges(spark.read.parquet(f"{folder}/barrios.parquet")), spark.read.parquet(f"{folder}/pois.parquet"),
                      spark.read.parquet(f"{folder}/variables_barrio.parquet"), index, model, meta)


def check_years(index: DataFrame, meta: Metadata) -> None:
    """Index tables that state their years must agree with the metadata."""
    stated = {"ano_base": meta.ano_base, "ano_destino": meta.ano_precio, "ano_renta": meta.ano_renta,
              **{k: v for k, v in meta.temporalidad.items() if k.startswith(("ultimo_ano", "ano_inicio"))}}
    shared = {k: v for k, v in stated.items() if k in index.columns}
    if not shared:
        return
    wrong = index.agg(*[F.count_if(~F.col(k).eqNullSafe(F.lit(v))).alias(k) for k, v in shared.items()]).first()
    bad = sorted(k for k in shared if wrong[k])
    if bad:
        raise ValueError("index years differ from the metadata: " + ", ".join(bad))
