"""A synthetic listing set that touches every polygon and the edge cases."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geo import unproject_utm
from .lookup import lookup
from .positions import with_positions

BASE_LISTING = dict(propertyCode="muestra", operation="sale", municipality="Madrid", propertyType="flat",
                    size=64.0, rooms=3, bathrooms=1, latitude=40.42, longitude=-3.69, floor="4", hasLift=True,
                    newDevelopment=None, price=310000.0, description="Luminoso, con balcones a la calle y cocina nueva.",
                    hasParkingSpace=False)
# One group of cases for each rule: works, occupation, text marks, missing facts, size limits, kinds, place.
EDGE_CASES = [
    *[{"description": t} for t in (
        "Oportunidad: para reformar a su gusto.", "El baño necesita reforma.", "Se entrega reformado, sin necesidad de reformas.",
        "Inmueble ocupado, no se puede visitar.", "Se vende alquilado con inquilino.", "Se entrega libre de ocupantes.",
        "Se vende la nuda propiedad.", "Para reformar; hoy ocupado.", "Gran terraza de uso privativo.", "", None)],
    {"floor": "bj"}, {"floor": None, "hasLift": None}, {"hasLift": False}, {"newDevelopment": True}, {"newDevelopment": False},
    *[{"size": v} for v in (0.0, 1.0, 367.0, 367.5, 900.0)],
    {"rooms": 0, "propertyType": "studio"}, {"propertyType": "penthouse"}, {"propertyType": "countryHouse"},
    {"latitude": 43.26, "longitude": -2.93}, {"operation": "rent", "price": 1150.0},
]
_SCHEMA = ("propertyCode string, operation string, municipality string, propertyType string, size double, rooms int, "
           "bathrooms int, latitude double, longitude double, floor string, hasLift boolean, newDevelopment boolean, "
           "price double, description string, hasParkingSpace boolean")


def interior_points(edges: DataFrame) -> DataFrame:
    """(area_code, x, y): the middle of the widest inner stretch of a line halfway up each area."""
    middle = edges.groupBy("area_code").agg(
        ((F.min(F.least("y1", "y2")) + F.max(F.greatest("y1", "y2"))) / 2).alias("half"))
    around = lookup(edges, middle, ["area_code"]).groupBy("area_code").agg(
        ((F.max(F.when(F.col("y1") <= F.col("half"), F.col("y1")))
          + F.min(F.when(F.col("y1") > F.col("half"), F.col("y1")))) / 2).alias("y"))
    spans = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + F.try_divide((F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    crossings = lookup(edges, around, ["area_code"]).filter(spans).select("area_code", "y", at.alias("x"))
    order = W.partitionBy("area_code").orderBy("x")
    stretches = (crossings.withColumns({"n": F.row_number().over(order), "to": F.lead("x").over(order)})
                 .filter("n % 2 = 1 AND to IS NOT NULL"))
    return (stretches.groupBy("area_code")
            .agg(F.max_by(F.struct(((F.col("x") + F.col("to")) / 2).alias("x"), "y"),
                          F.struct((F.col("to") - F.col("x")).alias("w"), (-F.col("x")).alias("x"))).alias("p"))
            .select("area_code", "p.x", "p.y"))


def coverage_set(edges: DataFrame) -> DataFrame:
    """One listing inside every polygon, then the edge cases, in the contract's field layout."""
    lat, lon = unproject_utm(F.col("x"), F.col("y"))
    base = {k: F.lit(v) for k, v in BASE_LISTING.items()}
    per_area = with_positions(interior_points(edges), ["area_code"], "i").select(
        F.col("i").cast("long").alias("row_id"),
        *[c.alias(k) for k, c in {**base, "propertyCode": F.concat(F.lit("barrio-"), F.col("i").cast("string")),
                                  "newDevelopment": F.lit(None).cast("boolean"),
                                  "size": (40 + F.col("i") % 21 * 5).cast("double"),
                                  "latitude": lat, "longitude": lon}.items()])
    spark = edges.sparkSession
    rows = [tuple({**BASE_LISTING, **change, "propertyCode": f"edge-{n}"}[k] for k in BASE_LISTING)
            for n, change in enumerate(EDGE_CASES)]
    cols = {f.split()[0]: f for f in _SCHEMA.split(", ")}
    edge_rows = spark.createDataFrame(rows, ", ".join(cols[k] for k in BASE_LISTING)).withColumn(
        "row_id", F.lit(1_000_000_000) + F.substring("propertyCode", 6, 4).cast("long"))
    both = per_area.unionByName(edge_rows)
    return both.select(
        F.lit("cobertura").alias("batch_id"), "row_id", "propertyCode", "operation", "municipality", "propertyType",
        "price", "size", "rooms", "bathrooms", "latitude", "longitude", "floor", "hasLift", "newDevelopment",
        "description", F.struct(F.lit(None).cast("string").alias("typology"),
                                F.lit(None).cast("string").alias("subTypology")).alias("detailedType"),
        F.struct("hasParkingSpace").alias("parkingSpace"))
