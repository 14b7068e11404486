"""Reasons for not valuing a listing and out-of-range marks."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import HOUSE_SUBTYPES, HOUSE_TYPES, OPERATIONS, REASONS
from ..functions.geo import usable_coordinates
from ..functions.numeric import is_finite
from .features import OCCUPIED_MARK, TEXT, WORKS_MARK, needs_work, occupied


def is_house() -> Column:
    return (F.coalesce(F.col("propertyType").isin(HOUSE_TYPES), F.lit(False))
            | F.coalesce(F.col("detailedType_subTypology").isin(HOUSE_SUBTYPES), F.lit(False)))


def domain_conditions(area_max: float, built: bool = False) -> dict[str, Column]:
    """Conditions that put a complete listing out of the model's domain.  built: over built features, which know what the text says."""
    works, taken = (F.col(WORKS_MARK), F.col(OCCUPIED_MARK)) if built else (needs_work(F.col(TEXT)), occupied(F.col(TEXT)))
    return {"tipologia_casa": is_house(),
            "superficie_fuera_de_dominio": F.coalesce(F.col("CONSTRUCTEDAREA") > area_max, F.lit(False)),
            "a_reformar": works, "ocupada": taken}


def native_conditions(area_max: float) -> dict[str, Column]:
    """Every condition for abstaining, in reporting order."""
    usable = usable_coordinates(F.col("latitude"), F.col("longitude"))

    def unusable(c: str) -> Column:
        return ~is_finite(F.col(c)) | (F.col(c) < 0)

    found = {"operacion_no_admitida": ~F.coalesce(F.col("operation").isin(OPERATIONS), F.lit(False)),
             "sin_coordenadas": ~usable,
             "fuera_de_madrid": F.col("barrio_code").isNull() & usable,
             "sin_superficie": unusable("CONSTRUCTEDAREA") | (F.col("CONSTRUCTEDAREA") <= 0),
             "sin_habitaciones": unusable("ROOMNUMBER"), "sin_banos": unusable("BATHNUMBER"),
             **domain_conditions(area_max, built=True)}
    return {r: F.coalesce(found[r], F.lit(False)) for r in REASONS}


def names_where(conditions: dict[str, Column]) -> Column:
    """ARRAY<STRING> of the names whose condition holds, in order."""
    # The engine interprets what it compacts, so conditions that cost much come as columns.
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def out_of_range(columns: list[str], ranges: dict[str, tuple[float, float]]) -> Column:
    """Names of features outside their training range joined with ';', NULL if none."""
    outside = {c: (F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1]) for c in columns if c in ranges}
    if not outside:
        return F.lit(None).cast("string")
    return F.nullif(F.concat_ws(";", names_where(outside)), F.lit(""))
