"""Model features and row context from typed listings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import OCCUPIED_CANCELLED, OCCUPIED_PARTS, TEXT_AMENITIES, WORKS_CANCELLED, WORKS_NEEDED, WORKS_WORDS
from ..functions.amenities import DEFAULT_RULES, RuleBook, is_blank, is_mentioned
from ..functions.numeric import nan_to_null, parse_floor
from ..functions.text import mentions, mentions_part, normalize_text
from ..operators.areas import assign_area
from ..operators.lookup import look_up
from ..operators.poi import nearest_poi
from ..sources.listings import canonical
from ..sources.reference import References

TEXT, WORKS_MARK, OCCUPIED_MARK = "__t", "__works", "__occupied"
NUMBERS = {"CONSTRUCTEDAREA": "size", "ROOMNUMBER": "rooms", "BATHNUMBER": "bathrooms"}


def prepare(df: DataFrame) -> DataFrame:
    """Typed listings with NaN as NULL and the description normalised once."""
    typed = canonical(df)
    numbers = {c: nan_to_null(F.col(c)) for c, t in typed.dtypes if t == "double"}
    return typed.withColumns({**numbers, TEXT: normalize_text(F.col("description"))})


def is_kind(word: str) -> Column:
    """Subtype or type equals the word."""
    return ((F.coalesce("detailedType_subTypology", F.lit("")) == word)
            | (F.coalesce("propertyType", F.lit("")) == word))


def own_features(median_floor: float, rules: RuleBook = DEFAULT_RULES) -> dict[str, Column]:
    """Features and marks that need only the listing itself."""
    t, floor = F.col(TEXT), parse_floor(F.col("floor"))
    return {
        **{x: F.col(c) for x, c in NUMBERS.items()},
        **{a: is_mentioned(t, rules[a]).cast("int") for a in TEXT_AMENITIES},
        "HASLIFT": F.coalesce("hasLift", is_mentioned(t, rules["HASLIFT"])).cast("int"),
        "HASPARKINGSPACE": F.coalesce("parkingSpace_hasParkingSpace", F.lit(False)).cast("int"),
        "ISDUPLEX": is_kind("duplex").cast("int"),
        "ISSTUDIO": is_kind("studio").cast("int"),
        "FLOORCLEAN": F.coalesce(floor, F.lit(float(median_floor))),
        "planta_imputada": floor.isNull(),
        "ascensor_desde_descripcion": F.col("hasLift").isNull(),
        "sin_descripcion": is_blank(t),
        "obra_nueva": F.coalesce("newDevelopment", F.lit(False)),
    }


def needs_work(t: Column) -> Column:
    return mentions(t, WORKS_NEEDED, WORKS_CANCELLED, WORKS_WORDS)


def occupied(t: Column) -> Column:
    return mentions_part(t, OCCUPIED_PARTS, OCCUPIED_CANCELLED)


def check_columns(df: DataFrame, columns: list[str]) -> None:
    """Every model column must have been built."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"model columns not built: {missing}")


def build_features(df: DataFrame, refs: References, rules: RuleBook = DEFAULT_RULES) -> DataFrame:
    """All model columns and context marks added to the listings, with what their texts say of works and occupation; no later step reads the texts."""
    out = prepare(df)
    # HASLIFT and hasLift differ only in case, so the raw field steps aside first.
    built = own_features(refs.meta.mediana_planta_train, rules)
    keep = [F.col(c) for c in out.columns if c != "hasLift"]
    marks = {WORKS_MARK: needs_work(F.col(TEXT)), OCCUPIED_MARK: occupied(F.col(TEXT))}
    out = out.select(*keep, *[c.alias(n) for n, c in (built | marks).items()]).drop(TEXT)
    out = look_up(assign_area(nearest_poi(out, refs.points), refs.areas), refs.area_table)
    out = out.withColumn("sin_barrio", F.col("barrio_code").isNull())
    check_columns(out, refs.meta.columnas)
    return out


def model_matrix(df: DataFrame, refs: References, prefix: str = "") -> DataFrame:
    """Just the model columns, in model order."""
    return df.select(*[F.col(c).alias(prefix + c) for c in refs.meta.columnas])
