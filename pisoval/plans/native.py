"""The native valuation table: every listing, valued or with its reasons."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import NATIVE_COLUMNS
from ..functions.amenities import DEFAULT_RULES, RuleBook
from ..operators.lookup import ROW_KEY
from ..sources.reference import References
from .domain import names_where, native_conditions, out_of_range
from .features import OCCUPIED_MARK, WORKS_MARK, build_features
from .pricing import announced_ratio, apply_index, base_price

ESTIMATES = ["precio_estimado_base", "indice_venta", "precio_estimado", "factor_renta_mensual",
             "renta_mensual_estimada", "anunciado_sobre_estimado"]


def with_reasons(df: DataFrame, refs: References) -> DataFrame:
    """Add `motivos` and `valido` to built features."""
    return (df.withColumn("motivos", names_where(native_conditions(refs.meta.area_max_dominio)))
            .withColumn("valido", F.size("motivos") == 0))


def value_features(df: DataFrame, refs: References) -> DataFrame:
    """Reasons, score and prices over built features; all intermediate columns stay."""
    meta = refs.meta
    out = with_reasons(df, refs).withColumn("fuera_de_rango", out_of_range(meta.columnas, meta.rangos_train)).drop(WORKS_MARK, OCCUPIED_MARK)
    out = refs.scorer(out, "score", F.col("valido"))
    out = out.withColumns({"precio_estimado_base": base_price(F.col("score"), meta.smearing),
                           "precio_anunciado": F.col("price")})
    out = apply_index(out, refs.index_table)
    out = out.withColumns({"anunciado_sobre_estimado": announced_ratio(),
                           "motivo_no_valido": F.when(~F.col("valido"), F.concat_ws(";", "motivos"))})
    masked = {c: F.when(F.col("valido"), F.col(c)) for c in ESTIMATES}
    stamps = {"ano_base": meta.ano_base, "ano_precio": meta.ano_precio, "ano_renta": meta.ano_renta,
              "modelo": meta.nombre}
    return out.withColumns({**masked, **{k: F.lit(v) for k, v in stamps.items()}})


def value_native(df: DataFrame, refs: References, include_features: bool = False,
                 rules: RuleBook = DEFAULT_RULES) -> DataFrame:
    """The 23 result columns, plus `x_*` features on request; a row key of the input is kept in front."""
    keys = [c for c in ROW_KEY if c in df.columns]
    valued = value_features(build_features(df, refs, rules), refs)
    extra = [F.col(c).alias(f"x_{c}") for c in refs.meta.columnas] if include_features else []
    return valued.select(*keys, *NATIVE_COLUMNS, *extra)
