"""Writing results, errors and reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .listings import column_name


def json_rows(df: DataFrame, output: str = "fila") -> DataFrame:
    """Each row as a JSON object that keeps its nulls."""
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
             for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias(output))


#: Quotes doubled, as spreadsheets and data frames write them; spaces at the ends of a value are its own.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_native(df: DataFrame, path: str, row_order: str | None = None) -> None:
    """Parquet when the path says so, else CSV with a header; optionally in input order. CSV is read back with `CSV` and `multiLine`; an
    empty text then comes back as NULL."""
    ordered = df.orderBy(row_order).drop(row_order) if row_order else df
    if path.rstrip("/").endswith(".parquet"):
        ordered.write.mode("overwrite").parquet(path)
    else:
        ordered.write.mode("overwrite").options(**CSV).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def dotted(df: DataFrame, fields: list[str]) -> DataFrame:
    """Engine names back to dotted names at the edge."""
    return df.withColumnsRenamed({column_name(f): f for f in fields if column_name(f) in df.columns})
