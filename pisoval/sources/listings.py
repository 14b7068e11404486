"""Listings from JSON, nested frames or flat frames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..fixed_values import EXPECTED_COLUMNS
from ..functions.numeric import coerce_numeric
from ..operators.lookup import lookup

# Listing fields and the kind each has once typed; dots mark nested fields.
FIELDS = {"propertyCode": "string", "operation": "string", "municipality": "string", "propertyType": "string",
          "price": "double", "size": "double", "rooms": "double", "bathrooms": "double",
          "latitude": "double", "longitude": "double", "floor": "string", "hasLift": "boolean",
          "newDevelopment": "boolean", "description": "string",
          "detailedType.typology": "string", "detailedType.subTypology": "string",
          "parkingSpace.hasParkingSpace": "boolean"}
ENVELOPE_KEYS = ["anuncios", "elementList"]


def column_name(field: str) -> str:
    """Inside the engine nested fields are joined with an underscore."""
    return field.replace(".", "_")


def parse_values(df: DataFrame, text: str = "value") -> DataFrame:
    """Parse JSON text to VARIANT `doc`; broken JSON is NULL.  Of repeated keys the last one counts."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return df.withColumn("doc", F.try_parse_json(text))


def is_wrapped() -> Column:
    """Whether the object `doc` has an envelope's key."""
    return F.coalesce(*[F.expr(f"try_variant_get(doc, '$.{k}', 'variant')") for k in ENVELOPE_KEYS]).isNotNull()


def unwrap_envelopes(df: DataFrame) -> DataFrame:
    """One row per listing from VARIANT `doc`: `pos` within its document and `raw`."""
    as_array = "array<variant>"
    kind = F.schema_of_variant("doc")
    held = [F.expr(f"try_variant_get(doc, '$.{k}', '{as_array}')") for k in ENVELOPE_KEYS]
    # A key that holds no array, and no other that does: one row that no check takes for a listing.
    broken = F.when(is_wrapped(), F.array(F.lit(None).cast("variant")))
    listed = (F.when(kind.startswith("ARRAY"), F.expr(f"try_variant_get(doc, '$', '{as_array}')"))
              .when(kind.startswith("OBJECT"), F.coalesce(*held, broken, F.array("doc"))).otherwise(F.array("doc")))
    others = [c for c in df.columns if c != "doc"]
    # The outer form spares a size filter that would parse every document twice.
    return df.select(*others, F.posexplode_outer(listed).alias("pos", "raw")).filter("pos IS NOT NULL")


def read_raw(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(batch_id, row_id, raw VARIANT) from JSON files.

    Whole documents: each file is one batch.  JSON Lines, the layout for size:
    bare listings of a file form one batch; a line holding an envelope or an
    array is a batch of its own.
    """
    if not lines:
        docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("batch_id"))
        return unwrap_envelopes(parse_values(docs).drop("value")).select(
            "batch_id", F.col("pos").cast("long").alias("row_id"), "raw")
    return raw_lines(lines_of(spark.read.text(path)))


def lines_of(texts: DataFrame) -> DataFrame:
    """Text rows of a file source with where each comes from: value, file, split."""
    return texts.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def numbered(lines: DataFrame) -> DataFrame:
    """Adds `line`, each row's place in its file from 0, whatever splits the file is read in.

    A split's rows have running numbers, so its first number and the rows of the splits before it give the place; the
    table of splits is small beside the input.
    """
    marked = lines.withColumn("__id", F.monotonically_increasing_id())
    splits = marked.groupBy("file", "split").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "split", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return lookup(marked, splits, ["file", "split"]).withColumn("line", F.col("__id") + F.col("__shift")).drop("__id", "__shift")


def raw_lines(lines: DataFrame) -> DataFrame:
    """(batch_id, row_id, raw VARIANT) from JSON Lines given by `lines_of`; read in one go or in many, the same rows."""
    parsed = parse_values(numbered(lines).filter(F.trim("value") != "")).drop("value")
    kind = F.schema_of_variant("doc")
    marked = parsed.withColumn("wrapped", F.coalesce(kind.startswith("ARRAY") | is_wrapped(), F.lit(False))).drop("split")
    return unwrap_envelopes(marked).select(
        F.when(F.col("wrapped"), F.concat_ws("#", "file", "line")).otherwise(F.col("file")).alias("batch_id"),
        F.when(F.col("wrapped"), F.col("pos").cast("long")).otherwise(F.col("line")).alias("row_id"), "raw")


NESTED = ["detailedType", "parkingSpace"]


def value_of(path: str, kind: str) -> Column:
    """An opened field as `kind`, NULL where it does not convert."""
    return F.expr(f"try_variant_get(`__v_{path}`, '$', '{kind}')")


def kind_of(path: str) -> Column:
    """BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, OBJECT<..>, ARRAY<..>; VOID for null and absent alike."""
    return F.col(f"`__k_{path}`")


def open_fields(df: DataFrame) -> DataFrame:
    """Look every listing field up once: its VARIANT and its kind, for `value_of` and `kind_of`."""
    found = {f"__v_{p}": F.expr(f"try_variant_get(raw, '$.{p}', 'variant')") for p in [*FIELDS, *NESTED]}
    kinds = {f"__k_{p}": F.coalesce(F.schema_of_variant(f"`__v_{p}`"), F.lit("VOID")) for p in [*FIELDS, *NESTED]}
    return df.withColumns(found).withColumns(kinds)


def close_fields(df: DataFrame) -> DataFrame:
    return df.drop(*[f"__{x}_{p}" for x in "vk" for p in [*FIELDS, *NESTED]])


def _typed(field: str, kind: str) -> Column:
    found, text = kind_of(field), value_of(field, "string")
    if kind == "string":
        return F.when(found == "STRING", text)
    is_number = found.isin("BIGINT", "DOUBLE") | found.startswith("DECIMAL")
    if kind == "double":
        number = value_of(field, "double")
        return (F.when(found == "STRING", coerce_numeric(text, T.StringType()))
                .when(is_number | (found == "BOOLEAN"), F.when(~F.isnan(number), number)))
    # Truthiness, as loosely typed listings are read.
    return (F.when(found == "BOOLEAN", value_of(field, "boolean")).when(found == "STRING", F.length(text) > 0)
            .when(is_number, value_of(field, "double") != 0))


def typed_fields() -> dict[str, Column]:
    """Typed listing columns from opened fields, leniently."""
    return {column_name(f): _typed(f, k) for f, k in FIELDS.items()}


def from_raw(df: DataFrame) -> DataFrame:
    """Typed listing columns from VARIANT `raw`; other columns stay.  A code given as a number keeps its digits."""
    found = kind_of("propertyCode")
    number = found.isin("BIGINT", "DOUBLE") | found.startswith("DECIMAL")
    code = F.when(number, value_of("propertyCode", "string")).otherwise(_typed("propertyCode", "string"))
    return close_fields(open_fields(df).withColumns({**typed_fields(), "propertyCode": code})).drop("raw")


def read_listings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Typed listings from JSON files, envelopes unwrapped."""
    return from_raw(read_raw(spark, path, lines))


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects to dotted columns, at any depth; flat columns are untouched."""
    def leaves(schema: T.StructType, path: list[str]) -> list[tuple[Column, str]]:
        out = []
        for f in schema.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            else:
                out.append((F.col(".".join(f"`{p}`" for p in here)), ".".join(here)))
        return out
    return df.select(*[c.alias(name) for c, name in leaves(df.schema, [])])


def with_expected_columns(df: DataFrame) -> DataFrame:
    """Add, as NULL, any of the ten guaranteed columns that a dotted frame lacks."""
    missing = {c: F.lit(None).cast(FIELDS[c]) for c in EXPECTED_COLUMNS if c not in df.columns}
    return df.withColumns(missing) if missing else df


def canonical(df: DataFrame) -> DataFrame:
    """Typed listing columns from a nested, dotted or already canonical frame."""
    if all(column_name(f) in df.columns for f in FIELDS) and all(
            df.schema[column_name(f)].dataType.simpleString() == k for f, k in FIELDS.items()):
        return df
    flat = with_expected_columns(flatten(df))
    types = {f.name: f.dataType for f in flat.schema.fields}
    out, used = [], set()
    for field, kind in FIELDS.items():
        name = field if field in types else column_name(field)
        used.add(name)
        if name not in types:
            out.append(F.lit(None).cast(kind).alias(column_name(field)))
        elif kind == "double":
            out.append(coerce_numeric(F.col(f"`{name}`"), types[name]).alias(column_name(field)))
        elif kind == "boolean" and isinstance(types[name], T.StringType):
            out.append((F.length(F.col(f"`{name}`")) > 0).alias(column_name(field)))
        elif kind == "string" and not isinstance(types[name], T.StringType):
            out.append((F.col(f"`{name}`").cast("string") if field == "propertyCode" else F.lit(None).cast("string"))
                       .alias(column_name(field)))
        else:
            out.append(F.col(f"`{name}`").cast(kind).alias(column_name(field)))
    rest = [F.col(f"`{c}`") for c in types if c not in used]
    return flat.select(*rest, *out)
