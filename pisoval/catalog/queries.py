"""Every registered query with its DuckDB counterpart."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..fixed_values import AMENITY_RULES, AREA_FEATURES, MODEL_FEATURES, NATIVE_COLUMNS
from ..functions.amenities import (DEFAULT_RULES, amenity_flags, amenity_matches, extract_amenities,
                                   rule_book)
from ..functions.geo import project_utm
from ..functions.numeric import coerce_numeric, parse_floor
from ..functions.text import normalize_text
from ..operators import coverage, manifest, profile
from ..operators.areas import assign_area, index_areas
from ..operators.duplicates import mark_duplicates
from ..operators.filters import only
from ..operators.lookup import look_up, measure
from ..operators.poi import index_pois, nearest_poi
from ..operators.reconcile import compare_results, reconcile
from ..operators.trees import TreeModel, score_trees, tree_check
from ..plans import batch, contract
from ..plans.domain import domain_conditions, needs_work, occupied, out_of_range
from ..plans.features import build_features, own_features, prepare
from ..plans.native import value_features, value_native, with_reasons
from ..session import checkpoint_dir
from ..sources import driver_tables as d
from ..sources.documents import read_documents
from ..sources.listings import (FIELDS, canonical, column_name, flatten, from_raw, numbered, parse_values,
                                unwrap_envelopes, with_expected_columns)
from ..sources.packages import load_package, package_manifest, write_package
from ..sources.polygons import polygon_edges, polygon_shapes
from ..sources.reference import References
from ..sources.sinks import CSV, json_rows, write_native, write_report
from ..streaming.valuation import read_stream_output, value_stream
from . import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn
    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in o.DOUBLES else F.col(c) for c in (columns or df.columns)])


@lru_cache(maxsize=4)
def references(spark: SparkSession, sf_dir: str) -> References:
    """A package is loaded and indexed once per session and folder."""
    return d.references(spark, sf_dir)


def _native(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return value_native(d.listings(spark, sf_dir), references(spark, sf_dir), **kw)


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark, sf_dir)
    return value_features(build_features(d.listings(spark, sf_dir), refs), refs)


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.value_batch(d.raw_listings(spark, sf_dir), references(spark, sf_dir))


# ---------------------------------------------------------------- sources and shapes
_JS = o.raw_sql().split(", raw_texts AS")[0]


@register(f"""WITH {o.LISTINGS}, {_JS},
k AS (SELECT row_id, row_id % 5 AS kind, CAST(js AS JSON) AS j FROM raw_js)
SELECT row_id, pos, CASE pos WHEN 9 THEN 'extra' ELSE json_extract_string(j, '$.propertyCode') END AS propertyCode,
  CASE pos WHEN 9 THEN NULL ELSE json_extract_string(j, '$.operation') END AS operation
FROM (SELECT row_id, 0 AS pos, j FROM k WHERE kind IN (0, 1, 2, 3) UNION ALL SELECT row_id, 1 AS pos, j FROM k WHERE kind = 1
      UNION ALL SELECT row_id, 9 AS pos, j FROM k WHERE kind = 3)""")
def read_envelope(spark, sf_dir):
    """Envelopes of every accepted shape, unwrapped with positions."""
    nested = d.nested_listings(spark, sf_dir)
    v = F.to_json(F.struct(*[c for c in nested.columns if c not in ("batch_id", "row_id")]), {"ignoreNullFields": "false"})
    kind = F.col("row_id") % 5
    doc = (F.when(kind == 0, F.concat(F.lit('{"elementList":[],"anuncios":['), v, F.lit("]}")))
           .when(kind == 1, F.concat(F.lit('{"elementList":['), v, F.lit(","), v, F.lit("]}")))
           .when(kind == 2, v).when(kind == 3, F.concat(F.lit("["), v, F.lit(',{"propertyCode":"extra"}]')))
           .otherwise('{"anuncios":[]}'))
    rows = from_raw(unwrap_envelopes(parse_values(nested.select("row_id", doc.alias("value"))).drop("value")))
    return rows.select("row_id", F.when(F.col("propertyCode") == "extra", 9).otherwise(F.col("pos")).alias("pos"),
                       "propertyCode", "operation")


@register("""WITH k AS (SELECT o_orderkey AS row_id, o_orderkey % 7 AS kind FROM orders)
SELECT row_id, pos, CASE WHEN kind = 6 OR pos = 2 THEN 'L' || row_id END AS propertyCode
FROM (SELECT row_id, kind, unnest(CASE WHEN kind = 4 THEN [0, 1, 2] ELSE [0] END) AS pos FROM k)""")
def read_malformed(spark, sf_dir):
    """Documents of every shape that is no listing, each kept as a row: a key without an array, bare values, broken text."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row_id"))
    listing = F.concat(F.lit('{"propertyCode":"L'), F.col("row_id").cast("string"), F.lit('"}'))
    kind = F.col("row_id") % 7
    doc = (F.when(kind == 0, F.concat(F.lit('{"anuncios":'), listing, F.lit("}")))
           .when(kind == 1, F.concat(F.lit('"'), F.col("row_id").cast("string"), F.lit('"'))).when(kind == 2, F.col("row_id").cast("string"))
           .when(kind == 3, "null").when(kind == 4, F.concat(F.lit("[1,null,"), listing, F.lit("]"))).when(kind == 5, F.concat(F.lit("{"), listing))
           .otherwise(F.concat(F.lit('{"anuncios":3,"elementList":['), listing, F.lit("]}"))))
    return from_raw(unwrap_envelopes(parse_values(orders.withColumn("value", doc)).drop("value"))).select("row_id", "pos", "propertyCode")


_TYPED = [column_name(f) for f in FIELDS]


@register(f"WITH {o.LISTINGS} SELECT forma, row_id, {', '.join(_TYPED)} FROM listings, (SELECT unnest(['anidada', 'punteada', 'plana']) AS forma)")
def accept_frames(spark, sf_dir):
    """Nested, dotted and flat frames become the same typed listings."""
    nested = d.nested_listings(spark, sf_dir)
    frames = {"anidada": nested, "punteada": flatten(nested), "plana": d.listings(spark, sf_dir)}
    one, two, three = (canonical(f).select(F.lit(n).alias("forma"), "row_id", *_TYPED) for n, f in frames.items())
    return one.unionByName(two).unionByName(three)


_WRITTEN = {"row_id": "long", "propertyCode": "string", "operation": "string", "price": "double", "size": "double", "description": "string"}


def _with_places(rows: DataFrame) -> DataFrame:
    """Each row's place in files as they are named; the table of files is small beside the rows."""
    lines = numbered(rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")))
    sizes = lines.groupBy("file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return look_up(lines, measure(sizes.select("file", before.alias("antes")), ["file"])).withColumn("lugar", F.col("line") + F.col("antes"))


@register(f"""WITH {o.LISTINGS} SELECT forma, row_number() OVER (PARTITION BY forma ORDER BY row_id) - 1 AS lugar, row_id, propertyCode, operation, price, size, description
FROM listings, (SELECT unnest(['parquet', 'csv']) AS forma)""")
def written_in_order(spark, sf_dir):
    """Rows written in input order, as Parquet and as CSV with a header, and read back with their places."""
    base, rows = f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}", d.listings(spark, sf_dir).select("row_id", *[c for c in _WRITTEN if c != "row_id"])
    rows = rows.withColumn("orden", F.col("row_id"))
    write_native(rows, f"{base}/rows.parquet", "orden")
    write_native(rows, f"{base}/rows", "orden")
    schema = ", ".join(f"{c} {t}" for c, t in _WRITTEN.items())
    read = {"parquet": spark.read.schema(schema).parquet(f"{base}/rows.parquet"), "csv": spark.read.schema(schema).options(**CSV, multiLine=True).csv(f"{base}/rows")}
    one, two = (_with_places(df).select(F.lit(n).alias("forma"), "lugar", F.col("row_id").cast(rows.schema["row_id"].dataType).alias("row_id"), *list(_WRITTEN)[1:]) for n, df in read.items())
    return one.unionByName(two)


@register(f"WITH {o.LISTINGS} SELECT row_id, {', '.join(column_name(f) for f in FIELDS)} FROM listings")
def flatten_listings(spark, sf_dir):
    """Nested objects flattened to dotted columns (shown with underscores)."""
    flat = flatten(d.nested_listings(spark, sf_dir))
    return flat.select("row_id", *[F.col(f"`{f}`").alias(column_name(f)) for f in FIELDS])


@register(f"""WITH {o.LISTINGS} SELECT row_id, propertyCode, operation, propertyType, CAST(NULL AS DOUBLE) AS price, size,
  CAST(NULL AS DOUBLE) AS rooms, bathrooms, longitude, CAST(NULL AS VARCHAR) AS detailedType_subTypology FROM listings""")
def default_columns(spark, sf_dir):
    """Expected columns a frame lacks appear as NULL."""
    partial = flatten(d.nested_listings(spark, sf_dir).drop("price", "rooms", "detailedType"))
    full = with_expected_columns(partial)
    return full.select("row_id", "propertyCode", "operation", "propertyType", "price", "size", "rooms", "bathrooms",
                       "longitude", F.col("`detailedType.subTypology`").alias("detailedType_subTypology"))


_JSON_FIELDS = [f for f in FIELDS if "." not in f]
_JSON_NUMBERS = [f for f in _JSON_FIELDS if FIELDS[f] == "double"]


@register(f"""WITH {o.LISTINGS} SELECT CAST(to_json({{row_id: row_id, {', '.join(f"{f}: CAST(round({f} * 10000) AS BIGINT)" if f in _JSON_NUMBERS else f"{f}: {f}" for f in _JSON_FIELDS)},
  detailedType: {{typology: detailedType_typology, subTypology: detailedType_subTypology}}, parkingSpace: {{hasParkingSpace: parkingSpace_hasParkingSpace}}}}) AS VARCHAR) AS fila FROM listings""")
def json_records(spark, sf_dir):
    """Whole rows as JSON objects that keep their nulls; numbers in ten-thousandths, as engines write doubles each in their own way."""
    nested = d.nested_listings(spark, sf_dir)
    whole = [F.round(F.col(f) * 10000).cast("long").alias(f) if f in _JSON_NUMBERS else F.col(f) for f in _JSON_FIELDS]
    return json_rows(nested.select("row_id", *whole, "detailedType", "parkingSpace"))


@register(f"""WITH {o.LISTINGS} SELECT row_number() OVER (ORDER BY batch_id, row_id) - 1 AS row_id, propertyCode, price, size, detailedType_typology, description
FROM listings UNION ALL SELECT count(*), 'fin', NULL, NULL, NULL, NULL FROM listings""")
def read_document(spark, sf_dir):
    """All listings in one JSON document, read back as elements that many tasks cut out of one file."""
    path = f"{checkpoint_dir(spark)}/document-{uuid.uuid4().hex}"
    nested = d.nested_listings(spark, sf_dir)
    value = F.to_json(F.struct(*[c for c in nested.columns if c not in ("batch_id", "row_id")]), {"ignoreNullFields": "false"})
    around = spark.createDataFrame([(0, '{"other":{"a":[1,{"b":"}"}]},"elementList":['), (2, '{"propertyCode":"fin"}],"end":[]}')], "part int, value string")
    around = around.select("part", F.lit("").alias("batch_id"), F.lit(0).cast("long").alias("row_id"), "value")
    body = nested.select(F.lit(1).alias("part"), "batch_id", F.col("row_id").cast("long").alias("row_id"), F.concat(value, F.lit(",")).alias("value"))
    # Listings are made by many tasks; one task puts their texts in order, as the document is one file.
    body.unionByName(around).repartition(1).sortWithinPartitions("part", "batch_id", "row_id").select("value").write.text(path)
    return from_raw(read_documents(spark, path)).select("row_id", "propertyCode", "price", "size", "detailedType_typology", "description")


# ---------------------------------------------------------------- projections
_NUMBER_TEXTS = ["12", " 12 ", "1e2", ".5", "5.", "inf", "nan", "12d", "1_000", "+3", "", "1 2", "-7.25", "0x10"]


def _number_text(k: str, concat: str) -> str:
    return (f"CASE {k} % 15" + "".join(f" WHEN {i} THEN '{t}'" for i, t in enumerate(_NUMBER_TEXTS)) + f" ELSE {concat} END")


@register(f"""SELECT o_orderkey, CASE WHEN regexp_full_match(trim(s), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
  THEN try_cast(replace(trim(s), '+', '') AS DOUBLE) END AS numero
FROM (SELECT o_orderkey, {_number_text('o_orderkey', "CAST(o_orderkey AS VARCHAR) || '.5'")} AS s FROM orders)""")
def coerce_numeric_text(spark, sf_dir):
    """Text to number; everything unusable is NULL."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.expr(_number_text("o_orderkey", "CONCAT(CAST(o_orderkey AS STRING), '.5')"))
    return orders.select("o_orderkey", coerce_numeric(text, T.StringType()).alias("numero"))


@register(f"WITH {o.LISTINGS} SELECT row_id, {o.FLOOR} AS planta FROM listings", name="parse_floor")
def parse_floor_codes(spark, sf_dir):
    return d.listings(spark, sf_dir).select("row_id", parse_floor(F.col("floor")).alias("planta"))


@register(f"""WITH {o.LISTINGS}, texts AS (SELECT row_id AS id, {o.norm('description')} AS t FROM listings),
found AS ({o.matches('texts', [r for r in AMENITY_RULES if r[0] == 'HASLIFT'])})
SELECT row_id, coalesce(any_value(CAST(hasLift AS INTEGER)), CAST({o._flag('HASLIFT')} AS INTEGER)) AS ascensor,
  any_value(hasLift) IS NULL AS ascensor_desde_descripcion
FROM listings JOIN texts ON row_id = texts.id LEFT JOIN found ON row_id = found.id GROUP BY row_id""")
def lift_fallback(spark, sf_dir):
    """Structured lift, else the text rule."""
    own = own_features(2.0)
    return prepare(d.listings(spark, sf_dir)).select("row_id", own["HASLIFT"].alias("ascensor"), own["ascensor_desde_descripcion"].alias("ascensor_desde_descripcion"))


@register(f"""WITH {o.LISTINGS} SELECT row_id, CAST(coalesce(parkingSpace_hasParkingSpace, false) AS INTEGER) AS garaje,
  {o._kind('duplex')} AS duplex, {o._kind('studio')} AS estudio, coalesce(newDevelopment, false) AS obra_nueva FROM listings""")
def structured_flags(spark, sf_dir):
    """Parking default, kinds and the new-development mark."""
    own = own_features(2.0)
    return prepare(d.listings(spark, sf_dir)).select(
        "row_id", own["HASPARKINGSPACE"].alias("garaje"), own["ISDUPLEX"].alias("duplex"),
        own["ISSTUDIO"].alias("estudio"), own["obra_nueva"].alias("obra_nueva"))


# ---------------------------------------------------------------- text
@register(f"WITH {o.DOC_TEXTS} SELECT id AS doc_id, t, length(t) AS largo FROM doc_texts", name="normalize_text")
def normalized_documents(spark, sf_dir):
    return d.described_documents(spark, sf_dir).select("doc_id", normalize_text(F.col("description")).alias("t")).select(
        "doc_id", "t", F.char_length("t").cast("long").alias("largo"))


def _doc_matches(df: DataFrame, rules) -> DataFrame:
    texts = df.select("doc_id", normalize_text(F.col("description")).alias("t"))
    per = texts.withColumns({f"m_{f}": amenity_matches(F.col("t"), rules[f]) for f in rules})
    stacked = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("m")) for f in rules])
    return (per.select("doc_id", F.explode(stacked).alias("s"))
            .select("doc_id", "s.feature", F.posexplode("s.m").alias("n", "hit"))
            .select("doc_id", "feature", "n", "hit.motivo", "hit.fragmento"))


_MATCH_COLUMNS = ("SELECT id AS doc_id, feature, CAST(row_number() OVER (PARTITION BY id, feature ORDER BY rule_no, i) - 1 AS INTEGER) AS n, "
                  "motivo, fragmento FROM found")


@register(f"{o.DOC_MATCHES} {_MATCH_COLUMNS}", name="amenity_matches")
def document_matches(spark, sf_dir):
    """Every match with its fragment and discard reason."""
    return _doc_matches(d.described_documents(spark, sf_dir), DEFAULT_RULES)


@register(f"WITH {o.DOC_TEXTS}, found AS ({o.matches('doc_texts', o.USER_RULES)}) {_MATCH_COLUMNS}")
def user_rule_matches(spark, sf_dir):
    """Rules given by the user, dense in matches."""
    return _doc_matches(d.described_documents(spark, sf_dir), rule_book(o.USER_RULES))


@register(o.amenity_states())
def amenity_states(spark, sf_dir):
    """State, conflict, evidence and discards per document and amenity."""
    out = extract_amenities(d.described_documents(spark, sf_dir))
    joined = F.array_join(F.transform("e.descartes", lambda x: F.concat(x["motivo"], F.lit(":"), x["fragmento"])), "|")
    return (out.select("doc_id", F.explode_outer("amenidades").alias("feature", "e"))
            .select("doc_id", "feature", "e.estado", "e.conflicto", "e.evidencia", "e.negacion", joined.alias("descartes")))


@register(o.amenity_flags(), name="amenity_flags")
def document_flags(spark, sf_dir):
    return amenity_flags(d.described_documents(spark, sf_dir)).drop("description")


@register(f"WITH {o.DOC_TEXTS} SELECT id AS doc_id, {o.is_work('t')} AS a_reformar, {o.is_occupied('t')} AS ocupada FROM doc_texts")
def state_and_occupation(spark, sf_dir):
    """Works needed and occupied, with their cancellations."""
    texts = d.described_documents(spark, sf_dir).select("doc_id", normalize_text(F.col("description")).alias("t"))
    return texts.select("doc_id", needs_work(F.col("t")).alias("a_reformar"), occupied(F.col("t")).alias("ocupada"))


# ---------------------------------------------------------------- geometry and lookups
@register(f"""WITH {o.LISTINGS} SELECT row_id, round(x, 3) AS x, round(y, 3) AS y
FROM ({o.projected('(SELECT row_id, CASE WHEN NOT isnan(latitude) THEN latitude END AS latitude, longitude FROM listings)')})""")
def utm_project(spark, sf_dir):
    """Degrees to zone 30N metres."""
    x, y = project_utm(F.col("latitude"), F.col("longitude"))
    return d.listings(spark, sf_dir).select("row_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_ASSIGNED = f"""WITH {o.LISTINGS}, edges AS ({o._edges()}), points AS ({o.projected('(SELECT row_id, latitude, longitude FROM listings)')}),
assigned AS ({o._assigned('points')})"""


def _assign(spark, sf_dir, **kw) -> DataFrame:
    index = index_areas(d.area_edges(spark, sf_dir), **kw)
    return assign_area(d.listings(spark, sf_dir).select("batch_id", "row_id", "latitude", "longitude"), index)


_AREA_COLUMNS = ["row_id", "barrio_code", "distrito_code", "barrio_rescatado"]


@register(f"{_ASSIGNED} SELECT {', '.join(_AREA_COLUMNS)} FROM assigned", name="assign_area")
def assigned_areas(spark, sf_dir):
    """Inside, else nearest within 500 m."""
    return _assign(spark, sf_dir).select(_AREA_COLUMNS)


@register(f"{_ASSIGNED} SELECT {', '.join(_AREA_COLUMNS)} FROM assigned")
def assign_area_shuffled(spark, sf_dir):
    """The same through the shuffle that serves layers too large to broadcast."""
    return _assign(spark, sf_dir, max_edges=0).select(_AREA_COLUMNS)


@register(f"{_ASSIGNED} SELECT row_id, barrio_code FROM assigned WHERE barrio_code IS NOT NULL AND NOT barrio_rescatado")
def point_in_area(spark, sf_dir):
    """Strictly inside only."""
    return _assign(spark, sf_dir).filter("barrio_code IS NOT NULL AND NOT barrio_rescatado").select("row_id", "barrio_code")


@register(f"{_ASSIGNED} SELECT row_id, barrio_code FROM assigned WHERE barrio_rescatado")
def nearest_area_500m(spark, sf_dir):
    """Rescued only."""
    return _assign(spark, sf_dir).filter("barrio_rescatado").select("row_id", "barrio_code")


@register(f"SELECT area_code, CAST(ring_no AS INTEGER) AS ring_no, CAST(edge_no AS INTEGER) AS edge_no, x1, y1, x2, y2 FROM ({o._edges()})")
def area_edges_from_wkb(spark, sf_dir):
    """Areas to WKB polygons and back to edges."""
    return polygon_edges(polygon_shapes(d.area_edges(spark, sf_dir)))


_DISTANCES = ["DISTANCE_TO_CITY_CENTER", "DISTANCE_TO_METRO", "DISTANCE_TO_CASTELLANA"]
_DISTANCE_SQL = f"""{o.NATIVE} SELECT row_id, {o.rounded(_DISTANCES)} FROM distances"""


@register(_DISTANCE_SQL, name="nearest_poi")
def poi_distances(spark, sf_dir):
    """Distance to the centre and to the nearest point of each type."""
    refs = references(spark, sf_dir)
    return rounded(nearest_poi(d.listings(spark, sf_dir).select("row_id", "latitude", "longitude"), refs.points),
                   "row_id", *_DISTANCES)


@register(_DISTANCE_SQL)
def nearest_poi_shuffled(spark, sf_dir):
    """The same through the shuffle that serves more points than can be broadcast; points without numbers, split by passes."""
    index = index_pois(references(spark, sf_dir).pois.orderBy("poi_no").drop("poi_no"), max_points=0, task_points=200)
    return rounded(nearest_poi(d.listings(spark, sf_dir).select("row_id", "latitude", "longitude"), index), "row_id", *_DISTANCES)


@register(f"""{o.NATIVE} SELECT row_id, barrio_code, {o.rounded(AREA_FEATURES)}, indice_venta, factor_renta_mensual FROM assigned LEFT JOIN area_table USING (barrio_code) LEFT JOIN indices USING (distrito_code)""")
def area_and_district_lookups(spark, sf_dir):
    """Area features and district indices by code."""
    refs = references(spark, sf_dir)
    located = assign_area(d.listings(spark, sf_dir).select("batch_id", "row_id", "latitude", "longitude"), refs.areas)
    out = look_up(look_up(located, refs.area_table), refs.index_table)
    return rounded(out, "row_id", "barrio_code", *AREA_FEATURES, "indice_venta", "factor_renta_mensual")


# ---------------------------------------------------------------- features, reasons, model
@register(f"""{o.NATIVE} SELECT row_id, {o.rounded(MODEL_FEATURES, 'x_')}, barrio_rescatado, planta_imputada,
  ascensor_desde_descripcion, sin_descripcion, obra_nueva FROM lifted""", name="build_features")
def listing_features(spark, sf_dir):
    """The model matrix, with the context marks."""
    refs = references(spark, sf_dir)
    out = build_features(d.listings(spark, sf_dir), refs)
    x = [F.round(c, 6).alias(f"x_{c}") if c in o.DOUBLES else F.col(c).alias(f"x_{c}") for c in refs.meta.columnas]
    return out.select("row_id", *x, "barrio_rescatado", "planta_imputada", "ascensor_desde_descripcion",
                      "sin_descripcion", "obra_nueva")


@register(f"{o.NATIVE} SELECT row_id, valido, motivo_no_valido FROM valued")
def native_reasons(spark, sf_dir):
    """Every reason for abstaining, in order."""
    refs = references(spark, sf_dir)
    out = with_reasons(build_features(d.listings(spark, sf_dir), refs), refs)
    return out.select("row_id", "valido", F.when(~F.col("valido"), F.concat_ws(";", "motivos")).alias("motivo_no_valido"))


@register(f"""WITH {o.LISTINGS}, t AS (SELECT *, size AS CONSTRUCTEDAREA, {o.norm('description')} AS t FROM listings)
SELECT row_id, {o._in('propertyType', ['chalet', 'countryHouse'])} OR {o._in('detailedType_subTypology', ['independantHouse', 'semidetachedHouse', 'terracedHouse'])} AS tipologia_casa,
  coalesce(size > 240, false) AS superficie_fuera_de_dominio, {o.is_work('t')} AS a_reformar, {o.is_occupied('t')} AS ocupada FROM t""")
def domain_reasons(spark, sf_dir):
    """Conditions outside the model's domain."""
    out = prepare(d.listings(spark, sf_dir)).withColumn("CONSTRUCTEDAREA", F.col("size"))
    return out.select("row_id", *[c.alias(n) for n, c in domain_conditions(d.META.area_max_dominio).items()])


@register(f"{o.NATIVE} SELECT row_id, fuera_de_rango FROM reasoned", name="out_of_range")
def out_of_range_marks(spark, sf_dir):
    refs = references(spark, sf_dir)
    out = build_features(d.listings(spark, sf_dir), refs)
    return out.select("row_id", out_of_range(refs.meta.columnas, refs.meta.rangos_train).alias("fuera_de_rango"))


_PROFILED = {"size": "CONSTRUCTEDAREA", "rooms": "ROOMNUMBER", "bathrooms": "BATHNUMBER", "planta": "FLOORCLEAN"}


@register(f"""WITH {o.LISTINGS}, f AS (SELECT *, {o.FLOOR} AS planta FROM listings)
{' UNION ALL '.join(f"SELECT '{v}' AS variable, count({c}) AS n, min({c}) AS minimo, max({c}) AS maximo, round(quantile_cont({c}, 0.5), 6) AS mediana, round(quantile_cont({c}, 0.99), 6) AS p99 FROM f" for c, v in _PROFILED.items())}""")
def training_profile(spark, sf_dir):
    """Ranges, medians and 99th percentiles."""
    rows = d.listings(spark, sf_dir).withColumn("planta", parse_floor(F.col("floor")))
    out = profile.training_profile(rows.select(*[F.col(c).alias(v) for c, v in _PROFILED.items()]), list(_PROFILED.values()))
    return out.select("variable", "n", "minimo", "maximo", F.round("mediana", 6).alias("mediana"), F.round("p99", 6).alias("p99"))


def _scored(spark, sf_dir, model: TreeModel | None = None, **kw) -> DataFrame:
    refs = references(spark, sf_dir)
    out = with_reasons(build_features(d.listings(spark, sf_dir), refs), refs)
    return score_trees(out, model or refs.model, "puntuacion", where=F.col("valido"), **kw).select(
        "row_id", F.round(F.col("puntuacion").cast("double"), 6).alias("puntuacion"))


_SCORE_SQL = f"{o.NATIVE} SELECT row_id, round(CAST(score AS DOUBLE), 6) AS puntuacion FROM scored"


@register(_SCORE_SQL, name="score_trees")
def scored_listings(spark, sf_dir):
    """The ensemble through Arrow batches, as large models run."""
    return _scored(spark, sf_dir, expression_nodes=0)


@register(_SCORE_SQL)
def score_trees_expression(spark, sf_dir):
    """The ensemble as one generated expression, as small models run."""
    return _scored(spark, sf_dir)


@register(f"{o.NATIVE}, {o.large_score_sql()}")
def score_trees_410(spark, sf_dir):
    """An ensemble as large as a full model: 410 trees over all 21 columns."""
    return _scored(spark, sf_dir, model=d.large_model(spark))


@register(f"{o.NATIVE} SELECT row_id, {o.rounded(NATIVE_COLUMNS)} FROM valued", name="value_native")
def native_valuation(spark, sf_dir):
    """The 23-column valuation."""
    return rounded(_native(spark, sf_dir), "row_id", *NATIVE_COLUMNS)


@register(f"{o.NATIVE} SELECT row_id, valido, {o.rounded(MODEL_FEATURES, 'x_')} FROM valued")
def value_with_features(spark, sf_dir):
    """The valuation with its features beside it."""
    out = _native(spark, sf_dir, include_features=True)
    x = [F.round(f"x_{c}", 6).alias(f"x_{c}") if c in o.DOUBLES else F.col(f"x_{c}") for c in MODEL_FEATURES]
    return out.select("row_id", "valido", *x)


@register(f"{o.NATIVE} SELECT row_id, barrio_code, distrito_code, barrio_code IS NULL AS sin_barrio FROM lifted")
def unassigned_marks(spark, sf_dir):
    """Listings that no area takes."""
    return build_features(d.listings(spark, sf_dir), references(spark, sf_dir)).select("row_id", "barrio_code", "distrito_code", "sin_barrio")


@register(f"""{o.NATIVE} SELECT distrito_code, operation, count(*) AS anuncios, count(*) FILTER (WHERE valido) AS validos,
  count(precio_estimado) AS valorados, max(precio_estimado) AS maximo, min(precio_estimado) AS minimo,
  max(renta_mensual_estimada) AS renta_maxima FROM valued GROUP BY distrito_code, operation""")
def value_by_district(spark, sf_dir):
    """Valuation summarised by district and operation."""
    return _valued(spark, sf_dir).groupBy("distrito_code", "operation").agg(
        F.count("*").alias("anuncios"), F.count_if("valido").alias("validos"), F.count("precio_estimado").alias("valorados"),
        F.max("precio_estimado").alias("maximo"), F.min("precio_estimado").alias("minimo"),
        F.max("renta_mensual_estimada").alias("renta_maxima"))


@register(f"""{o.NATIVE} SELECT motivo, count(*) AS anuncios FROM (SELECT unnest(motivos) AS motivo FROM reasoned) GROUP BY motivo""")
def reason_breakdown(spark, sf_dir):
    refs = references(spark, sf_dir)
    return profile.reason_breakdown(with_reasons(build_features(d.listings(spark, sf_dir), refs), refs))


@register(f"""{o.NATIVE} SELECT count(*) AS anuncios, count(*) FILTER (WHERE valido) AS validos,
  count(*) FILTER (WHERE NOT valido) AS abstenciones FROM valued""")
def run_summary(spark, sf_dir):
    return profile.run_summary(_native(spark, sf_dir))


@register(f"""{o.NATIVE} SELECT row_id, CAST(CASE WHEN precio_estimado IS NULL THEN 0 ELSE 1 END AS BIGINT) AS estimaciones,
  CAST(3 AS BIGINT) AS anuncios FROM valued""")
def price_invariance(spark, sf_dir):
    """Announced price and new-development flag never move an estimate: one value per listing and three variants."""
    rows = d.listings(spark, sf_dir)
    variants = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("variante")
    three = rows.select("*", variants).withColumns({
        "price": F.when(F.col("variante") == 1, F.col("price") * 2).when(F.col("variante") == 0, F.col("price")),
        "newDevelopment": F.when(F.col("variante") == 1, True).when(F.col("variante") == 0, F.col("newDevelopment"))})
    out = value_native(three, references(spark, sf_dir))
    return profile.estimate_invariance(out, ["row_id"])


@register("""SELECT count(*) AS trees, 3 * count(*) AS nodes, 2 * count(*) AS leaves,
  coalesce(string_agg(DISTINCT CASE WHEN s_suppkey % 5 = 3 THEN 'NATION_' || s_nationkey END, ',' ORDER BY CASE WHEN s_suppkey % 5 = 3 THEN 'NATION_' || s_nationkey END), '') AS unknown_features
FROM supplier""", name="tree_check")
def model_check(spark, sf_dir):
    """A model of one stump a supplier, some of them on features that the metadata doesn't list."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    known = F.element_at(F.array(*[F.lit(c) for c in MODEL_FEATURES]), (F.col("s_suppkey") % len(MODEL_FEATURES) + 1).cast("int"))
    feature = F.when(F.col("s_suppkey") % 5 == 3, F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))).otherwise(known)
    nodes = s.select(F.col("s_suppkey").alias("tree"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("node"),
                     feature.alias("f"), F.col("s_acctbal").cast("float").alias("t"))
    split = F.col("node") == 0
    nodes = nodes.select("tree", "node", F.when(split, F.col("f")).alias("feature"), F.when(split, F.col("t")).alias("threshold"),
                         F.when(split, 1).alias("left"), F.when(split, 2).alias("right"), split.alias("default_left"),
                         F.when(~split, F.col("t") / 1000).cast("float").alias("leaf"))
    return tree_check(TreeModel(nodes, list(MODEL_FEATURES), 0.0), list(MODEL_FEATURES))


# ---------------------------------------------------------------- contract layer
@register(f"WITH {o.validated()} SELECT row_id, codigo AS propertyCode, estado, detalle FROM checked")
def validate_strict(spark, sf_dir):
    """First failing step of every raw listing."""
    return contract.validate(d.raw_listings(spark, sf_dir)).select(
        "row_id", F.col("codigo").alias("propertyCode"), "error.estado", "error.detalle")


_COPIES = f"""WITH {o.validated()}, copies AS (SELECT batch_id, codigo, count(*) AS n FROM checked WHERE codigo IS NOT NULL GROUP BY ALL)
SELECT row_id, codigo, coalesce(n, 1) AS copias FROM checked LEFT JOIN copies USING (batch_id, codigo)"""


@register(_COPIES)
def duplicates_in_batch(spark, sf_dir):
    """Occurrences of each code within its batch."""
    return mark_duplicates(contract.validate(d.raw_listings(spark, sf_dir))).select("row_id", "codigo", "copias")


@register(_COPIES)
def duplicates_shuffled(spark, sf_dir):
    """The same through the filters that serve more repeated codes than can be broadcast; listing no key makes the cascade go its whole way."""
    return mark_duplicates(contract.validate(d.raw_listings(spark, sf_dir)), max_rows=0, listed=0).select("row_id", "codigo", "copias")


@register(f"""WITH {o.batch()} SELECT row_id, estado, detalle FROM judged WHERE estado IS NOT NULL""")
def contract_errors_filtered(spark, sf_dir):
    """Errors of the contract, copies told by filters: whole rows stay where they are."""
    return contract.validate_batch(d.raw_listings(spark, sf_dir), max_rows=0).where("error is not null").select("row_id", "error.estado", "error.detalle")


def _flat_results(rows: DataFrame) -> DataFrame:
    """Every response column, marks beside the rest and warnings joined."""
    flat = rows.select("*", "calidad.*").drop("calidad").withColumn("advertencias", F.array_join("advertencias", " | "))
    return rounded(flat)


@register(o.results_sql(), name="results")
def result_rows(spark, sf_dir):
    """Response rows of the contract layer."""
    return _flat_results(batch.results(_outcome(spark, sf_dir), d.META))


_HASHES = ["modelo_sha256", "paquete_sha256"]


@register(f"SELECT * EXCLUDE ({', '.join(_HASHES)}), true AS modelo_intacto, true AS paquete_intacto FROM ({o.results_sql()})")
def package_results(spark, sf_dir):
    """Whole responses with a package written, named by its manifest, checked and loaded; its hashes are held against the files'."""
    folder = f"{checkpoint_dir(spark)}/package-{uuid.uuid4().hex}"
    own = references(spark, sf_dir)
    write_package(own, folder)
    listed = package_manifest(own, folder)
    refs = load_package(spark, folder, listed)
    rows = _flat_results(batch.results(batch.value_batch(d.raw_listings(spark, sf_dir), refs), refs.meta))
    model = next(h for n, h in listed["sha256"].items() if n.startswith("modelo.json"))
    return rows.withColumns({"modelo_intacto": F.col("modelo_sha256") == model, "paquete_intacto": F.col("paquete_sha256") == listed["paquete_sha256"]}).drop(*_HASHES)


@register(f"WITH {o.batch()} SELECT row_id AS indice, codigo AS propertyCode, estado, detalle FROM outcome WHERE estado IS NOT NULL", name="errors")
def error_rows(spark, sf_dir):
    """Error rows of the contract layer."""
    return batch.errors(_outcome(spark, sf_dir)).drop("batch_id")


@register(f"WITH {o.batch()} SELECT row_id, {o.warnings_sql()} AS advertencias FROM outcome WHERE estado IS NULL")
def warnings_list(spark, sf_dir):
    """Warnings in reporting order."""
    return batch.results(_outcome(spark, sf_dir), d.META).select("row_id", F.array_join("advertencias", " | ").alias("advertencias"))


@register(f"""WITH {o.batch()} SELECT count(*) AS anuncios, count(*) FILTER (WHERE estado IS NULL) AS resultados, count(*) FILTER (WHERE estado IS NOT NULL) AS errores FROM outcome""")
def outcome_summary(spark, sf_dir):
    """Counts seen on the way while an outcome is written, without a second pass."""
    seen = batch.write_outcome(_outcome(spark, sf_dir), f"{checkpoint_dir(spark)}/outcome-{uuid.uuid4().hex}")
    return spark.createDataFrame([(seen["anuncios"], seen["resultados"], seen["errores"])], "anuncios long, resultados long, errores long")


_ESTIMATES = ["precio_estimado_base", "precio_estimado", "renta_mensual_estimada"]


@register(f"""WITH l AS ({o.NATIVE} SELECT row_id, {', '.join(_ESTIMATES)} FROM valued WHERE valido), r AS ({o.results_sql()}),
b AS (SELECT row_id, l.row_id IS NOT NULL AS izq, r.row_id IS NOT NULL AS der, {' AND '.join(f'l.{c} IS NOT DISTINCT FROM r.{c}' for c in _ESTIMATES)} AS igual,
  greatest({', '.join(f'abs(l.{c} - r.{c})' for c in _ESTIMATES)}) AS d FROM l FULL JOIN r USING (row_id))
SELECT count(*) AS total, count(*) FILTER (WHERE izq AND der AND igual) AS iguales, count(*) FILTER (WHERE izq AND der AND NOT igual) AS distintos,
  count(*) FILTER (WHERE NOT der) AS solo_izquierda, count(*) FILTER (WHERE NOT izq) AS solo_derecha, CAST(0 AS BIGINT) AS repetidos,
  round(coalesce(max(d), 0), 6) AS diferencia_maxima, count(*) FILTER (WHERE NOT (izq AND der)) AS sin_tolerancia, count(*) FILTER (WHERE NOT (izq AND der)) = 0 AS dentro_de_tolerancia FROM b""")
def reconcile_estimates(spark, sf_dir):
    """Base price, price and rent of the native layer against those of the contract's responses, row by row."""
    native = only(_native(spark, sf_dir), F.col("valido")).select("row_id", *_ESTIMATES)
    rows = batch.results(_outcome(spark, sf_dir), d.META).select("row_id", *_ESTIMATES)
    return reconcile(native, rows, "row_id", _ESTIMATES).withColumn("diferencia_maxima", F.round("diferencia_maxima", 6))


# ---------------------------------------------------------------- reports
def _shifted(native: DataFrame) -> DataFrame:
    """A second result set: some rows missing, some changed, some new."""
    k = F.col("row_id")
    return (native.filter(k % 83 != 4)
            .withColumn("propertyCode", F.when(k % 89 == 6, F.concat("propertyCode", F.lit("-x"))).otherwise(F.col("propertyCode")))
            .withColumn("precio_anunciado", F.when(k % 79 == 3, F.col("precio_anunciado") + 1)
                        .when(k % 71 == 5, F.lit(None)).otherwise(F.col("precio_anunciado"))))


_COMPARED = ["precio_anunciado", "propertyType", "size"]


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = d.listings(spark, sf_dir).select("row_id", "propertyCode", F.col("price").alias("precio_anunciado"), "propertyType", "size")
    return rows, _shifted(rows)


_SIDES_SQL = f"""WITH {o.LISTINGS}, l AS (SELECT row_id, propertyCode AS c, price AS p, propertyType AS k, size AS s FROM listings),
r AS (SELECT row_id, CASE WHEN row_id % 89 = 6 THEN c || '-x' ELSE c END AS c, CASE WHEN row_id % 79 = 3 THEN p + 1 WHEN row_id % 71 = 5 THEN NULL ELSE p END AS p, k, s
      FROM l WHERE row_id % 83 <> 4),
every_row AS (SELECT coalesce(coalesce(l.c, r.c), '?') AS c, bool_and(coalesce(l.n, 0) = coalesce(r.n, 0)) AS same
  FROM (SELECT c, p, k, s, count(*) AS n FROM l GROUP BY ALL) l FULL JOIN (SELECT c, p, k, s, count(*) AS n FROM r GROUP BY ALL) r
    ON l.c IS NOT DISTINCT FROM r.c AND l.p IS NOT DISTINCT FROM r.p AND l.k IS NOT DISTINCT FROM r.k AND l.s IS NOT DISTINCT FROM r.s GROUP BY 1),
la AS (SELECT coalesce(c, '?') AS c, count(*) AS n, min(p) AS p0, max(p) AS p1, min(k) AS k0, max(k) AS k1, min(s) AS s0, max(s) AS s1 FROM l GROUP BY ALL),
ra AS (SELECT coalesce(c, '?') AS c, count(*) AS n, min(p) AS p0, max(p) AS p1, min(k) AS k0, max(k) AS k1, min(s) AS s0, max(s) AS s1 FROM r GROUP BY ALL),
both_sides AS (SELECT nullif(coalesce(la.c, ra.c), '?') AS propertyCode, coalesce(la.n, 0) AS n_izquierda, coalesce(ra.n, 0) AS n_derecha,
  CASE WHEN ra.n IS NULL THEN 'solo_izquierda' WHEN la.n IS NULL THEN 'solo_derecha'
    WHEN same THEN 'igual' ELSE 'distinto' END AS comparacion,
  la.n = 1 AND ra.n = 1 AND (la.p0 IS NULL) = (ra.p0 IS NULL) AND la.k0 IS NOT DISTINCT FROM ra.k0 AND (la.s0 IS NULL) = (ra.s0 IS NULL) AS plain,
  greatest(abs(la.p0 - ra.p0), abs(la.p1 - ra.p1), abs(la.s0 - ra.s0), abs(la.s1 - ra.s1)) AS diferencia
  FROM la FULL JOIN ra ON la.c = ra.c JOIN every_row e ON e.c = coalesce(la.c, ra.c))"""


@register(f"{_SIDES_SQL} SELECT propertyCode, n_izquierda, n_derecha, comparacion, round(diferencia, 6) AS diferencia, coalesce(plain, false) AS solo_numerico FROM both_sides", name="compare_results")
def compared_results(spark, sf_dir):
    """Two result sets by code, row by row."""
    left, right = _sides(spark, sf_dir)
    return compare_results(left, right, "propertyCode", _COMPARED).withColumn("diferencia", F.round("diferencia", 6))


@register(f"""{_SIDES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE comparacion = 'igual') AS iguales,
  count(*) FILTER (WHERE comparacion = 'distinto') AS distintos, count(*) FILTER (WHERE comparacion = 'solo_izquierda') AS solo_izquierda,
  count(*) FILTER (WHERE comparacion = 'solo_derecha') AS solo_derecha, count(*) FILTER (WHERE n_izquierda > 1 OR n_derecha > 1) AS repetidos,
  round(coalesce(max(diferencia), 0), 6) AS diferencia_maxima, count(*) FILTER (WHERE comparacion <> 'igual' AND NOT coalesce(plain, false)) AS sin_tolerancia,
  coalesce(max(diferencia), 0) < 1e-8 AND count(*) FILTER (WHERE comparacion <> 'igual' AND NOT coalesce(plain, false)) = 0 AS dentro_de_tolerancia FROM both_sides""", name="reconcile")
def reconciliation(spark, sf_dir):
    """The reconciliation report."""
    left, right = _sides(spark, sf_dir)
    return reconcile(left, right, "propertyCode", _COMPARED).withColumn("diferencia_maxima", F.round("diferencia_maxima", 6))


@register(ORACLES["reconcile"])
def reconcile_report(spark, sf_dir):
    """The reconciliation report written as JSON and read back."""
    report, path = reconciliation(spark, sf_dir), f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@register(f"WITH {o.coverage_sql()} SELECT row_id, propertyCode, valido, motivo_no_valido, barrio_code, barrio_rescatado FROM valued")
def coverage_set(spark, sf_dir):
    """One listing inside every polygon and the edge cases, valued natively."""
    refs = references(spark, sf_dir)
    rows = coverage.coverage_set(refs.edges)
    return rounded(value_native(rows, refs), "row_id", "propertyCode", "valido", "motivo_no_valido", "barrio_code", "barrio_rescatado")


@register("""WITH f AS (SELECT 'doc-' || doc_id AS nombre, sha256(text) AS sha256, doc_id FROM documents),
m AS (SELECT CASE WHEN doc_id % 31 = 7 THEN nombre || '.x' ELSE nombre END AS nombre,
        CASE WHEN doc_id % 29 = 5 THEN sha256('otro') ELSE sha256 END AS sha256 FROM f WHERE doc_id % 37 <> 2)
SELECT nombre, CASE WHEN f.sha256 IS NULL THEN 'falta' WHEN m.sha256 IS NULL THEN 'inesperado' WHEN f.sha256 = m.sha256 THEN 'igual'
  ELSE 'alterado' END AS estado FROM f FULL JOIN m USING (nombre)""")
def manifest_check(spark, sf_dir):
    """Stored texts against a manifest of their hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("nombre"),
                        F.sha2("text", 256).alias("sha256"))
    listed = files.filter("doc_id % 37 <> 2").select(
        F.expr("CASE WHEN doc_id % 31 = 7 THEN CONCAT(nombre, '.x') ELSE nombre END").alias("nombre"),
        F.expr("CASE WHEN doc_id % 29 = 5 THEN sha2('otro', 256) ELSE sha256 END").alias("sha256"))
    return manifest.check_manifest(files, listed)


@register("""SELECT source, sha256('{' || string_agg('"doc-' || doc_id || '":"' || sha256(text) || '"', ',' ORDER BY 'doc-' || doc_id) || '}') AS paquete_sha256
FROM documents GROUP BY source""")
def manifest_fingerprint(spark, sf_dir):
    """One identity hash per source over its texts' hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    entries = docs.select("source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("nombre"),
                          F.sha2("text", 256).alias("sha256"))
    return manifest.manifest_fingerprint(entries, "source")


@register("""WITH e AS (SELECT source, 'doc-' || doc_id AS nombre, sha256(text) AS h FROM documents),
hojas AS (SELECT source, substr(sha256(nombre), 1, 1) AS d, count(*) AS n, sha256('{' || string_agg('"' || nombre || '":"' || h || '"', ',' ORDER BY nombre) || '}') AS h FROM e GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS entradas, 1 AS profundidad, sha256('{' || string_agg('"' || d || '":"' || h || '"', ',' ORDER BY d) || '}') AS raiz_sha256 FROM hojas GROUP BY source""")
def manifest_tree(spark, sf_dir):
    """Root of the hash tree over each source's texts: no task hashes a whole source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    entries = docs.select("source", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("nombre"), F.sha2("text", 256).alias("sha256"))
    return manifest.manifest_tree(entries, "source")


@register()
def file_hashes(spark, sf_dir):
    """Hashes of the files in a folder."""
    return manifest.file_hashes(spark, sf_dir)


@register("""SELECT CAST(doc_id % 32 AS VARCHAR) AS grupo, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) AS sha256
FROM documents GROUP BY 1""")
def file_hashes_streamed(spark, sf_dir):
    """Hashes of files that hold all documents, each streamed through a digest in pieces."""
    folder = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 32).alias("grupo"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition(32, "grupo").sortWithinPartitions("grupo", "doc_id").select("grupo", "text").write.partitionBy("grupo").text(folder)
    hashes = manifest.file_hashes(spark, folder, whole_bytes=0)
    return hashes.select(F.regexp_extract("nombre", "grupo=([^/]+)/", 1).alias("grupo"), "sha256")


# ---------------------------------------------------------------- stream
def _streamed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Results and errors of listings arriving as JSON lines, one file a batch, taken three files at a time; an attempt that broke off lies beside."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    ordered = d.raw_texts(spark, sf_dir).repartition("batch_id").sortWithinPartitions("batch_id", "row_id")
    ordered.select("batch_id", "value").write.partitionBy("batch_id").text(f"{base}/in")
    spark.range(5).write.parquet(f"{base}/out/data/epoch=0/attempt=brokenoff/tipo=resultado")
    refs = references(spark, sf_dir)
    value_stream(spark, f"{base}/in", refs, f"{base}/out", f"{base}/state", max_files=3).awaitTermination()
    named = F.regexp_extract("batch_id", "batch_id=([^/]+)", 1)
    return tuple(side.withColumn("batch_id", named) for side in read_stream_output(spark, f"{base}/out", refs))


@register(f"""WITH lineas AS (SELECT batch_id, row_id, row_number() OVER (PARTITION BY batch_id ORDER BY row_id) - 1 AS linea FROM ({d.LISTINGS_SQL}))
SELECT r.* REPLACE (linea AS row_id) FROM ({o.results_sql()}) r JOIN lineas USING (batch_id, row_id)""")
def value_stream_results(spark, sf_dir):
    """Whole responses of the stream, each with its line."""
    return _flat_results(_streamed(spark, sf_dir)[0])


@register(f"""WITH lineas AS (SELECT batch_id, row_id, row_number() OVER (PARTITION BY batch_id ORDER BY row_id) - 1 AS linea FROM ({d.LISTINGS_SQL}))
SELECT e.batch_id, linea AS indice, propertyCode, estado, detalle
FROM (WITH {o.batch()} SELECT batch_id, row_id, codigo AS propertyCode, estado, detalle FROM outcome WHERE estado IS NOT NULL AND row_id % 71 <> 3) e JOIN lineas USING (batch_id, row_id)""")
def value_stream_errors(spark, sf_dir):
    """Errors of the stream, each with its line; a line with an empty array is a request without listings."""
    return _streamed(spark, sf_dir)[1]
