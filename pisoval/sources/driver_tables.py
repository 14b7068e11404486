"""Listings, areas, points and dimensions read from the TPC-H-like driver tables.

The driver tables hold no listings, so every attribute follows from integer
arithmetic on their keys.  The statements stay within the SQL that Spark and
DuckDB share, so that both engines see the same listings.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread, tasks_for
from ..operators.trees import NODE_SCHEMA, TreeModel
from .listings import FIELDS, column_name
from .reference import Metadata, References

PHRASES = [
    "Piso con terraza y aire acondicionado.",
    "Sin ascensor, pero con trastero y balcón.",
    "Rincón tranquilo con vistas al parque, ideal para actualizar con ilusión.",
    "Armarios empotrados en todas las habitaciones; portero físico.",
    "Piscina comunitaria y zonas ajardinadas.",
    "Posibilidad de plaza de garaje. Se entrega sin necesidad de obras.",
    "Hoy se encuentra alquilado hasta junio, con la renta al día.",
    "Urbanización con jardín, piscina y conserje.",
    "No tiene terraza ni trastero. Ático luminoso.",
    "Cerca de la piscina municipal y con vistas al jardín.",
    "Preinstalación de aire acondicionado, garaje opcional.",
    "Oferta de bares con terraza en la zona. Portero automático.",
    "Proyecto para instalar ascensor en la finca.",
    "Trabajamos también la nuda propiedad - valoraciones sin coste.",
    "Venta de la nuda propiedad; el usufructo queda en la familia.",
    "Llaves en mano: sin inquilinos desde mayo y recién pintado.",
    "Trastero opcional, no incluido; plaza de aparcamiento.",
    "Bomba de calor, splits y climatización por conductos.",
    "El salón no precisa obras; la cocina necesita una actualización.",
    "Terraza comunitaria. Tiene terraza privada de 20 m² y ascensor.",
    "Empotrados de obra y armario ropero, antigua portería.",
    "Jardín botánico a dos pasos; ciudad jardín.",
    "Falta de ascensor; carece de garaje; ausencia de piscina.",
    "Estudio okupado que precisa de algo de reforma; venta sin posesión.",
]


def _phrase(index: str) -> str:
    return "CASE " + index + "".join(f" WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"


# One listing per order; the first orders also carry the text of the document with their number.
LISTINGS_SQL = f"""
SELECT CONCAT('b', CAST(o_orderkey % 16 AS STRING)) AS batch_id, o_orderkey AS row_id,
  CASE WHEN o_orderkey % 101 = 5 THEN NULL
       WHEN o_orderkey % 97 = 13 THEN CONCAT('L', CAST(o_orderkey - 16 AS STRING))
       WHEN o_orderkey % 97 = 15 THEN CONCAT('L', CAST(o_orderkey - 1 AS STRING))
       ELSE CONCAT('L', CAST(o_orderkey AS STRING)) END AS propertyCode,
  CASE WHEN o_orderkey % 59 = 3 THEN 'unknown' WHEN o_orderkey % 61 = 4 THEN NULL
       WHEN o_orderkey % 3 = 0 THEN 'rent' ELSE 'sale' END AS operation,
  CASE o_orderkey % 31 WHEN 7 THEN 'Barcelona' WHEN 8 THEN ' MADRID ' ELSE 'Madrid' END AS municipality,
  CASE o_orderkey % 23 WHEN 0 THEN 'penthouse' WHEN 1 THEN 'duplex' WHEN 2 THEN 'studio' WHEN 3 THEN 'chalet'
       WHEN 4 THEN 'homes' WHEN 5 THEN 'office' WHEN 6 THEN 'countryHouse' ELSE 'flat' END AS propertyType,
  CASE WHEN o_orderkey % 37 = 1 THEN NULL
       WHEN o_orderkey % 3 = 0 THEN CAST(500 + o_orderkey % 2500 AS DOUBLE)
       ELSE o_totalprice + 60000 END AS price,
  CASE o_orderkey % 41 WHEN 1 THEN NULL WHEN 2 THEN CAST(0 AS DOUBLE) WHEN 3 THEN CAST(368 AS DOUBLE)
       WHEN 4 THEN CAST(367 AS DOUBLE) WHEN 5 THEN CAST(-20 AS DOUBLE)
       ELSE CAST(60 + (o_orderkey * 37) % 481 AS DOUBLE) / 2 END AS size,
  CASE o_orderkey % 43 WHEN 1 THEN NULL WHEN 2 THEN CAST(-1 AS DOUBLE)
       ELSE CAST((o_orderkey * 5) % 7 AS DOUBLE) END AS rooms,
  CASE o_orderkey % 47 WHEN 1 THEN NULL WHEN 2 THEN CAST(-2 AS DOUBLE)
       ELSE CAST((o_orderkey * 3) % 5 AS DOUBLE) END AS bathrooms,
  CASE o_orderkey % 53 WHEN 1 THEN NULL WHEN 2 THEN CAST(91 AS DOUBLE) WHEN 3 THEN CAST(413851 AS DOUBLE) / 10000
       ELSE CAST(403801 + (o_orderkey * 7919) % 1087 AS DOUBLE) / 10000 END AS latitude,
  CASE WHEN o_orderkey % 53 = 3 THEN CAST(21734 AS DOUBLE) / 10000
       ELSE CAST((o_orderkey * 10473) % 1427 - 37728 AS DOUBLE) / 10000 END AS longitude,
  CASE o_orderkey % 11 WHEN 0 THEN 'bj' WHEN 1 THEN 'ss' WHEN 2 THEN '3' WHEN 3 THEN ' EN ' WHEN 4 THEN 'x'
       WHEN 5 THEN NULL WHEN 6 THEN '2.0' WHEN 7 THEN '12' WHEN 8 THEN '-1' WHEN 9 THEN 'st' ELSE '+1_0' END AS floor,
  CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS hasLift,
  CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS newDevelopment,
  CASE o_orderkey % 19 WHEN 1 THEN NULL WHEN 2 THEN '  '
       ELSE CONCAT({_phrase(f"o_orderkey % {len(PHRASES)}")}, ' ', COALESCE(text, ''), ' ',
                   {_phrase(f"(o_orderkey * 7 + 5) % {len(PHRASES)}")}) END AS description,
  CASE o_orderkey % 5 WHEN 0 THEN 'flat' WHEN 1 THEN 'chalet' ELSE NULL END AS detailedType_typology,
  CASE o_orderkey % 29 WHEN 1 THEN 'independantHouse' WHEN 2 THEN 'duplex' WHEN 3 THEN 'studio'
       WHEN 4 THEN 'terracedHouse' ELSE NULL END AS detailedType_subTypology,
  CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS parkingSpace_hasParkingSpace
FROM orders LEFT JOIN documents ON o_orderkey = doc_id
"""

# One described listing per document, with a phrase before and after its whole text.
DOCUMENTS_SQL = f"""
SELECT doc_id, CASE WHEN doc_id % 19 = 1 THEN NULL
  ELSE CONCAT({_phrase(f"doc_id % {len(PHRASES)}")}, ' ', text, ' ',
              {_phrase(f"(doc_id * 7 + 5) % {len(PHRASES)}")}) END AS description
FROM documents
"""

# A notched polygon with a hole per nation, on a 5 x 5 lattice of 2 km cells with gaps between.
AREA_ORIGIN = (435500, 4471000)
AREA_RING = [(20, 20), (1000, 400), (1980, 20), (1700, 1000), (1980, 1980), (1000, 1700), (20, 1980), (300, 1000)]
AREA_HOLE = [(700, 700), (1100, 700), (1100, 1100), (700, 1100)]
AREA_CODE_SQL = "CONCAT('0', CAST(n_regionkey + 1 AS STRING), CAST(10 + n_nationkey AS STRING))"

POIS_SQL = """
SELECT s_suppkey AS poi_no,
  CASE s_suppkey % 100 WHEN 0 THEN 'City_Center' ELSE CASE s_suppkey % 5 WHEN 1 THEN 'Castellana' ELSE 'Metro' END END AS tipo,
  CAST((s_suppkey * 577) % 1200 - 37600 AS DOUBLE) / 10000 AS Lon,
  CAST(403900 + (s_suppkey * 331) % 900 AS DOUBLE) / 10000 AS Lat
FROM supplier
"""
AREA_FEATURES_SQL = f"""
SELECT {AREA_CODE_SQL} AS barrio_code,
  CAST(8 + SUM(c_custkey) % 17 AS DOUBLE) AS alq_mediana_eur_m2_barrio,
  CAST(100 + COUNT(c_custkey) % 97 AS DOUBLE) AS delitos_per_10k_barrio,
  CASE WHEN n_nationkey = 7 THEN NULL ELSE CAST((n_nationkey * 7) % 20 AS DOUBLE) / 10 END AS indice_vulnerabilidad
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
GROUP BY n_nationkey, n_regionkey
"""
DISTRICT_INDEX_SQL = """
SELECT CONCAT('0', CAST(r_regionkey + 1 AS STRING)) AS distrito_code,
  CAST(110 + r_regionkey * 7 AS DOUBLE) / 100 AS indice_venta,
  CASE r_regionkey WHEN 2 THEN NULL ELSE CAST(31 + r_regionkey * 2 AS DOUBLE) / 10000 END AS factor_renta_mensual,
  2018 AS ano_base, 2026 AS ano_destino, 2026 AS ano_renta
FROM region WHERE r_regionkey <> 3
"""

# Small hand-written ensemble: (feature, threshold) of the root and both children, four leaves, default directions.
BASE_SCORE = 12.0
TREES = [
    (("CONSTRUCTEDAREA", 75.0), ("CONSTRUCTEDAREA", 45.0), ("CONSTRUCTEDAREA", 140.0), (-0.55, -0.2, 0.15, 0.6), (1, 1, 0)),
    (("alq_mediana_eur_m2_barrio", 14.5), ("indice_vulnerabilidad", 0.95), ("CONSTRUCTEDAREA", 95.0), (-0.1, -0.25, 0.2, 0.35), (1, 0, 1)),
    (("DISTANCE_TO_CITY_CENTER", 4.01), ("HASLIFT", 0.5), ("BATHNUMBER", 1.5), (0.1, 0.25, -0.2, -0.05), (1, 1, 1)),
    (("HASTERRACE", 0.5), ("FLOORCLEAN", 1.5), ("HASSWIMMINGPOOL", 0.5), (-0.06, 0.02, 0.08, 0.17), (1, 1, 1)),
    (("DISTANCE_TO_METRO", 0.613), ("ROOMNUMBER", 2.5), ("HASPARKINGSPACE", 0.5), (0.04, 0.07, -0.09, -0.02), (1, 1, 1)),
    (("HASAIRCONDITIONING", 0.5), ("ISSTUDIO", 0.5), ("HASWARDROBE", 0.5), (-0.03, 0.05, 0.03, 0.06), (1, 1, 1)),
    (("delitos_per_10k_barrio", 140.0), ("HASDOORMAN", 0.5), ("HASGARDEN", 0.5), (0.02, 0.09, -0.04, 0.03), (0, 1, 1)),
    (("DISTANCE_TO_CASTELLANA", 1.507), ("ISDUPLEX", 0.5), ("HASBOXROOM", 0.5), (0.08, 0.13, -0.07, -0.01), (1, 1, 1)),
    (("FLOORCLEAN", 0.5), ("HASLIFT", 0.5), ("CONSTRUCTEDAREA", 60.5), (-0.08, -0.03, 0.01, 0.05), (1, 1, 1)),
    (("BATHNUMBER", 2.5), ("indice_vulnerabilidad", 1.25), ("ROOMNUMBER", 4.5), (-0.02, -0.06, 0.11, 0.19), (1, 1, 1)),
]


def tree_rows() -> list[tuple]:
    """(tree, node, feature, threshold, left, right, default_left, leaf) of the small ensemble."""
    rows = []
    for tree, (root, low, high, leaves, default) in enumerate(TREES):
        splits = [(0, root, 1, 2), (1, low, 3, 4), (2, high, 5, 6)]
        rows += [(tree, n, f, t, left, right, bool(default[n]), None) for n, (f, t), left, right in splits]
        rows += [(tree, 3 + i, None, None, None, None, None, leaf) for i, leaf in enumerate(leaves)]
    return rows


META = Metadata(mediana_planta_train=2.0, area_max_dominio=240.0, smearing=1.0173,
                rangos_train={"CONSTRUCTEDAREA": (35.0, 230.0), "ROOMNUMBER": (0.0, 5.0), "BATHNUMBER": (0.0, 3.0),
                              "FLOORCLEAN": (-1.0, 11.0), "DISTANCE_TO_METRO": (0.0, 2.5)},
                nombre="conjunto-demo", model_id="pisoval-demo", model_version="1.0.0", arboles=len(TREES))
LARGE = {"orders": "o_orderkey", "documents": "doc_id"}
TABLES = ["region", "nation", "customer", "supplier", "orders", "documents"]


def _query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a shared statement over the Parquet tables it names."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t} " in sql.replace("\n", " ") + " "}
    large = [t for t in LARGE if t in named]
    if len(large) > 1:
        # Both sides are dealt by the key into as many parts, counted by rows: the join moves neither again, the number of tasks grows
        # with the rows, and how a file is cut into row groups doesn't matter.
        parts = max(tasks_for(named[t]) for t in large)
        named.update({t: named[t].repartition(parts, LARGE[t]) for t in large})
    else:
        named.update({t: spread(named[t], LARGE[t]) for t in large})
    for t in named:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql.replace("{{", "{").replace("}}", "}"), **named)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed listings, one per order."""
    return _query(spark, sf_dir, LISTINGS_SQL)


def described_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, description), one per document."""
    return _query(spark, sf_dir, DOCUMENTS_SQL)


def nested_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same listings with nested objects, as they arrive."""
    flat = listings(spark, sf_dir)
    top = [f for f in FIELDS if "." not in f]
    return flat.select(
        "batch_id", "row_id", *top,
        F.struct(*[F.col(column_name(f"detailedType.{i}")).alias(i) for i in ("typology", "subTypology")]).alias("detailedType"),
        F.struct(F.col("parkingSpace_hasParkingSpace").alias("hasParkingSpace")).alias("parkingSpace"))


# What goes wrong in the raw JSON of one order in seventy-one: (remainder, pattern, replacement).
RAW_FAULTS = [
    (5, r'"rooms":[^,]*', '"rooms":"3"'), (6, r'"rooms":[^,]*', '"rooms":2.5'),
    (7, r'"hasLift":[^,]*', '"hasLift":"false"'), (8, r'"bathrooms":[^,]*', '"bathrooms":' + "9" * 400),
    (9, r'"size":[^,]*', '"size":' + "1" + "0" * 400), (10, r'"operation":[^,]*,', ''),
    (11, r'"propertyCode":[^,]*', '"propertyCode":" \\t "'), (12, r'^\{', '{{'),
    (13, r'"detailedType":\{[^}]*\}', '"detailedType":5'),
    (14, r'"hasParkingSpace":[^}]*', '"hasParkingSpace":"yes"'), (15, r'"latitude":[^,]*', '"latitude":"40.4"'),
    (16, r'"price":[^,]*', '"price":0'), (17, r'^\{', '{"extra":[1,2],'),
    (18, r'"rooms":[^,]*', '"rooms":true'), (19, r'"floor":[^,]*', '"floor":"' + "1" * 21 + '"'),
    (20, r'"propertyCode":[^,]*', '"propertyCode":77'), (21, r'"municipality":[^,]*,', ''),
    (22, r'"parkingSpace":\{[^}]*\}', '"parkingSpace":null'), (23, r'"bathrooms":[^,]*', '"bathrooms":-1'),
    (24, r'"detailedType":\{[^}]*\}', '"detailedType":{"typology":7}'),
]
RAW_OTHERS = [(1, "123"), (2, "null"), (3, "[]"), (4, '"anuncio"')]


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, row_id, value): listings as JSON text, whole numbers as integers, some of them faulty."""
    nested = nested_listings(spark, sf_dir)
    whole = {c: F.col(c).cast("long") for c in ("rooms", "bathrooms")}
    listing = F.struct(*[whole.get(f, F.col(f)).alias(f) for f in FIELDS if "." not in f], "detailedType", "parkingSpace")
    # Within a lambda, which the engine evaluates apart: together with the join it is too long a method to be compiled.
    text = F.get(F.transform(F.array(listing), lambda x: F.to_json(x, {"ignoreNullFields": "false"})), F.lit(0))
    turn, value = (F.col("row_id") % 71).cast("int"), F.col("value")
    faults = F.create_map(*[F.lit(x) for n, pattern, replacement in RAW_FAULTS for x in (n, f"{pattern}\0{replacement.replace(chr(92), chr(92) * 2)}")])
    others = F.create_map(*[F.lit(x) for n, other in RAW_OTHERS for x in (n, other)])
    # Looked up, not spelled out case by case, for the same reason.
    parts = F.split(F.try_element_at(faults, turn), "\0")
    changed = F.get(F.transform(F.array(parts), lambda p: F.when(p.isNull(), value).otherwise(F.regexp_replace(value, F.get(p, F.lit(0)), F.get(p, F.lit(1))))), F.lit(0))
    return nested.select("batch_id", "row_id", text.alias("value")).withColumn("value", F.coalesce(F.try_element_at(others, turn), changed))


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, row_id, raw VARIANT)."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return raw_texts(spark, sf_dir).select("batch_id", "row_id", F.try_parse_json("value").alias("raw"))


def area_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in metres of one area per nation; the nation number moves a corner of the ring and the hole."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rings = []
    for ring_no, ring in enumerate((AREA_RING, AREA_HOLE)):
        for edge_no, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1])):
            rings.append(F.struct(F.lit(ring_no).alias("ring_no"), F.lit(edge_no).alias("edge_no"),
                                  *[F.lit(float(v)).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), a + b)]))
    x0 = AREA_ORIGIN[0] + F.col("n_nationkey") % 5 * 2000
    y0 = AREA_ORIGIN[1] + F.floor(F.col("n_nationkey") / 5) * 2000
    shift = F.when(F.col("e.ring_no") == 1, F.col("n_nationkey") * 37 % 11 * 5).otherwise(0)
    return nation.select("n_nationkey", F.expr(AREA_CODE_SQL).alias("area_code"), F.explode(F.array(*rings)).alias("e")).select(
        "area_code", "e.ring_no", "e.edge_no", *[(F.col(f"e.{k}") + base + shift).cast("double").alias(k)
                                                  for k, base in (("x1", x0), ("y1", y0), ("x2", x0), ("y2", y0))])


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, POIS_SQL)


def area_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, AREA_FEATURES_SQL)


def district_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, DISTRICT_INDEX_SQL)


def small_model(spark: SparkSession) -> TreeModel:
    return TreeModel(spark.createDataFrame(tree_rows(), NODE_SCHEMA), list(META.columnas), BASE_SCORE)


#: Trees of the large ensemble, the number that a full model has.
LARGE_TREES = 410
#: Splits of the small ensemble, which the large one draws on.
SPLITS = [split for root, low, high, _, _ in TREES for split in (root, low, high)]


def large_tree_rows() -> list[tuple]:
    """Nodes of the large ensemble: full trees of three to five levels, numbered level by level, all by arithmetic on tree and node."""
    rows = []
    for t in range(LARGE_TREES):
        inner = 2 ** (3 + t % 3) - 1
        for n in range(2 * inner + 1):
            if n < inner:
                feature, threshold = SPLITS[(7 * t + 11 * n) % len(SPLITS)]
                rows.append((t, n, feature, threshold, 2 * n + 1, 2 * n + 2, (t + n) % 3 > 0, None))
            else:
                rows.append((t, n, None, None, None, None, None, ((37 * t + 101 * n) % 199 - 99) / 16384))
    return rows


def large_model(spark: SparkSession) -> TreeModel:
    return TreeModel(spark.createDataFrame(large_tree_rows(), NODE_SCHEMA), list(META.columnas), BASE_SCORE)


def references(spark: SparkSession, sf_dir: str) -> References:
    """Everything a valuation needs, from the driver tables."""
    return References(area_edges(spark, sf_dir), pois(spark, sf_dir), area_features(spark, sf_dir),
                      district_index(spark, sf_dir), small_model(spark), META)
