"""The registered queries restated as DuckDB SQL over the driver tables."""
from __future__ import annotations

import unicodedata

from ..fixed_values import (ADMITTED_TYPES, AMENITY_RULES, AREA_FEATURES, DOMAIN_REASONS, EARTH_RADIUS_KM,
                            FIXED_WARNINGS, HOUSE_SUBTYPES, HOUSE_TYPES, MARK_WARNINGS, MODEL_FEATURES, MSG_CITY,
                            MSG_COORDINATES, MSG_DUPLICATE, MSG_FIELDS, MSG_KIND, MSG_NO_COMPARISON, MSG_NOT_FINITE,
                            MSG_OBJECT, MSG_OBSERVED, MSG_SIZE, NATIVE_COLUMNS, OCCUPIED_CANCELLED, REASONS,
                            TEXT_AMENITIES, WARNING_PARKING, WARNING_RANGE, WORKS_CANCELLED, WORKS_NEEDED)
from ..functions import geo
from ..operators.coverage import BASE_LISTING, EDGE_CASES
from ..plans.batch import stamp_values
from ..sources import driver_tables as d
from ..sources.listings import FIELDS, column_name
from ..sources.reference import Metadata

# Negative look-ahead is not available in this dialect, so these patterns are split in two positive ones.
CUES = r"sin|no tiene|no dispone de|no cuenta con|no incluye|carece de|no hay|ni|ausencia de|falta de"
REST = r"[^.,;:()!?\n•\-]"
OCCUPIED_PLAIN = (r"\b(?:ocupad[oa]|okupad[oa]|okupas?)\b|sin posesion|usufructo|renta antigua"
                  r"|\bcon inquilin[oa]s?\b|\binquilino actual|\b(?:actualmente|se encuentra|esta|vende) alquilad[oa]\b"
                  r"|\balquilad[oa] (?:actualmente|con contrato|hasta)\b|contrato de alquiler (?:en vigor|vigente)")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(column: str, values: list[str]) -> str:
    return f"coalesce({column} IN ({', '.join(map(q, values))}), false)"


_LETTERS = [chr(c) for c in range(0xA0, 0x180)
            if len(unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore")) == 1]
_PLAIN = "".join(unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in _LETTERS)


def norm(column: str) -> str:
    """Normalised text for the letters the driver texts hold."""
    folded = f"translate(coalesce({column}, ''), {q(''.join(_LETTERS))}, {q(_PLAIN)})"
    return (rf"regexp_replace(lower(regexp_replace({folded}, '[^\x00-\x7F]', '', 'g')), "
            r"'[\t-\r\x1c-\x20]+', ' ', 'g')")


def is_work(t: str) -> str:
    return f"(regexp_matches({t}, {q(WORKS_NEEDED)}) AND NOT regexp_matches({t}, {q(WORKS_CANCELLED)}))"


def is_occupied(t: str) -> str:
    bare = (f"len(regexp_extract_all({t}, 'nuda propiedad')) > "
            rf"len(regexp_extract_all({t}, 'nuda propiedad\s*-\s*valoracion'))")
    return (f"((regexp_matches({t}, {q(OCCUPIED_PLAIN)}) OR {bare}) "
            f"AND NOT regexp_matches({t}, {q(OCCUPIED_CANCELLED)}))")


# ---------------------------------------------------------------- text rules
def _negated(b: str) -> str:
    pattern = rf"^(?:.*)\b(?:{CUES})\s({REST}*)$"
    rest = f"regexp_extract({b}, {q(pattern)}, 1)"
    return (f"(regexp_matches({b}, {q(pattern)}) AND length({rest}) <= 20 "
            rf"AND NOT regexp_matches({rest}, '\b(?:con|y|e|pero|aunque|mas)\b'))")


def matches(texts: str, rules: list[tuple]) -> str:
    """Rows (id, feature, rule_no, i, motivo, fragmento) over a relation (id, t)."""
    parts = []
    for n, (feature, pattern, no_before, no_after, no_context, needs) in enumerate(rules):
        whens = [f"WHEN {_negated('b')} THEN 'negacion'"]
        for regex, where, name in ((no_before, "b", "no_antes"), (no_after, "a", "no_despues"),
                                   (no_context, "b || m || a", "no_contexto")):
            if regex:
                whens.append(f"WHEN regexp_matches({where}, {q(regex)}) THEN '{name}'")
        if needs:
            whens.append(f"WHEN NOT regexp_matches(b || m || a, {q(needs)}) THEN 'falta_contexto'")
        parts.append(f"""
SELECT id, {q(feature)} AS feature, {n} AS rule_no, i, CASE {' '.join(whens)} END AS motivo, b || m || a AS fragmento
FROM (SELECT id, i, m, substring(t, greatest(1, s - 44), least(45, s)) AS b, substring(t, s + length(m) + 1, 45) AS a
  FROM (SELECT id, t, i, marks[i] AS m,
          length(array_to_string(pieces[1:i], '')) + length(array_to_string(marks[1:i - 1], '')) AS s
    FROM (SELECT id, t, pieces, marks, unnest(range(1, len(marks) + 1)) AS i
      FROM (SELECT id, t, string_split_regex(t, {q(pattern)}) AS pieces, regexp_extract_all(t, {q(pattern)}) AS marks
            FROM {texts}))))""")
    return " UNION ALL ".join(parts)


def _flag(feature: str) -> str:
    return f"coalesce(bool_or(feature = {q(feature)} AND motivo IS NULL), false)"


def _negation_flag(feature: str) -> str:
    return f"(NOT {_flag(feature)} AND coalesce(bool_or(feature = {q(feature)} AND motivo = 'negacion'), false))"


FEATURES = list(dict.fromkeys(r[0] for r in AMENITY_RULES))
DOC_TEXTS = f"doc_texts AS (SELECT doc_id AS id, {norm('description')} AS t FROM ({d.DOCUMENTS_SQL}))"
DOC_MATCHES = f"WITH {DOC_TEXTS}, found AS ({matches('doc_texts', AMENITY_RULES)})"
# User rules over plain words, to exercise many matches per text and the context exclusion.
USER_RULES = [("WORD_THE", r"\bthe\b", r"\bof\s*$", r"^ (by|to)\b", r"\bwas\b", None),
              ("WORD_LE", r"\b(le|la|les)\b", None, None, None, r"\bque|\ben\b")]


def amenity_states() -> str:
    discards = ("coalesce(string_agg(motivo || ':' || fragmento, '|' ORDER BY rule_no, i) "
                "FILTER (WHERE motivo <> 'negacion'), '')")
    return f"""{DOC_MATCHES}
SELECT id AS doc_id, feature,
  CASE WHEN trim(any_value(t)) = '' THEN 'sin_descripcion' WHEN coalesce(bool_or(i IS NOT NULL AND motivo IS NULL), false) THEN 'mencionado'
       WHEN coalesce(bool_or(motivo = 'negacion'), false) THEN 'negado' ELSE 'sin_mencion' END AS estado,
  coalesce(bool_or(i IS NOT NULL AND motivo IS NULL), false) AND coalesce(bool_or(motivo = 'negacion'), false) AS conflicto,
  arg_min(fragmento, rule_no * 1000000 + i) FILTER (WHERE i IS NOT NULL AND motivo IS NULL) AS evidencia,
  arg_min(fragmento, rule_no * 1000000 + i) FILTER (WHERE motivo = 'negacion') AS negacion,
  {discards} AS descartes
FROM (SELECT id, t, feature FROM doc_texts, unnest([{', '.join(map(q, FEATURES))}]) AS u(feature))
LEFT JOIN found USING (id, feature) GROUP BY id, feature"""


def amenity_flags() -> str:
    cols = ", ".join(f"{_flag(f)} AS {f}, {_negation_flag(f)} AS {f}_negado" for f in FEATURES)
    return f"""{DOC_MATCHES}
SELECT id AS doc_id, {cols}, trim(any_value(t)) = '' AS sin_descripcion
FROM doc_texts LEFT JOIN found USING (id) GROUP BY id"""


# ---------------------------------------------------------------- geometry
def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(CASE WHEN {lat1} IS NOT NULL AND {lon1} IS NOT NULL THEN {2 * EARTH_RADIUS_KM} * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))) END)")


def projected(source: str) -> str:
    """Adds x, y in metres to a relation with latitude, longitude."""
    e, k = repr(geo.ECCENTRICITY), repr(geo.SCALE * geo.RECTIFYING)
    series = [(j, repr(a)) for j, a in enumerate(geo.FORWARD, start=1)]
    north = " + ".join(["xi"] + [f"{a} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in series])
    east = " + ".join(["eta"] + [f"{a} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in series])
    return f"""
SELECT * EXCLUDE (phi, lam, tt, xi, eta), {geo.FALSE_EASTING} + {k} * ({east}) AS x, {k} * ({north}) AS y
FROM (SELECT *, atan2(tt, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tt * tt + cos(lam) * cos(lam))) AS eta
  FROM (SELECT *, sinh(atanh(sin(phi)) - {e} * atanh({e} * sin(phi))) AS tt
    FROM (SELECT *, CASE WHEN abs(latitude) < 89.9 AND abs(longitude) <= 180 AND abs(longitude + 3) <= 80 THEN radians(latitude) END AS phi,
                 CASE WHEN abs(latitude) < 89.9 AND abs(longitude) <= 180 AND abs(longitude + 3) <= 80 THEN radians(longitude + 3) END AS lam
          FROM {source})))"""


def unprojected(source: str) -> str:
    """Adds latitude, longitude to a relation with x, y in metres."""
    e, k = repr(geo.ECCENTRICITY), repr(geo.SCALE * geo.RECTIFYING)
    series = [(j, repr(b)) for j, b in enumerate(geo.INVERSE, start=1)]
    u = " - ".join(["xi"] + [f"{b} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in series])
    v = " - ".join(["eta"] + [f"{b} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in series])
    steps = f"(SELECT *, asinh(sin(u) / sqrt(sinh(v) * sinh(v) + cos(u) * cos(u))) AS iso FROM (SELECT *, {u} AS u, {v} AS v FROM (SELECT *, y / {k} AS xi, (x - {geo.FALSE_EASTING}) / {k} AS eta FROM {source})))"
    steps = f"(SELECT *, tanh(iso) AS s0 FROM {steps})"
    for n in range(6):
        steps = f"(SELECT *, tanh(iso + {e} * atanh({e} * s{n})) AS s{n + 1} FROM {steps})"
    return f"SELECT *, degrees(asin(s6)) AS latitude, degrees(atan2(sinh(v), cos(u))) + {geo.CENTRAL_MERIDIAN} AS longitude FROM {steps}"


def coverage_sql() -> str:
    """CTE list ending in `valued`: a listing in the middle of every area and the edge cases, valued natively."""
    def value(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v) if isinstance(v, int) else q(v)
    flat = [f for f in FIELDS if "." not in f]
    base = {**{f: None for f in flat}, **{k: v for k, v in BASE_LISTING.items() if k in flat}}
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    own = {"propertyCode": "'barrio-' || i", "newDevelopment": "NULL", "size": "40 + i % 21 * 5", "latitude": "latitude", "longitude": "longitude"}

    def row(source: dict) -> str:
        return ", ".join(f"CAST({source[f]} AS {kinds[FIELDS[f]]}) AS {f}" for f in flat)
    rest = (f"CAST(NULL AS VARCHAR) AS detailedType_typology, CAST(NULL AS VARCHAR) AS detailedType_subTypology, "
            f"{value(BASE_LISTING['hasParkingSpace'])} AS parkingSpace_hasParkingSpace")
    cases = " UNION ALL ".join(f"SELECT {1_000_000_000 + n} AS row_id, {row({f: value({**base, **c, 'propertyCode': f'edge-{n}'}[f]) for f in flat})}, {rest}"
                               for n, c in enumerate(EDGE_CASES))
    spans = "(y1 > y) <> (y2 > y)"
    return f"""layer AS ({_edges()}),
halves AS (SELECT area_code, (min(least(y1, y2)) + max(greatest(y1, y2))) / 2 AS half FROM layer GROUP BY area_code),
lines AS (SELECT area_code, (max(CASE WHEN y1 <= half THEN y1 END) + min(CASE WHEN y1 > half THEN y1 END)) / 2 AS y FROM layer JOIN halves USING (area_code) GROUP BY area_code),
crossings AS (SELECT area_code, y, x1 + (y - y1) * (x2 - x1) / (y2 - y1) AS x FROM layer JOIN lines USING (area_code) WHERE {spans}),
stretches AS (SELECT *, row_number() OVER w AS n, lead(x) OVER w AS upto FROM crossings WINDOW w AS (PARTITION BY area_code ORDER BY x)),
middles AS (SELECT area_code, y, (x + upto) / 2 AS x FROM stretches WHERE n % 2 = 1 AND upto IS NOT NULL QUALIFY row_number() OVER (PARTITION BY area_code ORDER BY upto - x DESC, x) = 1),
placed AS ({unprojected('(SELECT *, row_number() OVER (ORDER BY area_code) - 1 AS i FROM middles)')}),
cover AS (SELECT CAST(i AS BIGINT) AS row_id, {row({**{f: value(base[f]) for f in flat}, **own})}, {rest} FROM placed UNION ALL {cases}),
{native('cover')}"""


def _edges() -> str:
    rows = []
    for ring_no, ring in enumerate((d.AREA_RING, d.AREA_HOLE)):
        for edge_no, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1])):
            rows.append(f"({ring_no}, {edge_no}, {a[0]}, {a[1]}, {b[0]}, {b[1]})")
    x0 = f"{d.AREA_ORIGIN[0]} + n_nationkey % 5 * 2000 + s"
    y0 = f"{d.AREA_ORIGIN[1]} + n_nationkey // 5 * 2000 + s"
    return f"""
SELECT {d.AREA_CODE_SQL} AS area_code, ring_no, edge_no, CAST(ax + {x0} AS DOUBLE) AS x1, CAST(ay + {y0} AS DOUBLE) AS y1,
  CAST(bx + {x0} AS DOUBLE) AS x2, CAST(by_ + {y0} AS DOUBLE) AS y2
FROM (SELECT *, CASE ring_no WHEN 1 THEN n_nationkey * 37 % 11 * 5 ELSE 0 END AS s
  FROM nation, (VALUES {', '.join(rows)}) AS v(ring_no, edge_no, ax, ay, bx, by_))"""


def _assigned(points: str) -> str:
    """(row_id, barrio_code, distrito_code, barrio_rescatado) for a relation (row_id, x, y)."""
    u = "least(1.0, greatest(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2))))"
    return f"""
SELECT row_id, coalesce(inside, best.code) AS barrio_code, substring(coalesce(inside, best.code), 1, 2) AS distrito_code,
  inside IS NULL AND best.code IS NOT NULL AS barrio_rescatado
FROM (SELECT row_id, min(area_code) FILTER (WHERE odd) AS inside,
        min({{'dist': dist, 'code': area_code}}) FILTER (WHERE dist <= 500) AS best
  FROM (SELECT p.row_id, area_code,
      coalesce(sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END), 0) % 2 = 1 AS odd,
      min(sqrt(pow(x - (x1 + {u} * (x2 - x1)), 2) + pow(y - (y1 + {u} * (y2 - y1)), 2))) AS dist
    FROM {points} p LEFT JOIN edges ON x IS NOT NULL GROUP BY p.row_id, area_code) GROUP BY row_id)"""


# ---------------------------------------------------------------- model
def score_case() -> str:
    """The small ensemble as nested CASE in single precision."""
    trees: dict[int, dict[int, tuple]] = {}
    for row in d.tree_rows():
        trees.setdefault(row[0], {})[row[1]] = row

    def walk(nodes: dict[int, tuple], at: int) -> str:
        _, _, feature, threshold, left, right, default_left, leaf = nodes[at]
        if feature is None:
            return f"CAST({leaf} AS FLOAT)"
        lo, hi = walk(nodes, left), walk(nodes, right)
        return (f"CASE WHEN {feature} IS NULL THEN {lo if default_left else hi} "
                f"WHEN CAST({feature} AS FLOAT) < CAST({threshold} AS FLOAT) THEN {lo} ELSE {hi} END")

    total = f"CAST({d.BASE_SCORE} AS FLOAT)"
    for tree in sorted(trees):
        total = f"({total} + {walk(trees[tree], 0)})"
    return total


def large_score_sql() -> str:
    """The large ensemble walked level by level, leaves added in tree order in single precision; follows the rows of `scored`."""
    columns = list(d.META.columnas)
    used = ", ".join(str(columns.index(f) + 1) for f, _ in d.SPLITS)
    limits = ", ".join(f"CAST({t} AS FLOAT)" for _, t in d.SPLITS)
    split = f"(7 * t + 11 * n) % {len(d.SPLITS)} + 1"
    value = f"xs[([{used}])[{split}]]"
    ctes = [f"level0 AS (SELECT row_id, xs, t, 0 AS n FROM (SELECT row_id, [{', '.join(f'CAST({c} AS FLOAT)' for c in columns)}] AS xs FROM scored WHERE valido), range({d.LARGE_TREES}) r(t))"]
    for k in range(5):
        left = f"CASE WHEN {value} IS NULL THEN (t + n) % 3 > 0 ELSE {value} < ([{limits}])[{split}] END"
        ctes.append(f"level{k + 1} AS (SELECT row_id, xs, t, CASE WHEN {k} >= 3 + t % 3 THEN n WHEN {left} THEN 2 * n + 1 ELSE 2 * n + 2 END AS n FROM level{k})")
    leaf = "CAST(((37 * t + 101 * n) % 199 - 99) / 16384 AS FLOAT)"
    return f"""{', '.join(ctes)}, sums AS (SELECT row_id, list_reduce(list_prepend(CAST({d.BASE_SCORE} AS FLOAT), list({leaf} ORDER BY t)), lambda a, b: a + b) AS total FROM level5 GROUP BY row_id)
SELECT row_id, round(CAST(total AS DOUBLE), 6) AS puntuacion FROM scored LEFT JOIN sums USING (row_id)"""


# ---------------------------------------------------------------- native valuation
def _kind(word: str) -> str:
    return f"CAST(coalesce(detailedType_subTypology, '') = '{word}' OR coalesce(propertyType, '') = '{word}' AS INTEGER)"


FLOOR = r"""CASE lower(trim(floor)) WHEN 'bj' THEN 0.0 WHEN 'en' THEN 0.0 WHEN 'ss' THEN -1.0 WHEN 'st' THEN -1.0
  ELSE CASE WHEN regexp_full_match(trim(floor), '[+-]?[0-9]+(_[0-9]+)*') THEN try_cast(replace(replace(trim(floor), '_', ''), '+', '') AS DOUBLE) END END"""
USABLE = "coalesce(abs(latitude) <= 90 AND abs(longitude) <= 180, false)"


def reasons_list() -> str:
    area = d.META.area_max_dominio
    conditions = {
        "operacion_no_admitida": f"NOT {_in('operation', ['sale', 'rent'])}",
        "sin_coordenadas": f"NOT {USABLE}",
        "fuera_de_madrid": f"barrio_code IS NULL AND {USABLE}",
        "sin_superficie": "CONSTRUCTEDAREA IS NULL OR CONSTRUCTEDAREA <= 0",
        "sin_habitaciones": "ROOMNUMBER IS NULL OR ROOMNUMBER < 0",
        "sin_banos": "BATHNUMBER IS NULL OR BATHNUMBER < 0",
        "tipologia_casa": f"{_in('propertyType', HOUSE_TYPES)} OR {_in('detailedType_subTypology', HOUSE_SUBTYPES)}",
        "superficie_fuera_de_dominio": f"coalesce(CONSTRUCTEDAREA > {area}, false)",
        "a_reformar": is_work("t"), "ocupada": is_occupied("t")}
    whens = ", ".join(f"CASE WHEN {conditions[r]} THEN '{r}' END" for r in REASONS)
    return f"list_filter([{whens}], lambda r: r IS NOT NULL)"


def range_names() -> str:
    whens = ", ".join(f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c}' END"
                      for c in d.META.columnas if c in d.META.rangos_train for lo, hi in [d.META.rangos_train[c]])
    return f"nullif(array_to_string(list_filter([{whens}], lambda r: r IS NOT NULL), ';'), '')"


def native(source: str = "listings") -> str:
    """CTE list ending in `valued`, from a CTE with the typed listing columns."""
    m = d.META
    flags = ", ".join(f"CAST({_flag(f)} AS INTEGER) AS {f}" for f in TEXT_AMENITIES)
    stats = ", ".join(AREA_FEATURES)
    keep = ", ".join(["l.row_id", *[f"l.{column_name(f)}" for f in FIELDS if f != "hasLift"]])
    return f"""
texts AS (SELECT row_id AS id, {norm('description')} AS t FROM {source}),
found AS ({matches('texts', AMENITY_RULES)}),
flags AS (SELECT id AS row_id, any_value(t) AS t, {flags}, CAST({_flag('HASLIFT')} AS INTEGER) AS text_lift
          FROM texts LEFT JOIN found USING (id) GROUP BY id),
edges AS ({_edges()}), pois AS ({d.POIS_SQL}), area_table AS ({d.AREA_FEATURES_SQL}), indices AS ({d.DISTRICT_INDEX_SQL}),
points AS ({projected(f'(SELECT row_id, latitude, longitude FROM {source})')}),
assigned AS ({_assigned('points')}),
center AS (SELECT Lat AS clat, Lon AS clon FROM pois WHERE tipo = 'City_Center' ORDER BY poi_no LIMIT 1),
distances AS (SELECT row_id, {haversine('latitude', 'longitude', 'any_value(clat)', 'any_value(clon)')} AS DISTANCE_TO_CITY_CENTER,
    min({haversine('latitude', 'longitude', 'Lat', 'Lon')}) FILTER (WHERE tipo = 'Metro') AS DISTANCE_TO_METRO,
    min({haversine('latitude', 'longitude', 'Lat', 'Lon')}) FILTER (WHERE tipo = 'Castellana') AS DISTANCE_TO_CASTELLANA
  FROM points, pois, center GROUP BY row_id, latitude, longitude),
featured AS (SELECT {keep}, t, size AS CONSTRUCTEDAREA, rooms AS ROOMNUMBER, bathrooms AS BATHNUMBER,
    {', '.join(TEXT_AMENITIES)}, coalesce(CAST(hasLift AS INTEGER), text_lift) AS HAS_LIFT_,
    CAST(coalesce(parkingSpace_hasParkingSpace, false) AS INTEGER) AS HASPARKINGSPACE,
    {_kind('duplex')} AS ISDUPLEX, {_kind('studio')} AS ISSTUDIO,
    coalesce({FLOOR}, {m.mediana_planta_train}) AS FLOORCLEAN, ({FLOOR}) IS NULL AS planta_imputada,
    hasLift IS NULL AS ascensor_desde_descripcion, trim(t) = '' AS sin_descripcion,
    coalesce(newDevelopment, false) AS obra_nueva, DISTANCE_TO_CITY_CENTER, DISTANCE_TO_METRO, DISTANCE_TO_CASTELLANA,
    barrio_code, distrito_code, barrio_rescatado, {stats}
  FROM {source} l JOIN flags USING (row_id) JOIN distances USING (row_id) JOIN assigned USING (row_id)
  LEFT JOIN area_table USING (barrio_code)),
lifted AS (SELECT * EXCLUDE (HAS_LIFT_), HAS_LIFT_ AS HASLIFT FROM featured),
reasoned AS (SELECT *, {reasons_list()} AS motivos, {range_names()} AS fuera_de_rango FROM lifted),
scored AS (SELECT *, len(motivos) = 0 AS valido, CASE WHEN len(motivos) = 0 THEN {score_case()} END AS score FROM reasoned),
priced AS (SELECT *, CAST(CAST(exp(CAST(score AS DOUBLE)) AS FLOAT) * CAST({m.smearing} AS FLOAT) AS DOUBLE) AS precio_estimado_base
  FROM scored),
indexed AS (SELECT p.*, CASE WHEN valido THEN indice_venta END AS indice_venta,
    precio_estimado_base * indice_venta AS precio_estimado,
    CASE WHEN valido THEN factor_renta_mensual END AS factor_renta_mensual,
    precio_estimado_base * indice_venta * factor_renta_mensual AS renta_mensual_estimada
  FROM priced p LEFT JOIN indices USING (distrito_code)),
valued AS (SELECT *, price AS precio_anunciado, CASE WHEN NOT valido THEN array_to_string(motivos, ';') END AS motivo_no_valido,
    price / CASE WHEN operation = 'sale' THEN precio_estimado ELSE renta_mensual_estimada END AS anunciado_sobre_estimado,
    {m.ano_base} AS ano_base, {m.ano_precio} AS ano_precio, {m.ano_renta} AS ano_renta, {q(m.nombre)} AS modelo
  FROM indexed)"""


LISTINGS = f"listings AS ({d.LISTINGS_SQL})"
NATIVE = f"WITH {LISTINGS}, {native()}"
# Distances come from library sines; everything else is the same arithmetic in both engines.
DOUBLES = {"DISTANCE_TO_CITY_CENTER", "DISTANCE_TO_METRO", "DISTANCE_TO_CASTELLANA"}


def rounded(columns: list[str], prefix: str = "") -> str:
    return ", ".join(f"round({c}, 6) AS {prefix}{c}" if c in DOUBLES else f"{c} AS {prefix}{c}" for c in columns)


# ---------------------------------------------------------------- contract
def raw_sql() -> str:
    whole = {"rooms", "bathrooms"}
    top = ", ".join(f"{f}: CAST({f} AS BIGINT)" if f in whole else f"{f}: {f}" for f in FIELDS if "." not in f)
    js = (f"CAST(to_json({{{top}, detailedType: {{typology: detailedType_typology, subTypology: detailedType_subTypology}}, "
          "parkingSpace: {hasParkingSpace: parkingSpace_hasParkingSpace}}) AS VARCHAR)")
    whens = "".join(f" WHEN {n} THEN {q(o)}" for n, o in d.RAW_OTHERS)
    whens += "".join(f" WHEN {n} THEN regexp_replace(js, {q(p)}, {q(r.replace(chr(92), chr(92) * 2))})" for n, p, r in d.RAW_FAULTS)
    return (f"raw_js AS (SELECT batch_id, row_id, {js} AS js FROM listings), "
            f"raw_texts AS (SELECT batch_id, row_id, CASE row_id % 71{whens} ELSE js END AS value FROM raw_js), "
            "raw AS (SELECT batch_id, row_id, CASE WHEN json_valid(value) AND json_type(value) = 'OBJECT' THEN CAST(value AS JSON) END AS j FROM raw_texts)")


def _absent(f: str) -> str:
    return f"coalesce(json_type(j, '$.{f}'), 'NULL') = 'NULL'"


def _text(f: str, limit: int, extra: str = "") -> str:
    return f"(json_type(j, '$.{f}') = 'VARCHAR' AND length(json_extract_string(j, '$.{f}')) <= {limit}{extra})"


def _number(f: str, extra: str = "") -> str:
    return (f"(json_type(j, '$.{f}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND length(json_extract_string(j, '$.{f}')) < 300{extra})")


def _whole(f: str) -> str:
    return (f"(json_type(j, '$.{f}') IN ('UBIGINT', 'BIGINT') "
            f"AND coalesce(try_cast(json_extract_string(j, '$.{f}') AS BIGINT) BETWEEN 0 AND 2147483647, false))")


def bad_fields_sql() -> str:
    def flag(f):
        return f"(json_type(j, '$.{f}') = 'BOOLEAN')"

    def inner(f, test):
        return f"({_absent(f)} OR {test})"

    fine = {
        "bathrooms": _whole("bathrooms"), "rooms": _whole("rooms"), "description": _text("description", 12000),
        "detailedType": (f"(json_type(j, '$.detailedType') = 'OBJECT' AND {inner('detailedType.typology', _text('detailedType.typology', 80))} "
                         f"AND {inner('detailedType.subTypology', _text('detailedType.subTypology', 80))})"),
        "floor": _text("floor", 20), "hasLift": flag("hasLift"), "newDevelopment": flag("newDevelopment"),
        "latitude": _number("latitude"), "longitude": _number("longitude"), "size": _number("size"),
        "price": _number("price", " AND try_cast(json_extract_string(j, '$.price') AS DOUBLE) > 0"),
        "municipality": _text("municipality", 120), "propertyType": _text("propertyType", 80),
        "operation": "(json_type(j, '$.operation') = 'VARCHAR' AND json_extract_string(j, '$.operation') IN ('sale', 'rent'))",
        "parkingSpace": f"(json_type(j, '$.parkingSpace') = 'OBJECT' AND {inner('parkingSpace.hasParkingSpace', flag('parkingSpace.hasParkingSpace'))})",
        "propertyCode": _text("propertyCode", 80, r" AND regexp_matches(json_extract_string(j, '$.propertyCode'), '\S')")}
    required = {"propertyCode", "operation", "municipality", "propertyType"}
    whens = ", ".join(f"CASE WHEN NOT coalesce({fine[f] if f in required else f'({_absent(f)} OR {fine[f]})'}, false) THEN '{f}' END"
                      for f in sorted(fine))
    return f"list_filter([{whens}], lambda r: r IS NOT NULL)"


def validated() -> str:
    """CTE list ending in `checked` (batch_id, row_id, codigo, estado, detalle, typed fields)."""
    kinds = {"string": ("VARCHAR", "json_extract_string(j, '$.{f}')"), "boolean": ("BOOLEAN", "CAST(json_extract_string(j, '$.{f}') AS BOOLEAN)"),
             "double": (None, "try_cast(json_extract_string(j, '$.{f}') AS DOUBLE)")}
    typed = ", ".join(
        (f"CASE WHEN json_type(j, '$.{f}') = '{kinds[k][0]}' THEN {kinds[k][1].format(f=f)} END" if kinds[k][0]
         else f"CASE WHEN json_type(j, '$.{f}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN {kinds[k][1].format(f=f)} END") + f" AS {column_name(f)}"
        for f, k in FIELDS.items())
    kind_ok = f"({_in('propertyType', ADMITTED_TYPES)} OR (propertyType = 'homes' AND coalesce(detailedType_typology = 'flat', false)))"
    steps = [("j IS NULL", "datos_insuficientes", q(MSG_OBJECT)),
             ("len(bad) > 0", "datos_insuficientes", f"{q(MSG_FIELDS)} || array_to_string(bad, ', ')"),
             ("lower(trim(municipality)) <> 'madrid'", "fuera_ambito", q(MSG_CITY)),
             (f"NOT {kind_ok} OR {_in('detailedType_subTypology', HOUSE_SUBTYPES)}", "fuera_ambito", q(MSG_KIND)),
             ("size > 367", "fuera_ambito", q(MSG_SIZE)),
             ("NOT coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false)", "datos_insuficientes", q(MSG_COORDINATES)),
             ("NOT coalesce(size > 0 AND rooms >= 0 AND bathrooms >= 0, false)", "datos_insuficientes", q(MSG_OBSERVED))]
    estado = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in steps) + " END"
    detalle = "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, _, t in steps) + " END"
    return f"""{LISTINGS}, {raw_sql()},
typed AS (SELECT batch_id, row_id, j, {typed}, {bad_fields_sql()} AS bad FROM raw),
checked AS (SELECT *, propertyCode AS codigo, {estado} AS estado, {detalle} AS detalle FROM typed)"""


def batch() -> str:
    """CTE list ending in `outcome`."""
    fields = ", ".join(f"CASE WHEN estado IS NULL THEN {column_name(f)} END AS {column_name(f)}" for f in FIELDS)
    domain = ", ".join(map(q, DOMAIN_REASONS))
    good = "coalesce(isfinite(precio_estimado) AND precio_estimado > 0, false)"
    compared = "CASE WHEN v.operation = 'rent' THEN renta_mensual_estimada ELSE precio_estimado END"
    failed = f"NOT valido OR NOT {good}"
    unavailable = "NOT coalesce(isfinite(precio_comparacion) AND precio_comparacion > 0, false)"
    return f"""{validated()},
copies AS (SELECT batch_id, codigo, count(*) AS copias FROM checked WHERE codigo IS NOT NULL GROUP BY ALL),
judged AS (SELECT c.* EXCLUDE (estado, detalle), CASE WHEN estado IS NULL AND copias > 1 THEN 'datos_insuficientes' ELSE estado END AS estado,
    CASE WHEN estado IS NULL AND copias > 1 THEN {q(MSG_DUPLICATE)} ELSE detalle END AS detalle
  FROM checked c LEFT JOIN copies USING (batch_id, codigo)),
hollow AS (SELECT row_id, {fields} FROM judged),
{native('hollow')},
compared AS (SELECT v.*, {compared} AS precio_comparacion FROM valued v),
outcome AS (SELECT v.*, j.batch_id, j.codigo,
    CASE WHEN j.estado IS NOT NULL THEN j.estado
         WHEN {failed} THEN CASE WHEN list_has_any(motivos, [{domain}]) THEN 'fuera_ambito' ELSE 'datos_insuficientes' END
         WHEN {unavailable} THEN 'no_disponible' END AS estado,
    CASE WHEN j.estado IS NOT NULL THEN j.detalle
         WHEN {failed} THEN coalesce(motivo_no_valido, {q(MSG_NOT_FINITE)})
         WHEN {unavailable} THEN {q(MSG_NO_COMPARISON)} END AS detalle
  FROM compared v JOIN judged j USING (row_id))"""


def warnings_sql() -> str:
    marks = ", ".join(f"CASE WHEN {k} THEN {q(v)} END" for k, v in MARK_WARNINGS.items())
    return (f"array_to_string(list_filter([{', '.join(map(q, FIXED_WARNINGS))}, {marks}, "
            f"CASE WHEN fuera_de_rango IS NOT NULL THEN {q(WARNING_RANGE)} || fuera_de_rango END, "
            f"CASE WHEN parkingSpace_hasParkingSpace IS NULL THEN {q(WARNING_PARKING)} END], lambda w: w IS NOT NULL), ' | ')")


def literal(v: object) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else q(v)


def results_sql(meta: Metadata = d.META) -> str:
    """Whole responses; warnings are joined and marks stand beside the rest."""
    fixed = ", ".join(f"{literal(v)} AS {k}" for k, v in stamp_values(meta).items())
    return f"""WITH {batch()}
SELECT batch_id, row_id, codigo AS propertyCode, 'ok' AS estado, {fixed}, CAST(NULL AS VARCHAR) AS intervalo, CAST(NULL AS VARCHAR) AS banda,
  false AS oportunidad, false AS sobrevalorado, false AS alquiler_validado, {q(f'ratio_distrital_proyectado_{meta.ano_renta}')} AS metodo_renta,
  {warnings_sql()} AS advertencias, indice_venta AS factor_escenario, precio_estimado_base AS precio_estimado_base,
  precio_estimado AS precio_estimado, precio_anunciado AS precio_anunciado, operation,
  precio_comparacion AS precio_comparacion, CASE WHEN operation = 'rent' THEN 'EUR/mes' ELSE 'EUR' END AS unidad_comparacion,
  (precio_anunciado / precio_comparacion - 1) * 100 AS brecha_pct, barrio_code, distrito_code,
  renta_mensual_estimada AS renta_mensual_estimada, factor_renta_mensual AS factor_renta_mensual,
  barrio_rescatado, planta_imputada, ascensor_desde_descripcion, sin_descripcion, obra_nueva, fuera_de_rango
FROM outcome WHERE estado IS NULL"""
