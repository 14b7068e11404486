"""Values the valuation results depend on, stated as plain text.

Everything in this module is a fixed value of the listing domain: names, codes,
limits, messages and regular expressions.  No logic lives here.
"""

# --- Fixed values: geometry and units -------------------------------------
EARTH_RADIUS_KM = 6371.0088
RESCUE_METRES = 500.0

# --- Fixed values: listing codes -------------------------------------------
OPERATIONS = ["sale", "rent"]
FLOOR_CODES = {"bj": 0, "en": 0, "ss": -1, "st": -1}
HOUSE_TYPES = ["chalet", "countryHouse"]
HOUSE_SUBTYPES = ["independantHouse", "semidetachedHouse", "terracedHouse"]
ADMITTED_TYPES = ["flat", "penthouse", "duplex", "studio"]
SUPPORTED_CITY = "madrid"
CONTRACT_MAX_SIZE = 367
MAX_INT = 2**31 - 1

# --- Fixed values: guaranteed input columns --------------------------------
EXPECTED_COLUMNS = ["propertyCode", "operation", "propertyType", "price", "size", "rooms", "bathrooms",
                    "latitude", "longitude", "detailedType.subTypology"]

# --- Fixed values: string length limits of the contract --------------------
MAX_LENGTHS = {"propertyCode": 80, "municipality": 120, "propertyType": 80, "floor": 20, "description": 12000}
MAX_SUBTYPE_LENGTH = 80

# --- Fixed values: output columns -------------------------------------------
NATIVE_COLUMNS = ["propertyCode", "propertyType", "valido", "motivo_no_valido", "barrio_code", "distrito_code",
                  "precio_anunciado", "precio_estimado_base", "indice_venta", "precio_estimado",
                  "factor_renta_mensual", "renta_mensual_estimada", "anunciado_sobre_estimado", "fuera_de_rango",
                  "barrio_rescatado", "planta_imputada", "ascensor_desde_descripcion", "sin_descripcion",
                  "obra_nueva", "ano_base", "ano_precio", "ano_renta", "modelo"]
AREA_FEATURES = ["alq_mediana_eur_m2_barrio", "delitos_per_10k_barrio", "indice_vulnerabilidad"]
TEXT_AMENITIES = ["HASTERRACE", "HASAIRCONDITIONING", "HASBOXROOM", "HASWARDROBE",
                  "HASSWIMMINGPOOL", "HASDOORMAN", "HASGARDEN"]
MODEL_FEATURES = (["CONSTRUCTEDAREA", "ROOMNUMBER", "BATHNUMBER"] + TEXT_AMENITIES
                  + ["HASLIFT", "HASPARKINGSPACE", "ISDUPLEX", "ISSTUDIO", "FLOORCLEAN",
                     "DISTANCE_TO_CITY_CENTER", "DISTANCE_TO_METRO", "DISTANCE_TO_CASTELLANA"]
                  + AREA_FEATURES)
POI_CENTER, POI_METRO, POI_AVENUE = "City_Center", "Metro", "Castellana"

# --- Fixed values: reasons for not valuing, in reporting order --------------
REASONS = ["operacion_no_admitida", "sin_coordenadas", "fuera_de_madrid", "sin_superficie", "sin_habitaciones",
           "sin_banos", "tipologia_casa", "superficie_fuera_de_dominio", "a_reformar", "ocupada"]
DOMAIN_REASONS = ["fuera_de_madrid", "tipologia_casa", "superficie_fuera_de_dominio", "a_reformar", "ocupada",
                  "operacion_no_admitida"]

# --- Fixed values: states and messages ---------------------------------------
STATE_DATA, STATE_SCOPE, STATE_UNAVAILABLE = "datos_insuficientes", "fuera_ambito", "no_disponible"
MSG_OBJECT = "Cada anuncio debe ser un objeto JSON."
MSG_FIELDS = "Revisa los campos requeridos y sus tipos: "
MSG_CITY = "El modelo admite viviendas de compra o alquiler en Madrid capital."
MSG_KIND = "Tipología no admitida: el modelo no valora casas, oficinas ni parcelas."
MSG_SIZE = "Superficie superior al límite de 367 m² del modelo."
MSG_COORDINATES = "Se requieren coordenadas finitas y válidas del anuncio."
MSG_OBSERVED = "Se requieren superficie positiva, habitaciones y baños observados."
MSG_DUPLICATE = "propertyCode duplicado en el lote."
MSG_NOT_FINITE = "No se pudo obtener una estimación finita."
MSG_NO_COMPARISON = "No se pudo obtener una referencia válida para esta operación."
FIXED_WARNINGS = [
    "Estimación de precio anunciado con datos de 2018 e índices proyectados a 2026. Precisión actual no validada.",
    "El paquete no incluye intervalos calibrados ni clasificación validada de barato o caro.",
    "No observa estado de conservación, condición de ático, vistas ni parcela.",
    "La renta es un escenario derivado del precio de venta y ratios distritales proyectados a 2026; no un modelo de alquiler validado.",
    "Los últimos datos observados de los índices corresponden a venta de 2025 y alquiler de 2024; 2026 se proyecta por tendencia.",
]
MARK_WARNINGS = {
    "sin_descripcion": "Sin descripción: los atributos extraídos del texto se tratan como ausentes.",
    "planta_imputada": "Planta desconocida: imputada con la mediana del entrenamiento (2).",
    "ascensor_desde_descripcion": "Ascensor inferido de la descripción al faltar el campo estructurado.",
    "barrio_rescatado": "Barrio asignado por cercanía, hasta 500 m del polígono disponible.",
    "obra_nueva": "Obra nueva: varias viviendas de una promoción comparten errores; cuenta la promoción una vez en agregados.",
}
WARNING_RANGE = "Valores fuera del rango de entrenamiento: "
WARNING_PARKING = "Garaje no informado: el predictor lo trata como ausente."
WARNING_EXPLAIN = "Este paquete no exporta explicaciones SHAP por anuncio."

# --- Fixed values: text patterns over normalised descriptions ----------------
TEXT_WINDOW = 45
NEGATION = (r"\b(sin|no tiene|no dispone de|no cuenta con|no incluye|carece de|no hay|ni|ausencia de|falta de)\s"
            r"(?:(?!\b(?:con|y|e|pero|aunque|mas)\b)[^.,;:()!?\n•\-]){0,20}$")
WORKS_NEEDED = (r"\b(?:a|para) (?:reformar|actualizar)\b"
                r"|\b(?:necesita|precisa|requiere) (?:de )?(?:una |un poco de |algo de )?(?:reforma|actualizacion)\b")
WORKS_CANCELLED = (r"sin necesidad de (?:reforma|reformar|obras|actualizar)"
                   r"|no (?:necesita|precisa|requiere) (?:de )?(?:ninguna |una )?(?:reforma|obras|actualizacion)")
OCCUPIED = (r"\b(?:ocupad[oa]|okupad[oa]|okupas?)\b|sin posesion|nuda propiedad(?!\s*-\s*valoracion)|usufructo|renta antigua"
            r"|\bcon inquilin[oa]s?\b|\binquilino actual|\b(?:actualmente|se encuentra|esta|vende) alquilad[oa]\b"
            r"|\balquilad[oa] (?:actualmente|con contrato|hasta)\b|contrato de alquiler (?:en vigor|vigente)")
# The same, taken apart: a word and, unless the word says all, the pattern for texts that hold it.
OCCUPIED_PARTS = [
    ("ocupad", r"\bocupad[oa]\b"), ("okupa", r"\b(?:okupad[oa]|okupas?)\b"), ("sin posesion", None),
    ("nuda propiedad", r"nuda propiedad(?!\s*-\s*valoracion)"), ("usufructo", None), ("renta antigua", None),
    ("inquilin", r"\bcon inquilin[oa]s?\b|\binquilino actual"),
    ("alquil", r"(?=[aesv])\b(?:actualmente|se encuentra|esta|vende) alquilad[oa]\b"
               r"|\balquilad[oa] (?:actualmente|con contrato|hasta)\b|contrato de alquiler (?:en vigor|vigente)"),
]
OCCUPIED_CANCELLED = r"libre de (?:inquilin|ocupant|cargas y ocupant)|sin inquilin|desocupad"
OPTIONAL_BEFORE = (r"(posibilidad|opcion) de( adquirir| comprar| anadir| alquilar)?( una| un)?( plaza de)?\s*$"
                   r"|opcional( plaza de)?\s*$")
OPTIONAL_AFTER = r"^[\s,:]*(\(?opcional|no incluid|aparte|por separado|a elegir|con coste)"
# feature, pattern, not before, not after, not in context, needed in context
AMENITY_RULES = [
    ("HASTERRACE", r"\bterraza(s)?\b",
     r"(bares|restaurantes|restauracion|hosteleria|oferta de|comercios)[^.]{0,30}$",
     r"^[\s,]*(comunitari|de (los )?bares|y restaurantes|de ocio)", None, None),
    ("HASAIRCONDITIONING",
     r"aire acondicionado|\bclimatizacion\b|\bclimatizad[oa]s?\b|bomba de calor|\bsplits?\b|\ba/a\b",
     r"pre-? ?instalacion( de)?\s*$|preinstalad[oa]s?( de| para)?\s*$", None, None, None),
    ("HASBOXROOM", r"\btrastero(s)?\b", OPTIONAL_BEFORE, OPTIONAL_AFTER, None, None),
    ("HASWARDROBE", r"\barmario(s)?\b[^.;:]{0,25}\bempotrad|\bempotrados?\b[^.;:]{0,15}\barmario(s)?\b",
     None, None, None, None),
    ("HASSWIMMINGPOOL", r"\bpiscinas?\b",
     r"(cerca|proxim\w*|junto|al lado|a pocos (metros|minutos))( de| a| del| al)?( la| las| una)?\s*$",
     r"^\s*(municipal|publica|climatizada municipal)", None, None),
    ("HASDOORMAN", r"\bporter[oa]s?\b|\bporteria\b|\bconserjes?\b|\bconserjeria\b",
     r"antigua\s*$", r"^\s*(automatico|electronico)", None, None),
    ("HASGARDEN", r"\bjardin(es)?\b",
     r"(real|ciudad|orientad[oa]s?( a| hacia)( el| un| los)?|vistas?( a| al| hacia)( el| un| los)?|rodead[oa]s? de|parques y)\s*$",
     r"^\s*(botanico|de (sabatini|la villa|el capricho))", None, None),
    ("HASGARDEN", r"\bajardinad[oa]s?\b",
     r"vistas?( a| al| hacia)( las| los| unas)?( zonas?| espacios?)?\s*$",
     None, None, r"urbanizacion|comunitari|zonas? comunes|piscina"),
    ("HASLIFT", r"\bascensor(es)?\b",
     r"(instalacion|instalar|proyecto|poner|colocar|futuro|previsto)[^.]{0,35}$", None, None, None),
    ("HASPARKINGSPACE",
     r"\bgarajes?\b|\bparking\b|plazas? de aparcamiento|aparcamiento (privado|propio|incluido)",
     OPTIONAL_BEFORE + r"|(facil|zona de)\s*$", OPTIONAL_AFTER + r"|^\s*publico", None, None),
]
# Every match of a rule starts with one of these letters and holds one of these words.
AMENITY_HINTS = [
    ("t", ("terraza",)),
    ("acbs", ("aire acondicionado", "climatiza", "bomba de calor", "split", "a/a")),
    ("t", ("trastero",)),
    ("ae", ("empotrad",)),
    ("p", ("piscina",)),
    ("pc", ("porter", "conserje")),
    ("j", ("jardin",)),
    ("a", ("ajardinad",)),
    ("a", ("ascensor",)),
    ("gpa", ("garaje", "parking", "aparcamiento")),
]
# What the rules say before and after a match, bounded so that it can be asked for where the match stands, in texts with single spaces; odd
# texts, for which the bounds, or an end of a window, could tell otherwise; whether no match can begin within another one. None where a match
# needs something near it.
_OPTIONAL_BEFORE = (r"(?:posibilidad|opcion) de(?: adquirir| comprar| anadir| alquilar)?(?: una| un)?(?: plaza de)? ?"
                    r"|opcional(?: plaza de)? ?")
_OPTIONAL_AFTER = r"[ ,:]{0,20}(?:\(?opcional|no incluid|aparte|por separado|a elegir|con coste)"
AMENITY_DOUBTS = [
    (r"(?:bares|restaurantes|restauracion|hosteleria|oferta de|comercios)[^.]{0,30}",
     r"[ ,]{0,20}(?:comunitari|de (?:los )?bares|y restaurantes|de ocio)", r"[ ,]{21}", True),
    (r"pre-? ?instalacion(?: de)? ?|preinstalad[oa]s?(?: de| para)? ?", None, r"\w(?:aire acondicionado|bomba de calor)|a/a/a", True),
    (_OPTIONAL_BEFORE, _OPTIONAL_AFTER, r"[ ,:]{21}", True),
    (None, None, None, False),
    (r"(?:cerca|proxim\w{0,20}|junto|al lado|a pocos (?:metros|minutos))(?: de| a| del| al)?(?: la| las| una)? ?",
     r" ?(?:municipal|publica|climatizada municipal)", r"proxim\w{21}", True),
    (r"antigua ?", r" ?(?:automatico|electronico)", None, True),
    (r"(?:real|ciudad|orientad[oa]s?(?: a| hacia)(?: el| un| los)?|vistas?(?: a| al| hacia)(?: el| un| los)?|rodead[oa]s? de|parques y) ?",
     r" ?(?:botanico|de (?:sabatini|la villa|el capricho))", None, True),
    None,
    (r"instalacion[^.]{0,34}|(?:instalar|proyecto|poner|colocar|futuro|previsto)[^.]{0,35}", None, None, True),
    (_OPTIONAL_BEFORE + r"|(?:facil|zona de) ?", _OPTIONAL_AFTER + r"| ?publico", r"[ ,:]{21}|\w(?:plaza|aparcamiento)", False),
]
WORKS_WORDS = ("reforma", "actualiza")
OCCUPIED_WORDS = tuple(word for word, _ in OCCUPIED_PARTS)
