"""Normalisation, windows and rules against plain-Python restatements."""
import random
import re
import unicodedata

from pyspark.sql import functions as F

from pisoval.fixed_values import AMENITY_HINTS, AMENITY_RULES, OCCUPIED, OCCUPIED_WORDS, WORKS_NEEDED, WORKS_WORDS
from pisoval.functions.amenities import (DEFAULT_RULES, amenity_flags, amenity_matches, extract_amenities, is_mentioned,
                                         rule_book, rule_book_from_table)
from pisoval.functions.text import Windows, normalize_text
from pisoval.plans.domain import needs_work, occupied


def folded(text):
    ascii_text = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"\s+", " ", ascii_text)


def one(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("out")).collect()
    return [r["out"] for r in sorted(rows, key=lambda r: r["i"])]


def test_normalize_matches_decomposition(spark):
    rnd = random.Random(7)
    pool = [chr(c) for c in range(1, 0x2FFF) if not 0xD800 <= c < 0xE000] + list("ﬁ½¼™㎏…𝐀𝟗 \t\n\x1c\x0b\xa0aAé\x00" * 30)
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + [None, "", "Ático  2ª"]
    assert one(spark, texts, normalize_text(F.col("t"))) == [folded(t) for t in texts]


def test_windows_equal_finditer(spark):
    rnd = random.Random(3)
    words = ["terraza", "terrazas", "sin", "con", ".", ",", "xterraza", "a" * 50, "armario bien empotrado", "ni"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(500)]
    for pattern in (r"\bterraza(s)?\b", AMENITY_RULES[3][1], r"a+|\bni\b"):
        w = Windows(F.col("t"), pattern)
        got = one(spark, texts, F.struct(w.before, w.match, w.after))
        for text, row in zip(texts, got):
            found = list(re.finditer(pattern, text))
            assert list(row[1]) == [m.group() for m in found]
            assert list(row[0]) == [text[max(0, m.start() - 45):m.start()] for m in found]
            assert list(row[2]) == [text[m.end():m.end() + 45] for m in found]


def test_hints_never_exclude_a_match():
    rnd = random.Random(11)
    vocabulary = ("terraza terrazas aire acondicionado climatizacion climatizado climatizadas bomba de calor split splits a/a "
                  "trastero trasteros armario armarios empotrado empotrados piscina piscinas portero porteras porteria conserje "
                  "conserjeria jardin jardines ajardinada ajardinados ascensor ascensores garaje garajes parking plaza plazas de "
                  "aparcamiento privado propio a para reformar actualizar necesita una reforma actualizacion ocupado okupas sin "
                  "posesion nuda propiedad usufructo renta antigua con inquilinos inquilino actual actualmente alquilado esta "
                  "contrato alquiler en vigor vigente hasta").split()
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(12)) for _ in range(4000)]
    for (_, pattern, *_), (starts, words) in zip(AMENITY_RULES, AMENITY_HINTS):
        seen = 0
        for text in texts:
            for m in re.finditer(pattern, text):
                seen += 1
                assert m.group()[0] in starts and any(w in m.group() for w in words)
        assert seen
    for pattern, words in ((WORKS_NEEDED, WORKS_WORDS), (OCCUPIED, OCCUPIED_WORDS)):
        found = [m.group() for text in texts for m in re.finditer(pattern, text)]
        assert found and all(any(w in f for w in words) for f in found)


PHRASES = [
    # text, feature, state
    ("Piso con terraza.", "HASTERRACE", "mencionado"), ("Sin terraza.", "HASTERRACE", "negado"),
    ("Sin compromiso y con terraza", "HASTERRACE", "mencionado"), ("Bares con terraza", "HASTERRACE", "sin_mencion"),
    ("Terraza comunitaria", "HASTERRACE", "sin_mencion"), ("Preinstalación de aire acondicionado", "HASAIRCONDITIONING", "sin_mencion"),
    ("Posibilidad de adquirir trastero", "HASBOXROOM", "sin_mencion"), ("Trastero opcional", "HASBOXROOM", "sin_mencion"),
    ("Armarios de madera empotrados", "HASWARDROBE", "mencionado"), ("Cerca de la piscina", "HASSWIMMINGPOOL", "sin_mencion"),
    ("Portero automático", "HASDOORMAN", "sin_mencion"), ("Vistas al jardín", "HASGARDEN", "sin_mencion"),
    ("Zonas ajardinadas de la urbanización", "HASGARDEN", "mencionado"), ("Calle ajardinada", "HASGARDEN", "sin_mencion"),
    ("Proyecto de instalación de ascensor", "HASLIFT", "sin_mencion"), ("Parking público", "HASPARKINGSPACE", "sin_mencion"),
    ("No dispone de garaje", "HASPARKINGSPACE", "negado"), ("   ", "HASLIFT", "sin_descripcion"), (None, "HASLIFT", "sin_descripcion"),
]


def test_phrases_and_evidence(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHRASES)], "i int, description string")
    states = {r["i"]: r["amenidades"] for r in extract_amenities(df).collect()}
    flags = {r["i"]: r for r in amenity_flags(df).collect()}
    for i, (_, feature, state) in enumerate(PHRASES):
        assert states[i][feature]["estado"] == state, PHRASES[i]
        assert flags[i][feature] == (state == "mencionado")
        assert flags[i][f"{feature}_negado"] == (state == "negado")
        assert flags[i]["sin_descripcion"] == (state == "sin_descripcion")
    both = extract_amenities(spark.createDataFrame([("Sin terraza. Gran terraza nueva",)], "description string")).first()["amenidades"]["HASTERRACE"]
    assert both["estado"] == "mencionado" and both["conflicto"] and both["negacion"].startswith("sin terraza")


def test_user_rules_from_table_and_context(spark):
    table = spark.createDataFrame([("X", 0, r"\bmuro\b", None, None, r"\balto\b", None)],
                                  "feature string, rule_no int, pattern string, no_before string, no_after string, no_context string, needs_context string")
    rules = rule_book_from_table(table)
    assert rules == rule_book([("X", r"\bmuro\b", None, None, r"\balto\b", None)])
    got = one(spark, ["muro", "muro alto", "nada"], amenity_matches(F.col("t"), rules["X"]))
    assert [[(m["motivo"], m["fragmento"]) for m in row] for row in got] == [[(None, "muro")], [("no_contexto", "muro alto")], []]
    assert one(spark, ["muro", "muro alto"], is_mentioned(F.col("t"), rules["X"])) == [True, False]


def test_works_and_occupation(spark):
    cases = [("Vivienda a reformar.", True, False), ("Necesita una reforma integral.", True, False), ("Piso para actualizar.", True, False),
             ("Vivienda ocupada y sin posesión.", False, True), ("Se vende nuda propiedad.", False, True), ("Piso a reformar y ocupado.", True, True),
             ("Sin necesidad de reformar.", False, False), ("No requiere ninguna reforma.", False, False),
             ("Piso libre de inquilinos, desocupado.", False, False), ("Agencia: nuda propiedad - valoración de viviendas.", False, False)]
    t = normalize_text(F.col("t"))
    got = one(spark, [c[0] for c in cases], F.struct(needs_work(t).alias("w"), occupied(t).alias("o")))
    assert [(g["w"], g["o"]) for g in got] == [c[1:] for c in cases]


def test_default_rules_cover_nine_amenities():
    assert len(DEFAULT_RULES) == 9 and len(DEFAULT_RULES["HASGARDEN"]) == 2


def test_windows_begin_with_the_text_or_are_full(spark):
    from pisoval.functions.text import Windows
    texts = ["xa", "a", *("b" * n + "xa" for n in (3, 4, 5, 6, 11)), "xa xa" * 4, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = Windows(F.col("t"), "(x)(a)", width=5)
    for r in df.select("t", found.before.alias("b"), found.match.alias("m"), found.after.alias("e")).collect():
        at = [m.span() for m in re.finditer("xa", r["t"])]
        assert (r["b"], r["m"], r["e"]) == ([r["t"][max(0, i - 5):i] for i, _ in at], ["xa"] * len(at), [r["t"][j:j + 5] for _, j in at])


def test_single_spaces_stay_and_others_become_one(spark):
    from pisoval.functions.text import normalize_text
    df = spark.createDataFrame([("a b  c\t\nd\x1fe \x0b f \r",)], "t string")
    assert df.select(normalize_text(F.col("t"))).first()[0] == "a b c d e f "


def test_doubts_hold_every_discarded_match(spark):
    """Texts without a rule's doubts are told by one scan; the answers are those of the window scan."""
    from dataclasses import replace
    rnd = random.Random(5)
    vocabulary = ("terraza terrazas climatizacion splits a/a trastero armario empotrado piscina piscinas portero conserje jardin jardines ajardinada "
                  "ascensor garaje parking . . , con y sin ni no tiene hay carece de ausencia falta bares comercios comunitaria ocio preinstalacion "
                  "posibilidad opcional aparte coste a elegir cerca junto al lado la municipal publica antigua automatico real ciudad vistas "
                  "orientado parques botanico urbanizacion instalar proyecto futuro luminoso amplio piso").split()
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    texts += ["terraza", "x" * 60 + " sin terraza", "sin " + "x" * 60 + " terraza", "cocina terraza", ""]
    names = list(DEFAULT_RULES)
    fast = one(spark, texts, F.array(*[is_mentioned(F.col("t"), DEFAULT_RULES[n]) for n in names]))
    slow = one(spark, texts, F.array(*[is_mentioned(F.col("t"), [replace(r, doubts=None) for r in DEFAULT_RULES[n]]) for n in names]))
    assert fast == slow
    assert all({True, False} == {row[i] for row in fast} for i in range(len(names)))


def test_normalize_case_and_long_runs(spark):
    texts = ["ÀB" + " " * n + "Ω²ﬁŒ" + "\t" * n + "Ǆ" for n in range(1, 12)] + ["İİ", "A\x1c \x1fB", "½  ¼ ", "¨  x", "漢 字"]
    assert one(spark, texts, normalize_text(F.col("t"))) == [folded(t) for t in texts]


def test_matches_are_told_where_they_stand(spark):
    """One scan without lists of windows gives the answers of the window scan, at the ends of windows and for overlapping words too."""
    from dataclasses import replace
    rnd = random.Random(9)
    vocabulary = ("terrazas splits a/a a/a/a conaire yaire aire acondicionado bomba de calor trastero armarios empotrado empotrad empotrados piscina porteria "
                  "jardin ascensor garaje plaza plazas aparcamiento privado yaparcamiento . , ; - con y e pero aunque mas sin ni no tiene carece de falta "
                  "bares comunitaria de los preinstalacion pre- instalacion opcion opcional comprar una (opcional no incluido aparte cerca proximidades a pocos "
                  "metros la municipal antigua automatico vistas hacia el parques botanico instalacion proyecto facil zona publico").split()
    odd = ["proxim" + "a" * 30, "," * 30, " , " * 14, "x" * 37, "\x01", ",:" * 12]
    texts = ["".join(rnd.choice(odd if rnd.random() < .04 else vocabulary) + rnd.choice([" "] * 12 + ["", ", ", ".", "-"]) for _ in range(rnd.randint(1, 14)))
             for _ in range(3000)]
    t, names = normalize_text(F.col("t")), list(DEFAULT_RULES)
    assert not any(r.doubts and ("exists" in str(c := r.is_counted(F.col("t"))) or "zip_with" in str(c)) for n in names for r in DEFAULT_RULES[n])
    fast = one(spark, texts, F.array(*[is_mentioned(t, DEFAULT_RULES[n]) for n in names]))
    assert fast == one(spark, texts, F.array(*[is_mentioned(t, [replace(r, doubts=None) for r in DEFAULT_RULES[n]]) for n in names]))


def test_occupation_by_parts_is_that_of_the_whole_pattern(spark):
    from pisoval.fixed_values import OCCUPIED_CANCELLED, OCCUPIED_PARTS
    rnd = random.Random(4)
    words = ("ocupada ocupado okupada okupa okupas sin posesion nuda propiedad - valoracion usufructo renta antigua con inquilino inquilinos inquilin actual "
             "actualmente se encuentra esta vende alquilada alquilado contrato hasta de alquiler en vigor vigente libre desocupado xocupado .").split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8))) for _ in range(4000)]
    assert all(any(re.search(p or w, x) for w, p in OCCUPIED_PARTS if w in x) == bool(re.search(OCCUPIED, x)) for x in texts)
    assert one(spark, texts, occupied(F.col("t"))) == [bool(re.search(OCCUPIED, x)) and not re.search(OCCUPIED_CANCELLED, x) for x in texts]


def test_usual_accents_need_the_small_table_only():
    from pisoval.functions.text import _latin_table
    assert len(_latin_table()[0]) == len(_latin_table()[1]) < 200 and set("áéíóúüñÁÑ²ºª\t\x1fAZ") <= set(_latin_table()[0])
