"""Product names to comparable pieces: normal text, dose, form, counts, size, nucleus. All are Column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _decomposed() -> tuple[str, str, dict[str, str], str]:
    """Letters whose compatibility decomposition, without marks, is one plain ASCII letter, and those; letters with a longer one that has ASCII in it; a class of combining marks."""
    single, plain, longer, marks = [], [], {}, []
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        letter = chr(code)
        if unicodedata.combining(letter):
            if marks and marks[-1][1] == code - 1:
                marks[-1][1] = code
            else:
                marks.append([code, code])
            continue
        text = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if text != letter and any(c < "\x80" for c in text):
            if len(text) == 1:
                single.append(letter)
                plain.append(text)
            else:
                longer[letter] = text
    return "".join(single), "".join(plain), longer, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in marks) + "]"


ACCENTED, PLAIN, LONGER, MARKS = _decomposed()
#: Letters up to U+0131 that have no longer decomposition, as ranges.
COMMON = r"\x00-\xA7\xA9-\xAE\xB0-\xB3\xB5-\xB7\xB9-\xBB\xBF-\x{131}"

# Words for a pharmaceutical form and the form's common name.
FORMS = {
    "tableta": "tableta", "tabletas": "tableta", "tab": "tableta", "comprimido": "tableta", "comprimidos": "tableta", "comp": "tableta",
    "capsula": "capsula", "capsulas": "capsula", "cap": "capsula",
    "jarabe": "jarabe", "suspension": "suspension", "solucion": "solucion", "gotas": "gotas", "polvo": "polvo", "efervescente": "efervescente",
    "crema": "crema", "gel": "gel", "locion": "locion", "jabon": "jabon", "shampoo": "shampoo", "champu": "shampoo",
    "ampolla": "ampolla", "ampollas": "ampolla", "supositorio": "supositorio", "spray": "spray",
}
SOLID_FORMS, LIQUID_FORMS = ("tableta", "capsula"), ("jarabe", "suspension", "solucion", "gotas")

# Patterns on normal text.
UNIT_GAP = r"(\d)\s+(mg|g|mcg|ui|ml|%)\b"
STRENGTH = r"\d+(?:[.,]\d+)?\s*(?:mg|mcg|g|ui)\s*/\s*\d+(?:[.,]\d+)?\s*ml|\d+(?:[.,]\d+)?\s*(?:mg|mcg|ui|%)"
GRAM_DOSE = r"\b(\d+(?:[.,]\d+)?)\s*gr?\b"
MOST_GRAMS = 5.0
COUNT = r"(?:x\s*(\d+)|caja\s*(?:de\s*)?(\d+)|(\d+)\s*(?:un|und|unidades|tabletas|capsulas|comprimidos))"
SIZE = r"(\d+(?:[.,]\d+)?)\s*(ml|l|kg|gr|g|und|unidades|unid|un|tabletas|tableta|tabs|tab|comprimidos|comprimido|comp|capsulas|capsula|caps|ampollas|ampolla|amp|sobres|sobre)\b"
NUMBERS = r"\d+(?:[.,]\d+)?(?:mg|g|mcg|ui|ml|kg|%)?(?:/\d+(?:[.,]\d+)?\s*ml)?"
CONCENTRATION = r"^(\d+(?:\.\d+)?)(mg|mcg|g|ui|%)(?:/(\d+(?:\.\d+)?)ml)?$"
VITAMIN = r"\bvitamin[a]?\s+([a-k])(?=\b|\d)"

# Words that say nothing of the product itself.
STOP_WORDS = tuple(
    "caja cajas frasco frascos blister blisters tableta capsula un und unid unidades x sobre sobres polvo solucion jarabe suspension "
    "gotas crema gel locion jabon granulos granulado granulada granular comprimido comprimidos comprimida shampoo barra efervescente "
    "ampolla supositorio spray ml mg mcg ui kg de del para con sin y o el la las los".split()
)
GENERIC_WORDS = tuple(
    "liberacion retardada retard prolongada modificada lenta rapida controlada recubierta recubiertas recubierto recubiertos gragea grageas "
    "oral sublingual masticable bucal dispersable bebible sodico sodica potasico potasica calcico calcica magnesico maleato sulfato fosfato "
    "nitrato bromuro clorhidrato dihidrato monohidrato besilato base micronizado anhidro trihidrato acido vitamina complejo sales sal".split()
)
VARIANT_WORDS = tuple("antigripal compuesto compositum plus duo forte fuerte expectorante descongestionante gripa fol pronatal prenatal peptigro".split())
CHILD_WORDS = tuple("infantil infantiles pediatrico pediatrica pediatricos pediatricas ninos nino nina ninas bebe bebes".split())
NOT_PLAIN_WORDS = ("polvo", "granulos", "granulado", "granulada", "jarabe", "solucion", "suspension", "gotas")


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def plain_letters(s: Column) -> Column:
    """Letters taken apart (compatibility decomposition) and their marks taken off, as far as that gives ASCII letters: ñ is n with or without its mark apart, ½ is 1⁄2, ™ is TM."""
    # one literal for all longer ones and one use of s, so that plans stay short; looked up are only letters that aren't common
    table = F.str_to_map(F.lit("\x02".join(f"{c}\x01{t}" for c, t in LONGER.items())), F.lit("\x02"), F.lit("\x01"))
    pieces = F.regexp_extract_all(s, F.lit(f"(?s)[{COMMON}]+|."), F.lit(0))
    apart = F.array_join(F.transform(pieces, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.translate(F.regexp_replace(apart, f"[[^{COMMON}]&&{MARKS}]", ""), ACCENTED, PLAIN)


def normal_text(s: Column) -> Column:
    """Lower case, plain letters, units joined to their numbers, words for forms made common; null: ''."""
    t = F.regexp_replace(F.lower(plain_letters(F.coalesce(s, F.lit("")))), "[^a-z0-9%./ ]+", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, UNIT_GAP, "$1$2"), r"\s+", " "))
    return F.array_join(F.transform(F.split(t, " "), lambda w: F.coalesce(F.try_element_at(_map(FORMS), w), w)), " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def concentration(text: Column) -> Column:
    """Strength of normal text ('500mg', '120mg/5ml'), else a small dose in grams ('1g'); null if neither."""
    strength = _some(F.regexp_replace(F.regexp_extract(text, STRENGTH, 0), r"\s+", ""))
    grams = F.replace(_some(F.regexp_extract(text, GRAM_DOSE, 1)), F.lit(","), F.lit(".")).try_cast("double")
    shortest = F.regexp_replace(grams.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    return F.coalesce(F.replace(strength, F.lit(","), F.lit(".")), F.when((grams > 0) & (grams <= MOST_GRAMS), F.concat(shortest, F.lit("g"))))


def form(text: Column) -> Column:
    """The first word of normal text that names a form; null without one."""
    return F.try_element_at(_map(FORMS), F.get(F.filter(tokens(text), lambda w: F.array_contains(_array(FORMS), w)), F.lit(0)))


def pack_count(text: Column) -> Column:
    """Units in the package, by the first count of normal text."""
    return F.coalesce(*[_some(F.regexp_extract(text, COUNT, i)).try_cast("int") for i in (1, 2, 3)])


def package_size(text: Column) -> Column:
    """Struct (value, class of ml, g, un) of the last size that isn't a strength; null without one."""
    rest = F.regexp_replace(text, STRENGTH, " ")
    number = F.try_element_at(F.regexp_extract_all(rest, F.lit(SIZE), F.lit(1)), F.lit(-1))
    unit = F.try_element_at(F.regexp_extract_all(rest, F.lit(SIZE), F.lit(2)), F.lit(-1))
    kind = F.when(unit.isin("ml", "l"), "ml").when(unit.isin("g", "gr", "kg"), "g").otherwise("un")
    value = F.replace(number, F.lit(","), F.lit(".")).try_cast("double") * F.when(unit.isin("l", "kg"), 1000.0).otherwise(1.0)
    return F.when(number.isNotNull(), F.struct(value.alias("valor"), kind.alias("clase")))


def nucleus_tokens(text: Column) -> Column:
    """Words of brand or substance in normal text."""
    words = tokens(F.regexp_replace(text, NUMBERS, " "))
    return F.filter(words, lambda w: ~F.array_contains(_array(STOP_WORDS), w) & (F.length(w) > 2))


def nucleus(text: Column) -> Column:
    return F.array_join(nucleus_tokens(text), " ")


def key_tokens(nucleus_words: Column) -> Column:
    return F.array_sort(F.array_except(nucleus_words, _array(GENERIC_WORDS + VARIANT_WORDS)))


def variant_tokens(nucleus_words: Column) -> Column:
    return F.array_sort(F.array_intersect(nucleus_words, _array(VARIANT_WORDS)))


def for_children(nucleus_words: Column) -> Column:
    return F.arrays_overlap(nucleus_words, _array(CHILD_WORDS))


def vitamin_letters(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(VITAMIN), F.lit(1))))


def effervescent(text: Column) -> Column:
    return F.contains(text, F.lit("efervescente"))


def plain_tablet(text: Column) -> Column:
    t = tokens(text)
    return ~F.arrays_overlap(t, _array(("efervescente", *NOT_PLAIN_WORDS))) & F.arrays_overlap(t, _array(SOLID_FORMS))


def gummy(text: Column) -> Column:
    return F.contains(text, F.lit("gomita"))


def parsed_concentration(c: Column) -> Column:
    """Struct (valor in mg where a mass, unidad, denominador in ml); null if it isn't one."""
    unit = F.regexp_extract(c, CONCENTRATION, 2)
    factor = F.when(unit == "g", 1000.0).when(unit == "mcg", 0.001).otherwise(1.0)
    value = _some(F.regexp_extract(c, CONCENTRATION, 1)).try_cast("double")
    kind = F.when(unit.isin("g", "mcg"), "mg").otherwise(unit)
    return F.when(value.isNotNull(), F.struct((value * factor).alias("valor"), kind.alias("unidad"), _some(F.regexp_extract(c, CONCENTRATION, 3)).try_cast("double").alias("denominador")))


def spec_signature(conc: Column, kind: Column, count: Column) -> Column:
    return F.concat_ws("|", F.coalesce(conc, F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce(count.cast("string"), F.lit("")))


def search_key(name: Column, nucleus_words: Column, n: int = 3) -> Column:
    """The first n words of the nucleus, or the name itself without any (3: narrow, 2, 1: wide)."""
    return F.when(F.size(nucleus_words) == 0, name).otherwise(F.array_join(F.slice(nucleus_words, 1, n), " "))


def slug_base(slug: Column) -> Column:
    """A menu slug without its number at the end."""
    return F.regexp_replace(slug, r"-\d+$", "")


def slug_title(slug: Column) -> Column:
    return F.initcap(F.replace(slug_base(slug), F.lit("-"), F.lit(" ")))


def count_text(s: Column) -> Column:
    """The number in a text such as '1,234 products'; null without digits."""
    return _some(F.regexp_replace(s, "[^0-9]", "")).try_cast("int")


def features(df, name: str = "nombre_origen", presentation: str | None = None):
    """All columns with the features that matching reads (texto_norm, concentracion, forma, cantidad, tamano, nucleo, ...)."""
    df = df.withColumn("texto_norm", normal_text(F.col(name)))
    t = F.col("texto_norm")
    whole = t if presentation is None else normal_text(F.concat_ws(" ", F.col(name), F.coalesce(F.col(presentation), F.lit(""))))
    df = df.withColumns({"_nt": nucleus_tokens(t), "concentracion": concentration(t), "forma": form(t), "cantidad": pack_count(t), "tamano": package_size(whole)})
    n = F.col("_nt")
    return df.withColumns(
        {
            "nucleo": F.array_join(n, " "), "clave": key_tokens(n), "variante": variant_tokens(n), "infantil": for_children(n),
            "vitaminas": vitamin_letters(t), "efervescente": effervescent(t), "tableta_plana": plain_tablet(t), "gomita": gummy(t),
            "conc": parsed_concentration(F.col("concentracion")),
        }
    ).drop("_nt")
