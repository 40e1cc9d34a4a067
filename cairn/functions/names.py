"""Name functions of the place pipeline, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that carry no meaning in place names, single generic names, usefulness of families.
STOPWORDS = [
    "of", "the", "and", "for", "in", "at", "to", "on", "de", "la", "el", "le", "del", "doha", "qatar", "city", "st", "saint", "near", "by",
    "along", "wll", "ltd", "llc", "co", "est", "center", "centre", "our", "lady", "في", "من", "علي", "الدوحه", "قطر", "دوله", "و", "ال",
]
GENERIC = [
    "cafe", "restaurant", "hotel", "mall", "market", "mosque", "masjid", "gym", "park", "beach", "hospital", "school", "bank", "atm", "shop",
    "store", "home", "centre", "center", "tower", "villa", "building", "accommodation", "doha", "qatar", "lobby", "lounge", "studio",
    "pharmacy", "clinic", "salon", "club", "مسجد", "جامع", "صيدليه", "مطعم", "مقهي", "بنك", "مستشفي", "عياده", "مدرسه", "سوق", "فندق",
    "موقف", "حديقه", "مركز", "محل", "شركه", "مبني", "برج",
]
USEFULNESS = {
    "HEALTHCARE": 1.0, "TRANSPORT": 0.95, "FOOD": 0.95, "RELIGIOUS": 0.92, "LODGING": 0.92, "EDUCATION": 0.88, "FINANCE": 0.85, "PARKING": 0.85,
    "GOVERNMENT": 0.82, "ATTRACTION": 0.82, "SHOPPING": 0.8, "SPORT": 0.78, "SERVICES": 0.55, "UNKNOWN": 0.35, "RESIDENTIAL": 0.08, "OFFICE": 0.05,
    "INDUSTRY": 0.05, "INFRASTRUCTURE": 0.15, "MAP_FURNITURE": 0.0,
}
CATEGORY_USEFULNESS = {"atm": 0.45, "atms": 0.45}
#: Letters with marks and what is left of them without; composed letters outside this list keep their marks.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿğşأإآؤئ", "aaaaaaceeeeiiiinooooouuuuyygsاااوي"
#: Arabic letters written alike, and digits of both Arabic rows.
ARABIC, FOLDED = "ةىیک٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "هييك01234567890123456789"


def normalize(name: Column) -> Column:
    """Lower case without marks, Arabic letters folded, other signs as single blanks."""
    text = F.translate(F.translate(F.lower(name), MARKED, PLAIN), ARABIC, FOLDED)
    text = F.regexp_replace(text, "[ً-ٟـ]", "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9ء-غف-يٮ-ۓۺ-ۿ]+", " "))


def normalize_sql(name: str) -> str:
    text = f"translate(translate(lower({name}), '{MARKED}', '{PLAIN}'), '{ARABIC}', '{FOLDED}')"
    text = rf"regexp_replace({text}, '[\x{{064b}}-\x{{065f}}\x{{0640}}]', '', 'g')"
    return rf"trim(regexp_replace({text}, '[^a-z0-9\x{{0621}}-\x{{063a}}\x{{0641}}-\x{{064a}}\x{{066e}}-\x{{06d3}}\x{{06fa}}-\x{{06ff}}]+', ' ', 'g'))"


def tokens(normal: Column, stop: bool = True) -> Column:
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(STOPWORDS)) if stop else words


def dice(a: Column, b: Column) -> Column:
    """2 * common / total of two lists of distinct words; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def quality(name: Column) -> Column:
    """How telling a name is, 0 to 1: grows with length, low for generic single words and stop words."""
    n = normalize(name)
    words = tokens(n, stop=False)
    base = F.least(F.lit(1.0), F.lit(0.45) + 0.10 * F.length(n))
    single = (F.size(words) == 1) & F.element_at(words, 1).isin(GENERIC)
    return F.when(name.isNull() | (F.trim(name) == "") | (n == ""), 0.0).when(F.length(n) < 3, 0.1).when(F.size(tokens(n)) == 0, 0.1).when(single, F.greatest(base * 0.25, F.lit(0.2))).otherwise(base)
