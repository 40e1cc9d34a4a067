"""Reading place names: kind of place, number, article, and a spelling-tolerant core comparable over scripts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words for kinds of places as they stand in names, by kind.
KIND_WORDS = {
    "restaurant": ["restaurant", "rest", "مطعم"],
    "grill": ["grill", "grills", "grill house", "مشاوي"],
    "cafe": ["cafe", "coffee shop", "coffee house", "coffee", "مقهى", "كافيه"],
    "clinic": ["clinic", "clinics", "med ctr", "medical centre", "medical center", "medical", "polyclinic", "عيادة"],
    "pharmacy": ["pharmacy", "pharm", "pharmacie", "drugstore", "صيدلية"],
    "hotel": ["hotel", "suites", "hotel suites", "hotel and suites", "فندق"],
    "bank": ["bank", "banking", "بنك", "مصرف"],
    "atm": ["atm", "cash machine", "صراف", "صراف الي"],
    "garage": ["garage", "car repair", "auto workshop", "workshop", "auto", "كراج"],
    "salon": ["salon", "saloon", "beauty salon", "beauty", "hair salon", "صالون"],
    "school": ["school", "schools", "sch", "مدرسة"],
    "fuel": ["petrol station", "petrol stn", "fuel station", "gas station", "petrol", "fuel", "station", "stn", "محطة وقود", "محطة", "وقود"],
    "supermarket": ["supermarket", "super market", "hypermarket", "سوبرماركت"],
    "mosque": ["mosque", "masjid", "مسجد"],
    "park": ["park", "garden", "gardens", "حديقة", "منتزه"],
    "hospital": ["hospital", "مستشفى"],
    "shop": ["shop", "store", "محل", "متجر"],
    "museum": ["museum", "متحف"],
}
# Category terms of both vocabularies, by kind.
CATEGORY_KINDS = {
    "restaurant": ["restaurant", "middle_eastern_restaurant", "food"],
    "grill": ["fast_food", "fast_food_restaurant", "burger_restaurant"],
    "cafe": ["cafe", "coffee_shop"],
    "clinic": ["clinic", "doctor", "doctors", "medical_clinic", "medical_center"],
    "pharmacy": ["pharmacy", "drugstore"],
    "hotel": ["hotel", "accommodation"],
    "bank": ["bank", "banks", "bank_credit_union"],
    "atm": ["atm", "atms"],
    "garage": ["car_repair", "automotive_repair", "auto_body_shop"],
    "salon": ["hairdresser", "beauty_salon", "hair_salon"],
    "school": ["school", "elementary_school"],
    "fuel": ["fuel", "gas_station"],
    "supermarket": ["supermarket", "grocery_store"],
    "mosque": ["place_of_worship", "mosque"],
    "park": ["park"],
    "hospital": ["hospital"],
    "museum": ["museum"],
}
CATEGORY = {term: kind for kind, terms in CATEGORY_KINDS.items() for term in terms}
_ARTICLES = {"al", "el", "an", "ar", "as", "at", "az", "ad", "the", "ash", "ath"}
# Consonants of Arabic letters in the spelling used below; letters left out are vowels.
_ARABIC = dict(zip("بپتثجچحخدذرزژسشصضطظعغفڤقكکگلمنهة", "b b t t g g h k d d r s s s s s d t s  g f f k k k g l m n h ".split(" ")))
_PLACEHOLDERS = {"", "-", "--", ".", "?", "n/a", "na", "none", "null", "unknown", "unnamed", "no name", "noname", "test", "poi", "tbd", "todo", "x", "xxx", "0", "place", "see map", "same as above"}


def fold(text: str) -> str:
    """Lower case without marks, invisible characters and runs of blanks; dots of abbreviations are dropped."""
    if text.isascii():
        return " ".join(text.lower().split())
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()
    text = text.translate(str.maketrans("أإآٱى", "ااااي", "ـ"))
    return " ".join(text.replace("’", "'").split())


_WORDS = sorted(((fold(w), k) for k, words in KIND_WORDS.items() for w in words), key=lambda x: -len(x[0]))


_PADDED = [(f" {w} ", k) for w, k in _WORDS]
_SINGLE = {w: k for w, k in _WORDS if " " not in w and w.isascii()}
_LEAST_MISSPELT = 6  # letters from which a word one edit away from a kind of place stands for it


def _one_edit(a: str, b: str) -> bool:
    """Whether one letter put in, left out or replaced, or two neighbours swapped, makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


@lru_cache(maxsize=200_000)
def kind_of_word(word: str) -> str:
    """Kind of place that a misspelt or vowelless word stands for ('resturant', 'htl'); empty if none."""
    if word in _SINGLE:
        return _SINGLE[word]
    for known, kind in _SINGLE.items():
        bare = known[0] + "".join(c for c in known[1:] if c not in "aeiou")
        if len(word) >= 3 and word in (bare, re.sub(r"(.)\1+", r"\1", bare)) and word != known:
            return kind
        if len(word) >= _LEAST_MISSPELT and len(known) >= _LEAST_MISSPELT and word[0] == known[0] and _one_edit(word, known):
            return kind
    return ""


def is_placeholder(text: str | None) -> bool:
    return text is None or fold(text).strip(" .!&,;:_-") in _PLACEHOLDERS


@lru_cache(maxsize=100_000)
def squeeze(word: str) -> str:
    """A Latin word with the spellings of one sound made alike."""
    for a, b in (("sch", "sh"), ("ch", "sh"), ("ph", "f"), ("th", "t"), ("gh", "g"), ("kh", "k"), ("dh", "d"), ("q", "k"), ("c", "k"), ("x", "ks"), ("ou", "u"), ("oo", "u"), ("ee", "i"), ("y", "i"), ("v", "f"), ("w", "u"), ("z", "s"), ("p", "b"), ("j", "g"), ("e", "i"), ("o", "u")):
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word)


@lru_cache(maxsize=100_000)
def skeleton(core: str) -> str:
    """Consonants of a folded core in one spelling for both scripts; doubled letters count once, h and half vowels not at all."""
    out, last = [], ""
    for c in core:
        if "\u0600" <= c <= "\u06ff" and c != last:
            out.append(_ARABIC.get(c, ""))
        last = c
    latin = "".join(c for c in squeeze("".join(c for c in core if c.isascii())) if c.isalpha() and c not in "aiuh")
    return "".join(out).replace("h", "") + latin


def parse(name: str | None) -> tuple[str, str, str, str]:
    """(core, kind, number, aside): folded core without kind, article and asides in brackets; empty parts where missing."""
    if is_placeholder(name):
        return "", "", "", ""
    text = fold(name)
    aside = " ".join(re.findall(r"[(\[]([^)\]]*)[)\]]?", text))
    text = re.sub(r"[(\[][^)\]]*[)\]]?", " ", text)
    if "." in text:
        text = re.sub(r"(?<=[^\W\d_])\.(?=\s|$)|(?<=\b[a-z])\.(?=[a-z]\b)", "", text)
    text = re.sub(r"\ba t m\b", "atm", re.sub(r"[^\w]+", " ", text).replace("_", " ")).strip()
    number = " ".join(re.findall(r"\d+", text))
    text = " ".join(re.sub(r"\d+", " ", text).split())
    kind = ""
    padded = f" {text} "
    for word, k in _PADDED:
        if word in padded:
            padded = padded.replace(word, " ", 1)
            kind = kind or k
    words = padded.split()
    if not kind and len(words) > 1:
        k = next((i for i in range(len(words) - 1, 0, -1) if kind_of_word(words[i])), None)
        if k is not None:
            kind = kind_of_word(words.pop(k))
    if words and words[0] in _ARTICLES and (len(words) > 1 or words[0] in ("al", "el")):
        words = words[1:]
    elif words and words[0].startswith("ال"):
        words = [words[0][2:], *words[1:]] if len(words[0]) > 2 else words[1:]
    return " ".join(words), kind, number, aside


def _arabic(text: str) -> bool:
    return any("\u0600" <= c <= "\u06ff" for c in text)


def variants(name: str | None) -> list[str]:
    """The names that a field holds: the parts in either script of 'English / عربي', or the whole."""
    if name is None:
        return []
    parts = [p for p in re.split(r"(?<=[\u0600-\u06ff])(?=[\s|/()–-]*[A-Za-z\u00c0-\u024f])|(?<=[A-Za-z\u00c0-\u024f0-9.)])(?=[\s|/(–-]*[\u0600-\u06ff])", name) if p.strip(" -|/–")]
    if len(parts) == 2 and _arabic(parts[0]) != _arabic(parts[1]):
        return [p.strip(" -|/–") for p in parts]
    return [name]
