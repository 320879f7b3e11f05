"""Scalar text functions of record normalisation and phonetic tokens, all native columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The legal words and street words of the record format.
LEGAL_WORDS = [
    "co", "company", "corp", "corporation", "inc", "incorporated", "limited", "limited liability company",
    "limited liability partnership", "llc", "llp", "ltd", "plc", "private limited", "private ltd", "pvt limited",
    "pvt ltd", "sa", "sarl", "sas", "sasu",
]
STREET_WORDS = {
    "apartment": "apt", "avenue": "ave", "boulevard": "blvd", "building": "bldg", "circle": "cir", "court": "ct",
    "drive": "dr", "floor": "fl", "highway": "hwy", "lane": "ln", "parkway": "pkwy", "place": "pl", "road": "rd",
    "square": "sq", "street": "st", "suite": "ste",
}
LEGAL_PATTERN = r"\b(" + "|".join(sorted(LEGAL_WORDS, key=lambda w: (-len(w), w))) + r")\b"


# Letters that their Unicode names do not spell out.
SPELLED = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i",
    "θ": "th", "φ": "ph", "χ": "ch", "ψ": "ps", "ξ": "x", "η": "e", "х": "kh", "щ": "shch", "ы": "y",
}


def _spell(c: str) -> str | None:
    """Latin letters for one lower-case letter, sign or digit, from its Unicode name."""
    if c in SPELLED:
        return SPELLED[c]
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    if plain and plain.isascii():
        return plain.lower()
    digit, name = unicodedata.digit(c, None), unicodedata.name(plain[:1] or c, "").split()
    if digit is not None:
        return str(digit)
    if not name or name[0] not in SCRIPTS:
        return None
    sound = name[-1].lower()
    if "SIGN" in name and "VOWEL" not in name:
        return "n" if sound in ("anusvara", "candrabindu") else ""
    if name[0] == "GREEK":
        return sound[0]
    if name[0] == "CYRILLIC":
        if len(sound) == 2 and sound[0] == "e" and sound[1] not in "aeiou":
            return sound[1]
        return sound.rstrip("e") or "e" if sound not in ("ie", "ka", "sha") else {"ie": "e", "ka": "k", "sha": "sh"}[sound]
    # Indic scripts: a consonant is named with the vowel that it carries.
    return sound[:-1] if sound.endswith("a") and sound.strip("aeiou") else sound


SCRIPTS = ("GREEK", "CYRILLIC", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
#: Letters beyond ASCII and what they are written as, by the rule above.
LETTERS = {c: x for n in (*range(0xC0, 0x180), *range(0x370, 0x460), *range(0x900, 0xD80)) if (c := chr(n)) == c.lower() and (x := _spell(c)) is not None}


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def to_ascii(c: Column) -> Column:
    """Lower case, with letters of other scripts written in Latin ones; unknown ones are kept."""
    low = F.lower(c)
    letters = F.expr("str_to_map('" + ",".join(f"{k}:{v}" for k, v in LETTERS.items()) + "', ',', ':')")
    spelled = F.array_join(F.transform(F.split(low, ""), lambda x: F.when(x > F.lit("\x7f"), F.coalesce(F.try_element_at(letters, x), x)).otherwise(x)), "")
    return F.when(low.rlike("[^\\x00-\\x7f]"), spelled).otherwise(low)


def alnum_only(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "))


def strip_legal_suffix(c: Column) -> Column:
    """Every legal word goes; a name of nothing else stays as it is."""
    cut = squeeze(F.regexp_replace(c, LEGAL_PATTERN, " "))
    return F.when(cut == "", c).otherwise(cut)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def norm_street(c: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in STREET_WORDS.items() for x in kv])
    return F.array_join(F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(words, t), t)), " ")


def digit_groups(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1))


def house_number(groups: Column) -> Column:
    return F.get(groups, F.lit(0))


def postal_code(groups: Column) -> Column:
    return F.try_element_at(F.filter(groups, lambda x: F.length(x).isin(5, 6)), F.lit(-1))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct n-grams without spaces; a shorter text is one gram, an empty one none."""
    s = F.replace(c, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1)), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


# Look-alike digits, and sound classes in the order in which they apply.
LOOK_ALIKE = ("5013478", "soieatb")
SOUNDS = (("ph", "f"), ("ck", "k"), ("x", "ks"), ("q", "k"), ("c", "k"), ("w", "v"), ("z", "j"), ("j", "g"))


def skeleton(t: Column) -> Column:
    """Phonetic skeleton of a token: look-alike digits, sound classes, vowels dropped."""
    mixed = t.rlike("[0-9]") & ~t.rlike("^[0-9]+$")
    s = F.when(mixed, F.translate(t, *LOOK_ALIKE)).otherwise(t)
    for a, b in SOUNDS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"(.)\1+", "$1")
    s = F.regexp_replace(s, "^[aeiou]", "a")
    s = F.regexp_replace(s, "(?<=.)[aeiouyh]", "")
    return F.regexp_replace(s, r"(.)\1+", "$1")


def joint_skeleton(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"(.)\1+", "$1"), "(?<=.)[aeiouyhw]", "")


def numbers(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+(?=.)", "")))


def _units(addr: Column) -> Column:
    def unit(t: Column) -> Column:
        return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).when(t.rlike("^[a-z]+$"), skeleton(t)).otherwise(t)

    return F.transform(tokens(addr), unit)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(values: Column) -> Column:
    def all_pairs(xs: Column) -> Column:
        return F.flatten(F.transform(xs, lambda x: F.transform(F.filter(xs, lambda y: y > x), lambda y: F.concat(x, F.lit("_"), y))))

    return let(F.array_sort(F.array_distinct(values)), all_pairs)


def name_skeletons(name: Column) -> Column:
    return F.transform(F.filter(tokens(name), lambda t: F.length(t) > 1), skeleton)


#: The kinds of tokens of ``tok4``, each with its prefix.
KINDS = ("n", "a", "c", "d", "b", "p")


def tok4_kinds(name: Column, addr: Column) -> Column:
    """The six kinds of tokens of a name and an address, each a distinct list without its prefix."""

    def kinds(v: Column) -> Column:
        names, parts, units = v["names"], v["parts"], v["units"]
        alpha = F.transform(F.filter(parts, lambda t: t.rlike("^[a-z]+$") & (F.length(t) > 1)), skeleton)
        codes = F.filter(parts, lambda t: ~t.rlike("^[a-z]+$") & ~t.rlike("^[0-9]+$"))
        ends = F.slice(units, 2, 1 << 20)
        bigrams = F.filter(F.zip_with(units, ends, lambda x, y: F.concat(x, F.lit("_"), y)), lambda x: x.isNotNull())
        lists = {"n": names, "a": alpha, "c": codes, "d": v["numbers"], "b": bigrams, "p": _pairs(names)}
        return F.struct(*[F.array_distinct(lists[k]).alias(k) for k in KINDS])

    return let(F.struct(name_skeletons(name).alias("names"), tokens(addr).alias("parts"), _units(addr).alias("units"), numbers(addr).alias("numbers")), kinds)


def tok4(name: Column, addr: Column) -> Column:
    """The tokens of all kinds, distinct and prefixed."""

    def tagged(v: Column, kind: str) -> Column:
        return F.transform(v[kind], lambda x: F.concat(F.lit(kind + ":"), x))

    return let(tok4_kinds(name, addr), lambda v: F.concat(*[tagged(v, k) for k in KINDS]))


def joint_tokens(name: Column, addr: Column) -> Column:
    n = F.transform(F.filter(tokens(name), lambda t: F.length(t) > 1), lambda t: F.concat(F.lit("n:"), joint_skeleton(t)))
    return F.array_distinct(F.concat(n, F.transform(tokens(addr), lambda t: F.concat(F.lit("a:"), t))))


def name_key(name: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(name_skeletons(name))), " ")


def twin_key(name: Column, addr: Column) -> Column:
    return F.concat(name_key(name), F.lit("#"), F.array_join(F.array_sort(numbers(addr)), " "))


def jaccard(a: Column, b: Column) -> Column:
    """-1 when both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(-1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union))
