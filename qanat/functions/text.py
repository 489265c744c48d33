"""Text scalars as Column functions; only Unicode normalisation and the date repair need an Arrow UDF.

Java's ``\\s`` is ASCII unless ``(?U)`` is set; it is set wherever the wider class is meant.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and word lists that results depend on.
BIDI = "[‎‏‪-‮⁦-⁩﻿]"
ARABIC = "[؀-ۿ]"
#: What ``(?U)\s`` matches, apart from the space.
GAPS = "\t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ARABIC_LETTERS = "ء-ي"
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
EASTERN = "۰۱۲۳۴۵۶۷۸۹"
WESTERN = "0123456789"
NUMERAL = "[0-9٠-٩۰-۹]"
MONTHS = (
    "يناير|فبراير|مارس|أبريل|ابريل|مايو|يونيو|يوليو|أغسطس|اغسطس|سبتمبر|أكتوبر|اكتوبر|نوفمبر|ديسمبر|"
    "رمضان|محرم|صفر|ربيع|جمادى|شوال|ذو القعدة|ذو الحجة"
)
YEAR_WORDS = "لسنة|بسنة|سنة|لعام|عام"


def strip_bidi(x: Column) -> Column:
    return F.regexp_replace(x, rf"[\x{{200E}}-\x{{FEFF}}&&{BIDI}]", "")  # one comparison for most characters


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFC")


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKC")


def stripped(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(" " + GAPS))


def spaces(x: Column) -> Column:
    """Runs of blanks become one, over two line feeds become two, ends are trimmed."""
    return stripped(F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\t"), F.lit(" ")), " {2,}", " "), "\n{3,}", "\n\n"))


def unmarked(x: Column) -> Column:
    """Without bidi controls, in NFC; null becomes empty. Text of characters below U+0300 is so already and is not handed to Python."""
    text = F.coalesce(x, F.lit(""))
    return F.coalesce(nfc(F.when(text.rlike(r"[\x{300}-\x{10FFFF}]"), strip_bidi(text))), text)


def plain_spaces(x: Column) -> Column:
    return spaces(F.replace(x, F.lit(" "), F.lit(" ")))


def clean(x: Column) -> Column:
    """Without bidi controls, in NFC, with plain spaces; null becomes empty."""
    return plain_spaces(unmarked(x))


def collapse(x: Column) -> Column:
    """Without bidi controls, every run of white space one space; null becomes empty."""
    plain = F.replace(strip_bidi(F.coalesce(x, F.lit(""))), F.lit(" "), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"(?U) \s+|[\s&&[^ ]]\s*", " "))  # single spaces are left alone


def ascii_digits(x: Column) -> Column:
    return F.translate(x, ARABIC_INDIC + EASTERN, WESTERN * 2)


def same_digits(token: Column, western: Column) -> Column:
    """The western digits in the family of the token's digits."""
    return F.when(token.rlike(f"[{ARABIC_INDIC}]"), F.translate(western, WESTERN, ARABIC_INDIC)).when(token.rlike(f"[{EASTERN}]"), F.translate(western, WESTERN, EASTERN)).otherwise(western)


def plausible_year(x: Column) -> Column:
    return x.between(1750, 2100) | x.between(1250, 1500)


_DAY = re.compile(rf"(?<!{NUMERAL}){NUMERAL}{{1,2}}(?!{NUMERAL})(?=\s*(?:{MONTHS}))")
_YEAR = re.compile(rf"((?:{YEAR_WORDS}|{MONTHS})\s*)({NUMERAL}{{4}})(?!{NUMERAL})")
_TO_ASCII = str.maketrans(ARABIC_INDIC + EASTERN, WESTERN * 2)


def _turned(token: str, fits, width: int) -> str:
    """The token reversed, in its own digits, where only its reversal fits."""
    plain = token.translate(_TO_ASCII)
    if fits(int(plain)) or len(plain) != width or not fits(int(plain[::-1])):
        return token
    family = next((f for f in (ARABIC_INDIC, EASTERN) if any(c in f for c in token)), WESTERN)
    return str(int(plain[::-1])).translate(str.maketrans(WESTERN, family))


def _repaired(text: str) -> str:
    text = _DAY.sub(lambda m: _turned(m[0], lambda d: 1 <= d <= 31, 2), text)
    return _YEAR.sub(lambda m: m[1] + _turned(m[2], lambda y: 1750 <= y <= 2100 or 1250 <= y <= 1500, 4), text)


@F.pandas_udf(StringType())
def repair_dates(x: pd.Series) -> pd.Series:
    """Days before a month and years after a year word or month whose digits are only plausible reversed."""
    return x.map(_repaired, na_action="ignore")


def repair_lam_alef(x: Column) -> Column:
    alone = F.regexp_replace(x, f"(?<![{ARABIC_LETTERS}])([وف]?)ال(?![{ARABIC_LETTERS}])", "$1لا")
    return F.replace(alone, F.lit("اال"), F.lit("الا"))


def normalise_arabic(x: Column, ligatures: bool = True) -> Column:
    y = F.replace(nfkc(clean(x)), F.lit("ـ"), F.lit(""))
    y = F.translate(F.regexp_replace(y, "[إأآٱ]", "ا"), "کی", "كي")
    y = F.regexp_replace(y, "[ً-ٰٟ]", "")
    return spaces(repair_dates(repair_lam_alef(y) if ligatures else y))


def arabic_for_embedding(x: Column) -> Column:
    """Without one- or two-digit numerals beside a parenthesis, and without parentheses."""
    d = f"[{ARABIC_INDIC}]"
    y = F.regexp_replace(x, rf"(?U)\(\s*\)?\s*{d}{{1,2}}(?!{d})", " ")
    y = F.regexp_replace(y, rf"(?U)(?<!{d}){d}{{1,2}}\s*\(\s*\)?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(y, "[()]", " "), r"(?U)\s+", " "))


def flatten_content(parts: Column) -> Column:
    """The text of an array of {text} parts; null is empty."""
    return F.coalesce(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit(""))


def strip_think(x: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.regexp_replace(x, r"(?s)<think>.*?</think>(?U)\s*", ""), "</think>", -1), r"(?U)^\s+|\s+$", "")


def first_sentence(x: Column, limit: int = 220) -> Column:
    return F.substring(F.split(collapse(x), r"(?<=[.!?؟۔])\s", 2)[0], 1, limit)


def strip_title(x: Column) -> Column:
    return F.regexp_replace(x, "^[ \\-–—:]+|[ \\-–—:]+$", "")


def slug(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\W+", "_")


def detect_article(x: Column, most: int = 1149) -> Column:
    """The number in the first mention of an article, null beyond 1..most."""
    found = F.nullif(F.regexp_extract(ascii_digits(x), r"(?i)(?:\barticle\b|\bart\.?\b|المادة|مادة)\s*(?:#\s*)?(\d+)\b", 1), F.lit(""))
    number = found.try_cast("int")
    return F.when(number.between(1, most), number)


def script_of(x: Column) -> Column:
    arabic, latin = F.regexp_count(x, F.lit(ARABIC)), F.regexp_count(x, F.lit("[A-Za-z]"))
    return F.when((arabic > 0) & (arabic >= latin), "ar").when(latin > 0, "en").otherwise("unknown")


def is_mixed(x: Column) -> Column:
    return (F.regexp_count(x, F.lit(ARABIC)) >= 3) & (F.regexp_count(x, F.lit("[A-Za-z]")) >= 5)


def split_scripts(x: Column) -> Column:
    """struct(en, ar) of a fragment's words; a word of neither script stays with the word before it, or else after it."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(None).cast("string").alias("lang"), none.alias("en"), none.alias("ar"), none.alias("wait"))

    def step(s: Column, word: Column) -> Column:
        own = F.when(word.rlike(ARABIC), "ar").when(word.rlike("[A-Za-z]{2,}"), "en")
        lang = F.coalesce(own, s["lang"])
        more = F.concat(s["wait"], F.array(word))
        return F.struct(
            lang.alias("lang"),
            F.when(lang == "en", F.concat(s["en"], more)).otherwise(s["en"]).alias("en"),
            F.when(lang == "ar", F.concat(s["ar"], more)).otherwise(s["ar"]).alias("ar"),
            F.when(lang.isNull(), more).otherwise(none).alias("wait"),
        )

    words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda s: F.struct(F.array_join(F.concat(s["wait"], s["en"]), " ").alias("en"), F.array_join(s["ar"], " ").alias("ar")))


def split_columns(line: Column) -> Column:
    """struct(en, ar) of a physical line whose columns lie two spaces or more apart."""
    plain = stripped(F.replace(strip_bidi(line), F.lit(" "), F.lit(" ")))
    pieces = F.split(plain, f"[ {GAPS}]{{2,}}")  # so a piece has single blanks only, and none at its ends

    def sides(f: Column) -> Column:
        arabic = script_of(f) == "ar"
        whole = F.struct(F.when(arabic, "").otherwise(f).alias("en"), F.when(arabic, f).otherwise("").alias("ar"))
        latin = F.struct(f.alias("en"), F.lit("").alias("ar"))
        return F.when(~f.rlike(ARABIC), latin).when(is_mixed(f), split_scripts(f)).otherwise(whole)

    def joined(parts: Column) -> Column:
        side = lambda n: F.array_join(F.filter(F.transform(parts, lambda p: p[n]), lambda t: t != ""), " ")
        return F.struct(side("en").alias("en"), side("ar").alias("ar"))

    parts = F.transform(F.transform(pieces, lambda f: F.replace(f, F.lit("\t"), F.lit(" "))), sides)
    both = F.transform(F.array(parts), joined)[0]  # by a variable, so each piece is read once for both sides
    latin = F.struct(F.replace(F.regexp_replace(plain, f"[ {GAPS[:7]}]{{2,}}", " "), F.lit("\t"), F.lit(" ")).alias("en"), F.lit("").alias("ar"))
    return F.when(plain.rlike(r"[\x{600}-\x{10FFFF}]"), both).otherwise(latin)  # without Arabic and wide blanks a line is one piece


def token_estimate(x: Column) -> Column:
    """Words times 2.2 with Arabic, else 1.4, rounded up; 0 for empty text, else 1 at least."""
    words = F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    per_word = F.when(x.rlike(ARABIC), 2.2).otherwise(1.4)
    return F.when(F.coalesce(x, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(words * per_word))).cast("int")


def prompt_tokens(x: Column) -> Column:
    """A third of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.round(F.length(F.coalesce(x, F.lit(""))) / 3)).cast("int")


def normalise(form: str, text: str) -> str:
    return unicodedata.normalize(form, text)
