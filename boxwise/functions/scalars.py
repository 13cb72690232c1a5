"""Column functions on printed text. Each reading of a number keeps its own rules."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic-Indic and Persian digits, and the digits that they stand for.
PRINTED_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
#: Units and currencies that may stand beside a number.
UNITS = "(?:PCS?|SETS?|KG|M|LTR|BAG|DRM|GAL|EA|SAR|USD|AED|ريال|#)"
CURRENCIES = "(?:SAR|USD|AED|EUR|GBP|PKR|ريال)"


def or_null(c: Column) -> Column:
    """Empty text is no value."""
    return F.nullif(c, F.lit(""))


def folded(c: Column) -> Column:
    """Digits in ASCII, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(c, PRINTED_DIGITS, ASCII_DIGITS), r"\s+", " "))


def normalized(c: Column) -> Column:
    """Every comma reads as a decimal point."""
    return F.replace(folded(c), F.lit(","), F.lit("."))


def money(c: Column) -> Column:
    """At most eight digits and two decimals, after an optional currency and before an optional unit; thousands commas give null."""
    pattern = rf"(?i)^ *(?:{CURRENCIES} *)?[:#]? *([0-9]{{1,8}}(?:\.[0-9]{{1,2}})?) *(?:[A-Za-z]+|ريال|#)? *$"
    return or_null(F.regexp_extract(normalized(c), pattern, 1)).try_cast("decimal(10,2)")


def numeric(c: Column) -> Column:
    """Thousands commas go, a unit may follow, a dot after two decimals is forgiven; a percent sign gives null."""
    t = F.replace(F.replace(F.translate(c, PRINTED_DIGITS, ASCII_DIGITS), F.lit("٬"), F.lit("")), F.lit("٫"), F.lit("."))
    t = F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"^([0-9]+[.,][0-9]{2})\.$", "$1")
    t = F.replace(F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9]{3}(?:[, .]|$))", ""), F.lit(","), F.lit("."))
    return or_null(F.regexp_extract(t, rf"(?i)^[:#]? *([0-9]+(?:\.[0-9]+)?) *{UNITS}? *$", 1)).try_cast("decimal(24,6)")


def number(c: Column) -> Column:
    """A comma between digits is a decimal point; sign and percent sign may stand."""
    t = F.regexp_replace(folded(c), r"^[ .:;،]+|[ .:;،]+$", "")
    t = F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9])", ".")
    return or_null(F.regexp_extract(t, r"^([-+]?[0-9]+(?:\.[0-9]+)?)%?$", 1)).try_cast("decimal(24,6)")


def loose_number(c: Column) -> Column:
    """All commas go; only finite values stay."""
    value = F.regexp_replace(c, ",", "").try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def digits_of_length(c: Column, lengths: list[int]) -> Column:
    """The first run of digits whose length is wanted."""
    runs = F.regexp_extract_all(folded(c), F.lit("[0-9]+"), F.lit(0))
    return F.get(F.filter(runs, lambda r: F.length(r).isin(lengths)), F.lit(0))


def squashed(c: Column) -> Column:
    """Vowel signs (U+064B to U+0652) and tatweel go, the four alef forms fold, only ASCII letters, digits and the Arabic block stay."""
    t = F.replace(F.regexp_replace(folded(F.lower(c)), "[\u064b-\u0652\u0640]", ""), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.translate(t, "أإآٱ", "اااا"), "[^0-9a-z\u0600-\u06ff]", "")


def has_arabic(c: Column) -> Column:
    return c.rlike("[؀-ۿ]")


def date_key(c: Column) -> Column:
    """ISO form of a text that is a date, year first or day first, between dashes or strokes; else the text, its strokes as dashes."""
    t = F.replace(normalized(c), F.lit("/"), F.lit("-"))
    first = F.when(t.rlike("^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(t, "yyyy-M-d"))
    last = F.when(t.rlike("^[0-9]{1,2}-[0-9]{1,2}-(?!0000)[0-9]{4}$"), F.try_to_date(t, "d-M-yyyy"))
    return F.coalesce(F.date_format(F.coalesce(first, last), "yyyy-MM-dd"), t)


def phrase_in(text: Column, phrase: str) -> Column:
    """Whether the words of a phrase follow each other among the words of the text, or joined are one of them."""
    tokens = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    words = phrase.lower().split()
    return F.contains(tokens, F.lit(f" {' '.join(words)} ")) | F.contains(tokens, F.lit(f" {''.join(words)} "))


def typed(c: Column, kind: str) -> Column:
    """The text if it has the shape of a VAT number, register number, building number, post code, short address or code."""
    shape = {"vat": "^3[0-9]{13}3$", "cr": "^[0-9]{10}$", "building": "^[0-9]{4}$", "post": "^[0-9]{5}$", "short": "^[A-Za-z]{4}[0-9]{4}$", "code": "^[A-Za-z0-9-]{2,20}$"}[kind]
    fits = folded(c).rlike(shape)
    return F.when(fits & c.rlike("[0-9]") if kind == "code" else fits, folded(c))


def trusted(confidence: Column, source: Column, least: float) -> Column:
    """Native text is always trusted; a missing confidence is zero."""
    return (F.coalesce(source, F.lit("")) == "native_text") | (F.coalesce(confidence, F.lit(0.0)) >= least)


def lost_digits(short: Column, full: Column) -> Column:
    """Whether the shorter text is the longer one with characters left out."""
    kept = F.aggregate(F.split(full, ""), F.lit(""), lambda a, c: F.when((F.length(a) < F.length(short)) & (F.substr(short, F.length(a) + 1, F.lit(1)) == c), F.concat(a, c)).otherwise(a))
    return (F.length(short) > 0) & (F.length(short) < F.length(full)) & (kept == short)


def _nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compatible(c: Column) -> Column:
    """NFKC, which no built-in function gives."""
    return F.pandas_udf(_nfkc, "string")(c)


def close_number(a: Column, b: Column, least: int = 2, share: int = 200) -> Column:
    """Both known and no further apart than the least or than one part in so many of b, whichever is more."""
    return F.coalesce(F.abs(a - b) * share <= F.greatest(F.lit(least * share), F.abs(b)), F.lit(False))


def draft_json(c: Column, schema: str) -> Column:
    """The one JSON object that a text is, with or without a code fence; null for any other text, and for text before or after it."""
    body = F.regexp_replace(F.trim(c), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    got = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{schema}>", {"mode": "PERMISSIVE"})
    return F.when(F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}")) & (F.size(got) == 1), F.get(got, F.lit(0)))


#: Arabic words that are printed joined to the word before, and month names.
JOINED = "الوحدة|الكمية|الضريبة|السعر|المبلغ|القيمة|الصنف|الخصم|النسبة"
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
#: A printed date: numeric, the year last or first, or with the name of its month.
PRINTED_DATE = rf"(?i)\b(?:\d{{1,2}}[-/.]\d{{1,2}}[-/.]20\d{{2}}|20\d{{2}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[\s-]+(?:{MONTHS})[\s-]+20\d{{2}})\b"
EDGE = r"[ .,:;/|-]+"


def heading_in(text: Column, phrases: list[str]) -> Column:
    """Whether a heading holds one of the phrases, after joined Arabic words were set apart and final yeh was made one letter."""
    apart = F.regexp_replace(F.translate(text, "ى", "ي"), rf"(?<=\S)({JOINED})", " $1")
    out = F.lit(False)
    for p in phrases:
        out = out | (phrase_in(apart, p) if p.isascii() else F.contains(apart, F.lit(p)))
    return out


def unlabelled(text: Column, labels: list[str]) -> Column:
    """The text without its labels (longest first; Latin ones as whole words), without separators, trimmed."""
    out = folded(text)
    for label in sorted(set(labels), key=lambda x: (-len(x), x)):
        pattern = rf"(?i)(?<![A-Za-z]){re.escape(label)}(?![A-Za-z])" if re.search("[A-Za-z]", label) else re.escape(label)
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, "[/|:;_-]+", " ")
    return F.regexp_replace(out, rf"^{EDGE}|{EDGE}$", "")


def is_text(text: Column, labels: list[str], least: int = 3) -> Column:
    """Whether a text can be a free-text value: letters, long enough, no run of three digits, no label in it."""
    t = F.regexp_replace(folded(text), rf"^{EDGE}|{EDGE}$", "")
    held = F.lit(False)
    for label in labels:
        held = held | phrase_in(t, label)
    return F.coalesce((F.length(t) >= least) & t.rlike("[A-Za-z؀-ۿ]") & ~t.rlike("[0-9]{3}") & ~held, F.lit(False))


def audited(text: Column) -> Column:
    """Text as an audit compares it: ASCII digits, no thousands commas, lower case, single spaces."""
    t = F.replace(F.replace(F.translate(text, PRINTED_DIGITS, ASCII_DIGITS), F.lit("٬"), F.lit("")), F.lit("٫"), F.lit("."))
    t = F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9]{3}(?:[, .]|$))", "")
    return F.trim(F.regexp_replace(F.replace(F.lower(t), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def is_decimal(text: Column) -> Column:
    """Whether a token is a number with a decimal point or comma; thousands commas are allowed."""
    t = F.trim(F.translate(text, PRINTED_DIGITS, ASCII_DIGITS))
    t = F.replace(F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9]{3}(?:[, .]|$))", ""), F.lit(","), F.lit("."))
    return F.coalesce(t.rlike(r"^[+-]?[0-9]+\.[0-9]+$"), F.lit(False))


def hijri(text: Column) -> Column:
    """The first date of a year 14xx, day first."""
    return or_null(F.regexp_extract(folded(text), r"\b([0-9]{1,2}/[0-9]{1,2}/14[0-9]{2})\b", 1))


def clock(text: Column) -> Column:
    """The first time of day."""
    return or_null(F.regexp_extract(folded(text), r"\b((?:[01]?[0-9]|2[0-3]):[0-5][0-9])\b", 1))
