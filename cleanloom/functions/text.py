"""Text functions: Column -> Column, all JVM-side but for Unicode forms and Python's title case."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import vocabulary as V


def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """Drops white space of any kind at both ends."""
    return _sub(c, r"(?U)^\s+|\s+$")


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return strip(_sub(c, r"(?U)\s+", " "))


def is_missing(c: Column, terms: tuple[str, ...] = V.MISSING_VALUES) -> Column:
    text = F.lower(strip(c.cast("string")))
    return c.isNull() | text.isin(*terms)


def placeholder_pattern(extra: tuple[str, ...] = ()) -> str:
    """Matches a whole cell that is a placeholder, with punctuation around it."""
    return r"(?iU)^[\W_]*(?:" + "|".join([*V.PLACEHOLDER_TERMS, *map(re.escape, extra)]) + r")[\W_]*$"


def is_placeholder(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.coalesce(F.rlike(c, F.lit(placeholder_pattern(extra))), F.lit(False))


def blank_to_null(c: Column) -> Column:
    """Blank cells and placeholders become null."""
    return F.when((strip(c) == "") | is_placeholder(c), None).otherwise(c)


def tokens_to_null(c: Column, tokens: tuple[str, ...] = V.READER_NA) -> Column:
    return F.when(c.isin(*tokens), None).otherwise(c)


def western_digits(c: Column) -> Column:
    return F.translate(c, V.ARABIC_DIGITS, V.WESTERN_DIGITS)


def language(c: Column) -> Column:
    """ar, en, mixed or other."""
    ar, en = F.rlike(c, F.lit(V.ARABIC)), F.rlike(c, F.lit(V.ENGLISH))
    return F.when(ar & en, "mixed").when(ar, "ar").when(en, "en").otherwise("other")


# Arabic.

_MARKS = "\u0640\u200c\u200d\u200e\u200f\ufeff"


def arabic(c: Column) -> Column:
    """Drops diacritics and marks; one form for alef, teh marbuta and yeh."""
    return F.translate(_sub(c, r"[\u064B-\u0652\u0670]"), "أإآٱةى" + _MARKS, "ااااهي")


def arabic_plain(c: Column) -> Column:
    """Three alefs, teh marbuta, yeh; drops diacritics; strips."""
    return strip(_sub(F.translate(c, "أإآةى", "اااهي"), r"[\u064B-\u065F]"))


def arabic_sanitised(c: Column) -> Column:
    """As arabic(), and hamza carriers to their letters, single blanks."""
    return squeeze(F.translate(arabic(c), "ؤئ", "وي"))


def arabic_for_matching(c: Column) -> Column:
    return squeeze(F.translate(western_digits(c), "أإآٱةى", "ااااهي"))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode's compatibility composition; there is no built-in."""
    return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode(), na_action="ignore")


@F.pandas_udf(StringType())
def python_title(s: pd.Series) -> pd.Series:
    """Upper case after any non-letter; initcap() upper-cases after blanks only."""
    return s.str.title()


def arabic_library(c: Column, teh_marbuta_to: str = "ه") -> Column:
    """The full chain: NFKC, marks, diacritics, letters, hamza, blanks. teh_marbuta_to: ه or ت."""
    if teh_marbuta_to not in ("ه", "ت"):
        raise ValueError("teh_marbuta_to is ه or ت")
    c = _sub(_sub(_sub(nfkc(c), V.CONTROLS, " "), V.ZERO_WIDTH), "\u0640")
    return squeeze(F.translate(_sub(c, V.DIACRITICS), "أإآٱىؤئة", "ااااي" + "وي" + teh_marbuta_to))


def arabic_cleanup(c: Column) -> Column:
    return strip(_sub(_sub(nfkc(c), "\u0640"), V.DIACRITICS))


# English.

_EDGES = ".,;:!?\"'()[]{}"


def english(c: Column, title_like_python: bool = False) -> Column:
    """No punctuation at the ends, single blanks, capitalised words."""
    c = squeeze(F.btrim(c, F.lit(_EDGES)))
    return python_title(c) if title_like_python else F.initcap(c)


def english_sanitised(c: Column) -> Column:
    return F.lower(strip(_sub(c, r"(?U)[\W_]+", " ")))


def expand_contractions(c: Column) -> Column:
    return functools.reduce(lambda x, pair: _sub(x, "(?i)" + re.escape(pair[0]), pair[1]), V.CONTRACTIONS.items(), c)


def english_library(c: Column, case: str = "lower", contractions: bool = False, ascii_only: bool = True) -> Column:
    if case not in ("lower", "upper", "title", "none"):
        raise ValueError("case is lower, upper, title or none")
    c = _sub(nfkc(c), V.CONTROLS, " ")
    c = expand_contractions(c) if contractions else c
    c = squeeze(ascii_fold(c) if ascii_only else c)
    return {"lower": F.lower, "upper": F.upper, "title": F.initcap, "none": lambda x: x}[case](c)


# By language.


def normalised(c: Column, personal: bool = False) -> Column:
    """Arabic, English, or word by word where both occur; signs @#_? become blanks unless the cell is personal data."""
    v = c if personal else F.translate(c, "@#_?", "    ")
    word = lambda w: F.when(F.rlike(w, F.lit(V.ARABIC)), arabic(w)).when(F.rlike(w, F.lit(V.ENGLISH)), english(w)).otherwise(w)
    mixed = F.array_join(F.transform(F.split(squeeze(v), " "), word), " ")
    ar, en = F.rlike(v, F.lit(V.ARABIC)), F.rlike(v, F.lit(V.ENGLISH))
    # Each pattern is looked for when its turn comes; what english() gives is squeezed.
    return F.when(en & ~ar, english(v)).when(ar & en, squeeze(mixed)).when(ar, squeeze(arabic(v))).otherwise(squeeze(v))


def imputation_text(c: Column) -> Column:
    """Null where missing, else one form for matching."""
    return F.when(is_missing(c, V.IMPUTATION_MISSING), None).when(F.rlike(c, F.lit(V.ARABIC)), arabic_sanitised(c)).otherwise(english_sanitised(c))


def clean_text(c: Column, lang: str = "auto") -> Column:
    if lang not in ("auto", "ar", "en"):
        raise ValueError("lang is auto, ar or en")
    if lang == "auto":
        return F.when(F.rlike(c, F.lit(r"[\u0600-\u06FF]")), arabic_library(c)).otherwise(english_library(c))
    return arabic_library(c) if lang == "ar" else english_library(c)


def for_matching(c: Column) -> Column:
    """Lower case, no punctuation, single blanks; empty for null."""
    return F.coalesce(squeeze(_sub(F.lower(c), r"(?U)[^\w\s]")), F.lit(""))


def keywords(c: Column, least: int = 2) -> Column:
    """The distinct words of `least` characters or more, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) >= least))


def charset_normalised(c: Column) -> Column:
    """Letters of one form (hamza carriers to hamza), a fixed set of characters, lower case; empty becomes null. Without NFKC."""
    c = F.translate(_sub(_sub(c, V.CONTROLS), V.DIACRITICS), "أإآٱىةؤئ\u0640", "اااايهءء")
    return F.nullif(F.lower(squeeze(_sub(c, r"[^0-9A-Za-z\u0600-\u06FF\s.,@%+\-/]"))), F.lit(""))


def person_name(c: Column, title_like_python: bool = False) -> Column:
    """Names: single blanks, dashes and dots, a fixed set of characters, capitalised where most characters are ASCII."""
    c = _sub(_sub(_sub(arabic_cleanup(c), r"[\s\u00A0]+", " "), r"-{2,}", "-"), r"[._]{2,}", ".")
    c = _sub(c, r"(?U)[^\w\s\-.,]")
    mostly = F.length(_sub(c, r"[^\x00-\x7F]")) > 0.5 * F.greatest(F.length(c), F.lit(1))
    return F.nullif(strip(F.when(mostly, python_title(c) if title_like_python else F.initcap(c)).otherwise(c)), F.lit(""))


def clean_value(c: Column, normalise=None) -> Column:
    """Null becomes empty, stripped; then the caller's Column -> Column."""
    c = F.coalesce(strip(c), F.lit(""))
    return normalise(c) if normalise else c


def non_printing_dropped(c: Column) -> Column:
    return _sub(_sub(c, V.CONTROLS), V.ZERO_WIDTH)
