"""Functions of columns on small inputs with known outputs."""

import pytest
from pyspark.sql import functions as F

from cleanloom.functions import dates, numeric
from cleanloom.functions import text as T


def run(spark, f, values):
    rows = [(i, v) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(got, key=lambda r: r["i"])]


def test_numbers(spark):
    cases = {"1500 ج.م": 1500.0, "$250.50": 250.5, "3000 EGP": 3000.0, "1,234.56": 1234.56, "999 USD": 999.0, "(42)": -42.0, "(-7)": -7.0, "12%": 0.12, "1.5K": 1500.0, "٣٤": 34.0, "x": None, "": None, None: None, "12 kg": 12000.0}
    assert run(spark, numeric.mixed_number, list(cases)) == list(cases.values())
    assert run(spark, lambda c: numeric.mixed_number(c, strict_suffix=True), ["12 kg", "3K", "5 boxes"]) == [12.0, 3000.0, 5.0]


def test_phones(spark):
    cases = {"00201112345678": "+201112345678", "+201012345678": "+201012345678", "01012345678": "", "0512345678": "+966512345678", "966512345678": "+966512345678", "12": "", None: "", "+14155552671": "+14155552671"}
    assert run(spark, numeric.phone, list(cases)) == list(cases.values())
    assert run(spark, lambda c: numeric.phone(c, compat=False), ["01012345678"]) == ["+201012345678"]


def test_dates(spark):
    cases = {"2024-02-03": "2024-02-03", "15/03/2020": "2020-03-15", "3/15/2020": "2020-03-15", "45292": "2024-01-01", "2026-02-30": None, "12 مارس 2024": "2024-03-12", "January 5, 2023": "2023-01-05", "x": None, "": None, None: None}
    assert [str(d) if d else None for d in run(spark, dates.parse, list(cases))] == list(cases.values())


def test_date_cells(spark):
    got = run(spark, lambda c: dates.clean_cell(c, 2025), ["تم التسليم في 2024-09-22", "N/A", "تم الشحن 27\\7\\2024", "01/01/224", "15-03-124", "2024-08-25", "2024-01-15 14:30:00", None, ""])
    assert [(str(r["date"]) if r["date"] else None, r["action"]) for r in got] == [
        ("2024-09-22", "Extracted Embedded Date"), (None, "Coerced Text to Null"), ("2024-07-27", "Extracted Embedded Date"), ("2024-01-01", "Corrected Year Typo"), ("2024-03-15", "Corrected Year Typo"),
        ("2024-08-25", ""), ("2024-01-15", "Stripped Time"), (None, ""), (None, ""),
    ]


def test_bounds(spark):
    assert run(spark, lambda c: dates.bound_failure(c, "2025-01-01"), ["2050-01-01", "1850-05-05", "x", "2020-01-01", None]) == ["future", "ancient", "invalid", None, None]


@pytest.mark.parametrize(("before", "after"), [("هبَة", "هبه"), ("فاطمـــة", "فاطمه"), ("سؤال", "سوال"), ("أحمد", "احمد"), ("موسى", "موسي")])
def test_arabic(spark, before, after):
    assert run(spark, T.arabic_sanitised, [before]) == [after]


def test_arabic_plain(spark):
    assert run(spark, T.arabic_plain, ["أسد", "إسلام", "آخر", "كنبة"]) == ["اسد", "اسلام", "اخر", "كنبه"]
    with pytest.raises(ValueError):
        T.arabic_library(F.lit("x"), "x")


def test_english(spark):
    assert run(spark, T.english, ["(new   YORK).", "o'neil new-york 3rd", None]) == ["New York", "O'neil New-york 3rd", None]
    assert run(spark, lambda c: T.english(c, True), ["o'neil new-york 3rd"]) == ["O'Neil New-York 3Rd"]
    assert run(spark, T.expand_contractions, ["can't", "it's"]) == ["cannot", "it is"]


def test_language_and_missing(spark):
    assert run(spark, T.language, ["abc", "سلام", "abc سلام", "12", "", None]) == ["en", "ar", "mixed", "other", "other", "other"]
    assert run(spark, T.is_missing, [" N/A ", "غير محدد", "x", None, ""]) == [True, True, False, True, True]
    assert run(spark, T.blank_to_null, ["**missing**", "ok", " "]) == [None, "ok", None]
    assert run(spark, T.nfkc, ["ﬁ", None]) == ["fi", None]
