"""Column functions against literal expectations on invented text."""

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import names as N
from noticeloom.functions import text as T
from noticeloom.functions import values as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: T.filing_number(F.lit(" ab-0 1.2_")), "AB012"),
        (lambda: T.filing_number(F.lit(" .- ")), None),
        (lambda: T.reuse_key(F.lit("12  Elm st., #4")), "12 ELM ST 4"),
        (lambda: T.clean_address(F.lit("508E  Hawk Ave.,")), "508 E Hawk Ave"),
        (lambda: T.street_term(F.lit("700 W La Plata Dr Weslaco, Texas 78596")), "700 La Plata Dr"),
        (lambda: T.street_term(F.lit("12 Mesquite, Weslaco, TX 78596")), "12 Mesquite"),
        (lambda: T.subdivision_term(F.lit("Oak Ridge Estates")), "Oak Ridge"),
        (lambda: T.subdivision_term(F.lit(" ESTATES")), " ESTATES"),
        (lambda: T.legal_cache_key(F.lit("Oak, Ridge"), F.lit("1"), F.lit(None).cast("string"), F.lit("x")), "SUBDIVISION:OAK RIDGE|LOT:1|BLOCK:"),
        (lambda: T.legal_cache_key(F.lit(None).cast("string"), F.lit("1"), F.lit("2"), F.lit(" a  b ")), "RAWTEXT:A B"),
        (lambda: T.search_text(F.lit("Lot 1 (partly illegible) A/B")), "Lot 1 A B"),
        (lambda: T.search_text(F.lit("#")), None),
        (lambda: T.barcode_number(F.lit(" VG-1-2026-0042 ")), "0042"),
        (lambda: T.name_variant(F.lit("Núñez,  josé")), "NUNEZ JOSE"),
        (lambda: T.is_prefix_truncation(F.lit("ANA B"), F.lit("ana belt")), True),
        (lambda: V.currency_cents(F.lit("sum of $1,234.50 due")), 123450),
        (lambda: V.currency_cents(F.lit("$0")), None),
        (lambda: V.first_date(F.lit("on 1/2/2024 or March 5, 2023")), "2023-03-05"),
        (lambda: V.first_date(F.lit("13/40/2024")), None),
        (lambda: V.labeled_time(F.lit("Time of Sale: 1:05 pm"), [r"(?i)Time of Sale:?"]), "1:05 PM"),
        (lambda: F.date_format(V.sale_month(F.lit("AUGUST-4-2026-PROPERTY-SALE")), "yyyy-MM-dd"), "2026-08-04"),
        (lambda: V.sale_month(F.lit("FEBRUARY-31-2026-PROPERTY-SALE")), None),
        (lambda: V.half_up(F.lit(-2.5)), -2),
        (lambda: V.confidence_band(F.lit(0.6)), "medium"),
        (lambda: V.equity_bucket(F.lit(7_500_000)), "25k_to_75k"),
        (lambda: V.plausible_principal(F.lit(99_999)), None),
        (lambda: V.seed_hash(F.lit("ab")), 97 * 31 + 98),
        (lambda: N.surnames_match(F.lit("Ana Belt"), F.lit("BELT, CARL")), True),
        (lambda: N.surnames_match(F.lit("Ana Belt"), F.lit("BELT FAMILY TRUST")), True),
        (lambda: N.related(F.lit("Ana B. Belt"), F.lit("BELT ANA B")), True),
        (lambda: N.related(F.lit("Ana Belt"), F.lit("Carl Belt")), False),
        (lambda: N.related(F.lit("OSCAR ILL"), F.lit("0SCAR 1LL")), True),
        (lambda: N.is_party(F.lit("Summit Bank, N.A.")), True),
        (lambda: N.is_party(F.lit("Sent to the Bank")), False),
        (lambda: N.is_party(F.lit("Current Mortgagee")), False),
    ],
)
def test_scalar(spark, column, want):
    assert value(spark, column()) == want


def test_names(spark):
    assert value(spark, N.split_names(F.lit("CARL DOVE, Jr., A SINGLE PERSON, AND ANA BELT,"))) == ["CARL DOVE, Jr.", "ANA BELT"]
    assert value(spark, N.people(F.lit("BELT, ANA & CARL"))) == ["ANA BELT", "CARL BELT"]
    assert value(spark, N.wrapped_name(F.lit("ANA D."), F.lit("\nBELT AND CARL DOVE\nDate: x"))) == "ANA D. BELT AND CARL DOVE"
    assert value(spark, N.wrapped_name(F.lit("ANA D."), F.lit("\nDate: x"))) == "ANA D."
    assert value(spark, V.all_currency_cents(F.lit("$1 then $ 2.50, $0"))) == [100, 250]


def test_nulls_stay_null(spark):
    none = F.lit(None).cast("string")
    for column in (T.filing_number(none), T.clean_address(none), V.currency_cents(none), V.first_date(none), T.search_text(none)):
        assert value(spark, column) is None
    assert value(spark, T.overlap(none, F.lit("a"))) is False


def test_needed_texts_are_in_every_match():
    """On Python's own matches of patterns and texts; what may be left out is not needed."""
    import random
    import re

    cases = {
        r"(?i)Date of Sale:?[^\n]+": ("date of sale",), r"(?i)(?:Grant(?:o|0)r|Trustor)s?:": ("grant", "trustor"), r"(?i)(?:abc)?x\d+": (), r"(?:abc)+\s*de": ("abc",), r"a|bcd": (), r"(?:ab|cde)\s+f?": ("ab", "cde"),
        r"(?i)Note:?\s*[\s\S]{0,9}?DOLLARS": ("dollars",), r"[abc]{3}": (), r"(?<=lead)er": ("er",),
    }
    for pattern, want in cases.items():
        assert T.needed(pattern) == want
    rng = random.Random(1)
    bits = ["Date of Sale", "DATE OF SALE:", "Grantor", "GRANT0Rs:", "trustor:", "x12", "abcabc de", "bcd", "cde  f", "Note", "dollars", "aab", "leader", " ", "\n", "7"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(5))
        for pattern, want in cases.items():
            if want and re.search(pattern, text):
                assert any(w in text.lower() for w in want)
