import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ombra.functions import text as X
from ombra.functions import validators as C
from tests.helpers import KNOWN, card, iban, tax_code, vat

RNG = random.Random(4)
VALID = [(C.tax_code_valid, tax_code), (C.vat_valid, vat), (C.iban_valid, iban)]


@pytest.mark.parametrize("check, make", VALID)
def test_valid_values_pass_and_one_wrong_character_fails(check, make):
    for _ in range(50):
        value = make(RNG)
        assert check(value) and check(value.lower())
        at = len(value) - 1
        other = chr(ord(value[at]) + 1) if value[at] not in "9Z" else ("0" if value[at] == "9" else "A")
        assert not check(value[:at] + other)


def test_known_numbers():
    assert C.vat_valid("01234567897") and C.vat_valid("01234 56789 7") and not C.vat_valid("01234567890")
    assert C.iban_valid("IT60 X054 2811 1010 0000 0123 456") and not C.iban_valid("IT60X05428111010000001234567")
    assert C.iban_shaped("DE89370400440532013001") and not C.iban_shaped("DE8937040044053201300", by_country=True)
    assert C.luhn("4111111111111111") and not C.luhn("") and not C.luhn("4111111111111112")
    assert not C.tax_code_valid("RSSMRA85T10A562") and C.tax_code_valid("RSSMRA85T10A562S")


DATES = [
    ("19 giugno 2026", "2026-06-19"), ("19/06/2026", "2026-06-19"), ("2026-06-19", "2026-06-19"), ("giugno 2026", "2026-06-??"),
    ("4 giugno", "????-06-04"), ("4.6.26", "2026-06-04"), ("1/2/71", "1971-02-01"), ("«12 mar 1980»,", "1980-03-12"),
    ("06/40", "0040-06-??"), ("31/12", "????-12-31"), ("non una data", "non una data"), ("", ""), ("5 Sett 99", "1999-09-05"),
]


@pytest.mark.parametrize("value, key", DATES)
def test_date_keys(value, key):
    assert C.date_key(value) == key


def test_native_twins(spark):
    from pyspark.sql import functions as F

    values = [make(RNG) for _, make in VALID for _ in range(20)] + [card(RNG) for _ in range(10)]
    values += [v[:-1] + "1" for v in values] + ["", "IT", "è" * 16, "0" * 11, "A" * 16, "IT60 X054 2811 1010 0000 0123 456"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    out = rows.select("v", C.tax_code_column(F.col("v")).alias("t"), C.vat_column(F.col("v")).alias("p"), C.iban_column(F.col("v")).alias("i"))
    for r in out.collect():
        assert (r.t, r.p, r.i) == (C.tax_code_valid(r.v), C.vat_valid(r.v), C.iban_valid(r.v)), r.v
    dates = spark.createDataFrame([(v, k) for v, k in DATES], "v string, k string").select("k", C.date_key_column(F.col("v")).alias("g"))
    assert all(r.k == r.g for r in dates.collect())


def test_telling_tokens():
    assert C.telling_tokens("Dott. Mario Rossi", "PERSONA") == ["mario", "rossi"]
    assert C.telling_tokens("Edilservice S.p.A.", "ORG") == ["edilservice"] and C.telling_tokens("x", "CF") == []


@given(st.text(max_size=300), st.integers(1, 40))
def test_blocks_join_to_the_text(text, size):
    parts = list(X.blocks(text, size))
    assert "".join(b for _, b in parts) == text and all(text[a : a + len(b)] == b and len(b) <= size for a, b in parts)


@given(st.text(max_size=200))
def test_truecasing_keeps_length(text):
    assert len(X.truecase(text, KNOWN)) == len(text)


def test_truecasing_and_language():
    assert X.truecase("ciao. sono mario di bianchi e vado a milano", KNOWN) == "Ciao. Sono Mario Di Bianchi e vado a Milano"
    assert X.truecase("ﬁne. ßa", KNOWN) == "ﬁne. ßa"
    assert [X.language(t) for t in ("il cane", "the dog is here", "perché the", "xyz", "")] == ["it", "en", "it", "it", "it"]
    assert X.mostly_lower("sono mario e vado") and not X.mostly_lower("Ciao Mario Rossi")


def test_noise(spark):
    from pyspark.sql import functions as F

    noisy = ["", "APPRESA", "A B C", "main.py", "snake_case", "camelCase", "AB-12", "ab", "casa", "Google", "PDFfile"]
    assert all(X.is_noise(v, KNOWN) for v in noisy) and not any(X.is_noise(v, KNOWN) for v in ("Mario", "MARIO ROSSI", "Gildo Ndiaye"))
    rows = spark.createDataFrame([(v,) for v in noisy if v != "casa"] + [("Gildo Ndiaye",)], "v string").select("v", X.noise_column(F.col("v")).alias("n"))
    assert {r.v for r in rows.collect() if not r.n} == {"Gildo Ndiaye"}
    assert X.looks_binary("\x00\x01\x02abc") and not X.looks_binary("abc\n\t")
