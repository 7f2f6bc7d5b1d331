"""Check digits and canonical forms, on values in Python and on columns natively."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ombra.functions.lexicons import CF_ODD, IBAN_LENGTHS, MONTHS, NOT_TELLING

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(digits))]
    return bool(digits) and sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def vat_valid(value: str) -> bool:
    """An eleven-digit VAT number has a Luhn check digit."""
    digits = "".join(value.split())
    return len(digits) == 11 and digits.isascii() and digits.isdigit() and luhn(digits)


def tax_code_valid(value: str) -> bool:
    """The last letter is the weighted sum of the first fifteen characters, modulo 26."""
    code = value.upper()
    if len(code) != 16 or any(c not in ALPHABET for c in code):
        return False
    number = [ALPHABET.index(c) for c in code]
    total = sum(CF_ODD[v] if n % 2 == 0 else v - 10 * (v > 9) for n, v in enumerate(number[:15]))
    return total % 26 == number[15] - 10


def iban_valid(value: str) -> bool:
    code = value.replace(" ", "").upper()
    if not 15 <= len(code) <= 34 or any(c not in ALPHABET for c in code):
        return False
    return int("".join(str(ALPHABET.index(c)) for c in code[4:] + code[:4])) % 97 == 1


def iban_shaped(value: str, by_country: bool = False) -> bool:
    code = value.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code):
        return False
    return not by_country or IBAN_LENGTHS.get(code[:2], len(code)) == len(code)


EDGE = r"[\s.,;:!?()\[\]{}\"'«»]+"


def base_key(value: str | None) -> str:
    """NFC, without punctuation at the ends, blanks as one; case stays."""
    text = unicodedata.normalize("NFC", value or "").strip()
    return " ".join(re.sub(f"^{EDGE}|{EDGE}$", "", text).split())


def full_year(year: int) -> int:
    return year if year >= 100 else year + (2000 if year < 70 else 1900)


MONTH_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
SPOKEN = re.compile(rf"(?:(\d{{1,2}})[\s°]?\s+)?({MONTH_NAMES})(?:\s+(\d{{2,4}}))?", re.IGNORECASE)
WRITTEN = re.compile(r"(\d{1,4})[/\-.](\d{1,2})(?:[/\-.](\d{1,4}))?")


def date_key(value: str | None) -> str:
    """YYYY-MM-DD with ? for what isn't said, or the value's base key if it is no date."""
    text = base_key(value)
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", text):
        return f"{int(m[1]):04d}-{int(m[2]):02d}-{int(m[3]):02d}"
    if m := WRITTEN.fullmatch(text):
        first, second = int(m[1]), int(m[2])
        if m[3]:
            return f"{full_year(int(m[3])):04d}-{second:02d}-{first:02d}"
        return f"{second:04d}-{first:02d}-??" if first <= 12 and second > 31 else f"????-{second:02d}-{first:02d}"
    if m := SPOKEN.fullmatch(text):
        year = f"{full_year(int(m[3])):04d}" if m[3] else "????"
        return f"{year}-{MONTHS[m[2].lower()]:02d}-" + (f"{int(m[1]):02d}" if m[1] else "??")
    return text


def key_of(value: str, kind: str) -> str:
    return date_key(value) if kind == "DATA" else base_key(value)


#: Legal forms that don't tell organisations apart.
LEGAL_FORMS = re.compile(
    r"\b(?:s\.?\s*p\.?\s*a\.?|s\.?\s*r\.?\s*l\.?s?|s\.?\s*n\.?\s*c\.?|s\.?\s*a\.?\s*s\.?|s\.?\s*c\.?|onlus|aps|odv|ets"
    r"|s\.?\s*coop\.?|societa|società|impresa|ltd|llc|inc|corp|gmbh|ag|plc)\b"
)


def telling_tokens(value: str, kind: str) -> list[str]:
    """The words that tell persons or organisations apart; nothing for other types."""
    text = base_key(value).lower()
    if kind == "PERSONA":
        return [t for t in (w.strip(".") for w in text.split()) if t and t not in NOT_TELLING]
    if kind == "ORG":
        return [t for t in re.split(r"\s+|[&.,]+", LEGAL_FORMS.sub(" ", text)) if t]
    return []


# -- native forms


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_column(value: Column) -> Column:
    """Luhn on the digits of a value."""
    return F.call_function("luhn_check", digits_of(value))


def vat_column(value: Column) -> Column:
    compact = F.regexp_replace(value, r"\s", "")
    return compact.rlike("^[0-9]{11}$") & F.call_function("luhn_check", compact)


def number_of(char: Column) -> Column:
    """The place of a character in 0-9A-Z, from 0; -1 if it isn't there."""
    return F.call_function("locate", char, F.lit(ALPHABET)) - 1


def tax_code_column(value: Column) -> Column:
    """The check of a tax code as a fold over its first fifteen characters."""
    code = F.upper(value)
    odd = F.array(*map(F.lit, CF_ODD))

    def step(total: Column, i: Column) -> Column:
        v = number_of(F.substring(code, i, F.lit(1)))
        even = F.when(v > 9, v - 10).otherwise(v)
        return total + F.when(i % 2 == 1, F.get(odd, v)).otherwise(even)

    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), step)
    return F.when(code.rlike("^[A-Z0-9]{16}$"), total % 26 == number_of(F.substring(code, 16, 1)) - 10).otherwise(F.lit(False))


def iban_column(value: Column) -> Column:
    """Modulo 97 of the rotated number, digit by digit."""
    code = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    rotated = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        v = number_of(char)
        return F.when(v > 9, (rest * 100 + v) % 97).otherwise((rest * 10 + v) % 97)

    chars = F.filter(F.split(rotated, ""), lambda c: c != "")
    return F.when(code.rlike("^[A-Z0-9]{15,34}$"), F.aggregate(chars, F.lit(0), step) == 1).otherwise(F.lit(False))


def date_key_column(value: Column) -> Column:
    """``date_key`` without the Unicode normalisation of values that are no dates."""
    text = F.trim(F.regexp_replace(F.regexp_replace(value, f"^{EDGE}|{EDGE}$", ""), r"\s+", " "))
    two = lambda c: F.lpad(c, 2, "0")
    part = lambda p, n: F.regexp_extract(text, p, n)
    year = lambda c: F.when(F.length(c) <= 2, F.when(c.cast("int") < 70, F.concat(F.lit("20"), two(c))).otherwise(F.concat(F.lit("19"), two(c)))).otherwise(F.lpad(c, 4, "0"))
    iso, full, short = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{1,4})$", r"^(\d{1,4})[/\-.](\d{1,2})$"
    spoken = rf"(?i)^(?:(\d{{1,2}})[\s°]?\s+)?({MONTH_NAMES})(?:\s+(\d{{2,4}}))?$"
    month = F.create_map(*(F.lit(x) for name, n in MONTHS.items() for x in (name, f"{n:02d}")))
    day_first = F.concat(F.lit("????-"), two(part(short, 2)), F.lit("-"), two(part(short, 1)))
    return (
        F.when(text.rlike(iso), F.concat_ws("-", part(iso, 1), two(part(iso, 2)), two(part(iso, 3))))
        .when(text.rlike(full), F.concat_ws("-", year(part(full, 3)), two(part(full, 2)), two(part(full, 1))))
        .when(text.rlike(short), F.when((part(short, 1).cast("int") <= 12) & (part(short, 2).cast("int") > 31), F.concat(F.lpad(part(short, 2), 4, "0"), F.lit("-"), two(part(short, 1)), F.lit("-??"))).otherwise(day_first))
        .when(text.rlike(spoken), F.concat_ws("-", F.when(part(spoken, 3) == "", F.lit("????")).otherwise(year(part(spoken, 3))), F.try_element_at(month, F.lower(part(spoken, 2))), F.when(part(spoken, 1) == "", F.lit("??")).otherwise(two(part(spoken, 1)))))
        .otherwise(text)
    )
