"""A small dictionary and generated identifiers for the tests."""

import random

from ombra.config import Config, Dictionaries
from ombra.functions.lexicons import ALL_CATEGORIES, CF_ODD
from ombra.functions.validators import ALPHABET, luhn

KNOWN = Dictionaries(
    names=frozenset("mario marco giovanni luisa anna rosa giuseppe giulia paolo serena".split()),
    ambiguous_names=frozenset("rosa serena".split()),
    surnames=frozenset("rossi bianchi verdi esposito ferrari".split()),
    ambiguous_surnames=frozenset(("verdi", "bianchi")),
    vocabulary=frozenset("casa rosa serena verdi bianchi marco il lavoro strada contratto oggi".split()),
    wide_vocabulary=frozenset("casa rosa verdi bianchi".split()),
    municipalities=frozenset(("milano", "roma", "reggio emilia")),
)
CONFIG = Config(dictionaries=KNOWN)
EVERYTHING = Config(dictionaries=KNOWN, categories=ALL_CATEGORIES, trace=True)


def tax_code(rng: random.Random) -> str:
    letters = lambda n: "".join(rng.choice("BCDFGLMNPRSTVZ") for _ in range(n))
    body = f"{letters(6)}{rng.randrange(100):02d}{rng.choice('ABCDEHLMPRST')}{rng.randrange(1, 72):02d}{rng.choice('ABCDEFGHIL')}{rng.randrange(1000):03d}"
    number = [ALPHABET.index(c) for c in body]
    return body + ALPHABET[10 + sum(CF_ODD[v] if n % 2 == 0 else v - 10 * (v > 9) for n, v in enumerate(number)) % 26]


def with_luhn(body: str) -> str:
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def vat(rng: random.Random) -> str:
    return with_luhn(f"{rng.randrange(10**9, 10**10)}")


def card(rng: random.Random) -> str:
    return with_luhn("4" + f"{rng.randrange(10**14):014d}")


def iban(rng: random.Random) -> str:
    body = f"{rng.choice('ABCDEFG')}{rng.randrange(10**10):010d}{rng.randrange(10**12):012d}"
    digits = "".join(str(ALPHABET.index(c)) for c in body + "IT00")
    return f"IT{98 - int(digits) % 97:02d}{body}"
