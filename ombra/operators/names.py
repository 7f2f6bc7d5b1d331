"""Names of persons from dictionaries, in three strengths.

Certain: a known name that is no common word, a known pair, or a known name after a phrase that
only a name follows. Confirmed: an ambiguous name or a lone surname after a title, a greeting or a
closing formula. Suggested: what remains, shown to the user but never replaced.
"""

from __future__ import annotations

import re

from ombra.config import Dictionaries
from ombra.functions import lexicons as L
from ombra.operators.detect import Span

LETTER = "A-Za-zÀ-ÿ"
CAPITALISED = re.compile(rf"(?<![{LETTER}])[A-ZÀÁÈÉÌÍÒÓÙÚ][a-zà-ÿ]{{2,29}}(?![{LETTER}])")
ANY_CASE = re.compile(rf"(?<![{LETTER}])(?:[a-zà-ÿ][a-zà-ÿ']{{2,29}}|[A-ZÀÁÈÉÌÍÒÓÙÚ][a-zà-ÿ]{{2,29}})(?![{LETTER}])")
PARTICLE = re.compile(rf"(?<![{LETTER}])(?:{'|'.join(sorted(L.SURNAME_PARTICLES - {'van', 'von', 'der'}, key=len, reverse=True))}|d'|l'|dell'|dall'|nell'|sull'|all')(?![{LETTER}])", re.IGNORECASE)

#: Phrases before a name.
TITLES = (
    r"il\s+signor|la\s+signora|la\s+signorina|signor|signora|signorina|sig\.?|sig\.?ra|sig\.?na|dott\.?|dott\.?ssa|dott\.?sa"
    r"|dottor|dottore|dottoressa|dr\.?|ing\.?|ingegner|arch\.?|architetto|avv\.?|avvocato|avvocata|geom\.?|geometra|prof\.?"
    r"|professor|professore|professoressa|rag\.?|ragionier|ragioniera"
)
PARTIES = r"il\s+cliente|la\s+cliente|il\s+fornitore|il\s+collega|il\s+paziente"
MORE_PARTIES = PARTIES + r"|la\s+fornitrice|la\s+collega|la\s+paziente"
SELF = r"sono|qui\s+è|qui\s+e|parla|vi\s+scrivo|ti\s+scrivo|sono\s+io|scrivo\s+io"
FROM = r"sono\s+stato\s+contattato\s+da|contattato\s+da|da\s+parte\s+di|risposta\s+da|inoltrata\s+da"
DEAR = r"gentile|gentilissima|gentilissimo|caro|cara|carissimo|carissima|egregio|egregia|spett\.?le|spettabile"
HELLO = r"buongiorno|buonasera|buon\s+pomeriggio|salve|ciao"
LINE = r"(?:^|\n)(?:\s*[-•]\s*)?"
CLOSING = re.compile(
    r"(?:cordiali\s+saluti|distinti\s+saluti|un\s+saluto|un\s+abbraccio|a\s+presto|saluti|grazie\s+e\s+saluti|cordialmente"
    r"|con\s+i\s+migliori\s+saluti)[\s,.:!]*\n[\s\-—]*",
    re.IGNORECASE,
)
UNAMBIGUOUS = re.compile(rf"\b(?:mi\s+chiamo|il\s+mio\s+nome\s+è|il\s+mio\s+nome\s+e|nome:?|cognome:?|{TITLES}|{PARTIES})\b[\s,:.]+|{LINE}(?:{DEAR})[\s,]+", re.IGNORECASE)
AMBIGUOUS = re.compile(rf"\b(?:{SELF}|{FROM})\b[\s,:]+|{LINE}(?:{HELLO})[\s,]+", re.IGNORECASE)
#: Contexts that end right before a name.
STRONG = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"\b(?:{SELF}|mi\s+chiamo|presento|ti\s+presento|vi\s+presento|{FROM})\b[\s,:]+",
        rf"{LINE}(?:{DEAR}|{HELLO})[\s,]+",
        rf"\b(?:{TITLES}|{MORE_PARTIES})\s+",
    )
)
#: Verbs whose object, or whose "da", is a person.
TRIGGER = re.compile(
    r"\b(?:(?:vado|vai|va|andiamo|andate|vanno|passo|passi|passa|passiamo|passato|passata|passati|vediamo|vediamoci|rivediamo"
    r"|sto|stai|sta|stiamo|state|stanno|resto|resti|resta|restiamo|ceno|ceni|cena|ceniamo|pranzo|pranzi|pranza|pranziamo"
    r"|dormo|dormi|dorme|dormiamo|torno|torni|torna|torniamo)\s+da"
    r"|viene|vengono|verrà|verranno|veniva|venivano|arriva|arrivano|arriverà|arriveranno|arrivava|chiama|chiamo|chiami|chiamate"
    r"|chiamerò|richiama|richiamo|avvisa|avviso|avvisate|avvisiamo|saluta|salutami|salutate|salutatemi|invita|invito|invitiamo"
    r"|invitate|aspetta|aspetto|aspettiamo|aspettate|incontro|incontri|incontriamo|incontrate|sento|senti|sentiamo|sentite"
    r"|conosco|conosci|conosciamo|conoscete|porto|porti|portiamo|portate|c'è|c'era|chiedo|chiedi|chiedete|chiediamo)\s+",
    re.IGNORECASE,
)
ELISIONS = frozenset("all dell sull dall nell un d l".split())
BLANKS = re.compile(r"[ \t]*")


def sentence_start(text: str, at: int) -> bool:
    before = text[:at].rstrip(" \t\r") if at < 400 else text[at - 400 : at].rstrip(" \t\r")
    return not before or before[-1] in ".!?\n"


def goes_on_plainly(text: str, end: int, known: Dictionaries) -> bool:
    """Whether an elision or a common word that is no name follows."""
    word = re.compile(rf"[ \t]*((?:[^\W\d_]|')*)").match(text, end)[1].lower()
    if word.split("'")[0] in ELISIONS:
        return True
    word = word.rstrip("'")
    return bool(word) and known.common(word) and word not in known.names and word not in known.surnames


def plausible_surname(token: str, known: Dictionaries) -> bool:
    if token in L.SURNAME_PARTICLES:
        return True
    if len(token) < 3 or not token.replace("'", "").isalpha() or token in L.NOT_SURNAMES or token in L.EXCLUDED_FORMULAS:
        return False
    return known.known(token) or token not in known.vocabulary


def strong_context(text: str, at: int) -> bool:
    """Whether a title, greeting, presentation or closing formula stands right before ``at``."""
    short, long_ = text[max(0, at - 40) : at], text[max(0, at - 200) : at]
    last = lambda p, s: max((m.end() for m in p.finditer(s)), default=-9)
    return any(last(p, short) >= len(short) - 1 for p in STRONG) or last(CLOSING, long_) >= len(long_) - 3


def final_signature(text: str, at: int) -> bool:
    return at >= len(text) - 60 and bool(CLOSING.search(text[max(0, at - 200) : at]))


def name_word(word: str, known: Dictionaries, after_name: bool) -> str:
    """What a word does in a name: p is a particle, k a known or likely name, u a word that only a particle lets in, x ends it."""
    if word in L.EXCLUDED_FORMULAS:
        return "x"
    if word in L.SURNAME_PARTICLES or word.endswith("'"):
        return "p"
    if known.known(word) or (after_name and plausible_surname(word, known)):
        return "k"
    return "u" if len(word) >= 3 and word.replace("'", "").isalpha() and word not in L.NOT_SURNAMES else "x"


def after_context(text: str, at: int, known: Dictionaries, sure: bool) -> tuple[int, int] | None:
    """The name that starts at ``at``: a known first word, and of the next three those that names and particles are made of."""
    first = ANY_CASE.match(text, BLANKS.match(text, at).end())
    low = first[0].lower() if first else ""
    if not known.known(low) or low in L.EXCLUDED_FORMULAS or not (sure or low not in known.vocabulary):
        return None
    ends, shape = [first.end()], ""
    while len(shape) < 3:
        start = BLANKS.match(text, ends[-1]).end()
        if not (word := PARTICLE.match(text, start) or ANY_CASE.match(text, start)):
            break
        ends.append(word.end())
        shape += name_word(word[0].lower(), known, known.name(low))
    return first.start(), ends[re.match("(?:k|p+u?)*", shape).end()]


def name_spans(text: str, known: Dictionaries) -> list[Span]:
    if not known.names or not text.strip():
        return []
    found: dict[tuple[int, int], float] = {}
    for pattern, sure in ((UNAMBIGUOUS, True), (AMBIGUOUS, False)):
        for m in pattern.finditer(text):
            if span := after_context(text, m.end(), known, sure):
                found.setdefault(span, 0.85)
    for m in TRIGGER.finditer(text):
        word = ANY_CASE.match(text, m.end())
        if word and (low := word[0].lower()) not in L.EXCLUDED_FORMULAS | L.NEVER_LOWER_NAMES and known.name(low) and low not in known.ambiguous_names:
            found.setdefault(word.span(), 0.75)
    out = [Span("IT_NOME_COGNOME", *span, score, "names") for span, score in found.items()]
    return out + capitalised(text, known)


#: How sure a capitalised word is a name, and the entity and score of each.
LEVELS = {"certain": ("IT_NOME_COGNOME", 0.8), "confirmed": ("IT_NOME_COGNOME", 0.7), "suggested": ("IT_NOME_SUGGERITO", 0.35)}


def level(text: str, start: int, end: int, known: Dictionaries) -> str | None:
    """The level of a capitalised word that stands by itself; none for words that aren't names, or are too common."""
    low = text[start:end].lower()
    name = known.name(low)
    if not name and not known.surname(low):
        return None
    if name and low not in known.ambiguous_names:
        opens = low in known.vocabulary and sentence_start(text, start) and goes_on_plainly(text, end, known)
        return "suggested" if opens else "certain"
    if strong_context(text, start) or final_signature(text, start):
        return "confirmed"
    return None if low in known.wide_vocabulary else "suggested"


def capitalised(text: str, known: Dictionaries) -> list[Span]:
    """Pairs of a name and another known word, and single words by their level."""
    out: list[Span] = []
    found = [m.span() for m in CAPITALISED.finditer(text)]
    low = [text[a:b].lower() for a, b in found]
    n = 0
    while n < len(found):
        (a, b), follows = found[n], n + 1 < len(found) and text[found[n][1] : found[n + 1][0]] == " "
        if low[n] not in L.EXCLUDED_FORMULAS:
            if follows and known.name(low[n]) and known.known(low[n + 1]):
                out.append(Span("IT_NOME_COGNOME", a, found[n + 1][1], 0.85, "names"))
                n += 1
            elif sure := level(text, a, b, known):
                kind, score = LEVELS[sure]
                out.append(Span(kind, a, b, score, "names"))
        n += 1
    return out
