"""Queries over Italian texts with planted values, and the SQL that says where each one stands.

A template is a text with marks: ``{TYPE=value}`` plants a constant, ``{TYPE~expression}`` an
expression over the key ``n`` of a row, and ``{~expression}`` a part that nothing may find. Each row
of a table gets the template whose turn its key is. The query runs the engine's own analysis over
the texts; the SQL adds up the lengths of the parts, and knows nothing of patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ombra.config import Config, Dictionaries
from ombra.functions.lexicons import ALL_CATEGORIES
from ombra.plans.anonymise import analysed
from ombra.plans.shared import spread

MARK = re.compile(r"\{([A-Za-z_]*)([=~])([^}]*)\}")
#: A small dictionary for the rules that need one.
WORDS = Dictionaries(
    names=frozenset("mario marco giovanni luisa anna rosa giuseppe giulia paolo serena andrea".split()),
    ambiguous_names=frozenset("rosa serena".split()),
    surnames=frozenset("rossi bianchi verdi esposito ferrari".split()),
    ambiguous_surnames=frozenset(("verdi", "bianchi")),
    vocabulary=frozenset("casa rosa serena verdi bianchi marco il lavoro strada contratto oggi".split()),
    wide_vocabulary=frozenset("casa rosa verdi bianchi".split()),
    municipalities=frozenset(("milano", "roma", "torino", "reggio emilia")),
)
EVERYTHING = Config(categories=ALL_CATEGORIES, dictionaries=WORDS, all_languages=True)


@dataclass(frozen=True)
class Planted:
    """What is planted, and what of the analysis is compared: accepted spans, suggested ones, or dropped ones by reason."""

    templates: tuple[str, ...]
    config: Config = EVERYTHING
    part: str = "spans"
    #: Only these types or reasons are compared; all, if none are given.
    only: tuple[str, ...] = ()
    table: str = "customer"
    key: str = "c_custkey"


def parts(template: str) -> list[tuple[str | None, str, bool]]:
    """(type or None, text or expression, whether it is an expression) of a template, in order."""
    out, at = [], 0
    for m in MARK.finditer(template):
        out.append((None, template[at : m.start()], False))
        out.append((m[1] or None, m[3], m[2] == "~"))
        at = m.end()
    out.append((None, template[at:], False))
    return [p for p in out if p[1]]


def six(shift: int = 0) -> str:
    """The key as six digits, in Spark's SQL and DuckDB's."""
    return f"lpad(cast(n + {shift} as string), 6, '0')"


def text_of(planted: Planted) -> Column:
    texts = [F.concat(*(F.expr(x) if expression else F.lit(x) for _, x, expression in parts(t))) for t in planted.templates]
    chosen = F.lit(None).cast("string")
    for n, text in enumerate(texts):
        chosen = F.when(F.col("n") % len(texts) == n, text).otherwise(chosen)
    return chosen


def query(planted: Planted) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(spark.read.parquet(f"{sf_dir}/{planted.table}.parquet")).select(F.col(planted.key).alias("n"))
        found = rows.select("n", analysed(text_of(planted), replace(planted.config, trace=planted.part == "dropped")).alias("f"))
        each = found.select("n", F.explode(f"f.{planted.part}").alias("s"))
        if planted.part == "dropped":
            each = each.select("n", F.col("s.reason").alias("kind"), F.col("s.span").alias("s"))
        else:
            each = each.select("n", F.col("s.type").alias("kind"), "s")
        if planted.only:
            each = each.where(F.col("kind").isin(*planted.only))
        return each.select("n", "kind", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.value").alias("value"))

    return run


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(planted: Planted) -> str:
    """The planted spans: each part of a type stands after the parts before it."""
    selects = []
    for turn, template in enumerate(planted.templates):
        before = []
        for kind, x, expression in parts(template):
            value = f"({x})" if expression else quoted(x)
            if kind:
                start = " + ".join(["0", *before])
                selects.append(f"SELECT n, {quoted(kind)} AS kind, {start} AS s, {value} AS value FROM k WHERE n % {len(planted.templates)} = {turn}")
            before.append(f"length({value})")
    rows = " UNION ALL ".join(selects)
    return f'WITH k AS (SELECT {planted.key} AS n FROM {planted.table}) SELECT n, kind, CAST(s AS BIGINT) AS start, CAST(s + length(value) AS BIGINT) AS "end", value FROM ({rows})'


def model(text: str) -> list[tuple[str, int, int, float]]:
    """Stands for a model: labels in the text as <LABEL score value>, read without the marks' effect on places."""
    return [(m[1], m.start(3), m.end(3), float(m[2])) for m in re.finditer(r"<([A-Z]+) ([0-9.]+) ([^>]*)>", text)]


ONLY_DEFAULT = Config(dictionaries=WORDS, all_languages=True)

PLANTED: dict[str, Planted] = {
    # -- detectors
    "it_tax_code": Planted((
        "Codice fiscale {CF=RSSMRA85T10A562S}, grazie.",
        "cf {CF=rssmra85t10a562s} in minuscolo",
        "Il signore ha {CF=RSSMRA85T10A562X} come codice",
        "Il condominio ha codice fiscale {CF=80012345678} da anni",
        "Serie 12345678901 del prodotto",
        "Si veda XRSSMRA85T10A562S e RSSMRA85T10A562",
    )),
    "it_vat_number": Planted((
        "Dati: {PIVA=12345670017} e basta",
        "partita iva {PIVA=12345 67001 7} spaziata",
        "{PIVA=1234 5670 017} altra forma",
        "{PIVA=123 456 700 17} altra ancora",
        "La P.IVA {PIVA=12345678901} non torna",
        "Senza parole 12345678901 non torna",
    )),
    "it_iban": Planted((
        "Bonifico su {IBAN=IT60X0542811101000000123456} entro oggi",
        "Bonifico su {IBAN=IT60 X054 2811 1010 0000 0123 456} entro oggi",
        "conto {IBAN=de89370400440532013000} estero",
        "conto {IBAN=IT61X0542811101000000123456} con cifra errata",
        "codice IT60X05428111 corto",
    )),
    "it_phone": Planted((
        "Chiamare {TELEFONO=+39 333 1234567} dopo le nove",
        "Chiamare {TELEFONO=333 1234567} dopo le nove",
        "Chiamare {TELEFONO=02 12345678} dopo le nove",
        "Chiamare {TELEFONO=0039 02 1234567} dopo le nove",
        "Vale 0,33 e 3,331234567 euro",
        "Chiamare {TELEFONO=075/9115329} dopo le nove",
        "US phone +1 (212) 555-0100 here",
    )),
    "it_postal_code": Planted((
        "Spedire in via delle Rose, cap {CAP=20121} Milano",
        "Il numero 20121 da solo",
        "Piazza grande, codice postale 00009 errato",
        "cap {CAP=00010} minimo",
        "cap {CAP=98168} massimo e cap 98169",
    )),
    "it_generic_name": Planted((
        "Ha scritto {score=Pinco Pallino} ieri",
        "Il Pallino ha scritto",
        "Ha scritto {score=Pinco De Pallinis} ieri",
    ), part="dropped", only=("score",)),
    "network_values": Planted((
        "Vedi {URL=https://www.example.it/a?b=1} ora",
        "Vedi {URL=www.example.it/pagina} ora e HTTP://ESEMPIO",
        "Da {IP=192.168.10.254} a 300.1.1.1",
        "Da {IP=2001:db8::ff00:42:8329} risponde",
        "Scheda {MAC=00:1A:2B:3C:4D:5E} di rete",
        "Scrivere a {EMAIL~'utente' || cast(n as string) || '@example.it'} subito",
        "Portafoglio {CRYPTO=bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq} attivo",
        "Pagato con {CARTA=4111 1111 1111 1111} online",
    )),
    "it_date": Planted((
        "Scade il {DATA=12/03/2024} alle dieci",
        "Scade il {DATA=2024-03-12} alle dieci",
        "Ci vediamo {DATA=lunedì 4 giugno 2026} in sede",
        "Ci vediamo il {DATA=4 giugno} in sede",
        "Era il {DATA=4 giu 2026} credo",
        "Era {DATA=giugno 2026} credo",
        "Il 4 giu credo",
    )),
    "it_birth_date": Planted((
        "Il cliente è nato il {DATA_NASCITA=12/03/1980} e vive",
        "Data di nascita: {DATA_NASCITA=12 marzo 1980} confermata",
        "nata a Roma il {DATA_NASCITA=1.2.1975} da genitori",
    ), only=("DATA_NASCITA",)),
    "it_birth_place": Planted((
        "Il cliente è nato a {LUOGO_NASCITA=Milano} ed è contento",
        "residente in {LUOGO_NASCITA=Reggio Emilia} con la moglie",
        "Luogo di nascita: {LUOGO_NASCITA=Vattelapesca} indicato",
        "nata a {LUOGO_NASCITA=Londra} e cresciuta qui",
        "nato a domicilio",
        "originario di {LUOGO_NASCITA=Torino} e nato a {LUOGO_NASCITA=Roma} poi",
    ), only=("LUOGO_NASCITA",)),
    "it_address": Planted((
        "Abita in {INDIRIZZO~'Via Garibaldi ' || cast(n % 900 + 1 as string)} da anni",
        "Abita in {INDIRIZZO=Corso Vittorio Emanuele, 12B} da anni",
        "Scrivere a {INDIRIZZO=casella postale 123} oppure",
        "Scrivere a {INDIRIZZO=C.P. n. 55} oppure",
        "Sta in via Roma senza numero",
    )),
    "it_plate": Planted((
        "La macchina {TARGA=AB123CD} è ferma",
        "La macchina {TARGA=AB 123 CD} è ferma",
        "La dimensione 10 MB 123 KB è alta",
        "Il veicolo targato {TARGA=MI 123456} è ferma",
        "Il codice MI 123456 è fermo",
    ), only=("TARGA",)),
    "it_vin": Planted((
        "Numero di telaio {VIN=ZFA16900001234567} verificato",
        "Codice ZFA16900001234567 verificato",
        "telaio {VIN=WBA3A5C50CF256651} ok",
    )),
    "it_cadastral": Planted((
        "Immobile al {CATASTO=foglio 12 particella 345 sub 6} del comune",
        "Immobile al {CATASTO=fg. 12, mapp. 345} del comune",
        "Il foglio 12 è vuoto",
    )),
    "it_case_number": Planted((
        "Causa R.G. {PRATICA=1234/2020} del foro",
        "Visto il ruolo generale n. {PRATICA=55/2019} si decide",
        "La sentenza n. {PRATICA=123/2018} è definitiva",
        "Il decreto n. {PRATICA=77/2021} vale",
        "L'ordinanza n. {PRATICA=8/2022} vale",
        "Rif. prot. n. {PRATICA=AB-12/2020} interno",
        "La pratica n. {PRATICA=X99/1} è aperta",
        "Atto rep. n. {PRATICA=1234/567} del notaio",
        "Atto, raccolta n. {PRATICA=98765} del notaio",
        "La fattura elettronica n. {PRATICA=FE-2020/1} è scaduta",
        "La polizza n. {PRATICA=POL-12345} è attiva",
        "La matricola inps {PRATICA=1234567} è attiva",
        "La posizione inail n. {PRATICA=7654321} vale",
        "Con iscrizione all'albo n. {PRATICA=A1234} da anni",
        "Visto il verbale n. {PRATICA=12/2020} si decide",
        "Il codice del contratto: {PRATICA=ABC123DEF456} firmato",
        "La pratica è aperta, la sentenza no",
    ), only=("PRATICA",)),
    "it_social": Planted((
        "Su instagram è {SOCIAL=@mario.rossi80} da anni",
        "Su telegram è {SOCIAL~'@utente_' || cast(n as string)} da anni",
        "Scrivere @example.it non basta",
        "Il segno @a è corto",
    )),
    "it_document": Planted((
        "Carta d'identità n. {DOCUMENTO=AX1234567} rilasciata",
        "Il passaporto {DOCUMENTO=YA1234567} è scaduto",
        "Il pezzo AX1234567 è esaurito",
        "carta d'identità {DOCUMENTO=CA12345AA} elettronica",
    ), only=("DOCUMENTO",)),
    "it_organisation": Planted((
        "Fornitura di {ORG=Rossi Impianti S.r.l.} per noi",
        "Fornitura di {ORG=Alfa Beta SPA} per noi",
        "Scrive il {ORG=Tribunale di Milano} per noi",
        "Lo studio {ORG=Ferrari & Associati} per noi",
        "una ditta qualunque srl per noi",
    ), only=("ORG",)),
    "it_suspect_card": Planted((
        "La carta di credito {CARTA=4111 1111 1111 1112} è sbagliata",
        "Il numero 4111 1111 1111 1112 è sbagliato",
        "Postepay {CARTA=5333-1710-1234-5679} da verificare",
    ), part="suggested"),
    "it_shipment": Planted((
        "Pacco {SPEDIZIONE=1Z999AA10123456784} in viaggio",
        "Tracking {SPEDIZIONE=123456789} in viaggio",
        "Il numero 123456789 in viaggio",
        "{SPEDIZIONE=GLS12345678} in viaggio",
    ), only=("SPEDIZIONE",)),
    "it_names": Planted((
        "Ieri {PERSONA=Mario} non è venuto",
        "Ieri {PERSONA=Mario Rossi} non è venuto",
        "Mi chiamo {PERSONA=giulia ferrari} e scrivo",
        "Ieri Rosa non è venuta",
        "Gentile {PERSONA=Rosa}, grazie",
        "stasera andiamo da {PERSONA=giulia} a cena",
        "Il dott. {PERSONA=Bianchi} conferma",
        "Ieri Bianchi conferma",
    ), only=("PERSONA",)),
    "it_names_suggested": Planted((
        "Ieri {PERSONA=Esposito} non è venuto",
        "Ieri Mario non è venuto",
        "Ieri {PERSONA=Serena} non è venuta",
    ), part="suggested"),
    "medical_licence": Planted((
        "Ricetta di {SANITARIO=BX1234563} firmata",
        "Ricetta di BX1234560 firmata",
        "Ricetta di BX12345634 firmata",
    )),
    "address_book": Planted((
        "Il progetto {PROGETTO=Falco} parte con {PROGETTO=Falco Reale} e {CODICE=xj-9}",
        "Il falconiere e Falcon non c'entrano, {PROGETTO=FALCO} sì",
    ), replace(EVERYTHING, book=(("Falco", "progetto"), ("falco reale", "progetto"), ("XJ-9", "codice")))),
    "model_labels": Planted((
        "<FULLNAME 0.9 {PERSONA=Mario Ferrari}> con <AMOUNT 0.8 {IMPORTO=100 euro}>",
        "<FULLNAME 0.9 Tizio Sempronio> con <CITY 0.8  {LUOGO=Vattelapesca},> e <CITY 0.3 Altrove>",
        "<TELEPHONENUM 0.9 {TELEFONO=+39 333 1234567}> e <EMAIL 0.9 nessuna>",
        "<UNKNOWN 0.9 Niente> <ORG 0.9 {ORG=Ditta Esempio}>",
    ), replace(EVERYTHING, model=model), only=("PERSONA", "IMPORTO", "LUOGO", "TELEFONO", "EMAIL", "ORG")),
    # -- filters, overlaps and propagation
    "default_categories": Planted((
        "Il 12/03/2024 vedi www.example.it e {EMAIL=a.b@example.it} da 10.0.0.1",
        "Targa {TARGA=AB123CD}, IBAN {IBAN=IT60X0542811101000000123456}, Rossi Impianti S.r.l.",
    ), ONLY_DEFAULT, only=("EMAIL", "TARGA", "IBAN", "URL", "IP", "ORG", "DATA")),
    "cut_at_line": Planted((
        "Firma: {PERSONA=Mario Rossi}\nSegretario generale",
        "mail {EMAIL=a.b@example.it}\nfine",
        "Sede {INDIRIZZO=Via Garibaldi 12}\n20 persone",
    ), only=("PERSONA", "EMAIL", "INDIRIZZO")),
    "person_edges": Planted((
        "<FULLNAME 0.9 «{PERSONA=Giulia Ferrari}»>",
        "<FULLNAME 0.9 nato {PERSONA=Mario Rossi} residente>",
        "<FULLNAME 0.9 il {PERSONA=Paolo Esposito} 2024>",
        "<FULLNAME 0.9 e di con>",
    ), replace(EVERYTHING, model=model), only=("PERSONA",)),
    "place_or_name": Planted((
        "<CITY 0.9 {PERSONA=Mario}> va via",
        "<CITY 0.9 {LUOGO=Vattelapesca}> va via",
    ), replace(EVERYTHING, model=model), only=("PERSONA", "LUOGO")),
    "dropped_spans": Planted((
        "<FULLNAME 0.9 {person_shape=tizio caio tre quattro cinque}> fine",
        "<FULLNAME 0.9 {role=Direttore Generale}> fine",
        "<FULLNAME 0.9 {person_dictionary=Tizio Caio}> fine",
        "residente a {birth_place=Vattelapesca} fine",
        "Il pezzo {document=AX1234567} fine",
        "<TELEPHONENUM 0.9 {phone=12345678}> fine",
        "<CITY 0.9 {noise=file.txt}> fine",
    ), replace(EVERYTHING, model=model), part="dropped", only=("person_shape", "role", "person_dictionary", "birth_place", "document", "phone", "noise")),
    "overlaps": Planted((
        # a tax code beats a plate inside it, an e-mail the address of its host
        "Codice {CF=RSSMRA85T10A562S} e {EMAIL=a@10.example.it} ok",
        # the longer of two of a type, and a birth date over a plain one
        "nato il {DATA_NASCITA=12/03/1980}, carta {CARTA=4111111111111111} ok",
        # a postal code loses to whatever holds it
        "al numero {TELEFONO=02 12345} postale",
    )),
    "persons_over_particles": Planted((
        "Scrive {PERSONA=Giulia de Mario} da sola",
        "Scrive {PERSONA=Giulia} per {PERSONA=Mario} da sola",
    ), only=("PERSONA",)),
    "spread_surnames": Planted((
        "{PERSONA=Mario Ferrari} scrive. Poi {PERSONA=Ferrari} tace e Ferrarini ride.",
        "{PERSONA=Paolo Esposito} scrive. L'avvocato {PERSONA=Esposito} tace.",
    ), only=("PERSONA",)),
    "spread_lists": Planted((
        "Vengono {PERSONA=Mario}, {PERSONA=paolo} e {PERSONA=giulia} domani",
        "Ci sono casa, strada e lavoro domani",
    ), replace(EVERYTHING, dictionaries=WORDS), only=("PERSONA",)),
    "spread_repeated": Planted((
        "Esco con {PERSONA=giulia}, dice {PERSONA=Mario Rossi}. Poi {PERSONA=giulia} torna e tutto il resto va avanti come sempre nella vita di ogni giorno.",
        "Esco con casa, dice {PERSONA=Mario Rossi}. Poi casa torna.",
    ), only=("PERSONA",)),
    "truecased_names": Planted((
        "ieri ho visto {PERSONA=giovanni} che lavora ancora in quella strada",
        "abito a {LUOGO_NASCITA=milano} da sempre e lavoro ancora in quella strada",
        "ieri ho visto casa mia che sta ancora in quella strada",
    ), only=("PERSONA", "LUOGO_NASCITA")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(p) for name, p in PLANTED.items()}


def oracles() -> dict[str, str]:
    return {name: sql(p) for name, p in PLANTED.items()}
