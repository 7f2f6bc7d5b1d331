"""Evaluation: spans against a truth, recall by type, ablation, residuals, dictionary building."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ombra.config import Config, Dictionaries
from ombra.plans.shared import matched, stored

#: What may be left in an anonymised text, as Java patterns.
RESIDUALS = {
    "email": r"[A-Za-z0-9._%+\-]{2,}\s{0,3}@\s{0,3}\.?[A-Za-z0-9.\-]{2,}\.[A-Za-z]{2,}",
    "tax_code": r"\b[A-Z]{6}[0-9O]{2}[A-Z][0-9O]{2}[A-Z][0-9O]{3}[A-Z]\b",
    "iban": r"\b[A-Z]{2}\s?\d{2}\s?[A-Z0-9][\s\dA-Z]{10,28}\b",
    "card_run": r"(?<![\d.,])(?:\d[ \-]?){12,18}\d(?![\d.,])",
    "mobile": r"(?:\+\s?39\s?)?\b3\d{2}[\s.\-/]?\d{3}[\s.\-/]?\d{3,4}\b",
    "landline": r"(?:\+\s?39\s?)?\b0\d{1,3}[\s.\-/]?\d{5,8}\b",
    "vat": r"(?<!\d)\d{11}(?!\d)",
    "plate": r"\b[A-Z]{2}\s?\d{3}\s?[A-Z]{2}\b",
    "birth_date": r"\b\d{1,2}[/.\-]\d{1,2}[/.\-](?:19|20)\d{2}\b",
    "titled_person": r"\b(?:Sig\.ra|Sig\.|Sig|Dott\.ssa|Dott\.|Dr\.|Avv\.|Ing\.|Prof\.ssa|Prof\.|Geom\.|Rag\.|Arch\.|On\.|Mar\.llo|Mar\.|Isp\.|Sovr\.|Ass\.|Comm\.|Cav\.|Don|Padre|Suor)\s+[A-Z][A-Za-zà-ùÀ-Ù'’]{2,}(?:\s+[A-Z][A-Za-zà-ùÀ-Ù'’]{2,})?",
    "organisation": r"\b(?:[A-Z][A-Za-zà-ùÀ-Ù&'’.\-]{1,}\s+){1,4}(?:S\.?r\.?l\.?s?|S\.?p\.?A|S\.?n\.?c|S\.?a\.?s|S\.?c\.?a\.?r\.?l|Soc\.?\s?Coop|SRL|SPA|SNC|SAS|Ltd|GmbH|Inc)\b\.?",
}


def residuals(docs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, kind, value, context): what looks like data in texts whose placeholders are masked."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "«[A-Z_]+_[0-9]+»", " ")
    found = F.flatten(F.array(*map(_tagged, kinds or RESIDUALS)))
    each = docs.select("doc_id", text.alias("_t")).select("doc_id", "_t", F.explode(found).alias("f"))
    return each.select("doc_id", "f.kind", "f.value", context(F.col("_t"), F.col("f.value")).alias("context"))


def _tagged(kind: str) -> Column:
    values = F.regexp_extract_all(F.col("_t"), F.lit(RESIDUALS[kind]), F.lit(0))
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def context(text: Column, value: Column, reach: int = 65) -> Column:
    """The value's first place with what stands around it, on one line."""
    at = F.call_function("locate", value, text)
    start = F.greatest(at - reach, F.lit(1))
    return F.regexp_replace(F.substring(text, start, at - start + F.length(value) + reach), r"\s+", " ")


def outcomes(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Each true span (doc_id, start, end, type) with its best overlapping found span, and found ones that overlap none.

    ``outcome`` is exact, wrong_type, partial or missing; spurious for found spans without a true one.
    The overlap join is an equi-join on the document with a condition on places.
    """
    span = ["doc_id", "start", "end", "type"]
    t = truth.select(*span)
    g = found.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("type").alias("k"))
    pairs = matched(t, g, ["doc_id"]).where((F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    same, right = (F.col("s") == F.col("start")) & (F.col("e") == F.col("end")), F.col("k").eqNullSafe(F.col("type"))
    best = F.max(F.struct(same.cast("int").alias("same"), right.cast("int").alias("right"))).alias("b")
    # equal spans fare alike, so a span is its own key
    rated = matched(t, pairs.groupBy(*span).agg(best), span, "left")
    outcome = F.when(F.col("b").isNull(), "missing").when((F.col("b.same") == 1) & (F.col("b.right") == 1), "exact").when(F.col("b.right") == 1, "partial").otherwise("wrong_type")
    hit = rated.select(*span, outcome.alias("outcome"))
    extra = matched(g, pairs.select("doc_id", "s", "e", "k").distinct(), ["doc_id", "s", "e", "k"], "left_anti")
    return hit.unionByName(extra.select("doc_id", F.col("s").alias("start"), F.col("e").alias("end"), F.col("k").alias("type"), F.lit("spurious").alias("outcome")))


def recall(rated: DataFrame) -> DataFrame:
    """Counts of outcomes by type with a row of totals (type null), wide recall (any overlap) and strict recall (exact)."""
    count = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    table = rated.rollup("type").agg(*map(count, ("exact", "wrong_type", "partial", "missing", "spurious")))
    true = F.col("exact") + F.col("wrong_type") + F.col("partial") + F.col("missing")
    share = lambda n: F.when(true > 0, n / true)
    return table.select("*", share(true - F.col("missing")).alias("wide"), share(F.col("exact")).alias("strict"))


def leaks(masked: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows (doc_id, value, leaked) for true values (doc_id, value) in anonymised texts (doc_id, text)."""
    rest = [c for c in truth.columns if c not in ("doc_id", "value")]
    return truth.join(masked.select("doc_id", "text"), "doc_id").select("doc_id", "value", *rest, F.contains("text", F.col("value")).alias("leaked"))


def ablation(docs: DataFrame, truth: DataFrame, config: Config) -> DataFrame:
    """Rows (corpus, names, leaked_without, leaked_with): true names (doc_id, value, corpus) left in texts without and with the dictionary."""
    from ombra.plans.anonymise import anonymise

    bare = replace(config, dictionaries=Dictionaries(), without=config.without | {"names"})
    each = [leaks(anonymise(docs, c).docs, truth).select("corpus", F.col("leaked").cast("long").alias(n), F.lit(0).cast("long").alias(m)) for c, n, m in ((bare, "l0", "l1"), (config, "l1", "l0"))]
    both = each[0].withColumn("one", F.lit(1).cast("long")).unionByName(each[1].withColumn("one", F.lit(0).cast("long")))
    return both.groupBy("corpus").agg(F.sum("one").alias("names"), F.sum("l0").alias("leaked_without"), F.sum("l1").alias("leaked_with"))


CLERK = "Il giorno 12/03/2026 il sig. Mario Rossi, CF RSSMRA85T10A562S, con IBAN IT60X0542811101000000123456, firma. "
#: Texts of all structures, spellings, languages, sizes and states: what must vanish, and what must stay.
MATRIX: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "prose": ("Il cliente Mario Rossi ha confermato l'ordine scrivendo da m.rossi@example.it.", ("Mario Rossi", "m.rossi@example.it"), ("ordine",)),
    "table": ("Nome\tEmail\tTelefono\nMario Rossi\tm.rossi@example.it\t3391234567\n", ("Mario Rossi", "m.rossi@example.it", "3391234567"), ("Telefono",)),
    "list": ("- referente: Mario Rossi\n- IBAN: IT60X0542811101000000123456", ("Mario Rossi", "IT60X0542811101000000123456"), ("referente",)),
    "title": ("RELAZIONE TECNICA FINALE\n\nContattare Mario Rossi.", ("Mario Rossi",), ("RELAZIONE TECNICA FINALE",)),
    "columns": ("Mario Rossi\nDeterministico\nLayout", ("Mario Rossi",), ("Deterministico\nLayout",)),
    "headers": ("pag. 1\nIl teste Mario Rossi parla.\n\npag. 2\nIl teste Mario Rossi tace.", ("Mario Rossi",), ("pag. 1", "pag. 2")),
    "footnote": ("Il contratto vale (1).\n\n---\n(1) Come da nota di Mario Rossi.", ("Mario Rossi",), ("---",)),
    "form": ("Nome: Mario\nCodice fiscale: RSSMRA85T10A562S\nLuogo di nascita: Milano\nData di nascita: 10/06/1980", ("Mario", "RSSMRA85T10A562S", "Milano", "10/06/1980"), ("Luogo di nascita",)),
    "lower": ("ciao sono mario rossi, la mia email è m.rossi@example.it", ("mario rossi", "m.rossi@example.it"), ("ciao",)),
    "upper": ("IL SOTTOSCRITTO, CF RSSMRA85T10A562S, CHIEDE QUANTO IN OGGETTO.", ("RSSMRA85T10A562S",), ("CHIEDE",)),
    "cased": ("Il Sig. Mario Rossi è nato a Milano.", ("Mario Rossi",), ("nato",)),
    "accents": ("perche' non chiami Mario Rossi? e' urgente", ("Mario Rossi",), ("perche'",)),
    "spaced": ("Chiamare 333 - 1234567 oppure IT60 X054 2811 1010 0000 0123 456.", ("IT60 X054 2811 1010 0000 0123 456",), ("oppure",)),
    "english": ("Please contact john.miller@corp.com for the order.", ("john.miller@corp.com",), ("contact",)),
    "mixed": ("Il meeting con Mario Rossi è fissato; scrivere a john.miller@corp.com.", ("Mario Rossi", "john.miller@corp.com"), ("meeting",)),
    "few": ("Chiama Mario.", ("Mario",), ("Chiama",)),
    "page": (CLERK * 12, ("Mario Rossi", "RSSMRA85T10A562S"), ("firma",)),
    "fifty_pages": (CLERK * 700, ("Mario Rossi", "RSSMRA85T10A562S", "IT60X0542811101000000123456"), ("firma",)),
    "scan": ("Il s0ttoscritt0 chiede c0me da c0dice RSSMRA85T10A562S.", ("RSSMRA85T10A562S",), ("s0ttoscritt0",)),
    "controls": ("Mario Rossi\x07 ha firmato\ufffd il contratto.", ("Mario Rossi",), ("firmato",)),
    "emoji": ("🌸 Mario Rossi 🌸 paga con 4111 1111 1111 1111 🌸", ("Mario Rossi", "4111 1111 1111 1111"), ("🌸",)),
    "blank": (" \n\t ", (), (" \n\t ",)),
}


def input_matrix(spark: SparkSession, config: Config) -> DataFrame:
    """Rows (name, vanished, restored): whether what must vanish did, what must stay stayed, and the text came back, for each text of ``MATRIX``."""
    from ombra.operators.rewrite import restore
    from ombra.plans.anonymise import anonymise

    rows = [(name, n, n, text, list(gone), list(kept)) for n, (name, (text, gone, kept)) in enumerate(MATRIX.items())]
    docs = spark.createDataFrame(rows, "session_id string, doc_id long, seq long, text string, gone array<string>, kept array<string>")
    done = anonymise(docs, config)
    good = F.forall("gone", lambda v: ~F.contains("text", v)) & F.forall("kept", lambda v: F.contains("text", v))
    masked = stored(done.docs, "matrix")
    back = restore(masked, done.vault).select(F.col("doc_id").alias("own"), F.col("text").alias("again"))
    whole = masked.select("session_id", "doc_id", good.alias("vanished")).join(back, F.col("doc_id") == F.col("own")).join(docs.select(F.col("doc_id").alias("first"), F.col("text").alias("before")), F.col("doc_id") == F.col("first"))
    return whole.select(F.col("session_id").alias("name"), "vanished", (F.col("again") == F.col("before")).alias("restored"))


def verdicts(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Replaced values against a list of true ones, both (doc_id, value): true, noise or lost."""
    f, t = found.select("doc_id", "value").distinct().withColumn("f", F.lit(True)), truth.select("doc_id", "value").distinct().withColumn("t", F.lit(True))
    both = f.join(t, ["doc_id", "value"], "full")
    return both.select("doc_id", "value", F.when(F.col("f") & F.col("t"), "true").when(F.col("f"), "noise").otherwise("lost").alias("verdict"))


def ocr_confusions(value: Column) -> dict[str, Column]:
    """Readings of a scanned value: letters for digits, digits for letters, rn for m. For analysis; not used to detect."""
    return {"digits": F.translate(value, "OoIlSBZ", "0011582"), "letters": F.translate(value, "01582", "OISBZ"), "rn": F.replace(value, F.lit("rn"), F.lit("m"))}


# -- dictionaries


def clean_tokens(raw: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """Distinct tokens of lines: NFC, letters, apostrophes, hyphens and blanks, a capital first, of a fair length."""

    def nfc(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFC")

    token = F.trim(F.pandas_udf(nfc, T.StringType())(F.col("value")))
    return raw.select(token.alias("token")).where(F.length("token").between(least, most) & F.col("token").rlike(r"(?U)^\p{Lu}[\p{L}' \-]*$")).distinct()


def ambiguity(tokens: DataFrame, vocabulary: DataFrame, certain: DataFrame) -> DataFrame:
    """Rows (token, ambiguous): a token whose longest part is a common word, unless it is listed as certain."""
    parts = F.split(F.lower("token"), r"[' \-]")
    longest = F.reduce(parts, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    rows = tokens.select(F.lower("token").alias("token"), longest.alias("word")).distinct()
    rows = rows.join(vocabulary.select(F.lower("word").alias("word"), F.lit(True).alias("common")).distinct(), "word", "left")
    rows = rows.join(certain.select(F.lower("token").alias("token"), F.lit(True).alias("sure")).distinct(), "token", "left")
    return rows.select("token", (F.coalesce("common", F.lit(False)) & ~F.coalesce("sure", F.lit(False))).alias("ambiguous"))


def municipality_tokens(municipalities: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct words of at least four letters of municipality names that are no common words."""
    words = municipalities.select(F.explode(F.split(F.lower("name"), r"[ \-]")).alias("word")).where("length(word) >= 4").distinct()
    return words.join(vocabulary.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")


def lost_tokens(docs: DataFrame, names: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows (doc_id, start, token): words of a text that are known names but in no candidate span (doc_id, start, end)."""
    from ombra.operators.native import offsets

    words = docs.select("doc_id", F.explode(offsets(F.coalesce("text", F.lit("")), "[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ']*")).alias("w")).select("doc_id", F.col("w.start").alias("ws"), F.col("w.end").alias("we"), F.lower("w.value").alias("token"))
    named = words.join(names.select(F.lower("token").alias("token")).distinct(), "token")
    covered = named.join(spans.select("doc_id", "start", "end"), "doc_id").where((F.col("start") <= F.col("ws")) & (F.col("we") <= F.col("end"))).select("doc_id", "ws").distinct()
    return named.join(covered, ["doc_id", "ws"], "left_anti").select("doc_id", F.col("ws").alias("start"), "token")
