"""Queries that show single operators at work on texts, files and vaults made from the tables, with their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ombra.config import Config
from ombra.engine import Engine, RequestError
from ombra.functions import text as X
from ombra.functions import validators as C
from ombra.functions.lexicons import ALL_CATEGORIES
from ombra.operators import detect, evaluate, rewrite
from ombra.operators import names as N
from ombra.operators import spans as S
from ombra.operators import vault as V
from ombra.plans.anonymise import Anonymised, anonymise
from ombra.plans.blocks import candidates
from ombra.plans.shared import shared_dir, spread
from ombra.planted import EVERYTHING, ONLY_DEFAULT, WORDS, quoted
from ombra.sources import files
from ombra.streaming import sessions

TIME = "timestamp '2026-01-01 00:00:00'"
IBAN = "IT60X0542811101000000123456"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def values_sql(columns: list[str], rows: list[tuple]) -> str:
    def one(v) -> str:
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    body = ", ".join(f"({', '.join(map(one, r))})" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


# -- functions on single values: name, function, and (arguments, result) pairs

CASES: list[tuple[str, Callable[..., object], list[tuple[tuple, object]]]] = [
    ("tax_code_valid", C.tax_code_valid, [(("RSSMRA85T10A562S",), True), (("rssmra85t10a562s",), True), (("RSSMRA85T10A562X",), False), (("RSSMRA85T10A562",), False), (("",), False)]),
    ("iban_shaped", C.iban_shaped, [((IBAN,), True), (("IT60 X054 2811 1010 0000 0123 456",), True), (("IT6",), False), (("1T60X0542811101000000123456",), False)]),
    ("iban_length", lambda v: C.iban_shaped(v, by_country=True), [((IBAN,), True), ((IBAN[:-1],), False), (("DE89370400440532013000",), True), (("ZZ89370400440532013000",), True)]),
    ("base_key", C.base_key, [((" «Mario   Rossi», ",), "Mario Rossi"), (("perché",), "perché"), (("...",), ""), (("a.b",), "a.b")]),
    ("key_of", lambda v, k: C.key_of(v, k), [(("4 giugno", "DATA"), "????-06-04"), (("giugno 2026", "DATA"), "2026-06-??"), (("12/03/1980", "DATA"), "1980-03-12"), (("12/03/1980", "PERSONA"), "12/03/1980"), (("1.2.75", "DATA"), "1975-02-01"), (("boh", "DATA"), "boh")]),
    ("telling_tokens", lambda v, k: " ".join(C.telling_tokens(v, k)), [(("Dott. Mario Rossi", "PERSONA"), "mario rossi"), (("Rossi S.p.A.", "ORG"), "rossi"), (("Ferrari & Figli srl", "ORG"), "ferrari figli"), (("12", "DATA"), "")]),
    ("country", X.is_country, [(("Italia",), True), ((" stati uniti ",), True), (("Milano",), False)]),
    ("role", S.is_role, [(("Amministratore Delegato",), True), (("Ufficio Acquisti",), True), (("Direttore Mario",), False), (("Mario Rossi",), False), (("Dott. Presidente",), True)]),
    ("noise", lambda v: X.is_noise(v, WORDS), [(("CAPITOLO PRIMO",), True), (("MARIO ROSSI",), False), (("appunti.txt",), True), (("camelCase",), True), (("snake_case",), True), (("A1",), True), (("casa",), True), (("Mario",), False), (("Python",), True), (("Vattelapesca",), False)]),
    ("truecase", lambda v: X.truecase(v, WORDS), [(("ieri mario ha visto giulia. poi è andato a milano",), "Ieri Mario ha visto Giulia. Poi è andato a Milano"), (("ßtrano. ﬁne",), "ßtrano. ﬁne"), (("marco e casa",), "Marco e casa"), (("il sig. rosa",), "Il sig. Rosa"), (("Giulia de rossi",), "Giulia De Rossi")]),
    ("mostly_lower", X.mostly_lower, [(("uno due tre",), True), (("Uno due tre",), False), (("uno due",), False)]),
    ("sentence_start", lambda t, a: N.sentence_start(t, int(a)), [(("Mario", 0), True), (("Ciao. Mario", 6), True), (("Ciao Mario", 5), False), (("riga\nMario", 5), True), (("no, Mario", 4), False)]),
    ("chunks", lambda n: "|".join(f"{a}:{len(p)}" for a, p in detect.model_chunks("parola " * int(n))), [((10,), "0:70"), ((400,), "0:1994|1994:806"), ((0,), "0:0")]),
    ("hard_chunks", lambda n: "|".join(f"{a}:{len(p)}" for a, p in detect.model_chunks("x" * int(n))), [((4500,), "0:2000|2000:2000|4000:500"), ((2000,), "0:2000")]),
    ("blocks", lambda t, n: "|".join(f"{a}:{b}" for a, b in X.blocks(t, int(n))), [(("uno due tre", 6), "0:uno|3: due|7: tre"), (("ab\ncd ef", 5), "0:ab|2:\ncd|5: ef"), (("", 5), "0:"), (("abcdefgh", 3), "0:abc|3:def|6:gh")]),
    ("span_length", lambda v: "yes" if detect.iban(v, 0, len(v)) else "no", [((IBAN,), "yes"), (("IT60X0542811",), "no"), (("IT60" + " X054" * 9,), "no")]),
    ("phone", lambda v: S.phone_valid(v, False), [(("333 1234567",), True), (("075.5098004",), True), (("0,331234567",), False), (("+1 212 5550100",), False)]),
    ("strict_phone", lambda v: S.phone_valid(v, True), [(("333 1234567",), True), (("075.5098004",), False), (("075/9115329",), False)]),
    ("placeholder_order", lambda v: "{}:{}".format(*rewrite.order_key(v)), [(("«PERSONA_12»",), "PERSONA:12"), (("«DATA_NASCITA_3»",), "DATA_NASCITA:3"), (("altro",), "altro:0")]),
    ("mentions", lambda v: ",".join(f"{k}{n}" for k, n in sorted(rewrite.mentioned(v))), [(("[cf_1] e **Persona_2** o CF _ 3",), "CF1,CF3,PERSONA2"), (("niente 12",), ""), (("a_b",), "")]),
    ("language", X.language, [(("il gatto",), "it"), (("the cat",), "en"), (("xyz",), "it"), (("perché the",), "it")]),
    ("binary", X.looks_binary, [(("testo",), False), (("a\x01b",), True), (("a" * 30 + "\x01",), False)]),
    ("medical_number", lambda v: detect.medical(v, 0, len(v)) == 1.0, [(("BX1234563",), True), (("BX1234560",), False)]),
]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function on its values, in Arrow batches."""
    rows = [(name, n, n_args, *(None if i >= len(args) else str(args[i]) for i in range(2))) for name, _, pairs in CASES for n, (args, _) in enumerate(pairs) for n_args in [len(args)]]
    known = {name: f for name, f, _ in CASES}

    def run(names: pd.Series, sizes: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        found = [known[name](*[a, b][:size]) for name, size, a, b in zip(names, sizes, first, second, strict=True)]
        return pd.Series([str(x).lower() if isinstance(x, bool) else x for x in found], dtype=object)

    given = spark.createDataFrame(rows, "function string, n int, size int, a string, b string")
    return given.select("function", "n", F.pandas_udf(run, "string")("function", "size", "a", "b").alias("result"))


def cases_sql() -> str:
    return values_sql(["function", "n", "result"], [(name, n, str(want).lower() if isinstance(want, bool) else want) for name, _, pairs in CASES for n, (_, want) in enumerate(pairs)])


# -- the flagship on texts with a value of each customer

CATEGORIES = replace(EVERYTHING, categories=ALL_CATEGORIES)
LETTER = f"'Scrive utente' || cast(c_custkey as string) || '@example.it da conto {IBAN}, poi utente' || cast(c_custkey as string) || '@example.it. Cita [EMAIL_2] e basta.'"


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("session_id"), F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("seq"), F.expr(LETTER).alias("text"))


def answered(spark: SparkSession, sf_dir: str) -> Anonymised:
    return anonymise(letters(spark, sf_dir), CATEGORIES, now=F.expr(TIME))


#: The k-th customer of a nation has the k-th e-mail number, but for 2, which every text mentions.
NUMBERS = f"""
WITH d AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS session_id, c_custkey AS doc_id, {LETTER.replace(' as string)', ' AS VARCHAR)')} AS text,
         'utente' || CAST(c_custkey AS VARCHAR) || '@example.it' AS email, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k
  FROM customer
), e AS (
  SELECT *, CASE WHEN k < 2 THEN k ELSE k + 1 END AS idx FROM d
), m AS (
  SELECT *, '«EMAIL_' || CAST(idx AS VARCHAR) || '»' AS mark FROM e
)
"""


def anonymised_letters(spark, sf_dir):
    return answered(spark, sf_dir).docs.select("session_id", "doc_id", "text")


def letter_entities(spark, sf_dir):
    found = answered(spark, sf_dir).entities
    return found.select("session_id", "doc_id", "placeholder", "value", "type", "occurrences", "related_to", "suggested")


def letter_vault(spark, sf_dir):
    return answered(spark, sf_dir).vault.select("session_id", "type", "idx", "placeholder", "value", "value_hash", "norm_key", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def letter_trace(spark, sf_dir):
    """How often each type was accepted, with its source."""
    return answered(spark, sf_dir).trace.where("phase = 'accepted'").groupBy("type", "detail").agg(F.count("*").alias("n"))


def restored_letters(spark, sf_dir):
    """Letters back from their anonymised form, and what was found and unknown."""
    done = answered(spark, sf_dir)
    back = rewrite.restore(done.docs, done.vault)
    return back.select("session_id", "doc_id", "text", F.size("restored").cast("long").alias("restored"), F.array_join("warnings", ",").alias("warnings"))


def letters_without_a_session(spark, sf_dir):
    """Null sessions and ids, repeated rows, and columns named like the engine's own: nothing leaks, nothing is lost."""
    odd = letters(spark, sf_dir).select(F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("long").alias("doc_id"), "seq", "text", F.col("seq").alias("spans"), F.col("seq").alias("map"))
    odd = odd.unionByName(odd)
    done = anonymise(odd.withColumn("restored", F.lit("x")), CATEGORIES, now=F.expr(TIME))
    leaks = done.docs.where(F.col("text").contains("@example.it") | F.col("text").contains(IBAN)).agg(F.count("*").alias("leaks"))
    back = rewrite.restore(done.docs, done.vault).select("spans", "text")
    return back.crossJoin(F.broadcast(leaks)).select(F.col("spans").alias("n"), "text", "leaks")


def decorated_answers(spark, sf_dir):
    """A placeholder in thirteen decorations and three spellings, restored."""
    marks = ["«»", "“”", "‘’", "**|**", "__|__", "**", "``", '""', "''", "[]", "()", "<>", ""]
    pairs = [tuple(m.split("|")) if "|" in m else (m[:1], m[1:]) for m in marks]
    bodies = ["PERSONA_1", "persona_1", "PERSONA _ 1"]
    shapes = F.array(*(F.lit(f"a {a}{b}{z} z") for a, z in pairs for b in bodies))
    docs = table(spark, sf_dir, "customer").select(F.lit("s").alias("session_id"), F.col("c_custkey").alias("doc_id"), F.get(shapes, (F.col("c_custkey") % len(pairs) * 3 + F.col("c_custkey") % 3).cast("int")).alias("text"))
    vault = spark.createDataFrame([("s", "«PERSONA_1»", "Mario")], "session_id string, placeholder string, value string")
    return rewrite.restore(docs, vault).select("doc_id", "text", F.size("restored").cast("long").alias("restored"))


# -- blocks

ITEM = f"conto {IBAN} del cliente, "


def block_candidates(spark, sf_dir):
    """Accounts in one long text for each nation, found block by block: none is lost at a cut."""
    one = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("session_id")).agg(F.count("*").alias("n"))
    docs = one.select("session_id", F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("x "), F.expr("repeat('" + ITEM + "', cast(n as int))")).alias("text"))
    found = candidates(docs, Config(all_languages=True), size=97)
    return found.where("entity_type = 'IT_IBAN'").select("session_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# -- files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
B = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def pdf_of(lines: list[str]) -> bytes:
    content = b"BT /F1 12 Tf 72 720 Td " + b" 0 -14 Td ".join(b"(" + x.encode("cp1252") + b") Tj" for x in lines) + b" ET"
    parts = [
        b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [3 0 R] /Count 1>>",
        b"<</Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources <</Font <</F1 5 0 R>>>>>>",
        b"<</Length %d>>\nstream\n" % len(content) + content + b"\nendstream", b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n + 1, p) for n, p in enumerate(parts)) + b"trailer <</Root 1 0 R>>\n%%EOF"


#: For each kind of file: its bytes for a customer, and the text that it must give, in SQL over ``n``.
FILES: dict[str, tuple[Callable[[int], bytes], str]] = {
    "txt": (lambda n: f"cliente {n} è qui".encode(), "'cliente ' || n || ' è qui'"),
    "md": (lambda n: f"# cliente {n} è qui".encode("cp1252"), "'# cliente ' || n || ' è qui'"),
    "csv": (lambda n: f'nome;n\n"a;b";{n}\n'.encode(), "'nome, n' || chr(10) || 'a;b, ' || n || chr(10)"),
    "html": (lambda n: f"<p>cliente   {n}</p><script>x</script><p>è &amp; qui</p>".encode(), "'cliente ' || n || chr(10) || 'è & qui'"),
    "eml": (lambda n: f"From: a@b.it\r\nTo: c{n}@d.it\r\nSubject: =?utf-8?q?perch=C3=A9?=\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nciao".encode(), "'From: a@b.it' || chr(10) || 'To: c' || n || '@d.it' || chr(10) || 'Subject: perché' || chr(10) || chr(10) || 'ciao'"),
    "rtf": (lambda n: f"{{\\rtf1{{\\fonttbl{{\\f0 Arial;}}}}cliente {n} \\'e8\\par qui}}".encode(), "'cliente ' || n || ' è' || chr(10) || 'qui'"),
    "docx": (lambda n: zipped(**{"word/document.xml": f"<w:document {W}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{n}</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>cliente {n}</w:t></w:r></w:p></w:body></w:document>"}), "'cliente ' || n || chr(10) || 'a' || chr(9) || n"),
    "odt": (lambda n: zipped(**{"content.xml": f"<office:document-content {O}><office:body><text:h>titolo</text:h><text:p>cliente {n}</text:p></office:body></office:document-content>"}), "'cliente ' || n || chr(10) || 'titolo'"),
    "xlsx": (lambda n: zipped(**{
        "xl/workbook.xml": f'<workbook {B}><sheets><sheet name="Uno" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet {B}><sheetData><row><c t="inlineStr"><is><t>cliente</t></is></c><c><f>1+1</f><v>{n}</v></c></row><row><c/></row></sheetData></worksheet>',
    }), "'# Foglio: Uno' || chr(10) || 'cliente, ' || n"),
    "pdf": (lambda n: pdf_of([f"cliente numero {n}", "è scritto qui"]), "'cliente numero ' || n || chr(10) || 'è scritto qui'"),
}
#: Files that give an error instead of a text.
BROKEN: dict[str, Callable[[int], bytes]] = {"docx": lambda n: b"no zip", "txt": lambda n: b"\x00\x01\x02\x03abc", "xyz": lambda n: b"x", "rtf": lambda n: b"plain", "pdf": lambda n: pdf_of(["poco"])}


def read_files(spark, sf_dir):
    """A file of every kind for each supplier, read back through the dispatch by extension."""

    def read(keys: pd.Series) -> pd.Series:
        out = []
        for n in keys:
            each = [{"kind": kind, "text": files.load(f"/x/f.{kind.upper()}", make(n)), "error": False} for kind, (make, _) in FILES.items()]
            for kind, make in BROKEN.items():
                try:
                    each.append({"kind": kind, "text": files.load(f"f.{kind}", make(n)), "error": False})
                except files.DocumentError:
                    each.append({"kind": kind, "text": None, "error": True})
            out.append(each)
        return pd.Series(out, dtype=object)

    found = F.pandas_udf(read, "array<struct<kind:string,text:string,error:boolean>>")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.explode(found("s_suppkey")).alias("f")).select("n", "f.*")


def read_files_sql() -> str:
    good = " UNION ALL ".join(f"SELECT k, '{kind}' AS kind, {text} AS text, false AS error FROM s" for kind, (_, text) in FILES.items())
    bad = " UNION ALL ".join(f"SELECT k, '{kind}', NULL, true FROM s" for kind in BROKEN)
    return f"WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS n FROM supplier) SELECT k AS n, kind, text, error FROM ({good} UNION ALL {bad})"


def scanned_pages(spark, sf_dir):
    """Which pages need recognition, and the documents put together from embedded and recognised text."""
    order = table(spark, sf_dir, "orders").where("o_orderkey % 3 < 3")
    few = F.col("o_custkey") % 3 == 0
    pages = order.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("page"), F.when(few, F.lit("poco")).otherwise(F.repeat(F.lit("testo "), 30)).alias("text"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(0.9)).otherwise(F.lit(0.1)).alias("image_cover"))
    asked = files.pages_to_recognise(pages)
    read = asked.withColumn("recognised_text", F.when(F.col("recognise"), F.repeat(F.lit("riletto "), 40)))
    whole = files.joined_pages(read)
    return whole.select("path", F.length("text").cast("long").alias("chars"), F.size("recognised").cast("long").alias("recognised"), F.col("error").isNotNull().alias("failed"))


def imported_book(spark, sf_dir):
    """An address book in CSV for each nation: terms, and how many lines gave none."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            rows, bad = files.book_rows(text.encode())
            out.append([{"term": t, "type": k, "rejected": bad} for t, k in rows])
        return pd.Series(out, dtype=object)

    text = F.concat(F.lit("testo;tipo\n"), F.col("n_name"), F.lit(";paese\n;vuoto\n"), F.col("n_nationkey").cast("string"), F.lit(";\n"))
    rows = F.explode(F.pandas_udf(run, "array<struct<term:string,type:string,rejected:int>>")(text)).alias("r")
    return table(spark, sf_dir, "nation").select("n_nationkey", rows).select("n_nationkey", "r.*")


# -- the vault


def customer_vault(spark, sf_dir) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    rows = customer.select(F.col("c_nationkey").cast("string").alias("session_id"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("type"), F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("doc_id"), F.lit(0).alias("start"))
    return V.allocate(rows, rows.select("session_id", "type", F.lit(0).cast("long").alias("idx")).where("false"), now=F.expr(TIME))


def vault_by_placeholder(spark, sf_dir):
    """Known and unknown placeholders of each nation."""
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("session_id"), F.explode(F.array(F.lit("«BUILDING_1»"), F.lit("«BUILDING_99999»"))).alias("placeholder"))
    return V.lookup_placeholders(wanted, customer_vault(spark, sf_dir)).select("session_id", "placeholder", "value")


def vault_session(spark, sf_dir):
    return V.session(customer_vault(spark, sf_dir), "7").select("type", "idx", "value")


def vault_cleared(spark, sf_dir):
    return V.clear(customer_vault(spark, sf_dir), "7").groupBy("session_id").agg(F.count("*").alias("entries"))


def vault_latest(spark, sf_dir):
    """Sessions, the latest first, then by name, numbered in that order."""
    found = V.summary(customer_vault(spark, sf_dir))
    order = F.row_number().over(V.W.orderBy(F.desc("latest"), "session_id"))
    return found.select("session_id", "entries", F.date_format("latest", "yyyy-MM-dd HH:mm").alias("latest"), order.cast("long").alias("place"))


def vault_migrated(spark, sf_dir):
    """An earlier layout gets numbers and hashes; encrypted values keep a null hash."""
    old = customer_vault(spark, sf_dir).select("session_id", "type", "placeholder", F.when(F.col("idx") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit(V.PREFIX), F.col("value"))).alias("value"))
    return V.migrated(old).select("session_id", "placeholder", "idx", "value_hash")


def book_edits(spark, sf_dir):
    book = table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_type").alias("type"), F.col("p_partkey").alias("n"))
    held = V.book_upsert(book.where("false"), book)
    return V.book_list(V.book_remove(held, ["Brand#11", "Brand#23"])).select("term", "type")


def collisions(spark, sf_dir):
    """Numbers that texts mention and an earlier call has already given."""
    mentioned = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("session_id"), F.col("c_custkey").alias("doc_id"), F.concat(F.lit("see BUILDING_"), F.col("c_custkey").cast("string")).alias("text"))
    return V.collisions(None, customer_vault(spark, sf_dir), rewrite.reserved(mentioned)).select("session_id", "doc_id", "idx")


# -- evaluation and dictionaries


def residuals_all(spark, sf_dir):
    """Every kind of residual, planted once for each customer beside a placeholder, with its surroundings."""
    planted = {"email": "a.b@example.it", "tax_code": "RSSMRA85T10A562S", "iban": IBAN, "card_run": "4111-1111-1111-1111", "mobile": "333 1234567", "landline": "02 12345678", "vat": "12345670017", "plate": "AB 123 CD", "birth_date": "12/03/1980", "titled_person": "Sig. Rossi", "organisation": "Alfa Beta SRL"}
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in planted.items()))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.get(kinds, (F.col("c_custkey") % len(planted)).cast("int")).alias("p"))
    docs = rows.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("«CF_1»\nqui: "), F.col("p.v"), F.lit(" ; fine")).alias("text"), F.col("p.k").alias("own"))
    found = evaluate.residuals(docs).join(docs.select("doc_id", "own"), "doc_id").where("kind = own")
    return found.select("doc_id", "kind", "value", "context")


def residuals_all_sql() -> str:
    planted = {"email": "a.b@example.it", "tax_code": "RSSMRA85T10A562S", "iban": IBAN, "card_run": "4111-1111-1111-1111", "mobile": "333 1234567", "landline": "02 12345678", "vat": "12345670017", "plate": "AB 123 CD", "birth_date": "12/03/1980", "titled_person": "Sig. Rossi", "organisation": "Alfa Beta SRL"}
    rows = ", ".join(f"({n}, '{k}', '{v}')" for n, (k, v) in enumerate(planted.items()))
    # a mobile number's place holds three more digits than are asked for, so its context shows the whole
    return f"SELECT c_custkey AS doc_id, k AS kind, v AS value, ' qui: ' || v || ' ; fine' AS context FROM customer JOIN (VALUES {rows}) AS t(n, k, v) ON c_custkey % {len(planted)} = t.n"


def verdict_table(spark, sf_dir):
    """Replaced values of each nation against the true ones."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_name").alias("value"), "c_custkey")
    return evaluate.verdicts(customer.where("c_custkey % 3 < 2"), customer.where("c_custkey % 3 > 0")).groupBy("doc_id", "verdict").agg(F.count("*").alias("n"))


def leak_table(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("value"))
    masked = customer.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("resta "), F.col("value"))).otherwise(F.lit("«PERSONA_1»")).alias("text"))
    return evaluate.leaks(masked, customer).groupBy("leaked").agg(F.count("*").alias("n"))


def ablation(spark, sf_dir):
    """Names that stay in texts with and without the dictionary, by kind of text."""
    kinds = [("formale", "Il dott. Mario Rossi conferma."), ("colloquiale", "ieri ho visto giulia con gli altri"), ("nuovo", "Ieri Vattelapesca non è venuto")]
    names = {"formale": "Mario Rossi", "colloquiale": "giulia", "nuovo": "Vattelapesca"}
    texts = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text"), F.lit(names[k]).alias("value")) for k, t in kinds))
    rows = table(spark, sf_dir, "customer").select(F.lit("s").alias("session_id"), F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("seq"), F.get(texts, (F.col("c_custkey") % 3).cast("int")).alias("t")).select("session_id", "doc_id", "seq", "t.*")
    return evaluate.ablation(rows.select("session_id", "doc_id", "seq", "text"), rows.select("doc_id", "value", F.col("kind").alias("corpus")), EVERYTHING)


def dictionary_files(spark, sf_dir):
    """Lines of a dictionary cleaned, marked and turned into the sets that detection takes."""
    raw = spark.createDataFrame([("Rosa",), ("Mario",), (" Mario ",), ("mario",), ("X1",), ("Della Casa",), ("A",), ("D'Angelo",), ("Nicolò",)], "value string")
    words = spark.createDataFrame([("rosa",), ("della",), ("angelo",)], "word string")
    tokens = evaluate.clean_tokens(raw)
    return evaluate.ambiguity(tokens, words, spark.createDataFrame([("d'angelo",)], "token string"))


def municipality_words(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select(F.initcap("n_name").alias("name"))
    return evaluate.municipality_tokens(places, spark.createDataFrame([("united",), ("arabia",)], "word string"))


def lost_names(spark, sf_dir):
    """Known names that no candidate covers."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.col("c_custkey").cast("string"), F.lit(" mario e Giulia")).alias("text"))
    start = F.length(F.col("doc_id").cast("string")) + 1
    spans = docs.where("doc_id % 2 = 0").select("doc_id", start.alias("start"), (start + 5).alias("end"))
    names = spark.createDataFrame([("mario",), ("giulia",)], "token string")
    return evaluate.lost_tokens(docs, names, spans).select("doc_id", F.col("start").cast("long").alias("start"), "token")


def input_matrix(spark, sf_dir):
    """Texts of all structures, spellings, languages and sizes: what must vanish does, and all come back."""
    return evaluate.input_matrix(spark, EVERYTHING).select("name", "vanished", "restored")


def ocr_readings(spark, sf_dir):
    """Readings of a scanned value with letters and digits confused."""
    value = F.concat(F.lit("OI5B rnl"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", *(c.alias(n) for n, c in evaluate.ocr_confusions(value).items()))


def page_texts(spark, sf_dir):
    """The text nodes of real pages."""
    texts = F.pandas_udf(lambda pages: pd.Series([files.html_text(h or "") for h in pages], dtype=object), "string")
    return table(spark, sf_dir, "pages").select("page_id", texts("html").alias("text"))


PAGE_SQL = r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>|<!--.*?-->|<!doctype[^>]*>', '<x>', 'g'), '(<[^>]+>)+', chr(10), 'g'),
  '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text
FROM pages
"""


def stream_numbering(spark, sf_dir):
    """Customers' names numbered as a stream, by keyed state."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = spark.readStream.schema(customer.schema).parquet(f"{sf_dir}/custome[r].parquet")
    none = lambda t: F.lit(None).cast(t)
    values = rows.select(F.col("c_nationkey").cast("string").alias("session_id"), F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("seq"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("type"), none("long").alias("idx"))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set(key, sessions.ROCKS)
    try:
        sessions.numbered(values).writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.parquet(f"{at}/out").select("session_id", "type", "value", "placeholder")


def service_verbs(spark, sf_dir):
    """The verbs of the service, one after another on a vault, a book and settings of their own."""
    engine = Engine(spark, f"{shared_dir(spark)}/service-{uuid.uuid4().hex}", ONLY_DEFAULT)
    out: list[tuple[str, str]] = []
    say = lambda verb, what: out.append((verb, str(what)))

    def refused(verb: str, call: Callable[[], object]) -> None:
        try:
            call()
            say(verb, "accepted")
        except RequestError:
            say(verb, "refused")

    say("import", engine.import_book("testo;tipo\nFalco;progetto\n;vuoto\n".encode()))
    first = engine.anonymise("Il sig. Mario Rossi per il progetto Falco scrive da a.b@example.it", "s1")
    say("anonymise", first["text"])
    say("entities", ",".join(f"{e['placeholder']}={e['value']}" for e in first["entities"]))
    say("again", engine.anonymise("a.b@example.it e c.d@example.it", "s1")["text"])
    say("restore", engine.restore("Gentile **persona_1**, vedi [EMAIL_2] e «EMAIL_9».", "s1"))
    say("edited", engine.reanonymise("Mario Rossi paga", "s2", [{"value": "Mario", "type": "nome"}])["text"])
    say("sessions", sorted((r["session_id"], r["entries"]) for r in engine.sessions()))
    say("session", [r["value"] for r in engine.session("s2")])
    engine.delete_session("s2")
    say("deleted", sorted(r["session_id"] for r in engine.sessions()))
    engine.set_categories({"email"})
    say("settings", engine.settings())
    say("fewer", engine.anonymise("Targa AB123CD di a.b@example.it", "s3")["text"])
    engine.remove_terms(["Falco"])
    say("book", engine.book().count())
    refused("blank", lambda: engine.anonymise("  ", "s1"))
    refused("language", lambda: engine.anonymise("x", "s1", language="fr"))
    refused("category", lambda: engine.set_categories({"NIENTE"}))
    refused("no session", lambda: engine.restore("x", ""))
    return spark.createDataFrame([(n, verb, what) for n, (verb, what) in enumerate(out)], "n int, verb string, result string")


VERBS = [
    ("import", "{'added': 1, 'rejected': 1}"),
    ("anonymise", "Il sig. «PERSONA_1» per il progetto «PROGETTO_1» scrive da «EMAIL_1»"),
    ("entities", "«EMAIL_1»=a.b@example.it,«PERSONA_1»=Mario Rossi,«PROGETTO_1»=Falco"),
    ("again", "«EMAIL_1» e «EMAIL_2»"),
    ("restore", "{'text': 'Gentile Mario Rossi, vedi c.d@example.it e «EMAIL_9».', 'restored': ['«EMAIL_2»', '«PERSONA_1»'], 'not_found': ['«EMAIL_1»', '«PROGETTO_1»'], 'warnings': ['«EMAIL_9»']}"),
    ("edited", "«NOME_1» Rossi paga"),
    ("sessions", "[('s1', 4), ('s2', 1)]"),
    ("session", "['Mario']"),
    ("deleted", "['s1']"),
    ("settings", "{'categories': ['EMAIL']}"),
    ("fewer", "Targa AB123CD di «EMAIL_1»"),
    ("book", "0"),
    ("blank", "refused"),
    ("language", "refused"),
    ("category", "refused"),
    ("no session", "refused"),
]


def dictionary_loaders(spark, sf_dir):
    """Dictionaries and word lists as files, read, and as the sets that detection takes."""
    at = f"{shared_dir(spark)}/lists-{uuid.uuid4().hex}"
    spark.createDataFrame([("# nomi",), ("Mario\t0",), ("Rosa\t1",), (" Luisa ",), ("",)], "value string").coalesce(1).write.text(f"{at}/names")
    spark.createDataFrame([("Casa",), ("x1",), ("è",), ("casa",)], "value string").coalesce(1).write.text(f"{at}/words")
    tokens, words = files.read_dictionary(spark, f"{at}/names"), files.read_words(spark, f"{at}/words")
    known = files.dictionaries(tokens, tokens.limit(0), words)
    rows = [(kind, w) for kind, held in (("name", known.names), ("ambiguous", known.ambiguous_names), ("surname", known.surnames), ("word", known.vocabulary)) for w in sorted(held)]
    return spark.createDataFrame(rows, "kind string, word string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "functions_on_values": cases,
    **{
        f.__name__: f
        for f in (
            anonymised_letters, letter_entities, letter_vault, letter_trace, restored_letters, letters_without_a_session, decorated_answers,
            block_candidates, read_files, scanned_pages, imported_book, vault_by_placeholder, vault_session, vault_cleared, vault_latest,
            vault_migrated, book_edits, collisions, residuals_all, verdict_table, leak_table, ablation, dictionary_files,
            municipality_words, lost_names, input_matrix, ocr_readings, page_texts, stream_numbering,
            service_verbs, dictionary_loaders,
        )
    },
}

VAULT = "SELECT CAST(c_nationkey AS VARCHAR) AS session_id, c_mktsegment AS type, c_name AS value, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS idx FROM customer"
MARKED = f"SELECT *, '«' || type || '_' || CAST(idx AS VARCHAR) || '»' AS placeholder FROM ({VAULT})"


def oracles() -> dict[str, str]:
    return {
        "functions_on_values": cases_sql(),
        "anonymised_letters": NUMBERS + f"SELECT session_id, doc_id, replace(replace(text, email, mark), '{IBAN}', '«IBAN_1»') AS text FROM m",
        "letter_entities": NUMBERS + f"""
            SELECT session_id, doc_id, mark AS placeholder, email AS value, 'EMAIL' AS type, CAST(2 AS BIGINT) AS occurrences, CAST(NULL AS VARCHAR) AS related_to, false AS suggested FROM m
            UNION ALL SELECT session_id, doc_id, '«IBAN_1»', '{IBAN}', 'IBAN', 1, NULL, false FROM m""",
        "letter_vault": NUMBERS + f"""
            SELECT session_id, 'EMAIL' AS type, CAST(idx AS BIGINT) AS idx, mark AS placeholder, email AS value, sha256(email) AS value_hash, email AS norm_key, '2026-01-01' AS created FROM m
            UNION ALL SELECT DISTINCT session_id, 'IBAN', 1, '«IBAN_1»', '{IBAN}', sha256('{IBAN}'), '{IBAN}', '2026-01-01' FROM m""",
        "letter_trace": "SELECT 'EMAIL_ADDRESS' AS type, 'email' AS detail, 2 * count(*) AS n FROM customer UNION ALL SELECT 'IT_IBAN', 'iban', count(*) FROM customer",
        # numbers of other customers' letters never reach this text, so the cited number is unknown
        "restored_letters": NUMBERS + "SELECT session_id, doc_id, text, CAST(2 AS BIGINT) AS restored, '«EMAIL_2»' AS warnings FROM m",
        "letters_without_a_session": NUMBERS + "SELECT doc_id AS n, text, CAST(0 AS BIGINT) AS leaks FROM m UNION ALL SELECT doc_id, text, 0 FROM m",
        "decorated_answers": "SELECT c_custkey AS doc_id, 'a Mario z' AS text, CAST(1 AS BIGINT) AS restored FROM customer",
        "block_candidates": f"""
            WITH n AS (SELECT CAST(c_nationkey AS VARCHAR) AS session_id, count(*) AS n FROM customer GROUP BY 1)
            SELECT session_id, 2 + {len(ITEM)} * i + 6 AS start, 2 + {len(ITEM)} * i + 6 + {len(IBAN)} AS "end" FROM (SELECT session_id, unnest(range(n)) AS i FROM n)""",
        "read_files": read_files_sql(),
        "scanned_pages": """
            WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_custkey % 3 = 0 AS few, o_orderkey % 2 = 0 AS pictured FROM orders),
            w AS (SELECT *, sum(CASE WHEN few THEN 4 ELSE 179 END) OVER (PARTITION BY path) AS chars, count(*) OVER (PARTITION BY path) AS pages FROM p),
            r AS (SELECT *, (chars < 20 OR (pages >= 3 AND chars < 15 * pages)) OR pictured AS again FROM w),
            t AS (SELECT path, sum(CASE WHEN again THEN 320 WHEN few THEN 4 ELSE 180 END) + count(*) - 1 AS chars,
                         sum(CASE WHEN few AND NOT again THEN 4 ELSE 999 END) + count(*) - 1 AS least, count(*) FILTER (again) AS recognised FROM r GROUP BY path)
            SELECT path, CASE WHEN least >= 20 THEN CAST(chars AS BIGINT) END AS chars, CAST(recognised AS BIGINT) AS recognised, least < 20 AS failed FROM t""",
        "imported_book": "SELECT n_nationkey, n_name AS term, 'PAESE' AS type, 1 AS rejected FROM nation UNION ALL SELECT n_nationkey, CAST(n_nationkey AS VARCHAR), 'ALTRO', 1 FROM nation",
        "vault_by_placeholder": f"SELECT CAST(n_nationkey AS VARCHAR) AS session_id, p.placeholder, v.value FROM nation CROSS JOIN (VALUES ('«BUILDING_1»'), ('«BUILDING_99999»')) AS p(placeholder) LEFT JOIN ({MARKED}) v ON v.session_id = CAST(n_nationkey AS VARCHAR) AND v.placeholder = p.placeholder",
        "vault_session": f"SELECT type, idx, value FROM ({VAULT}) WHERE session_id = '7'",
        "vault_cleared": "SELECT CAST(c_nationkey AS VARCHAR) AS session_id, count(*) AS entries FROM customer WHERE c_nationkey <> 7 GROUP BY 1",
        "vault_latest": "SELECT session_id, entries, '2026-01-01 00:00' AS latest, row_number() OVER (ORDER BY session_id) AS place FROM (SELECT CAST(c_nationkey AS VARCHAR) AS session_id, count(*) AS entries FROM customer GROUP BY 1)",
        "vault_migrated": f"SELECT session_id, placeholder, idx, CASE WHEN idx % 2 = 0 THEN sha256(value) END AS value_hash FROM ({MARKED})",
        "book_edits": "SELECT p_brand AS term, arg_max(upper(p_type), p_partkey) AS type FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#23') GROUP BY 1",
        "collisions": f"SELECT v.session_id, c_custkey AS doc_id, v.idx FROM customer JOIN ({VAULT}) v ON v.session_id = CAST(c_nationkey AS VARCHAR) AND v.type = 'BUILDING' AND v.idx = c_custkey",
        "residuals_all": residuals_all_sql(),
        "verdict_table": "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'noise' WHEN 1 THEN 'true' ELSE 'lost' END AS verdict, count(*) AS n FROM customer GROUP BY 1, 2",
        "leak_table": "SELECT c_custkey % 4 = 0 AS leaked, count(*) AS n FROM customer GROUP BY 1",
        "ablation": """
            SELECT corpus, count(*) AS names, CAST(sum(w) AS BIGINT) AS leaked_without, CAST(sum(l) AS BIGINT) AS leaked_with FROM (
              SELECT CASE c_custkey % 3 WHEN 0 THEN 'formale' WHEN 1 THEN 'colloquiale' ELSE 'nuovo' END AS corpus, 1 AS w, CASE c_custkey % 3 WHEN 2 THEN 1 ELSE 0 END AS l FROM customer
            ) GROUP BY corpus""",
        "dictionary_files": values_sql(["token", "ambiguous"], [("rosa", True), ("mario", False), ("della casa", True), ("d'angelo", False), ("nicolò", False)]),
        "municipality_words": "SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(n_name), ' ')) AS word FROM nation) WHERE length(word) >= 4 AND word NOT IN ('united', 'arabia')",
        "lost_names": """
            SELECT c_custkey AS doc_id, length(CAST(c_custkey AS VARCHAR)) + 1 AS start, 'mario' AS token FROM customer WHERE c_custkey % 2 = 1
            UNION ALL SELECT c_custkey, length(CAST(c_custkey AS VARCHAR)) + 9, 'giulia' FROM customer""",
        "input_matrix": values_sql(["name", "vanished", "restored"], [(name, True, True) for name in evaluate.MATRIX]),
        "ocr_readings": """
            WITH v AS (SELECT s_suppkey, 'OI5B rnl' || CAST(s_suppkey AS VARCHAR) AS v FROM supplier)
            SELECT s_suppkey, translate(v, 'OoIlSBZ', '0011582') AS digits, translate(v, '01582', 'OISBZ') AS letters, replace(v, 'rn', 'm') AS rn FROM v""",
        "page_texts": PAGE_SQL,
        "stream_numbering": f"SELECT session_id, type, value, placeholder FROM ({MARKED})",
        "service_verbs": values_sql(["n", "verb", "result"], [(n, verb, what) for n, (verb, what) in enumerate(VERBS)]),
        "dictionary_loaders": values_sql(["kind", "word"], [("name", "luisa"), ("name", "mario"), ("name", "rosa"), ("ambiguous", "rosa"), ("word", "casa"), ("word", "è")]),
    }
