"""Documents from files: bytes become text by extension, errors become a column.

``read_documents`` scans files of any supported extension with Spark's binary reader, so any store
that Spark reads will do. Office formats, PDF and MSG are unpacked with the standard library.
Optical recognition needs a function from outside; without one, scans report that. Files over
``LARGEST`` bytes are an error, and their contents aren't read.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
import zlib
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ombra.config import Dictionaries
from ombra.functions.text import looks_binary
from ombra.plans.shared import written
from ombra.sources import msg as outlook
from ombra.sources import pdf as portable

#: A document is a scan if it has fewer characters in all, or at least so many pages with fewer characters each; a page, if it has little text under much image.
SCAN_CHARS, SCAN_PAGES, SCAN_MEAN, PAGE_CHARS, PAGE_COVER = 20, 3, 15, 600, 0.5
#: Bytes of a file at most.
LARGEST = 20 * 1024 * 1024


class DocumentError(ValueError):
    """A file that gives no text; the message says why."""


def decoded(data: bytes, ladder: tuple[str, ...] = ("utf-8-sig", "cp1252")) -> str:
    for name in ladder:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def plain(data: bytes) -> str:
    text = decoded(data)
    if looks_binary(text):
        raise DocumentError("binary content")
    return text


def dialect(text: str) -> str:
    """The separator of a table, from its first characters."""
    try:
        return csv.Sniffer().sniff(text[:2048], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def table(data: bytes) -> str:
    text = decoded(data, ("utf-8-sig", "cp1252", "latin-1"))
    return "".join(", ".join(row) + "\n" for row in csv.reader(io.StringIO(text), delimiter=dialect(text)))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    """Text nodes on lines of their own, without scripts and styles; blank runs shrink."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    text = "\n".join(parser.parts)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def page(data: bytes) -> str:
    return html_text(decoded(data))


def mail(data: bytes) -> str:
    """Headers, a blank line, and the plain body, or else the HTML one as text."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{name}: {message[name]}" for name in ("From", "To", "Cc", "Subject", "Date") if message[name]]
    body = message.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body is not None else ""
    return "\n".join([*head, "", html_text(text) if body is not None and body.get_content_subtype() == "html" else text])


RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
#: Groups of a rich text that hold no text.
RTF_HIDDEN = frozenset("fonttbl colortbl stylesheet info pict object header footer generator themedata datastore listtable rsidtbl".split())


def rich(data: bytes) -> str:
    text = decoded(data)
    if not text.lstrip().startswith("{\\rtf"):
        raise DocumentError("not an RTF file")
    out: list[str] = []
    stack, hidden = [], False
    for m in RTF.finditer(text):
        code, point, word, _, symbol, brace, run = m.groups()
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif word in RTF_HIDDEN or symbol == "*":
            hidden = True
        elif hidden:
            continue
        elif code:
            out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif point:
            out.append(chr(int(point) % 65536))
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif symbol in ("\\", "{", "}"):
            out.append(symbol)
        elif symbol == "~":
            out.append(" ")
        elif run:
            out.append(run)
    return "".join(out).strip()


def member(data: bytes, *names: str) -> list[ElementTree.Element]:
    """Parsed parts of an office file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [ElementTree.fromstring(z.read(n)) for n in names]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error) as why:
        raise DocumentError(f"damaged or of another kind: {why}") from why


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def word_text(node: ElementTree.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n"}
    return "".join(x.text or "" if x.tag == f"{W}t" else marks.get(x.tag, "") for x in node.iter())


def docx(data: bytes) -> str:
    """Paragraphs, then tables with their cells between tabs."""
    body = member(data, "word/document.xml")[0].find(f"{W}body")
    lines = [word_text(p) for p in body.findall(f"{W}p")]
    for row in (r for t in body.findall(f"{W}tbl") for r in t.findall(f"{W}tr")):
        lines.append("\t".join("\n".join(map(word_text, c.findall(f"{W}p"))) for c in row.findall(f"{W}tc")))
    return "\n".join(lines)


T_ = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
TAB = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"


def odf_text(node: ElementTree.Element) -> str:
    inner = {f"{T_}tab": "\t", f"{T_}line-break": "\n"}
    out = [node.text or ""]
    for x in node:
        out.append(" " * int(x.get(f"{T_}c", 1)) if x.tag == f"{T_}s" else inner.get(x.tag) or odf_text(x))
        out.append(x.tail or "")
    return "".join(out)


def odt(data: bytes) -> str:
    """All paragraphs, then all headings, then table rows with their cells between tabs."""
    root = member(data, "content.xml")[0]
    lines = [odf_text(p) for kind in ("p", "h") for p in root.iter(f"{T_}{kind}")]
    for row in root.iter(f"{TAB}table-row"):
        lines.append("\t".join(" ".join(odf_text(p) for p in c.iter(f"{T_}p")) for c in row.findall(f"{TAB}table-cell")))
    return "\n".join(lines)


S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx(data: bytes) -> str:
    """Each sheet under its name, rows that aren't blank with cells between commas: values, not formulas."""
    book, links = member(data, "xl/workbook.xml", "xl/_rels/workbook.xml.rels")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
        places = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in links}
        sheets = []
        for sheet in book.iter(f"{S}sheet"):
            lines = [f"# Foglio: {sheet.get('name')}"]
            for row in ElementTree.fromstring(z.read("xl/" + places[sheet.get(R)])).iter(f"{S}row"):
                cells = [cell_value(c, strings) for c in row.findall(f"{S}c")]
                if any(c.strip() for c in cells):
                    lines.append(", ".join(cells))
            sheets.append("\n".join(lines))
    return "\n\n".join(sheets)


def cell_value(cell: ElementTree.Element, strings: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{S}t"))
    value = cell.findtext(f"{S}v") or ""
    return strings[int(value)] if cell.get("t") == "s" and value else value


def pdf(data: bytes) -> str:
    """The text of all pages, one after another; a scan is an error, as it needs recognition."""
    text = "\n".join(text for text, _ in portable.pages(data))
    if len(text.strip()) < SCAN_CHARS:
        raise DocumentError("a scan without readable text")
    return text


def msg(data: bytes) -> str:
    """Headers, a blank line, and the plain body, or else the HTML one as text."""
    found = outlook.fields(data)
    head = [f"{name}: {found[name]}" for name in ("From", "To", "Cc", "Subject", "Date") if found.get(name)]
    return "\n".join([*head, "", found.get("Body") or html_text(found.get("Html", ""))])


READERS: dict[str, Callable[[bytes], str]] = {
    "txt": plain, "md": plain, "markdown": plain, "csv": table, "eml": mail, "msg": msg, "rtf": rich,
    "odt": odt, "docx": docx, "xlsx": xlsx, "html": page, "htm": page, "pdf": pdf,
}


def load(path: str, data: bytes, readers: dict[str, Callable[[bytes], str]] | None = None) -> str:
    """The text of a file, by its extension."""
    known = READERS | (readers or {})
    kind = path.rpartition("/")[2].rpartition(".")[2].lower()
    if kind not in known:
        raise DocumentError(f"unsupported extension; supported: {', '.join(sorted(known))}")
    if len(data) > LARGEST:
        raise DocumentError(f"over {LARGEST} bytes")
    try:
        return known[kind](data)
    except DocumentError:
        raise
    except Exception as why:  # a reader's own error is the file's error
        raise DocumentError(f"{type(why).__name__}: {why}") from why


def read_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Rows (path, name, text, error) of the files under a path; exactly one of text and error is null."""

    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for p, data in zip(paths, contents, strict=True):
            try:
                if data is None:
                    raise DocumentError(f"over {LARGEST} bytes")
                rows.append((load(p, bytes(data), readers), None))
            except DocumentError as why:
                rows.append((None, str(why)))
        return pd.DataFrame(rows, columns=["text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    loaded = F.pandas_udf(run, "struct<text:string,error:string>")(F.col("path"), F.col("content"))
    # a filter on the length keeps the contents of larger files from being read
    large = files.where(F.col("length") > LARGEST).select("path", F.lit(None).cast("binary").alias("content"))
    files = files.where(F.col("length") <= LARGEST).select("path", "content").unionByName(large)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), loaded.alias("d")).select("path", "name", "d.text", "d.error")


# -- scanned pages

def pages_to_recognise(pages: DataFrame) -> DataFrame:
    """Rows (path, page, text, image_cover) with ``recognise``: pages of scans, and single pages that look like one."""
    chars = F.length(F.trim(F.coalesce("text", F.lit(""))))
    whole = pages.groupBy("path").agg(F.sum(chars).alias("_chars"), F.count("*").alias("_pages"))
    scan = (F.col("_chars") < SCAN_CHARS) | ((F.col("_pages") >= SCAN_PAGES) & (F.col("_chars") < SCAN_MEAN * F.col("_pages")))
    single = (chars < PAGE_CHARS) & (F.least("image_cover", F.lit(1.0)) > PAGE_COVER)
    return pages.join(whole, "path").withColumn("recognise", scan | F.coalesce(single, F.lit(False))).drop("_chars", "_pages")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, page, text, image_cover, error) of the PDF files under a path; a damaged file has one row with its error."""

    def run(contents: pd.Series) -> pd.Series:
        out = []
        for data in contents:
            try:
                out.append([{"page": n, "text": text, "image_cover": cover, "error": None} for n, (text, cover) in enumerate(portable.pages(bytes(data)), 1)])
            except Exception as why:  # a reader's own error is the file's error
                out.append([{"page": None, "text": None, "image_cover": None, "error": f"{type(why).__name__}: {why}"}])
        return pd.Series(out, dtype=object)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).where(F.col("length") <= LARGEST)
    each = F.explode(F.pandas_udf(run, "array<struct<page:int,text:string,image_cover:double,error:string>>")("content")).alias("p")
    return found.select("path", each).select("path", "p.*")


def recognised(spark: SparkSession, pages: DataFrame, path: str, reader: Callable[[bytes, int], str]) -> DataFrame:
    """Rows of ``pages_to_recognise`` with ``recognised_text``: what a reader makes of a file's page, where it is asked; its failure gives an empty text."""

    def run(contents: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for data, n in zip(contents, numbers, strict=True):
            try:
                out.append(reader(bytes(data), int(n)))
            except Exception:  # the other pages are still of use
                out.append("")
        return pd.Series(out, dtype=object)

    asked = pages.where("recognise").select("path", "page")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= LARGEST).select("path", "content")
    texts = asked.join(found, "path").select("path", "page", F.pandas_udf(run, "string")("content", "page").alias("recognised_text"))
    return pages.join(texts, ["path", "page"], "left")


def read_pdfs(spark: SparkSession, path: str, reader: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """Rows (path, text, recognised, error) of the PDF files under a path; scans, and pages that look like one, go through the reader, if there is one."""
    found, _ = written(pdf_pages(spark, path), "pages")
    asked = pages_to_recognise(found.where("error is null").drop("error"))
    read = recognised(spark, asked, path, reader) if reader else asked.withColumn("recognised_text", F.lit(None).cast("string"))
    bad = found.where("error is not null").select("path", F.lit(None).cast("string").alias("text"), F.array().cast("array<int>").alias("recognised"), "error")
    return joined_pages(read).unionByName(bad)


def joined_pages(pages: DataFrame) -> DataFrame:
    """Rows (path, text, recognised, error) of rows (path, page, text, recognised_text): the longer text of each page, in order."""
    longer = F.when(F.length("recognised_text") > F.length(F.coalesce("text", F.lit(""))), F.col("recognised_text")).otherwise(F.coalesce("text", F.lit("")))
    each = F.struct("page", longer.alias("text"), F.coalesce(F.length("recognised_text") > F.length(F.coalesce("text", F.lit(""))), F.lit(False)).alias("used"))
    whole = pages.groupBy("path").agg(F.array_sort(F.collect_list(each)).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["text"]), "\n")
    rows = whole.select("path", text.alias("text"), F.transform(F.filter("p", lambda p: p["used"]), lambda p: p["page"]).alias("recognised"))
    bad = F.length(F.trim("text")) < SCAN_CHARS
    return rows.select("path", F.when(~bad, F.col("text")).alias("text"), "recognised", F.when(bad, "a scan without readable text").alias("error"))


# -- the address book and dictionaries

BOOK_HEADERS = ("testo", "nome", "valore", "termine")


def book_rows(data: bytes) -> tuple[list[tuple[str, str]], int]:
    """(term, type) rows of an address book in CSV, and how many lines gave none; over 5 MB is an error."""
    if len(data) > 5 * 1024 * 1024:
        raise DocumentError("over 5 MB")
    text = decoded(data, ("utf-8-sig", "cp1252", "latin-1"))
    out, bad = [], 0
    for n, row in enumerate(csv.reader(io.StringIO(text), delimiter=dialect(text))):
        term = row[0].strip() if row else ""
        if n == 0 and term.lower() in BOOK_HEADERS:
            continue
        if term:
            out.append((term, (row[1].strip().upper() if len(row) > 1 else "") or "ALTRO"))
        else:
            bad += 1
    return out, bad


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Rows (token, ambiguous) of lines token TAB 0 or 1; # starts a comment, tokens are lowered."""
    lines = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != ""))
    parts = F.split("value", "\t")
    return lines.select(F.lower(F.trim(F.get(parts, F.lit(0)))).alias("token"), (F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("0"))) == "1").alias("ambiguous")).where("token <> ''")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Rows (word) of lower-case alphabetic lines."""
    word = F.lower(F.trim("value"))
    return spark.read.text(path).select(word.alias("word")).where(F.col("word").rlike(r"(?U)^\p{Alpha}+$")).distinct()


#: Words of a dictionary at most: what every Python worker holds.
MOST_WORDS = 2_000_000


def dictionaries(names: DataFrame, surnames: DataFrame, vocabulary: DataFrame, wide: DataFrame | None = None, municipalities: DataFrame | None = None) -> Dictionaries:
    """The sets that detection takes, of tables (token, ambiguous) of names and surnames, and (word) of the others.

    They go to every task, so more than ``MOST_WORDS`` rows in one are an error.
    """

    def held(rows: DataFrame | None, column: str) -> frozenset[str]:
        if rows is None:
            return frozenset()
        found = rows.select(F.lower(column)).distinct().limit(MOST_WORDS + 1).collect()
        if len(found) > MOST_WORDS:
            raise ValueError(f"a dictionary of over {MOST_WORDS} words")
        return frozenset(r[0] for r in found if r[0])

    unsure = lambda rows: held(rows.where("ambiguous"), "token")
    return Dictionaries(held(names, "token"), unsure(names), held(surnames, "token"), unsure(surnames), held(vocabulary, "word"), held(wide, "word"), held(municipalities, "word"))
