r"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for candidates: assignments, access keys, long hexadecimal runs (the base
kinds) and other high-entropy tokens (kind ``token``). Candidate values are hashed, and their
hashes counted over distinct repositories and distinct owners. A value that many owners share, or
that two owners have in many repositories, is a widely copied example; any other that looks live
(enough entropy, no filler words) is an owner-specific credential, in however many repositories of
its one owner it was copied. The base spans are always kept; a high-entropy token
becomes a span only if it is such a credential and no base span covers it.

Spans are code points [start, end) of the whole match. Defined results: a null text is empty, a
text without candidates has empty spans; equal rows are scanned and returned each by itself, and
count as one repository when their repository is equal; a null repository or owner counts as one
value of its own; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ombra.llm.common import documents, large, map_rows, written

#: The base kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A high-entropy token: at least this long, with capitals, small letters and digits.
TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
#: Words that mark a value as filler.
FILLER = ("example", "sample", "changeme", "placeholder", "dummy", "your", "test", "xxxx", "0000", "1234567", "abcdef")
MASK = "<secret>"
#: A value with at least this many owners, or with two and this many repositories, is a widely copied example.
COMMON_OWNERS, COMMON_REPOSITORIES = 3, 16
#: Bits a character of a live-looking value.
ENTROPY = 3.0


def entropy(value: str) -> float:
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts) if value else 0.0


def looks_live(value: str) -> bool:
    low = value.lower()
    return entropy(value) >= ENTROPY and not any(x in low for x in FILLER)


def mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed."""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b, _ in out)
    for m in TOKEN.finditer(text):
        if mixed(m[0]) and not any(a < m.end() and m.start() < b for a, b in base):
            out.append(("token", m.start(), m.end(), m[0]))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


SCHEMA = "row long, id long, repository string, owner string, found array<struct<kind:string,start:int,end:int,hash:string,live:boolean>>"


def scan(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """Rows (row, id, repository, owner, found): the candidates of each row, values only as hashes; ``row`` is ``key``, or a number."""

    def rows(numbers: list, ids: list, repositories: list, owners: list, texts: list) -> Iterable[tuple]:
        for n, i, r, o, t in zip(numbers, ids, repositories, owners, texts, strict=True):
            yield n, i, r, o, [{"kind": k, "start": a, "end": b, "hash": sha256(v.encode()).hexdigest(), "live": looks_live(v)} for k, a, b, v in candidates(t)]

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    columns = [(F.monotonically_increasing_id() if key is None else key).alias("row"), F.col(id_col).cast("long"), repository.cast("string"), owner.cast("string"), text]
    return map_rows(docs, columns, SCHEMA, rows)


def ownership(scanned: DataFrame) -> DataFrame:
    """Rows (hash, n_repositories, n_owners, class) over the whole corpus; class is example, live or other."""
    spans = scanned.select("repository", "owner", F.explode("found").alias("f")).select(F.col("f.hash").alias("hash"), F.col("f.live").alias("live"), F.coalesce("repository", F.lit("\0")).alias("repository"), F.coalesce("owner", F.lit("\0")).alias("owner"))
    each = spans.groupBy("hash", "live", "repository", "owner").agg(F.lit(1))
    counts = each.groupBy("hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.max("live").alias("live"))
    copied = (F.col("n_owners") >= COMMON_OWNERS) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= COMMON_REPOSITORIES))
    kind = F.when(copied, "example").when(F.col("live"), "live").otherwise("other")
    return counts.select("hash", "n_repositories", "n_owners", kind.alias("class"))


def find_secrets(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, id, spans) with spans of (kind, start, end, hash, n_repositories, n_owners, class), one for each row of ``docs``."""
    scanned, _ = written(scan(docs, repository, owner, id_col, text_col), "secrets")
    owned, _ = written(ownership(scanned), "secrets")
    spans = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f"))
    spans = spans.join(large(owned), F.col("f.hash") == F.col("hash")).where((F.col("f.kind") != "token") | (F.col("class") == "live"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("f.kind"))
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("f.start").alias("start"), order.alias("order"), F.col("f.end").alias("end"), F.col("f.kind").alias("kind"), "hash", "n_repositories", "n_owners", "class"))).alias("spans"))
    whole = scanned.select("row", "id").join(large(spans), "row", "left")
    return whole.select("row", "id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """One row for each document, which is a repository; its source is the owner. Odd rows as at the top."""
    docs = documents(spark, sf_dir)
    found = find_secrets(docs, F.col("doc_id"), F.col("source"))
    count = lambda field, value: F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "token")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count("kind", k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("class", "live").alias("n_live"),
        count("class", "example").alias("n_example"),
    )


def redacted(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every base span and live credential masked, but for widely copied examples; n_chars follows the text, if there.

    Texts without such a span, null ones included, stay as they are. Masks are matched by id and
    text, so rows that share an id keep their own.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    scanned, _ = written(scan(docs, repository, owner, id_col, text_col, key), "secrets")
    owned, _ = written(ownership(scanned), "secrets")
    spans = scanned.where(F.size("found") > 0).select("row", "id", F.explode("found").alias("f")).join(large(owned), F.col("f.hash") == F.col("hash"))
    spans = spans.where(F.when(F.col("f.kind") == "token", F.col("class") == "live").otherwise(F.col("class") != "example"))
    masks = spans.groupBy("row", "id").agg(F.sort_array(F.collect_set(F.struct(F.col("f.start").alias("start"), F.col("f.end").alias("end")))).alias("masks"))
    # the input's columns stay in a struct, so none of their names can clash
    rows = docs.select(F.struct("*").alias("doc"), key.alias("key"), F.col(id_col).cast("long").alias("own"))
    rows = rows.join(large(masks), F.col("key").eqNullSafe(F.col("row")) & F.col("own").eqNullSafe(F.col("id")), "left")
    doc = lambda c: F.col("doc")[c]
    rows = rows.withColumn("new", mask(doc(text_col), F.col("masks.start"), F.col("masks.end")))
    changed = {text_col: F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("masks").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(doc("n_chars"))
    return rows.select(*(changed.get(c, doc(c)).alias(c) for c in docs.columns))


@F.pandas_udf(T.StringType())
def mask(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([t if a is None else masked_text(t, a, b) for t, a, b in zip(texts, starts, ends, strict=True)], dtype=object)


def masked_text(text: str, starts: Iterable[int], ends: Iterable[int]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the mask."""
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])
