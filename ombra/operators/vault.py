"""The vault: which placeholder stands for which value in each session.

Columns: session_id, type, idx, placeholder, value, value_hash, norm_key, created_at. Values are
joined by hash, so the value column may be encrypted. A value has one placeholder in a session, the
type of its first appearance; rows without a session share one. Numbers go on from the highest, leaving out numbers that texts of the
session already mention.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ombra.functions.validators import key_of
from ombra.plans.shared import matched, prefix_sums, ranked

SCHEMA = "session_id string, type string, idx long, placeholder string, value string, value_hash string, norm_key string, created_at timestamp"
PREFIX = "enc:v1:"
#: Sequence numbers of a bucket in which first appearances are numbered together.
BUCKET = 4096


def placeholder(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("«"), kind, F.lit("_"), number.cast("string"), F.lit("»"))


def first_appearances(values: DataFrame) -> DataFrame:
    """Rows (session_id, value, value_hash, type, seq, doc_id, start) of rows with these columns: the first of each value in its session."""
    first = F.min(F.struct("seq", "doc_id", "start", "type")).alias("first")
    return values.groupBy("session_id", "value").agg(first).select("session_id", "value", F.sha2(F.col("value").cast("binary"), 256).alias("value_hash"), "first.*")


def allocate(values: DataFrame, reserved: DataFrame, vault: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """New vault rows for the values that the vault lacks.

    ``values`` has (session_id, value, type, seq, doc_id, start); ``reserved`` has (session_id,
    type, idx): numbers not to be given. The k-th new value of a type gets the k-th number over the
    highest in use that isn't reserved. A reserved number with f free ones between the highest and
    itself moves all values from the (f + 1)-th on by one, so the move of a value is the running
    count of the reserved numbers before it: a sum by buckets, whatever a session holds.
    """
    kind = ["session_id", "type"]
    first = first_appearances(values)
    marks = reserved.select(*kind, F.col("idx").cast("long").alias("idx")).distinct()
    marks = matched(marks, values.select(*kind).distinct(), kind, "left_semi")
    if vault is None:
        first, marks = (x.withColumn("top", F.lit(0).cast("long")) for x in (first, marks))
    else:
        first = matched(first, vault.select("session_id", "value_hash"), ["session_id", "value_hash"], "left_anti")
        used = vault.groupBy(*kind).agg(F.max("idx").alias("top"))
        first, marks = (matched(x, used, kind, "left").withColumn("top", F.coalesce("top", F.lit(0))) for x in (first, marks))
    order = ranked(first, kind, F.floor(F.col("seq") / BUCKET), [F.col("seq"), F.col("doc_id"), F.col("start"), F.col("value")], "k")
    marks = ranked(marks.where("idx > top"), kind, F.floor(F.col("idx") / BUCKET), [F.col("idx")], "j")
    events = order.withColumn("at", F.col("k")).withColumn("mark", F.lit(0).cast("long"))
    moves = marks.select(*kind, (F.col("idx") - F.col("top") - F.col("j") + 1).alias("at"), F.lit(1).cast("long").alias("mark"))
    events = events.unionByName(moves, allowMissingColumns=True).withColumn("part", F.floor(F.col("at") / BUCKET))
    moved = prefix_sums(events, kind, "part", [F.col("at"), F.desc("mark")], "mark", "gaps").where("mark = 0")
    out = moved.withColumn("idx", (F.col("top") + F.col("k") + F.col("gaps")).cast("long"))
    return out.select("session_id", "type", "idx", placeholder(F.col("type"), F.col("idx")).alias("placeholder"), "value", "value_hash", norm_key("value", "type").alias("norm_key"), (F.current_timestamp() if now is None else now).alias("created_at"))


def norm_key(value: str, kind: str) -> Column:
    def keys(values: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([key_of(v, k) for v, k in zip(values, kinds, strict=True)], dtype=object)

    return F.pandas_udf(keys, T.StringType())(F.col(value), F.col(kind))


def append(vault: DataFrame, rows: DataFrame) -> DataFrame:
    """The vault with the rows whose value and placeholder it lacks: the first writer stays."""
    fresh = matched(rows, vault.select("session_id", "value_hash"), ["session_id", "value_hash"], "left_anti")
    fresh = matched(fresh, vault.select("session_id", "placeholder"), ["session_id", "placeholder"], "left_anti")
    return vault.unionByName(fresh.select(*vault.columns))


def lookup_values(values: DataFrame, vault: DataFrame) -> DataFrame:
    """``values`` (session_id, value) with type and placeholder, null where unknown."""
    hashed = values.withColumn("value_hash", F.sha2(F.col("value").cast("binary"), 256))
    return matched(hashed, vault.select("session_id", "value_hash", "type", "placeholder"), ["session_id", "value_hash"], "left").drop("value_hash")


def lookup_placeholders(wanted: DataFrame, vault: DataFrame) -> DataFrame:
    return matched(wanted, vault.select("session_id", "placeholder", "type", "value"), ["session_id", "placeholder"], "left")


def session(vault: DataFrame, session_id: str) -> DataFrame:
    return vault.where(F.col("session_id").eqNullSafe(F.lit(session_id))).orderBy("type", "idx")


def summary(vault: DataFrame) -> DataFrame:
    """Sessions with their number of entries and latest entry, latest first."""
    return vault.groupBy("session_id").agg(F.count("*").alias("entries"), F.max("created_at").alias("latest")).orderBy(F.desc("latest"), "session_id")


def clear(vault: DataFrame, session_id: str) -> DataFrame:
    return vault.where(~F.col("session_id").eqNullSafe(F.lit(session_id)))


def collisions(texts: DataFrame, vault: DataFrame, reserved: DataFrame) -> DataFrame:
    """Rows of ``reserved`` (session_id, doc_id, type, idx) that an earlier call's placeholder already has: restoring them would expand foreign text."""
    return matched(reserved, vault.select("session_id", "type", "idx"), ["session_id", "type", "idx"], "left_semi")


# -- encryption of the value column


def encrypt(vault: DataFrame, key: Column) -> DataFrame:
    """Values as prefixed AES-GCM text; null, empty and already encrypted ones stay. The hash column still joins."""
    plain = F.col("value").isNotNull() & (F.col("value") != "") & ~F.startswith("value", F.lit(PREFIX))
    sealed = F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(F.col("value").cast("binary"), key)))
    return vault.withColumn("value", F.when(plain, sealed).otherwise(F.col("value")))


def decrypt(vault: DataFrame, key: Column) -> DataFrame:
    opened = F.aes_decrypt(F.unbase64(F.substring("value", len(PREFIX) + 1, 1 << 30)), key).cast("string")
    return vault.withColumn("value", F.when(F.startswith("value", F.lit(PREFIX)), opened).otherwise(F.col("value")))


def is_encrypted(vault: DataFrame) -> bool:
    return not vault.where(F.startswith("value", F.lit(PREFIX))).limit(1).isEmpty()


def migrated(old: DataFrame) -> DataFrame:
    """A vault of an earlier layout with the columns it lacks: hashes are filled in from plain values."""
    out = old
    if "norm_key" not in out.columns:
        out = out.withColumn("norm_key", F.lit(None).cast("string"))
    if "value_hash" not in out.columns:
        out = out.withColumn("value_hash", F.lit(None).cast("string"))
    if "idx" not in out.columns:
        out = out.withColumn("idx", F.regexp_extract("placeholder", "_([0-9]+)»$", 1).cast("long"))
    plain = ~F.startswith("value", F.lit(PREFIX))
    return out.withColumn("value_hash", F.coalesce("value_hash", F.when(plain, F.sha2(F.col("value").cast("binary"), 256))))


# -- the address book


def book_upsert(book: DataFrame, rows: DataFrame) -> DataFrame:
    """The book (term, type, n) with rows of the same columns: the row with the highest n decides a term's type.

    Terms are trimmed and keep their case; empty terms are ignored and a blank type is ALTRO.
    """
    both = book.select("term", "type", "n").unionByName(rows.select(F.trim("term").alias("term"), F.when(F.trim("type") == "", F.lit("ALTRO")).otherwise(F.coalesce(F.upper(F.trim("type")), F.lit("ALTRO"))).alias("type"), "n"))
    last = F.row_number().over(W.partitionBy("term").orderBy(F.desc("n"), F.desc("type")))
    return both.where("term is not null and term <> ''").withColumn("r", last).where("r = 1").drop("r")


def book_list(book: DataFrame) -> DataFrame:
    return book.orderBy(F.lower("term"), "term")


def book_remove(book: DataFrame, terms: list[str]) -> DataFrame:
    return book.where(~F.col("term").isin(*terms)) if terms else book
