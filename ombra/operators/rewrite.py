"""Placeholders in texts: those already there, rewriting, restoring, and rewriting from an edited list.

A placeholder is «TYPE_n». When a text comes back, its placeholders may be bare, in lower case, with
blanks, or in one of twelve decorations; all of these are recognised, and a decoration is taken away
only where the placeholder is known.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ombra.functions.validators import telling_tokens
from ombra.plans.shared import matched

#: A placeholder's body, and the pairs that may stand around it.
BODY = r"[A-Za-z][A-Za-z_]{0,30}\s*_\s*\d+"
PAIRS = (("«", "»"), ("“", "”"), ("‘", "’"), (r"\*\*", r"\*\*"), ("__", "__"), (r"\*", r"\*"), ("`", "`"), ('"', '"'), ("'", "'"), (r"\[", r"\]"), (r"\(", r"\)"), ("<", ">"))
ANY = "|".join([rf"{a}\s*(?:{BODY})\s*{b}" for a, b in PAIRS] + [BODY])
PARTS = r"([A-Za-z][A-Za-z_]{0,30})\s*_\s*(\d+)"
_ANY, _PARTS = re.compile(ANY), re.compile(PARTS)


def canonical(found: str) -> tuple[str, int, str]:
    """Type, number and placeholder of a match."""
    m = _PARTS.search(found)
    return m[1].upper(), int(m[2]), f"«{m[1].upper()}_{m[2]}»"


def mentioned(text: str | None) -> set[tuple[str, int]]:
    """(type, number) pairs that a text already holds, however decorated."""
    return {canonical(m[0])[:2] for m in _ANY.finditer(text or "")}


def order_key(placeholder: str) -> tuple[str, int]:
    m = re.fullmatch(r"«([A-Z][A-Z_]*)_(\d+)»", placeholder or "")
    return (m[1], int(m[2])) if m else (placeholder or "", 0)


def number_columns(placeholder: Column) -> tuple[Column, Column]:
    """Type and number of a canonical placeholder."""
    return F.regexp_extract(placeholder, "^«([A-Z][A-Z_]*)_[0-9]+»$", 1), F.regexp_extract(placeholder, "_([0-9]+)»$", 1).try_cast("long")


JAVA_ANY = "(?U)(?:" + ANY + ")"
JAVA_PARTS = "(?U)" + PARTS


def may_mention(text: Column) -> Column:
    """Whether a text can hold a placeholder: what every one has, and cheap to look for."""
    return text.rlike(r"(?U)_\s*\d")


def matches(text: Column) -> Column:
    """All placeholder-like pieces of a text, in order."""
    return F.when(may_mention(text), F.regexp_extract_all(text, F.lit(JAVA_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def canonical_column(found: Column) -> Column:
    return F.concat(F.lit("«"), F.upper(F.regexp_extract(found, JAVA_PARTS, 1)), F.lit("_"), F.regexp_extract(found, JAVA_PARTS, 2), F.lit("»"))


def kind_of(found: Column) -> Column:
    return F.upper(F.regexp_extract(found, JAVA_PARTS, 1))


def number_of(found: Column) -> Column:
    """The number of a match; null if it is too long for one, which no allocation reaches."""
    return F.regexp_extract(found, JAVA_PARTS, 2).try_cast("long")


def reserved(docs: DataFrame) -> DataFrame:
    """Rows (session_id, doc_id, type, idx) of numbers that texts already mention; ones too long for a number are left out, as no allocation reaches them."""
    each = docs.where(may_mention(F.col("text"))).select("session_id", "doc_id", F.explode(matches(F.col("text"))).alias("m"))
    return each.select("session_id", "doc_id", kind_of(F.col("m")).alias("type"), number_of(F.col("m")).alias("idx")).where("idx is not null").distinct()


def rewritten(pieces: Column, spans: Column, marks: Column) -> Column:
    """A text from the pieces around its spans, with the placeholder of each span's mark, or where it has none its value, between them.

    All three are columns of a table: an expression would be worked out anew for each span.
    """
    put = lambda s, i: F.concat(F.coalesce(F.get(marks, i)["placeholder"], s["value"]), F.get(pieces, i + 1))
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(spans, put), ""))


def restore(docs: DataFrame, vault: DataFrame) -> DataFrame:
    """``docs`` (session_id, doc_id, text) with the restored text, and the placeholders found and unknown as ``restored`` and ``warnings``.

    Only the placeholders that a text mentions are looked up, so no row carries a session's vault,
    and texts that can't mention any aren't moved. Null sessions and ids are values like any other; a
    null text is empty; columns of the input that are named like the new ones are replaced.
    """
    # the input's columns stay in a struct, so none of their names can clash
    rows = docs.select(F.struct("*").alias("doc"), "session_id", F.coalesce("text", F.lit("")).alias("text"))
    some = rows.where(may_mention(F.col("text"))).withColumn("marks", matches(F.col("text"))).withColumn("key", F.xxhash64("text"))
    # a map is a text's, as many rows may share an id; texts that hash alike share one, of which each uses its own
    keys = ["session_id", "key"]
    wanted = some.select(*keys, F.explode(F.transform("marks", canonical_column)).alias("placeholder")).distinct()
    known = matched(wanted, vault.select("session_id", "placeholder", "value"), ["session_id", "placeholder"])
    known = known.groupBy(*keys, "placeholder").agg(F.min("value").alias("value"))
    maps = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("map"))
    joined = matched(some, maps, keys, "left")
    # marks and what follows each go together, so that nothing is worked out anew for each of them
    pieces = F.split("text", JAVA_ANY, -1)
    pairs = F.arrays_zip(F.col("marks").alias("m"), F.slice(pieces, F.lit(2), F.size("marks")).alias("after"))
    value = lambda m: F.when(F.col("map").isNull(), m).otherwise(F.coalesce(F.try_element_at("map", canonical_column(m)), m))
    text = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(pairs, lambda p: F.concat(value(p["m"]), p["after"])), ""))
    names, there = F.transform("marks", canonical_column), F.coalesce(F.map_keys("map"), F.array().cast("array<string>"))
    new = joined.select("doc", F.when(F.size("marks") > 0, text).otherwise(F.col("text")).alias("text"), F.array_sort(F.array_intersect(names, there)).alias("restored"), F.array_except(names, there).alias("warnings"))
    none = F.array().cast("array<string>")
    both = new.unionByName(rows.where(~may_mention(F.col("text"))).select("doc", "text", none.alias("restored"), none.alias("warnings")))
    kept = [c for c in docs.columns if c not in ("restored", "warnings")]
    return both.select(*(F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in kept), "restored", "warnings")


def not_found(restored: DataFrame, vault: DataFrame) -> DataFrame:
    """Placeholders of each session that none of its restored texts mentions."""
    seen = restored.select("session_id", F.explode("restored").alias("placeholder")).distinct()
    return matched(vault.select("session_id", "placeholder"), seen, ["session_id", "placeholder"], "left_anti")


def reanonymise_text(text: str, edits: Sequence[tuple[str, str, str | None]]) -> tuple[str, list[tuple[str, str, str]]]:
    """A text rewritten from (value, type, placeholder or None) rows alone, and the (placeholder, value, type) table.

    The first row of a value counts. Placeholders that fit their type are kept, others numbered from
    1 past those in use or mentioned. All values are replaced in one pass, the longest first, so a
    value never hits a placeholder that was just put in.
    """
    rows: dict[str, tuple[str, str | None]] = {}
    for value, kind, mark in edits:
        value = (value or "").strip()
        if value:
            rows.setdefault(value, (re.sub(r"[^A-Z_]", "", re.sub(r"[\s\-]+", "_", (kind or "").strip().upper())).strip("_") or "ALTRO", mark))
    taken, chosen = mentioned(text), {}
    for value in sorted(rows, key=lambda v: (-len(v), v)):
        kind, mark = rows[value]
        key = order_key(mark or "")
        if key[0] == kind and key[1] and key not in taken:
            taken.add(key)
            chosen[value] = mark
    for value in sorted(rows, key=lambda v: (-len(v), v)):
        if value not in chosen:
            kind, n = rows[value][0], 1
            while (kind, n) in taken:
                n += 1
            taken.add((kind, n))
            chosen[value] = f"«{kind}_{n}»"
    if not chosen:
        return text, []
    union = re.compile("|".join(re.escape(v) for v in sorted(chosen, key=lambda v: (-len(v), v))))
    out = union.sub(lambda m: chosen[m[0]], text)
    return out, sorted(((mark, v, rows[v][0]) for v, mark in chosen.items()), key=lambda r: order_key(r[0]))


EDITED = "struct<text:string,entities:array<struct<placeholder:string,value:string,type:string>>>"


def reanonymise(docs: DataFrame) -> DataFrame:
    """``docs`` (session_id, doc_id, text, edits: array<struct<value,type,placeholder>>) with ``text`` rewritten and ``entities``; what a session had before is void."""

    def run(texts: pd.Series, edits: pd.Series) -> pd.DataFrame:
        rows = [reanonymise_text(t or "", [(e["value"], e["type"], e["placeholder"]) for e in (es if es is not None else [])]) for t, es in zip(texts, edits, strict=True)]
        return pd.DataFrame({"text": [r[0] for r in rows], "entities": [[{"placeholder": p, "value": v, "type": k} for p, v, k in r[1]] for r in rows]})

    done = F.pandas_udf(run, EDITED)(F.col("text"), F.col("edits"))
    return docs.withColumn("_done", done).select("session_id", "doc_id", F.col("_done.text").alias("text"), F.col("_done.entities").alias("entities"))


def related(entities: Iterable[tuple[str, str, str]]) -> dict[str, str]:
    """For (placeholder, value, type) rows of a document, the one other of the type whose words include its words, or are included."""
    rows = [(p, k, t, frozenset(t)) for p, v, k in entities if (t := telling_tokens(v, k))]
    out = {}
    for p, k, tokens, own in rows:
        near = [q for q, other, theirs, words in rows if other == k and theirs != tokens and (own <= words or words <= own)]
        if len(near) == 1:
            out[p] = near[0]
    return out


def related_column(entities: Column) -> Column:
    """Map from placeholder to the related one, of an array of (placeholder, value, type)."""

    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([related((e["placeholder"], e["value"], e["type"]) for e in (x if x is not None else [])) for x in lists], dtype=object)

    return F.pandas_udf(run, T.MapType(T.StringType(), T.StringType()))(entities)
