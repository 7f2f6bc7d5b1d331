"""Blocks of long texts as rows: one document's detection becomes the work of many tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ombra.config import Config
from ombra.functions.lexicons import BLOCK_CHARS
from ombra.functions.text import blocks, language_column
from ombra.operators.detect import MARGIN, block_spans


def block_rows(docs: DataFrame, size: int = BLOCK_CHARS) -> DataFrame:
    """The other columns of ``docs`` with (offset, block) rows of each text; a null or empty text has one empty block."""

    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"offset": a, "block": b} for a, b in blocks(t or "", size)] for t in texts], dtype=object)

    pieces = F.pandas_udf(split, "array<struct<offset:int,block:string>>")(F.col("text"))
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.explode(pieces).alias("b")).select(*rest, "b.offset", "b.block")


#: Characters of the blocks that are read together, at least: as many as their neighbours lend them, so small blocks aren't mostly margin.
RUN = 2 * MARGIN


def windows(text: str, size: int) -> list[dict]:
    """Each run of blocks with as much of its neighbours as a value over its border needs: where it begins, how much lead it has, its own size, and the text."""
    runs: list[list[int]] = []
    for a, b in blocks(text, size):
        if runs and runs[-1][1] < RUN:
            runs[-1][1] += len(b)
        else:
            runs.append([a, len(b)])
    return [{"offset": a, "lead": min(a, MARGIN), "size": n, "window": text[max(0, a - MARGIN) : a + n + MARGIN]} for a, n in runs]


def candidates(docs: DataFrame, config: Config, size: int = BLOCK_CHARS, tasks: int | None = None) -> DataFrame:
    """Rows (session_id, doc_id, entity_type, start, end, score, source): candidates with offsets in the whole text.

    Blocks are dealt out over ``tasks`` (by default four for each core, or as many as a shuffle has), so a
    very long document is found by many; the language is the whole text's. Small blocks are read in
    runs. A run is read with its neighbours' edges and gives what starts in it, so
    no value is lost or cut at a border; only one longer than ``MARGIN`` may be shorter than in the whole.
    """
    text = F.coalesce("text", F.lit(""))
    italian = F.lit(True) if config.all_languages else language_column(text) == "it" if config.language == "auto" else F.lit(config.language == "it")

    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([windows(t or "", size) for t in texts], dtype=object)

    pieces = F.pandas_udf(split, "array<struct<offset:int,lead:int,size:int,window:string>>")(text)
    rows = docs.select("session_id", "doc_id", italian.alias("italian"), F.explode(pieces).alias("b")).select("session_id", "doc_id", "italian", "b.*")
    spark = docs.sparkSession
    rows = rows.repartition(tasks or max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(texts: pd.Series, leads: pd.Series, sizes: pd.Series, offsets: pd.Series, italian: pd.Series) -> pd.Series:
        each = zip(texts, leads, sizes, offsets, italian, strict=True)
        return pd.Series([[s._asdict() for s in block_spans(t, int(lead), int(n), int(at), config, bool(i))] for t, lead, n, at, i in each], dtype=object)

    found = F.pandas_udf(run, "array<struct<entity_type:string,start:int,end:int,score:double,source:string>>")("window", "lead", "size", "offset", "italian")
    return rows.select("session_id", "doc_id", F.explode(found).alias("s")).select("session_id", "doc_id", "s.*")
