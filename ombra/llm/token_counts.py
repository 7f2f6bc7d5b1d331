"""Token counts by heap-and-linked-list merging.

The lowest-ranked adjacent pair is popped until none is a piece; the count is the number of symbols
at the start less the merges, plus the further bytes of characters that only byte pieces can spell.
No ids are made.

Defined results: a null or empty text has no bytes and no tokens; equal rows give equal rows; other
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ombra.llm import piece
from ombra.llm.common import documents, map_rows
from ombra.llm.pieces import model_path, text_or_empty

LIMIT = 4096


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows (id, n_bytes, n_tokens), without begin or end ids."""
    path = path or model_path()

    def rows(keys: list, texts: list, sizes: list) -> Iterable[tuple]:
        model = piece.load(path)
        for key, text, size in zip(keys, texts, sizes, strict=True):
            yield key, size, model.count(text)

    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return map_rows(docs, [F.col(id_col).cast("long"), text_or_empty(text_col), size.alias("size")], "id long, n_bytes long, n_tokens long", rows)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """One row for each document; nulls, empty texts and repeated rows as at the top."""
    counts = token_counts(documents(spark, sf_dir))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
