"""SentencePiece encoding with original byte spans, and decoding.

``encode_documents`` gives ids and the UTF-8 byte span of every piece; ``decode_documents`` turns
ids back into text. ``encoded_digests`` does both in one pass for whole tables and returns digests
in place of long arrays.

Defined results: a null text is empty; an empty text has the end id only; equal rows give equal
rows; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ombra.llm import piece
from ombra.llm.common import documents, map_rows

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


def text_or_empty(text_col: str):
    return F.coalesce(F.col(text_col), F.lit("")).alias("text")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, add_end: bool = True) -> DataFrame:
    """Rows (id, ids, begins, ends): the span of a piece is [begin, end) in bytes of the text; the end id has an empty span."""
    path = path or model_path()

    def rows(keys: list, texts: list) -> Iterable[tuple]:
        model = piece.load(path)
        for key, text, found in zip(keys, texts, model.encode_all(texts), strict=True):
            tail = [model.end] if add_end else []
            stop = [len(text.encode())] * len(tail)
            yield key, found.ids + tail, found.begins.tolist() + stop, found.ends.tolist() + stop

    return map_rows(docs, [F.col(id_col).cast("long"), text_or_empty(text_col)], "id long, ids array<int>, begins array<long>, ends array<long>", rows)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (id, text) of rows (id, ids); null ids give a null text."""
    path = path or model_path()

    def rows(keys: list, all_ids: list) -> Iterable[tuple]:
        model = piece.load(path)
        for key, ids in zip(keys, all_ids, strict=True):
            yield key, None if ids is None else model.decode(ids)

    return map_rows(encoded, ["id", "ids"], "id long, text string", rows)


def encoded_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256, spans_sha256); the last digests the begins, then the ends of the pieces as 64-bit little-endian integers."""
    path = path or model_path()

    def rows(keys: list, texts: list) -> Iterable[tuple]:
        model = piece.load(path)
        for key, text, found in zip(keys, texts, model.encode_all(texts), strict=True):
            ids = [*found.ids, model.end]
            line = " ".join(map(model.text.__getitem__, ids))
            yield key, len(ids), sha256(line.encode()).hexdigest(), sha256(model.decode(ids).encode()).hexdigest(), sha256(np.concatenate((found.begins, found.ends)).astype("<i8", copy=False)).hexdigest()

    return map_rows(docs, [F.col(id_col).cast("long"), text_or_empty(text_col)], "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", rows)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, begins, ends): ids with an end id as little-endian 16-bit integers, and where the pieces begin and end in bytes of the text as 32-bit ones."""
    path = path or model_path()

    def rows(keys: list, texts: list) -> Iterable[tuple]:
        model = piece.load(path)
        for key, text, found in zip(keys, texts, model.encode_all(texts), strict=True):
            ids = np.array([*found.ids, model.end], "<u2")
            begins, ends = (np.append(x, len(text.encode())).astype("<u4").tobytes() for x in (found.begins, found.ends))
            yield key, len(ids), ids.tobytes(), begins, ends

    return map_rows(docs, [F.col(id_col).cast("long"), text_or_empty(text_col)], "doc_id long, n_tokens long, ids binary, begins binary, ends binary", rows)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """One row for each document; nulls, empty texts and repeated rows as at the top."""
    return encoded_digests(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
