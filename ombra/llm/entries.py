"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ombra.llm import langid, licenses, media, mixing, nn_descent, pieces, secrets, shards, simhash, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_licenses": licenses.op2_licenses,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_mixing": mixing.op5_mixing,
        "op6_simhash": simhash.op6_simhash,
        "op7_media": media.op7_media,
        "op8_nn_descent": nn_descent.op8_nn_descent,
        "op9_langid": langid.op9_langid,
        "op10_shards": shards.op10_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.OP5_SQL, "op8_nn_descent": nn_descent.OP8_SQL}
