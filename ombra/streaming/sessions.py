"""Placeholders in a stream: each session's values and counters are state, kept over restarts.

Detection is stateless; its values are keyed by session and get their placeholders from a map of
the session's values and a counter for each type. Rows of a session are numbered by ``seq`` within
a batch, and late rows get later numbers. Numbers that texts mention come along as rows without a
value: they are never given, so that restoring can't expand what a text held before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session_id string, doc_id long, seq long, start int, end int, value string, type string, placeholder string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Numbering(StatefulProcessor):
    """value -> (type, number), type -> last number, and the numbers that texts mention."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "value string", "type string, idx long")
        self.last = handle.getMapState("last", "type string", "idx long")
        self.taken = handle.getMapState("taken", "type string, idx long", "there boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Rows of values that the session knows go out chunk by chunk; only those of new values wait for their order."""
        new: list[pd.DataFrame] = []
        for part in rows:
            mentions = part[part["value"].isna()]
            for kind, idx in {*zip(mentions["type"], mentions["idx"].astype("int64"), strict=True)}:
                self.taken.updateValue((kind, int(idx)), (True,))
            part = part[part["value"].notna()]
            known = part["value"].map({v: self.values.containsKey((v,)) for v in part["value"].unique()}).astype(bool)
            if known.any():
                yield self.marked(key[0], part[known])
            if not known.all():
                new.append(part[~known])
        if new:
            batch = pd.concat(new).sort_values(["seq", "doc_id", "start"], kind="stable")
            for value, kind in batch.drop_duplicates("value")[["value", "type"]].itertuples(index=False):
                idx = (self.last.getValue((kind,))[0] if self.last.containsKey((kind,)) else 0) + 1
                while self.taken.containsKey((kind, idx)):
                    idx += 1
                self.values.updateValue((value,), (kind, idx))
                self.last.updateValue((kind,), (idx,))
            yield self.marked(key[0], batch)

    def marked(self, session: str, rows: pd.DataFrame) -> pd.DataFrame:
        found = {v: self.values.getValue((v,)) for v in rows["value"].unique()}
        kinds = [found[v][0] for v in rows["value"]]
        marks = [f"«{k}_{found[v][1]}»" for k, v in zip(kinds, rows["value"], strict=True)]
        return rows.assign(session_id=session, type=kinds, placeholder=marks)[["session_id", "doc_id", "seq", "start", "end", "value", "type", "placeholder"]]

    def close(self) -> None:
        pass


def numbered(values: DataFrame) -> DataFrame:
    """Placeholders of a stream of values (session_id, doc_id, seq, start, end, value, type, idx); rows without a value reserve a number.

    Needs the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` = ``ROCKS``.
    """
    return values.groupBy("session_id").transformWithStateInPandas(Numbering(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def values_of_stream(docs: DataFrame, config) -> DataFrame:
    """Detected values of a stream of documents (session_id, doc_id, seq, text), and rows without a value for the numbers that they mention."""
    from ombra.operators import rewrite
    from ombra.plans.anonymise import analysed

    text = F.coalesce("text", F.lit(""))
    spans = F.transform(analysed(text, config)["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["type"].alias("type"), F.lit(None).cast("long").alias("idx")))
    none = lambda t: F.lit(None).cast(t)
    marks = F.transform(rewrite.matches(text), lambda m: F.struct(none("int").alias("start"), none("int").alias("end"), none("string").alias("value"), rewrite.kind_of(m).alias("type"), rewrite.number_of(m).alias("idx")))
    each = docs.select("session_id", "doc_id", "seq", F.explode(F.concat(spans, F.filter(marks, lambda m: m["idx"].isNotNull()))).alias("s"))
    return each.select("session_id", "doc_id", "seq", "s.*")


def to_vault(batch_values: DataFrame, vault_path: str, batch_id: int = 0, reserved: DataFrame | None = None) -> None:
    """For ``foreachBatch``: allocate a batch against the vault of the others and put what is new in a part of its own.

    A part is replaced as a whole, so a batch that runs again after a failure leaves the same
    vault; what another part is reading is never touched. ``reserved`` has (session_id, type, idx).
    """
    from ombra.operators import vault as V

    spark = batch_values.sparkSession
    none = batch_values.select("session_id", "type", F.lit(0).cast("long").alias("idx")).where("false")
    at = spark._jvm.org.apache.hadoop.fs.Path(vault_path)
    vault = None
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        vault = spark.read.schema(V.SCHEMA + ", batch long").parquet(vault_path).where(F.col("batch") != batch_id).drop("batch")
    V.allocate(batch_values.where("value is not null"), none if reserved is None else reserved, vault).write.mode("overwrite").parquet(f"{vault_path}/batch={batch_id}")
