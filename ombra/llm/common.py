"""Helpers shared by the corpus operators: reading tables, Arrow mapping, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ombra.plans.shared import forget, large, prefix_sums, spread, written

__all__ = ["components", "documents", "forget", "given_back", "large", "map_rows", "prefix_sums", "spread", "text_bytes", "to_batch", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents, read by all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def map_rows(df: DataFrame, columns: list[str | Column], schema: str, rows: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Map Arrow batches: ``rows`` gets a few hundred rows of the selected columns as lists and yields output tuples."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # a whole batch as Python values would be many times its size
                found = iter(rows(*(c.to_pylist() for c in batch.slice(at, 512).columns)))
                while part := list(islice(found, 512)):
                    yield to_batch(part, arrow)
            del batch
        given_back()

    picked = [(F.col(c) if isinstance(c, str) else c).alias(f"c{n}") for n, c in enumerate(columns)]
    return df.select(*picked).mapInArrow(run, kind)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def given_back() -> None:
    """Let the system have what a task's batches held: between tasks a worker waits, and the machine's other processes need it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null is the empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the links (a, b): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps, each a partial minimum and an equi-join that
    adaptive execution may split where a node is hot. Every round is a written table, so a lost
    executor repeats one round at most. Links of a node to itself and nulls have no effect; nodes
    without links aren't returned. No links give no rows.
    """
    spark = edges.sparkSession
    a, b = F.col("a"), F.col("b")
    now, path = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.select(mark).first()[0]
    while seen[0]:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        star = both.where(a < b).join(large(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        star, star_path = written(star, name)
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(large(low), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        now, next_path = written(small, name)
        forget(spark, path, star_path)
        path, before = next_path, seen
        seen = now.select(mark).first()[0]
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
