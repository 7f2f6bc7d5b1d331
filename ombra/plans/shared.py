"""Tables in the folder that the driver and all executors share, scans that use all cores, null-safe joins, running sums without one big sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error,
    as no folder of one machine is visible to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ombra-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def written(df: DataFrame, name: str, *by: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder, in parts by some columns, and read it back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for made in _watching:
        made.append(path)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEAN, None)
    # once the table is there, nothing reads what was shuffled for it
    conf.set(CLEAN, "true")
    try:
        df.write.options(**options).partitionBy(*by).parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once and read back, so that what is computed twice from it isn't; in parts by some columns."""
    return written(df, name, *by)[0]


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``written`` made and that no returned DataFrame reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_watching: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[set[str]]:
    """Tables written inside are deleted at its end, but for those whose paths the block adds to the set."""
    made: list[str] = []
    kept: set[str] = set()
    _watching.append(made)
    try:
        yield kept
        forget(spark, *(p for p in made if p not in kept))
    finally:
        _watching.remove(made)


def spread(scan: DataFrame) -> DataFrame:
    """A file scan whose rows reach all cores: one that leaves most of them idle is dealt out anew.

    A scan of many parts, as every large table has, stays as it is and is never shuffled. One of
    few parts is looked at without reading a column: it is dealt out only if its largest part has
    over twice a core's even share, as a file of one row group does.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= 4 * cores:
        return scan
    sizes = scan.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    most, total = sizes.first()
    return scan.repartition(2 * cores) if total and most * cores > 2 * total else scan


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, which is never sent to the driver.

    Spark takes a written table for as large as its compressed files, so one of a few MB, which
    may be hundreds in memory, would else be broadcast.
    """
    return df.hint("merge")


def same(left: str, right: str, columns: list[str]) -> Column:
    """Whether columns of two aliased tables are equal, or both null."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of the same names in which null equals null; the columns of ``left``, then the others of ``right``."""
    joined = left.alias("l").join(large(right).alias("r"), same("l", "r", on), how)
    rest = [] if how in ("left_anti", "left_semi") else [F.col(f"r.{c}") for c in right.columns if c not in on]
    return joined.select("l.*", *rest)


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, start: str) -> DataFrame:
    """Add ``start``: the sum of ``value`` over the rows before each one, within ``group``.

    Rows are ordered by ``bucket``, then ``order``. A group is summed bucket by bucket in
    parallel; only the buckets' totals are summed in one go, so a group may hold most of the rows.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    over = W.partitionBy(*group).orderBy(bucket) if group else W.partitionBy(F.lit(0)).orderBy(bucket)
    totals = totals.withColumn("_base", F.sum("_total").over(over) - F.col("_total")).drop("_total")
    inside = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = df.withColumn("_inner", F.sum(value).over(inside) - F.col(value))
    whole = inner.alias("l").join(totals.alias("r"), same("l", "r", [*group, bucket])).select("l.*", "r._base")
    return whole.withColumn(start, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Number the rows of each group from 1 by ``bucket``, then ``order``; buckets are numbered in parallel."""
    rows = df.withColumn("_bucket", bucket).withColumn("_one", F.lit(1).cast("long"))
    return prefix_sums(rows, group, "_bucket", order, "_one", name).withColumn(name, F.col(name) + 1).drop("_bucket", "_one")
