"""Near-duplicate embeddings by NN-descent.

Vectors of a label are compared by cosine. Equal vectors are one node that counts as many. A
neighbour graph starts from leaves of random-hyperplane orders and is refined by local joins: the
neighbours and reverse neighbours of each node are compared with one another, and a pair better than
the end of a list enters it. Lists whose every entry passes the threshold are saturated: they are
enlarged to their whole component, whose members are compared block by block in double precision,
so no link inside a component is lost and none is listed as a pair. Before that, saturated nodes of
different components are compared too, in blocks whose centres and radii allow a link, as the links
between them may have found no place in any list. Bounded samples of vectors are
compared with all rows by brute force; while too few of their links are found, further orders and
joins are added, and when these find no more, all vectors of a label are compared in such blocks.

Reverse lists of hubs and large components are dealt out in hashed chunks; leaves are consecutive
rows of a range-partitioned order, so no label or group of copies is one task's work.

Defined results: a vector that is null, empty, zero, or holds nulls or non-finite values, or has a
null label or id, links with nothing and is its own component (null for a null id); vectors of
different length never link; equal rows count as different vectors; other columns of the input are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ombra.llm.common import components, forget, map_rows, spread, written

THRESHOLD = 0.98
#: Entries of a list, leaves' rows, orders at the start and with each repetition.
NEIGHBOURS, LEAF, ORDERS = 8, 128, 6
#: Bits of an order's key.
BITS = 32
#: Rounds of local joins before the audit; fewer if under this part of the entries changed.
ROUNDS, SETTLED = 2, 0.002
#: Reverse neighbours joined together, and rows of a component compared in one go.
JOINED, BLOCK = 48, 512
#: Chunks that a large component is dealt out in, each as often as there are chunks, while none has more rows than ``WIDE``.
CHUNKS, WIDE = 64, 16384
#: Vectors of the audit of each kind, most of those without links, and the part of a vector's links to be found.
AUDIT, AUDIT_MOST, RECALL = 256, 4096, 0.97
#: Single-precision cosines this close to the threshold are computed again in double precision.
DOUBT = 1e-4


def nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows (id, g, digest, wide, narrow): unit vectors in double and single precision; nulls where a row can't link."""

    def rows(ids: list, labels: list, values: list) -> Iterable[tuple]:
        for i, label, v in zip(ids, labels, values, strict=True):
            if i is None or label is None or not v or None in v:
                yield i, None, None, None, None
                continue
            x = np.array(v, np.float64) + 0.0
            most = np.abs(x).max()
            if not np.isfinite(x).all() or most == 0:
                yield i, None, None, None, None
                continue
            unit = x / most
            unit /= np.linalg.norm(unit)
            yield i, f"{label}:{len(v)}", blake2b(x.tobytes(), digest_size=16).digest(), unit.tobytes(), unit.astype(np.float32).tobytes()

    return map_rows(vectors, [F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vector_col)], "id long, g string, digest binary, wide binary, narrow binary", rows)


def grouped(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[list[tuple]]:
    """Runs of rows with equal first columns, cut after ``most`` rows."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[:keys] != held[0][:keys] or len(held) == most):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def matrix(blobs: Iterable[bytes], kind: type) -> np.ndarray:
    blobs = list(blobs)
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def batches_of(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


PAIR = [pa.int64(), pa.int64(), pa.float32()]


def leaves(classes: DataFrame, first: int, orders: int) -> DataFrame:
    """Rows (u, v, s): the nearest vectors of the same leaf, in ``orders`` orders numbered from ``first``."""

    def keys(reps: list, groups: list, blobs: list) -> Iterable[tuple]:
        for rep, g, blob in zip(reps, groups, blobs, strict=True):
            x = np.frombuffer(blob, np.float32)
            for t in range(first, first + orders):
                yield t, g, int.from_bytes(np.packbits(planes(t, len(x)) @ x > 0).tobytes(), "big"), rep, blob

    keyed = map_rows(classes, ["rep", "g", "narrow"], "t int, g string, k long, rep long, narrow binary", keys)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for run in grouped(batches, 2, LEAF):
                x = matrix((r[4] for r in run), np.float32)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                k = min(NEIGHBOURS, len(run) - 1)
                if k:
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    for i, row in enumerate(best):
                        for j in row:
                            yield run[i][3], run[j][3], float(s[i, j])

        yield from batches_of(rows(), PAIR, ["u", "v", "s"])

    order = ["t", "g", "k", "rep"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(near, "u long, v long, s float")


_planes: dict[tuple[int, int], np.ndarray] = {}


def planes(t: int, dims: int) -> np.ndarray:
    if (t, dims) not in _planes:
        _planes[t, dims] = np.random.default_rng([7, t, dims]).normal(size=(BITS, dims)).astype(np.float32)
    return _planes[t, dims]


def best(found: DataFrame) -> DataFrame:
    """The ``NEIGHBOURS`` nearest of each node, of rows (u, v, s, fresh); a pair known before isn't fresh."""
    each = found.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
    n = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))
    return each.withColumn("n", n).where(F.col("n") <= NEIGHBOURS).drop("n")


def local_joins(graph: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (u, v, s): pairs of neighbours of a node that would enter a list."""
    ends = graph.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("s")).otherwise(F.lit(-2.0).cast("float")).alias("end"))
    ahead = graph.select(F.col("u").alias("m"), F.col("v").alias("x"), "fresh")
    back = graph.select(F.col("v").alias("m"), F.col("u").alias("x"), "fresh")
    busy = ahead.union(back).groupBy("m").agg(F.max("fresh").alias("any")).where("any").select("m")
    hubs = back.groupBy("m").agg(F.ceil(F.count("*") / F.lit(JOINED)).cast("int").alias("chunks"))
    back = back.join(hubs, "m").select("m", F.pmod(F.xxhash64("x"), "chunks").cast("int").alias("c"), "x", "fresh")
    ahead = ahead.join(hubs, "m", "left").select("m", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("c"), "x", "fresh")
    members = ahead.union(back).join(busy, "m").groupBy("m", "c", "x").agg(F.max("fresh").alias("fresh"))
    known = classes.select(F.col("rep").alias("x"), "narrow").join(ends.withColumnRenamed("u", "x"), "x")
    full = members.join(known, "x").select("m", "c", "x", "fresh", "end", "narrow")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for run in grouped(batches, 2):
                x = matrix((r[5] for r in run), np.float32)
                s = x @ x.T
                fresh, end = np.array([r[3] for r in run]), np.array([r[4] for r in run], np.float32)
                enters = (s > end[:, None]) & (fresh[:, None] | fresh[None, :])
                np.fill_diagonal(enters, False)
                for i, j in zip(*np.nonzero(enters), strict=True):
                    yield run[i][2], run[j][2], float(s[i, j])

        yield from batches_of(rows(), PAIR, ["u", "v", "s"])

    return full.repartition("m", "c").sortWithinPartitions("m", "c").mapInArrow(near, "u long, v long, s float")


def certain(graph: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b): the graph's links; those near the threshold are computed in double precision."""
    close = graph.where(F.col("s") >= threshold - DOUBT).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"), "s").distinct()
    sure = close.where(F.col("s") >= threshold + DOUBT).select("a", "b")
    open_ = close.where(F.col("s") < threshold + DOUBT).select("a", "b").distinct()
    wide = lambda c, x: classes.select(F.col("rep").alias(c), F.col("wide").alias(x))

    def rows(a: list, b: list, x: list, y: list) -> Iterable[tuple]:
        for i, j, p, q in zip(a, b, x, y, strict=True):
            if float(np.frombuffer(p) @ np.frombuffer(q)) >= threshold:
                yield i, j

    checked = map_rows(open_.join(wide("a", "x"), "a").join(wide("b", "y"), "b"), ["a", "b", "x", "y"], "a long, b long", rows)
    return sure.union(checked)


def saturated(graph: DataFrame, threshold: float) -> DataFrame:
    """Rows (rep): nodes whose list is full of links, so that others may have found no place in it."""
    ends = graph.groupBy("u").agg(F.count("*").alias("k"), F.min("s").alias("end"))
    return ends.where((F.col("k") >= NEIGHBOURS) & (F.col("end") >= threshold - DOUBT)).select(F.col("u").alias("rep"))


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (g, part, block, rep, wide, centre, radius) of rows (g, part, rep, wide): at most ``BLOCK`` of a part, near in one order; the first of each has its centre and the widest angle to it."""

    def keys(groups: list, parts: list, reps: list, blobs: list) -> Iterable[tuple]:
        for g, part, rep, blob in zip(groups, parts, reps, blobs, strict=True):
            x = np.frombuffer(blob).astype(np.float32)
            yield g, part, int.from_bytes(np.packbits(planes(0, len(x)) @ x > 0).tobytes(), "big"), rep, blob

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for run in grouped(batches, 2, BLOCK):
                x = matrix((r[4] for r in run), np.float64)
                mean = x.mean(axis=0)
                centre = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-6 else x[0]
                radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
                for n, r in enumerate(run):
                    yield r[0], r[1], run[0][3], r[3], r[4], None if n else centre.tobytes(), None if n else radius

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64()]
        yield from batches_of(out(), kinds, ["g", "part", "block", "rep", "wide", "centre", "radius"])

    keyed = map_rows(rows, ["g", "part", "rep", "wide"], "g string, part long, k long, rep long, wide binary", keys)
    order = ["g", "part", "k", "rep"]
    schema = "g string, part long, block long, rep long, wide binary, centre binary, radius double"
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, schema)


def across(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b): links that join what all links of rows (g, part, rep, wide) join, without those inside a part; a null part is compared with itself too.

    Blocks whose centres are further apart than both radii and the threshold's angle hold no link;
    all others are compared in double precision. Of a pair of blocks, only a forest of its links is listed.
    """
    cut, _ = written(blocks(rows), "nn")
    centres = cut.where("centre is not null").select("g", "part", "block", "centre", "radius")
    sizes = centres.groupBy("g").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("chunks"))
    placed = centres.join(sizes, "g").withColumn("c", F.pmod(F.xxhash64("block"), "chunks").cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("g", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "part", "block", "centre", "radius")
    reach = float(np.arccos(threshold)) + 1e-6

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for run in grouped(batches, 3):
                x, r, c = matrix((r[6] for r in run), np.float64), np.array([r[7] for r in run]), np.array([r[3] for r in run])
                close = np.triu(np.arccos(np.clip(x @ x.T, -1, 1)) <= r[:, None] + r[None, :] + reach)
                if run[0][1] != run[0][2]:
                    close &= c[:, None] != c[None, :]
                for i, j in zip(*np.nonzero(close), strict=True):
                    if run[i][4] is None or run[i][4] != run[j][4]:
                        yield run[i][5], run[j][5]

        yield from batches_of(out(), [pa.int64(), pa.int64()], ["p", "q"])

    pairs = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(near, "p long, q long")
    asked = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    members = asked.join(cut.select("block", "rep", "wide"), "block").select("p", "q", "rep", "wide")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for run in grouped(batches, 2):
                x = matrix((r[3] for r in run), np.float64)
                for i, j in forest(x @ x.T >= threshold):
                    yield run[i][2], run[j][2]

        yield from batches_of(out(), [pa.int64(), pa.int64()], ["a", "b"])

    return members.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(links, "a long, b long")


def forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a symmetric relation that join all that it joins, fewer than its rows."""
    left = np.ones(len(linked), bool)
    for start in range(len(linked)):
        ahead = [start] if left[start] else []
        left[start] = False
        while ahead:
            i = ahead.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            for j in new.tolist():
                yield i, j
                ahead.append(j)


def enlarged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component), joined by further links (a, b)."""
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.union(links), "nn")


def counted(found: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (rep, links): for the members of components (node, component), the vectors linked with each, without its own copies."""
    size = F.count("*")
    chunks = F.greatest(F.least(F.ceil(size / F.lit(BLOCK)), F.lit(CHUNKS)), F.ceil(size / F.lit(WIDE)))
    sizes = found.groupBy("component").agg(chunks.cast("int").alias("chunks"))
    members = found.join(sizes, "component").select("component", F.col("node").alias("rep"), "chunks", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("c"))
    members = members.join(classes.select("rep", "n", "wide"), "rep")
    dealt = members.select("component", "rep", "n", "wide", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    dealt = dealt.select("component", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "rep", "n", "wide")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for run in grouped(batches, 3):
                x, n, c = matrix((r[6] for r in run), np.float64), np.array([r[5] for r in run]), np.array([r[3] for r in run])
                apart = run[0][1] != run[0][2]
                for at in range(0, len(run), BLOCK):
                    linked = x[at : at + BLOCK] @ x.T >= threshold
                    own = np.arange(len(linked))
                    linked[own, own + at] = False
                    if apart:
                        linked &= c[at : at + BLOCK, None] != c[None, :]
                    for r, k in zip(run[at : at + BLOCK], (linked @ n).tolist(), strict=True):
                        yield r[4], k

        yield from batches_of(rows(), [pa.int64(), pa.int64()], ["rep", "links"])

    pieces = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(count, "rep long, links long")
    return pieces.groupBy("rep").agg(F.sum("links").alias("links"))


def audit(classes: DataFrame, found: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The mean part of a vector's links that ``counts`` has, the lower of vectors with few and with many links.

    Samples of the vectors in small components, in large ones and in none are compared with all by brute
    force; each stands for its kind's share. That of the vectors in none grows with their number for
    each linked one, so that missed links show up in it.
    """
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    kinds = found.join(sizes, "component").select(F.col("node").alias("rep"), F.when(F.col("size") <= NEIGHBOURS + 1, "small").otherwise("large").alias("kind"))
    rows = classes.select("rep", "g", "wide").join(kinds, "rep", "left").withColumn("kind", F.coalesce("kind", F.lit("none")))
    total = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    linked = total.get("small", 0) + total.get("large", 0)
    loose = 3 * total.get("none", 0) / ((1 - RECALL) * linked) if linked else AUDIT_MOST
    by: dict[str, list] = {}
    weight: dict[int, float] = {}
    for kind, held in total.items():
        size = AUDIT if kind != "none" else int(min(max(loose, AUDIT), AUDIT_MOST))
        for r in rows.where(F.col("kind") == kind).orderBy(F.xxhash64(F.lit("audit"), "rep"), "rep").limit(size).collect():
            by.setdefault(r.g, []).append((r.rep, bytes(r.wide)))
            weight[r.rep] = held / min(size, held)
    asked = classes.sparkSession.sparkContext.broadcast(by)  # at most AUDIT_MOST and twice AUDIT vectors

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, int]] = {}
        queries = {g: (np.array([r for r, _ in rows]), matrix((b for _, b in rows), np.float64)) for g, rows in asked.value.items()}
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                reps, groups, ns, blobs = (c.to_pylist() for c in batch.slice(first, 512).columns)
                for g in set(groups) & queries.keys():
                    names, x = queries[g]
                    at = [i for i, h in enumerate(groups) if h == g]
                    hits = x @ matrix((blobs[i] for i in at), np.float64).T >= threshold
                    hits &= names[:, None] != np.array([reps[i] for i in at])[None, :]
                    real, near = hits @ np.array([ns[i] for i in at]), hits.sum(axis=1)
                    for i in np.flatnonzero(near).tolist():
                        r, k = total.get(int(names[i]), (0, 0))
                        total[int(names[i])] = r + int(real[i]), k + int(near[i])
        yield from batches_of(((n, r, k) for n, (r, k) in total.items()), [pa.int64(), pa.int64(), pa.int64()], ["rep", "real", "near"])

    true = classes.select("rep", "g", "n", "wide").mapInArrow(brute, "rep long, real long, near long").groupBy("rep").agg(F.sum("real").alias("real"), F.sum("near").alias("near"))
    parts: dict[bool, list[float]] = {}
    for r in true.join(counts, "rep", "left").collect():
        part = parts.setdefault(r.near <= NEIGHBOURS, [0.0, 0.0])
        part[0] += weight[r.rep] * min((r.links or 0) / r.real, 1.0)
        part[1] += weight[r.rep]
    asked.unpersist()
    return min((f / t for f, t in parts.values()), default=1.0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, n_links, component) of all vectors."""
    spark = vectors.sparkSession
    all_rows, _ = written(nodes(vectors, id_col, vector_col, label_col), "nn")
    classes = all_rows.where("digest is not null").groupBy("g", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("wide").alias("wide"), F.first("narrow").alias("narrow"))
    classes, _ = written(classes, "nn")
    total = classes.count()
    graph, path, first, recall = None, None, 0, -1.0
    while True:
        fresh = leaves(classes, first, ORDERS).withColumn("fresh", F.lit(True))
        first += ORDERS
        graph, path = renewed(best(fresh if graph is None else fresh.unionByName(graph.withColumn("fresh", F.lit(False)))), path)
        for _ in range(ROUNDS):
            joined = local_joins(graph, classes).withColumn("fresh", F.lit(True))
            graph, path = renewed(best(joined.unionByName(graph.withColumn("fresh", F.lit(False)))), path)
            if graph.where("fresh").count() <= SETTLED * NEIGHBOURS * total:
                break
        found, _ = written(components(certain(graph, classes, threshold), "nn"), "nn")
        full = saturated(graph, threshold).join(classes.select("g", "rep", "wide"), "rep").join(found, F.col("rep") == F.col("node"), "left")
        full = full.select("g", F.coalesce("component", "rep").alias("part"), "rep", "wide")
        found, _ = written(enlarged(found, across(full, threshold)), "nn")
        counts, _ = written(counted(found, classes, threshold), "nn")
        before, recall = recall, audit(classes, found, counts, threshold)
        if recall >= RECALL:
            break
        if recall <= before:  # more orders don't help: all vectors of a label, block by block
            every = classes.select("g", F.lit(None).cast("long").alias("part"), "rep", "wide")
            found, _ = written(enlarged(found, across(every, threshold)), "nn")
            counts, _ = written(counted(found, classes, threshold), "nn")
            break
    forget(spark, path)
    of = classes.select("g", "digest", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    of = of.select("g", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    whole = all_rows.select("id", "g", "digest").join(of, ["g", "digest"], "left")
    return whole.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def renewed(graph: DataFrame, path: str | None) -> tuple[DataFrame, str]:
    """The graph as a new table; the one that it came from is deleted."""
    out = written(graph, "nn")
    if path:
        forget(graph.sparkSession, path)
    return out


def op8_nn_descent(spark, sf_dir: str) -> DataFrame:
    """One row for each vector; vectors that can't link and repeated rows as at the top."""
    found = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


#: Brute force: all pairs of a label, then the smallest id that links reach.
OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a
)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
