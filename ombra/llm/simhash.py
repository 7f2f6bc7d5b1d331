"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint is the bitwise majority of the hashes of its word shingles. Fingerprints
within ``RADIUS`` differing bits are linked and a component takes the smallest document id. Where
texts that share fewer shingles are to be found, a document has several fingerprints.

Candidates come from an exact pigeonhole split: of six bit blocks at least two are untouched by
four differing bits, so every link meets under one of fifteen pairs of blocks. Tables with more
fingerprints take seven or eight blocks, three or four of them untouched, whose longer keys keep as
few rows under each; every split finds the same links. Rows that meet are
gathered into blocks of bit planes (bit k of all fingerprints lies in one run of words) and many
distances are counted at once with carry-save adders; a query leaves the block as soon as all its
distances exceed the radius. A block gives a star for each component of its links, never all pairs.
A key with more rows than ``CHUNK`` is dealt out as pairs of hashed chunks, so no task holds it whole.

Defined results: a null text is empty, and a text without words has fingerprint zero; equal rows
are linked and each is returned; a row with a null id has a fingerprint, links with nothing and has
a null component; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ombra.llm.common import components, documents, large, map_rows, text_bytes, written

WORDS, SEED, RADIUS = 4, 42, 4
#: Rows under keys that are compared in one go, rows of a chunk of a key with more, and queries asked at once.
BLOCK, CHUNK, QUERIES = 1024, 8192, 128
#: Blocks of a fingerprint, and up to how many fingerprints: the rows under a key stay near ``BLOCK``.
SPLITS = ((6, 1 << 31), (7, 1 << 37), (8, 1 << 62))


def parts(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block, as even as can be."""
    cuts = [64 * n // blocks for n in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def shingles(text: bytes, size: int = WORDS) -> list[bytes]:
    """The shingles of a text in UTF-8, with repeats; ASCII capitals are lowered."""
    words = text.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    return [joined[i : j - 1] for i, j in zip(chain((0,), ends), ends[size - 1 :], strict=False)]


def majority(hashes: np.ndarray) -> bytes:
    """The bits that more than half of some 64-bit hashes (rows of eight bytes) have, most significant first."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16320):
        bits = np.unpackbits(hashes[at : at + 16320]).reshape(-1, 64)
        whole = len(bits) // 255
        counts += np.add.reduce(bits[: whole * 255].reshape(whole, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole * 255 :].sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def remixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of the same shingles."""
    x = hashes.view(">u8").astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(31)).astype(">u8").view(np.uint8)


def fingerprint(text: bytes, size: int = WORDS, seed: int = SEED, prints: int = 1) -> list[bytes]:
    """Fingerprints of eight bytes: the first of the shingles' hashes, further ones of the same hashes mixed anew."""
    digest = xxhash.xxh64_digest
    found = [digest(s, seed) for s in shingles(text, size)]
    if not found:
        return [bytes(8)] * prints
    hashes = np.frombuffer(b"".join(found), np.uint8)
    return [majority((remixed(hashes, turn) if turn else hashes).reshape(-1, 8)) for turn in range(prints)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, prints: int = 1) -> DataFrame:
    """Rows (id, fps, key): the fingerprints as signed 64-bit integers, and a hash of the text."""

    def rows(ids: list, keys: list, texts: list) -> Iterable[tuple]:
        for i, key, t in zip(ids, keys, texts, strict=True):
            yield i, [int.from_bytes(x, "big", signed=True) for x in fingerprint(t, size, SEED, prints)], key

    return map_rows(docs, [F.col(id_col).cast("long").alias("id"), text_key(text_col), text_bytes(text_col)], "id long, fps array<long>, key long", rows)


def text_key(text_col: str = "text") -> Column:
    return F.xxhash64(text_col).alias("key")


def planes_of(block: np.ndarray) -> np.ndarray:
    """Bit k of all fingerprints (uint64) as a run of words, for each k."""
    width = -(-len(block) // 64)
    padded = np.zeros((64, width * 64), np.uint8)
    padded[:, : len(block)] = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, planes: np.ndarray, rows: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, row of the block) of uint64 pairs within ``radius`` (at most 6) differing bits; the block's rows are given by their planes."""
    width = planes.shape[1]
    asked = np.unpackbits(queries.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(bool)
    there = np.packbits(np.arange(width * 64) < rows, bitorder="little").view(np.uint64)
    live, full = np.arange(len(queries)), np.uint64(0xFFFFFFFFFFFFFFFF)
    ones, twos, fours, over = (np.zeros((len(queries), width), np.uint64) for _ in range(4))
    within = np.zeros((0, width), np.uint64)
    for k in range(0, 64, 2):
        flip = np.where(asked[live, k : k + 2], full, np.uint64(0))
        d, e = planes[k] ^ flip[:, :1], planes[k + 1] ^ flip[:, 1:]
        half = ones ^ d  # a full adder of ones, d and e
        carry = (ones & d) | (half & e)
        ones = half ^ e
        carry, twos = twos & carry, twos ^ carry
        carry, fours = fours & carry, fours ^ carry
        over |= carry
        if k % 8 == 6:
            beyond = over | exceeds(ones, twos, fours, radius)
            within = ~beyond & there
            left = within.any(axis=1)
            if not left.all():
                live, ones, twos, fours, over, within = (x[left] for x in (live, ones, twos, fours, over, within))
                if not len(live):
                    break
    hits = np.unpackbits(within.view(np.uint8).reshape(len(live), -1), axis=1, bitorder="little")
    q, r = np.nonzero(hits)
    return live[q], r


def exceeds(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Where the three-bit counters are over ``radius``."""
    out, equal = np.zeros_like(ones), np.full_like(ones, 0xFFFFFFFFFFFFFFFF)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal = equal & plane
        else:
            out |= equal & plane
    return out


def joined(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the first row of its component, components being joined by links within ``radius``.

    A run of queries at a time meets the whole block; only pairs of different components count, and
    once all is one component nothing is left to ask.
    """
    low, planes = np.arange(len(fps)), planes_of(fps)
    for at in range(0, len(fps), QUERIES):
        if not low.any():
            break
        q, r = near(fps[at : at + QUERIES], planes, len(fps), radius)
        q = q + at
        while len(q):
            a, b = low[q], low[r]
            apart = a != b
            q, r, a, b = q[apart], r[apart], a[apart], b[apart]
            # every label goes to the least that a pair gives it, and on to where that one goes
            to = np.arange(len(fps))
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(further := to[to], to):
                to = further
            low = to[low]
    return low


def links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Rows (a, b): links between the nodes of rows (turn, fp, node) that keep every component whole; fingerprints of different turns don't meet."""
    if radius > 4:
        raise ValueError("the splits are exact up to four differing bits")
    if blocks is None:
        total = prints.count()
        blocks = next(n for n, most in SPLITS if total <= most)
    cuts = parts(blocks)
    part = lambda n: F.shiftrightunsigned("fp", cuts[n][0]).bitwiseAND((1 << cuts[n][1]) - 1)
    # the turn, the number of the choice, and untouched blocks side by side: at most 7 and 32 bits
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - 4)):
        key = F.shiftleft(F.col("turn").cast("long"), 7).bitwiseOR(F.lit(n))
        for i in chosen:
            key = F.shiftleft(key, cuts[i][1]).bitwiseOR(part(i))
        keys.append(key)
    keyed = prints.select(F.explode(F.array(*keys)).alias("key"), "fp", "node", F.col("turn").cast("long").alias("turn"))
    counts = keyed.groupBy("key").count().where("count > 1")
    chunks = F.ceil(F.col("count") / F.lit(CHUNK)).cast("int")
    met = keyed.join(large(counts), "key").select("key", "fp", "node", "turn", chunks.alias("n"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("c"))
    one = met.where("n = 1").select("turn", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "node")
    hot = met.where("n > 1").select("key", "fp", "node", "turn", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    dealt = one.unionByName(hot.select("turn", "key", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "fp", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for group in runs(batches, 4):
            if held and (sum(map(len, held)) + len(group) > BLOCK or held[-1][0, 0] != group[0, 0]):
                yield compared(held, radius)
                held = []
            held.append(group)
        if held:
            yield compared(held, radius)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("turn", "key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """The rows (of long columns) of each run with equal first columns; runs may cross batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        rows = rows if rest is None else np.concatenate((rest, rows))
        cuts = np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1
        *done, rest = np.split(rows, cuts)
        yield from done
    if rest is not None:
        yield rest


def compared(held: list[np.ndarray], radius: int) -> pa.RecordBatch:
    rows = np.concatenate(held)
    fps, first = np.unique(rows[:, 4], return_index=True)
    nodes, low = rows[first, 5], joined(fps.view(np.uint64), radius)
    found = np.flatnonzero(low != np.arange(len(fps)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[low[found]], pa.int64()), pa.array(nodes[found], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, size: int = WORDS, prints: int = 1) -> DataFrame:
    """Rows (id, fp, key, component, group) of all documents: ``fp`` is the first fingerprint, ``key`` hashes the text, ``group`` numbers what is linked.

    With more than one fingerprint, documents are linked if any of theirs are within the radius:
    the chance of finding texts that share fewer shingles grows with each.
    """
    found, _ = written(fingerprints(docs, id_col, text_col, size, prints), "simhash")
    classes = found.where("id is not null").groupBy("fps").agg(F.min("id").alias("rep"))
    classes, _ = written(classes.withColumn("node", F.monotonically_increasing_id()), "simhash")
    # for each fingerprint of a turn, one of its documents' classes stands for all
    each = classes.select("node", F.posexplode("fps").alias("turn", "fp"))
    firsts, _ = written(each.groupBy("turn", "fp").agg(F.min("node").alias("node")), "simhash")
    edges = links(firsts, radius)
    if prints > 1:
        same = each.join(large(firsts.withColumnRenamed("node", "first")), ["turn", "fp"]).where("node <> first")
        edges = edges.union(same.select(F.col("node").alias("a"), F.col("first").alias("b")))
    tied = components(edges, "simhash").select(F.col("node").alias("own"), "component")
    of = classes.join(large(tied), F.col("node") == F.col("own"), "left").select("fps", "rep", F.coalesce("component", "node").alias("group"))
    lowest = of.groupBy("group").agg(F.min("rep").alias("component"))
    # written, so that adaptive execution may split the join where a fingerprint is hot
    of, _ = written(of.join(large(lowest), "group").select("fps", "group", "component"), "simhash")
    linked = F.col("id").isNotNull()
    whole = found.join(large(of), "fps", "left")
    return whole.select("id", F.get("fps", F.lit(0)).alias("fp"), "key", F.when(linked, F.col("component")).alias("component"), F.when(linked, F.col("group")).alias("group"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """One row for each document; nulls, empty texts and repeated rows as at the top."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
