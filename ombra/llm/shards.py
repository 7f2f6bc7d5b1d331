"""Token shards in training order.

Documents become ids, closed by an end id, and are cut into sequences of ``LENGTH`` ids. Every
sequence has a number; a keyed Feistel permutation of the numbers, walked along its cycle until it
falls inside the range, gives its global slot. Range partitions of the slots write shards of
records with a fixed stride, so slot s lies in shard s // SHARD at byte (s % SHARD) * STRIDE: a
reader goes through a shard in order, and can resume at any slot without reading what is before.

A record is little-endian: the document id (int64), the sequence's number within the document
(uint32), its ids (uint16), a flag for a null document id (uint16), then ``LENGTH`` ids (uint16),
filled with the end id. Shards are rows of a Parquet table in the shared folder, (shard, first,
records, crc32, payload), so that any store can hold them and a lost task is simply written again;
``read_slots`` reads a range of them.

Numbers follow a stable order of the documents, by a hash of id and text, then id, then ids: the
same documents get the same slots however the input is split or ordered. The hash's first bits name
a bucket; documents are numbered within buckets, and a table of one row for each bucket (at most
2**``BUCKET``) has what comes before it, so no task orders more than a bucket.

Defined results: a null or empty text is one sequence with the end id only; equal rows are
sequences of their own, and share their slots; a null id is flagged; other columns of the input are ignored; an empty
table gives no shards.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ombra.llm.common import documents, map_rows, written
from ombra.llm.pieces import text_or_empty

RANKS = "byte_bpe_50k.tiktoken"
END = 50256
LENGTH = 512
HEAD = "<qIHH"
HEAD_SIZE = struct.calcsize(HEAD)
STRIDE = HEAD_SIZE + 2 * LENGTH
#: Sequences of a shard.
SHARD = 4096
KEY = "order-1"
ROUNDS = 4
#: Bits of a document's hash that name its bucket.
BUCKET = 16
#: Shards that a task writes, while there are no more tasks than a driver bears; bytes of a row group, which a reader takes at once.
RUN, TASKS, GROUP = 4, 50_000, 1 << 24

_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """One for each process."""
    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_ids(text: str, path: str) -> np.ndarray:
    ids = encoding(path).encode_to_numpy(text, disallowed_special=())
    return np.append(ids, END).astype("<u2")


def feistel(numbers: np.ndarray, total: int, key: str = KEY) -> np.ndarray:
    """Slots of sequence numbers: a permutation of 0 .. total - 1.

    The two halves of an even number of bits are mixed by rounds keyed with a digest; slots beyond
    the range are permuted again. The domain is under four times the range.
    """
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little") | 1) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                y = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                y ^= y >> np.uint64(29)
                y = (y ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (y >> np.uint64(32) & mask)
        return left << np.uint64(half) | right

    out = once(numbers.astype(np.uint64))
    while (beyond := out >= np.uint64(total)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def packed(data: bytes) -> bytes:
    """Ids as they are shuffled and kept on the way."""
    return _pack.compress(data)


def unpacked(data: bytes) -> bytes:
    return _unpack.decompress(data)


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows (bucket, key, id, n, ids): a document's hash and its first bits, its number of sequences, and its ids, packed."""
    path = path or public_tokenizers.path(RANKS)

    def rows(buckets: list, keys: list, ids: list, texts: list) -> Iterable[tuple]:
        for bucket, key, i, text in zip(buckets, keys, ids, texts, strict=True):
            blob = token_ids(text, path).tobytes()
            yield bucket, key, i, -(-len(blob) // (2 * LENGTH)), packed(blob)

    own = F.col(id_col).cast("long")
    key = F.xxhash64(F.lit("order"), own, F.coalesce(F.col(text_col), F.lit("")))
    columns = [F.shiftrightunsigned(key, 64 - BUCKET).cast("int"), key, own, text_or_empty(text_col)]
    return map_rows(docs, columns, "bucket int, key long, id long, n long, ids binary", rows)


def before_in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, before, id, n, ids) of rows (bucket, key, id, n, ids) in order: ``before`` counts the sequences before each in its bucket."""
    last, carried = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        buckets, ns = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        sums = np.cumsum(ns)
        starts = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1))
        # what is summed up to the start of each row's bucket in this batch; the first may go on from the batch before
        base = np.repeat(np.concatenate(([0], sums))[starts], np.diff(np.append(starts, len(ns))))
        before = sums - ns - base
        if buckets[0] == last:
            before[: starts[1] if len(starts) > 1 else None] += carried
        last, carried = buckets[-1], int(before[-1] + ns[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.int64()), *batch.columns[2:]], names=["bucket", "before", "id", "n", "ids"])


def numbered(tokens: DataFrame) -> tuple[DataFrame, int]:
    """Rows (id, ids, number), the number being that of a document's first sequence, and the number of sequences."""
    order = ["bucket", "key", "id", "ids"]
    held = tokens.repartition("bucket").sortWithinPartitions(*order).mapInArrow(before_in_bucket, "bucket int, before long, id long, n long, ids binary")
    held, _ = written(held, "shards", compression="none")
    sizes = held.groupBy("bucket").agg(F.sum("n").alias("n"))
    # a row for each bucket: 2**BUCKET at most, which bounds the window and the broadcast
    base = sizes.select("bucket", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("n")).alias("base"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return held.join(F.broadcast(base), "bucket").select("id", "ids", (F.col("base") + F.col("before")).alias("number")), total


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, path: str | None = None, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The table of shards, (shard, first, records, crc32, payload), and the number of sequences."""
    sequences, total = numbered(tokenised(docs, id_col, text_col, path))

    def records(ids: list, blobs: list, numbers: list) -> Iterable[tuple]:
        blobs = [unpacked(b) for b in blobs]
        counts = [-(-len(b) // (2 * LENGTH)) for b in blobs]
        # the numbers of all these documents' sequences, permuted at once
        own = np.arange(sum(counts)) - np.repeat(np.cumsum([0, *counts[:-1]]), counts)
        slots = iter(feistel(np.repeat(np.array(numbers, np.int64), counts) + own, total, key).tolist())
        for i, blob, count in zip(ids, blobs, counts, strict=True):
            for n in range(count):
                part, slot = blob[2 * LENGTH * n : 2 * LENGTH * (n + 1)], next(slots)
                yield slot // shard, slot, struct.pack(HEAD, i or 0, n, len(part) // 2, i is None) + part

    rows = map_rows(sequences, ["id", "ids", "number"], "shard long, slot long, record binary", records)
    shards = -(-total // shard)
    tasks = max(1, min(-(-shards // RUN), TASKS), min(shards, docs.sparkSession.sparkContext.defaultParallelism))
    # whole runs of shards by partition: slots are evenly spread, so the ranges need no sample
    dealt = rows.repartitionById(tasks, F.floor(F.col("shard") * tasks / F.lit(max(1, shards))).cast("int"))
    schema = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("records", pa.int64()), ("crc32", pa.int64()), ("payload", pa.binary())])
    fill = np.full(LENGTH, END, "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, first = None, [], 0

        def done() -> pa.RecordBatch:
            payload = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, first, len(held), zlib.crc32(payload), payload), schema, strict=True)], schema=schema)

        for batch in batches:
            for own, slot, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != now:
                    if held:
                        yield done()
                    now, held, first = own, [], slot
                held.append(record + fill[: STRIDE - len(record)])
        if held:
            yield done()

    out = dealt.sortWithinPartitions("slot").mapInArrow(run, "shard long, first long, records long, crc32 long, payload binary")
    return written(out, "shards", compression="zstd", **{"parquet.block.size": str(GROUP)})[0], total


def read_slots(shards: DataFrame, start: int = 0, stop: int | None = None, shard: int = SHARD) -> DataFrame:
    """Rows (slot, shard, offset, id, seq, n_tokens, ids) of slots start .. stop - 1; other shards aren't read. Damage is an error."""
    picked = shards.where(F.col("shard") >= start // shard)
    if stop is not None:
        picked = picked.where(F.col("shard") <= (stop - 1) // shard)

    def rows(names: list, firsts: list, sums: list, payloads: list) -> Iterable[tuple]:
        for name, first, crc, payload in zip(names, firsts, sums, payloads, strict=True):
            if zlib.crc32(payload) != crc:
                raise ValueError(f"shard {name} is damaged")
            low = max(0, start - first)
            high = len(payload) // STRIDE if stop is None else min(len(payload) // STRIDE, stop - first)
            for k in range(low, high):
                i, seq, n, null = struct.unpack_from(HEAD, payload, k * STRIDE)
                at = k * STRIDE + HEAD_SIZE
                yield first + k, name, k * STRIDE, None if null else i, seq, n, payload[at : at + 2 * n]

    return map_rows(picked, ["shard", "first", "crc32", "payload"], "slot long, shard long, offset long, id long, seq int, n_tokens int, ids binary", rows)


def op10_shards(spark, sf_dir: str) -> DataFrame:
    """Every sequence as read back from the shards; nulls, empty texts and repeated rows as at the top."""
    shards, _ = write_shards(documents(spark, sf_dir))
    return read_slots(shards).select(F.col("id").alias("doc_id"), "seq", "slot", "shard", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
