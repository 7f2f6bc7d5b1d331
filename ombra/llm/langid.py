"""Language identification: averaged hashed subword embeddings, a linear softmax, and rejection.

A word's features are its character n-grams and itself, hashed into rows of an embedding table; a
text is the mean of its features' embeddings, classified by a linear softmax. Training is
mini-batch gradient descent in numpy on a bounded, stratified sample of labelled rows, each taught
by its whole text: executors turn a text into its features with their counts, which are no more
than the table has rows, however long the text. As the classifier is linear, a text's class scores are the mean of its features' scores, so
a word's score sum is worked out once for each process and whole texts are cheap.

Scores are calibrated by a temperature, fitted on sampled rows that training left out; a text is
rejected if its calibrated score is under a threshold that those rows set: the score that all but
``REJECT`` of the rightly classified ones reach, and at most ``CEILING``.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; ties
of scores go to the first language in order; a table without labelled rows teaches nothing, and
every text of it is ``und``; rows with a null language are classified but teach nothing; equal rows
give equal rows, and each may be drawn by itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ombra.llm.common import documents, given_back, map_rows

UNKNOWN = "und"
#: Bounds of the training sample: rows a language, and languages, the most frequent ones.
ROWS, LANGUAGES = 400, 256
#: One sampled row in this many calibrates instead of teaching.
CALIBRATE = 4
HASHES, DIMS = 1 << 16, 16
#: Passes over the sample, but for small ones as many steps at least.
EPOCHS, STEPS, BATCH, RATE = 6, 240, 32, 2.0
GRAMS = (1, 2, 3, 4)
#: The part of rightly classified calibration rows that may be rejected, and the highest threshold.
REJECT, CEILING = 0.001, 0.4
#: Words kept in a process's table of scores, and words looked up in one go; a table holds at least a run.
TABLE, RUN = 150_000, 50_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of many words at once: hashes, and the place of the word that each belongs to.

    A word's letters stand between marks; its n-grams and the whole are hashed from code points.
    A word without letters has no features.
    """
    letters = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]
    sizes = np.array([len(w) + 2 if w else 0 for w in letters], np.int64)
    points = np.frombuffer("".join([f"<{w}>" for w in letters if w]).encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = (np.cumsum(sizes) - sizes)[owner]
    left = sizes[owner] - (np.arange(len(points)) - starts)
    out, owners = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolled[: len(points) - n + 1] = rolled[: len(points) - n + 1] * PRIME + points[n - 1 :]
        if n in GRAMS:
            there = left >= n
            out.append(mixed(rolled[there] + np.uint64(n)))
            owners.append(owner[there])
    place = (np.arange(len(points)) - starts).astype(np.uint64)
    full = np.add.reduceat(spread(points * PRIME + place), np.flatnonzero(place == 0))
    out.append(mixed(full))
    owners.append(owner[place == 0])
    return np.concatenate(out), np.concatenate(owners)


PRIME = np.uint64(0x100000001B3)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def mixed(x: np.ndarray) -> np.ndarray:
    return (spread(x) % np.uint64(HASHES)).astype(np.int64)


@dataclass
class Model:
    """``scores`` is the embedding table times the classifier: a row of class scores for each hash."""

    names: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def rows_of(self, words: list[str]) -> list[int]:
        """Rows of the words in the table of score sums and feature counts; unknown words are added."""
        known, table = words_known(self)
        rows = list(map(known.get, words))
        if None in rows:
            fresh = list(dict.fromkeys(w for w, r in zip(words, rows, strict=True) if r is None))
            if len(known) + len(fresh) > TABLE:
                known.clear()
                fresh = list(dict.fromkeys(words))
            ids, owners = hashed(fresh)
            at = len(known)
            for c in range(len(self.names)):
                table[at : at + len(fresh), c] = np.bincount(owners, self.scores[ids, c], len(fresh))
            table[at : at + len(fresh), -1] = np.bincount(owners, minlength=len(fresh))
            known.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            rows = list(map(known.get, words))
        return rows

    def logits(self, texts: list[str]) -> list[np.ndarray | None]:
        """Class scores of each text, or None for a text without a letter."""
        out: list[np.ndarray | None] = []
        total = np.zeros((len(texts), len(self.names) + 1))
        run: list[str] = []
        ends: list[tuple[int, int]] = []

        def add() -> None:
            if run:
                rows = self.rows_of(run)
                starts = [0, *(e for _, e in ends[:-1])]
                total[[n for n, _ in ends]] += np.add.reduceat(words_known(self)[1][rows], starts, axis=0, dtype=np.float64)
                run.clear()
                ends.clear()

        for n, text in enumerate(texts):  # one text's words at a time: a batch's would fill the memory
            words = words_of(text)
            for at in range(0, len(words), RUN):
                run += words[at : at + RUN]
                ends.append((n, len(run)))
                if len(run) >= RUN:
                    add()
        add()
        for row in total:
            out.append(row[:-1] / row[-1] + self.bias if row[-1] else None)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, calibrated score, and whether the text is rejected, for each text."""
        found = self.logits([t or "" for t in texts]) if self.names else [None] * len(texts)
        out = []
        for z in found:
            if z is None:
                out.append((UNKNOWN, 0.0, True))
                continue
            p = softmax(z / self.temperature)
            best = int(p.argmax())
            out.append((self.names[best], float(p[best]), bool(p[best] < self.threshold)))
        return out


_table: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def words_known(model: Model) -> tuple[dict[str, int], np.ndarray]:
    """The process's one table of words, which is the last model's: an earlier model's goes."""
    if model.key not in _table:
        _table.clear()
        _table[model.key] = {}, np.zeros((TABLE, len(model.names) + 1), np.float32)
    return _table[model.key]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text: hashes in order, and how often each occurs."""
    words = Counter(words_of(text))
    ids, owners = hashed(list(words))
    times = np.bincount(ids, np.array(list(words.values()), np.float64)[owners] if len(ids) else None, HASHES)
    found = np.flatnonzero(times)
    return found, times[found].astype(np.int64)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 9) -> Model:
    """A model of rows (language, features, counts), before calibration."""
    names = sorted({lang for lang, *_ in rows})
    rng = np.random.default_rng(seed)
    samples = [(names.index(lang), ids.astype(np.int32), (times / times.sum()).astype(np.float32)) for lang, ids, times in rows if len(ids)]
    if not samples:
        return Model([], np.zeros((HASHES, 0), np.float32), np.zeros(0, np.float32))
    embed = rng.uniform(-1 / DIMS, 1 / DIMS, (HASHES, DIMS)).astype(np.float32)
    weights, bias = np.zeros((DIMS, len(names)), np.float32), np.zeros(len(names), np.float32)
    share = np.bincount([y for y, *_ in samples], minlength=len(names))
    balance = (len(samples) / np.maximum(share, 1) / len(names)).astype(np.float32)
    batches = -(-len(samples) // BATCH)
    steps = max(EPOCHS, -(-STEPS // batches)) * batches
    for step in range(steps):
        if step % batches == 0:
            shuffled = np.array_split(rng.permutation(len(samples)), batches)
        batch = shuffled[step % batches]
        rate = RATE * (1 - step / steps)
        ids = np.concatenate([samples[i][1] for i in batch])
        parts = np.concatenate([samples[i][2] for i in batch])
        sizes = [len(samples[i][1]) for i in batch]
        mean = np.add.reduceat(embed[ids] * parts[:, None], np.cumsum([0, *sizes[:-1]]))
        y = np.array([samples[i][0] for i in batch])
        error = softmax(mean @ weights + bias)
        error[np.arange(len(y)), y] -= 1
        error *= balance[y, None] / len(batch)
        back = np.repeat(error @ weights.T, sizes, axis=0) * parts[:, None]
        weights -= rate * (mean.T @ error)
        bias -= rate * error.sum(axis=0)
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        embed[ids[order[firsts]]] -= rate * len(batch) * np.add.reduceat(back[order], firsts, axis=0)
    return Model(names, embed @ weights, bias)


def calibrate(model: Model, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Fit the temperature by likelihood and the threshold by the kept part of rows (language, features, counts)."""
    known = [(model.names.index(lang), (times @ model.scores[ids]) / times.sum() + model.bias) for lang, ids, times in rows if lang in model.names and len(ids)]
    if known:
        y, z = np.array([a for a, _ in known]), np.stack([b for _, b in known])
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
        p = softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        if len(right):
            model.threshold = float(min(CEILING, np.quantile(right, REJECT)))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: one in five by the checksum of the id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def sample(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Rows (language, order, features, counts): at most ``ROWS`` for each of ``LANGUAGES`` languages, the ones whose keys hash lowest.

    A key is of the whole row, so equal ids are no problem. Only rows under a bound of the hash that
    lets about twice as many through go to the window; a language with few rows has no bound.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), allowed.alias("allowed"))
    rows = rows.where("allowed and lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return []
    # keys are signed and evenly spread: the lowest part of them that holds twice the rows wanted
    bound = {r.lang: int(2**64 * min(1.0, 2 * max(ROWS, 32) / r["count"])) - 2**63 - 1 for r in sizes}
    limits = docs.sparkSession.createDataFrame(list(bound.items()), "lang string, bound long")
    keyed = rows.join(F.broadcast(limits), "lang").withColumn("key", F.xxhash64(F.lit("langid"), "id", "text")).where("key <= bound")

    def features(langs: list, keys: list, ids: list, texts: list) -> Iterable[tuple]:
        for lang, key, i, text in zip(langs, keys, ids, texts, strict=True):
            found, times = bag(text)
            if len(found):
                yield lang, key, i, found.astype("<u2").tobytes(), times.astype("<u4").tobytes()

    # texts without a letter teach nothing and take no place
    bags = map_rows(keyed, ["lang", "key", "id", "text"], "lang string, key long, id string, ids binary, times binary", features)
    n = F.row_number().over(W.partitionBy("lang").orderBy("key", "id", "ids"))
    picked = bags.withColumn("n", n).where(F.col("n") <= ROWS).collect()
    return sorted(((r.lang, r.n, np.frombuffer(r.ids, "<u2").astype(np.int64), np.frombuffer(r.times, "<u4").astype(np.int64)) for r in picked), key=lambda r: r[:2])


def fit(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train and calibrate on a bounded sample of the allowed labelled rows."""
    rows = sample(docs, allowed, id_col, text_col, lang_col)
    model = train([(lang, ids, times) for lang, n, ids, times in rows if n % CALIBRATE])
    return calibrate(model, [(lang, ids, times) for lang, n, ids, times in rows if not n % CALIBRATE])


def predict(docs: DataFrame, model: Model, columns: list[str | Column], schema: str, text_col: str = "text") -> DataFrame:
    """Rows of ``columns``, whose names and types ``schema`` gives, and lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: a row of scores for each hash

    def rows(texts: list, *kept: list) -> Iterable[tuple]:
        for *rest, found in zip(*kept, shared.value.predict(texts), strict=True):
            yield (*rest, *found)

    return map_rows(docs, [F.col(text_col), *columns], f"{schema}, lang_pred string, score double, rejected boolean", rows)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """One row for each document; nulls, empty texts and repeated rows as at the top."""
    docs = documents(spark, sf_dir)
    model = fit(docs, ~held_out())
    found = predict(docs, model, [F.col("doc_id").cast("long"), held_out()], "doc_id long, held_out boolean")
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.filter(pa.array([not rejected for *_, rejected in shared.value.predict(part.column(at).to_pylist())], pa.bool_()))
        given_back()

    return docs.mapInArrow(run, docs.schema)
