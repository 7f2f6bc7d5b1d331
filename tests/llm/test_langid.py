import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ombra.llm import langid

SYLLABLES = {"aa": "ka lo mi tu ra ne".split(), "bb": "sch ung ein der ach tz".split(), "cc": "eau oux ment tion é qui".split()}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(n=360):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        lang = ["aa", "aa", "bb", "cc"][i % 4]
        rows.append((i, text(lang, 40, rng), lang, "src", 0.5))
    return rows + [(9001, None, "aa", "src", 0.1), (9002, "", "aa", "src", 0.1), (9003, "12 34 ½ !", "bb", "src", 0.1), (9004, text("cc", 60000, rng), None, "src", 0.1), (9005, "Ka", None, None, 0.1)]


def test_query(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in langid.op9_langid(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i, t, lang, *_ in rows:
        r = found[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        if i in (9001, 9002, 9003):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    held = [(found[i].lang_pred, lang, found[i].rejected) for i, _, lang, *_ in rows if i < 9000 and found[i].held_out]
    assert sum(a == b for a, b, _ in held) >= 0.97 * len(held)
    assert sum(x for *_, x in held) <= 0.05 * len(held)
    assert found[9004].lang_pred == "cc" and not found[9004].rejected
    again = {r.doc_id: r for r in langid.op9_langid(spark, str(tmp_path)).collect()}
    assert again == found


def test_scores_are_the_mean_of_all_features(monkeypatch):
    monkeypatch.setattr(langid, "TABLE", 40)
    monkeypatch.setattr(langid, "RUN", 20)
    rng = np.random.default_rng(1)
    model = langid.Model(["x", "y"], rng.normal(size=(langid.HASHES, 2)).astype(np.float32), np.array([0.1, 0.2], np.float32))
    t = " ".join(text("cc", 50, rng) for _ in range(3))
    ids = np.concatenate([langid.hashed([w])[0] for w in langid.words_of(t)])
    together, alone = model.logits([t, "½ 3", "", t[:40]]), model.logits([t[:40]])
    assert np.allclose(together[0], model.scores[ids].mean(axis=0) + model.bias, atol=1e-4)
    assert together[1] is None and together[2] is None and np.allclose(together[3], alone[0])
    assert len(langid.hashed(["abc"])[0]) == 5 + 4 + 3 + 2 + 1 and len(langid.hashed(["½", "a½"])[0]) == len(langid.hashed(["a"])[0])


def plain_features(word):
    """Hashes of a word's n-grams and itself, one at a time in plain integers."""
    wide, prime = (1 << 64) - 1, int(langid.PRIME)

    def spread(x):
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 & wide
        return x ^ x >> 29

    points = [ord(c) for c in f"<{word}>"]
    out = []
    for n in langid.GRAMS:
        for i in range(len(points) - n + 1):
            rolled = 0
            for p in points[i : i + n]:
                rolled = (rolled * prime + p) & wide
            out.append(spread((rolled + n) & wide) % langid.HASHES)
    return [*out, spread(sum(spread((p * prime + i) & wide) for i, p in enumerate(points)) & wide) % langid.HASHES]


def test_features_of_whole_texts_against_plain_counting():
    rng = np.random.default_rng(2)
    for t in [text("cc", 900, rng), "", "½ 3", "a", "Éa éa ÉA " * 40 + "x-y_z"]:
        words = ["".join(c for c in w if c.isalpha()) for w in langid.words_of(t)]
        want = Counter(h for w in words if w for h in plain_features(w))
        ids, times = langid.bag(t)
        assert dict(zip(ids.tolist(), times.tolist(), strict=True)) == want


def test_training_against_a_slow_twin(monkeypatch):
    monkeypatch.setattr(langid, "HASHES", 97)
    monkeypatch.setattr(langid, "BATCH", 5)
    rng = np.random.default_rng(3)
    rows = [(lang, *langid.bag(text(lang, 12, rng))) for lang in ("aa", "bb", "cc", "aa") for _ in range(6)]
    got = langid.train(rows)
    draw = np.random.default_rng(9)
    names, n = ["aa", "bb", "cc"], len(rows)
    embed = draw.uniform(-1 / langid.DIMS, 1 / langid.DIMS, (97, langid.DIMS))
    weights, bias = np.zeros((langid.DIMS, 3)), np.zeros(3)
    whole = [np.bincount(ids, times / times.sum(), 97) for _, ids, times in rows]
    share = Counter(lang for lang, *_ in rows)
    batches, step = -(-n // 5), 0
    epochs = -(-langid.STEPS // batches)
    for _ in range(epochs):
        for batch in np.array_split(draw.permutation(n), batches):
            rate = langid.RATE * (1 - step / (epochs * batches))
            step += 1
            gw, gb, ge = np.zeros_like(weights), np.zeros(3), np.zeros_like(embed)
            for i in batch:
                mean = whole[i] @ embed
                p = np.exp(mean @ weights + bias)
                p /= p.sum()
                error = (p - np.eye(3)[names.index(rows[i][0])]) * n / share[rows[i][0]] / 3 / len(batch)
                gw += np.outer(mean, error)
                gb += error
                ge += np.outer(whole[i], weights @ error) * len(batch)
            weights, bias, embed = weights - rate * gw, bias - rate * gb, embed - rate * ge
    assert got.names == names and np.allclose(got.scores, embed @ weights, atol=1e-3) and np.allclose(got.bias, bias, atol=1e-4)


def test_sample_is_bounded_with_repeated_rows_and_ids(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS", 20)
    rows = [(7, f"ka lo {'mi ' * (i % 50)}", "aa") for i in range(3000)] + [(i, "der ein", "bb") for i in range(5)] + [(1, "zz", "cc"), (2, "5", "dd"), (None, "null id", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = langid.sample(docs, F.lit(True), "doc_id", "text", "lang")
    assert Counter(lang for lang, *_ in picked) == {"aa": 20, "bb": 6, "cc": 1}
    again = langid.sample(docs.repartition(3), F.lit(True), "doc_id", "text", "lang")
    assert [(a[0], a[1], a[2].tolist()) for a in again] == [(a[0], a[1], a[2].tolist()) for a in picked]
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert {lang for lang, *_ in langid.sample(docs, F.lit(True), "doc_id", "text", "lang")} == {"aa", "bb"}
    # ties of scores go to the first language in order
    assert langid.Model(["aa", "bb"], np.zeros((langid.HASHES, 2), np.float32), np.zeros(2, np.float32)).predict(["ka"])[0][:2] == ("aa", 0.5)


def test_held_out_rows_and_nulls_never_teach(spark):
    docs = spark.createDataFrame([(i, "der ein", "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else None) for i in range(60)], "doc_id long, text string, lang string")
    model = langid.fit(docs, ~langid.held_out())
    assert model.names == [] and model.predict(["der"]) == [("und", 0.0, True)]
    assert langid.predict(docs.limit(0), model, [F.col("doc_id")], "doc_id long").count() == 0


def test_accepted_rows_keep_their_columns(spark):
    rows = corpus(80)
    docs = spark.createDataFrame([(*r[:4], r[4], "k") for r in rows], "doc_id long, text string, lang string, source string, score double, rejected string")
    model = langid.fit(docs, ~langid.held_out())
    kept = langid.accepted(docs, model)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {9001, 9002, 9003} and len(ids) >= 75
