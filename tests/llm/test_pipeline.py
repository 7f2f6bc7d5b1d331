from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from ombra.llm import langid, mixing, pieces, secrets, simhash
from tests.llm.test_langid import text
from tests.llm.test_mixing import slow as slow_mix
from tests.llm.test_simhash import slow_linked, slow_print

LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def corpus():
    rng = np.random.default_rng(21)
    rows = [(i, text(["aa", "bb", "cc"][i % 3], 60, rng), ["aa", "bb", "cc"][i % 3], f"s{i % 4}", 1) for i in range(90)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 1) for i in range(20)]
    rows += [(300, rows[4][1] + ' password = "q7Rz2LmX9vKp4TnB"', "bb", "s1", 1), (301, None, "aa", "s1", 1), (302, "", "aa", "s2", 1), (303, "123 !", "aa", None, 1), (400, rows[7][1] + " " + text("bb", 40, rng), None, None, 1)]
    return rows


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(docs, ~langid.held_out())
    left = [r for r, (*_, gone) in zip(rows, model.predict([r[1] for r in rows]), strict=True) if not gone]
    assert {301, 302, 303}.isdisjoint({r[0] for r in left}) and len(left) >= 100
    prints = [(r[0], [int.from_bytes(x, "big") for x in simhash.fingerprint(r[1].encode(), 5, prints=corpus_pipeline.PRINTS)]) for r in left]
    assert all(p[0] == slow_print(r[1], 5) for r, (_, p) in zip(left, prints, strict=True))
    groups = slow_linked(prints)
    left = [r for r in left if groups[r[0]] == r[0]]
    owners = {}
    for i, t, _, s, _ in left:
        for k, *_, v in secrets.candidates(t):
            owners.setdefault(v, set()).add(s)
    masked = []
    for i, t, lang, s, _ in left:
        found = [(k, a, b, v) for k, a, b, v in secrets.candidates(t) if (k != "token" or secrets.looks_live(v)) and len(owners[v]) < secrets.COMMON_OWNERS]
        new = secrets.masked_text(t, [x[1] for x in found], [x[2] for x in found])
        masked.append((i, new, s, len(new)))
    times = Counter({i: int(taken / size + 0.5) for i, size, _, _, taken in slow_mix(masked) if size})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == +times
    texts = {i: t for i, t, *_ in masked}
    for r in out:
        assert np.frombuffer(r.ids, "<u2").tolist() == LIB.encode(texts[r.doc_id], add_eos=True)
        assert np.frombuffer(r.ends, "<u4")[-1] == len(texts[r.doc_id].encode()) and r.n_tokens * 4 == len(r.ends)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_tables(spark, name, stage):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "ein text " * 50, None, None, 3), (2, "ein text " * 50, "de", "s", 3)]
    docs = spark.createDataFrame([(*r, *"abcdefghijkl") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in "component size n id row key masks doc own new mix_key hash".split()))
    for given in (docs, docs.limit(0)):
        out = stage(spark, given, "")
        out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns


def test_near_duplicate_stage_keeps_clean_documents(spark):
    rng = np.random.default_rng(3)
    rows = [(i, text("aa", 80, rng), "s") for i in range(30)] + [(50, None, "s"), (None, "n", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == len(rows)
    assert mixing.mixed(docs.where(F.col("doc_id") < 30), F.col("source")).count() == 30


def test_stages_send_no_large_table_to_the_driver(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.secret_scan):
        assert "BroadcastHashJoin" not in stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
