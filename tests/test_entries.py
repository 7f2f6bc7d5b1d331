"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
OWN = [n for n in entry.queries() if not n.startswith("op") or n == "overlap_resolution"]


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def canonical(frame):
    return sorted(tuple(str(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in OWN if n != "pipeline"])
def test_query(spark, db, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    assert len(got) or sql
    if sql:
        want = db.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["session_id", "doc_id", "text"]


def test_flagship_and_round_trip_of_all_types(spark, tmp_path):
    values = ["12/03/1980", "via Garibaldi 12", "20121", "347 1234567", "AB123CD", "@mario.rossi80", "mario.rossi@example.it", "10.1.2.3", "AX1234567", "00:1A:2B:3C:4D:5E"]
    texts = [
        "Il cliente, nato a Milano il 12/03/1980, abita in via Garibaldi 12, 20121 Milano, tel. 347 1234567.",
        "Targa AB123CD, profilo instagram @mario.rossi80, scrivere a mario.rossi@example.it da 10.1.2.3.",
        "Carta d'identità n. AX1234567; MAC 00:1A:2B:3C:4D:5E",
    ]
    rows = [(n, t, "s") for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = entry.queries()
    masked = " ".join(r.text for r in run["anonymise_docs"](spark, str(tmp_path)).collect())
    assert not [v for v in values if v in masked]
    assert sorted((r.doc_id, r.text) for r in run["roundtrip_identity"](spark, str(tmp_path)).collect()) == [(n, t) for n, t, _ in rows]
    assert not any(r.violations for r in run["guarantee_violations"](spark, str(tmp_path)).collect())
