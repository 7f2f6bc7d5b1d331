import time

import pytest

from ombra.config import Config
from ombra.streaming import sessions

SCHEMA = "session_id string, doc_id long, seq long, text string"
CONFIG = Config(categories=frozenset(("EMAIL",)), all_languages=True)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, sessions.ROCKS)
    yield
    spark.conf.unset(key)


def run(spark, source, out, state):
    docs = spark.readStream.schema(SCHEMA).parquet(str(source))
    stream = sessions.numbered(sessions.values_of_stream(docs, CONFIG))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out))
    query.awaitTermination(180)


def test_placeholders_survive_a_restart(spark, tmp_path, rocks):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    first = [("s", 1, 1, "a@x.it e b@x.it"), ("s", 2, 2, "b@x.it"), ("t", 3, 1, "b@x.it")]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run(spark, source, out, state)
    time.sleep(1)
    spark.createDataFrame([("s", 4, 3, "c@x.it poi a@x.it")], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    run(spark, source, out, state)
    rows = {(r.session_id, r.doc_id, r.value): r.placeholder for r in spark.read.parquet(str(out)).collect()}
    assert rows == {
        ("s", 1, "a@x.it"): "«EMAIL_1»", ("s", 1, "b@x.it"): "«EMAIL_2»", ("s", 2, "b@x.it"): "«EMAIL_2»", ("t", 3, "b@x.it"): "«EMAIL_1»",
        ("s", 4, "c@x.it"): "«EMAIL_3»", ("s", 4, "a@x.it"): "«EMAIL_1»",
    }


def test_batches_against_the_vault_table(spark, tmp_path):
    rows = [("s", 1, 1, 0, 6, "a@x.it", "EMAIL"), ("s", 1, 1, 9, 15, "b@x.it", "EMAIL")]
    values = spark.createDataFrame(rows, "session_id string, doc_id long, seq long, start int, end int, value string, type string")
    path = str(tmp_path / "vault")
    taken = values.select("session_id", "type").limit(1).selectExpr("*", "2L as idx")
    sessions.to_vault(values.limit(1), path, 0)
    for _ in range(2):  # the second time as after a failure
        sessions.to_vault(values.unionByName(values.selectExpr("session_id", "doc_id", "seq", "start", "end", "'c@x.it' as value", "type")), path, 1, taken)
    found = sorted((r.value, r.placeholder) for r in spark.read.parquet(path).collect())
    assert found == [("a@x.it", "«EMAIL_1»"), ("b@x.it", "«EMAIL_4»"), ("c@x.it", "«EMAIL_3»")] or found == [("a@x.it", "«EMAIL_1»"), ("b@x.it", "«EMAIL_3»"), ("c@x.it", "«EMAIL_4»")]


def test_numbers_that_a_stream_mentions_are_never_given(spark, tmp_path, rocks):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    spark.createDataFrame([("s", 1, 1, "a@x.it cita **email_1** e [EMAIL_3]"), ("s", 2, 2, "b@x.it"), ("t", 1, 1, "a@x.it")], SCHEMA).coalesce(1).write.parquet(str(source))
    run(spark, source, out, state)
    rows = {(r.session_id, r.value): r.placeholder for r in spark.read.parquet(str(out)).collect()}
    assert rows == {("s", "a@x.it"): "«EMAIL_2»", ("s", "b@x.it"): "«EMAIL_4»", ("t", "a@x.it"): "«EMAIL_1»"}
