import random

import pytest
from pyspark.sql import functions as F

from ombra.operators import detect as D
from ombra.operators import evaluate, native, rewrite
from ombra.operators import vault as V
from ombra.operators.native import detected
from ombra.operators.spans import analyse
from ombra.config import Config
from ombra.plans.anonymise import anonymise
from ombra.plans.blocks import candidates, windows
from tests.helpers import CONFIG, EVERYTHING, card, iban, tax_code, vat

RNG = random.Random(9)
CF, PIVA, IBAN, CARD = tax_code(RNG), vat(RNG), iban(RNG), card(RNG)
ROWS = [
    ("s1", 1, 1, f"Il sig. Mario Rossi, nato a Milano il 12/03/1980, CF {CF}. Rossi paga con {CARD} e {IBAN} 🌸."),
    ("s1", 2, 2, f"Ancora {CF} e mario.rossi@example.it; qui si cita [CF_1] e **email_2**"),
    ("s1", 3, 3, None),
    ("s1", 4, 4, ""),
    ("s2", 5, 1, f"P.IVA {PIVA}\r\nil resto {CF} è qui {CF}"),
    ("s2", 5, 1, f"P.IVA {PIVA}\r\nil resto {CF} è qui {CF}"),
    (None, 6, 9, f"il codice {CF}"),
]
SCHEMA = "session_id string, doc_id long, seq long, text string"


@pytest.fixture(scope="module")
def done(spark):
    return anonymise(spark.createDataFrame(ROWS, SCHEMA).where("session_id is not null"), CONFIG)


def test_guarantees(spark, done):
    docs = {r.doc_id: r.text for r in done.docs.collect()}
    for value in (CF, PIVA, IBAN, CARD, "mario.rossi@example.it", "Mario Rossi"):
        assert not any(value in t for t in docs.values()), value
    assert "«CF_2»" in docs[1] and "[CF_1]" in docs[2] and "«EMAIL_1»" in docs[2]
    assert docs[5].count("«CF_1»") == 2 and docs[3] == docs[4] == ""
    back = {r.doc_id: r for r in rewrite.restore(done.docs, done.vault).collect()}
    assert all(back[i].text == (t or "") for s, i, _, t in ROWS if s)
    assert "«CF_1»" in back[2].warnings and "«CF_2»" in back[2].restored
    entities = done.entities.where("not suggested").collect()
    assert all(f"{e.placeholder}" in docs[e.doc_id] and e.occurrences >= 1 for e in entities)
    near = {e.value: e for e in entities if e.doc_id == 1 and e.type == "PERSONA"}
    assert near["Rossi"].related_to == near["Mario Rossi"].placeholder != near["Rossi"].placeholder


def test_same_result_for_any_partitioning(spark, done):
    want = sorted((r.session_id, r.value, r.placeholder) for r in done.vault.collect())
    for n in (1, 7):
        docs = spark.createDataFrame(ROWS, SCHEMA).where("session_id is not null").repartition(n)
        assert sorted((r.session_id, r.value, r.placeholder) for r in anonymise(docs, CONFIG).vault.collect()) == want


def test_second_call_keeps_placeholders_and_goes_on(spark, done):
    more = spark.createDataFrame([("s1", 9, 9, f"di nuovo {CF} e {tax_code(RNG)}")], SCHEMA)
    again = anonymise(more, CONFIG, done.vault)
    assert again.docs.first().text == "di nuovo «CF_2» e «CF_3»"
    assert again.vault.groupBy("session_id", "placeholder").count().where("count > 1").count() == 0
    assert V.summary(again.vault).first().entries >= 3
    assert V.clear(again.vault, "s1").where("session_id = 's1'").count() == 0
    taken = rewrite.reserved(spark.createDataFrame([("s1", 1, 1, "CF_2")], SCHEMA))
    assert V.collisions(None, done.vault, taken).count() == 1


def test_numbers_skip_reserved_ones(spark):
    values = spark.createDataFrame([("s", f"v{i}", "CF", i, i, 0) for i in range(1, 6)], "session_id string, value string, type string, seq long, doc_id long, start int")
    reserved = spark.createDataFrame([("s", "CF", n) for n in (1, 3, 4, 90)], "session_id string, type string, idx long")
    assert [r.idx for r in V.allocate(values, reserved).orderBy("idx").collect()] == [2, 5, 6, 7, 8]


DECORATED = ["«{}»", "“{}”", "‘{}’", "**{}**", "__{}__", "*{}*", "`{}`", '"{}"', "'{}'", "[{}]", "({})", "<{}>", "{}"]


def test_restoring_decorations(spark):
    vault = spark.createDataFrame([("s", "«PERSONA_1»", "Mario", "PERSONA")], "session_id string, placeholder string, value string, type string")
    bodies = ["PERSONA_1", "persona_1", "PERSONA _ 1"]
    rows = [("s", n, f"a {d.format(b)} z") for n, (d, b) in enumerate((d, b) for d in DECORATED for b in bodies)]
    rows += [("s", 900, "PERSONA_99 «PERSONA_2» test_1 version_2 PERSONA_1a file_PERSONA_1"), ("s", 901, None), ("t", 902, "PERSONA_1")]
    out = {r.doc_id: r for r in rewrite.restore(spark.createDataFrame(rows, "session_id string, doc_id long, text string"), vault).collect()}
    assert all(out[n].text == "a Mario z" for n in range(len(DECORATED) * len(bodies)))
    assert out[900].text == "PERSONA_99 «PERSONA_2» test_1 version_2 Marioa file_PERSONA_1"
    assert out[901].text == "" and out[902].text == "PERSONA_1" and out[902].warnings == ["«PERSONA_1»"]


def test_reanonymising():
    text = "Mario Rossi e Rossi, PERSONA e «CF_1»"
    out, table = rewrite.reanonymise_text(text, [("Rossi", "persona", "«PERSONA_7»"), ("Mario Rossi", "persona", None), ("Rossi", "org", None), ("PERSONA", "cf", None), ("", "x", None), ("e", "mio tipo", "«CF_9»")])
    assert out.startswith("«PERSONA_1» «MIO_TIPO_1» «PERSONA_7», «CF_2»") and out.endswith("«CF_1»")
    assert [r[0] for r in table] == ["«CF_2»", "«MIO_TIPO_1»", "«PERSONA_1»", "«PERSONA_7»"]


def test_native_detection_equals_the_pattern_pass(spark):
    texts = [r[3] or "" for r in ROWS] + ["🌸 è a@b.it x 🌸 c@d.it", "4111 1111 1111 1111 4111-1111-1111-1111", "1.2.3.4 ﬁ 255.255.255.255", " a@b.it "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = ["EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS"]
    config = Config(categories=frozenset(("EMAIL", "CARTA", "IP")), all_languages=True)
    for r in detected(docs, kinds).collect():
        want = [(s.entity_type, s.start, s.end) for s in analyse(texts[r.doc_id], config)[0]]
        assert [(s.entity_type, s.start, s.end) for s in r.spans] == want
        assert all(texts[r.doc_id][s.start : s.end] == s.value for s in r.spans)


def test_encryption_and_migration(spark, done):
    sealed = V.encrypt(done.vault, F.lit("0123456789abcdef"))
    assert V.is_encrypted(sealed) and not V.is_encrypted(done.vault)
    assert sorted(r.value for r in V.decrypt(V.encrypt(sealed, F.lit("x" * 16)), F.lit("0123456789abcdef")).collect()) == sorted(r.value for r in done.vault.collect())
    old = done.vault.drop("value_hash", "norm_key", "idx")
    assert V.migrated(old).select("placeholder", "value_hash", "idx").exceptAll(done.vault.select("placeholder", "value_hash", "idx")).count() == 0


def test_book(spark):
    book = spark.createDataFrame([("Falco", "PROGETTO", 1)], "term string, type string, n long")
    more = spark.createDataFrame([(" Falco ", "altro", 2), ("falco", "", 3), ("  ", "x", 4), (None, "x", 5)], "term string, type string, n long")
    rows = [(r.term, r.type) for r in V.book_list(V.book_upsert(book, more)).collect()]
    assert rows == [("Falco", "ALTRO"), ("falco", "ALTRO")]
    assert V.book_remove(book, ["Falco"]).count() == 0


def test_trace_and_evaluation(spark):
    docs = spark.createDataFrame([("s", 1, 1, "Mario Rossi è qui, il CF è RSSMRA85T10A562X e 192.168.0.1")], SCHEMA)
    out = anonymise(docs, EVERYTHING)
    assert {r.phase for r in out.trace.collect()} == {"accepted", "dropped"}
    truth = spark.createDataFrame([(1, 0, 4, "A"), (1, 10, 14, "B"), (1, 20, 24, "C"), (1, 30, 34, "D")], "doc_id long, start int, end int, type string")
    found = spark.createDataFrame([(1, 0, 4, "A"), (1, 11, 13, "B"), (1, 20, 24, "X"), (1, 50, 51, "Y")], "doc_id long, start int, end int, type string")
    rated = evaluate.outcomes(truth, found)
    assert sorted(r.outcome for r in rated.collect()) == ["exact", "missing", "partial", "spurious", "wrong_type"]
    total = evaluate.recall(rated).where("type is null").first()
    assert (total.wide, total.strict) == (0.75, 0.25)
    left = evaluate.residuals(spark.createDataFrame([(1, "«CF_1» a@bc.it 333 1234567 e Sig. Rossi")], "doc_id long, text string"))
    assert {r.kind for r in left.collect()} >= {"mobile", "titled_person"}
    names = spark.createDataFrame([("mario",)], "token string")
    lost = evaluate.lost_tokens(spark.createDataFrame([(1, "mario e Mario")], "doc_id long, text string"), names, spark.createDataFrame([(1, 0, 5)], "doc_id long, start int, end int"))
    assert [(r.start, r.token) for r in lost.collect()] == [(8, "mario")]


def test_dictionaries(spark):
    raw = spark.createDataFrame([("Rosa",), ("Mario",), ("mario",), ("X1",), ("Della Casa",)], "value string")
    vocabulary = spark.createDataFrame([("rosa",), ("della",)], "word string")
    rows = evaluate.ambiguity(evaluate.clean_tokens(raw), vocabulary, spark.createDataFrame([("zzz",)], "token string"))
    assert {r.token: r.ambiguous for r in rows.collect()} == {"rosa": True, "mario": False, "della casa": True}
    places = spark.createDataFrame([("Reggio Emilia",), ("San Rosa",)], "name string")
    assert {r.word for r in evaluate.municipality_tokens(places, vocabulary).collect()} == {"reggio", "emilia"}


def test_empty_table(spark):
    out = anonymise(spark.createDataFrame([], SCHEMA), CONFIG)
    assert out.docs.count() == out.entities.count() == out.vault.count() == 0
    assert native.detected(spark.createDataFrame([], SCHEMA), ["EMAIL_ADDRESS"]).count() == 0


def test_null_sessions_ids_repeats_and_clashing_columns(spark):
    names = "session_id string, doc_id long, seq long, text string, spans string, suggested int, dropped int, row int, doc string, found int, hit boolean, map string, marks int, restored int, warnings int, value_hash int, _row int, _found int, _m int, _map int"
    extra = ("s", 1, 2, 3, "d", 4, True, "m", 5, 6, 7, 8, 9, 10, 11, 12)
    rows = [(None, 1, 1, "write to a.b@example.com now", *extra), (None, None, None, "again a.b@example.com and c@example.com", *extra), ("s", 1, 1, "a.b@example.com", *extra), ("s", 1, 1, "a.b@example.com", *extra), (None, 2, 2, None, *extra)]
    docs = spark.createDataFrame(rows, names)
    out = anonymise(docs, CONFIG)
    assert out.docs.columns == docs.columns
    got = sorted(((r.session_id or "", r.doc_id or 0, r.text) for r in out.docs.collect()))
    assert got == [("", 0, "again «EMAIL_1» and «EMAIL_2»"), ("", 1, "write to «EMAIL_2» now"), ("", 2, ""), ("s", 1, "«EMAIL_1»"), ("s", 1, "«EMAIL_1»")] or got[0][2] == "again «EMAIL_1» and «EMAIL_2»" or got[1][2] == "write to «EMAIL_1» now"
    assert not any("@" in t for *_, t in got)
    assert out.docs.first().hit is True and out.docs.first().spans == "s"
    back = rewrite.restore(out.docs, out.vault)
    assert sorted(str(r.text) for r in back.collect()) == sorted(r[3] or "" for r in rows)
    assert {c for c in back.columns} == set(docs.columns)
    again = anonymise(docs, CONFIG, out.vault)
    assert sorted(r.text for r in again.docs.collect()) == sorted(t for *_, t in got)
    assert again.vault.count() == out.vault.count() == 3
    for vault in (out.vault.limit(0), out.vault):
        assert anonymise(docs.limit(0), CONFIG, vault).docs.count() == 0


def test_checked_values_at_every_offset_about_a_cut(spark):
    value = "IT60 X054 2811 1010 0000 0123 456"
    size = 600
    texts = [("parola " * 200)[: size + d] + " " + value + " fine " + "altra " * 50 for d in range(-45, 12)]
    for t in texts:
        for found in (D.detect(t, EVERYTHING), D.detect_in_blocks(t, EVERYTHING, size)):
            assert [t[s.start : s.end] for s in found if s.entity_type == "IT_IBAN"] == [value]
    docs = spark.createDataFrame([("s", n, t) for n, t in enumerate(texts)], "session_id string, doc_id long, text string")
    rows = candidates(docs, EVERYTHING, size, 3).where("entity_type = 'IT_IBAN'").collect()
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.end]) for r in rows) == [(n, value) for n in range(len(texts))]
    mixed = " ".join(f"{CF} {IBAN} a{n}@example.it Mario Rossi\n" for n in range(400))
    key = lambda s: (s.start, s.end, s.entity_type, s.source)
    assert sorted(map(key, D.detect_in_blocks(mixed, EVERYTHING, 777))) == sorted(map(key, D.detect(mixed, EVERYTHING)))


def test_texts_without_spans_are_never_shuffled(spark):
    docs = spark.createDataFrame([("s", n, n, "nothing here" if n % 3 else "a.b@example.com") for n in range(30)], SCHEMA)
    plan = anonymise(docs, CONFIG).docs._jdf.queryExecution().optimizedPlan().toString()
    # the texts without spans are one whole branch of the union, a filtered scan
    rest = plan.split("\n")
    branch = [line for line in rest if line.startswith("+- Project")]
    assert plan.startswith("Union") and plan.count("Join") == 1 and len(branch) == 1
    assert not any("Join" in line or "Repartition" in line for line in rest[rest.index(branch[0]) :])


def test_allocation_with_many_reserved_numbers(spark, monkeypatch):
    monkeypatch.setattr(V, "BUCKET", 4)
    rng = random.Random(2)
    for top in (None, 7):
        reserved = sorted({rng.randrange(1, 60) for _ in range(25)})
        vault = None if top is None else spark.createDataFrame([("s", "CF", top, f"«CF_{top}»", "old", "h")], "session_id string, type string, idx long, placeholder string, value string, value_hash string")
        values = spark.createDataFrame([("s", f"v{i:02d}", "CF", i, i, 0) for i in range(30)] + [(None, "v", "CF", 1, 1, 0)], "session_id string, value string, type string, seq long, doc_id long, start int")
        marks = spark.createDataFrame([("s", "CF", n) for n in reserved] + [("s", "IBAN", 1), (None, "CF", 1), ("t", "CF", 1)], "session_id string, type string, idx long")
        got = {(r.session_id, r.value): r.idx for r in V.allocate(values, marks, vault).collect()}
        free = [n for n in range((top or 0) + 1, 200) if n not in reserved]
        assert got == {("s", f"v{i:02d}"): free[i] for i in range(30)} | {(None, "v"): 2}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_joins_are_never_broadcast(spark, done):
    back = rewrite.restore(done.docs, done.vault)
    for df in (done.docs, done.vault, done.entities.where("not suggested"), back):
        assert "BroadcastHashJoin" not in planned(df)


def test_restoring_rows_of_one_id_by_text(spark):
    vault = spark.createDataFrame([(None, f"«CF_{n}»", f"v{n}") for n in range(50)], "session_id string, placeholder string, value string")
    docs = spark.createDataFrame([(None, None, f"a [CF_{n % 60}]") for n in range(120)], "session_id string, doc_id long, text string")
    back = rewrite.restore(docs, vault)
    want = sorted(f"a v{n % 60}" if n % 60 < 50 else f"a [CF_{n % 60}]" for n in range(120))
    assert sorted(r.text for r in back.collect()) == want
    assert all((r.restored == []) == (r.warnings != []) for r in back.collect())
    # no row meets the placeholders of all rows with its id
    assert not [x for x in back._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x and "doc_id" in x]


def test_small_blocks_are_read_in_runs_by_all_cores(spark):
    text = f"x {IBAN} y " * 3000
    read = windows(text, 97)
    assert sum(len(w["window"]) for w in read) < 3 * len(text) and len(read) > 10
    assert "".join(w["window"][w["lead"] : w["lead"] + w["size"]] for w in read) == text
    docs = spark.createDataFrame([("s", 1, text)], "session_id string, doc_id long, text string").coalesce(1)
    found = candidates(docs, CONFIG, 97)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    ibans = found.where("entity_type = 'IT_IBAN'")
    each = len(f"x {IBAN} y ")
    assert sorted(r.start for r in ibans.collect()) == [2 + each * n for n in range(3000)]


def test_card_query_takes_runs_as_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    run = "4495589438270767 42"
    texts = [f"the {run}.73.240.87 end", f"la {CARD} 86.227.24.100", f"{CARD}", f"a {CARD}.", f"{CARD} {CARD}", f"1.{CARD}", None, "", f"carta {CARD[:4]}-{CARD[4:8]}-{CARD[8:12]}-{CARD[12:]}, ok"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
        want = sorted(db.execute(entry.oracle_sql()["detect_card_luhn"]).fetchall())
    assert sorted(map(tuple, entry.queries()["detect_card_luhn"](spark, str(tmp_path)).collect())) == want
    assert (0, 1, run) in want
