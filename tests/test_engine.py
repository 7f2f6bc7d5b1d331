import os
import subprocess
import sys

import pytest

from ombra.engine import Engine, RequestError
from ombra.plans.blocks import candidates
from tests.helpers import CONFIG


def test_verbs(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/home", CONFIG)
    assert engine.sessions() == [] and "PERSONA" in engine.categories() and "IP" in engine.types()
    text = "Il sig. Mario Rossi scrive da a.b@example.it per il progetto Falco"
    engine.import_book("testo,tipo\nFalco,progetto\n".encode())
    done = engine.anonymise(text, "s")
    assert done["text"] == "Il sig. «PERSONA_1» scrive da «EMAIL_1» per il progetto «PROGETTO_1»"
    assert engine.anonymise("Il sig. Mario Rossi", "s")["text"].endswith("«PERSONA_1»")
    back = engine.restore("[persona_1] e EMAIL_1, PERSONA_7", "s")
    assert back["text"] == "Mario Rossi e a.b@example.it, PERSONA_7"
    assert back["not_found"] == ["«PROGETTO_1»"] and back["warnings"] == ["«PERSONA_7»"]
    edited = engine.reanonymise(text, "s", [{"value": "Rossi", "type": "persona"}])
    assert edited["text"] == text.replace("Rossi", "«PERSONA_1»") and len(engine.session("s")) == 1
    engine.set_categories({"ip"})
    assert engine.anonymise("il 192.168.0.1 di a@b.it", "t")["text"] == "il «IP_1» di a@b.it"
    assert {r["session_id"]: r["entries"] for r in engine.sessions()} == {"s": 1, "t": 1}
    engine.delete_session("s")
    engine.remove_terms(["Falco"])
    assert [r["session_id"] for r in engine.sessions()] == ["t"] and engine.book().count() == 0
    for bad in (lambda: engine.anonymise("  "), lambda: engine.anonymise("x", language="fr"), lambda: engine.set_categories({"x"}), lambda: engine.reanonymise("", "s", [])):
        with pytest.raises(RequestError):
            bad()


def test_blocks_find_what_the_whole_text_has(spark):
    line = "Il sig. Mario Rossi scrive da a.b@example.it.\n"
    docs = spark.createDataFrame([("s", 1, line * 200), ("s", 2, None), ("s", 3, "please write to x.y@example.com and the others")], "session_id string, doc_id long, text string")
    whole = candidates(docs, CONFIG, 10**6)
    parts = candidates(docs, CONFIG, 120, tasks=5)
    keys = ["doc_id", "entity_type", "start", "end"]
    assert whole.select(*keys).exceptAll(parts.select(*keys)).count() == 0 == parts.select(*keys).exceptAll(whole.select(*keys)).count()
    assert parts.where("entity_type = 'EMAIL_ADDRESS'").count() == 201


def test_entry_without_a_library_of_the_corpus_operators():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'anonymise_docs' in q and 'op2_licenses' not in q and 'pipeline' not in q and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
