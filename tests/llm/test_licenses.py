import random
import re

from ombra.llm import licenses

TEXTS = {
    1: "The MIT License and the mit\nlicense; CC-BY, cc by cc by. GNU General Public License!",
    2: "under the Apache Licence, v2",
    3: "Permision is hereby granted, free of charge to any persn obtaining a copy of",
    4: None,
    5: "",
    6: "limit license mit licenses commit license cc bye",
    7: "é mit license é — apache — license " + "word " * 30000 + "mozila public licence",
    8: "redistribution and use",
    9: "GNU Lesser General Public License",
}


def base(text):
    words = [w.lower() if w.isascii() else w for w in re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", text or "")]
    out = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), out


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, "x") for i, t in TEXTS.items()], "doc_id long, text string, labels string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in licenses.op2_licenses(spark, str(tmp_path)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in TEXTS.items():
        n, found = base(t)
        r = rows[i]
        at = [w for w, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(found), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")} and 0 <= r.score <= 1
    assert rows[2].labels == "apache" and rows[2].n_base == 0 and rows[2].spans == "apache:10:24:1"
    assert rows[3].labels == "mit" and 0.9 < rows[3].score < 1
    assert rows[7].labels.split(",") == ["mit", "mpl"] and rows[9].labels == "lgpl"
    assert rows[8].labels == "" and rows[8].score == 0
    assert licenses.license_notices(spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_every_planted_notice_within_the_bound_is_found():
    rng = random.Random(5)
    for text, label in licenses.NOTICES:
        k = len(text) // licenses.PER_EDIT
        for edits in range(k + 1):
            s = list(text)
            for _ in range(edits):
                i = rng.randrange(1, len(s) - 1)
                kind = rng.randrange(3)
                if kind == 0:
                    s[i] = rng.choice("xyz")
                elif kind == 1:
                    del s[i]
                else:
                    s.insert(i, rng.choice("xyz"))
            planted = "".join(s)
            if re.search("^ | $|  ", planted):
                continue
            found = licenses.fuzzy(f"zz zz {planted} zz zz")
            assert label in {f.label for f in found}, (text, planted)
            for f in found:
                assert f.edits >= distance(f.notice, f"zz zz {planted} zz zz"[f.start : f.end])
                assert f.edits <= len(f.notice) // licenses.PER_EDIT


def test_notices_next_to_one_another_are_all_found():
    assert [(f.start, f.end, f.edits) for f in licenses.fuzzy("zz mit licence mit license zz") if f.label == "mit"] == [(3, 14, 1), (15, 26, 0)]
    assert [(f.start, f.edits) for f in licenses.fuzzy("x apache licence apache license apache licens y") if f.label == "apache"] == [(2, 1), (17, 0), (32, 1)]
    rng = random.Random(8)
    for _ in range(60):
        picked = [rng.choice(licenses.NOTICES[:6] + licenses.NOTICES[9:12]) for _ in range(rng.randrange(2, 6))]
        words, planted = "", []
        for text, label in picked:
            at = rng.randrange(1, len(text) - 1)
            changed = text[:at] + "q" + text[at + 1 :] if text[at] != " " else text
            words += " " * bool(words)
            planted.append((len(words), len(words) + len(changed), label, text))
            words += changed
        found = licenses.fuzzy(words)
        for a, b, label, text in planted:
            assert any(f.notice == text and f.start < b and a < f.end and f.edits <= distance(words[a:b], text) for f in found), (words, text)
        for text, _ in licenses.NOTICES:
            own = [f for f in found if f.notice == text]
            assert all(f.end <= g.start for f, g in zip(own, own[1:]))
            assert all(distance(words[f.start : f.end], text) <= f.edits <= len(text) // licenses.PER_EDIT for f in own)


def test_repeated_rows(spark, tmp_path):
    spark.createDataFrame([(1, "mit licence"), (1, "mit licence"), (None, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = licenses.op2_licenses(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.labels, r.n_words) for r in rows) == [(0, "", 0), (1, "mit", 2), (1, "mit", 2)]
