import random
from hashlib import sha256

import duckdb
import pytest
import sentencepiece

from ombra.llm import piece, pieces, token_counts

PATH = pieces.model_path()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", "   a", "a", "a  b   c ", "▁", "▁a ▁▁ b", "\n\n x\t", "é è ß ﬁ ½", "漢字かな交じり", "🌸🌸 x🌸", "\u0000a", "<s> </s> <unk> <0x41>", "x" * 3000, "漢字" * 3000, "a" + "!漢" * 2000, "ab " * 3000, " " * 70, "́̂", "​  ", "İı ſ K"]


def texts():
    rng = random.Random(3)
    alphabet = list("abcdefghij  \n\t.,▁éñ漢🌸́0123") + ["th", "ing ", "   "]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    real = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    return ODD + made + real


def test_same_ids_text_counts_and_spans_as_the_library():
    model = piece.load(PATH)
    for t in texts():
        want = LIB.encode(t)
        got = model.encode(t)
        assert got.ids == want, t
        assert model.decode(got.ids) == LIB.decode(want), t
        assert model.count(t) == len(want), t
        data = t.encode()
        assert len(got.begins) == len(got.ends) == len(want)
        proto = LIB.encode(t, return_type="proto")
        for i, b, e, p in zip(got.ids, got.begins, got.ends, proto.pieces, strict=True):
            if i not in model.bytes.values():
                assert data[b:e].decode() == p.surface, t


def test_decoding_any_ids():
    model, rng = piece.load(PATH), random.Random(4)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 2]) for _ in range(rng.randrange(1, 8))]
        assert model.decode(ids) == LIB.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_map_against_the_library(rule):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(piece.fields(lib.serialized_normalizer_spec()))
    model = piece.Pieces(PATH)
    model.map, model.plain, model.dummy, model.squeeze = piece.CharMap(spec.get(2, b"")), False, bool(spec.get(3, 1)), bool(spec.get(4, 1))
    for t in ["ﬁ ½ Ａ１ ｶﾞ é é", "​﻿x\ty", "Straße ǅ ẞ", "①②  ㍿", "", " ", "   ", "  a  ½ b ﬁ  ", "　x　　y　", "ﷺ ﷺ ", "a" * 300 + "ｶﾞ" * 50]:
        norm, at = model.normalise(t.encode())
        assert norm.decode() == lib.normalize(t)
        assert len(at) == len(norm) + 1 and (at[1:] >= at[:-1]).all()
        slow, places = slowly(model, t.encode())
        assert slow == norm and places == at.tolist()


def slowly(model, data):
    """Byte by byte: the longest known prefix, or a character; blanks at the ends and after blanks are left out if squeezed."""
    out, i = [], 0
    while i < len(data):
        size = next((n for n in (1, 2, 3, 4) if len(data) >= i + n and _whole(data[i : i + n])), 1)
        put, size = model.map.longest(data, i) or (data[i : i + size], size)
        out += [(b, i) for b in put]
        i += size
    end = len(data)
    if model.squeeze:
        out = [x for n, x in enumerate(out) if x[0] != 32 or (n and out[n - 1][0] != 32)]
        while out and out[-1][0] == 32:
            end = out.pop()[1]
        if not out and data:
            end = 0
    mark = "▁".encode()
    pieces = ([(mark, out[0][1])] if out and model.dummy else []) + [(mark if b == 32 else bytes([b]), i) for b, i in out]
    return b"".join(p for p, _ in pieces), [i for p, i in pieces for _ in p] + [end]


def _whole(data):
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def test_query_matches_library(spark, tmp_path):
    rows = [(n, t, 1) for n, t in enumerate([None, *ODD, *ODD])]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda s: sha256(s.encode()).hexdigest()
    for r in pieces.op3_sentencepiece(spark, str(tmp_path)).collect():
        ids = LIB.encode(rows[r.doc_id][1] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(LIB.decode(ids)))
    for r in token_counts.op4_token_counts(spark, str(tmp_path)).collect():
        text = rows[r.doc_id][1] or ""
        n = len(LIB.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)


def test_round_trip_and_empty(spark):
    docs = spark.createDataFrame([(1, "héllo  wörld 🌸"), (None, "x"), (2, None)], "doc_id long, text string")
    encoded = pieces.encode_documents(docs)
    assert {r.id: r.text for r in pieces.decode_documents(encoded).collect()} == {1: "héllo  wörld 🌸", None: "x", 2: ""}
    assert pieces.encode_documents(docs.limit(0)).count() == token_counts.token_counts(docs.limit(0)).count() == 0


def test_words_merged_side_by_side_are_those_of_the_heap(monkeypatch):
    model, rng = piece.Pieces(PATH), random.Random(9)
    monkeypatch.setattr(piece, "TOGETHER", 500)
    monkeypatch.setattr(piece, "TABLE", 700)
    real = {w for t in texts() for w in model.cut.findall(model.marked(t))}
    made = {"".join(rng.choice("▁aeiouthnrsñ漢🌸0.,!́") for _ in range(rng.randrange(1, 30))) for _ in range(3000)}
    words = real | made
    found = model.learned(words)
    alone = piece.Pieces(PATH)
    assert found.keys() == words
    for w in words:
        assert found[w] == alone.word(w), w
    many = [t * (1 + n % 3) for n, t in enumerate(texts()[:300])]
    monkeypatch.setattr(piece, "GATHERED", 4000)
    for one, t in zip(model.encode_all(many), many, strict=True):
        assert one.ids == LIB.encode(t)
