import random
import re
import zlib
from hashlib import sha256
from html import unescape

import pytest
from pyspark.sql import functions as F

from ombra.llm import media

TEXTS = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "<b>&amp; 🌸</b>\n" * 5000, "a", "one\n\n two  words \r\n<p>three</figure>\n</html>", "\n"]


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, feature string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in media.op7_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data, r = (t or "").encode(), rows[i]
        payload = data + bytes((64 - len(data) % 64) % 64)
        payload = payload or bytes(64)
        stored = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), sha256(stored).hexdigest(), media.feature(payload))
        parts = [" ".join(x.split()) for x in (t or "").split("\n")]
        first = max(1, len(parts) // 2)
        parts = [*parts[:first], None, *parts[first:], None]
        parts = [x for x in parts if x is None or x]
        assert (r.n_parts, r.positions) == (len(parts), ",".join(str(n) for n, x in enumerate(parts) if x is None))
        assert r.captions == f"payload of {len(data)} bytes|end of {i}"
        assert r.text_sha256 == sha256("\n".join(x for x in parts if x is not None).encode()).hexdigest()
    assert rows[0].feature == rows[1].feature and rows[2] != rows[3] and rows[2].feature == rows[7].feature


def test_lossless_and_damage():
    rng = random.Random(6)
    for n in (1, 2, 100):
        payload = rng.randbytes(64 * n)
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload
        for at in (0, 20, len(stored) // 2, len(stored) - 14):
            with pytest.raises((ValueError, zlib.error)):
                media.from_png(stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1 :])


def test_parts_keep_order_and_captions():
    html = """<p>one <b>two</b></p><script>var x = "<p>";</script><figure><img src="sha256:aa" alt="alt"><figcaption>cap &amp; more</figcaption><img src="u2"></figure>
    three<img src="http://x/y.png" alt="pic">four<img alt="no source"><figure><figcaption>lone</figcaption></figure>"""
    parts = [(p["position"], p["kind"], p["text"] or p["ref"], p["caption"]) for p in media.parse(html)]
    assert parts == [(0, "text", "one two", None), (1, "media", "sha256:aa", "cap & more"), (2, "media", "u2", "cap & more"), (3, "text", "three", None), (4, "media", "http://x/y.png", "pic"), (5, "text", "four", None)]
    assert media.parse(None) == media.parse("") == []
    brief = lambda html: [(p["text"] or p["ref"], p["caption"]) for p in media.parse(html)]
    assert brief("<figure><img src=a><figcaption>cap</figure><p>rest") == [("a", "cap"), ("rest", None)]
    assert brief("<figure><img src=a><figcaption>cap <b>all") == [("a", "cap all")]
    assert brief("<figure><figcaption>out<figure><img src=b><figcaption>in</figcaption></figure><img src=a></figure>x") == [("b", "in"), ("a", "out"), ("x", None)]
    assert brief("<figure><img src=a alt=z><figcaption></figcaption></figure>") == [("a", "z")]


def test_resolving(spark):
    known, lost = sha256(b"a").hexdigest(), "b" * 64
    many = media.page_of("t\nu\nv\nw", [(lost, "first"), (known, "second"), (known, "third & <last>")])
    pages = spark.createDataFrame([(1, many), (1, many), (2, None), (None, media.page_of("", [(known, "x")])), (3, '<img src="x.png">')], "page_id long, html string")
    docs = spark.createDataFrame([("a",), ("a",)], "text string")
    found = media.resolve(media.sequences(pages), media.features(media.store(docs)))
    rows = sorted(((r.id or 0, r.position, r.caption or "", r.n_bytes) for r in found.where("position < 9").collect()), key=str)
    assert rows == [(0, 0, "x", 1), *[(1, 1, "first", None)] * 2, *[(1, 3, "second", 1)] * 2, *[(1, 6, "third & <last>", 1)] * 2, (3, 0, "", None)]
    whole = media.interleaved(media.sequences(pages), media.features(media.store(docs))).collect()
    assert sorted((r.id or 0, len(r.parts), [m.position for m in r.media], [m.caption for m in r.media]) for r in whole if r.id != 3) == [(0, 1, [0], ["x"]), *[(1, 7, [1, 3, 6], ["first", "second", "third & <last>"])] * 2, (2, 0, [], [])]
    assert all(r.parts[m.position].ref == f"sha256:{m.digest}" and r.parts[m.position].caption == m.caption for r in whole for m in r.media if m.digest)
    empty = media.features(media.store(docs.limit(0)))
    assert media.resolve(media.sequences(pages.limit(0)), empty).count() == media.interleaved(media.sequences(pages.limit(0)), empty).count() == 0
    kept = media.store(docs).select(F.col("digest"), "media").dropDuplicates(["digest"])
    assert [media.from_png(bytes(r.media))[:1] for r in media.resolve(media.sequences(pages.where("page_id is null")), kept).collect()] == [b"a"]


def test_real_pages_keep_their_text(spark):
    """All text of real pages is in the sequences, in order; whatever isn't text or media isn't."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html or "" for r in pages.collect()}
    for r in media.sequences(pages).collect():
        bare = re.sub(r"(?s)<(script|style).*?</\1>|<!--.*?-->", "", html[r.id])
        words = unescape(re.sub(r"<[^>]+>", " ", bare)).split()
        assert "".join(w for p in r.parts for w in p.text.split()) == "".join(words)
        assert [p.position for p in r.parts] == list(range(len(r.parts)))
