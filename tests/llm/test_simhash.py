import numpy as np
import xxhash

from ombra.llm import simhash


def slow_print(text, size=4):
    table = {c: c + 32 for c in range(65, 91)}
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    of = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, f in prints:
            for j, g in prints:
                if bin(f ^ g).count("1") <= 4 and of[j] < of[i]:
                    of[i], changed = of[j], True
    return of


def corpus():
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    texts = []
    for t in base:
        texts += [t, t, t.upper().replace("W", "w"), t + " end", t.replace("w7 ", "w8 ", 1)]
    return texts + [None, "", " \t\n", "one", "One", "é à", "a b c d", "a b c", "x " * 20000]


def test_matches_brute_force(spark, tmp_path):
    texts = corpus()
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, str(tmp_path)).collect()}
    prints = [(i, slow_print(t)) for i, t, _ in rows]
    of = slow_components(prints)
    assert got == {i: (f"{p:016x}", of[i]) for i, p in prints}


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (4, "a b c d e")], "doc_id long, text string")
    got = sorted((r.id or 0, r.component) for r in simhash.near_duplicates(docs).collect() if r.id)
    assert got == [(4, 4), (5, 4), (5, 4)]
    assert [r.component for r in simhash.near_duplicates(docs).where("id is null").collect()] == [None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    some = base[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(64, n % 8, replace=False)) for n in range(200)], np.uint64)
    for radius in (0, 1, 2, 3, 4, 5, 6):
        q, r = simhash.near(some, simhash.planes_of(base), len(base), radius)
        want = {(i, j) for i, x in enumerate(some) for j, y in enumerate(base) if bin(int(x) ^ int(y)).count("1") <= radius}
        assert set(zip(q.tolist(), r.tolist(), strict=True)) == want


def test_hot_key_is_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "QUERIES", 5)
    fps = [(1 << 63) - 1 - (1 << a) - (1 << b) for a in range(20) for b in range(a)]
    prints = spark.createDataFrame([(0, f, f) for f in fps], "turn int, fp long, node long")
    from ombra.llm.common import components

    found = components(simhash.links(prints))
    assert {r.component for r in found.collect()} == {min(fps)} and found.count() == len(fps)


def test_components_of_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    for n, groups, queries in ((1, 1, 4), (40, 3, 7), (300, 12, 64), (700, 700, 128), (500, 1, 128)):
        monkeypatch.setattr(simhash, "QUERIES", queries)
        centres = rng.integers(0, 2**63, groups, dtype=np.uint64)
        fps = np.unique(centres[rng.integers(0, groups, n)] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(n)], np.uint64))
        want = slow_components([(i, int(f)) for i, f in enumerate(fps)])
        assert simhash.joined(fps).tolist() == [want[i] for i in range(len(fps))]


def test_every_split_finds_the_same_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 60)
    fps = sorted({int(x) for x in base} | {int(x ^ np.int64(sum(1 << int(b) for b in rng.choice(62, 4, replace=False)))) for x in base for _ in range(6)})
    from ombra.llm.common import components

    prints = spark.createDataFrame([(0, f, f) for f in fps] + [(1, f ^ 1, -n) for n, f in enumerate(fps[:1], 1)], "turn int, fp long, node long")
    want = slow_components([(f, f % 2**64) for f in fps])
    for blocks, _ in simhash.SPLITS:
        found = {r.node: r.component for r in components(simhash.links(prints, blocks=blocks)).collect()}
        assert {f: found.get(f, f) for f in fps} == want, blocks


def test_texts_that_share_an_id_are_apart(spark):
    docs = spark.createDataFrame([(5, "one two three four five six"), (5, "a b c d e f g h"), (2, "a b c d e f g h")], "doc_id long, text string")
    got = sorted((r.id, r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == [(2, 2), (5, 2), (5, 5)]


def slow_linked(prints):
    """The smallest id that links reach, for (id, fingerprints) rows linked by any of theirs."""
    of = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, f in prints:
            for j, g in prints:
                if of[j] < of[i] and any(bin(x ^ y).count("1") <= 4 for x, y in zip(f, g, strict=True)):
                    of[i], changed = of[j], True
    return of


def test_several_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for k in range(15):
        base = list(rng.choice(words, 150))
        rows.append((10 * k, " ".join(base)))
        for n in range(1, 4):
            other = list(base)
            for at in rng.choice(150, 2 * n, replace=False):
                other[at] = "changed"
            rows.append((10 * k + n, " ".join(other)))
    rows += [(900, ""), (901, None), (902, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [(i, [int.from_bytes(x, "big") for x in simhash.fingerprint((t or "").encode(), 5, prints=4)]) for i, t in rows]
    assert all(p[0] == slow_print(t, 5) for (_, t), (_, p) in zip(rows, prints, strict=True))
    assert len({x for _, p in prints[:60] for x in p}) > 200
    got = {r.id: r.component for r in simhash.near_duplicates(docs, size=5, prints=4).collect()}
    assert got == slow_linked(prints)
    assert len(set(got.values())) < len(set(slow_linked([(i, p[:1]) for i, p in prints]).values()))
