import duckdb
import numpy as np

from ombra.llm import nn_descent


def vectors():
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(300)]
    for k in range(40):
        base = np.array(rows[k * 7][1])
        rows += [(1000 + k, (base + rng.normal(size=16) * 0.1).tolist(), rows[k * 7][2])]
    hot = rng.normal(size=16)
    rows += [(2000 + k, (hot + rng.normal(size=16) * 0.02).tolist(), 1) for k in range(150)]
    rows += [(3000 + k, hot.tolist(), 1) for k in range(30)] + [(3100, (hot * 7).tolist(), 1), (3101, hot.tolist(), 2), (3102, hot.tolist()[:15], 1)]
    rows += [(4000, None, 1), (4001, [0.0] * 16, 1), (4002, [float("nan")] * 16, 1), (4003, [None] + [1.0] * 15, 1), (4004, hot.tolist(), None), (4005, [], 1), (4006, [1e300] * 16, 0), (4007, [1e-300] * 16, 0)]
    return rows


def brute(rows):
    ok = [(i, np.array(v, float), g) for i, v, g in rows if v and None not in v and g is not None and np.isfinite(np.array(v, float)).all() and np.any(v)]
    units = [(i, (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()), g) for i, v, g in ok]
    near = {i: set() for i, _, _ in rows}
    for n, (i, x, g) in enumerate(units):
        for j, y, h in units[n + 1 :]:
            if g == h and len(x) == len(y) and x @ y >= 0.98:
                near[i].add(j)
                near[j].add(i)
    low = {i: i for i in near}
    changed = True
    while changed:
        changed = False
        for i, js in near.items():
            m = min([low[i], *(low[j] for j in js)])
            changed |= m != low[i]
            low[i] = m
    return {i: (len(near[i]), low[i], low[i] == i) for i in near}


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nn_descent, "LEAF", 32)
    monkeypatch.setattr(nn_descent, "BLOCK", 40)
    rows = vectors()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    docs.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.op8_nn_descent(spark, str(tmp_path)).collect()}
    assert got == brute(rows)


def test_sql_against_brute_force():
    rows = [r for r in vectors() if r[0] < 4000]
    import pyarrow as pa

    embeddings = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64())), "label": [r[2] for r in rows]})
    assert embeddings.num_rows
    got = {r[0]: r[1:] for r in duckdb.sql(nn_descent.OP8_SQL).fetchall()}
    assert got == brute(rows)


def test_empty_null_ids_and_copies(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [2.0, 0.0], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.id or 0, r.n_links, r.component or 0) for r in nn_descent.near_duplicates(docs).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (4, 2, 4), (5, 2, 4), (5, 2, 4)]
    assert nn_descent.near_duplicates(docs.limit(0)).count() == 0


def pairs_of_clusters():
    """Clusters of 20 whose members' nearest 8 are all of their own, with links to the other cluster; and one further away."""
    rng = np.random.default_rng(3)
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    rows = []
    for k in range(12):
        a, b = axes[2 * k], axes[2 * k + 1]
        for c, angle in enumerate((0, 0.175, 0.6)):
            centre = np.cos(angle) * a + np.sin(angle) * b
            rows += [(1000 * k + 100 * c + n, (centre + rng.normal(size=64) * 0.0018).tolist(), k % 2) for n in range(20)]
    return rows


def test_links_between_saturated_clusters(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 8)
    monkeypatch.setattr(nn_descent, "CHUNKS", 2)
    monkeypatch.setattr(nn_descent, "WIDE", 16)
    rows = pairs_of_clusters()
    want = brute(rows)
    assert {n for n, _, _ in want.values()} == {19, 39}
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component, r.id == r.component) for r in nn_descent.near_duplicates(docs).collect()}
    assert got == want


def test_large_clusters_that_touch(spark):
    """Clusters far larger than a list, linked across, and chains of them: every link counts."""
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.normal(size=(48, 48)))[0]
    rows = []
    for k, angles in enumerate(((0, 0.175), (0, 0.17, 0.34, 0.51), (0, 0.6))):
        for c, angle in enumerate(angles):
            centre = np.cos(angle) * axes[2 * k] + np.sin(angle) * axes[2 * k + 1]
            rows += [(10000 * k + 1000 * c + n, (centre + rng.normal(size=48) * 0.0018).tolist(), 1) for n in range(90)]
    rows += [(90000 + n, rng.normal(size=48).tolist(), 1) for n in range(600)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component, r.id == r.component) for r in nn_descent.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_missed_pairs_are_noticed_beside_a_large_group(spark, monkeypatch):
    """Leaves that hold nothing but a hot group: the result must still be whole."""
    leaves = nn_descent.leaves
    monkeypatch.setattr(nn_descent, "leaves", lambda *a: leaves(*a).where("u between 2000 and 2999 and v between 2000 and 2999"))
    monkeypatch.setattr(nn_descent, "BLOCK", 40)
    rows = vectors()
    want = brute(rows)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component, r.id == r.component) for r in nn_descent.near_duplicates(docs).collect()}
    assert got == want
