"""Nearest vectors against brute force."""

import os

import numpy as np
import pytest

from lodegraph.llm import neighbours as nb
from lodegraph.llm import queries

ROWS = "id string, embedding_vector array<float>, updated_at timestamp, leaf int, reach double"


def data(n=900, dim=16, seed=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dim))
    x = centres[rnd.integers(0, 6, n)] + 0.35 * rnd.normal(size=(n, dim))
    x[: n // 3] = centres[0] + 0.05 * rnd.normal(size=(n // 3, dim))  # one group holds a third
    x[5] = x[6] = x[7]
    return x


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.sort(s, axis=1)[:, ::-1][:, :k], s


@pytest.mark.parametrize("block", [8192, 60])
def test_exact_with_factor_one(spark, block):
    x = data()
    df = spark.createDataFrame([(f"v{i:04}", [float(a) for a in r], None, 1, 1.0) for i, r in enumerate(x)], ROWS)
    v = nb.cut(nb.usable_vectors(df, dim=16))
    best, s = exact(x, 5)
    got = nb.nearest(v, 5, dim=16, block=block).collect()
    assert len(got) == 5 * len(x)
    for r in got:
        assert abs(r.cosine - best[int(r.q[1:]), r["rank"] - 1]) < 1e-5
    near = nb.nearest(v, 5, radius=0.3, dim=16, block=block).collect()
    limit = 1 - 0.3**2 / 2
    want = sum(min(5, int((s[i] >= limit).sum())) for i in range(len(x)))
    assert abs(len(near) - want) <= 2 and all(r.cosine >= limit - 1e-5 for r in near)


def test_recall_of_relaxed_search(spark):
    x = data(1500, 24, 3)
    df = spark.createDataFrame([(f"v{i:04}", [float(a) for a in r], None, 1, 1.0) for i, r in enumerate(x)], ROWS)
    v = nb.cut(nb.usable_vectors(df, dim=24))
    best, _ = exact(x, 10)
    asked = v.where("substring(id, 5, 1) = '0'")
    got = nb.nearest(v, 10, queries=asked, factor=0.7, dim=24).collect()
    hits = sum(r.cosine >= best[int(r.q[1:]), 9] - 1e-6 for r in got)
    assert hits >= 0.9 * 10 * asked.count()


def test_dirty_vectors_take_no_part(spark):
    ok = [1.0, 2.0, 3.0, 4.0]
    rows = [("A ", ok, None, 1, 1.0), ("a", ok, None, 1, 1.0), ("b", [2.0, 4.0, 6.0, 8.0], None, 1, 1.0), ("z", [0.0] * 4, None, 1, 1.0), ("n", None, None, 1, 1.0), ("e", [], None, 1, 1.0), ("s", [1.0], None, 1, 1.0), ("i", [1.0, float("inf"), 1.0, 1.0], None, 1, 1.0), ("q", [1.0, float("nan"), 1.0, 1.0], None, 1, 1.0), ("u", [1.0, None, 1.0, 1.0], None, 1, 1.0), (None, ok, None, 1, 1.0)]
    v = nb.usable_vectors(spark.createDataFrame(rows, ROWS), dim=4)
    assert sorted(r.id for r in v.collect()) == ["a", "b"]
    found = nb.nearest(v, 3, dim=4)
    assert {(r.q, r.x) for r in found.collect()} == {("a", "b"), ("b", "a")}
    assert [(r.a, r.b) for r in nb.mutual_pairs(found, 0.9).collect()] == [("a", "b")]
    none = nb.usable_vectors(spark.createDataFrame([], ROWS), dim=4)
    assert nb.nearest(none, 3, dim=4).count() == 0


def test_tree_prunes_and_stays_exact():
    x = data(600, 8, 1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, cos = nb.Tree(x, bucket=16).search(x, 4, np.full(len(x), 2.0), 1.0, np.arange(len(x)))
    s = x @ x.T
    np.fill_diagonal(s, -9)
    assert np.allclose(cos, np.sort(s, 1)[:, ::-1][:, :4], atol=1e-5) and (rows >= 0).all()


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test data")
def test_on_the_tables(spark):
    """p4_knn's recall against brute force over all rows, and p4_found against SQL that tries every pair."""
    import duckdb

    v = nb.usable_vectors(spark.read.parquet(f"{TABLES}/code_entities.parquet")).collect()
    ids, x = np.array([r.id for r in v]), np.stack([np.frombuffer(r.vec, "<f4") for r in v]).astype(float)
    asked = [i for i, name in enumerate(ids) if int(name.replace("-", ""), 16) % 20 == 0]
    got: dict[str, list[float]] = {}
    for r in queries.p4_knn(spark, TABLES).collect():
        got.setdefault(r.entity_id, []).append(r.cosine)
    assert set(got) == set(ids[asked])
    hit = want = 0
    for i in asked:
        s = x @ x[i]
        s[i] = -9
        least = np.sort(s)[-10]
        want += 10
        hit += sum(c >= least - 1e-5 for c in got[ids[i]])
    assert hit / want >= 0.9
    duck = duckdb.connect()
    duck.execute(f"create view code_entities as select * from '{TABLES}/code_entities.parquet'")
    pairs = set(duck.execute(queries.oracle_sql()["p4_found"]).fetchall())
    assert pairs and {tuple(r) for r in queries.p4_found(spark, TABLES).collect()} == pairs
