"""Neighbours in many dimensions against a plain scan, and how few blocks points in groups meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vicinage.operators import vectors

SCHEMA = "view string, spot_id long, pc array<double>"


def plain(ids, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return {int(i): [int(j) for j in ids[np.lexsort((ids, row))[:k]]] for i, row in zip(ids, d)}


def found(df):
    out = {}
    for r in df.orderBy("view", "q", "place").collect():
        out.setdefault(r["view"], {}).setdefault(r["q"], []).append(r["r"])
    return out


def clusters(rng, n, groups, dims, spread):
    return (rng.normal(size=(groups, dims)) * 10)[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * spread


@pytest.mark.parametrize("block,pivots,k", [(16, 1024, 5), (16, 3, 20), (4096, 1024, 3)])
def test_neighbours_equal_a_scan(spark, monkeypatch, block, pivots, k):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    monkeypatch.setattr(vectors, "VISITS", 2)
    rng = np.random.default_rng(block + pivots)
    grid = np.stack(np.meshgrid(np.arange(10.0), np.arange(10.0)), 2).reshape(-1, 2)  # many equal distances
    views = {"clusters": clusters(rng, 300, 6, 8, 0.3), "grid": grid, "copies": np.repeat(rng.normal(size=(3, 4)), 40, 0), "few": rng.normal(size=(2, 5)), "far": np.concatenate([rng.normal(size=(50, 3)), [[1e12, -1e12, 0.0]]])}
    rows, want = [], {}
    for name, x in views.items():
        ids = rng.permutation(len(x) * 3)[: len(x)]
        rows += [(name, int(i), v.tolist()) for i, v in zip(ids, x)]
        want[name] = plain(ids, x, k)
    assert found(vectors.knn_dense(spark.createDataFrame(rows, SCHEMA), k)) == want


def test_points_in_groups_meet_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(4)
    shares = {}
    for name, x in (("groups", clusters(rng, 2000, 25, 16, 0.2)), ("random", rng.normal(size=(2000, 16)))):
        points = spark.createDataFrame([(name, i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
        packed, shape = vectors.blocks(points, "view", "spot_id", "pc")
        assert packed.agg(F.max(F.size("ids"))).first()[0] <= 64
        goes = vectors.meetings(packed, shape, 5, "view").filter("near is null").agg(F.sum(F.size("ids"))).first()[0] or 0
        shares[name] = goes / (2000 * packed.count())
    assert shares["groups"] < 0.1 < shares["random"] <= 1


def test_copies_of_one_point_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    points = spark.createDataFrame([("a", i, [1.0, 2.0]) for i in range(400)], SCHEMA)
    packed, _ = vectors.blocks(points, "view", "spot_id", "pc")
    assert packed.agg(F.max(F.size("ids"))).first()[0] < 64
    assert found(vectors.knn_dense(points, 3))["a"] == {i: [0, 1, 2] for i in range(400)}


def test_points_without_a_finite_vector_take_no_part(spark):
    rows = [("a", 1, [0.0, 1.0]), ("a", 2, None), ("a", 3, [float("nan"), 0.0]), ("a", 4, [0.0, 3.0]), (None, 5, [0.0, 0.0]), ("a", 6, [float("inf"), 0.0]), ("a", 7, [None, 0.0]), ("a", None, [1.0, 1.0])]
    assert found(vectors.knn_dense(spark.createDataFrame(rows, SCHEMA), 3)) == {"a": {1: [1, 4], 4: [4, 1]}}
    assert vectors.knn_dense(spark.createDataFrame([], SCHEMA), 3).collect() == []


def test_vectors_are_not_written_for_each_block_they_meet(spark, monkeypatch, capsys):
    """Random directions meet all blocks: pairs come from a product of written tables, and references in several parts change nothing."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "HELD", 4000)
    x = np.random.default_rng(9).normal(size=(200, 8))
    near = vectors.knn_dense(spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], SCHEMA), 6)
    near.explain()
    assert "CartesianProduct" in capsys.readouterr().out
    assert found(near)["a"] == plain(np.arange(200), x, 6)
