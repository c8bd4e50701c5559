"""Neighbour search, permutations and sums over edges against plain computations, with crowded places, odd ids and missing labels."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from vicinage.operators import neighbours, permutation, statistics


def plain_nearest(queries, refs, k, radius, others):
    out = {}
    for g, q, x, y in queries:
        near = sorted(((x - a) * (x - a) + (y - b) * (y - b), r) for h, r, a, b in refs if h == g and not (others and r == q))
        out[g, q] = [p for p in near if radius is None or p[0] <= radius * radius][:k]
    return out


def tissue(seed, n, name=int):
    """Uneven density, a line, coincident points and far ones."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.4:
            x, y = r.gauss(0, 1), r.gauss(0, 1)
        elif kind < 0.6:
            x, y = float(r.randrange(4)), 0.0
        elif kind < 0.8:
            x, y = r.uniform(-300, 300), r.uniform(-300, 300)
        else:
            x, y = r.uniform(0, 50), 7.0
        rows.append((r.choice("ab"), name(i), x, y))
    return rows + [("a", name(n), 1e7, -1e7), ("c", name(n + 1), 0.0, 0.0)]


@pytest.mark.parametrize("k,radius,others,name", [(5, None, True, int), (3, 2.0, False, int), (12, 40.0, True, "s{}".format), (1, None, False, int), (400, None, False, int)])
def test_nearest_equal_plain_search(spark, monkeypatch, k, radius, others, name):
    monkeypatch.setattr(neighbours, "LEAF", 20)
    monkeypatch.setattr(neighbours, "SAMPLE", 300)
    monkeypatch.setattr(neighbours, "ROWS", 7)
    rows = tissue(k, 700, name)
    kind = "string" if isinstance(rows[0][1], str) else "long"
    refs = spark.createDataFrame(rows, f"kind string, r {kind}, x double, y double")
    asked = rows + [("z", name(10_000), 0.0, 0.0), ("b", name(10_001), -5e8, 3.0)]
    queries = spark.createDataFrame(asked, f"kind string, q {kind}, x double, y double")
    got = {(r.kind, r.q): [tuple(p) for p in r.near] for r in neighbours.nearest_lists(queries, refs, k, radius, ["kind"], others).collect()}
    want = {key: near for key, near in plain_nearest(asked, rows, k, radius, others).items() if key[0] != "z"}
    assert got == want


def test_no_leaf_is_over_its_bound(spark):
    rows = [(("", i, x, y)) for i, (_, _, x, y) in enumerate(tissue(1, 5000))]
    refs = spark.createDataFrame(rows, "g string, r long, x double, y double").dropDuplicates(["x", "y"])
    tree, placed = neighbours.plant(refs, 64)
    sizes = [r["count"] for r in placed.groupBy("leaf").count().collect()]
    assert max(sizes) <= 64 and sum(sizes) == refs.count() and len(sizes) > 30


def test_a_crowded_point_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 16)
    cells = spark.range(3000).select(F.col("id").alias("q"), F.when(F.col("id") < 2900, 0.0).otherwise(F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"))
    got = {r.q: [p.r for p in r.near] for r in neighbours.nearest_lists(cells, cells.withColumnRenamed("q", "r"), 2, None, others=True).collect()}
    assert got[5] == [0, 1] and got[0] == [1, 2] and got[1] == [0, 2] and got[2999] == [2998, 2997] and len(got) == 3000


def test_tiles_meet_the_references_around_them_only(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(40):
        n, m, k = int(rng.integers(1, 200)), int(rng.integers(0, 200)), int(rng.integers(1, 30))
        draw = lambda n: rng.integers(0, 9, n) + 1e6 if trial % 2 else rng.random(n) * 20
        rx, ry, qx, qy, limit = draw(m), draw(m), draw(n), draw(n), rng.choice([np.inf, 30.0, 4.0, 0.0], n)
        own = np.where(rng.random(n) < 0.5, rng.integers(0, max(m, 1), n), -1) if m else np.full(n, -1)
        order = neighbours.tiled(qx, qy)
        qx, qy, limit, own = qx[order], qy[order], limit[order], own[order]
        many, column, d2 = neighbours.nearest_of(qx, qy, limit, own, rx, ry, k)
        at = 0
        for i in range(n):
            far = (qx[i] - rx) ** 2 + (qy[i] - ry) ** 2
            want = [j for j in np.argsort(far, kind="stable").tolist() if far[j] <= limit[i] and j != own[i]][:k]
            assert column[at : at + many[i]].tolist() == want and d2[at : at + many[i]].tolist() == far[want].tolist()
            at += many[i]
    met, plain = [], np.partition
    monkeypatch.setattr(neighbours.np, "partition", lambda x, *a: met.append(x.size if x.ndim > 1 else 0) or plain(x, *a))
    x, y = rng.random((2, 2000))
    order = neighbours.tiled(x, y)
    neighbours.nearest_of(x[order], y[order], np.full(2000, np.inf), np.full(2000, -1), x, y, 10)
    assert 0 < sum(met) < 2000 * 2000 / 5  # a query meets under a fifth of the leaf


# --- permutations


def labelled(n, seed=1):
    r = random.Random(seed)
    return [(i, r.uniform(0, 30), r.uniform(0, 30), r.choice(["t1", "t1", "t2", None]), r.choice(["A", "B", None]), "s") for i in range(n)]


CELLS = "cell_id long, x double, y double, cell_type string, se string, sample string"


def plain_deal(rows, label, nperm, seed):
    groups = defaultdict(list)
    for r in sorted(rows):
        groups[r[3]].append(r)
    out = []
    for perm in range(1, nperm + 1):
        dealt = {}
        for members in groups.values():
            order = sorted((r[0] for r in members), key=lambda c: hashlib.md5(f"{seed}|{perm}|{c}".encode()).digest())
            dealt.update(zip(order, (label(r) for r in members)))
        out.append(dealt)
    return out


@pytest.mark.parametrize("part,chunk", [(1 << 16, 1 << 16), (13, 7)])
def test_dealt_labels_equal_plain_permutations(spark, monkeypatch, part, chunk):
    for name, value in (("PART", part), ("CHUNK", chunk), ("TOGETHER", 2), ("DRAWS", 50)):
        monkeypatch.setattr(permutation, name, value)
    rows = labelled(150)
    names = ["A", "B"]
    got = permutation.dealt_codes(spark.createDataFrame(rows, CELLS), "cell_id", "se", ["cell_type"], 5, 3, names)
    want = plain_deal(rows, lambda r: names.index(r[4]) if r[4] else 2, 5, 3)
    assert {r.cell_id: list(memoryview(r.codes).cast("h")) for r in got.collect()} == {i: [d[i] for d in want] for i in range(150)}


def plain_shares(rows, labels, near, least):
    sums, sizes = defaultdict(float), defaultdict(int)
    for q, others in near.items():
        if len(others) >= least and labels[q] is not None:
            sizes[labels[q]] += 1
            for r in others:
                if labels[r] is not None:
                    sums[labels[q], labels[r]] += 1 / len(others)
    states = {v for v in labels.values() if v is not None}
    return {(i, j): sums[i, j] / sizes[i] for i in sizes for j in states}


def test_colocalization_of_unlabelled_cells(spark):
    rows = labelled(160)
    state = lambda r: f"{r[4]}_{r[3]}" if r[4] and r[3] else None
    found = plain_nearest([("", *r[:3]) for r in rows], [("", *r[:3]) for r in rows], 9, 4.0, True)
    near = {q: [r for _, r in v] for (_, q), v in found.items()}
    observed = plain_shares(rows, {r[0]: state(r) for r in rows}, near, 3)
    nulls = [plain_shares(rows, d, near, 3) for d in plain_deal(rows, state, 12, 1)]
    got = {(r.i, r.j): (r.value, r.zscore) for r in statistics.colocalization(spark.createDataFrame(rows, CELLS), 4, 10, 3, 12).collect()}
    assert set(got) == set(observed)
    for key, value in observed.items():
        null = [x[key] for x in nulls]
        mean = sum(null) / 12
        sd = math.sqrt(sum((x - mean) ** 2 for x in null) / 11)
        assert got[key] == pytest.approx((value, (value - mean) / (sd if sd > 1e-9 else 1)), abs=1e-6)


def test_moran_of_unlabelled_cells(spark):
    rows = labelled(90, 2)
    found = plain_nearest([("", *r[:3]) for r in rows], [("", *r[:3]) for r in rows], 3, None, True)

    def index(labels):
        out = {}
        for se in ("A", "B"):
            z = {i: (labels[i] == se) - sum(v == se for v in labels.values()) / len(rows) for i in labels}
            out[se] = sum(z[q] * z[r] / 3 for (_, q), v in found.items() for _, r in v) / sum(x * x for x in z.values())
        return out

    observed, nulls = index({r[0]: r[4] for r in rows}), [index(d) for d in plain_deal(rows, lambda r: r[4], 10, 1)]
    got = {r.se: (r.value, r.zscore) for r in statistics.normalized_moran(spark.createDataFrame(rows, CELLS), 10).collect()}
    assert set(got) == {"A", "B"}
    for se, value in observed.items():
        null = [x[se] for x in nulls]
        mean = sum(null) / 10
        sd = math.sqrt(sum((x - mean) ** 2 for x in null) / 9)
        assert got[se] == pytest.approx((value, (value - mean) / sd), abs=1e-6)
    assert {r.se: r.value for r in statistics.moran_index(spark.createDataFrame(rows, CELLS)).collect()} == pytest.approx(observed)


def test_chunks_of_permutations():
    assert statistics.permutation_chunks(450, 10) == [(0, 200), (200, 200), (400, 50)] and statistics.permutation_chunks(3, 4000) == [(0, 1), (1, 1), (2, 1)]


def test_coassociation_of_unlabelled_cells(spark):
    rows = [(i, s, se, ct) for i, (s, se, ct) in enumerate((s, se, ct) for s in "123" for k in range(int(s)) for se in ("A", "B", None) for ct in ("t", "u", None))]
    cells = spark.createDataFrame(rows, "cell_id long, sample string, se string, cell_type string")
    whole = cells.dropna()
    assert sorted(map(tuple, statistics.coassociation(cells).collect())) == sorted(map(tuple, statistics.coassociation(whole).collect()))
