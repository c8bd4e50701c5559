"""Edge rules: equal places, exact radius, constant genes, empty groups, files, streams."""

import pytest
from pyspark.sql import functions as F
from vicinage.functions.shared import numbered
from vicinage.operators import expression, neighbours, ranking, spatial, statistics
from vicinage.plans import communities
from vicinage.sources import files
from vicinage.streaming.abundance import windowed_counts


def points(spark, rows, name):
    return spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], f"{name} long, x double, y double")


def test_distance_equal_to_the_radius(spark):
    q, r = points(spark, [(1, 0, 0)], "q"), points(spark, [(1, 0, 0), (2, 3, 4)], "r")
    assert spatial.radius_pairs(q, r, 5.0).count() == 2
    assert spatial.knn_weights(r, q, 5, 5.0).count() == 1
    assert spatial.knn_weights(r, q, 5, 5.0, include_self=False).count() == 0


def test_coincident_points_keep_self_first(spark):
    cells = points(spark, [(5, 0, 0), (3, 0, 0), (4, 0, 0)], "cell_id")
    edges = {(r.q, r.r) for r in statistics.neighbour_edges(cells, 10, 3).collect()}
    assert edges == {(a, b) for a in (3, 4, 5) for b in (3, 4, 5) if a != b}


def test_more_neighbours_than_points_at_any_distance(spark):
    p = points(spark, [(1, 0, 0), (2, 1000, 0), (3, 0, 50000)], "q")
    near = neighbours.nearest_pairs(p, p.withColumnRenamed("q", "r"), 10)
    assert near.count() == 9


def test_neighbours_of_far_and_unplaced_points(spark):
    """Far queries get all they can have; null and NaN coordinates take no part and do not keep the search going."""
    refs = points(spark, [(i, i, 0) for i in range(5)], "r")
    odd = spark.createDataFrame([(1, 1e9, 2.0), (2, float("nan"), 0.0), (3, None, 0.0), (4, 0.0, 0.0)], "q long, x double, y double")
    got = {(r.q, r.r) for r in neighbours.nearest_pairs(odd, refs, 2).collect()}
    assert got == {(1, 4), (1, 3), (4, 0), (4, 1)}


def test_spot_weights_rules(spark):
    cells = points(spark, [(i, i, 0) for i in range(8)], "cell_id")
    spots = points(spark, [(i, i, 1) for i in range(6)], "spot_id")
    got = spatial.spot_weights(cells, spots, 3, 2.0).collect()
    of = {s: sorted(r.cell_id for r in got if r.spot_id == s) for s in range(6)}
    assert of[0] == [0, 1] and of[3] == [2, 3, 4] and all(r.w == 1 / len(of[r.spot_id]) for r in got)
    assert {r.spot_id for r in spatial.spot_weights(cells, spots, 3, 2.0, min_cells=3).collect()} == {1, 2, 3, 4, 5}
    assert spatial.spot_weights(cells, spots.filter("spot_id < 4"), 3, 2.0).count() == 0  # fewer than five spots
    few = spatial.spot_weights(cells.filter("cell_id < 3"), spots, 9, 20.0).collect()
    assert {sum(r.spot_id == s for r in few) for s in range(6)} == {2}  # of fewer cells than asked for, all but one
    assert spatial.spot_weights(cells.limit(0), spots, 3, 2.0).count() == 0


def test_numbers_follow_the_key(spark):
    rows = [(f"s{i:03d}", i) for i in (5, 3, 99, 42, 7, 0)]
    got = {r.spot_id: r.n for r in numbered(spark.createDataFrame(rows, "spot_id string, i int"), "spot_id").collect()}
    assert [got[k] for k in sorted(got)] == [1, 2, 3, 4, 5, 6]
    assert numbered(spark.createDataFrame([], "spot_id string"), "spot_id").count() == 0


def test_scaling_constant_gene_and_zero_cell(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,)], "cell_id long")
    expr = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "a", 2.0), (1, "b", 3.0)], "cell_id long, gene string, value double")
    got = {(r.cell_id, r.gene): r.value for r in expression.scale(expr, cells).collect()}
    assert got[1, "a"] == 0 and len(got) == 6 and got[1, "b"] == pytest.approx(2 / 3**0.5)


def test_one_group_znorm_is_centred(spark):
    cells = spark.createDataFrame([(1, "g"), (2, "g")], "cell_id long, g string")
    expr = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0)], "cell_id long, gene string, value double")
    assert sorted(r.value for r in expression.znorm(expr, cells, "g").collect()) == [-1.0, 1.0]


def test_mode_tie_and_equal_bins(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a")], "k long, v string")
    assert ranking.most_frequent(df, ["k"], "v").first()["v"] == "a"
    same = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert sorted(r.bin for r in ranking.cut_equal_width(same, "v", 5).collect()) == [-1, 2, 2]


def test_lost_state_is_an_error(spark):
    rows = [(i, float(i % 5), float(i // 5), "t", "SE1" if i else "SE2") for i in range(20)] + [(99, 500.0, 500.0, "t", "SE1")]
    cells = spark.createDataFrame(rows, "cell_id long, x double, y double, cell_type string, se string")
    with pytest.raises(ValueError):
        statistics.colocalization(cells, 10, 30, 3, nperm=60)


def test_required_types_need_enough_metacells(spark):
    meta = spark.createDataFrame([("s1", "a", "g", 1.0), ("s1", "b", "g", 1.0)], "spot_id string, cell_type string, gene string, value double")
    with pytest.raises(ValueError):
        communities.spots_with_types(meta, ("a", "b"))


def test_toy_lattice_has_communities(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    cells, values = [], []
    for i in range(600):
        x, y, kind = (i % 30) * 12.0, (i // 30) * 12.0, "ABCD"[i % 4]
        cells.append((i, x, y, kind))
        counts = rng.poisson(2, 60).astype(float)
        counts[20:40 if x > 170 else 20] += 8
        counts[0 : 0 if x > 170 else 20] += 8
        counts[i % 4 :: 4] += 4
        values += [(i, f"g{g:02d}", v) for g, v in enumerate(counts.tolist()) if v]
    c = spark.createDataFrame(cells, "cell_id long, x double, y double, cell_type string")
    e = expression.normalize(spark.createDataFrame(values, "cell_id long, gene string, value double"))
    options = {"radius": 25, "n_features": 30, "npcs": 10, "min_types": 1, "min_cells": 2, "min_features": 3, "iterations": 3, "k": 10, "k_graph": 15}
    finder = communities.CommunityFinder(e, c, **options).run()
    labels = finder.se.join(c, "cell_id").groupBy("se", (F.col("x") > 170).alias("right")).count().collect()
    assert len({r.se for r in labels}) >= 2


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "counts.tsv").write_text("gene\tc1\tc2\nA\t1\t0\nB\t2.5\t3\n")
    assert {tuple(r) for r in files.read_wide(spark, str(tmp_path / "counts.tsv")).collect()} == {("A", "c1", 1.0), ("B", "c1", 2.5), ("B", "c2", 3.0)}
    (tmp_path / "meta.tsv").write_text("id\tX\tY\tCellType\nc1\t1\t2\tB\n")
    assert files.read_metadata(spark, str(tmp_path / "meta.tsv")).first().asDict() == {"cell_id": "c1", "x": 1.0, "y": 2.0, "cell_type": "B"}
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 5\n2 2 7\n")
    (tmp_path / "m.rows").write_text("A\nB\n")
    (tmp_path / "m.cols").write_text("c1\nc2\n")
    got = files.read_matrix_market(spark, *(str(tmp_path / f"m.{x}") for x in ("mtx", "rows", "cols"))).collect()
    assert {tuple(r) for r in got} == {("A", "c1", 5.0), ("B", "c2", 7.0)}
    files.write_metadata(spark.createDataFrame([("c1", "SE1")], "cell_id string, se string"), str(tmp_path / "out"))
    assert files.read_metadata(spark, str(tmp_path / "out")).first()["se"] == "SE1"


def test_stream_counts(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 1.0D AS x, 2.0D AS y, 'SE1' AS se UNION ALL SELECT timestamp'2024-01-01 00:20:00', 3.0D, 1.0D, 'SE1'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", 50)
    q = stream.writeStream.outputMode("update").format("memory").queryName("abundance").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.spot_id, r.se, r.n) for r in spark.sql("SELECT * FROM abundance").collect()] == [("X0_Y0", "SE1", 2)]


def test_neighbours_within_a_radius_make_no_table_of_pairs(spark, monkeypatch):
    """Only the k nearest leave a task; ties go to the smaller id and the radius itself is out (for labels in)."""
    monkeypatch.setattr(spatial, "radius_pairs", lambda *a, **b: pytest.fail("all pairs within the radius"))
    q, r = points(spark, [(1, 0, 0), (2, 50, 0)], "q"), points(spark, [(7, 3, 0), (5, 0, 3), (6, 0, 5), (1, 0, 0)], "r")
    assert {(x.q, x.r) for x in spatial.knn_weights(r, q, 2, 5.0).collect()} == {(1, 1), (1, 5)}
    assert {(x.q, x.r) for x in spatial.knn_weights(r, q, 4, 5.0, include_self=False).collect()} == {(1, 5), (1, 7)}
    cells, spots = points(spark, [(1, 0, 0), (2, 50, 0)], "cell_id"), points(spark, [(6, 0, 5), (8, 5, 0)], "spot_id").withColumn("se", F.concat(F.lit("s"), "spot_id"))
    assert [(x.cell_id, x.se) for x in spatial.annotate_cells(cells, spots, 5.0).collect()] == [(1, "s6")]
