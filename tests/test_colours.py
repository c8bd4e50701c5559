"""Ramps, annotation colours, and the order of a heatmap's rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from vicinage.functions import colours, views
from vicinage.operators import trees

BLUE, WHITE, RED = colours.STOPS


def ramp(spark, breaks, shades, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r["c"] for r in df.select("i", colours.ramp_hex(F.col("v"), breaks, shades).alias("c")).orderBy("i").collect()]


def test_ramps_through_lab_have_the_known_colours(spark):
    heat = ["#ffffd9", "#edf8b1", "#225ea8"]
    assert ramp(spark, [0, 0.6, 1.2], heat, [-1.0, 0.0, 0.15, 0.3, 0.6, 0.75, 0.9, 1.2, 5.0]) == ["#FFFFD9", "#FFFFD9", "#FBFDCF", "#F6FCC5", "#EDF8B1", "#C3CFB1", "#98A7AF", "#225EA8", "#225EA8"]
    assert ramp(spark, [1, 5, 9], [BLUE, WHITE, RED], [0.0, 1.0, 2.5, 5.0, 7.0, 9.0, 12.0]) == ["#0000FF", "#0000FF", "#9B6FFF", "#FFFFFF", "#FF9E81", "#FF0000", "#FF0000"]


def test_breaks_in_any_order_repeated_or_too_few(spark):
    assert ramp(spark, [9, 1, 5, 5], [RED, BLUE, WHITE, "#000000"], [5.0, 7.0, None, math.nan]) == ["#FFFFFF", "#FF9E81", None, None]
    assert ramp(spark, [0, 1], ["#000000", "#FFFFFF"], [0.0, 1.0, 1e-3]) == ["#000000", "#FFFFFF", "#000000"]
    with pytest.raises(ValueError):
        colours.ramp_hex(F.col("v"), [1, 1], [RED, BLUE])
    with pytest.raises(ValueError):
        colours.ramp_hex(F.col("v"), [1, 2, 3], [RED, BLUE])


def test_levels_beyond_the_palette_lie_between_its_colours(spark):
    df = spark.range(1, 8).select("id", colours.level_hex(F.col("id"), F.lit(7), ["#000000", "#FFFFFF"]).alias("c"))
    assert [r["c"] for r in df.orderBy("id").collect()] == views.ramp(["#000000", "#FFFFFF"], 7)


def test_annotation_of_missing_equal_and_own_colours(spark):
    rows = [(1, "b", 1.0, 2.0, True), (2, "a", None, 2.0, None), (3, None, 3.0, None, False), (4, "a", math.nan, 2.0, True)]
    df = spark.createDataFrame(rows, "id int, kind string, x double, same double, flag boolean")
    got = {(r["column"], r["key"]): r["colour"] for r in colours.annotation(df, "id", ["kind", "x", "same", "flag"], {"kind": ["#111111", "#222222"]}).collect()}
    assert [got["kind", i] for i in (1, 2, 3, 4)] == ["#222222", "#111111", "#BEBEBE", "#111111"]
    assert [got["x", i] for i in (1, 2, 3, 4)] == [BLUE, "#BEBEBE", RED, "#BEBEBE"]
    assert [got["same", i] for i in (1, 2, 3, 4)] == [WHITE, WHITE, "#BEBEBE", WHITE]
    assert [got["flag", i] for i in (1, 2, 3, 4)] == [views.KELLY[2], "#BEBEBE", views.KELLY[1], views.KELLY[2]]
    assert colours.annotation(df.limit(0), "id", ["kind", "x"]).collect() == []


def test_rows_of_a_heatmap_follow_their_trees(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(6, 4)), 20 + rng.normal(size=(5, 4)), -20 + rng.normal(size=(3, 4))])
    names = [f"r{i:02}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame([(n, j, float(v)) for n, row in zip(names, x) for j, v in enumerate(row)], "row string, col int, value double")
    at = np.argsort(names)
    d = np.sqrt(((x[at][:, None] - x[at][None]) ** 2).sum(2))
    names = sorted(names)
    got = {r["row"]: (r["slice"], r["place"]) for r in views.heatmap_order(df).collect()}
    assert sorted(names, key=lambda n: got[n][1]) == [names[i] for i in trees.leaf_order(trees.linkage(d), len(d))]
    label = trees.cut(trees.linkage(d), len(d), 3)
    got = {r["row"]: (r["slice"], r["place"]) for r in views.heatmap_order(df, split=3).collect()}
    want = []
    for g in (1, 2, 3):
        own = np.flatnonzero(label == g)
        want += [(names[own[i]], g) for i in trees.leaf_order(trees.linkage(d[np.ix_(own, own)]), len(own))]
    assert [(n, got[n][0]) for n in sorted(got, key=lambda n: got[n][1])] == want and sorted(p for _, p in got.values()) == list(range(1, 15))


def test_slices_by_label_single_rows_and_missing_values(spark):
    rows = [("a", 0, 1.0), ("b", 0, 1.0), ("b", 0, 3.0), ("c", 0, None), ("d", 1, math.nan), ("e", 0, 9.0), ("f", 0, 1.0), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "row string, col int, value double")
    labels = spark.createDataFrame([("a", "y"), ("b", "x"), ("c", "x"), ("d", None), ("e", "x")], "row string, slice string")
    got = [(r["row"], r["slice"]) for r in views.heatmap_order(df, split=labels).orderBy("place").collect()]
    assert got == [("d", None), ("e", "x"), ("b", "x"), ("c", "x"), ("a", "y")]
    assert views.heatmap_order(df.limit(0), split=2).collect() == []
    assert len(views.heatmap_order(df, split=50).select("slice").distinct().collect()) == 6
