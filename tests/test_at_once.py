"""Samples are analysed at once: their jobs are small and mostly wait for the driver."""

import threading

import pytest
from vicinage.functions.shared import at_once, shuffles_dropped
from vicinage.plans import communities

NAME = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_samples_are_analysed_at_once(spark, monkeypatch):
    meet = threading.Barrier(3, timeout=20)  # broken if one sample waits for another

    def found(expr, cells, o):
        meet.wait()
        return [r[0] for r in cells.select("sample").distinct().collect()]

    monkeypatch.setattr(communities, "find_communities", found)
    monkeypatch.setattr(communities, "integrate_communities", lambda results, *a, **b: results)
    cells = spark.createDataFrame([(i, f"S{i % 3}") for i in range(9)], "cell_id long, sample string")
    assert communities.several_samples(cells, cells, [2]) == {s: [s] for s in ("S0", "S1", "S2")}


def test_results_are_in_order_and_errors_are_raised(spark):
    assert at_once(spark, lambda n: spark.range(n).count(), [3, 1, 2, 7, 5]) == [3, 1, 2, 7, 5]
    with pytest.raises(ZeroDivisionError):
        at_once(spark, lambda n: 1 // n, [1, 0])


def test_threads_share_the_setting_that_drops_shuffles(spark):
    before, both = spark.conf.get(NAME, None), threading.Barrier(2, timeout=20)
    ended = threading.Event()

    def first(_):
        with shuffles_dropped(spark):
            both.wait()
        ended.set()

    def second(_):
        with shuffles_dropped(spark):
            both.wait()
            ended.wait(20)
            return spark.conf.get(NAME)

    assert at_once(spark, lambda f: f(0), [first, second])[1] == "true"
    assert spark.conf.get(NAME, None) == before
