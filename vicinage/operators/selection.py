"""Exact quantiles by rounds of selection: histograms narrow the interval around each wanted rank until it holds one value.

A round is one aggregation with partial sums; what reaches the driver is some counts for each wanted rank, whatever the rows or their
distinct values. Every round leaves a smaller interval, as both its ends are values of the table and lie in different bins: for
values spread evenly it shrinks by the number of bins, for values of very different sizes more slowly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import checkpointed

#: Bins of an interval in a round.
BINS = 1024


def order_statistics(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values of the wanted ranks, from 0, of a written one-column table ``v`` of finite numbers."""
    ends = values.agg(F.min("v"), F.max("v")).first()
    known: dict[int, float] = {}
    open_: dict[int, tuple[float, float, int]] = {r: (ends[0], ends[1], 0) for r in ranks}  # interval, and how many values lie before it
    while True:
        known |= {r: low for r, (low, high, _) in open_.items() if low == high}
        open_ = {r: i for r, i in open_.items() if i[0] < i[1]}
        if not open_:
            return known
        spans = sorted({(low, high) for low, high, _ in open_.values()})
        v, bins = F.col("v"), []
        for k, (low, high) in enumerate(spans):
            share = (v / 2 - low / 2) / (high / 2 - low / 2)  # halves, as the difference of large ends may overflow
            at = F.when(v == low, 0).when(v == high, BINS - 1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
            bins.append(F.when(v.between(low, high), F.struct(F.lit(k).alias("span"), at.cast("int").alias("bin"))))
        rows = values.select("v", F.explode(F.filter(F.array(*bins), lambda b: b.isNotNull())).alias("b"))
        found: dict = {}
        for r in rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect():
            found.setdefault(r["b"]["span"], []).append((r["n"], r["low"], r["high"]))
        for r, (low, high, before) in list(open_.items()):
            for n, first, last in found[spans.index((low, high))]:
                if r < before + n:
                    open_[r] = (first, last, before)
                    break
                before += n


def quantiles(df: DataFrame, value: str, at: tuple[float, ...]) -> DataFrame:
    """(at, value): interpolated quantiles, between the two values next to (n - 1) * at. Null and NaN are absent, infinite values count at their
    ends; without values the quantiles are null, and between two values of which one is infinite they are that one (of both, NaN)."""
    if any(not 0 <= a <= 1 for a in at):
        raise ValueError("quantiles are from 0 to 1")
    rows = checkpointed(df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)"))
    inf = math.inf
    below, above, n = rows.agg(F.count_if(F.col("v") == -inf), F.count_if(F.col("v") == inf), F.count(F.lit(1))).first()
    schema = "at double, value double"
    if not n:
        return df.sparkSession.createDataFrame([(float(a), None) for a in at], schema)
    places = {a: (n - 1) * a for a in at}
    ranks = {r for h in places.values() for r in (math.floor(h), math.ceil(h))}
    held = {r: -inf if r < below else inf for r in ranks if r < below or r >= n - above}
    inner = sorted(r - below for r in ranks if r not in held)
    if inner:
        held |= {r + below: x for r, x in order_statistics(rows.filter((F.col("v") > -inf) & (F.col("v") < inf)), inner).items()}
    out = []
    for a, h in places.items():
        low, high = held[math.floor(h)], held[math.ceil(h)]
        out.append((float(a), low if low == high else low * (1 - (h - math.floor(h))) + high * (h - math.floor(h))))
    return df.sparkSession.createDataFrame(out, schema)
