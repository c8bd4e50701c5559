"""Tables ready for plotting: rectangles, breaks, colours. Nothing here draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import trees
from ..operators.selection import quantiles

#: The 22 colours of maximum contrast published by K. Kelly (1965).
KELLY = ("#F2F3F4", "#222222", "#F3C300", "#875692", "#F38400", "#A1CAF1", "#BE0032", "#C2B280", "#848482", "#008856", "#E68FAC", "#0067A5", "#F99379", "#604E97", "#F6A600", "#B3446C", "#DCD300", "#882D17", "#8DB600", "#654522", "#E25822", "#2B3D26")


def label_runs(rows: DataFrame, pos: str = "pos", label: str = "label") -> DataFrame:
    """(label, first, last): runs of equal labels in the order of positions."""
    order = Window.orderBy(pos)
    new = (~F.col("label").eqNullSafe(F.lag("label").over(order))).cast("int")
    runs = rows.select(F.col(pos).alias("pos"), F.col(label).alias("label")).withColumn("run", F.sum(new).over(order))
    return runs.groupBy("run", "label").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("run")


def rectangles(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(label, row_from, row_to, col_from, col_to): blocks of a heatmap where the labels of rows and columns are equal."""
    a = label_runs(rows).select("label", F.col("first").alias("row_from"), F.col("last").alias("row_to"))
    return a.join(label_runs(cols).select("label", F.col("first").alias("col_from"), F.col("last").alias("col_to")), "label")


def breaks(df: DataFrame, value: str, at: tuple[float, ...] = (0.55, 0.75, 0.9)) -> DataFrame:
    """(at, value): exact interpolated quantiles."""
    return quantiles(df, value, at)


def spatial_layers(cells: DataFrame, by: str, highlight: list[str] | None = None, background: int = 2000, seed: int = 1) -> DataFrame:
    """(x, y, group, layer): highlighted cells in front; of the others as many as asked for, chosen by hash."""
    front = F.col(by).isin(highlight) if highlight else F.col(by).isNotNull()
    rows = cells.select("cell_id", "x", "y", F.col(by).alias("group"), F.when(front, "front").otherwise("background").alias("layer"))
    back = rows.filter("layer = 'background'").orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id").limit(background)
    return rows.filter("layer = 'front'").unionByName(back).drop("cell_id")


def heatmap_cells(values: DataFrame, low: float, high: float) -> DataFrame:
    """(row, col, value) with values within the breaks and ``shade`` from 0 to 1."""
    v = F.greatest(F.least("value", F.lit(high)), F.lit(low))
    return values.select("row", "col", v.alias("value"), ((v - low) / (high - low)).alias("shade"))


def heatmap_order(values: DataFrame, method: str = "complete", split: int | DataFrame | None = None) -> DataFrame:
    """(row, slice, place): rows of a heatmap (row, col, value) in the order of the leaves of trees over their euclidean distances; columns are ordered
    with ``row`` and ``col`` exchanged.

    ``split``: a number of groups that the tree of all rows is cut into, named from 1 by their first rows, or labels (row, slice), a null label being one
    of its own, rows without a label left out. Each slice has a tree of its own; slices go by label, null first, and places, from 1, run through all of them.
    Absent, null and NaN values are 0, of repeated ones the mean counts. A slice is one task's, with 8 n * n bytes: rows that a plot can show.
    """
    rows = values.filter("row is not null and col is not null").select("row", "col", F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(None)), F.lit(0.0)).alias("value"))
    rows = rows.groupBy("row", "col").agg(F.avg("value").alias("value"))
    labels, groups = (split.select("row", "slice").dropDuplicates(["row"]), 1) if isinstance(split, DataFrame) else (None, split or 1)
    kind = values.schema["row"].dataType.simpleString()
    name = labels.schema["slice"].dataType.simpleString() if labels is not None else "int"
    named = labels is not None
    if groups < 1:
        raise ValueError("rows are split into one group at least")
    rows = rows.join(labels, "row") if labels is not None else rows.withColumn("slice", F.lit(1))

    def run(pdf):
        wide = pdf.pivot_table(index="row", columns="col", values="value", fill_value=0.0).sort_index()
        x, names, parts = wide.to_numpy(float), wide.index.to_numpy(), []

        def tree(x):
            d = np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in x])
            return trees.linkage(d, method)

        label = trees.cut(tree(x), len(x), groups) if groups > 1 else np.ones(len(x), int)
        for g in range(1, int(label.max(initial=0)) + 1):
            at = np.flatnonzero(label == g)
            order = at[trees.leaf_order(tree(x[at]), len(at))]
            parts.append(pd.DataFrame({"row": names[order], "slice": pdf["slice"].iloc[0] if named else g, "at": np.arange(1, len(at) + 1)}))
        return pd.concat(parts)

    placed = rows.groupBy("slice").applyInPandas(run, f"row {kind}, slice {name}, at int")
    sizes = placed.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))  # a row for each slice
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).withColumnRenamed("slice", "s")
    found = placed.join(before, F.col("slice").eqNullSafe(F.col("s")))
    return found.select("row", "slice", (F.col("at") + F.coalesce("before", F.lit(0))).cast("int").alias("place"))


# --- colours ---------------------------------------------------------------------------------------------------------


def rgb(colour: str) -> tuple[int, int, int]:
    return tuple(int(colour[i : i + 2], 16) for i in (1, 3, 5))


def hex_colour(parts) -> str:
    return "#" + "".join(f"{max(0, min(255, int(p))):02X}" for p in parts)


def ramp(colours: list[str], n: int) -> list[str]:
    """n colours along straight lines through the given ones."""
    stops, out = [rgb(c) for c in colours], []
    for k in range(n):
        at = k * (len(stops) - 1) / max(1, n - 1)
        i = min(int(at), len(stops) - 2) if len(stops) > 1 else 0
        a, b = stops[i], stops[min(i + 1, len(stops) - 1)]
        out.append(hex_colour(x + (y - x) * (at - i) + 0.5 for x, y in zip(a, b)))
    return out


def categorical(names: list[str], exclude: tuple[str, ...] = ()) -> dict[str, str]:
    """A colour for each name in sorted order; beyond the palette, shades between its colours."""
    names = sorted(names)
    free = [c for c in KELLY[1:] if c not in exclude]
    free = free if len(names) <= len(free) else ramp(free, len(names))
    return dict(zip(names, free))
