"""Operators on expression tables (cell_id, gene, value), in which an absent row is a zero.

Whatever divides by a number of cells takes that number from the cells, not from stored rows. A sample or cell type may be
part of any key through ``by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import log2p1, ratio


def preprocess(expr: DataFrame, cells: DataFrame, min_cells: int = 3, min_features: int = 5) -> tuple[DataFrame, DataFrame]:
    """Genes expressed in enough cells, then cells with enough of those genes; returns both tables."""
    genes = expr.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n")).filter(F.col("n") >= min_cells).select("gene")
    kept = expr.join(F.broadcast(genes), "gene", "left_semi")
    n = kept.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("n"))
    good = cells.join(n, "cell_id", "left").filter(F.coalesce("n", F.lit(0)) >= min_features).drop("n")
    return kept.join(good.select("cell_id"), "cell_id", "left_semi"), good


def normalize(expr: DataFrame, scale_factor: float = 1e4, method: str = "LogNormalize") -> DataFrame:
    """Values by their cell's total, times the factor; with LogNormalize the logarithm of one more. A total of 0 leaves a cell as it is."""
    if method not in ("LogNormalize", "RC"):
        raise ValueError(f"normalisation {method} is not supported")
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    scaled = F.col("value") / F.col("total") * scale_factor
    out = F.log1p(scaled) if method == "LogNormalize" else scaled
    return expr.withColumn("total", total).withColumn("value", F.when(F.col("total") == 0, F.col("value")).otherwise(out)).drop("total")


def _decided(expr: DataFrame, test: Column, then: Column) -> DataFrame:
    seen = expr.agg(F.max("value").alias("top"), F.least(F.min("value"), F.lit(0.0)).alias("low"))
    return expr.join(F.broadcast(seen)).withColumn("value", F.when(test, then).otherwise(F.col("value"))).drop("top", "low")


def log1p_if_counts(expr: DataFrame) -> DataFrame:
    """log(x + 1) of all values if any is over 50."""
    return _decided(expr, F.col("top") > 50, F.log1p("value"))


def log2_if_counts(expr: DataFrame) -> DataFrame:
    """log2(x + 1) of all values if none is negative and any is over 80."""
    return _decided(expr, (F.col("low") >= 0) & (F.col("top") > 80), log2p1(F.col("value")))


def unlog_if_logs(expr: DataFrame) -> DataFrame:
    """2^x - 1 of all values if all are under 80."""
    return _decided(expr, F.col("top") < 80, F.pow(F.lit(2.0), "value") - 1)


def zero_filled(expr: DataFrame, cells: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """A row for every gene and cell: genes (default: all with a row) are few, so their list goes to every task."""
    genes = expr.select("gene").distinct() if genes is None else genes.select("gene").distinct()
    known = expr.join(F.broadcast(genes), "gene", "left_semi")
    held = known.groupBy("cell_id").agg(F.collect_list(F.struct("gene", F.coalesce("value", F.lit(0.0)).alias("value"))).alias("held"))
    # A cell's stored values come to the cell at once, its zeros are made beside them: the grid of cells and genes is never shuffled.
    every = genes.agg(F.collect_list(F.struct("gene")).alias("every"))
    both = cells.select("cell_id").join(held, "cell_id", "left").join(F.broadcast(every))
    have = F.coalesce("held", F.array().cast(held.schema["held"].dataType))
    absent = F.transform(F.array_except(F.col("every.gene"), F.col("have.gene")), lambda g: F.struct(g.alias("gene"), F.lit(0.0).alias("value")))
    cell = both.withColumn("have", have).select("cell_id", F.explode(F.concat("have", absent)).alias("v"))
    return cell.select("cell_id", F.col("v.gene").alias("gene"), F.col("v.value").alias("value"))


def moments(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """(gene, mean, sd, n) over all cells; the sum of squares is centred first, absent zeros included."""
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    mean = expr.groupBy("gene").agg(F.sum("value").alias("s")).join(F.broadcast(n)).withColumn("mean", F.col("s") / F.col("n"))
    centred = expr.join(F.broadcast(mean), "gene").groupBy("gene", "mean", "n").agg(F.sum((F.col("value") - F.col("mean")) ** 2).alias("ss"), F.count(F.lit(1)).alias("stored"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    ss = F.col("ss") + (F.col("n") - F.col("stored")) * F.col("mean") ** 2
    flat = (F.col("lo") == F.col("hi")) & ((F.col("stored") == F.col("n")) | (F.col("hi") == 0))
    return centred.select("gene", "mean", "n", F.when(flat, 0.0).otherwise(F.sqrt(ratio(ss, F.col("n") - 1))).alias("sd"))


def scale(expr: DataFrame, cells: DataFrame, center: bool = True, do_scale: bool = True, most: float = 10) -> DataFrame:
    """Each gene less its mean, over its standard deviation (over the root of its mean square where it isn't centred), at most
    ``most``; a constant gene becomes 0. A row for every gene and cell."""
    full = zero_filled(expr, cells)
    if center:
        by = moments(expr, cells).select("gene", "mean", F.col("sd").alias("by"))
    else:
        n = cells.agg(F.count(F.lit(1)).alias("n"))
        by = expr.groupBy("gene").agg(F.sum(F.col("value") ** 2).alias("ss")).join(F.broadcast(n)).select("gene", F.lit(0.0).alias("mean"), F.sqrt(ratio(F.col("ss"), F.col("n") - 1)).alias("by"))
    z = F.col("value") - F.col("mean")
    z = ratio(z, F.col("by")) if do_scale else z
    return full.join(F.broadcast(by), "gene").select("cell_id", "gene", F.least(F.coalesce(z, F.lit(0.0)), F.lit(float(most))).alias("value"))


def znorm(expr: DataFrame, cells: DataFrame, group: str | None = None) -> DataFrame:
    """Weighted z-scores in which every group counts alike; without groups, scaled values. With one group the variance is
    undefined, and centred values stay."""
    if group is None:
        return scale(expr, cells)
    w = cells.select("cell_id", F.col(group).alias("g")).withColumn("w", 1 / F.count(F.lit(1)).over(Window.partitionBy("g")))
    sums = w.agg(F.countDistinct("g").cast("double").alias("sw"))
    full = zero_filled(expr, cells).join(w.select("cell_id", "w"), "cell_id")
    mean = full.groupBy("gene").agg(F.sum(F.col("w") * F.col("value")).alias("s")).join(F.broadcast(sums)).select("gene", "sw", (F.col("s") / F.col("sw")).alias("mean"))
    both = full.join(F.broadcast(mean), "gene")
    var = both.groupBy("gene", "mean").agg(ratio(F.sum(F.col("w") * (F.col("value") - F.col("mean")) ** 2), F.first("sw") - 1).alias("var"))
    sd = F.sqrt(F.when(F.coalesce("var", F.lit(0.0)) > 0, F.col("var")).otherwise(1.0))
    return full.join(F.broadcast(var), "gene").select("cell_id", "gene", ((F.col("value") - F.col("mean")) / sd).alias("value"))


def dispersion(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """(gene, mean, dispersion) on the scale of counts: log of the mean plus one, and log of variance over mean."""
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    first = expr.groupBy("gene").agg(F.sum(F.expm1("value")).alias("s")).join(F.broadcast(n)).withColumn("m", F.col("s") / F.col("n"))
    second = expr.join(F.broadcast(first), "gene").groupBy("gene", "m", "n").agg(F.sum((F.expm1("value") - F.col("m")) ** 2).alias("ss"), F.count(F.lit(1)).alias("stored"))
    var = ratio(F.col("ss") + (F.col("n") - F.col("stored")) * F.col("m") ** 2, F.col("n") - 1)
    return second.select("gene", F.log1p("m").alias("mean"), F.coalesce(F.log(ratio(var, F.col("m"))), F.lit(0.0)).alias("dispersion"))


def variable_features(expr: DataFrame, cells: DataFrame, n: int = 2000) -> DataFrame:
    """The genes of largest dispersion with their ``place``; genes without a mean go, ties by name."""
    ranked = dispersion(expr, cells).filter(F.col("mean") != 0)
    return ranked.orderBy(F.desc("dispersion"), "gene").limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc("dispersion"), "gene")))


def average_expression(expr: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """(gene, group, value): mean of exp(x) - 1 over the cells of each group."""
    n = cells.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    genes = expr.select("gene").distinct()
    sums = expr.join(cells.select("cell_id", group), "cell_id").groupBy("gene", group).agg(F.sum(F.expm1("value")).alias("s"))
    return genes.join(F.broadcast(n)).join(sums, ["gene", group], "left").select("gene", group, (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("value"))


def marker_scores(expr: DataFrame, cells: DataFrame, group: str, sets: DataFrame, without: str = "NonSE") -> DataFrame:
    """(gene_set, group, value): mean log2 average expression of each set's genes by group, then scaled over the groups.
    ``sets``: (gene_set, gene). A set without any gene has no value."""
    mean = average_expression(expr, cells, group)
    some = mean.groupBy("gene").agg(F.sum("value").alias("s")).filter("s <> 0").select("gene")
    logs = mean.join(some, "gene", "left_semi").filter(F.col(group) != without).withColumn("value", log2p1(F.col("value")))
    per = sets.join(logs, "gene").groupBy("gene_set", group).agg(F.avg("value").alias("value"))
    w = Window.partitionBy("gene_set")
    z = ratio(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))
    groups = cells.filter(F.col(group) != without).select(group).distinct()
    scaled = per.withColumn("value", F.least(F.coalesce(z, F.lit(0.0)), F.lit(10.0)))
    return sets.select("gene_set").distinct().join(F.broadcast(groups)).join(scaled, ["gene_set", group], "left")


def fold_changes(expr: DataFrame, cells: DataFrame, cluster: str = "se", min_cells: int = 10) -> DataFrame:
    """(cell_type, cluster, gene, value): mean within a cluster less the mean of the other cells of the same type, for types with
    enough cells and two clusters or more."""
    c = cells.filter(F.col(cluster).isNotNull()).select("cell_id", "cell_type", F.col(cluster).alias("cluster"))
    sizes = c.groupBy("cell_type", "cluster").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cell_type")
    sizes = sizes.withColumn("all_n", F.sum("n").over(w)).withColumn("k", F.count(F.lit(1)).over(w)).filter((F.col("all_n") >= min_cells) & (F.col("k") >= 2)).drop("k")
    sums = expr.join(c, "cell_id").groupBy("cell_type", "cluster", "gene").agg(F.sum("value").alias("s"))
    genes = sums.select("gene").distinct()
    full = F.broadcast(sizes).join(genes).join(sums, ["cell_type", "cluster", "gene"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    full = full.withColumn("all_s", F.sum("s").over(Window.partitionBy("cell_type", "gene")))
    value = F.coalesce(F.col("s") / F.col("n") - ratio(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")), F.lit(0.0))
    return full.select("cell_type", "cluster", "gene", value.alias("value"))


def signed_parts(values: DataFrame, value: str = "value") -> DataFrame:
    """Each value as two non-negative ones: sign 1 what is over zero, sign -1 what is under."""
    rest = [c for c in values.columns if c != value]
    stack = F.stack(F.lit(2), F.lit(1), F.greatest(F.col(value), F.lit(0.0)), F.lit(-1), F.greatest(-F.col(value), F.lit(0.0)))
    return values.select(*rest, stack.alias("sign", value))
