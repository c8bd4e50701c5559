"""Statistics of states and places: co-location, co-association, autocorrelation, classification measures, meta-analysis.

Permutations are named by a number and a seed (see ``permutation``), so every engine and every partitioning draws the same one.

A cell without a community or a type has no state: it counts among its neighbours' neighbours and takes part in permutations, in
which its lack of a label moves like a label (within its type, or within the cells without a type), but it is no row or column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clipped, ratio, two_sided_p
from ..functions.shared import checkpointed, forget, shuffles_dropped, written
from .neighbours import nearest_lists
from .permutation import blocks_of, dealt_codes, edge_sums, held_chunks, label_codes, observed_codes, to_deal


def cell_state(se: Column, cell_type: Column) -> Column:
    """The state's name; null where either part is missing."""
    return F.concat(se, F.lit("_"), cell_type)


def se_of(state: Column) -> Column:
    return F.substring_index(state, "_", 1)


# --- classification --------------------------------------------------------------------------------------------------


def compute_metrics(cells: DataFrame, metric: str = "F1", se: str = "se", pred: str = "pred", sample: str | None = "sample", cell_type: str | None = None) -> DataFrame:
    """(a, b, value) for every true label a and predicted label b: recall is the share of a predicted as b, precision the share of
    b that is a, F1 and F2 combine them; mean over the samples in which it is defined, 0 where there are none."""
    if metric not in ("F1", "F2", "recall", "precision"):
        raise ValueError(f"unknown measure {metric}")
    name = lambda c: F.concat_ws("_", c, cell_type) if cell_type else F.col(c)
    rows = cells.select((F.col(sample) if sample else F.lit("")).alias("s"), name(se).alias("a"), name(pred).alias("b")).dropna()
    levels = rows.select(F.col("a").alias("v")).union(rows.select("b")).distinct()
    grid = rows.select("s").distinct().join(levels.select(F.col("v").alias("a"))).join(levels.select(F.col("v").alias("b")))
    n = grid.join(rows.groupBy("s", "a", "b").agg(F.count(F.lit(1)).alias("n")), ["s", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    recall = ratio(F.col("n"), F.sum("n").over(Window.partitionBy("s", "a")))
    precision = ratio(F.col("n"), F.sum("n").over(Window.partitionBy("s", "b")))
    both = n.withColumn("r", recall).withColumn("p", precision)
    if metric in ("recall", "precision"):
        value = F.col(metric[0])
    else:
        r, p, beta = F.coalesce("r", F.lit(0.0)), F.coalesce("p", F.lit(0.0)), 4 if metric == "F2" else 1
        value = ratio((1 + beta) * p * r, beta * p + r)
    return both.groupBy("a", "b").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("value"))


# --- co-association --------------------------------------------------------------------------------------------------


def _pair_correlations(frac: DataFrame) -> DataFrame:
    """(i, j, r): Pearson correlation of states over the samples in which both have a value; undefined without variance."""
    x, y = frac.select("sample", F.col("state").alias("i"), F.col("v").alias("x")), frac.select("sample", F.col("state").alias("j"), F.col("v").alias("y"))
    pairs = x.join(y, "sample")
    means = pairs.groupBy("i", "j").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = pairs.join(means.filter("n >= 2 and x0 < x1 and y0 < y1"), ["i", "j"]).groupBy("i", "j").agg(F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"))
    return sums.select("i", "j", clipped(ratio(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), -1.0, 1.0).alias("r"))


def coassociation(cells: DataFrame, sample: str = "sample", se: str = "se", cell_type: str = "cell_type", without: str = "NonSE") -> DataFrame:
    """(i, j, value): mean over four variants (with and without cells outside communities; absent states null or 0) of the correlation,
    over samples, of the states' shares of their cell type. 0 where no variant is defined."""
    rows = cells.select(F.col(sample).alias("sample"), F.col(se).alias("se"), F.col(cell_type).alias("ct")).dropna()
    states = rows.filter(F.col("se") != without).select(cell_state(F.col("se"), F.col("ct")).alias("state")).distinct()
    parts = []
    for keep in (True, False):
        some = rows if keep else rows.filter(F.col("se") != without)
        n = some.groupBy("sample", "ct", "se").agg(F.count(F.lit(1)).alias("n"))
        share = n.withColumn("v", F.col("n") / F.sum("n").over(Window.partitionBy("sample", "ct"))).filter(F.col("se") != without).select("sample", cell_state(F.col("se"), F.col("ct")).alias("state"), "v")
        filled = some.select("sample").distinct().join(states).join(share, ["sample", "state"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
        parts += [_pair_correlations(share), _pair_correlations(filled)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    mean = every.groupBy("i", "j").agg(F.avg("r").alias("r"))
    grid = states.select(F.col("state").alias("i")).join(states.select(F.col("state").alias("j")))
    return grid.join(mean, ["i", "j"], "left").select("i", "j", F.coalesce("r", F.lit(0.0)).alias("value"))


def within_index(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, se, value): mean of the entries between states of one community."""
    by = by or []
    rows = matrix.filter(se_of(F.col("i")) == se_of(F.col("j")))
    return rows.groupBy(*by, se_of(F.col("i")).alias("se")).agg(F.avg("value").alias("value"))


def masked_diagonal(matrix: DataFrame) -> DataFrame:
    """Without a diagonal that is all 1 or all missing; a mixed one is an error."""
    d = matrix.filter("i = j").agg(F.count_if(F.col("value") == 1).alias("ones"), F.count_if(F.col("value").isNull()).alias("none"), F.count(F.lit(1)).alias("n")).first()
    if d["n"] in (d["ones"], d["none"]):
        return matrix.withColumn("value", F.when(F.col("i") != F.col("j"), F.col("value")))
    if d["ones"] or d["none"]:
        raise ValueError("the diagonal is partly 1 or missing")
    return matrix


def permutation_chunks(nperm: int, labels: int, most: int = 200, cells: int = 1 << 22) -> list[tuple[int, int]]:
    """(first, number) of the permutations that go together: as many as keep a task's sums under so many cells."""
    size = max(1, min(most, cells // max(1, labels * labels)))
    return [(a, min(size, nperm - a)) for a in range(0, nperm, size)]


def _permuted(blocks, cells: DataFrame, label: str, nperm: int, seed: int, names: list, values) -> Iterator[DataFrame]:
    """``values`` of the sums over edges for some permutations within cell types at a time. Of what they are made from, only one such part
    is on disk; a permutation's name does not depend on the parts."""
    shared = to_deal(cells, "cell_id", label, ["cell_type"], names)
    for first, number in permutation_chunks(nperm, len(names) + 1):
        for before, many in held_chunks(shared[1], number):
            codes = dealt_codes(cells, "cell_id", label, ["cell_type"], many, seed + first, names, before, shared)
            with shuffles_dropped(cells.sparkSession):
                yield checkpointed(values(edge_sums(blocks, codes, "cell_id", names, many)))
            if shared[1]:
                forget(codes)


def null_z(observed: DataFrame, null: DataFrame, key: list[str], fallback: bool = False) -> DataFrame:
    """(key, value, zscore, pval) of observed values against permuted ones; a deviation of 0 becomes 1 (or the median deviation)."""
    stats = null.groupBy(*key).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    sd = F.when(F.coalesce("sd", F.lit(0.0)) > 0, F.col("sd"))
    if fallback:
        middle = stats.agg(F.median("sd").alias("middle"))
        stats = stats.join(F.broadcast(middle))
        sd = F.coalesce(sd, F.when(F.col("middle") > 0, F.col("middle")))
    z = ratio(F.col("value") - F.col("m"), F.coalesce(sd, F.lit(1.0)))
    return observed.join(stats, key, "left").select(*key, "value", F.coalesce(z, F.lit(0.0)).alias("zscore")).withColumn("pval", two_sided_p("zscore"))


def coassociation_null(matrix: DataFrame, nperm: int, seed: int = 1) -> DataFrame:
    """(perm, se, value): the within-community index with the matrix's columns permuted under labels that stay."""
    m = masked_diagonal(matrix)
    states = m.select(F.col("j").alias("state")).distinct()
    dealt = _permuted_states(states, nperm, seed)
    moved = m.join(dealt, m.j == dealt.label).select("perm", "i", F.col("state").alias("j"), "value")
    return within_index(moved, ["perm"])


def _permuted_states(states: DataFrame, nperm: int, seed: int) -> DataFrame:
    """(perm, state, label): the states dealt anew."""
    names = label_codes(states, "state")
    dealt = dealt_codes(states.withColumn("label", F.col("state")), "state", "label", [], nperm, seed, names)
    low, high = (F.conv(F.hex(F.expr(f"substring(codes, 2 * perm - {k}, 1)")), 16, 10).cast("int") for k in (1, 0))
    rows = dealt.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(nperm))))
    return rows.select(F.col("perm").cast("long").alias("perm"), "state", F.get(F.array(*[F.lit(x) for x in names]).cast("array<string>"), low + 256 * high).alias("label"))


def coassociation_test(matrix: DataFrame, nperm: int = 1000, seed: int = 1) -> DataFrame:
    """(se, value, zscore, pval): whether states of one community go together more than under permuted columns."""
    return null_z(within_index(masked_diagonal(matrix)), coassociation_null(matrix, nperm, seed), ["se"], fallback=True)


# --- co-location -----------------------------------------------------------------------------------------------------


def neighbour_lists(cells: DataFrame, radius: float = 50, k: int = 200) -> DataFrame:
    """(q, leaf, near): each cell's nearest cells within the radius, k with the cell itself, which is left out."""
    q = cells.select(F.col("cell_id").alias("q"), "x", "y")
    return nearest_lists(q, q.withColumnRenamed("q", "r"), max(k - 1, 1), radius, others=True).filter(F.lit(k > 1))


def neighbour_edges(cells: DataFrame, radius: float = 50, k: int = 200) -> DataFrame:
    """(q, r): the pairs of ``neighbour_lists``."""
    return neighbour_lists(cells, radius, k).select("q", F.explode("near").alias("x")).select("q", F.col("x.r").alias("r"))


def state_shares(sums: DataFrame) -> DataFrame:
    """(perm, i, j, value): mean share of state j among the neighbours of cells of state i, from sums of edge weights, which are one for
    each cell in all."""
    w = Window.partitionBy("perm", "i")
    return sums.filter("i is not null").withColumn("value", F.col("s") / F.sum("s").over(w)).filter("j is not null").select("perm", "i", "j", "value")


def _lists_with_enough(cells: DataFrame, radius: float, k: int, min_cells: int) -> DataFrame:
    q = cells.select(F.col("cell_id").alias("q"), "x", "y")
    lists = nearest_lists(q, q.withColumnRenamed("q", "r"), max(k - 1, 1), radius, others=True, slim=True)
    with shuffles_dropped(cells.sparkSession):
        return written(lists.filter(F.lit(k > 1) & (F.size("rs") >= max(min_cells, 1))))


def _observed_shares(blocks, rows: DataFrame, names: list) -> DataFrame:
    """(i, j, value) for every state i with cells that have enough neighbours and every state j."""
    found = checkpointed(state_shares(edge_sums(blocks, observed_codes(rows, "cell_id", "state", names), "cell_id", names, 1)).drop("perm"))
    grid = found.select("i").distinct().join(rows.select(F.col("state").alias("j")).filter("j is not null").distinct())
    return grid.join(found, ["i", "j"], "left").na.fill(0.0, ["value"])


def colocalization_matrix(cells: DataFrame, radius: float = 50, k: int = 200, min_cells: int = 10) -> DataFrame:
    """(i, j, value): mean share of state j among the neighbours of cells (cell_id, x, y, state) of state i with enough neighbours."""
    names = label_codes(cells, "state")
    return _observed_shares(blocks_of(_lists_with_enough(cells, radius, k, min_cells)), cells, names)


def colocalization(cells: DataFrame, radius: float = 50, k: int = 200, min_cells: int = 10, nperm: int = 1000, seed: int = 1) -> DataFrame:
    """(i, j, value, zscore, pval): co-location of states against labels permuted within cell types. Neighbours are found once;
    permutations go in chunks, of which only sums are kept."""
    rows = checkpointed(cells.select("cell_id", "x", "y", "cell_type", cell_state(F.col("se"), F.col("cell_type")).alias("state")))
    names = label_codes(rows, "state")
    blocks = blocks_of(_lists_with_enough(rows, radius, k, min_cells))
    observed = checkpointed(_observed_shares(blocks, rows, names))
    sums, counts = [], []
    for null in _permuted(blocks, rows, "state", nperm, seed, names, state_shares):
        sums.append(null.groupBy("i", "j").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss")))
        counts.append(null.groupBy("i").agg(F.countDistinct("perm").alias("n")))
    n = checkpointed(reduce(DataFrame.unionByName, counts).groupBy("i").agg(F.sum("n").alias("n")))
    if n.filter(F.col("n") < nperm).take(1) or n.count() < observed.select("i").distinct().count():
        raise ValueError("a permutation left a state without cells that have enough neighbours")
    total = reduce(DataFrame.unionByName, sums).groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = observed.join(total, ["i", "j"], "left").join(n, "i", "left").na.fill(0.0, ["s", "ss"])
    mean = F.col("s") / F.col("n")
    var = ratio(F.col("ss") - F.col("n") * mean * mean, F.col("n") - 1)
    sd = F.sqrt(F.when(var > 1e-18, var).otherwise(1.0))
    z = F.coalesce(ratio(F.col("value") - mean, sd), F.lit(0.0))
    return total.select("i", "j", "value", z.alias("zscore")).withColumn("pval", two_sided_p("zscore"))


def meta_analysis(results: DataFrame, cap: float = 5, min_samples: int = 1) -> DataFrame:
    """(i, j, zscore, pval): capped scores of samples (sample, i, j, zscore) combined; a state must be in enough samples."""
    per = results.select("sample", F.col("i").alias("state")).distinct().groupBy("state").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= min_samples).select("state")
    kept = results.join(per.withColumnRenamed("state", "i"), "i", "left_semi").join(per.withColumnRenamed("state", "j"), "j", "left_semi")
    z = clipped(F.col("zscore"), -cap, cap)
    n = F.count("zscore")
    out = kept.groupBy("i", "j").agg(F.when(n > 0, F.sum(z) / (F.sqrt(n) + 1e-7)).alias("zscore"))
    return out.withColumn("pval", two_sided_p("zscore"))


# --- autocorrelation -------------------------------------------------------------------------------------------------


def moran_lists(cells: DataFrame, k: int = 3) -> DataFrame:
    """(q, leaf, near): each cell's k nearest other cells."""
    q = cells.select(F.col("cell_id").alias("q"), "x", "y")
    return nearest_lists(q, q.withColumnRenamed("q", "r"), k, others=True).filter(F.size("near") > 0)


def moran_values(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(perm, se, value): Moran's I of each label's indicator, weights of a cell's neighbours summing to one, from sums of edge weights
    (perm, i, j, s) and sizes (se, m, n): cells of the label, and all. With share p of n cells the sums reduce to the weights between and
    into labelled cells."""
    into = sums.groupBy("perm", F.col("j").alias("se")).agg(F.sum("s").alias("w_in"), F.sum(F.when(F.col("i") == F.col("j"), F.col("s")).otherwise(0.0)).alias("w_both"))
    out_of = sums.groupBy("perm", F.col("i").alias("se")).agg(F.sum("s").alias("w_out"))
    every = sums.groupBy("perm").agg(F.sum("s").alias("w_all")).join(F.broadcast(sizes))
    both = every.join(into, ["perm", "se"], "left").join(out_of, ["perm", "se"], "left").na.fill(0.0, ["w_in", "w_both", "w_out"])
    p = F.col("m") / F.col("n")
    top = F.col("w_both") - p * (F.col("w_in") + F.col("w_out")) + p * p * F.col("w_all")
    return both.select("perm", "se", ratio(top, F.col("n") * p * (1 - p)).alias("value"))


def _label_sizes(cells: DataFrame) -> DataFrame:
    """(se, m, n): permutations leave a label's cells as many; n counts cells without a label too."""
    size = cells.filter("se is not null").groupBy("se").agg(F.count(F.lit(1)).alias("m"))
    return checkpointed(size.join(F.broadcast(cells.agg(F.count(F.lit(1)).alias("n")))))


def moran_index(cells: DataFrame, k: int = 3) -> DataFrame:
    """(se, value): Moran's I of each label over the k nearest cells of each cell."""
    names = label_codes(cells, "se")
    sums = edge_sums(blocks_of(checkpointed(moran_lists(cells, k))), observed_codes(cells, "cell_id", "se", names), "cell_id", names, 1)
    return moran_values(checkpointed(sums), _label_sizes(cells)).drop("perm")


def normalized_moran(cells: DataFrame, nperm: int = 1000, k: int = 3, seed: int = 1) -> DataFrame:
    """(se, value, zscore, pval): Moran's I against labels permuted within cell types."""
    names, sizes = label_codes(cells, "se"), _label_sizes(cells)
    blocks = blocks_of(checkpointed(moran_lists(cells, k)))
    value = lambda sums: moran_values(checkpointed(sums), sizes)
    parts = list(_permuted(blocks, cells, "se", nperm, seed, names, value))
    observed = checkpointed(value(edge_sums(blocks, observed_codes(cells, "cell_id", "se", names), "cell_id", names, 1)).drop("perm"))
    return null_z(observed, reduce(DataFrame.unionByName, parts), ["se"])


# --- mixtures --------------------------------------------------------------------------------------------------------


def pseudobulks(expr: DataFrame, cells: DataFrame, group: str = "se", n_mixtures: int = 100, draws: int = 1000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Mixtures of cells: shares (mixture, group, share) drawn from N(2, 1), negatives 0, with over two groups positive; and profiles
    (mixture, gene, value): means of about ``draws`` cells drawn with replacement by share, normalised and logged."""
    from .expression import normalize, unlog_if_logs

    spark = expr.sparkSession
    groups = cells.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("size"))
    unit = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    made = spark.range(1, 4 * n_mixtures + 1).select(F.col("id").alias("mixture")).join(F.broadcast(groups))
    normal = F.sqrt(-2 * F.log(unit("mixture", "group", F.lit("u")))) * F.cos(2 * 3.141592653589793 * unit("mixture", "group", F.lit("v")))
    made = made.withColumn("x", F.greatest(2 + normal, F.lit(0.0)))
    w = Window.partitionBy("mixture")
    made = made.withColumn("positive", F.count_if(F.col("x") > 0).over(w)).filter("positive > 2").withColumn("share", F.col("x") / F.sum("x").over(w))
    kept = made.select("mixture").distinct().orderBy("mixture").limit(n_mixtures)
    shares = made.join(kept, "mixture", "left_semi").select("mixture", "group", "size", "share")
    times = F.bround(F.col("share") * draws, 0).cast("int")
    picks = shares.withColumn("draw", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).filter(F.col("draw") <= times)
    picks = picks.withColumn("at", (F.floor(unit("mixture", "group", "draw") * F.col("size")) + 1).cast("int"))
    numbered = cells.filter(F.col(group).isNotNull()).select("cell_id", F.col(group).alias("group")).withColumn("at", F.row_number().over(Window.partitionBy("group").orderBy("cell_id")))
    uses = picks.join(numbered, ["group", "at"]).groupBy("mixture", "cell_id").agg(F.count(F.lit(1)).alias("times"))
    total = uses.groupBy("mixture").agg(F.sum("times").alias("total"))
    plain = unlog_if_logs(expr)
    mean = plain.join(uses, "cell_id").groupBy("mixture", "gene").agg(F.sum(F.col("value") * F.col("times")).alias("s")).join(F.broadcast(total), "mixture")
    profiles = normalize(mean.select(F.col("mixture").alias("cell_id"), "gene", (F.col("s") / F.col("total")).alias("value"))).withColumnRenamed("cell_id", "mixture")
    return shares.select("mixture", "group", "share"), profiles
