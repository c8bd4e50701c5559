"""Registered queries over the star-schema tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colours, views
from ..functions.scalars import stars
from ..functions.shared import checkpointed
from ..operators import clustering, edge_clusters, expression, factors, graph, ranking, spatial, statistics
from ..sources.tables import cells_of_customers, cells_of_events, embedding_views, expression_of_customers, predictions, table
from . import communities

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Adapters in SQL, as the first parts of a WITH clause.
_EV = """cells_ev AS (SELECT event_id AS cell_id, value * 4 AS x, CAST(user_id AS DOUBLE) * 4 AS y, event_type AS cell_type,
  'SE' || (1 + (event_id * 7) % 4) AS se, 'S' || (event_id % 4) AS sample FROM events)"""
_CU = """cu0 AS (SELECT c_custkey AS cell_id, CAST(c_custkey % 40 AS DOUBLE) * 12 AS x, CAST(c_custkey // 40 AS DOUBLE) * 12 AS y,
  c_mktsegment AS cell_type, 'S' || (c_nationkey % 4) AS sample FROM customer),
cells_cu AS (SELECT *, 'SE' || (1 + (CAST(floor(x / 120) AS BIGINT) + CAST(floor(y / 120) AS BIGINT)) % 3) AS se FROM cu0)"""
_EX = """expr_cu AS (SELECT o_custkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_NORM = _EX + """, norm AS (SELECT cell_id, gene, ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 10000) AS value FROM expr_cu)"""
_FULL = _CU + ", " + _EX + """, full_cu AS (SELECT c.cell_id, g.gene, coalesce(e.value, 0) AS value FROM cells_cu c CROSS JOIN (SELECT DISTINCT gene FROM expr_cu) g
  LEFT JOIN expr_cu e ON e.cell_id = c.cell_id AND e.gene = g.gene)"""


def _grid(cells: str, size: int, out: str) -> str:
    return f"""{out}_g AS (SELECT *, 'X' || CAST(round_even(x / {size}, 0) AS BIGINT) || '_Y' || CAST(round_even(y / {size}, 0) AS BIGINT) AS spot_id FROM {cells}),
{out} AS (SELECT spot_id, median(x) AS x, median(y) AS y, count(*) AS n_cells FROM {out}_g GROUP BY spot_id)"""


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("value",)})


# --- neighbourhoods --------------------------------------------------------------------------------------------------


@_query("se_abundance_by_sn", f"""WITH {_EV}, {_grid("cells_ev", 50, "spots")},
near AS (SELECT s.spot_id, s.x, s.y, c.se, row_number() OVER (PARTITION BY s.spot_id ORDER BY (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y), c.cell_id) AS k,
  (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) AS d2 FROM spots s JOIN cells_ev c ON c.x BETWEEN s.x - 50 AND s.x + 50 AND c.y BETWEEN s.y - 50 AND s.y + 50
  AND (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) <= 2500),
n AS (SELECT spot_id, x, y, se, count(*) AS n FROM near WHERE k <= 200 AND d2 < 2500 GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY spot_id) AS total FROM n)
SELECT spot_id, round(x, 6) AS x, round(y, 6) AS y, se, round(n / total, 6) AS fraction FROM t WHERE total >= 5""")
def _abundance(spark, sf_dir):
    cells = cells_of_events(spark, sf_dir)
    return _rounded(spatial.abundance(cells, spatial.grid_spots(cells, 50)), "x", "y", "fraction")


@_query("grid_spots", f"""WITH {_EV}, {_grid("cells_ev", 70, "spots")},
m AS (SELECT spot_id, cell_type, row_number() OVER (PARTITION BY spot_id ORDER BY count(*) DESC, cell_type) AS r FROM spots_g GROUP BY spot_id, cell_type)
SELECT spot_id, round(x, 6) AS x, round(y, 6) AS y, n_cells, cell_type FROM spots JOIN m USING (spot_id) WHERE r = 1""")
def _spots(spark, sf_dir):
    return _rounded(spatial.grid_spots(cells_of_events(spark, sf_dir), 70, others=["cell_type"]), "x", "y")


@_query("partition_tissue", f"""WITH {_EV}, r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells_ev)
SELECT cell_id, CAST(floor((x - x0) / ((x1 - x0) * 1.000001 / 3)) AS BIGINT) || '_' || CAST(floor((y - y0) / ((y1 - y0) * 1.000001 / 5)) AS BIGINT) AS region FROM cells_ev, r""")
def _partition(spark, sf_dir):
    return ranking.partition_tissue(cells_of_events(spark, sf_dir), 3, 5).select("cell_id", "region")


@_query("infer_ncells", f"""WITH {_EX}, t AS (SELECT cell_id, sum(value) AS total FROM expr_cu GROUP BY 1), s AS (SELECT avg(total) AS m, min(total) AS lo FROM t)
SELECT cell_id, total, CAST(greatest(1, round_even(4 / (m - lo) * total + 1 - 4 / (m - lo) * lo, 0)) AS BIGINT) AS n_cells FROM t, s""")
def _ncells(spark, sf_dir):
    totals = expression_of_customers(spark, sf_dir).groupBy("cell_id").agg(F.sum("value").alias("total"))
    return ranking.infer_ncells(totals, average=5).select("cell_id", "total", F.col("n_cells").cast("long").alias("n_cells"))


_MEMBERS = f"""{_grid("cells_cu", 70, "spots")},
big AS (SELECT cell_type FROM cells_cu GROUP BY 1 HAVING count(*) > 10),
near AS (SELECT s.spot_id, c.cell_type, c.cell_id, row_number() OVER (PARTITION BY s.spot_id, c.cell_type ORDER BY (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y), c.cell_id) AS k
  FROM spots s JOIN cells_cu c ON (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) <= 2500 WHERE c.cell_type IN (SELECT cell_type FROM big)),
mem AS (SELECT *, count(*) OVER (PARTITION BY spot_id, cell_type) AS n FROM near WHERE k <= 10),
ok AS (SELECT cell_type FROM mem GROUP BY 1 HAVING count(DISTINCT spot_id) >= 5)"""


@_query("spot_weights", f"WITH {_CU}, {_MEMBERS} SELECT cell_type, spot_id, cell_id, round(1 / n, 6) AS w FROM mem WHERE cell_type IN (SELECT cell_type FROM ok)")
def _spot_weights(spark, sf_dir):
    cells = cells_of_customers(spark, sf_dir)
    return _rounded(spatial.spot_weights(cells, spatial.grid_spots(cells, 70), 10, 50, by=["cell_type"]), "w")


@_query("metacells", f"""WITH {_CU}, {_EX}, {_MEMBERS}
SELECT spot_id, cell_type, gene, round(sum(value) / first(n), 6) AS value FROM mem JOIN expr_cu USING (cell_id) WHERE cell_type IN (SELECT cell_type FROM ok) GROUP BY 1, 2, 3""")
def _metacells(spark, sf_dir):
    cells = cells_of_customers(spark, sf_dir)
    return _rounded(spatial.metacells(expression_of_customers(spark, sf_dir), cells, spatial.grid_spots(cells, 70), 10, 50)).select("spot_id", "cell_type", "gene", "value")


@_query("annotate_cells", f"""WITH {_EV}, {_grid("cells_ev", 70, "spots")},
m AS (SELECT spot_id, se, row_number() OVER (PARTITION BY spot_id ORDER BY count(*) DESC, se) AS r FROM spots_g GROUP BY spot_id, se),
near AS (SELECT c.cell_id, m.se, row_number() OVER (PARTITION BY c.cell_id ORDER BY (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y), s.spot_id) AS k
  FROM cells_ev c JOIN spots s ON s.x BETWEEN c.x - 30 AND c.x + 30 AND s.y BETWEEN c.y - 30 AND c.y + 30 AND (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) <= 900 JOIN m ON m.spot_id = s.spot_id AND m.r = 1)
SELECT cell_id, se FROM near WHERE k = 1""")
def _annotate(spark, sf_dir):
    cells = cells_of_events(spark, sf_dir)
    return spatial.annotate_cells(cells, spatial.grid_spots(cells, 70, others=["se"]), 30).select("cell_id", "se")


def _weights_sql(more: str) -> str:
    return f"""WITH {_CU}, near AS (SELECT a.cell_id AS q, b.cell_id AS r, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM cells_cu a JOIN cells_cu b
  ON b.x BETWEEN a.x - 40 AND a.x + 40 AND b.y BETWEEN a.y - 40 AND a.y + 40), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, r) AS k FROM near WHERE d2 <= 1600)
SELECT q, r FROM k WHERE k <= 20 AND d2 < 1600 {more}"""


def _weights(include_self):
    def run(spark, sf_dir):
        at = cells_of_customers(spark, sf_dir).select(F.col("cell_id").alias("r"), "x", "y")
        return spatial.knn_weights(at, at.withColumnRenamed("r", "q"), 20, 40, include_self)

    return run


_query("knn_weights_self", _weights_sql(""))(_weights(True))
_query("knn_weights_noself", _weights_sql("AND q <> r AND d2 > 0"))(_weights(False))


@_query("smooth_abundance", f"""WITH {_CU}, {_grid("cells_cu", 50, "spots")},
v AS (SELECT spot_id, se, count(*) / sum(count(*)) OVER (PARTITION BY spot_id) AS fraction FROM spots_g GROUP BY spot_id, se),
near AS (SELECT a.spot_id AS q, b.spot_id AS r, row_number() OVER (PARTITION BY a.spot_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.spot_id) AS k FROM spots a, spots b)
SELECT q AS spot_id, se, round(sum(fraction) / 7, 6) AS fraction FROM near JOIN v ON v.spot_id = r WHERE k <= 7 GROUP BY 1, 2""")
def _smooth(spark, sf_dir):
    cells = cells_of_customers(spark, sf_dir)
    spots = spatial.grid_spots(cells, 50)
    n = cells.withColumn("r", spatial.grid_label(F.col("x"), F.col("y"), 50)).groupBy("r", "se").count()
    total = n.groupBy("r").agg(F.sum("count").alias("total"))
    values = n.join(total, "r").select("r", "se", (F.col("count") / F.col("total")).alias("fraction"))
    return _rounded(spatial.smooth(values, spots, "se", "fraction", 7), "fraction").withColumnRenamed("q", "spot_id")


@_query("aggregate_by_weights", f"""WITH {_CU}, near AS (SELECT a.cell_id AS q, b.cell_id AS r, b.se, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_id) AS k
  FROM cells_cu a JOIN cells_cu b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 900 AND b.x BETWEEN a.x - 30 AND a.x + 30), m AS (SELECT q, se, count(*) AS n FROM near WHERE k <= 12 GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY q) AS t FROM m) SELECT q, se, round(n / t, 6) AS share FROM t WHERE t >= 5""")
def _aggregate(spark, sf_dir):
    cells = cells_of_customers(spark, sf_dir)
    at = cells.select(F.col("cell_id").alias("r"), "x", "y")
    w = spatial.knn_weights(at, at.withColumnRenamed("r", "q"), 12, 30)
    return _rounded(spatial.aggregate_by_weights(cells.select(F.col("cell_id").alias("r"), "se", F.lit(1.0).alias("share")), w, "se", "share"), "share")


# --- expression ------------------------------------------------------------------------------------------------------


@_query("preprocess_filter", f"""WITH {_CU}, {_EX}, k AS (SELECT * FROM expr_cu WHERE gene IN (SELECT gene FROM expr_cu WHERE value > 0 GROUP BY 1 HAVING count(*) >= 120)),
n AS (SELECT cell_id, count(*) FILTER (value > 0) AS n_genes, sum(value) AS total FROM k GROUP BY 1)
SELECT c.cell_id, n_genes, total FROM cells_cu c JOIN n USING (cell_id) WHERE n_genes >= 18""")
def _preprocess(spark, sf_dir):
    kept, _ = expression.preprocess(expression_of_customers(spark, sf_dir), cells_of_customers(spark, sf_dir), 120, 18)
    return kept.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("n_genes"), F.sum("value").alias("total"))


@_query("normalize_log", f"WITH {_NORM} SELECT cell_id, gene, round(value, 6) AS value FROM norm")
def _normalize(spark, sf_dir):
    return _rounded(expression.normalize(expression_of_customers(spark, sf_dir))).select("cell_id", "gene", "value")


@_query("normalize_rc", f"WITH {_EX} SELECT cell_id, gene, round(value / sum(value) OVER (PARTITION BY cell_id) * 10000, 6) AS value FROM expr_cu")
def _normalize_rc(spark, sf_dir):
    return _rounded(expression.normalize(expression_of_customers(spark, sf_dir), method="RC")).select("cell_id", "gene", "value")


@_query("conditional_logs", f"""WITH {_EX}, r AS (SELECT max(value) AS top, least(min(value), 0) AS low FROM expr_cu)
SELECT cell_id, gene, round(CASE WHEN top > 50 THEN ln(1 + value) ELSE value END, 6) AS log1p_value, round(CASE WHEN low >= 0 AND top > 80 THEN log2(value + 1) ELSE value END, 6) AS log2_value,
  round(CASE WHEN top < 80 THEN pow(2, value) - 1 ELSE value END, 6) AS plain_value FROM expr_cu, r""")
def _conditional(spark, sf_dir):
    e = expression_of_customers(spark, sf_dir)
    name = lambda d, c: _rounded(d).withColumnRenamed("value", c)
    a, b, c = name(expression.log1p_if_counts(e), "log1p_value"), name(expression.log2_if_counts(e), "log2_value"), name(expression.unlog_if_logs(e), "plain_value")
    return a.join(b, ["cell_id", "gene"]).join(c, ["cell_id", "gene"])


@_query("scale_data", f"""WITH {_FULL}, s AS (SELECT gene, avg(value) AS m, stddev_samp(value) AS sd FROM full_cu GROUP BY 1)
SELECT cell_id, gene, round(CASE WHEN sd > 0 THEN least((value - m) / sd, 10) ELSE 0 END, 6) AS value FROM full_cu JOIN s USING (gene)""")
def _scale(spark, sf_dir):
    return _rounded(expression.scale(expression_of_customers(spark, sf_dir), cells_of_customers(spark, sf_dir)))


@_query("scale_uncentered", f"""WITH {_FULL}, s AS (SELECT gene, sqrt(sum(value * value) / (count(*) - 1)) AS sd FROM full_cu GROUP BY 1)
SELECT cell_id, gene, round(CASE WHEN sd > 0 THEN least(value / sd, 10) ELSE 0 END, 6) AS value FROM full_cu JOIN s USING (gene)""")
def _scale_uncentered(spark, sf_dir):
    return _rounded(expression.scale(expression_of_customers(spark, sf_dir), cells_of_customers(spark, sf_dir), center=False))


@_query("znorm_grouped", f"""WITH {_FULL}, w AS (SELECT cell_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY sample) AS w FROM cells_cu), k AS (SELECT CAST(count(DISTINCT sample) AS DOUBLE) AS k FROM cells_cu),
m AS (SELECT gene, sum(w * value) / first(k) AS m, first(k) AS k FROM full_cu JOIN w USING (cell_id), k GROUP BY 1),
v AS (SELECT gene, m.m, sum(w * (value - m.m) * (value - m.m)) / (first(m.k) - 1) AS v FROM full_cu JOIN w USING (cell_id) JOIN m USING (gene) GROUP BY 1, 2)
SELECT cell_id, gene, round((value - m) / sqrt(CASE WHEN v > 0 THEN v ELSE 1 END), 6) AS value FROM full_cu JOIN v USING (gene)""")
def _znorm(spark, sf_dir):
    return _rounded(expression.znorm(expression_of_customers(spark, sf_dir), cells_of_customers(spark, sf_dir), "sample"))


@_query("hvf_dispersion", f"""WITH {_CU}, {_NORM}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells_cu),
full_n AS (SELECT c.cell_id, g.gene, coalesce(exp(e.value) - 1, 0) AS v FROM cells_cu c CROSS JOIN (SELECT DISTINCT gene FROM norm) g LEFT JOIN norm e ON e.cell_id = c.cell_id AND e.gene = g.gene),
d AS (SELECT gene, ln(1 + avg(v)) AS mean, ln(var_samp(v) / avg(v)) AS dispersion FROM full_n GROUP BY 1)
SELECT gene, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, row_number() OVER (ORDER BY dispersion DESC, gene) AS place FROM d QUALIFY place <= 10""")
def _hvf(spark, sf_dir):
    norm = expression.normalize(expression_of_customers(spark, sf_dir))
    return _rounded(expression.variable_features(norm, cells_of_customers(spark, sf_dir), 10), "mean", "dispersion").withColumn("place", F.col("place").cast("long"))


@_query("average_expression", f"""WITH {_CU}, {_NORM}, n AS (SELECT se, count(*) AS n FROM cells_cu GROUP BY 1), s AS (SELECT gene, se, sum(exp(value) - 1) AS s FROM norm JOIN cells_cu USING (cell_id) GROUP BY 1, 2)
SELECT gene, se, round(coalesce(s, 0) / n, 6) AS value FROM n CROSS JOIN (SELECT DISTINCT gene FROM norm) g LEFT JOIN s USING (gene, se)""")
def _average(spark, sf_dir):
    norm = expression.normalize(expression_of_customers(spark, sf_dir))
    return _rounded(expression.average_expression(norm, cells_of_customers(spark, sf_dir), "se"))


@_query("marker_set_score", f"""WITH {_CU}, {_NORM}, n AS (SELECT se, count(*) AS n FROM cells_cu GROUP BY 1), s AS (SELECT gene, se, sum(exp(value) - 1) AS s FROM norm JOIN cells_cu USING (cell_id) GROUP BY 1, 2),
a AS (SELECT 'set' || substr(gene, 7, 1) AS gene_set, se, avg(log2(s / n + 1)) AS v FROM s JOIN n USING (se) WHERE se <> 'SE3' GROUP BY 1, 2)
SELECT gene_set, se, round(coalesce((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 0), 6) AS value FROM a WINDOW w AS (PARTITION BY gene_set)""")
def _markers(spark, sf_dir):
    norm = expression.normalize(expression_of_customers(spark, sf_dir))
    sets = norm.select(F.concat(F.lit("set"), F.substring("gene", 7, 1)).alias("gene_set"), "gene").distinct()
    return _rounded(expression.marker_scores(norm, cells_of_customers(spark, sf_dir), "se", sets, "SE3"))


@_query("compute_fcs", f"""WITH {_CU}, {_NORM}, n AS (SELECT cell_type, se, count(*) AS n FROM cells_cu GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER w AS all_n, count(*) OVER w AS k FROM n WINDOW w AS (PARTITION BY cell_type)),
s AS (SELECT cell_type, se, gene, sum(value) AS s FROM norm JOIN cells_cu USING (cell_id) GROUP BY 1, 2, 3),
f AS (SELECT cell_type, se, gene, n, all_n, coalesce(s, 0) AS s, sum(coalesce(s, 0)) OVER (PARTITION BY cell_type, gene) AS all_s FROM t CROSS JOIN (SELECT DISTINCT gene FROM norm) g LEFT JOIN s USING (cell_type, se, gene) WHERE all_n >= 10 AND k >= 2)
SELECT cell_type, se AS cluster, gene, round(s / n - (all_s - s) / (all_n - n), 6) AS value FROM f""")
def _fcs(spark, sf_dir):
    norm = expression.normalize(expression_of_customers(spark, sf_dir))
    return _rounded(expression.fold_changes(norm, cells_of_customers(spark, sf_dir)))


@_query("posneg", "SELECT c_custkey, s.sign, greatest(s.sign * (c_acctbal - 4500), 0) AS value FROM customer, (VALUES (1), (-1)) s(sign)")
def _posneg(spark, sf_dir):
    return expression.signed_parts(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") - 4500).alias("value")))


@_query("matrix_multiply", f"WITH {_EX} SELECT a.gene AS i, b.gene AS j, sum(a.value * b.value) AS value FROM expr_cu a JOIN expr_cu b USING (cell_id) GROUP BY 1, 2")
def _multiply(spark, sf_dir):
    e = expression_of_customers(spark, sf_dir)
    return graph.multiply(e.select(F.col("gene").alias("i"), F.col("cell_id").alias("k"), "value"), e.select(F.col("cell_id").alias("k"), F.col("gene").alias("j"), "value"))


# --- ranks, modes, bins ----------------------------------------------------------------------------------------------


@_query("avg_rank", f"WITH {_EX} SELECT cell_id, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS rank FROM expr_cu")
def _avg_rank(spark, sf_dir):
    return expression_of_customers(spark, sf_dir).select("cell_id", "gene", ranking.average_rank("value", ["gene"]).alias("rank"))


@_query("rank_sparse", f"""WITH {_EX}, n AS (SELECT count(DISTINCT cell_id) AS n FROM expr_cu)
SELECT cell_id AS src, gene AS dst, round((rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2) / n, 6) AS w FROM expr_cu, n WHERE value <> 0""")
def _rank_sparse(spark, sf_dir):
    edges = expression_of_customers(spark, sf_dir).select(F.col("cell_id").alias("src"), F.col("gene").alias("dst"), F.col("value").alias("w"))
    return _rounded(ranking.rank_sparse(edges), "w").select("src", "dst", "w")


@_query("most_frequent", "SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
def _mode(spark, sf_dir):
    return ranking.most_frequent(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@_query("value_counts", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1")
def _counts(spark, sf_dir):
    return ranking.counts(table(spark, sf_dir, "part"), "p_brand")


@_query("cut_equal_width", "SELECT c_custkey, CAST(greatest(least(ceil((c_acctbal - lo) / ((hi - lo) / 20)) - 1, 19), 0) AS INTEGER) AS bin FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def _cut(spark, sf_dir):
    return ranking.cut_equal_width(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 20).select("c_custkey", "bin")


# --- graphs ----------------------------------------------------------------------------------------------------------


_POINTS = """p AS (SELECT 'a' AS view, vec_id AS spot_id, list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE)) AS pc FROM embeddings UNION ALL SELECT 'b', vec_id, list_transform(embedding[33:64], lambda v: CAST(v AS DOUBLE)) FROM embeddings),
near AS (SELECT a.view, a.spot_id AS q, b.spot_id AS r, list_distance(a.pc, b.pc) AS d FROM p a JOIN p b USING (view)),
k AS (SELECT *, row_number() OVER (PARTITION BY view, q ORDER BY CASE WHEN q = r THEN 0 ELSE d END, r) AS k FROM near)"""


_SIM = """sim AS MATERIALIZED (SELECT view, r AS src, q AS dst, CASE WHEN q = r THEN 0.5 ELSE 1 / (d + 2) END AS w FROM k WHERE k <= 10)"""


@_query("knn_similarity", f"WITH {_POINTS}, {_SIM} SELECT view, src, dst, round(w, 6) AS w FROM sim")
def _similarity(spark, sf_dir):
    return _rounded(graph.similarity_graph(embedding_views(spark, sf_dir), 10), "w")


@_query("snn_graph", f"""WITH {_POINTS}, n AS (SELECT view, q, r FROM k WHERE k <= 10), s AS (SELECT view, a.q AS src, b.q AS dst, count(*) AS s FROM n a JOIN n b USING (view, r) GROUP BY 1, 2, 3)
SELECT view, src, dst, round(s / (20 - s), 6) AS w FROM s WHERE s / (20 - s) >= 1.0 / 15""")
def _snn(spark, sf_dir):
    return _rounded(graph.shared_neighbours(embedding_views(spark, sf_dir), 10), "w")


@_query("dominateset", f"""WITH {_POINTS}, {_SIM}, t AS (SELECT *, row_number() OVER (PARTITION BY view, src ORDER BY w DESC, dst DESC) AS r FROM sim WHERE w <> 0)
SELECT view, src, dst, round(w, 6) AS w FROM t WHERE r <= 5""")
def _dominate(spark, sf_dir):
    return _rounded(graph.dominate_set(graph.similarity_graph(embedding_views(spark, sf_dir), 10), 5), "w")


@_query("fillspots", f"""WITH {_POINTS}, n AS (SELECT 'L' || label AS view, vec_id AS src FROM embeddings)
SELECT DISTINCT v.view, s.src AS spot_id FROM (SELECT DISTINCT view FROM n) v, (SELECT src FROM n) s""")
def _fill(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("L"), "label").alias("view"), F.col("vec_id").alias("spot_id"), F.col("embedding").alias("pc"))
    return graph.fill_spots(graph.similarity_graph(points, 10))


def _norm_sql(of: str, out: str, nodes: str = "nodes") -> str:
    return f"""{out}_s AS MATERIALIZED (SELECT view, src, sum(w) AS s FROM {of} WHERE src <> dst GROUP BY 1, 2), {out}_n AS MATERIALIZED (SELECT e.view, e.src, e.dst, w / (2 * CASE WHEN s = 0 THEN 1 ELSE s END) AS w FROM {of} e JOIN {out}_s USING (view, src) WHERE e.src <> e.dst),
{out} AS MATERIALIZED (SELECT view, src, dst, sum(w) / 2 AS w FROM (SELECT * FROM {out}_n UNION ALL SELECT view, dst, src, w FROM {out}_n) GROUP BY 1, 2, 3 UNION ALL SELECT view, id, id, 0.5 FROM {nodes})"""


_NODES = "nodes AS (SELECT v.view, s.id FROM (SELECT DISTINCT view FROM sim) v, (SELECT src AS id FROM sim UNION SELECT dst FROM sim) s)"


@_query("snf_normalize", f"WITH {_POINTS}, {_SIM}, {_NODES}, {_norm_sql('sim', 'w1')} SELECT view, src, dst, round(w, 6) AS w FROM w1")
def _snf_normalize(spark, sf_dir):
    return _rounded(graph.normalized(checkpointed(graph.similarity_graph(embedding_views(spark, sf_dir), 10))), "w")


def _round_sql(of: str, out: str) -> str:
    return f"""{out}_y AS MATERIALIZED (SELECT p.view, p.src AS i, o.dst AS l, sum(p.w * o.w) AS y FROM pn p JOIN {of} o ON o.view <> p.view AND o.src = p.dst GROUP BY 1, 2, 3),
{out}_x AS MATERIALIZED (SELECT y.view, i AS src, q.src AS dst, sum(y * q.w) AS w FROM {out}_y y JOIN pn q ON q.view = y.view AND q.dst = l GROUP BY 1, 2, 3), {_norm_sql(f"{out}_x", out)}"""


_NEAR = f"""WITH {_POINTS}, {_SIM}, {_NODES}, {_norm_sql('sim', 'w1')},
dom AS MATERIALIZED (SELECT view, src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY view, src ORDER BY w DESC, dst DESC) AS r FROM w1 WHERE w <> 0) WHERE r <= 10), {_norm_sql('dom', 'pn')}"""


for _rounds, _name, _parts in ((1, "snf_one_round", _round_sql("w1", "w2")), (2, "snf_two_rounds", f"{_round_sql('w1', 'v2')}, {_round_sql('v2', 'w2')}")):

    @_query(_name, f"{_NEAR}, {_parts} SELECT src, dst, round(sum(w) / count(*) FILTER (w > 0), 6) AS w FROM w2 GROUP BY 1, 2 HAVING sum(w) <> 0")
    def _snf_rounds(spark, sf_dir, rounds=_rounds):
        return _rounded(graph.fuse(graph.similarity_graph(embedding_views(spark, sf_dir), 10), 10, rounds), "w")


def _columns(spark, sf_dir) -> DataFrame:
    """Profiles by market segment, sample and thirds of nations, as columns of a network."""
    cells = cells_of_customers(spark, sf_dir).select("cell_id", F.col("cell_type").alias("view"), "sample", F.concat_ws("..", "sample", "se").alias("col"))
    e = expression.normalize(checkpointed(expression_of_customers(spark, sf_dir))).join(cells, "cell_id")
    return e.groupBy("view", "sample", "col", "gene").agg(F.avg("value").alias("value"))


@_query("rank_correlation_network", f"""WITH {_CU}, {_NORM}, c AS (SELECT cell_type AS view, sample, sample || '..' || se AS col, gene, avg(value) AS v FROM norm JOIN cells_cu USING (cell_id) GROUP BY 1, 2, 3, 4),
d AS (SELECT view, sample, col, gene, v - avg(v) OVER (PARTITION BY view, col) AS d FROM c), n AS (SELECT view, col, sqrt(sum(d * d)) AS n FROM d GROUP BY 1, 2),
r AS (SELECT a.view, a.sample, a.col AS src, b.col AS dst, sum(a.d * b.d) AS xy FROM d a JOIN d b USING (view, gene) GROUP BY 1, 2, 3, 4),
s AS (SELECT r.view, sample, src, dst, round(xy / (n1.n * n2.n), 12) AS r FROM r JOIN n n1 ON n1.view = r.view AND n1.col = src JOIN n n2 ON n2.view = r.view AND n2.col = dst),
k AS (SELECT *, rank() OVER (PARTITION BY view, sample, dst ORDER BY r) + (count(*) OVER (PARTITION BY view, sample, dst, r) - 1) / 2 AS k FROM s),
w AS (SELECT view, src, dst, k / sum(k) OVER (PARTITION BY view, sample, dst) AS w FROM k)
SELECT view, src, dst, round(sum(w), 6) AS w FROM (SELECT * FROM w UNION ALL SELECT view, dst, src, w FROM w) GROUP BY 1, 2, 3""")
def _network(spark, sf_dir):
    return _rounded(communities.rank_network(_columns(spark, sf_dir)), "w")


# --- statistics ------------------------------------------------------------------------------------------------------


def _metric_sql(value: str) -> str:
    return f"""WITH v AS (SELECT source AS s, 'Q' || quality AS a, 'Q' || (1 - toxic) AS b FROM labels JOIN documents USING (doc_id)), l AS (SELECT a AS l FROM v UNION SELECT b FROM v),
n AS (SELECT s, a, b, count(v.cnt) AS n FROM (SELECT DISTINCT s FROM v) x CROSS JOIN (SELECT l AS a FROM l) y CROSS JOIN (SELECT l AS b FROM l) z LEFT JOIN (SELECT *, 1 AS cnt FROM v) v USING (s, a, b) GROUP BY 1, 2, 3),
m AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY s, a), 0) AS r, n / nullif(sum(n) OVER (PARTITION BY s, b), 0) AS p FROM n)
SELECT a, b, round(coalesce(avg({value}), 0), 6) AS value FROM m GROUP BY 1, 2"""


_R, _P = "coalesce(r, 0)", "coalesce(p, 0)"
for _name, _value in {"recall": "r", "precision": "p", "F1": f"2 * {_P} * {_R} / nullif({_P} + {_R}, 0)", "F2": f"5 * {_P} * {_R} / nullif(4 * {_P} + {_R}, 0)"}.items():
    _query(f"metrics_{_name.lower()}", _metric_sql(_value))(lambda spark, sf_dir, m=_name: _rounded(statistics.compute_metrics(predictions(spark, sf_dir), m)))


def _some_outside(cells: DataFrame) -> DataFrame:
    return cells.withColumn("se", F.when(F.col("cell_id") % 11 == 0, "NonSE").otherwise(F.col("se")))


_COASSOC = f"""WITH {_EV}, c AS (SELECT 'S' || (cell_id // 250) AS sample, cell_type AS ct, CASE WHEN cell_id % 11 = 0 THEN 'NonSE' ELSE se END AS se FROM cells_ev),
st AS (SELECT DISTINCT se || '_' || ct AS state FROM c WHERE se <> 'NonSE'),
n AS (SELECT k, sample, ct, se, count(*) AS n FROM c, (VALUES (0), (1)) v(k) WHERE k = 0 OR se <> 'NonSE' GROUP BY 1, 2, 3, 4),
f AS (SELECT k, sample, se || '_' || ct AS state, v, se FROM (SELECT *, n / sum(n) OVER (PARTITION BY k, sample, ct) AS v FROM n) WHERE se <> 'NonSE'),
z AS (SELECT k, 0 AS z, sample, state, v FROM f UNION ALL SELECT x.k, 1, x.sample, st.state, coalesce(f.v, 0) FROM (SELECT DISTINCT k, sample FROM n) x CROSS JOIN st LEFT JOIN f ON f.k = x.k AND f.sample = x.sample AND f.state = st.state),
m AS (SELECT a.k, a.z, a.state AS i, b.state AS j, avg(a.v) AS mx, avg(b.v) AS my FROM z a JOIN z b USING (k, z, sample) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND min(a.v) < max(a.v) AND min(b.v) < max(b.v)),
r AS (SELECT m.i, m.j, greatest(-1, least(1, sum((a.v - mx) * (b.v - my)) / sqrt(sum((a.v - mx) * (a.v - mx)) * sum((b.v - my) * (b.v - my))))) AS r
  FROM m JOIN z a ON a.k = m.k AND a.z = m.z AND a.state = m.i JOIN z b ON b.k = m.k AND b.z = m.z AND b.state = m.j AND b.sample = a.sample GROUP BY m.k, m.z, m.i, m.j),
mat AS (SELECT s.state AS i, t.state AS j, coalesce(avg(r.r), 0) AS value FROM st s CROSS JOIN st t LEFT JOIN r ON r.i = s.state AND r.j = t.state GROUP BY 1, 2)"""


def _coassociation_matrix(spark, sf_dir) -> DataFrame:
    cells = _some_outside(cells_of_events(spark, sf_dir)).withColumn("sample", F.concat(F.lit("S"), F.floor(F.col("cell_id") / 250)))
    return statistics.coassociation(cells)


@_query("coassociation", f"{_COASSOC} SELECT i, j, round(value, 6) AS value FROM mat")
def _coassociation(spark, sf_dir):
    return _rounded(_coassociation_matrix(spark, sf_dir))


@_query("coassociation_null", f"""{_COASSOC}, masked AS (SELECT i, j, CASE WHEN i <> j THEN value END AS value FROM mat), s AS (SELECT state, row_number() OVER (ORDER BY state) AS at FROM st),
d AS (SELECT p.perm, state, row_number() OVER (PARTITION BY p.perm ORDER BY md5('1|' || p.perm || '|' || state), state) AS at FROM st, range(1, 201) p(perm)),
mv AS (SELECT d.perm, m.i, d.state AS j, m.value FROM d JOIN s ON s.at = d.at JOIN masked m ON m.j = s.state)
SELECT perm, split_part(i, '_', 1) AS se, round(avg(value), 6) AS value FROM mv WHERE split_part(i, '_', 1) = split_part(j, '_', 1) GROUP BY 1, 2""")
def _coassociation_null(spark, sf_dir, nperm=200):
    return _rounded(statistics.coassociation_null(_coassociation_matrix(spark, sf_dir), nperm))


_COLOC = f"""{_EV}, c AS (SELECT cell_id, x, y, cell_type, se || '_' || cell_type AS state FROM cells_ev),
near AS (SELECT a.cell_id AS q, b.cell_id AS r, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), CASE WHEN a.cell_id = b.cell_id THEN 0 ELSE 1 END, b.cell_id) AS k
  FROM c a JOIN c b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 6400 AND b.x BETWEEN a.x - 80 AND a.x + 80),
e AS (SELECT q, r, count(*) OVER (PARTITION BY q) AS n FROM near WHERE k BETWEEN 2 AND 50), u AS (SELECT * FROM e WHERE n >= 5),
pl AS (SELECT cell_id, cell_type, state, row_number() OVER (PARTITION BY cell_type ORDER BY cell_id) AS k FROM c),
dr AS (SELECT p.perm, cell_id, cell_type, row_number() OVER (PARTITION BY p.perm, cell_type ORDER BY md5('1|' || p.perm || '|' || cell_id), cell_id) AS k FROM c, range(1, 21) p(perm)),
lab AS (SELECT 0 AS perm, cell_id, state FROM c UNION ALL SELECT dr.perm, dr.cell_id, pl.state FROM dr JOIN pl USING (cell_type, k)),
m AS (SELECT perm, state AS i, count(*) AS m FROM lab WHERE cell_id IN (SELECT q FROM u) GROUP BY 1, 2),
s AS (SELECT a.perm, a.state AS i, b.state AS j, sum(1 / n) AS s FROM u JOIN lab a ON a.cell_id = q JOIN lab b ON b.cell_id = r AND b.perm = a.perm GROUP BY 1, 2, 3),
mat AS (SELECT m.perm, m.i, t.state AS j, coalesce(s, 0) / m AS value FROM m CROSS JOIN (SELECT DISTINCT state FROM c) t LEFT JOIN s ON s.perm = m.perm AND s.i = m.i AND s.j = t.state)"""


@_query("colocalization_observed", f"WITH {_COLOC} SELECT i, j, round(value, 6) AS value FROM mat WHERE perm = 0")
def _colocalization(spark, sf_dir):
    cells = cells_of_events(spark, sf_dir).withColumn("state", statistics.cell_state(F.col("se"), F.col("cell_type")))
    return _rounded(statistics.colocalization_matrix(cells, 80, 50, 5))


@_query("colocalization_z", f"""WITH {_COLOC}, n AS (SELECT i, j, avg(value) AS m, stddev_samp(value) AS sd FROM mat WHERE perm > 0 GROUP BY 1, 2)
SELECT i, j, round(value, 6) AS value, round((value - m) / CASE WHEN sd > 1e-9 THEN sd ELSE 1 END, 4) AS zscore FROM mat JOIN n USING (i, j) WHERE perm = 0""")
def _colocalization_z(spark, sf_dir, nperm=20):
    out = statistics.colocalization(cells_of_events(spark, sf_dir), 80, 50, 5, nperm=nperm)
    return out.select("i", "j", F.round("value", 6).alias("value"), F.round("zscore", 4).alias("zscore"))


_MORAN = f"""{_CU}, near AS (SELECT a.cell_id AS q, b.cell_id AS r, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_id) AS k
  FROM cells_cu a JOIN cells_cu b ON a.cell_id <> b.cell_id AND b.x BETWEEN a.x - 60 AND a.x + 60 AND b.y BETWEEN a.y - 60 AND a.y + 60), e AS (SELECT q, r FROM near WHERE k <= 3),
pl AS (SELECT cell_type, se, row_number() OVER (PARTITION BY cell_type ORDER BY cell_id) AS k FROM cells_cu),
dr AS (SELECT p.perm, cell_id, cell_type, row_number() OVER (PARTITION BY p.perm, cell_type ORDER BY md5('1|' || p.perm || '|' || cell_id), cell_id) AS k FROM cells_cu, range(1, 201) p(perm)),
lab AS (SELECT 0 AS perm, cell_id, se FROM cells_cu UNION ALL SELECT perm, cell_id, se FROM dr JOIN pl USING (cell_type, k)),
n AS (SELECT count(*)::DOUBLE AS n FROM cells_cu), m AS (SELECT perm, se, count(*) / first(n) AS p FROM lab, n GROUP BY 1, 2),
z AS (SELECT l.perm, m.se, l.cell_id, CASE WHEN l.se = m.se THEN 1 ELSE 0 END - m.p AS z FROM lab l JOIN m USING (perm)),
t AS (SELECT a.perm, a.se, sum(a.z * b.z) / 3 AS t FROM e JOIN z a ON a.cell_id = q JOIN z b ON b.cell_id = r AND b.perm = a.perm AND b.se = a.se GROUP BY 1, 2),
i AS (SELECT perm, se, t / d AS value FROM t JOIN (SELECT perm, se, sum(z * z) AS d FROM z GROUP BY 1, 2) USING (perm, se))"""


@_query("moran_observed", f"WITH {_MORAN} SELECT se, round(value, 6) AS value FROM i WHERE perm = 0")
def _moran(spark, sf_dir):
    return _rounded(statistics.moran_index(cells_of_customers(spark, sf_dir), 3))


@_query("moran_z", f"""WITH {_MORAN}, s AS (SELECT se, avg(value) AS m, stddev_samp(value) AS sd FROM i WHERE perm > 0 GROUP BY 1)
SELECT se, round(value, 6) AS value, round((value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 5) AS zscore FROM i JOIN s USING (se) WHERE perm = 0""")
def _moran_z(spark, sf_dir):
    out = statistics.normalized_moran(cells_of_customers(spark, sf_dir), 200)
    return out.select("se", F.round("value", 6).alias("value"), F.round("zscore", 5).alias("zscore"))


@_query("coloc_meta_stouffer", """WITH r AS (SELECT o_orderpriority AS sample, 'SE' || (l_suppkey % 3) || '_' || l_returnflag AS i, 'SE' || (l_partkey % 3) || '_' || l_returnflag AS j, (avg(l_discount) - 0.05) * 4000 AS z
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
SELECT i, j, round(sum(greatest(-2, least(2, z))) / (sqrt(count(*)) + 1e-7), 6) AS zscore FROM r GROUP BY 1, 2""")
def _meta(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("sample"), F.concat(F.lit("SE"), F.col("l_suppkey") % 3, F.lit("_"), "l_returnflag").alias("i"), F.concat(F.lit("SE"), F.col("l_partkey") % 3, F.lit("_"), "l_returnflag").alias("j"))
    results = rows.agg(((F.avg("l_discount") - 0.05) * 4000).alias("zscore"))
    return _rounded(statistics.meta_analysis(results, 2), "zscore").drop("pval")


# --- models ----------------------------------------------------------------------------------------------------------


def _models(spark, sf_dir) -> DataFrame:
    e = expression_of_customers(spark, sf_dir)
    return e.groupBy(F.concat(F.lit("M"), F.col("cell_id") % 5).alias("model"), "gene", F.lit(1).alias("sign"), F.concat(F.lit("SE"), F.floor(F.col("cell_id") / 5) % 3).alias("se")).agg((F.avg("value") / 10).alias("w"))


_MODELS = f"""{_EX}, mo AS (SELECT 'M' || (cell_id % 5) AS model, gene, 1 AS sign, 'SE' || (cell_id // 5 % 3) AS se, avg(value) / 10 AS w FROM expr_cu GROUP BY 1, 2, 4),
de AS (SELECT *, w - nth_value(w, 2) OVER (PARTITION BY model, gene, sign ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS delta FROM mo)"""


@_query("delta_specificity", f"WITH {_MODELS} SELECT model, gene, sign, se, round(w, 6) AS w, round(delta, 6) AS delta FROM de")
def _delta(spark, sf_dir):
    return _rounded(factors.specificity(_models(spark, sf_dir), ["model", "gene", "sign"]), "w", "delta").select("model", "gene", "sign", "se", "w", "delta")


@_query("aggregate_recover_models", f"""WITH {_MODELS}, h AS (SELECT se, gene FROM de WHERE sign = 1 AND delta > 0.01 GROUP BY 1, 2 HAVING count(DISTINCT model) / (SELECT count(DISTINCT model) FROM mo) > 0.5)
SELECT gene, sign, se, round(avg(w), 6) AS w FROM mo WHERE gene IN (SELECT gene FROM h) GROUP BY 1, 2, 3""")
def _aggregate_models(spark, sf_dir):
    return _rounded(factors.aggregate_models(_models(spark, sf_dir)), "w")


@_query("plurality_vote", """WITH v AS (SELECT source AS sample, 'Q' || (1 - toxic) AS pred FROM labels JOIN documents USING (doc_id))
SELECT sample, pred AS cv_pred FROM (SELECT sample, pred, row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, pred) AS r FROM v GROUP BY 1, 2) WHERE r = 1""")
def _plurality(spark, sf_dir):
    return ranking.plurality(predictions(spark, sf_dir), ["sample"], "pred", "cv_pred")


# --- views -----------------------------------------------------------------------------------------------------------


@_query("heatmap_breaks", """SELECT 0.55::DOUBLE AS at, round(quantile_cont(c_acctbal, 0.55), 6) AS value FROM customer
UNION ALL SELECT 0.75::DOUBLE, round(quantile_cont(c_acctbal, 0.75), 6) FROM customer UNION ALL SELECT 0.9::DOUBLE, round(quantile_cont(c_acctbal, 0.9), 6) FROM customer""")
def _breaks(spark, sf_dir):
    return _rounded(views.breaks(table(spark, sf_dir, "customer"), "c_acctbal"))


def _lab_sql() -> str:
    """A ramp from blue over white to red at three quantiles, mixed in L*a*b*, for (key, v) of the table vals."""
    low, middle, high = (colours.lab(c) for c in colours.STOPS)
    mix = lambda k, n: f"CASE WHEN v <= q2 THEN {low[k]!r} * (1 - (v - q1) / (q2 - q1)) + {middle[k]!r} * ((v - q1) / (q2 - q1)) ELSE {middle[k]!r} * (1 - (v - q2) / (q3 - q2)) + {high[k]!r} * ((v - q2) / (q3 - q2)) END AS {n}"
    light = [" + ".join(f"{m!r} * {n} * {w / 100!r}" for m, n, w in zip(row, "xyz", colours.WHITE)) for row in colours.FROM_XYZ]
    part = lambda c: f"lpad(upper(to_hex(CAST(round_even(least(greatest(CASE WHEN {c} > 0.0031308 THEN 1.055 * pow(greatest({c}, 0), 1 / 2.4) - 0.055 ELSE 12.92 * {c} END, 0), 1) * 255, 0) AS BIGINT))), 2, '0')"
    back = lambda f: f"CASE WHEN pow({f}, 3) > 0.008856 THEN pow({f}, 3) ELSE ({f} - 16.0 / 116) / 7.787 END"
    return f"""st AS (SELECT quantile_cont(v, 0.1) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.9) AS q3 FROM vals),
cl AS (SELECT key, least(greatest(v, q1), q3) AS v, q1, q2, q3 FROM vals, st), mx AS (SELECT key, {mix(0, "l")}, {mix(1, "a")}, {mix(2, "b")} FROM cl),
ty AS (SELECT *, CASE WHEN l <= 8 THEN l / 903.3 ELSE pow((l + 16) / 116, 3) END AS y FROM mx),
fy AS (SELECT *, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16.0 / 116 END AS f FROM ty),
xz AS (SELECT key, y, {back("(f + a / 500)")} AS x, {back("(f - b / 200)")} AS z FROM fy),
li AS (SELECT key, {light[0]} AS r, {light[1]} AS g, {light[2]} AS bl FROM xz), ramp AS (SELECT key, '#' || {part("r")} || {part("g")} || {part("bl")} AS colour FROM li)"""


_LEVELS = "[" + ", ".join(f"'{c}'" for c in views.KELLY[1:]) + "]"


@_query("heatmap_annotation", f"""WITH vals AS (SELECT c_custkey AS key, CAST(c_acctbal AS DOUBLE) AS v FROM customer), {_lab_sql()},
lv AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS n FROM customer GROUP BY 1)
SELECT key, 'c_acctbal' AS column, colour FROM ramp UNION ALL SELECT c_custkey, 'c_mktsegment', ({_LEVELS})[n] FROM customer JOIN lv USING (c_mktsegment)""")
def _annotation(spark, sf_dir):
    return colours.annotation(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal", "c_mktsegment"])


@_query("significance_stars", """SELECT CASE WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS mark, count(*) AS n
FROM (SELECT l_discount * l_tax AS p FROM lineitem) GROUP BY 1""")
def _stars(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(stars(F.col("l_discount") * F.col("l_tax")).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


@_query("rectangle_islands", """WITH r AS (SELECT n_nationkey AS pos, n_regionkey AS label FROM nation), c AS (SELECT row_number() OVER (ORDER BY n_regionkey % 3, n_name) AS pos, n_regionkey AS label FROM nation),
i AS (SELECT 0 AS k, pos, label, pos - row_number() OVER (PARTITION BY label ORDER BY pos) AS g FROM r UNION ALL SELECT 1, pos, label, pos - row_number() OVER (PARTITION BY label ORDER BY pos) FROM c),
b AS (SELECT k, label, min(pos) AS a, max(pos) AS z FROM i GROUP BY k, label, g)
SELECT x.label, x.a AS row_from, x.z AS row_to, y.a AS col_from, y.z AS col_to FROM b x JOIN b y ON x.label = y.label AND x.k = 0 AND y.k = 1""")
def _rectangles(spark, sf_dir):
    from pyspark.sql.window import Window

    n = table(spark, sf_dir, "nation")
    cols = n.select(F.row_number().over(Window.orderBy(F.col("n_regionkey") % 3, "n_name")).cast("long").alias("pos"), F.col("n_regionkey").alias("label"))
    return views.rectangles(n.select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_regionkey").alias("label")), cols)


# --- without SQL: iterations, factorisations, random mixtures ---------------------------------------------------------


@_query("pseudobulks")
def _pseudobulks(spark, sf_dir):
    _, profiles = statistics.pseudobulks(expression_of_customers(spark, sf_dir), cells_of_customers(spark, sf_dir), n_mixtures=20)
    return profiles


@_query("run_pca")
def _pca(spark, sf_dir):
    values = expression.scale(checkpointed(expression_of_customers(spark, sf_dir)), cells_of_customers(spark, sf_dir)).withColumn("cell_type", F.lit("all"))
    return factors.embeddings(values, row="cell_id", n=10)


@_query("pc_list")
def _pc_list(spark, sf_dir):
    cells = cells_of_customers(spark, sf_dir)
    meta = spatial.metacells(expression.log1p_if_counts(expression_of_customers(spark, sf_dir)), cells, spatial.grid_spots(cells, 70), 10, 50)
    return factors.type_embeddings(meta)


@_query("snf_full")
def _snf(spark, sf_dir):
    return graph.fuse(graph.similarity_graph(embedding_views(spark, sf_dir), 20))


@_query("louvain_clusters")
def _louvain(spark, sf_dir):
    return clustering.find_clusters(graph.shared_neighbours(embedding_views(spark, sf_dir), 20))


@_query("edge_communities")
def _edge_communities(spark, sf_dir):
    return edge_clusters.find_clusters(graph.shared_neighbours(embedding_views(spark, sf_dir), 20), starts=2)


_SMALL = {"radius": 50, "n_features": 25, "min_types": 1, "npcs": 10, "min_cells": 3, "min_features": 5, "iterations": 5, "k": 10, "k_graph": 20}


@_query("spatial_communities")
def _communities(spark, sf_dir):
    finder = communities.CommunityFinder(checkpointed(expression_of_customers(spark, sf_dir)), cells_of_customers(spark, sf_dir), **_SMALL)
    return finder.run().se


def _trained(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, c = checkpointed(expression_of_customers(spark, sf_dir)), cells_of_customers(spark, sf_dir)
    return e, c, checkpointed(communities.train_models(e, c))


@_query("nmf_fit_w")
def _fit(spark, sf_dir):
    return _trained(spark, sf_dir)[2]


@_query("nmf_predict")
def _predict(spark, sf_dir):
    e, c, model = _trained(spark, sf_dir)
    return factors.predict_shares(e.join(c.select("cell_id", "cell_type"), "cell_id"), model, scaled=True)


@_query("recover_labels")
def _recover(spark, sf_dir):
    e, c, model = _trained(spark, sf_dir)
    return communities.recover(e, c, model)


@_query("deconvolute")
def _deconvolute(spark, sf_dir):
    e, c, model = _trained(spark, sf_dir)
    _, bulk = statistics.pseudobulks(e, c, n_mixtures=20)
    one = model.groupBy("gene", "sign", "se").agg(F.avg("w").alias("w"))
    return communities.deconvolute(bulk.withColumnRenamed("mixture", "cell_id"), one)


@_query("loocv_predict")
def _loocv(spark, sf_dir):
    return communities.cross_predicted(checkpointed(expression_of_customers(spark, sf_dir)), cells_of_customers(spark, sf_dir), min_cells=5)


@_query("integrate_samples")
def _integrate(spark, sf_dir):
    return communities.integrate(_columns(spark, sf_dir), min_features=3)


@_query("several_samples")
def _several(spark, sf_dir):
    e, c = checkpointed(expression_of_customers(spark, sf_dir)), cells_of_customers(spark, sf_dir)
    options = communities.Options(**{**_SMALL, "min_types": 1})
    clusters, cells = communities.several_samples(e.join(c.select("cell_id", "sample"), "cell_id"), c, [2, 3], options, runs=5, n_features=25, min_features=3, sub_resolution=5)
    return cells.select("sample", "cell_id", "init_se", "se")


@_query("nmf_consensus")
def _consensus(spark, sf_dir):
    net = communities.integrate(_columns(spark, sf_dir), min_features=3)
    labels, _, _ = factors.consensus_clusters(net.select(F.col("src").alias("row"), F.col("dst").alias("node"), F.col("w").alias("value")), [2, 3])
    return labels


@_query("heatmap_order")
def _heatmap_order(spark, sf_dir):
    """Brands in three slices, by the mean quantity that customers of each nation buy."""
    home = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("col"))
    bought = expression_of_customers(spark, sf_dir).join(home, "cell_id").groupBy(F.col("gene").alias("row"), "col").agg(F.avg("value").alias("value"))
    return views.heatmap_order(bought, split=3)


@_query("colocalization_test")
def _colocalization_test(spark, sf_dir):
    return statistics.colocalization(cells_of_events(spark, sf_dir), 80, 50, 5, nperm=200)


@_query("coassociation_test")
def _coassociation_test(spark, sf_dir):
    return statistics.coassociation_test(_coassociation_matrix(spark, sf_dir))
