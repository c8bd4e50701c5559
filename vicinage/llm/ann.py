"""Nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. Every vector is represented by its nearest pivots in order and posted, with the
place of each pivot, in the pivots' inverted files, block of vectors by block. A query reads the files of its own nearest
pivots; the footrule distance of the two orders ranks what it finds in a block, and the best are ranked again by cosine.
Blocks of vectors and of queries are written once; their Cartesian product reads them as often as needed and sends nothing through
a shuffle or the driver.

Cases: vectors that are null, of zero length or norm, or have null or non-finite components take no part; vectors of
different lengths have no cosine, so each length has an index of its own; equal vectors tie and the smaller id comes first; with fewer candidates
than asked for all are returned; an empty table gives an empty table; rows with a null id take no part; only the id and
vector columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import kept, shuffles_dropped

#: Size of the sample of pivots, pivots in a representation, and pivots whose files a query reads.
PIVOTS, LENGTH = 256, 48
#: Vectors and queries of a block, and candidates of each block that are ranked again for a query.
BLOCK, QUERY_BLOCK, RERANK = 8192, 512, 1280
#: Tasks at most for a side of the product; blocks of queries that a task takes where there are many; tasks to have where there are few.
MOST_TASKS, PARTS, FEW_TASKS = 20_000, 32, 64


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with v an array of doubles, for the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite).filter(F.exists("v", lambda x: x != 0))


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """At most n of the 4 * n vectors with the smallest hashes of their ids, no two equal, scaled to unit length."""
    # Only vectors under a hash that about 16 * n have go on: else each partition would send its own 4 * n to the driver.
    h, total = F.xxhash64("id"), vectors.count()
    drawn = lambda df: df.orderBy(h, "id").select("v").limit(4 * n).collect()
    most = (16 * n << 64) // max(1, total) - (1 << 63)
    rows = drawn(vectors.filter(h < F.lit(most))) if most < 1 << 63 else drawn(vectors)
    if len(rows) < min(4 * n, total):
        rows = drawn(vectors)
    rows = list(dict.fromkeys(tuple(r["v"]) for r in rows))[:n]
    return _unit(np.array(rows, np.float64)) if rows else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _in_range(m: np.ndarray) -> np.ndarray:
    """Vectors whose squares would vanish or overflow, scaled; others as they are."""
    with np.errstate(over="ignore"):
        n = (m * m).sum(1)
    odd = ~((n > 1e-280) & (n < 1e280))
    return np.where(odd[:, None], m / np.abs(m).max(1, keepdims=True), m)


def permutations(m: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each vector its nearest pivots in order, ties to the smaller number."""
    return np.argsort(-(_unit(m) @ pivots.T), 1, kind="stable")[:, :length].astype(np.int16)


def _blocks(vectors: DataFrame, pivots: np.ndarray, length: int, blocks: int, name: str, tasks: int) -> DataFrame:
    """Rows of packed blocks, written: ids, vectors and permutations of the vectors whose id hashes to the block. Vectors take four bytes a
    number where that loses nothing, permutations one a pivot where numbers of pivots fit."""
    width, kind = pivots.shape[1], _place_type(len(pivots))

    def run(batches):
        for batch in batches:
            ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ok = np.diff(v.offsets.to_numpy()) == width
            if ok.any():
                m = v.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                perm = permutations(m, pivots, length).astype(kind)
                with np.errstate(over="ignore"):
                    short = m.astype(np.float32)
                exact = (short == m).all(1)
                packed = [(short if e else m)[i].tobytes() for i, e in enumerate(exact.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(packed, pa.binary()), pa.array([x.tobytes() for x in perm], pa.binary())], ["id", "v", "perm"])

    posted = vectors.mapInArrow(run, "id long, v binary, perm binary").withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)))
    with shuffles_dropped(vectors.sparkSession):
        return kept(posted.repartition(tasks, name).groupBy(name).agg(F.sort_array(F.collect_list(F.struct("id", "v", "perm"))).alias(f"{name}_rows")))


def _place_type(pivots: int) -> type:
    return np.uint8 if pivots <= 256 else np.int16


def _unpacked(rows: list, width: int) -> np.ndarray:
    """Vectors of four or eight bytes a number."""
    if all(len(r) == 4 * width for r in rows):
        return np.frombuffer(b"".join(rows), np.float32).reshape(-1, width).astype(np.float64)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * width else np.float64).astype(np.float64) for r in rows])


def inverted_files(perm: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings ordered by pivot: where each pivot's file starts, the vectors in it, and the pivot's place in them."""
    n, length = perm.shape
    flat = perm.ravel()
    order = np.argsort(flat, kind="stable")
    return np.searchsorted(flat[order], np.arange(pivots + 1)), order // length, (order % length).astype(np.int32)


def footrule_gains(query: np.ndarray, starts: np.ndarray, vectors: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """How much nearer each vector is to the query's order than one that shares no pivot with it."""
    length, gain = len(query), np.zeros(n, np.int32)
    for place, pivot in enumerate(query.tolist()):
        a, b = starts[pivot], starts[pivot + 1]
        # A pivot that one order lacks counts as at place ``length`` there, for either of the two orders.
        gain[vectors[a:b]] += (length - place) + (length - places[a:b]) - np.abs(places[a:b] - place)
    return gain


def search_block(q_ids, q, q_perm, ids, m, perm, pivots: int, k: int, rerank: int):
    """For each query its best k in the block: (query, vector, score)."""
    starts, vectors, places = inverted_files(perm, pivots)
    m, q = _in_range(m), _in_range(q)
    norms, q_norms = np.sqrt((m * m).sum(1)), np.sqrt((q * q).sum(1))
    out = []
    for i in range(len(q_ids)):
        gain = footrule_gains(q_perm[i], starts, vectors, places, len(ids))
        gain[ids == q_ids[i]] = -1
        if len(ids) > rerank:  # ids are in order: equal distances go to the smaller id
            cut = np.partition(gain, len(gain) - rerank)[len(gain) - rerank]
            over = np.flatnonzero(gain > cut)
            some = np.sort(np.concatenate([over, np.flatnonzero(gain == cut)[: rerank - len(over)]]))
        else:
            some = np.arange(len(ids))
        some = some[gain[some] >= 0]
        score = (m[some] * q[i]).sum(1) / (norms[some] * q_norms[i])
        best = np.lexsort((ids[some], -score))[:k]
        out.append((np.full(len(best), q_ids[i]), ids[some][best], score[best]))
    return [np.concatenate(x) for x in zip(*out)]


def search(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, pivots: int = PIVOTS, length: int = LENGTH, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``df`` nearest to each row of ``queries`` by cosine, its own id left out."""
    rows, asked = usable(df, key, vector), usable(queries, key, vector)
    lengths = sorted(r["n"] for r in asked.select(F.size("v").alias("n")).distinct().collect())  # a column has few
    none = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search(*(x.filter(F.size("v") == n) for x in (rows, asked)), k, pivots, length, rerank) for n in lengths]
    return functools.reduce(DataFrame.unionAll, [x for x in found if x is not None], none)


def _search(rows: DataFrame, asked: DataFrame, k: int, pivots: int, length: int, rerank: int) -> DataFrame | None:
    """``search`` among vectors (id, v) of one length."""
    schema = "query_id long, vec_id long, score double"
    chosen = choose_pivots(rows, pivots)
    if not len(chosen):
        return None
    length = min(length, len(chosen))
    n, n_asked = rows.count(), asked.count()
    blocks, query_blocks = -(-n // BLOCK), max(1, -(-n_asked // QUERY_BLOCK))
    base = _blocks(rows, chosen, length, blocks, "block", min(blocks, MOST_TASKS))
    parts = min(query_blocks, max(-(-query_blocks // PARTS), -(-FEW_TASKS // blocks)), MOST_TASKS)
    against = _blocks(asked, chosen, length, query_blocks, "part", parts)
    width, n_pivots = chosen.shape[1], len(chosen)

    def matrices(column):
        rows = column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py())
        part = rows.flatten()
        return part[0].to_numpy(zero_copy_only=False), _unpacked(part[1].to_pylist(), width), np.frombuffer(b"".join(part[2].to_pylist()), _place_type(n_pivots)).reshape(-1, length)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                mine, theirs = matrices(batch.column(0).slice(i, 1)), matrices(batch.column(1).slice(i, 1))
                found = search_block(*mine, *theirs, n_pivots, k, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    # By hint: a join on a made-up key would be taken for as small as the queries, and broadcast with all its copies through the driver.
    # The product has a task for each pair of partitions, so these are as few as there are blocks.
    found = base.coalesce(min(blocks, MOST_TASKS)).join(against.coalesce(parts).hint("shuffle_replicate_nl")).select("part_rows", "block_rows").mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter("vec_id % 50 = 0"))
