"""Exact nearest neighbours in many dimensions, with cells of pivots that most queries need not enter.

Pivots (centres of a bounded sample) divide a view into cells; a cell of many points is divided into rings by the distance to its pivot, and a
ring into parts by hash, so that no block holds much more than BLOCK points, copies of one point included. Each query first meets its own block,
whose k-th distance bounds what it still looks for. By the triangle inequality a ring can hold such a point only if the query's
distance to the ring's pivot comes as near to the ring's distances as that bound, so the query goes on to the blocks of these rings alone.
Points in groups meet few blocks. Points without any nearness to exploit (random directions in some tens of dimensions) meet nearly all
of them: then the work is that of all pairs of blocks. Pairs of blocks are a Cartesian product of two written tables, which reads them as
often as it must but writes nothing; a task goes over the references of one part of HELD bytes and keeps the k nearest of each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import checkpointed, merged_batches

#: Points of a block; pivots of a view and sampled points for each of them; rings of a cell at most; blocks of queries that one task takes.
BLOCK, PIVOTS, SAMPLE, RINGS, VISITS = 2048, 1024, 8, 64, 2
#: Bytes of vectors of a part of the references, tasks at most, pairs whose exact distances are taken at once.
HELD, MOST_TASKS, PAIRS = 64 << 20, 20_000, 1 << 16

_EPS = float(np.finfo(float).eps)


def _centres(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Centres of groups of the sample, by some rounds of means; those without points stay where they were."""
    centres = sample[:n].copy()
    for _ in range(rounds):
        nearest = ((centres * centres).sum(1) - 2 * sample @ centres.T).argmin(1)
        total, many = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(total, nearest, sample)
        centres = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centres)
    return centres


def _bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the distances of points to centres are at least and at most, whatever rounding does."""
    xx, cc = (x * x).sum(1)[:, None], (centres * centres).sum(1)[None]
    square, slack = xx + cc - 2 * x @ centres.T, (8 * x.shape[1] + 64) * _EPS * (xx + cc)
    return np.sqrt(np.maximum(square - slack, 0)), np.sqrt(np.maximum(square + slack, 0))


def _nearest(q: np.ndarray, x: np.ndarray, r: np.ndarray, y: np.ndarray, k: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, reference, distance): the k nearest of each query, no farther than its bound; itself always takes part."""
    m = min(k, len(r))
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    near = xx[:, None] + yy[None] - 2 * x @ y.T
    slack = (8 * x.shape[1] + 64) * _EPS * (xx + yy.max(initial=0.0))  # over twice what rounding can change
    limit = np.minimum(np.partition(near, m - 1, 1)[:, m - 1], within * within) + slack
    maybe = ~(near > limit[:, None]) | (q[:, None] == r[None])
    at, ref, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in np.flatnonzero(maybe.any(1)):  # of all that may be among the nearest, the exact distances and the smaller ids
        some = np.flatnonzero(maybe[i])
        d = np.sqrt(((x[i] - y[some]) ** 2).sum(1))
        order = np.lexsort((r[some], d))[:m]
        order = order[~(d[order] > within[i])]
        at.append(np.full(len(order), i)), ref.append(r[some[order]]), dist.append(d[order])
    return np.concatenate(at), np.concatenate(ref), np.concatenate(dist)


def _matrix(ids: pa.Array, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    q = ids.to_numpy(zero_copy_only=False)
    return q, flat.to_numpy(zero_copy_only=False).reshape(len(q), len(flat) // max(1, len(q)))


def blocks(points: DataFrame, by: str, point: str, vector: str) -> tuple[DataFrame, dict]:
    """Blocks (by, cell, ring, part, ids, flat), written, and for each view its pivots and rings (cell, ring, parts, least and largest distance).

    The driver and all tasks hold PIVOTS vectors and PIVOTS * RINGS rings of a view at most. Points without a view, an id or a vector, or with
    a component that is null or not finite, take no part; vectors of a view have one length.
    """
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = points.select(by, F.col(point).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col(by).isNotNull() & F.col("id").isNotNull() & fine)
    kind = points.schema[by].dataType.simpleString()
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    pivots = {view: min(PIVOTS, -(-2 * n // BLOCK)) for view, n in sizes.items()}
    if not sizes:
        return rows.select(by, *(F.lit(0).alias(c) for c in ("cell", "ring", "part")), F.array("id").alias("ids"), F.col("v").alias("flat")), {}
    share = F.create_map(*(F.lit(e) for view, n in sizes.items() for e in (view, int(min(1.0, (SAMPLE * pivots[view] + 64) / n) * (1 << 30)))))
    drawn = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)).alias("h")
    sample: dict = {view: [] for view in sizes}
    for r in rows.select(by, "id", "v", drawn).filter(F.col("h") < share[F.col(by)]).collect():
        sample[r[0]].append((r["h"], r["id"], r["v"]))
    centres = {view: _centres(np.array([v for _, _, v in sorted(found)], float), pivots[view]) for view, found in sample.items() if found}
    centres |= {view: np.zeros((1, 1)) for view in sizes if view not in centres}  # a view that the sample missed: any pivot will do
    held = points.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            places: dict = {}
            for i, view in enumerate(batch.column(0).to_pylist()):
                places.setdefault(view, []).append(i)
            for view, at in places.items():
                part = batch.take(pa.array(at))
                _, x = _matrix(part.column(1), part.column(2).flatten())
                low, high = _bounds(x, np.broadcast_to(held.value[view], (len(held.value[view]), x.shape[1])))
                cell, line = low.argmin(1), np.arange(len(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(low[line, cell]), pa.array(high[line, cell])], ["view", "id", "v", "cell", "low", "high"])

    dealt = checkpointed(rows.mapInArrow(assign, f"{by} {kind}, id long, v array<double>, cell int, low double, high double"))
    many, cut = F.count(F.lit(1)), [i / RINGS for i in range(1, RINGS)]
    cells = dealt.groupBy(by, "cell").agg(many.alias("n"), F.percentile_approx("low", cut, 1000).alias("edges"))
    rings = F.least(F.lit(RINGS), F.ceil(F.col("n") / BLOCK))
    ring = F.floor(F.size(F.filter("edges", lambda e: e < F.col("low"))) * rings / RINGS).cast("int")
    placed = dealt.join(F.broadcast(cells), [by, "cell"]).select(by, "id", "v", "cell", "low", "high", ring.alias("ring"))
    spans = checkpointed(placed.groupBy(by, "cell", "ring").agg(F.ceil(many / BLOCK).cast("int").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high")))
    part = F.pmod(F.xxhash64(F.lit(11), "id"), F.col("parts").cast("long")).cast("int")
    packed = placed.drop("low", "high").join(F.broadcast(spans.select(by, "cell", "ring", "parts")), [by, "cell", "ring"]).withColumn("part", part)
    packed = packed.groupBy(by, "cell", "ring", "part").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows"))
    packed = checkpointed(packed.select(by, "cell", "ring", "part", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat")))
    shape = {}
    for r in spans.orderBy(by, "cell", "ring").collect():
        shape.setdefault(r[0], []).append((r["cell"], r["ring"], r["parts"], r["low"], r["high"]))
    return packed, {view: (centres[view], np.array(found)) for view, found in shape.items()}


class _Kept:
    """The nearest references of a block of queries among the blocks that it has met so far, none farther than the queries' bounds."""

    def __init__(self, q: np.ndarray, x: np.ndarray, k: int, within: np.ndarray):
        self.q, self.x, self.k, self.bound = q, x, k, within.copy()
        self.xx = (x * x).sum(1)
        self.left = np.concatenate([-2 * x, np.ones((len(x), 1)), self.xx[:, None]], 1)
        self.at, self.ref, self.dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, r: np.ndarray, y: np.ndarray) -> None:
        yy = (y * y).sum(1)
        near = self.left @ np.concatenate([y, yy[:, None], np.ones((len(y), 1))], 1).T  # squares of the distances, but for rounding
        slack = (16 * y.shape[1] + 128) * _EPS * (self.xx + yy.max(initial=0.0))
        limit = self.bound * self.bound
        loose = np.flatnonzero(~np.isfinite(limit))
        if len(loose) and len(r) > self.k:
            limit[loose] = np.partition(near[loose], self.k - 1, 1)[:, self.k - 1] + slack[loose]
        at, some = np.nonzero(~(near > (limit + slack)[:, None]))
        if not len(at):
            return
        parts = range(0, len(at), PAIRS)
        d = np.concatenate([np.sqrt(((self.x[at[a : a + PAIRS]] - y[some[a : a + PAIRS]]) ** 2).sum(1)) for a in parts])
        good = ~(d > self.bound[at])
        at, ref, dist = (np.concatenate(z) for z in ((self.at, at[good]), (self.ref, r[some[good]]), (self.dist, d[good])))
        order = np.lexsort((ref, dist, at))
        at, ref, dist = at[order], ref[order], dist[order]
        many = np.bincount(at, minlength=len(self.q))
        place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        last = place == self.k - 1
        self.bound[at[last]] = np.minimum(self.bound[at[last]], dist[last])
        keep = place < self.k
        self.at, self.ref, self.dist = at[keep], ref[keep], dist[keep]


def meetings(packed: DataFrame, shape: dict, k: int, by: str, visits: bool = True) -> DataFrame:
    """Rows (by, cell, ring, part, ids, near, dist, within, goes) of each block: the nearest of its queries in the block itself, each query's bound,
    in the order of the block's ids, and to which rings (number: cell * RINGS + ring) any query goes. With ``visits`` also rows without
    ``near``: the queries that go to a block."""
    kind = packed.schema[by].dataType.simpleString()
    held = packed.sparkSession.sparkContext.broadcast(shape)
    names = [by, "cell", "ring", "part", "ids", "near", "dist", "within", "goes"]
    types = [pa.int32()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.float64())] * 2 + [pa.list_(pa.bool_())]

    def row(view, *values):
        return pa.RecordBatch.from_arrays([pa.array([view]), *(pa.array([v], t) for v, t in zip(values, types))], names)

    def one(view, cell, ring, part, q, x):
        at, near, dist = _nearest(q, x, q, x, k, np.full(len(q), np.inf))
        within = np.full(len(q), np.inf)
        if len(q) >= k:
            within = np.full(len(q), -np.inf)
            np.maximum.at(within, at, dist)
        centres, rings = held.value[view]
        low, high = _bounds(x, np.broadcast_to(centres, (len(centres), x.shape[1])))
        reached = np.zeros(len(centres) * RINGS, bool)
        for first in range(0, len(rings), BLOCK):
            some = rings[first : first + BLOCK]
            to = some[:, 0].astype(int)
            gap = np.maximum(low[:, to] - some[:, 4], some[:, 3] - high[:, to]) - 1e-12 * (high[:, to] + some[:, 4])
            goes = ~(gap > within[:, None] * (1 + 1e-9))
            for j in np.flatnonzero(goes.any(0)):
                reached[to[j] * RINGS + int(some[j, 1])] = True
                for p in range(int(some[j, 2]) if visits else 0):
                    if (to[j], some[j, 1], p) != (cell, ring, part):
                        yield row(view, to[j], int(some[j, 1]), p, q[goes[:, j]], None, None, None, None)
        yield row(view, cell, ring, part, q[at], near, dist, within, reached)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                view, cell, ring, part = (batch.column(c)[i].as_py() for c in range(4))
                yield from one(view, cell, ring, part, *_matrix(batch.column(4)[i].values, batch.column(5)[i].values))

    schema = f"{by} {kind}, cell int, ring int, part int, ids array<long>, near array<long>, dist array<double>, within array<double>, goes array<boolean>"
    return packed.mapInArrow(lambda batches: merged_batches(run(batches)), schema)


def knn_dense(points: DataFrame, k: int, by: str = "view", point: str = "spot_id", vector: str = "pc") -> DataFrame:
    """(view, q, r, d, place): the k nearest points of each point in its view, itself included at distance 0, ties to the smaller id
    (so that of k or more copies with smaller ids a point is not itself among them). Points without a finite vector take no part."""
    packed, shape = blocks(points, by, point, vector)
    kind = points.schema[by].dataType.simpleString()
    block = [by, "cell", "ring", "part"]
    size = packed.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("flat")).alias("numbers")).first()
    n, parts = size["blocks"], -(-8 * (size["numbers"] or 0) // HELD) or 1
    tasks = max(1, min(-(-n // VISITS), MOST_TASKS // parts))
    state = checkpointed(meetings(packed.repartition(max(1, min(n, MOST_TASKS)), *block), shape, k, by, False))
    pair = F.explode(F.arrays_zip("ids", "near", "dist")).alias("e")
    own = state.select(by, pair).select(by, F.col("e.ids").alias("q"), F.col("e.near").alias("r"), F.col("e.dist").alias("d"))

    def raw(batches):
        """Ids, vectors and bounds as bytes, which pass between Spark and Python unchanged."""
        for batch in batches:
            flat = [pa.array([None if v is None else np.asarray(v.values).tobytes() for v in batch.column(c)], pa.binary()) for c in ("ids", "flat", "within")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*block, "goes")), *flat], [*block, "goes", "ids", "flat", "within"])

    bytes_of = lambda df, many: checkpointed(df.repartition(many, *block[1:]).mapInArrow(raw, f"{by} {kind}, cell int, ring int, part int, goes array<boolean>, ids binary, flat binary, within binary"))
    asked = bytes_of(packed.join(state.select(*block, "within", "goes").hint("merge"), block).select(*block, "ids", "flat", "within", "goes"), tasks)
    refs = bytes_of(packed.withColumns({"within": F.lit(None).cast("array<double>"), "goes": F.lit(None).cast("array<boolean>")}), parts)
    refs = refs.select(F.col(by).alias("there"), *(F.col(c).alias(f"to_{c}") for c in block[1:]), F.col("ids").alias("refs"), F.col("flat").alias("ref_flat"))
    same = (F.col("cell") == F.col("to_cell")) & (F.col("ring") == F.col("to_ring")) & (F.col("part") == F.col("to_part"))
    meet = (F.col(by) == F.col("there")) & F.get("goes", F.col("to_cell") * RINGS + F.col("to_ring")) & ~same
    met = asked.join(refs.hint("shuffle_replicate_nl"), meet).select(*block, "ids", "flat", "within", "refs", "ref_flat")

    def run(batches):
        now, kept = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(kept.at), view_type), pa.array(kept.q[kept.at]), pa.array(kept.ref), pa.array(kept.dist)], [by, "q", "r", "d"])

        def matrix(ids, flat):
            ids = np.frombuffer(ids, np.int64)
            return ids, np.frombuffer(flat).reshape(len(ids), -1)

        for batch in batches:
            view_type = batch.column(by).type
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in block)
                if key != now:  # all references of a block of queries follow one another
                    if now is not None:
                        yield done()
                    now, kept = key, _Kept(*matrix(*(batch.column(c)[i].as_buffer() for c in ("ids", "flat"))), k, np.frombuffer(batch.column("within")[i].as_buffer()))
                    kept.x = kept.x.copy()
                    kept.q = kept.q.copy()
                kept.meet(*matrix(*(batch.column(c)[i].as_buffer() for c in ("refs", "ref_flat"))))
        if now is not None:
            yield done()

    found = own.unionByName(met.mapInArrow(lambda batches: merged_batches(run(batches)), f"{by} {kind}, q long, r long, d double"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy(by, "q").orderBy("d", "r"))).filter(F.col("place") <= k)
