"""Exact similarity join of documents on their word shingles: which documents are linked, directly or through others, how many
links each has, and the links.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. Linked sets differ in a bounded
number of shingles U, and so have much in common once the universe of shingles is cut by a hash:

* Sizes fall into bands so that a set's partners lie in its own band or the next. A pair of bands has one U.
* For each pair of bands the universe is cut into segments. With threshold 0 a segment's whole subset is indexed: of
  U+1 segments one at least agrees. With threshold 1 the subset is cut further into blocks and every one-deletion
  neighbour (all blocks but one) is indexed: of U/2+1 segments one has a single difference, which lies in one block.
* The allocation of thresholds, segments and blocks is by cost: index entries plus the candidate pairs they let through,
  from the exact number of sets in each band.
* An empty subset would match too much. Spare segments make it unnecessary unless a set has more empty ones than spares;
  only such sets index them.
* Equal sets are one class. Candidates of an index entry are compared with its smallest and its largest set. What this leaves
  in different components is compared with all others of the entry: by parity sketches, which bound the difference from
  below, then what is left of the pairs like the first ones. Comparison is exact, on the texts.

Cases: a null or empty text has no shingles and links with nothing; keys are taken to be unique, and a row that is there
twice gives the same result twice; texts of any length are used whole; an empty table gives an empty table; only the key
and text columns are read, so extra columns cannot clash; a row with a null key gets its number of shingles, and a null
component, as no link could name it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .components import components
from .textbytes import group_sums, lowered, mix64, slabs, span_hashes, word_spans

#: Blocks of a segment that may be chosen; 1 stands for threshold 0.
BLOCKS = (1, 3, 4)
#: A candidate pair costs as much as so many index entries; the share of a set that unrelated sets may have in common.
PAIR_COST, SHARED = 20.0, 0.5
#: Sets that must index empty subsets should be fewer than this share.
TAIL = 0.01
#: Members of one set's comparisons are spread over so many groups; members of an entry are compared in chunks of so many.
SALTS, CHUNK = 16, 512
#: Bytes of text that a task works on at once.
SLAB = 1 << 20
#: Links are counted between chunks of a component that hold about so many sets, or so many shingles.
LINK_SETS, LINK_SHINGLES = 512, 1 << 19


# --- what is indexed -------------------------------------------------------------------------------------------------


def band_bounds(percent: int, largest: int = 1 << 40) -> list[int]:
    """Smallest size of each band: a set of band k links with sizes of bands k and k+1 at most."""
    out = [1]
    while out[-1] <= largest:
        out.append(100 * out[-1] // percent + 1)
    return out


def difference_bound(bounds: list[int], k: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets, the smaller one in band k."""
    a = bounds[k + 1] - 1
    return (a + 100 * a // percent) * (100 - percent) // (100 + percent)


def _spares(segments: int, size: float, blocks: int) -> int:
    x = 0
    for _ in range(8):
        q = size / (segments + x) * (1 if blocks == 1 else (blocks - 1) / blocks)
        rate = (segments + x) * min(1.0, blocks * math.exp(-q))
        need, p, tail = 0, math.exp(-rate), 1.0
        while tail > TAIL and need < segments:
            tail -= p
            need += tail > TAIL
            p *= rate / max(1, need)
        if need <= x:
            break
        x = need
    return x


def allocate(counts: dict[int, int], percent: int) -> dict[int, tuple[int, int, int]]:
    """For each pair of bands (k, k+1): segments, blocks, spares. No entry where linked sets must be equal."""
    bounds = band_bounds(percent)
    out = {}
    for k in {j for b in counts for j in (b, b - 1) if j >= 0}:
        u = difference_bound(bounds, k, percent)
        sets, pairs = counts.get(k, 0) + counts.get(k + 1, 0), counts.get(k, 0) * (counts.get(k, 0) / 2 + counts.get(k + 1, 0))
        if not u or not pairs:
            continue
        best = None
        for blocks in BLOCKS:
            least = u + 1 if blocks == 1 else u // 2 + 1
            x = _spares(least, bounds[k], blocks)
            n = least + x
            q = bounds[k] / n * (1 if blocks == 1 else (blocks - 1) / blocks)
            cost = n * blocks * (sets + PAIR_COST * pairs * math.exp(-2 * q * (1 - SHARED)))
            if best is None or cost < best[0]:
                best = cost, (n, blocks, x)
        out[k] = best[1]
    return out


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle of the documents in a buffer, in order of both."""
    data = lowered(data)
    start, end, doc = word_spans(data, at)
    h = span_hashes(data, start, end)
    n = len(h)
    words = np.bincount(doc, minlength=len(at) - 1)
    value = np.zeros(n, np.uint64)
    for j in range(width):  # of each start the hash of its next words, as far as they lie in the same document
        m = max(0, n - j)  # a slab may hold fewer words than a shingle
        inside = np.zeros(n, bool)
        inside[:m] = doc[j:] == doc[:m]
        step = np.zeros(n, np.uint64)
        step[:m] = h[j:]
        value = np.where(inside, mix64(value * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(1)), value)
    first = np.zeros(n, bool)
    first[:1] = True
    first[1:] = doc[1:] != doc[:-1]
    full = np.zeros(n, bool)
    if n >= width:
        full[: n - width + 1] = doc[width - 1 :] == doc[: n - width + 1]
    use = full | (first & (words[doc] < width) if n else first)
    doc, value = doc[use], value[use]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


_SEED = np.uint64(0xA0761D6478BD642F)


def index_entries(doc: np.ndarray, value: np.ndarray, size: np.ndarray, bounds: np.ndarray, plan: dict[int, tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Document and signature of all index entries of the sets (document, value)."""
    band = np.searchsorted(bounds, size, "right") - 1
    place = mix64(value ^ _SEED)
    weight = mix64(value + _SEED)
    docs, sigs = [], []
    for shift in (0, 1):  # as the smaller of a pair, then as the larger
        pair = np.where(size > 0, band - shift, -1)
        use = np.array([plan.get(int(p), (0, 1, 0)) for p in pair], np.int64).reshape(-1, 3)
        segments, blocks, spare = use.T
        cells = segments * blocks
        base = np.concatenate([[0], np.cumsum(cells)])
        if not base[-1]:
            continue
        on = cells[doc] > 0
        d, c = doc[on], cells[doc[on]]
        cell = base[d] + (place[on] % c.astype(np.uint64)).astype(np.int64)
        total, many = group_sums(cell, weight[on], base[-1]), np.bincount(cell, minlength=base[-1])
        owner = np.repeat(np.arange(len(cells)), cells)
        local = np.arange(base[-1]) - base[owner]
        several = blocks[owner] > 1
        starts = np.flatnonzero(local % blocks[owner] == 0)
        segment = np.cumsum(local % blocks[owner] == 0) - 1
        seg_total, seg_many = np.add.reduceat(total, starts), np.add.reduceat(many, starts)
        left = np.where(several, seg_total[segment] - total, total)
        full = np.where(several, seg_many[segment] - many, many) > 0
        hollow = np.bincount(owner[starts], ~np.logical_and.reduceat(full, starts), len(cells))
        emit = full | (hollow > spare)[owner]
        tag = mix64((pair[owner].astype(np.uint64) << np.uint64(40)) + local.astype(np.uint64))
        docs.append(owner[emit])
        sigs.append(mix64(left ^ tag)[emit])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(sigs)


# --- exact comparison ------------------------------------------------------------------------------------------------

_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def exact_set(text: str, width: int) -> set:
    words = text.encode().translate(_LOWER_BYTES).split()
    return set(zip(*(words[i:] for i in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


def linked(a: set, b: set, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not a or not b:
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compared(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. A set's members are dealt into groups, and its text goes to each group that has any."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    used = tables.only_ids(texts, "id", ids)
    members = pairs.join(used, pairs.b == used.id).select("a", "salt", "b", "text")
    heads = pairs.select("a", "salt").distinct().join(used, F.col("a") == used.id).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = heads.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        of, mine = None, set()
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b is None:
                    of, mine = a, exact_set(text.as_py() or "", width)
                elif of == a and linked(mine, exact_set(text.as_py() or "", width), percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.select("a", "b", "text").mapInArrow(run, "a long, b long")


# --- sketches --------------------------------------------------------------------------------------------------------


def sketch_bits(size: int, percent: int) -> int:
    """Bits of a set's sketch, a power of two: enough that linked and other sets differ clearly."""
    return 1 << min(13, max(8, (64 * size * (100 - percent) // (100 + percent)).bit_length()))


def parity_sketch(value: np.ndarray, bits: int) -> bytes:
    """For each of the bits, whether an odd number of the set's hashes fall on it. Two sketches differ in as many bits as the
    sets have differences, or fewer. Half a sketch XOR the other half is the sketch of half the bits."""
    count = np.bincount((mix64(value ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def _sketches(texts: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row, data, at in slabs(batch.column(1), SLAB):
                doc, value = shingle_sets(data, at, width)
                n = np.bincount(doc, minlength=len(at) - 1)
                ends = np.cumsum(n)
                made = [parity_sketch(value[e - k : e], sketch_bits(k, percent)) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n), pa.array(made, pa.binary())], ["id", "n", "sketch"])

    return texts.mapInArrow(run, "id long, n long, sketch binary")


def near_in_group(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Pairs of a group's rows (chunk, id, part, n, low, high, sketch) that may link: of different parts, not compared before,
    of sizes and sketches that do not rule it out. With two chunks only pairs between them."""
    bits = min(len(r[6]) for r in rows)

    def folded(sketch: bytes) -> np.ndarray:
        x = np.frombuffer(sketch, np.uint8)
        while len(x) > bits:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        return x

    bit = np.stack([folded(r[6]) for r in rows]).view(np.uint64)
    chunk, ids, part, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    done = (ids == rows[0][4]) | (ids == rows[0][5])
    both, out = chunk.min() != chunk.max(), []
    for i in range(len(rows) - 1):
        if done[i]:
            continue
        o = slice(i + 1, None)
        ok = (part[o] != part[i]) & ~done[o] & (100 * np.minimum(n[o], n[i]) >= percent * np.maximum(n[o], n[i]))
        if both:
            ok &= chunk[o] != chunk[i]
        if ok.any():
            differ = np.bitwise_count(bit[o][ok] ^ bit[i]).sum(1, dtype=np.int64)
            hit = ids[o][ok][differ * (100 + percent) <= (n[o][ok] + n[i]) * (100 - percent)]
            out.extend((min(int(ids[i]), h), max(int(ids[i]), h)) for h in hit.tolist())
    return out


def _near_sketches(left: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of ids of one index entry whose sketches allow a link. The members of an entry are dealt into chunks, and each
    pair of chunks is a group of its own."""
    rows = left.join(sketches, "id").withColumn("c", F.pmod(F.xxhash64("id", "sig"), F.col("chunks")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("sig", F.least("c", "j").alias("c0"), F.greatest("c", "j").alias("c1"), "c", "id", "part", "n", "low", "high", "sketch")
    dealt = rows.repartition("sig", "c0", "c1").sortWithinPartitions("sig", "c0", "c1")

    def run(batches):
        of, held = None, []
        for batch in batches:
            out = []
            columns = [x.to_pylist() for x in batch.columns]
            for g, row in zip(zip(*columns[:3]), zip(*columns[3:])):
                if g != of:
                    if len(held) > 1:
                        out.extend(near_in_group(held, percent))
                    of, held = g, []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
        out = near_in_group(held, percent) if len(held) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


# --- the join --------------------------------------------------------------------------------------------------------


def _sizes(texts: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row, data, at in slabs(batch.column(1), SLAB):
                doc, value = shingle_sets(data, at, width)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), *(pa.array(group_sums(doc, mix64(value ^ np.uint64(k)), n).view(np.int64)) for k in (1, 2))],
                    ["id", "n", "s1", "s2"],
                )

    return texts.mapInArrow(run, "id long, n long, s1 long, s2 long")


def _entries(texts: DataFrame, width: int, percent: int, plan: dict, ends: bool = False) -> DataFrame:
    """(sig, id) of all index entries; with ``ends`` (sig, low, span), of each entry in a slab the smallest id and the largest less
    the smallest."""
    bounds = np.array(band_bounds(percent), np.int64)
    names = ["sig", "low", "span"] if ends else ["sig", "id"]

    def run(batches):
        for batch in batches:
            for row, data, at in slabs(batch.column(1), SLAB):
                doc, value = shingle_sets(data, at, width)
                ids = batch.column(0).slice(row, len(at) - 1).to_numpy(zero_copy_only=False)
                owner, sig = index_entries(doc, value, np.bincount(doc, minlength=len(at) - 1), bounds, plan)
                columns = [sig.view(np.int64), ids[owner]]
                if ends and len(sig):
                    order = np.argsort(sig, kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(sig[order]) != 0]))
                    low, high = (f.reduceat(columns[1][order], starts) for f in (np.minimum, np.maximum))
                    columns = [columns[0][order][starts], low, high - low]
                elif ends:
                    columns.append(columns[1])
                for k in range(0, len(columns[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 200_000]) for c in columns], names)

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def similarity_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per key: its number of distinct shingles, and the smallest key that links reach from it.

    ``width``: words of a shingle; ``percent``: the least similarity that links, in hundredths.
    """
    return _components(df, key, text, width, percent)[1].select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _found(df: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The texts (id, text), and the rows of ``similarity_components`` with ``head``, the smallest key of the row's set."""
    texts, found = _components(df, key, text, width, percent)
    return texts, found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "head")


def _components(df: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Texts (id, text), and a written table (id, n, head, component_id) of a row for each of the rows: the size of its set, and the
    smallest id with that set and in its component."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    with tables.shuffles_dropped(df.sparkSession):
        return rows.filter("id is not null"), _components_of(rows, width, percent)


def _components_of(rows: DataFrame, width: int, percent: int) -> DataFrame:
    spark, texts = rows.sparkSession, rows.filter("id is not null")
    sizes, sizes_path = tables.written(_sizes(rows, width), "sizes")
    # Of equal sets the smallest document stands for all. Only sets of several documents are joined back.
    copied = sizes.filter("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("head"), F.count("*").alias("many")).filter("many > 1")
    copied, copied_path = tables.written(copied.drop("many"), "copied")
    heads = sizes.join(tables.small(copied), ["n", "s1", "s2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("head", "id")).alias("head"))
    heads, heads_path = tables.written(heads, "heads")
    tables.drop(spark, sizes_path, copied_path)

    bounds = band_bounds(percent)
    edges = F.array(*[F.lit(b) for b in bounds])
    bands = heads.filter("id = head and n > 0").groupBy(F.size(F.filter(edges, lambda b: b <= F.col("n"))).alias("k")).count()
    counts = {r["k"] - 1: r["count"] for r in bands.collect()}  # a row for each band, of which there are few hundreds
    plan = allocate(counts, percent)

    # Entries are made twice: once to find those of several documents, and once more to keep only those. Most are of one document,
    # so the first shuffle takes rows that a slab has combined, without further map-side tables. Least and greatest of structs are
    # found by sorting, which spills, and not in a hash table of all entries.
    alone = tables.only_ids(texts, "id", heads.filter("id <> head").select("id").distinct(), "left_anti")
    ends = _entries(alone, width, percent, plan, True).repartition("sig").groupBy("sig")
    ends = ends.agg(F.min(F.struct("low")).alias("a"), F.max(F.struct((F.col("low") + F.col("span")).alias("high"))).alias("b")).select("sig", "a.low", "b.high")
    shared, shared_path = tables.written(ends.filter("low <> high"), "shared")
    entries, entries_path = tables.written(_entries(alone, width, percent, plan).join(shared.hint("shuffle_hash"), "sig"), "entries")
    tables.drop(spark, shared_path)
    pairs = entries.select(F.col("low").alias("a"), F.col("id").alias("b")).filter("a <> b").union(entries.filter("id <> low").select(F.col("id").alias("b"), F.col("high").alias("a")).filter("a <> b").select(F.least("a", "b"), F.greatest("a", "b")))
    near, near_path = tables.written(_compared(alone, pairs.distinct(), width, percent), "near")
    groups, groups_path = components(near, "a", "b")

    # Classes of one entry in different components: all of them are compared, first by their sketches.
    entry = entries.join(tables.small(groups.withColumnRenamed("node", "id")), "id", "left").select("sig", "id", "low", "high", F.coalesce("component", "id").alias("part"))
    several = entry.groupBy("sig").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.ceil(F.count("*") / CHUNK).alias("chunks")).filter("p0 <> p1").select("sig", "chunks")
    several, several_path = tables.written(several, "several")
    left, left_path = tables.written(entry.join(tables.small(several), "sig").distinct(), "left")
    tables.drop(spark, entries_path, several_path)
    more = _near_sketches(left, _sketches(tables.only_ids(alone, "id", left.select("id").distinct()), width, percent), percent).distinct()
    more, more_path = tables.written(more, "more")
    tables.drop(spark, left_path)
    late, late_path = tables.written(_compared(alone, more, width, percent), "late")
    tables.drop(spark, more_path)
    if late.take(1):
        tables.drop(spark, groups_path)
        groups, groups_path = components(near.union(late), "a", "b")

    named = heads.join(tables.small(groups.withColumnRenamed("node", "head")), "head", "left")
    found, _ = tables.written(named.select("id", "n", "head", F.coalesce("component", "head").alias("component_id")), "components")
    tables.drop(spark, heads_path, near_path, late_path, groups_path)
    return found


# --- links -----------------------------------------------------------------------------------------------------------


def _shingles(texts: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the set's sorted hashes, eight bytes each."""

    def run(batches):
        for batch in batches:
            for row, data, at in slabs(batch.column(1), SLAB):
                doc, value = shingle_sets(data, at, width)
                ends = np.cumsum(np.bincount(doc, minlength=len(at) - 1)).tolist()
                made = [value[a:b].tobytes() for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(ends)), pa.array(made, pa.binary())], ["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles binary")


def common_counts(a: list[np.ndarray], b: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """How many values each set of ``a`` and each of ``b`` have in common."""

    def flat(sets):
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)

    (i, x), (j, y) = flat(a), flat(b)
    both = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.int64)

    def cells(owner, value):
        at = np.minimum(np.searchsorted(both, value), max(0, len(both) - 1))
        use = both[at] == value if len(both) else np.zeros(len(value), bool)
        order = np.argsort(at[use], kind="stable")
        return owner[use][order], at[use][order]

    (i, x), (j, y) = cells(i, x), cells(j, y)
    for first in range(0, len(both), step):  # sums under 2**24, exact in float32
        m, n = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        for owner, value, to in ((i, x, m), (j, y, n)):
            p, q = np.searchsorted(value, [first, first + step])
            to[owner[p:q], value[p:q] - first] = 1
        out += (m @ n.T).astype(np.int64)
    return out


def links_in_group(rows: list[tuple[int, int, bytes]], percent: int) -> list[tuple[int, int]]:
    """All links (a, b), a < b, of a group's sets (chunk, id, shingles); with two chunks only those between them."""
    chunks = sorted({r[0] for r in rows})
    ids = [np.array([r[1] for r in rows if r[0] == c], np.int64) for c in chunks]
    sets = [[np.frombuffer(r[2], np.uint64) for r in rows if r[0] == c] for c in chunks]
    common = common_counts(sets[0], sets[-1])
    n, m = (np.array([len(x) for x in s], np.int64) for s in (sets[0], sets[-1]))
    hit = (common > 0) & (100 * common >= percent * (n[:, None] + m[None] - common))
    if len(chunks) == 1:
        hit &= ids[0][:, None] < ids[0][None]
    i, j = np.nonzero(hit)
    a, b = ids[0][i], ids[-1][j]
    return list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))


def _dealt_links(members: DataFrame, run_group, schema: str) -> DataFrame:
    """``run_group`` of the rows (c, id, weight, shingles) of each chunk or pair of chunks of a component; so each pair of a component's sets
    meets in one group only."""
    rows = members.withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("component", F.least("c", "j").alias("c0"), F.greatest("c", "j").alias("c1"), "c", "id", "weight", "shingles")
    dealt = rows.repartition("component", "c0", "c1").sortWithinPartitions("component", "c0", "c1")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        of, held = None, []

        def done():
            found = run_group(held) if len(held) > 1 and (of[1] == of[2] or len({r[0] for r in held}) > 1) else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(len(names))], names)

        for batch in batches:
            columns = [x.to_pylist() for x in batch.columns]
            for g, row in zip(zip(*columns[:3]), zip(*columns[3:])):
                if g != of:
                    yield done()
                    of, held = g, []
                held.append(row)
        yield done()

    return dealt.mapInArrow(run, schema)


def _members(texts: DataFrame, found: DataFrame, key: str, width: int) -> DataFrame:
    """The different sets of each component that has several: (component, chunks, id, weight, shingles); ``weight``: documents of the set."""
    heads = found.filter("n_shingles > 0").groupBy("component_id", "head").agg(F.count_distinct(key).alias("weight"), F.first("n_shingles").alias("n"))
    chunks = F.ceil(F.greatest(F.count("*") / LINK_SETS, F.sum("n") / LINK_SHINGLES)).alias("chunks")
    several = heads.groupBy("component_id").agg(F.count("*").alias("sets"), chunks).filter("sets > 1").select("component_id", "chunks")
    used = tables.kept(heads.join(several, "component_id").select(F.col("component_id").alias("component"), "chunks", F.col("head").alias("id"), "weight"))
    shingles = _shingles(tables.only_ids(texts, "id", used.select("id")), width).dropDuplicates(["id"])
    return used.join(shingles, "id")


def similarity_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, as pairs (a, b) of the smallest keys of the two sets, a < b; and the membership: one row per
    key with n_shingles, component_id and ``head``, the smallest key with the same set. Documents of one set link with one another.

    Linked sets lie in one component, so all pairs of a component's sets are compared and no others. Shingles are compared by
    the 64-bit hashes that count them. The pairs of a large group are as many as the square of its sets: for their number
    alone see ``similarity_links``.
    """
    texts, found = _found(df, key, text, width, percent)
    pairs = _dealt_links(_members(texts, found, key, width), lambda rows: links_in_group([(c, i, s) for c, i, _, s in rows], percent), "a long, b long")
    return pairs, found


def similarity_links(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """``similarity_components`` and ``n_links``: how many other documents link with the row's, those of an equal set included. Counts
    are summed in the tasks that compare, so that pairs are never rows."""
    texts, found = _found(df, key, text, width, percent)

    def counts(rows):
        weight, total = {r[1]: r[2] for r in rows}, {}
        for a, b in links_in_group([(c, i, s) for c, i, _, s in rows], percent):
            total[a] = total.get(a, 0) + weight[b]
            total[b] = total.get(b, 0) + weight[a]
        return list(total.items())

    other = _dealt_links(_members(texts, found, key, width), counts, "head long, links long").groupBy("head").agg(F.sum("links").alias("links"))
    same = found.filter("n_shingles > 0").groupBy("head").agg((F.count_distinct(key) - 1).alias("copies"))
    zero = F.lit(0).cast("long")
    return found.join(same.join(other, "head", "left"), "head", "left").select(key, "n_shingles", "component_id", (F.coalesce("copies", zero) + F.coalesce("links", zero)).alias("n_links"))


_LINKED = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingle FROM words),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT id, b FROM reach JOIN link ON a = other),
component AS (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY 1)"""
SQL = _LINKED + " SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents JOIN component USING (doc_id) LEFT JOIN n USING (doc_id)"
LINKS_SQL = _LINKED + """ SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(k, 0) AS n_links FROM documents JOIN component USING (doc_id)
LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM link GROUP BY 1) USING (doc_id)"""


def query(spark, sf_dir: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def links_query(spark, sf_dir: str) -> DataFrame:
    return similarity_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
