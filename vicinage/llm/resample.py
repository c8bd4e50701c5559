"""Importance resampling towards a target: documents are drawn with odds that follow how typical their word runs are of the target.

Features are words and pairs of neighbouring words, counted in buckets by hash. A bucket's gain is the scaled logarithm of its share in the
target over that in the corpus; a document's weight is the mean gain of its features. Weights plus noise from the document's key are
scores, and the highest scores are drawn, which is a draw without replacement by weight.

Every partition sorts its eligible rows into one run. Runs are cut into ranges of scores, from an exact count of scores, so that ranges
have about ``RANGE_ROWS`` rows and each is merged by a task of its own, with a tree of matches between the runs that holds one block of
each; it gives out ranks from the range's first on, and stops at the draw's last. Ranges beyond the draw are not merged.

Cases: a null or empty text has no features and weight 0; a null key is written as nothing for its noise, and comes after the others in
ties; texts of any length are read whole; rows of one key and one score go by features and weight; repeated rows are drawn one by one; an
empty corpus or target gives gains of its smoothing alone. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .textbytes import lowered, runs, slabs

#: Buckets of features; words that a document needs to be drawn; the share of documents drawn, in percent; the seed of the noise.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Rows of a range of scores, of a block of a run; most tasks of a merge.
RANGE_ROWS, BLOCK_ROWS, MOST_TASKS = 1 << 16, 1 << 12, 20_000
#: Words up to so many bytes are hashed together, byte by byte; longer ones each on their own.
SHORT_WORD = 48

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    """Remainders of the bytes under the reversed polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1)).astype(np.uint32)
    return table


_CRC = _crc_table()


def continued_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans that go on from earlier checksums (0 for none)."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, state, size = start[order], ~before[order], size[order]
    long = int(np.searchsorted(-size, -SHORT_WORD, "left"))
    if long:
        raw = data.tobytes()
        state[:long] = [zlib.crc32(raw[a : a + n], int(c)) ^ 0xFFFFFFFF for a, n, c in zip(at[:long].tolist(), size[:long].tolist(), (~state[:long]).tolist())]
    for j in range(int(size[long]) if long < len(size) else 0):
        many = int(np.searchsorted(-size, -j, "left"))  # spans of more than j bytes
        now = state[long:many]
        state[long:many] = _CRC[(now ^ data[at[long:many] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, words of each row, row of each feature, bucket of each feature) for consecutive rows of a text column."""
    for row, raw, at in slabs(column):
        n = len(at) - 1
        data = lowered(raw)
        start, end, doc = runs(_WORD[raw], at)
        one = continued_crc(data, start, end, np.zeros(len(start), np.uint32))
        first = np.flatnonzero(doc[1:] == doc[:-1])  # a word that another follows in its text
        spaced = _CRC[(~one[first] ^ np.uint32(32)) & np.uint32(255)] ^ (~one[first] >> np.uint32(8))
        two = continued_crc(data, start[first + 1], end[first + 1], ~spaced)
        yield row, n, np.bincount(doc, minlength=n), np.concatenate([doc, doc[first]]), np.concatenate([one, two]).astype(np.int64) % BUCKETS


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket. Tasks sum, and a row for each bucket reaches the driver."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for *_, bucket in features(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) by bucket, every bucket counted once more."""
    t_all, s_all = int(target.sum()) + BUCKETS, int(corpus.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def noise(key, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of SHA-256 of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row, n, words, doc, bucket in features(batch.column(1)):
                many = np.bincount(doc, minlength=n)
                total = np.zeros(n, np.int64)
                np.add.at(total, doc, gains[bucket])
                weight = np.where(many > 0, total // np.maximum(many, 1), 0)
                keys = batch.column(0).slice(row, n)
                score = weight + np.array([noise(k, seed) for k in keys.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x.astype(np.int64)) for x in (words, many, weight, score))], [key, "n_words", "n_features", "weight", "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_words long, n_features long, weight long, score long")


class Tournament:
    """Matches between the heads of runs: every inner node of the tree holds the run that wins below it; the smallest head wins."""

    def __init__(self):
        self.n, self.heads, self.win, self.free = 1, [None], [0, 0], [0]

    def _winner(self, v: int) -> int:
        a, b = self.win[2 * v], self.win[2 * v + 1]
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x <= y) else b

    def put(self, run: int, head) -> None:
        """A run's new head (None: it leaves), and the matches on its way to the root played anew."""
        self.heads[run] = head
        v = (self.n + run) // 2
        while v:
            self.win[v] = self._winner(v)
            v //= 2
        if head is None:
            self.free.append(run)

    def enter(self, head) -> int:
        if not self.free:  # twice as many places
            self.free = list(range(2 * self.n - 1, self.n - 1, -1))
            self.heads += [None] * self.n
            self.n *= 2
            self.win = [0] * self.n + list(range(self.n))
            for v in range(self.n - 1, 0, -1):
                self.win[v] = self._winner(v)
        run = self.free.pop()
        self.put(run, head)
        return run

    def best(self):
        run = self.win[1]
        return run, self.heads[run]


class Merge:
    """Rows of sorted blocks in order. Blocks come by their first rows; one is taken only when it may hold the next row, so that no more are
    held at once than there are runs."""

    def __init__(self, blocks: Iterable[list]):
        self.blocks, self.tree, self.held = iter(blocks), Tournament(), {}
        self.coming = next(self.blocks, None)

    def next(self):
        """The smallest row that is left, or None."""
        run, head = self.tree.best()
        while self.coming is not None and (head is None or self.coming[0] < head):
            self.held[self.tree.enter(self.coming[0])] = [self.coming, 0]
            self.coming = next(self.blocks, None)
            run, head = self.tree.best()
        if head is None:
            return None
        block, at = self.held[run]
        if at + 1 < len(block):
            self.held[run][1] = at + 1
            self.tree.put(run, block[at + 1])
        else:
            del self.held[run]
            self.tree.put(run, None)
        return head

    def rest(self) -> Iterator:
        """All rows that are left, in no order."""
        for block, at in self.held.values():
            yield from block[at:]
        for block in itertools.chain([self.coming] if self.coming is not None else [], self.blocks):
            yield from block


def score_ranges(counts: list[tuple[int, int]], draw: int, rows: int = RANGE_ROWS) -> list[tuple[int, int, int]]:
    """(lowest score, rows before it, rows to draw) of ranges of falling scores that together hold the draw, from (score, rows)."""
    out, before, now = [], 0, 0
    for score, n in sorted(counts, reverse=True):
        if before >= draw:
            break
        now += n
        if now >= rows or before + now >= draw:
            out.append((score, before, min(now, draw - before)))
            before, now = before + now, 0
    return out


def drawn(rows: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The scored rows with ``rank``: 1, 2, ... by falling score, ties to the smaller key, over exactly the given share of the rows with enough
    words; null for the others. ``rows`` is read several times, so it should be a written table.

    Scores are whole numbers between bounds that grow with the logarithm of the corpus (some ten thousands of values), so their counts
    go through the driver."""
    columns = [key, "n_words", "n_features", "weight", "score"]
    rows = rows.select(*columns)
    eligible = F.col("n_words") >= least_words
    counts = [tuple(r) for r in rows.filter(eligible).groupBy("score").count().collect()]
    ranges = score_ranges(counts, sum(n for _, n in counts) * percent // 100, RANGE_ROWS)
    if not ranges:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    lowest = np.array([-low for low, *_ in ranges], np.int64)
    kind = rows.schema[key].dataType.simpleString()
    many = F.col("score") >= ranges[-1][0]
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]

    def cut(batches):
        """The partition's run as blocks, none over the end of a range."""
        for batch in batches:
            score = batch.column("score").to_numpy()
            place = np.searchsorted(lowest, -score, "left")
            edges = np.flatnonzero(np.diff(place)) + 1
            for a, b in itertools.pairwise([0, *edges.tolist(), batch.num_rows]):
                for k in range(a, b, BLOCK_ROWS):
                    part = batch.slice(k, min(BLOCK_ROWS, b - k))
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns]
                    first = [c.slice(0, 1) for c in part.columns]
                    yield pa.RecordBatch.from_arrays([pa.array([int(place[k])], pa.int32()), *first, *lists], ["part", *columns, *[f"{c}_s" for c in columns]])

    types = {key: kind} | {c: "long" for c in columns[1:]}
    blocks = rows.filter(eligible & many).sortWithinPartitions(*order).mapInArrow(cut, ", ".join(["part int", *[f"{c} {t}" for c, t in types.items()], *[f"{c}_s array<{t}>" for c, t in types.items()]]))
    blocks = blocks.repartition(min(len(ranges), MOST_TASKS), "part").sortWithinPartitions("part", *order)

    def ranked(batches):
        def held():
            """(range, rows of a block as sortable tuples)"""
            for batch in batches:
                parts, lists = batch.column(0).to_pylist(), batch.columns[-len(columns) :]
                for i, part in enumerate(parts):
                    ids, words, feats, weight, score = (c[i].as_py() for c in lists)
                    yield part, [(-s, k is None, 0 if k is None else k, f, w, m) for k, m, f, w, s in zip(ids, words, feats, weight, score)]

        def out(group, kind):
            (negative, none, k, f, w, m), rank = zip(*[g[0] for g in group]), [g[1] for g in group]
            values = [[None if x else y for x, y in zip(none, k)], m, f, w, [-s for s in negative], rank]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [kind, *[pa.int64()] * 5])], [*columns, "rank"])

        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kind, batches = first.schema.field(key).type, itertools.chain([first], batches)
        for part, group in itertools.groupby(held(), key=lambda x: x[0]):
            _, before, take = ranges[part]
            runs_of_part, rows_out = Merge(block for _, block in group), []
            ranks = ((runs_of_part.next(), rank) for rank in range(before + 1, before + take + 1))
            for row in itertools.chain(ranks, ((row, None) for row in runs_of_part.rest())):
                rows_out.append(row)
                if len(rows_out) == BLOCK_ROWS:
                    yield out(rows_out, kind)
                    rows_out = []
            if rows_out:
                yield out(rows_out, kind)

    merged = blocks.mapInArrow(ranked, ", ".join([*[f"{c} {t}" for c, t in types.items()], "rank long"]))
    rest = rows.filter(~F.coalesce(eligible & many, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return merged.unionByName(rest)


def sample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's (key, n_words, n_features, weight, score, rank), drawn towards the target's texts."""
    gains = bucket_gains(bucket_counts(target, text), bucket_counts(docs, text))
    rows, _ = tables.written(scored(docs, gains, key, text, seed), "scored")
    return drawn(rows, key, percent, least_words)


def query(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sample(read("documents"), read("benchmark"))
