"""Quality of texts by a byte-level convolutional network in numpy.

Learned filters run over every position of a text; their largest responses in overlapping chunks, which cover the whole
text, are pooled over the chunks (mean and maximum) and combined into one probability. The network is fitted on a bounded
sample of labelled rows: SAMPLE rows with the smallest hashes of their ids. Fit and scores take whole texts, and nothing
but texts; the driver holds the texts of the sample.

Cases: a null or empty text has no response anywhere and gets the score of the network's constant part; texts of any length
are scored whole; repeated rows get equal scores; an empty table gives an empty table; without labelled rows every score is
0.5; rows with a null label or id are not learned from; only the key and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import string_bytes

SAMPLE = 3000
FILTERS, WIDTH = 16, 4
#: Positions of a block; blocks of a chunk, of which the next chunk repeats the last one.
BLOCK, CHUNK = 32, 8
STEPS, BATCH, RATE = 750, 32, 0.02
THRESHOLD = 0.3


def fold(key: str) -> Column:
    """Remainder of the key's crc32 by 5: labels of remainder 0 are held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


class Network:
    """weights (WIDTH, 256, FILTERS), bias, and the combination of mean and maximum."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.a = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of byte pairs: the sum of both table entries is a filter's response to four bytes."""
        w = self.w
        return (w[0][:, None] + w[1][None] + self.b).reshape(65536, FILTERS), (w[2][:, None] + w[3][None]).reshape(65536, FILTERS)


def responses(x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Responses at every position of the bytes x, which are followed by zeros."""
    padded = np.zeros(len(x) + WIDTH, np.int32)
    padded[: len(x)] = x
    pair = padded[:-1] << 8 | padded[1:]
    z = tables[0][pair[: len(x)]]
    z += tables[1][pair[2 : len(x) + 2]]
    return z


def chunk_bounds(blocks: int) -> np.ndarray:
    """Starts and ends of overlapping chunks in blocks, alternating."""
    start = np.arange(0, max(1, blocks - 1), CHUNK - 1)
    return np.stack([start, np.minimum(start + CHUNK, blocks)], 1).ravel()


def pooled(x: np.ndarray, tables, piece: int = 1 << 18) -> np.ndarray:
    """Mean and maximum over chunks of the largest responses; long texts in pieces of whole blocks, so that memory stays bounded."""
    if not len(x):
        return np.zeros(2 * FILTERS, np.float32)
    parts = []
    for a in range(0, len(x), piece):
        some = x[a : a + piece + WIDTH - 1]
        z = responses(some, tables)[: min(piece, len(x) - a)]
        parts.append(np.maximum.reduceat(z, np.arange(0, len(z), BLOCK)))
    blocks = np.maximum(np.concatenate(parts), 0)
    ends = chunk_bounds(len(blocks))
    top = np.maximum.reduceat(np.concatenate([blocks, np.zeros((1, FILTERS), np.float32)]), ends)[::2]
    return np.concatenate([top.mean(0), top.max(0)])


def peaks(x: np.ndarray, tables, piece: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Place and size of each filter's largest response in each chunk, in pieces of so many chunks, so that memory stays bounded."""
    ends = chunk_bounds(-(-len(x) // BLOCK)).reshape(-1, 2) * BLOCK
    at, top = [], []
    for k in range(0, len(ends), piece):
        some = ends[k : k + piece]
        first, last = int(some[0, 0]), min(int(some[-1, 1]), len(x))
        z = np.maximum(responses(x[first : last + WIDTH - 1], tables)[: last - first], 0)
        place = np.stack([a - first + z[a - first : b - first].argmax(0) for a, b in some.tolist()])
        at.append(place + first)
        top.append(np.take_along_axis(z, place, 0))
    return np.concatenate(at), np.concatenate(top)


def fit(texts: list[bytes], labels: list[int], seed: int = 7) -> Network:
    """Gradient descent (Adam) on the log loss; gradients flow to the positions of the largest responses."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not texts:
        net.a[:], net.c[:] = 0, 0
        return net
    params = [net.w, net.b, net.a, net.c]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    data, y, step = [np.frombuffer(t, np.uint8) for t in texts], np.array(labels, np.float32), 0
    for _ in range(-(-STEPS * BATCH // len(data))):
        order = rng.permutation(len(data))
        for s in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in params]
            tables = net.tables()
            some = order[s : s + BATCH]
            for i in some:
                x = data[i]
                if len(x):
                    at, top = peaks(x, tables)
                    mean, best = top.mean(0), top.argmax(0)
                    f = np.concatenate([mean, top.max(0)])
                else:
                    f = np.zeros(2 * FILTERS, np.float32)
                p = 1 / (1 + np.exp(-np.clip(f @ net.a + net.c[0], -30, 30)))
                g = (p - y[i]) / len(some)
                grads[2] += g * f
                grads[3] += g
                if len(x):
                    d = np.repeat((g * net.a[:FILTERS] / len(top))[None], len(top), 0)
                    d[best, np.arange(FILTERS)] += g * net.a[FILTERS:]
                    d *= top > 0
                    k = np.broadcast_to(np.arange(FILTERS), at.shape)
                    np.add.at(grads[1], k, d)
                    padded = np.concatenate([x, np.zeros(WIDTH, np.uint8)])
                    for j in range(WIDTH):
                        np.add.at(grads[0][j], (padded[at + j], k), d)
            step += 1
            for p, g, a, b in zip(params, grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """The network fitted on the sample of labelled rows outside the held-out fold."""
    chosen = labels.select(F.col(key), F.col(label).cast("int").alias("y")).filter(F.col(key).isNotNull() & F.col("y").isNotNull() & (fold(key) != 0))
    chosen = chosen.orderBy(F.xxhash64(key), key, "y").limit(SAMPLE)
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = docs.select(key, text).join(F.broadcast(chosen), key).select(key, "y", raw.alias("raw"))
    rows = sorted((r[key], r["y"], bytes(r["raw"])) for r in rows.collect())
    return fit([r[2] for r in rows], [r[1] for r in rows])


def _scores(texts: pa.Array, net: Network, tables) -> np.ndarray:
    data, at = string_bytes(texts)
    f = np.array([pooled(data[a:b], tables) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.float64).reshape(-1, 2 * FILTERS)
    return 1 / (1 + np.exp(-np.clip(f @ net.a + net.c[0], -30, 30)))


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score``, the probability of label 1."""
    kind = docs.schema[key].dataType.simpleString()
    arrays = (net.w, net.b, net.a, net.c)

    def run(batches):
        own = Network()
        own.w, own.b, own.a, own.c = arrays
        tables = own.tables()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), own, tables))], [key, "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, score double")


def keep(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least the threshold."""
    arrays, at_text = (net.w, net.b, net.a, net.c), docs.columns.index(text)

    def run(batches):
        own = Network()
        own.w, own.b, own.a, own.c = arrays
        tables = own.tables()
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at_text), own, tables) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
