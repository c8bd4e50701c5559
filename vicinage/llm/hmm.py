"""Hidden Markov language model of word sequences, with Baum-Welch training over all training documents.

A text is its words, with A-Z in lower case, and one end. Every word type belongs to a class: the most frequent words and the
end are classes of their own, all other words share classes by their last bytes. A state emits a class, the class its word:

    P(text) = sum over state paths of the product of P(state | state before) * P(class | state) * P(word | class).

P(word | class) comes from the counts of all training words, half of a class's singletons' mass standing for unseen words. The
other probabilities come from Baum-Welch: expected counts of windows of the sequences, which cover every training token,
are summed in each task and then across tasks. Moves from one window to the next are not counted, one in WINDOW; a
window starts from the states' shares instead. The likelihood of a text is exact: a scaled forward recursion over the whole.

Cases: a null or empty text is its end alone; texts of any length are scored whole; a row that is there twice gives the same
result twice, and rows of one key with different texts are scored each; rows with a null key are scored and not trained on,
and count as held out; an empty table gives an empty table; without training documents all counts are 0 and the model is uniform; only the key and text columns are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .textbytes import lowered, mix64, slabs, span_hashes, word_spans

#: Words that are classes of their own; classes of the other words; states; passes of Baum-Welch; tokens of a window.
TOP, SHAPES, STATES, PASSES, WINDOW = 1500, 1024, 8, 4, 128
_END = TOP + SHAPES
CLASSES = _END + 1


def held_out(key: str):
    """Whether the key's crc32 leaves 1 on division by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1


def _trains(keys: list) -> np.ndarray:
    return np.array([k is not None and zlib.crc32(str(k).encode()) % 5 != 1 for k in keys], bool)


def shape_class(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class of words that are no classes of their own, from their last three bytes."""
    code = np.zeros(len(start), np.uint64)
    for j in (1, 2, 3):
        at = end - j
        code = code * np.uint64(257) + np.where(at >= start, data[np.maximum(at, 0)], 256).astype(np.uint64)
    return TOP + (mix64(code) % np.uint64(SHAPES)).astype(np.int64)


class _Words:
    """The most frequent words by hash, to find the classes of a buffer's words."""

    def __init__(self, top: list[bytes]):
        data = np.frombuffer(b"".join(top), np.uint8)
        ends = np.cumsum([len(w) for w in top]).astype(np.int64)
        starts = ends - np.array([len(w) for w in top], np.int64)
        h = span_hashes(data, starts, ends)
        self.number = np.argsort(h)
        self.hashes = h[self.number]

    def classes(self, data, start, end, h) -> np.ndarray:
        out = shape_class(data, start, end)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            out[hit] = self.number[at[hit]]
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of the training documents and how often they occur."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, data, at in slabs(batch.column(1)):
                data = lowered(data)
                start, end, doc = word_spans(data, at)
                use = _trains(keys[row : row + len(at) - 1])[doc]
                start, end = start[use], end[use]
                _, first, n = np.unique(span_hashes(data, start, end), return_index=True, return_counts=True)
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n)], ["word", "n"])

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _class_sums(counts: DataFrame, top: list[bytes]) -> DataFrame:
    """(class, total, once) of the shared classes: tokens, and words that occur once."""

    def run(batches):
        words = _Words(top)
        for batch in batches:
            for row, data, at in slabs(batch.column(0)):
                n = batch.column(1).slice(row, len(at) - 1).to_numpy(zero_copy_only=False)
                c = words.classes(data, at[:-1], at[1:], span_hashes(data, at[:-1], at[1:]))
                total, once = np.bincount(c, n, CLASSES), np.bincount(c, n == 1, CLASSES)
                k = np.flatnonzero(total)
                k = k[k >= TOP]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k].astype(np.int64)), pa.array(once[k].astype(np.int64))], ["class", "total", "once"])

    return counts.select("word", "n").mapInArrow(run, "class long, total long, once long").groupBy("class").agg(F.sum("total").alias("total"), F.sum("once").alias("once"))


def _rare_words(docs: DataFrame, top: list[bytes]) -> DataFrame:
    """(word, class, rows): words of shared classes, and the rows of a slab in which they occur, once per occurrence."""

    def run(batches):
        words = _Words(top)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, at in slabs(batch.column(1)):
                data = lowered(data)
                start, end, doc = word_spans(data, at)
                h = span_hashes(data, start, end)
                c = words.classes(data, start, end, h)
                rare = np.flatnonzero(c >= TOP)
                order = rare[np.argsort(h[rare], kind="stable")]
                first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(order) else order
                raw, one = data.tobytes(), order[first]
                found = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
                owners = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(ids[row + doc[order]], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(c[one]), owners], ["word", "class", "rows"])

    return docs.select("row", "text").mapInArrow(run, "word binary, class long, rows array<long>")


def _with_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (id, text) with ``row``, which tells rows apart: the id where it is one row's alone, else a hash of id and text;
    and (row, copies) of those that several equal rows share."""
    repeated = docs.groupBy("id").count().filter("count > 1 or id is null").select("id", F.lit(True).alias("shared"))
    repeated = tables.written(repeated, "repeated")[0].withColumnRenamed("id", "again")
    if not repeated.take(1):
        return docs.withColumn("row", F.col("id")), docs.sparkSession.createDataFrame([], "row long, copies long")
    found = docs.join(tables.small(repeated), F.col("id").eqNullSafe(F.col("again")), "left")
    found = found.select("id", "text", F.when(F.col("shared"), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("row"), "shared")
    copies = found.filter("shared").groupBy("row").agg(F.count("*").alias("copies")).filter("copies > 1")
    return found.drop("shared"), tables.written(copies, "copies")[0]


def _sequences(docs: DataFrame, top: list[bytes], terms: np.ndarray) -> DataFrame:
    """(row, id, n_words, classes, base, known): the classes of each text's tokens, and what its frequent words and its end add to the base score."""

    def run(batches):
        words = _Words(top)
        for batch in batches:
            for row, data, at in slabs(batch.column(2)):
                data, n = lowered(data), len(at) - 1
                start, end, doc = word_spans(data, at)
                c = words.classes(data, start, end, span_hashes(data, start, end))
                many = np.bincount(doc, minlength=n)
                base = np.bincount(doc, np.where(c < TOP, terms[np.minimum(c, TOP)], 0.0), n) + terms[TOP]
                known = np.bincount(doc, c < TOP, n).astype(np.int64)
                out = np.full(len(c) + n, _END, np.uint16)
                out[np.arange(len(c)) + doc] = c
                bounds = np.concatenate([[0], np.cumsum(many + 1)]).tolist()
                seqs = [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, n) for i in (0, 1)), pa.array(many), pa.array(seqs, pa.binary()), pa.array(base), pa.array(known)], ["row", "id", "n_words", "classes", "base", "known"])

    return docs.select("row", "id", "text").mapInArrow(run, "row long, id long, n_words long, classes binary, base double, known long")


# --- the model -------------------------------------------------------------------------------------------------------


def first_model(freq: np.ndarray, states: int = STATES, seed: int = 11) -> dict[str, np.ndarray]:
    """States that tend to last, with emissions near the classes' frequencies."""
    rng = np.random.default_rng(seed)
    emit = freq * np.exp(rng.normal(0, 0.7, (states, len(freq))))
    move = np.full((states, states), 0.2 / max(1, states - 1)) + np.eye(states) * (0.8 - 0.2 / max(1, states - 1))
    return {"start": np.full(states, 1 / states), "inside": np.full(states, 1 / states), "move": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True)}


def windows(seqs: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (window, position), lengths, and whether a window starts its text; together they hold every token once."""
    out, first = [], []
    for s in seqs:
        x = np.frombuffer(s, np.uint16)
        for a in range(0, len(x), length):
            out.append(x[a : a + length])
            first.append(a == 0)
    lengths = np.array([len(x) for x in out], np.int64)
    order = np.argsort(-lengths, kind="stable")
    obs = np.zeros((len(out), length), np.int64)
    for k, i in enumerate(order.tolist()):
        obs[k, : len(out[i])] = out[i]
    return obs, lengths[order], np.array(first, bool)[order]


def expected_counts(seqs: list[bytes], model: dict[str, np.ndarray]) -> np.ndarray:
    """Expected starts, window starts, moves and emissions, flattened one after the other (scaled forward-backward)."""
    obs, lengths, first = windows(seqs)
    k, n_classes = model["emit"].shape
    start, inside, move, emit = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((n_classes, k))
    by_class = np.ascontiguousarray(model["emit"].T)
    for a in range(0, len(obs), 4096):
        o, n, f = obs[a : a + 4096], lengths[a : a + 4096], first[a : a + 4096]
        longest = int(n[0])
        live = [int(np.searchsorted(-n, -t, "left")) for t in range(longest)]  # windows longer than t come first
        alpha, scale, seen = [], [], []
        for t in range(longest):
            m = live[t]
            e = by_class[o[:m, t]]
            x = (np.where(f[:m, None], model["start"], model["inside"]) if t == 0 else alpha[-1][:m] @ model["move"]) * e
            c = x.sum(1, keepdims=True)
            alpha.append(x / c)
            scale.append(c)
            seen.append(e)
        beta = np.ones((live[-1], k))
        for t in range(longest - 1, -1, -1):
            m = live[t]
            if len(beta) < m:
                beta = np.concatenate([beta, np.ones((m - len(beta), k))])
            gamma = alpha[t] * beta
            for s in range(k):
                emit[:, s] += np.bincount(o[:m, t], gamma[:, s], n_classes) if m > n_classes // 8 else 0
            if m <= n_classes // 8:
                np.add.at(emit, o[:m, t], gamma)
            if t:
                ahead = beta * seen[t] / scale[t]
                move += alpha[t - 1][:m].T @ ahead
                beta = ahead @ model["move"].T
            else:
                start += gamma[f].sum(0)
                inside += gamma.sum(0)
    return np.concatenate([start, inside, (move * model["move"]).ravel(), emit.ravel()])


def next_model(counts: np.ndarray, freq: np.ndarray, states: int) -> dict[str, np.ndarray]:
    """The model of the expected counts, smoothed a little so that nothing is impossible."""
    a, b, c = states, 2 * states, 2 * states + states * states
    emit = counts[c:].reshape(-1, states).T + freq
    start, inside, move = counts[:a] + 0.1, emit.sum(1), counts[b:c].reshape(states, states) + 0.1
    return {"start": start / start.sum(), "inside": inside / inside.sum(), "move": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True)}


def log_likelihoods(seqs: list[bytes], model: dict[str, np.ndarray]) -> np.ndarray:
    """Natural logarithms of the exact probabilities of whole class sequences."""
    lengths = np.array([len(s) // 2 for s in seqs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(seqs[i] for i in order), np.uint16)
    n = lengths[order]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    by_class, total = np.ascontiguousarray(model["emit"].T), np.zeros(len(n))
    alpha, ends, m = None, -n, len(n)
    for t in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(ends, -t, "left"))
        e = by_class[flat[begin[:m] + t]]
        alpha = (model["start"] if t == 0 else alpha[:m] @ model["move"]) * e
        c = alpha.sum(1)
        total[:m] += np.log(c)
        alpha /= c[:, None]
    out = np.empty(len(n))
    out[order] = total
    return out


def baum_welch(sequences: DataFrame, freq: np.ndarray, passes: int = PASSES, states: int = STATES) -> dict[str, np.ndarray]:
    """Train on the training documents' sequences. What reaches the driver in a pass is one model's worth of sums."""
    model = first_model(freq, states)
    size = 2 * states + states * states + states * len(freq)
    for _ in range(passes):

        def run(batches, model=model):
            total = np.zeros(size)
            for batch in batches:
                seqs = batch.column(0).to_pylist()
                for a in range(0, len(seqs), 1024):
                    total += expected_counts(seqs[a : a + 1024], model)
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "x"])

        sums = sequences.filter("not held_out").select("classes").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
        counts = np.zeros(size)
        counts[[r["k"] for r in sums]] = [r["x"] for r in sums]
        model = next_model(counts, freq, states)
    return model


def fit_and_score(df: DataFrame, key: str = "doc_id", text: str = "text", passes: int = PASSES, states: int = STATES) -> DataFrame:
    """One row per text: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    counts, counts_path = tables.written(word_counts(docs), "words")
    some = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = docs.filter(F.col("id").isNotNull() & ~held_out("id")).count()
    n_tokens, n_types = some["n"] + ends, some["v"] + (1 if ends else 0)
    best = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(TOP).collect()]
    top = [w for w, _ in best]
    shared = {r["class"]: (r["total"], r["once"]) for r in _class_sums(counts, top).collect()}  # SHAPES rows at most

    # Base terms of the frequent words and, last, of the end.
    c = np.array([n for _, n in best] + [0] * (TOP - len(best)) + [ends], np.float64)
    base_terms = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
    freq = np.full(CLASSES, 0.01)
    freq[: len(best)] += [n for _, n in best]
    freq[_END] += ends
    for k, (total, _) in shared.items():
        freq[k] += total
    freq /= freq.sum()

    flag = F.coalesce(held_out("id"), F.lit(True))
    docs, copies = _with_rows(docs)
    sequences, sequences_path = tables.written(_sequences(docs, top, base_terms).withColumn("held_out", flag), "sequences")
    model = baum_welch(sequences, freq, passes, states)

    classes = spark.createDataFrame([(k, *map(float, shared.get(k, (0, 0)))) for k in range(TOP, _END)], "class long, total double, once double")
    n = F.coalesce("n", F.lit(0)).cast("double")
    share = F.when(n == 0, (F.col("once") + 1) / 2).when(n == 1, F.lit(0.5)).otherwise(n) / (F.col("total") + 0.5)
    rare = _rare_words(docs, top).join(counts, "word", "left").join(F.broadcast(classes), "class")
    rare = rare.select(
        F.log10((n + 0.5) / F.lit(n_tokens + 0.5 * (n_types + 1))).alias("rare_base"),
        F.log10(share).alias("rare_score"),
        (n > 0).cast("long").alias("rare_known"),
        F.explode("rows").alias("row"),
    )
    sums = rare.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("rare_base", "rare_score", "rare_known")])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(6)], pa.array(log_likelihoods(batch.column(6).to_pylist(), model) / math.log(10))], ["row", "id", "n_words", "base", "known", "held_out", "path"])

    scored = sequences.select("row", "id", "n_words", "base", "known", "held_out", "classes").mapInArrow(run, "row long, id long, n_words long, base double, known long, held_out boolean, path double")
    one = lambda x: F.coalesce(F.col(x) / F.coalesce("copies", F.lit(1)), F.lit(0))  # noqa: E731  # equal rows share one sum
    return scored.join(sums, "row", "left").join(tables.small(copies), "row", "left").select(
        F.col("id").alias(key),
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + one("rare_known").cast("long") + (1 if ends else 0)).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + one("rare_base")).alias("base_score"),
        (F.col("path") + one("rare_score")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
