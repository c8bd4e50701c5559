"""Byte-level BPE: ids of texts and texts of ids, with the merges folded by Spark's higher-order functions.

A task numbers the distinct words (matches of the tokenizer's pattern) of its documents as they come, and passes each new word
on once, as an array of its bytes' ids, beside the documents as word numbers. Higher-order functions fold the merges over that
array: the pair of lowest rank merges, leftmost first, until no pair has a rank. A second step of the same task puts the
words' ids in place of the numbers. Nothing is shuffled, and a row holds no more than one slab's new words.

The rank map is a literal: of each pair of ids, the rank of the two together. It is a sparse table of rows (left ids) laid over
one another where they do not collide (row displacement), so that a look-up is two array accesses, and the found
cell names its row. Words that are one piece need no fold. Words over LONG_WORD bytes, over which a fold would take quadratic time,
are merged with a heap in the task, in n log n steps; the ids are the same.

Cases: a null or empty text has no ids; texts of any length are encoded whole; repeated rows give equal ids; an empty table
gives an empty table; only the named columns are read, so extra columns cannot clash; a null key stays a null key; a null
list of ids decodes to null.
"""

from __future__ import annotations

import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import SeenPieces, encoded_slabs, read_vocabulary

LONG_WORD = 512
#: Bytes of text whose new words travel in one row; distinct words that a task keeps before it starts anew; words turned into ids at once.
SLAB, WORDS, STEP = 1 << 20, 500_000, 1 << 18
#: Ids are below this; a rank is a cell's lower part, its row the upper.
_ID = 1 << 16
#: Places in a folded word are below this.
_PLACE = 1 << 10


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file."""
    return read_vocabulary(path)[0]


@functools.lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(shift, cells): the rank of ids a, b together is cells[shift[a] + b] - a * _ID if that is in 0.._ID - 1; else they never merge."""
    ranks = read_ranks(path)
    if max(ranks.values()) + 1 >= _ID:
        raise ValueError(f"vocabularies of {_ID - 1} pieces and more do not fit the table")
    rows: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    n, window = max(ranks.values()) + 1, 2048
    free, shift, at, lowest = np.ones(2 * n + window, bool), np.zeros(n, np.int64), {}, 0
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):  # the longest rows first, each in the first place that it fits
        columns = np.array([b for b, _ in rows[a]])
        d = max(0, lowest - int(columns.min()))
        while True:
            while len(free) < d + n + window:
                free = np.concatenate([free, np.ones(n, bool)])
            fits = np.logical_and.reduce([free[d + b : d + b + window] for b in columns.tolist()])
            if fits.any():
                d += int(fits.argmax())
                break
            d += window
        shift[a] = d
        free[columns + d] = False
        at |= {d + b: a * _ID + rank for b, rank in rows[a]}
        if not free[lowest]:
            lowest += int(free[lowest:].argmax())
    cells = np.full(int(shift.max()) + n + 1, n * _ID, np.int64)
    cells[list(at)] = list(at.values())
    return np.append(shift, 0), cells  # id n stands for the end of a word and never merges


def _numbers(values: np.ndarray, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(ids: Column, shift: Column, cells: Column, end: int) -> Column:
    """Ids of one word of at most LONG_WORD bytes, given as its bytes' ids and the id ``end`` after them.

    The state is one array of numbers: of each piece its rank together with the next one (or more than any rank), the place of its
    first byte, and its id. So the least number is the pair to merge, leftmost of equal ranks; a merge changes two numbers and
    removes one.
    """

    def number(a: Column, b: Column, place: Column) -> Column:
        rank = F.get(cells, F.get(shift, a) + b).bitwiseXOR(a.cast("long") * _ID)
        return (rank * _PLACE + place) * _ID + a

    def id_of(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_ID - 1)).cast("int")

    def rank_of(x: Column) -> Column:
        return F.shiftright(x, 26).cast("int")

    def place_of(x: Column) -> Column:
        return F.shiftright(x, 16).bitwiseAND(F.lit(_PLACE - 1))

    def merged(state: Column, p: Column) -> Column:
        """``p``: place of the least number, from 1; the one after it is number p of those from 0."""

        def changed(x: Column, i: Column) -> Column:
            here = number(rank_of(x), id_of(F.get(state, p + 1)), place_of(x))
            before = number(id_of(x), rank_of(F.get(state, p - 1)), place_of(x))
            return F.when(i > p, x).when(i + 2 < p, x).when(i == p, F.lit(-1).cast("long")).when(i + 1 == p, here).otherwise(before)

        return F.array_remove(F.transform(state, changed), F.lit(-1).cast("long"))

    def step(state: Column, _: Column) -> Column:
        found = _let(F.array_position(state, F.array_min(state)).cast("int"), lambda p: merged(state, p))
        return F.when(F.array_min(state) < _ID * _ID * _PLACE, found).otherwise(state)

    start = F.transform(ids, lambda x, i: number(x, F.coalesce(F.get(ids, i + 1), F.lit(end)), i))
    steps = F.sequence(F.lit(1), F.greatest(F.size(ids) - 2, F.lit(1)))
    return F.array_remove(F.aggregate(steps, start, step, lambda state: F.transform(state, id_of)), F.lit(end))


def merge_with_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word in n log n steps."""
    n = len(word)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(word[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[after[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Numbered(dict):
    """Numbers of words in order of appearance; ``fresh`` lists those that are new since the last row."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def _as_words(df: DataFrame, key: str, text: str, pattern: str, ranks: dict[bytes, int], end: int) -> DataFrame:
    """Per document its key and the numbers of its words (``numbers``, four bytes each), with the ``fresh`` words of a slab in
    the slab's first row: bytes' ids, or for a word that needs no fold its ids. Numbers start anew in each ``epoch``."""
    kind = df.schema[key].dataType.simpleString()
    of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def words_of(fresh: list[str]) -> pa.Array:
        raw = [w.encode() for w in fresh]
        ids = [[ranks[w]] if w in ranks else merge_with_heap(w, ranks) if len(w) > LONG_WORD else None for w in raw]
        folded = [w if i is None else b"" for w, i in zip(raw, ids)]
        ends = np.cumsum([0, *map(len, folded)])
        parts = np.insert(of_byte[np.frombuffer(b"".join(folded), np.uint8)], ends[1:], end)  # the end after each word
        parts = pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(parts))
        return pa.StructArray.from_arrays([parts, pa.array(ids, pa.list_(pa.int32()))], ["parts", "ids"])

    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        number, seen, epoch = _Numbered(), SeenPieces(), 0

        def numbers_of(piece: str):
            plain = piece.isascii() and (piece[1:] if piece[0] == " " else piece).isalpha()  # one word, without a search
            return (number[piece],) if plain else map(number.__getitem__, find(piece))

        for batch in batches:
            for row, numbers, at in encoded_slabs(batch.column(1), numbers_of, seen=seen, limit=SLAB):
                n = len(at) - 1
                fresh = pa.ListArray.from_arrays(pa.array([0, *[len(number.fresh)] * n], pa.int32()), words_of(number.fresh))
                held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.full(n, epoch, np.int32)), held, fresh], ["key", "epoch", "numbers", "fresh"])
                number.fresh = []
                if len(number) > WORDS:
                    number.clear()
                    seen.clear()
                    epoch += 1

    return df.select(key, text).mapInArrow(run, f"key {kind}, epoch int, numbers binary, fresh array<struct<parts:array<int>,ids:array<int>>>")


def _joined(ids: np.ndarray, at: list[int], pieces: list[bytes]) -> pa.Array:
    """The pieces of each list of ids, one after the other."""
    return pa.array([b"".join(map(pieces.__getitem__, ids[a:b].tolist())) for a, b in zip(at, at[1:])], pa.binary())


def _pieces(path: str) -> list[bytes]:
    by_rank = {rank: piece for piece, rank in read_ranks(path).items()}
    return [by_rank.get(r, b"") for r in range(max(by_rank) + 1)]


def _as_ids(words: DataFrame, key: str, kind: str, as_bytes: bool, decoded: str | None, pieces: list[bytes]) -> DataFrame:
    """Key and ids of each document, the words' ids in the place of their numbers. Rows of a task come in the order made."""

    def lists(ends: np.ndarray, ids: np.ndarray) -> pa.Array:
        if as_bytes:
            return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(ids.astype("<u4"))])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))

    names = [key, "ids"] + ([decoded] if decoded else [])

    def run(batches):
        epoch, flat, begin, size = -1, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            of, (_, offsets, data) = batch.column(1).to_numpy(), batch.column(2).buffers()
            at = np.frombuffer(offsets, np.int32, len(of) + 1, batch.column(2).offset * 4) // 4
            numbers = np.frombuffer(data, np.int32) if at[-1] else np.zeros(0, np.int32)
            cuts = {0, len(of), *(np.flatnonzero(np.diff(of)) + 1).tolist(), *np.searchsorted(at, range(at[0] + STEP, at[-1], STEP)).tolist()}
            for a, b in itertools.pairwise(sorted(cuts)):  # rows of one epoch, of about STEP words
                if of[a] != epoch:
                    epoch, flat, begin, size = of[a], flat[:0], begin[:0], size[:0]
                fresh = batch.column(3).slice(a, b - a).flatten()
                many = np.asarray(fresh.value_lengths(), np.int64)
                begin = np.concatenate([begin, len(flat) + np.cumsum(many) - many])
                size, flat = np.concatenate([size, many]), np.concatenate([flat, np.asarray(fresh.flatten())])
                number = numbers[at[a] : at[b]]
                count = size[number]
                total = np.concatenate([[0], np.cumsum(count)])
                ids = flat[np.repeat(begin[number] - total[:-1], count) + np.arange(total[-1])]
                ends = total[at[a : b + 1] - at[a]].astype(np.int32)
                made = [batch.column(0).slice(a, b - a), lists(ends, ids)]
                yield pa.RecordBatch.from_arrays(made + ([_joined(ids, ends.tolist(), pieces)] if decoded else []), names)

    return words.mapInArrow(run, f"`{key}` {kind}, ids {'binary' if as_bytes else 'array<int>'}" + (f", `{decoded}` binary" if decoded else ""))


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", as_bytes: bool = False, decoded: str | None = None) -> DataFrame:
    """Key and ``ids`` of each row's text. ``path``: a vocabulary file; ``pattern``: what is a word; ``as_bytes``: ids as unsigned
    32-bit little-endian integers in one binary, not as an array; ``decoded``: the name of a further column, of the bytes that
    the ids decode to."""
    ranks = read_ranks(path)
    shift, cells = pair_table(path)
    end = len(shift) - 1
    words = _as_words(df, key, text, pattern, ranks, end)
    fold = lambda s, c: F.transform("fresh", lambda w: F.when(w["ids"].isNotNull(), w["ids"]).otherwise(fold_merges(w["parts"], s, c, end)))
    fresh = _let(_numbers(shift, "int"), lambda s: _let(_numbers(cells, "bigint"), lambda c: fold(s, c)))
    return _as_ids(words.select("key", "epoch", "numbers", fresh.alias("fresh")), key, df.schema[key].dataType.simpleString(), as_bytes, decoded, _pieces(path))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes of the ids' pieces, one after the other."""
    pieces = _pieces(path)

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        ends = np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
        made = _joined(lists.flatten().to_numpy(), ends.tolist(), pieces)
        return pc.if_else(lists.is_valid(), made, pa.scalar(None, pa.binary()))

    return df.withColumn(out, joined(F.col(ids)))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = encode(docs, path, public_tokenizers.PATTERN, as_bytes=True, decoded="decoded")
    return ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
