"""Importance resampling against a plain computation, and its merge of runs against sorting."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinage.llm import resample

DOCS = "doc_id long, text string, score string, rank int, n_words double"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], DOCS)


def plain_features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(rows, target, percent=25, least=20):
    s, t = (collections.Counter(b for x in texts for b in plain_features(x)[1]) for texts in ([x for _, x in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for i, text in rows:
        n, found = plain_features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


ODD = [(None, "a b " * 30), (None, None), (5_000, ""), (5_001, "ÉA é É 日本 x1 _y" * 9), (5_002, "a" * 5000 + " b " + "c" * 200 + " d" * 30), (5_003, "word " * 50_000), (5_004, "!!! ..."), (5_005, "A b-C  d\te\nf" * 20)]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("range_rows,block_rows", [(1 << 16, 1 << 12), (10, 3), (1, 1)])
def test_draw_equals_plain_computation(spark, documents, monkeypatch, range_rows, block_rows):
    monkeypatch.setattr(resample, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(resample, "BLOCK_ROWS", block_rows)
    rows = documents + ODD + documents[:30]
    target = [t for _, t in documents[::9]] + [None, ""]
    got = resample.sample(frame(spark, rows).repartition(7), frame(spark, list(enumerate(target))))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, target)


def test_query_draws_the_stated_share(spark, sf_dir):
    rows = resample.query(spark, sf_dir).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(map(tuple, rows), key=str) == plain(docs, target)


def test_few_rows_and_none(spark):
    three = [(i, "a b " * 30) for i in range(3)]
    assert [r.rank for r in resample.sample(frame(spark, three), frame(spark, [])).collect()] == [None] * 3
    assert sorted(map(tuple, resample.sample(frame(spark, three), frame(spark, three)).collect())) == plain(three, [t for _, t in three])
    assert resample.sample(frame(spark, []), frame(spark, three)).count() == 0


def test_many_equal_scores_and_other_keys(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", 8)
    monkeypatch.setattr(resample, "BLOCK_ROWS", 4)
    rows = spark.createDataFrame([(f"k{i % 40:02d}", 30, 59, 5, 100 + i % 3) for i in range(400)], "doc_id string, n_words long, n_features long, weight long, score long").repartition(5)
    got = resample.drawn(rows).filter("rank is not null").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 101))
    assert [(r.score, r.doc_id) for r in got] == sorted(((r.score, r.doc_id) for r in rows.collect()), key=lambda x: (-x[0], x[1]))[:100]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40), max_size=9), st.integers(1, 7), st.integers(0, 200))
def test_merge_equals_sorting(runs, size, stop):
    blocks = [sorted(run)[k : k + size] for run in runs for k in range(0, len(run), size)]
    merge = resample.Merge(sorted(blocks, key=lambda b: b[0]))
    want = sorted(x for run in runs for x in run)
    got = []
    for _ in range(min(stop, len(want))):
        got.append(merge.next())
        assert len(merge.held) <= len(runs)
    assert got == want[:stop] and sorted(merge.rest()) == want[stop:]
    assert stop < len(want) or merge.next() is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB1é \n_日")), max_size=8), st.integers(1, 6))
def test_checksums_equal_the_library(texts, short):
    before, resample.SHORT_WORD = resample.SHORT_WORD, short
    try:
        got = collections.Counter((row + int(d), int(b)) for row, _, _, doc, bucket in resample.features(pa.array(texts, pa.string())) for d, b in zip(doc, bucket))
    finally:
        resample.SHORT_WORD = before
    assert got == collections.Counter((i, b) for i, t in enumerate(texts) for b in plain_features(t)[1])


def test_ranges_hold_the_draw_exactly():
    r = random.Random(3)
    for _ in range(200):
        counts = [(s, r.randrange(1, 50)) for s in r.sample(range(-100, 100), r.randrange(0, 30))]
        all_rows = sum(n for _, n in counts)
        draw, rows = r.randrange(0, all_rows + 1), r.randrange(1, 100)
        ranges = resample.score_ranges(counts, draw, rows)
        assert sum(take for *_, take in ranges) == draw
        assert [b for _, b, _ in ranges] == list(np.cumsum([0, *[t for *_, t in ranges]])[:-1].astype(int))[: len(ranges)]
