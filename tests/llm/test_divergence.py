"""Divergence of sources against plain sums over all pairs and terms, with small blocks and odd rows."""

import collections
import random
import re

import pytest

from vicinage.llm import divergence

DOCS = "lang string, source string, text string, term string, n int, value double"
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], DOCS)


def plain(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for lang in {r[0] for r in rows}:
        texts = [(s, LETTERS.findall(t.translate(lower))) for l, s, t in rows if l == lang]
        docs = collections.Counter(w for _, ws in texts for w in set(ws))
        kept = [w for w, n in docs.items() if n >= least]
        count = collections.defaultdict(collections.Counter)
        for s, ws in texts:
            count[s].update(w for w in ws if docs[w] >= least)
        total = {s: sum(c.values()) for s, c in count.items()}
        share = lambda n, all_n: 1 + 10**9 * (n + 5) // (all_n + 5 * len(kept))
        p = {s: {w: share(count[s][w], total[s]) for w in kept} for s in count}
        every = collections.Counter()
        for c in count.values():
            every.update(c)
        for s in count:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in count if o != s]
            terms = [(p[s][w] - q, w) for w in kept for q in [share(every[w], sum(total.values()))] if count[s][w] and p[s][w] > q]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, k))
    return sorted(out)


def rows_of(seed, many, words, groups):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)] + ["Éa", "日本", "A", "a"]
    rows = []
    for _ in range(many):
        g = min(r.randrange(groups), r.randrange(groups))
        own = vocabulary[g % 7 :: 3] if r.random() < 0.5 else vocabulary
        rows.append((r.choice(["en", "en", "de", None]), r.choice([f"s{g}", f"s{g}", None, "S"]), " ".join(r.choice(own) + r.choice(["", ",", "1x", "_"]) for _ in range(r.randrange(30)))))
    return rows + [("fr", "alone", "one"), ("fr", None, None), ("", "", "Word word 12 w_w"), ("xx", "é", ""), ("xx", "z", "a b"), ("en", "s0", "wa " * 20_000)]


@pytest.mark.parametrize("block,least,groups", [(256, 3, 12), (4, 3, 30), (3, 8, 30), (256, 10**6, 5)])
def test_audit_equals_plain_sums(spark, monkeypatch, block, least, groups):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TERMS", 5)
    monkeypatch.setattr(divergence, "HELD", 300)
    rows = rows_of(block + least, 400, 60, groups)
    got = sorted(map(tuple, divergence.audit(frame(spark, rows), least, 7).collect()))
    assert got == plain(rows, least, 7)


def test_both_kinds_of_terms_are_used(spark):
    rows = rows_of(1, 400, 60, 30)
    counts, _ = divergence.kept_counts(frame(spark, rows), 3)
    groups = divergence.sources(frame(spark, rows), counts)
    posts, _ = divergence.postings(counts, groups)
    heavy = posts.filter(divergence._is_heavy()).count()
    assert 0 < heavy < posts.count()
    assert divergence.heavy_sums(posts, groups).count() and divergence.both_posted(posts).count() and divergence.one_posted(posts, groups).count()


def test_no_documents(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_query_equals_its_sql(spark, duck, sf_dir):
    got, want = divergence.query(spark, sf_dir), duck.sql(divergence.SQL)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
