"""Audit of how the sources of each language differ in their words: exact distances of all pairs of sources, and each source's own terms.

A term is a run of letters A-Z, a-z and characters beyond ASCII, with only A-Z lower-cased. A language keeps the terms of at least
``least`` of its documents. Shares are whole billionths, smoothed, so that all sums are exact integers.

Pairs of sources by a heavy-light split of the kept terms. A term that a quarter of the language's sources have is heavy: its shares
in blocks of sources are a column of a dense tile, and tiles are compared in numpy, one pair of blocks at a time. Other terms are
light: a source without the term has its base share there, so a pair's sum is the number of light terms times the distance of base
shares, plus corrections of one source's postings against the other's base share, plus corrections where both have postings.

Cases: null texts, languages and sources count as empty strings; texts of any length are read whole; repeated rows are documents of
their own; ties of values go by the bytes of the item; a language without kept terms has distances of 0 and no terms; an empty
table gives no rows. Only the three named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tables
from .textbytes import lowered, runs, slabs

#: Documents that a kept term needs; smoothing; ranks of a source's own terms.
LEAST_DOCS, SMOOTH, TOP_TERMS = 30, 5, 50
#: Sources of a block; terms that are subtracted at once; shares of the heavy terms of a pair of blocks.
BLOCK, TERMS, SALTS = 256, 512, 16
#: Counts of a task go on when it holds so many, so do its corrections.
HELD = 400_000

_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def _slab_counts(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> pa.Table | None:
    """(g, term, n, df) of the texts of a slab, whose groups are numbers."""
    inside = _TERM[data]
    start, end, doc = runs(inside, at)
    if not len(start):
        return None
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(lowered(data)[inside])])
    coded = words.dictionary_encode()
    codes, k = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    pair, n = np.unique(doc * k + codes, return_counts=True)
    key, back = np.unique(group[pair // k] * k + pair % k, return_inverse=True)
    total = np.bincount(back, n, len(key)).astype(np.int64)
    return pa.table({"g": key // k, "term": coded.dictionary.take(pa.array(key % k)), "n": total, "df": np.bincount(back, minlength=len(key))})


def _combined(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(["g", "term"]).aggregate([("n", "sum"), ("df", "sum")])
    return sums.rename_columns([c.removesuffix("_sum") for c in sums.column_names])


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents, summed within tasks (a key has a row for each task or more)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        parts, rows = [], 0

        def out(table: pa.Table):
            names = list(groups)
            at = table["g"].to_numpy()
            columns = [pa.array([names[i][c] for i in at.tolist()], pa.string()) for c in (0, 1)]
            whole = pa.table([*columns, table["term"].cast(pa.string()), table["n"], table["df"].cast(pa.int64())], ["lang", "source", "term", "n", "df"])
            return whole.combine_chunks().to_batches(max_chunksize=50_000)

        for batch in batches:
            number = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            for row, data, at in slabs(batch.column(2)):
                found = _slab_counts(data, at, number[row : row + len(at) - 1])
                if found is None:
                    continue
                parts.append(found)
                rows += len(found)
                if rows > HELD:
                    parts = [_combined(parts)]
                    rows = len(parts[0])
                    if rows > HELD // 2:
                        yield from out(parts[0])
                        parts, rows = [], 0
        if parts:
            yield from out(_combined(parts))

    empty = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, df long")


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exact."""
    whole = (kept * SMOOTH + total).cast("decimal(25,0)")
    return F.when(kept > 0, F.expr("1") + F.call_function("div", (n + SMOOTH).cast("decimal(25,0)") * F.lit(10**9).cast("decimal(10,0)"), whole))


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS, **columns: str) -> tuple[DataFrame, str]:
    """(lang, source, term, n) of the terms that each language keeps, as a written table, and its path."""
    # Sums of tasks meet once, dealt by language and term; both groupings below are finer.
    sums = term_counts(docs, **columns).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    docs_with = F.sum("df").over(Window.partitionBy("lang", "term"))
    return tables.written(sums.withColumn("docs", docs_with).filter(F.col("docs") >= least).select("lang", "source", "term", "n"), "kept-terms")


def sources(docs: DataFrame, counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, g, total, kept, size, base): every group, its number in its language, its occurrences of kept terms, the kept
    terms and the groups of the language, and the share of a term that the group does not have."""
    seen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    kept = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    rows = seen.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept"])
    rows = rows.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    return tables.kept(rows.withColumn("base", _share(F.lit(0), F.col("total"), F.col("kept"))))


def postings(counts: DataFrame, groups: DataFrame) -> tuple[DataFrame, str]:
    """(lang, term, n, size, at): a row for each kept term, its occurrences in the language, and the groups that have it with their shares
    (g, p, base); as a written table, and its path."""
    rows = counts.join(tables.small(groups), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
    found = rows.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.first("size").alias("size"), F.collect_list(F.struct("g", "p", "base", "source")).alias("at"))
    return tables.written(found, "postings")


# --- pairs of sources ------------------------------------------------------------------------------------------------


def _is_heavy() -> Column:
    return (F.size("at") * 4 >= F.col("size")) & (F.size("at") > 1)


def blocks_of(groups: DataFrame) -> DataFrame:
    """(lang, block, bases): base shares of each block of sources, in order of their numbers."""
    rows = groups.filter("kept > 0").withColumn("block", F.floor(F.col("g") / BLOCK).cast("int"))
    return rows.groupBy("lang", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "base"))), lambda x: x["base"]).alias("bases"))


def heavy_sums(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, s), a < b: distances over heavy terms, in parts. A pair of blocks of sources is a key, in SALTS shares by term; each
    share gets the base shares first and then a column for each term, and holds one tile of sums at a time."""
    blocks = blocks_of(groups)
    one, two = (blocks.select("lang", F.col("block").alias(c), F.col("bases").alias(f"base_{c}")) for c in "ij")
    none = F.array().cast("array<struct<g:int,p:bigint>>")
    base = one.join(two, "lang").filter("i <= j").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("lang", "i", "j", "salt", F.lit(0).alias("kind"), "base_i", "base_j", none.alias("at"))
    last = F.floor((F.col("size") - 1) / BLOCK).cast("int")
    heavy = posts.filter(_is_heavy()).withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("j", F.explode(F.sequence(F.col("i"), last)))
    in_blocks = F.filter("at", lambda x: F.floor(x["g"] / BLOCK).isin(F.col("i"), F.col("j")))
    own = F.transform(in_blocks, lambda x: F.struct(x["g"].cast("int").alias("g"), x["p"].alias("p")))
    no_bases = F.array().cast("array<bigint>")
    terms = heavy.select("lang", "i", "j", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), no_bases.alias("base_i"), no_bases.alias("base_j"), own.alias("at"))
    key = ["lang", "i", "j", "salt"]
    rows = base.unionByName(terms).repartition(*key).sortWithinPartitions(*key, "kind")

    def run(batches):
        now, bases, held, total = None, (), [], None

        def add():
            """The held terms as two tiles, whose distances are added."""
            (x, y), (i, j) = ([np.repeat(b[None], len(held), 0) for b in bases], now[1:3])
            sizes = np.array([len(h) for h in held])
            term, flat = np.repeat(np.arange(len(held)), sizes), [e for h in held for e in h]
            g, p = np.array([e["g"] for e in flat], np.int64), np.array([e["p"] for e in flat], np.int64)
            for tile, block in ((x, i), (y, j)):
                use = g // BLOCK == block
                tile[term[use], g[use] - block * BLOCK] = p[use]
            for row in range(x.shape[1]):
                total[row] += np.abs(y - x[:, row : row + 1]).sum(0)
            held.clear()

        def out():
            if held:
                add()
            lang, i, j = now[:3]
            a, b = np.nonzero(total)
            a, b, s = a + i * BLOCK, b + j * BLOCK, total[a, b]
            use = a < b  # within a block each pair stands twice
            return pa.RecordBatch.from_arrays([pa.array([lang] * int(use.sum()), pa.string()), pa.array(a[use]), pa.array(b[use]), pa.array(s[use])], ["lang", "a", "b", "s"])

        for batch in batches:
            for lang, i, j, salt, kind, base_i, base_j, at in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if now is not None:
                        yield out()
                    now, bases = (lang, i, j, salt), (np.array(base_i, np.int64), np.array(base_j, np.int64))
                    total = np.zeros((len(base_i), len(base_j)), np.int64)
                else:
                    held.append(at)
                    if len(held) == TERMS:
                        add()
        if now is not None:
            yield out()

    return rows.mapInArrow(run, "lang string, a long, b long, s long")


def both_posted(posts: DataFrame) -> DataFrame:
    """(lang, a, b, s), a < b: corrections of light terms for pairs of groups that both have the term, summed within tasks."""
    light = posts.filter(~_is_heavy() & (F.size("at") > 1)).select("lang", F.transform("at", lambda x: F.struct(x["g"].alias("g"), x["p"].alias("p"), x["base"].alias("base"))).alias("at"))

    def run(batches):
        langs: dict[str, int] = {}
        parts, rows = [], 0

        def summed():
            keys, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            keys, back = np.unique(keys, axis=0, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back.ravel(), value)
            return keys, total

        def out(keys, total):
            names = list(langs)
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in keys[:, 0].tolist()], pa.string()), pa.array(keys[:, 1]), pa.array(keys[:, 2]), pa.array(total)], ["lang", "a", "b", "s"])

        for batch in batches:
            lang = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], np.int64)
            at = batch.column(1)
            sizes = np.diff(at.offsets.to_numpy())
            flat = at.flatten()
            first = np.cumsum(sizes) - sizes
            g, p, base = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            for m in np.unique(sizes):
                terms = np.flatnonzero(sizes == m)
                step = max(1, HELD // max(1, m * (m - 1) // 2))
                x, y = np.triu_indices(m, 1)
                for k in range(0, len(terms), step):
                    some = terms[k : k + step]
                    u, v = (first[some][:, None] + x).ravel(), (first[some][:, None] + y).ravel()
                    value = np.abs(p[u] - p[v]) - np.abs(p[u] - base[v]) - np.abs(base[u] - p[v]) + np.abs(base[u] - base[v])
                    parts.append((np.stack([np.repeat(lang[some], len(x)), np.minimum(g[u], g[v]), np.maximum(g[u], g[v])], 1), value))
                    rows += len(value)
                    if rows > HELD:
                        parts = [summed()]
                        rows = len(parts[0][0])
                        if rows > HELD // 2:
                            yield out(*parts[0])
                            parts, rows = [], 0
        if parts:
            yield out(*summed())

    return light.mapInArrow(run, "lang string, a long, b long, s long")


def one_posted(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, s), a < b: corrections of one group's postings of light terms against the other's base share. Equal shares of a group
    are counted together; a sum of distances to a base share comes from prefix sums over the ordered shares."""
    light = posts.filter(~_is_heavy()).select("lang", F.explode("at").alias("x")).groupBy("lang", "x.g", "x.p", "x.base").agg(F.count(F.lit(1)).alias("m"))
    of = light.groupBy("lang", "g", "base").agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("ps"))
    rows = of.join(blocks_of(groups), "lang").select("lang", "g", "base", "ps", "block", "bases")

    def run(batches):
        for batch in batches:
            for lang, g, base, ps, block, bases in zip(*(c.to_pylist() for c in batch.columns)):
                p, m = np.array([e["p"] for e in ps], np.int64), np.array([e["m"] for e in ps], np.int64)
                below, weight = np.concatenate([[0], np.cumsum(m * p)]), np.concatenate([[0], np.cumsum(m)])
                x = np.array(bases, np.int64)
                k = np.searchsorted(p, x, "right")
                s = x * weight[k] - below[k] + (below[-1] - below[k]) - x * (weight[-1] - weight[k]) - weight[-1] * np.abs(base - x)
                other = block * BLOCK + np.arange(len(x))
                use = (other != g) & (s != 0)
                a, b = np.minimum(other, g)[use], np.maximum(other, g)[use]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(s[use])], ["lang", "a", "b", "s"])

    return rows.mapInArrow(run, "lang string, a long, b long, s long")


def pair_distances(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each group every other group of its language, and the sum over kept terms of the distance of
    their shares."""
    parts = heavy_sums(posts, groups).unionByName(both_posted(posts)).unionByName(one_posted(posts, groups))
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("s").alias("s"))
    light = posts.filter(~_is_heavy()).groupBy("lang").agg(F.count(F.lit(1)).alias("light"))
    known = groups.join(tables.small(light), "lang", "left").na.fill(0, ["light"])
    a = known.select("lang", "light", F.col("g").cast("long").alias("a"), F.col("source").alias("source_a"), F.col("base").alias("base_a"))
    b = known.select("lang", F.col("g").cast("long").alias("b"), F.col("source").alias("source_b"), F.col("base").alias("base_b"))
    # The answer itself is every pair of sources of a language.
    pairs = a.join(b, "lang").filter("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("light") * F.abs(F.col("base_a") - F.col("base_b")), F.lit(0)) + F.coalesce("s", F.lit(0))
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    return pairs.select("lang", F.explode(both).alias("x"), value.alias("value")).select("lang", "x.source", "x.item", "value")


def own_terms(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms of a group whose share is over the language's, and by how much."""
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("kept").alias("kept"))
    rows = posts.join(tables.small(langs), "lang").withColumn("q", _share(F.col("n"), F.col("total"), F.col("kept")))
    rows = rows.select("lang", "term", "q", F.explode("at").alias("x")).filter("x.p > q")
    return rows.select("lang", "x.source", F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``: the other sources of the language by distance; part ``term``: the terms of
    which a source has most beyond its language, to rank ``top``."""
    counts, path = kept_counts(docs, least)
    groups = sources(docs, counts)
    posts, _ = postings(counts, groups)
    tables.drop(docs.sparkSession, path)
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = own_terms(posts, groups).withColumn("rank", order).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    pairs = pair_distances(posts, groups).withColumn("rank", order).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY 1, 2, 3),
g AS MATERIALIZED (SELECT x.lang, x.source, coalesce(sum(n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
k AS (SELECT lang, count(*)::HUGEINT AS kept FROM v GROUP BY 1), m AS (SELECT lang, sum(total)::HUGEINT AS total FROM g GROUP BY 1),
p AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * kept) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
l AS (SELECT p.lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 5)) // (first(m.total) + 5 * first(kept)) AS q FROM p JOIN m USING (lang) JOIN k USING (lang) GROUP BY 1, 2),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""
