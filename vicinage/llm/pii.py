"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions are used. Every kind is searched over the whole text with a linear pattern; positions
come from the lengths of what lies between the matches.

Cases: a null or empty text has no spans; texts of any length are searched whole; repeated rows each give their own
result; an empty table gives an empty table; further input columns are kept unless they carry one of the output names,
in which case the output column replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with the same start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

#: A run may start where the last match ended (\G) or after a character that cannot be part of it; with that and
#: possessive runs, matching takes time in proportion to the text and finds what the plain patterns find.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this substring has no match of the kind; only where such a test exists.
NEEDLE = {"email": "@", "phone": "+", "ssn": "-"}

#: Score of a confirmed span before context, and words whose presence nearby raises it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": r"e-?mail|mailto|contact|write",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|amex|credit|payment",
    "phone": r"phone|\btel\b|call|mobile|fax|whatsapp",
    "iban": r"iban|bank|account|konto|cuenta|compte",
    "ssn": r"ssn|social security|tax id|national id",
}
CONTEXT_BOOST = 0.3
#: Context is looked for in so many characters on either side, not beyond the neighbouring span of the same kind.
CONTEXT_CHARS = 48
#: A span of an added kind is reported from this score on; base kinds are always reported.
MIN_SCORE = 0.6


def _luhn(digits: Column) -> Column:
    def step(total: Column, k: Column) -> Column:
        d = F.substring(digits, -k, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _mod97(text: Column) -> Column:
    plain = F.replace(text, F.lit(" "))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, k: Column) -> Column:
        code = F.ascii(F.substring(moved, k, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def confirmed(kind: str, text: Column) -> Column:
    """Whether a proposed span of the kind holds what the kind's rules ask for."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _mod97(text)
    if kind == "ssn":
        return ~(text.rlike("^(?:000|666|9)") | text.rlike("-00-|-0000$"))
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, add) -> Column:
    """Running results of ``add`` over an array of ints, from its first element on. Elements are taken in blocks, then blocks'
    results are carried on, so that no long array is built up element by element."""
    n, block = F.size(values), 256

    def inner(k: Column) -> Column:
        some = F.slice(values, k * block + 1, F.lit(block))
        return F.aggregate(F.slice(some, F.lit(2), F.lit(block)), F.slice(some, F.lit(1), F.lit(1)), lambda out, x: F.concat(out, F.array(add(F.element_at(out, -1), x))))

    def carried(blocks: Column) -> Column:
        last = F.aggregate(blocks, F.array().cast("array<int>"), lambda out, b: F.concat(out, F.array(F.when(F.size(out) == 0, F.element_at(b, -1)).otherwise(add(F.try_element_at(out, F.lit(-1)), F.element_at(b, -1))))))
        return _let(last, lambda t: F.flatten(F.transform(blocks, lambda b, j: F.when(j == 0, b).otherwise(F.transform(b, lambda x: add(F.get(t, j - 1), x))))))

    return F.when(n > 0, _let(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), inner), carried)).otherwise(F.array().cast("array<int>"))


def _spans(kind: str, text: Column, found: Column) -> Column:
    order, is_base = KINDS.index(kind), kind in BASE_KINDS

    def between(gaps: Column) -> Column:
        """All matches, from the texts between them: each step is a gap and its match."""
        steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(g) + F.length(m))
        return _let(steps, lambda step: _let(_running(step, lambda a, b: a + b), lambda ends: F.transform(found, lambda m, k: one(m, k, gaps, ends))))

    def one(m: Column, k: Column, gaps: Column, ends: Column) -> Column:
        before = F.right(F.get(gaps, k), F.lit(CONTEXT_CHARS))
        after = F.left(F.get(gaps, k + 1), F.lit(CONTEXT_CHARS))
        near = F.lower(before).rlike(CONTEXT[kind]) | F.lower(after).rlike(CONTEXT[kind])
        end = F.get(ends, k)
        return F.struct(
            (end - F.length(m)).alias("start"),
            F.lit(order).alias("order"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            (F.lit(BASE_SCORE[kind]) + F.when(near, CONTEXT_BOOST).otherwise(0.0)).alias("score"),
            F.when(confirmed(kind, m), m).alias("text"),
        )

    return F.filter(_let(F.split(text, PATTERNS[kind], -1), between), lambda s: s["text"].isNotNull() & (F.lit(is_base) | (s["score"] >= MIN_SCORE)))


_SPAN = "array<struct<start:int,order:int,kind:string,end:int,score:double,text:string>>"


def find_pii(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add ``out``: spans (start, order, kind, end, score, text) by start, then kind; positions count code points from 0."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in df.columns if c != out]
    names = {k: f"__found_{k}" for k in KINDS}
    found = df.select(
        *[F.col(f"`{c}`") for c in kept],
        *[
            F.when(F.contains(whole, F.lit(NEEDLE[k])), F.regexp_extract_all(whole, F.lit(PATTERNS[k]), F.lit(0))).alias(names[k])
            if k in NEEDLE
            else F.regexp_extract_all(whole, F.lit(PATTERNS[k]), F.lit(0)).alias(names[k])
            for k in KINDS
        ],
    )
    none = F.array().cast(_SPAN)
    parts = [F.when(F.size(names[k]) > 0, _spans(k, whole, F.col(names[k])).cast(_SPAN)).otherwise(none) for k in KINDS]
    return found.select(*[F.col(f"`{c}`") for c in kept], F.sort_array(F.concat(*parts)).alias(out))


def _cut(text: Column, spans: Column) -> Column:
    """The text with each span (sorted by start) replaced by its kind. Overlapping spans go together, as one of the first's kind."""
    size = 2048  # the text in chunks, so that a place in it is found without counting from its start

    def between(chunks: Column, a: Column, b: Column) -> Column:
        """Characters a to b."""
        i, j = F.floor(a / size).cast("int"), F.floor(b / size).cast("int")
        first, last = F.coalesce(F.get(chunks, i), F.lit("")), F.coalesce(F.get(chunks, j), F.lit(""))
        whole = F.array_join(F.slice(chunks, i + 2, j - i - 1), "")
        return F.when(i == j, F.substring(first, a - i * size + 1, b - a)).otherwise(F.concat(F.substring(first, a - i * size + 1, F.lit(size)), whole, F.substring(last, F.lit(1), b - j * size)))

    def replaced(chunks: Column, s: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))
        return _let(heads, lambda h: F.concat(F.array_join(F.transform(h, lambda i, j: piece(chunks, s, reach, i)), ""), between(chunks, F.element_at(reach, -1), F.length(text))))

    def piece(chunks: Column, s: Column, reach: Column, i: Column) -> Column:
        return F.concat(between(chunks, F.when(i == 0, 0).otherwise(F.get(reach, i - 1)), F.get(s, i)["start"]), F.lit("["), F.upper(F.get(s, i)["kind"]), F.lit("]"))

    def body(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["end"])
        chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))
        return _let(chunks, lambda c: _let(ends, lambda e: _let(_running(e, F.greatest), lambda reach: replaced(c, s, reach))))

    return F.when(F.size(spans) > 0, _let(spans, body)).otherwise(text)


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span in ``text`` by its kind in brackets. Of spans that overlap, the one that starts first stays
    (of equal starts the first kind of ``KINDS``), and what a dropped one has beyond its end goes too, so that no part is left."""
    spans = "__pii"
    found = find_pii(df, text, spans)
    return found.select(*[(_cut(F.col(f"`{c}`"), F.col(spans)).alias(c) if c == text else F.col(f"`{c}`")) for c in df.columns])


def digest(df: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a hash of the base spans, and all spans as text."""
    spans = F.col("pii_spans")
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(df).select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(listed(F.filter(spans, lambda x: x["order"] < len(BASE_KINDS))), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
