"""Operators for training data against plain versions, exact round trips, and held-out accuracy."""

import base64
import collections
import hashlib
import math
import random
import re
import struct
import zlib

import brute
import numpy as np
import pytest

from vicinage.llm import ann, bpe, chat, encoding, hmm, jaccard, media, mpeg, packing, pii, quality, textbytes, token_counts

EMPTY = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "word " * 3000), (4, "same text here"), (5, "same text here"), (6, "é 日本 🎉\n\t x"), (7, "a" * 5000)]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, EMPTY).withColumn("score", F.lit("x")).withColumn("n", F.lit(1))


# --- personal data


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m.group()))


def test_pii_equals_plain_matching(spark, documents):
    random.seed(1)
    alphabet = ["1.2.3.4", ".5.6.7.8", "a@b.c", "_d@e.f", "@", "4111 1111 1111 1111", "-", "+1 (222) 333-4444", "+12", " ", "300.1.1.1", "🎉", "x", "0001.2.3.4"]
    rows = documents[:100] + [(10_000 + i, "".join(random.choice(alphabet) for _ in range(12))) for i in range(300)] + [(99_999 + i, t) for i, t in ODD]
    got = {r.doc_id: r for r in pii.digest(frame(spark, rows)).collect()}
    for i, text in rows:
        spans = plain_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in spans).encode()).hexdigest(), text
        assert got[i].n_card == sum(n == "card" for _, _, n, _ in spans)


def test_pii_added_kinds_and_redaction(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, "IBAN GB82 WEST 1234 5698 7654 33 no"), (3, "my ssn 123-45-6789."), (4, "part 123-45-6789."), (5, "mail a.b@c.de, 1.2.3.4 end"), (6, None), (7, "")]
    spans = {r.doc_id: r.spans for r in pii.digest(frame(spark, rows)).collect()}
    assert "iban:5:32" in spans[1] and "iban" not in spans[2] and spans[3] == "ssn:7:18" and spans[4] == ""
    clean = {r.doc_id: r.text for r in pii.redact_pii(frame(spark, rows)).collect()}
    assert clean[5] == "mail [EMAIL], [IP] end" and clean[6] is None and clean[7] == ""
    assert pii.digest(frame(spark, [])).count() == 0


def linear_spans(text):
    """``plain_spans`` in linear time: an address lies within a run of its characters that has an @ and no other run is searched."""
    emails = [(run.start() + m[0], k, name, run.start() + m[3]) for run in re.finditer(r"[A-Za-z0-9._%+@-]+", text) if "@" in run.group() for m in plain_spans(run.group()) if m[2] == "email" for k, name in [(m[1], m[2])]]
    other = plain_spans(re.sub(r"@", "\0", re.sub(r"[A-Za-z_%]", " ", text)))  # other kinds have none of these characters
    return sorted(emails + [x for x in other if x[2] != "email"])


def test_pii_of_many_matches_takes_linear_time(spark):
    import time

    pii.digest(frame(spark, [(1, "a@b.co")])).collect()
    for text in ("a@b.co text " * 20_000, "1." * 150_000, "é a@b.co +49 (123) 456-7890 1.2.3.4 " * 3000):
        short = text[:3000]
        spans = linear_spans(text) if "@" in text else [x for x in sorted((m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text))]
        assert plain_spans(short) == (linear_spans(short) if "@" in text else [x for x in spans if x[3] <= len(short)])
        digest = hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in spans).encode()).hexdigest()
        want, at = [], 0
        for a, _, n, b in spans:
            want.append(text[at:a] + f"[{n.upper()}]")
            at = b
        want = "".join(want) + text[at:]
        rows = frame(spark, [(1, text)])
        began = time.perf_counter()
        got, clean = pii.digest(rows).first().base_sha256, pii.redact_pii(rows).first().text
        took = time.perf_counter() - began
        assert got == digest
        assert clean == want
        assert took < 60, took  # a quadratic way takes many minutes


# --- media


def test_media_round_trip(spark, documents):
    rows = documents[:50] + [(10_000 + i, t) for i, t in ODD]
    got = {r.doc_id: r for r in media.read_media(media.store_text(frame(spark, rows))).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.n_samples == 384 * r.n_frames and r.bad_crc == 0 and len(r.frame_offsets) == r.n_frames
    assert media.read_media(media.store_text(frame(spark, []))).count() == 0


def test_media_resynchronises_and_sees_damage():
    raw = mpeg.write(b"some text " * 100)
    whole = mpeg.parse(raw)
    at = whole["offsets"][2]
    mixed = raw[:at] + b"junk\xff\xfejunk" + raw[at:]
    again = mpeg.parse(mixed)
    assert again["skipped"] == 10 and mpeg.payload(mixed, again) == mpeg.pad(b"some text " * 100)
    assert mpeg.parse(raw[: at + 4] + bytes([raw[at + 4] ^ 1]) + raw[at + 5 :])["bad"] == 1
    assert media.features(None)[0] is None and media.features(b"no frames")[7] == 0
    layer3 = (b"\xff\xfb\x90\x64" + bytes(413)) * 3
    assert mpeg.parse(layer3)["samples"] == 3 * 1152
    assert whole["table"]["fits"] and whole["table"]["frames"] == len(whole["offsets"])
    table = raw.index(b"Info")
    assert not mpeg.parse(raw[: table + 8] + struct.pack(">I", 99) + raw[table + 12 :])["table"]["fits"]  # number of frames
    assert not mpeg.parse(raw[: table + 16 + 50] + b"\0" + raw[table + 67 :])["table"]["fits"]  # a seek point
    for cut in range(0, len(raw), 37):  # truncated streams keep their whole frames
        assert mpeg.parse(raw[:cut])["offsets"] == [x for x in whole["offsets"] if x + 240 <= cut]
    random.seed(8)
    for _ in range(200):  # hostile bytes neither fail nor give frames beyond the end
        noise = bytes(random.choice((255, 254, 251, 88, 192, 0, random.randrange(256))) for _ in range(3000))
        assert all(x < len(noise) for x in mpeg.parse(noise)["offsets"])
    assert mpeg.header(raw[whole["offsets"][0] :][:4])["size"] == 240


def bitwise_crc(bits):
    """The checksum as the standard has it, bit by bit."""
    value = 0xFFFF
    for b in bits:
        value = (value << 1) ^ (0x18005 if (value >> 15 ^ int(b)) & 1 else 0)
        value &= 0xFFFF
    return value


def test_media_layer_2_checksums():
    """Frames of 192 kbit/s, 44.1 kHz, joint stereo with bound 8: 8 subbands for each channel, 22 for both."""
    random.seed(9)
    word = bytes([0xFF, 0xFC, 0xA0, 0x54])
    h = mpeg.header(word)
    assert (h["layer"], h["kbit"], h["rate"], h["samples"], h["protected"]) == (2, 192, 44100, 1152, True)
    widths, out = [4] * 11 + [3] * 12 + [2] * 7, b""
    for _ in range(4):
        allocation, used = "", 0
        for band, width in enumerate(widths):
            for _ in range(2 if band < 8 else 1):
                x = random.randrange(1 << width)
                allocation += f"{x:0{width}b}"
                used += (1 if band < 8 else 2) * (x > 0)
        bits = allocation + "".join(random.choice("01") for _ in range(2 * used))
        crc = bitwise_crc(f"{word[2]:08b}{word[3]:08b}" + bits)
        body = int(bits.ljust(8 * (h["size"] - 6), "1"), 2).to_bytes(h["size"] - 6)
        out += word + crc.to_bytes(2) + body
    got = mpeg.parse(out)
    assert (len(got["offsets"]), got["checked"], got["bad"], got["samples"]) == (4, 4, 0, 4608)
    assert mpeg.parse(out[:8] + bytes([out[8] ^ 16]) + out[9:])["bad"] == 1


# --- similarity join


def test_jaccard_equals_all_pairs(spark, documents):
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    rows = documents[:60] + [(5000 + i, t) for i, t in ODD]
    for n in (4, 9, 15, 40, 120, 400):
        for _ in range(2):
            base = [random.choice(words) for _ in range(n)]
            for _ in range(8):
                w = list(base)
                for _ in range(random.choice([0, 1, 2, max(1, n // 60), max(1, n // 30)])):
                    w[random.randrange(n)] = random.choice(words)
                rows.append((len(rows) + 10_000, " ".join(w)))
    for width, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(frame(spark, rows), width=width, percent=percent).collect()}
        assert got == brute.jaccard_components(rows, width, percent)
    assert jaccard.similarity_components(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (None, None), (3, "a b c d"), (2, "A B c d"), (2, "A B c d"), (4, None)], EMPTY)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.similarity_components(odd).collect() if r.n_shingles)
    assert got == [(0, 2, None), (2, 2, 2), (2, 2, 2), (3, 2, 2)] and jaccard.similarity_links(odd).count() == 6


def test_every_link_is_found_and_counted(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "LINK_SETS", 3)  # several chunks a component
    random.seed(6)
    rows = documents[:60] + [(5000 + i, t) for i, t in ODD]
    for n in (3, 12, 60, 200):
        base = [f"v{random.randrange(400)}" for _ in range(n)]
        for k in range(12):
            w = list(base)
            for _ in range(k % 4):
                w[random.randrange(n)] = f"x{random.randrange(400)}"
            rows.append((len(rows) + 10_000, " ".join(w)))
    for width, percent in ((3, 90), (5, 80)):
        sets = {i: brute.shingles(t, width) for i, t in rows}
        want = {(a, b) for a in sets for b in sets if a < b and jaccard.linked(sets[a], sets[b], percent)}
        components = brute.jaccard_components(rows, width, percent)
        for r in jaccard.similarity_links(frame(spark, rows), width=width, percent=percent).collect():
            assert (r.n_shingles, r.component_id) == components[r.doc_id] and r.n_links == sum(r.doc_id in p for p in want)
        pairs, members = jaccard.similarity_pairs(frame(spark, rows), width=width, percent=percent)
        of = collections.defaultdict(list)
        for r in members.collect():
            of[r.head].append(r.doc_id)
        got = [(r.a, r.b) for r in pairs.collect()]
        assert len(got) == len(set(got)) and all(a < b for a, b in got)
        spread = {tuple(sorted((i, j))) for a, b in got for i in of[a] for j in of[b]}
        same = {(i, j) for head in of if sets[head] for i in of[head] for j in of[head] if i < j}
        assert spread | same == want and not spread & same
    assert jaccard.similarity_links(frame(spark, [])).count() == 0


@pytest.mark.parametrize("made, sql", [(jaccard.query, jaccard.SQL), (jaccard.links_query, jaccard.LINKS_SQL)])
def test_similarity_join_equals_its_sql(spark, duck, sf_dir, made, sql):
    got, want = made(spark, sf_dir), duck.sql(sql)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("width", [3, 5])
def test_slabs_of_fewer_words_than_a_shingle(width):
    import pyarrow as pa

    for n in range(7):
        texts = [" ".join("abcdefg"[:n])]
        found = [jaccard.shingle_sets(data, at, width) for _, data, at in textbytes.slabs(pa.array(texts))]
        assert sum(len(value) for _, value in found) == len(brute.shingles(texts[0], width))
    texts = ["a b", "long " * (textbytes.SLAB_BYTES // 5 + 1), "a b c"]
    sizes = [np.bincount(jaccard.shingle_sets(data, at, width)[0], minlength=len(at) - 1) for _, data, at in textbytes.slabs(pa.array(texts))]
    assert len(sizes) == 3 and np.concatenate(sizes).tolist() == [len(brute.shingles(t, width)) for t in texts]


@pytest.mark.parametrize("blocks", [1, 3, 6])
def test_every_allocation_finds_all_links(blocks, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCKS", (blocks,))
    rng = np.random.default_rng(2)
    bounds = np.array(jaccard.band_bounds(80))
    for size in (10, 30, 90, 300):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets = [np.unique(base)]
        for _ in range(20):
            k = int(rng.integers(1, size // 9 + 1))
            sets.append(np.unique(np.concatenate([base[k:], rng.integers(0, 2**63, int(rng.integers(0, k + 1)), dtype=np.uint64)])))
        n = np.array([len(s) for s in sets])
        counts = collections.Counter((np.searchsorted(bounds, n, "right") - 1).tolist())
        doc, sig = jaccard.index_entries(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n, bounds, jaccard.allocate(dict(counts), 80))
        entries = [set(sig[doc == i].tolist()) for i in range(len(sets))]
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (n[i] + n[j] - both) and both < n[i] + n[j] - both:
                    assert entries[i] & entries[j]


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))
        b = np.unique(np.concatenate([a[6:], rng.integers(0, 2**63, 5, dtype=np.uint64)]))
        rows = [(0, k, k, len(s), -1, -1, jaccard.parity_sketch(s, jaccard.sketch_bits(len(s), 90))) for k, s in enumerate((a, b))]
        both = len(np.intersect1d(a, b))
        assert (100 * both < 90 * (len(a) + len(b) - both)) or jaccard.near_in_group(rows, 90) == [(0, 1)]


# --- tokens


def tokenizer(name):
    import public_tokenizers as P
    import tiktoken

    with open(P.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return P.path(name), P.PATTERN, tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, documents):
    path, pattern, library = tokenizer("byte_bpe_multi_50k.tiktoken")
    rows = documents[:60] + [(10_000 + i, t) for i, t in ODD] + [(20_000, "<|endoftext|> it's  1234567"), (20_001, "　 x  y")]
    ids = bpe.encode(frame(spark, rows), path, pattern)
    got = {r.doc_id: r for r in bpe.decode(ids, path).collect()}
    for i, text in rows:
        assert got[i].ids == library.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode()
    assert bpe.encode(frame(spark, []), path, pattern).count() == 0


def test_bpe_of_words_of_any_length(spark, monkeypatch):
    """Folded words and those merged with a heap, with a new start of the numbers after every slab."""
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "SLAB", 4000)
    monkeypatch.setattr(bpe, "STEP", 100)
    path, pattern, library = tokenizer("byte_bpe_multi_50k.tiktoken")
    random.seed(11)
    rows = [(n, "".join(random.choice("etaoinbcé") for _ in range(n))) for n in [*range(1, 40), 100, 255, 511, 512, 513, 700, 2000]]
    rows += [(3000 + n, "a" * n) for n in (2, 3, 7, 511, 512, 513, 1999)] + [(4000 + i, f" {w}" * 30) for i, (_, w) in enumerate(rows[:30])]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(spark, rows).coalesce(1), path, pattern), path).collect()}
    for i, text in rows:
        assert got[i].ids == library.encode_ordinary(text) and bytes(got[i].decoded) == text.encode()
    for r in bpe.encode(frame(spark, rows).coalesce(1), path, pattern, as_bytes=True, decoded="again").collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == got[r.doc_id].ids and r.again == got[r.doc_id].decoded
    odd = spark.createDataFrame([(None, "x y"), (1, None), (1, None)], EMPTY)
    assert sorted((r.doc_id or 0, len(r.ids)) for r in bpe.encode(odd, path, pattern).collect()) == [(0, 2), (1, 0), (1, 0)]
    lists = spark.createDataFrame([(None,), ([],), ([5, 6],)], "ids array<int>")
    ranks = {r: p for p, r in bpe.read_ranks(path).items()}
    assert [r.decoded for r in bpe.decode(lists, path).collect()] == [None, b"", ranks[5] + ranks[6]]


def test_pieces_give_the_library_ids(documents):
    import pyarrow as pa

    _, _, library = tokenizer("byte_bpe_50k.tiktoken")
    texts = [t for _, t in documents[:80]] + ["", None, " a  b", "x  y", "é ü  \n z", "  ", "'s it's  'll", "　 x", "a\u0085 b", "<|endoftext|> x", "a\x1c b"]
    out = [ids[a:b].tolist() for _, ids, at in encoding.encoded_slabs(pa.array(texts), library.encode_ordinary) for a, b in zip(at[:-1], at[1:])]
    assert out == [library.encode_ordinary(t or "") for t in texts]


def test_pieces_give_the_ids_of_the_tokenizers_file(documents):
    import public_tokenizers as P
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"{end}a", f"a{end}", f"a {end} b", f"a  {end}{end}  b", f" {end} ", f"é{end}\n{end}", end, "it's 1234 <|endoftext| >", "x <|endof", "text|> y", f"x\n {end}  z"] + [t or "" for _, t in documents[:80]]
    encode, added = encoding.encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    out = [ids[a:b].tolist() for _, ids, at in encoding.encoded_slabs(pa.array(texts), encode, added) for a, b in zip(at[:-1], at[1:])]
    assert out == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)] and out[0][0] == 50256


def test_histogram_answers_every_limit(spark, documents):
    path, pattern, library = tokenizer("byte_bpe_50k.tiktoken")
    path = path.replace(".tiktoken", ".json")
    rows = documents[:80] + ODD
    lengths = [len(library.encode_ordinary(t or "")) for _, t in rows]
    h = token_counts.length_histogram(token_counts.token_lengths(frame(spark, rows), path, pattern))
    for r in h.collect():
        at = [n for n in lengths if n >= r.n_tokens]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(r.n_tokens), len(at), sum(at))
        assert r.truncated_total == sum(min(n, r.n_tokens) for n in lengths) and r.lost_tokens == sum(lengths) - r.truncated_total
    for r in token_counts.answer(h, [0, 100, 1 << 20]).collect():
        assert r.truncated_total == sum(min(n, r.context_limit) for n in lengths) and r.docs_over == sum(n > r.context_limit for n in lengths)
    assert token_counts.quantile(h, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert token_counts.length_histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_packing_covers_every_id_once(spark, documents):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = documents + [(10_000 + i, t) for i, t in ODD] + [(20_000, "x <|endoftext|> y"), (20_001, "<|endoftext|>"), (20_002, "of<|endoftext|><|endoftext|>  z")]
    pieces = packing.packed(frame(spark, rows)).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text in rows:
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    total = 0
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
        total += at
    assert total / (packing.CAPACITY * len(by_sequence)) > 0.97


# --- language model


def test_hmm_base_scores_and_likelihood(spark, documents):
    rows = documents + [(10_000 + i, t) for i, t in ODD]
    got = {r.doc_id: r for r in hmm.fit_and_score(frame(spark, rows), passes=2).collect()}
    end, counts = object(), collections.Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*brute.words(text), end])
    n, v = sum(counts.values()), len(counts)
    tokens = base = model = 0
    for i, text in rows:
        w, r, out = [*brute.words(text), end], got[i], zlib.crc32(str(i).encode()) % 5 == 1
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        if out:
            tokens, base, model = tokens + len(w), base + r.base_score, model + r.score
    assert model > base


def test_hmm_repeated_and_null_keys(spark):
    rows = [(1, "zz1 zz2 zz3"), (1, "zz1 zz2 zz3"), (1, "zz1 other"), (None, "zz1 zz2"), (None, "zz1 zz2"), (None, None), (2, "zz1 zz2"), (3, "the the")]
    got = hmm.fit_and_score(frame(spark, rows), passes=1).collect()
    end, counts = "\0", collections.Counter()
    for i, text in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*(text or "").split(), end])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        w = [*(text or "").split(), end]
        want.append((i or 0, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 9)))
    assert sorted(want) == sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 9)) for r in got)
    assert len({round(r.score, 9) for r in got if r.n_tokens == 4}) == 1 and all(r.held_out for r in got if r.doc_id is None)
    assert hmm.fit_and_score(frame(spark, [])).count() == 0


def test_forward_recursion_sums_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    draw = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s))
    m = {"start": draw(3), "inside": draw(3), "move": draw(3, 3), "emit": draw(3, 5)}
    seq = [0, 4, 2, 2]
    total = sum(m["start"][p[0]] * np.prod([m["move"][a, b] for a, b in zip(p, p[1:])]) * np.prod([m["emit"][s, o] for s, o in zip(p, seq)]) for p in itertools.product(range(3), repeat=4))
    got = hmm.log_likelihoods([np.array(seq, np.uint16).tobytes(), np.array([1], np.uint16).tobytes()], m)
    assert got[0] == pytest.approx(math.log(total)) and got[1] == pytest.approx(math.log(m["start"] @ m["emit"][:, 1]))


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 6, rng.integers(1, 100)).astype(np.uint16).tobytes() for _ in range(30)]
    freq = np.full(6, 1 / 6)
    m, before = hmm.first_model(freq, 3), -np.inf
    for _ in range(5):
        now = hmm.log_likelihoods(seqs, m).sum()
        assert now >= before - 0.05
        before, m = now, hmm.next_model(hmm.expected_counts(seqs, m), freq * 1e-6, 3)


# --- chat


def test_chat_round_trip(spark, duck, sf_dir):
    got = chat.query(spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.sql(chat.SQL)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_chat_odd_conversations(spark):
    rows = [(1, 0, "user", "a<|end|>b&lt;"), (1, 1, "assistant", None), (1, 2, None, "tail"), (2, 5, "user", "only"), (None, 1, "assistant", "x"), (3, None, "assistant", "n"), (3, None, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.expand(df)
    assert examples.filter("conv_id = 3 and loss_length > 0").count() == 2
    out = {r.conv_id: r for r in chat.digest(examples).collect()}
    said = "user\na<|end|>b&lt;\nassistant\n\n\ntail\n"
    assert out[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[1].loss_chars == 0
    assert out[2].n_turns == 1 and out[2].loss_chars == 0 and out[None].loss_chars == 1 and out[3].loss_chars == 2
    assert chat.expand(df.limit(0)).count() == 0


# --- quality


def test_quality_is_learned(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality.query(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.93


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.extend(texts))
    texts = {i: f"start{i} " + "word " * 4000 * (i % 3) + f"end{i}" for i in range(20)}
    quality.train(frame(spark, list(texts.items())), spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int"))
    assert seen == [t.encode() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5]
    x = np.frombuffer(texts[2].encode(), np.uint8)
    tables = quality.Network().tables()
    for piece in (1, 5, 1024):
        _, top = quality.peaks(x, tables, piece)
        assert np.allclose(np.concatenate([top.mean(0), top.max(0)]), quality.pooled(x, tables), atol=1e-6)


def test_quality_pooling_covers_the_whole_text(spark):
    tables = quality.Network().tables()
    x = np.frombuffer(b"plain words " * 3000, np.uint8).copy()
    whole = quality.pooled(x, tables)
    assert np.allclose(whole, quality.pooled(x, tables, 4096))
    x[-3] = 255
    assert not np.allclose(whole, quality.pooled(x, tables))
    net = quality.fit([], [])
    assert {r.score for r in quality.score(frame(spark, ODD), net).collect()} == {0.5}
    assert quality.score(frame(spark, []), net).count() == 0


def plain_quality(text, net):
    """The network's answer by loops: each filter at each byte, chunks of 256 bytes that share 32, their largest responses."""
    x = [*(text or "").encode()]
    if not x:
        return 1 / (1 + math.exp(-float(net.c[0])))
    z = [[max(0.0, float(net.b[f]) + sum(float(net.w[j][(x[p + j] if p + j < len(x) else 0)][f]) for j in range(4))) for f in range(len(net.b))] for p in range(len(x))]
    blocks = -(-len(x) // 32)
    chunks = [z[32 * s : 32 * min(s + 8, blocks)] for s in range(0, max(1, blocks - 1), 7)]
    top = [[max(row[f] for row in c) for f in range(len(net.b))] for c in chunks]
    features = [sum(t[f] for t in top) / len(top) for f in range(len(net.b))] + [max(t[f] for t in top) for f in range(len(net.b))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(features, net.a.tolist())) - float(net.c[0])))


def test_quality_scores_equal_plain_loops(spark, documents):
    net = quality.fit([t.encode() for _, t in documents[:40]], [i % 2 for i in range(40)])
    texts = ["", None, "a", "abc", "x" * 31, "y z " * 8, "é" * 40, "w" * 256, "word " * 52, "line\n" * 200, documents[0][1][:900], documents[1][1][:1500]]
    got = {r.doc_id: r.score for r in quality.score(frame(spark, list(enumerate(texts))), net).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_quality(text, net), abs=1e-5)


# --- nearest neighbours


def test_neighbours_recall_and_rules(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    got = ann.query(spark, folder).collect()
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    found, hits = {(r.query_id, r.vec_id): r.score for r in got}, 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[i]
        score[i] = -9
        best = np.argsort(-score)[:5]
        hits += sum((ids[i], ids[j]) in found for j in best)
        assert all(abs(found[ids[i], ids[j]] - score[j]) < 1e-12 for j in best if (ids[i], ids[j]) in found)
    assert hits / (5 * (ids % 50 == 0).sum()) >= 0.9


def test_neighbours_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [0.0, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id) for r in ann.search(df, df.filter("vec_id = 0"), k=3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 8)]
    more = spark.createDataFrame([*rows, (9, [1.0, 1.0, 2.0]), (9, [1.0, 1.0, 2.0]), (10, [3.0] * 3), (11, [5.0])], "vec_id long, embedding array<double>").selectExpr("*", "'x' AS score")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(more, more.filter("vec_id in (0, 7, 11)"), k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (7, 1, 10), (7, 2, 9)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.search(same, same.filter("vec_id = 5"), k=3).orderBy("rank").collect()] == [0, 1, 2]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_recall_on_clusters(spark):
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(40, 32))[rng.integers(0, 40, 9000)] + 0.4 * rng.normal(size=(9000, 32))).astype(np.float64)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit[::50] @ unit.T
    score[np.arange(180), np.arange(180) * 50] = -9
    best = np.argsort(-score, 1)[:, :5]
    assert sum((i * 50, j) in found for i in range(180) for j in best[i].tolist()) / 900 >= 0.9


# --- pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, (_, c) in brute.jaccard_components(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    clean = dict(corpus_pipeline.STAGES)["pii"](spark, docs, sf_dir)
    assert all(not plain_spans(r.text) for r in clean.collect()) and clean.columns == docs.columns
    good = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, sf_dir).collect()}
    groups = brute.jaccard_components([r for r in rows if r[0] in good], 5, 80)
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {i for i, (_, c) in groups.items() if i == c}


def test_pipeline_odd_documents(spark, sf_dir):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "mail a@b.co now and then", "en", "s", 24), (3, long, "en", "s", len(long)), (4, long + " end", "en", "s", 1), (5, "same five words in here now", "en", "s", 5), (5, "same five words in here now", "en", "s", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS id", "'x' AS component_id", "'x' AS score", "'x' AS pii_spans")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == docs.columns and (name == "quality" or out.count() == (7 if name == "near_duplicates" else 8) * bool(table.take(1)))
        packed = dict(corpus_pipeline.STAGES)["packing"](spark, table, sf_dir)
        assert packed.select("doc_id").distinct().count() == (6 if table is docs else 0)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 2, 3, 5, 5]
    clean = {(r.doc_id, r.text): r.n_chars for r in corpus_pipeline.redact(spark, docs, sf_dir).collect()}
    assert clean[None, "mail [EMAIL] now and then"] == 25 and clean[1, None] is None and clean[2, ""] == 0


def test_pivots_come_from_few_rows_of_each_partition(spark):
    """The vectors of smallest hashes, of which partitions do not each send a whole sample to the driver."""
    from pyspark.sql import functions as F

    vectors = spark.range(4000).repartition(16).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    kind, seen = type(vectors), []
    ordered = kind.orderBy
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(kind, "orderBy", lambda self, *c: (seen.append(self.count()), ordered(self, *c))[1])
        got = ann.choose_pivots(vectors, 8)
    want = [tuple(r["v"]) for r in ordered(vectors, F.xxhash64("id"), "id").limit(8).collect()]
    assert np.allclose(got, ann._unit(np.array(want)))
    assert seen and max(seen) < 400


def test_neighbours_send_no_copies_of_queries_through_the_driver(spark, capsys):
    """Blocks meet as a product of written tables; queries repeated for each block were a broadcast at size, as one block looks small."""
    from pyspark.sql import functions as F

    vectors = spark.range(600).select(F.col("id").alias("vec_id"), F.array(*[F.xxhash64("id", F.lit(i)) / 1e18 for i in range(4)]).alias("embedding"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ann, "BLOCK", 128)
        patch.setattr(ann, "QUERY_BLOCK", 8)
        found = ann.search(vectors, vectors.filter("vec_id % 50 = 0"), k=2)
        got = {(r.query_id, r["rank"]): r.vec_id for r in found.collect()}
    m = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    score = unit[::50] @ unit.T
    score[np.arange(12), np.arange(12) * 50] = -9
    assert got == {(i * 50, r + 1): j for i, row in enumerate(np.argsort(-score, 1)[:, :2].tolist()) for r, j in enumerate(row)}
    found.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
