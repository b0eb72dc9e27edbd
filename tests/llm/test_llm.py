"""The training-data operators against brute force, libraries and round trips, on odd rows and on the small tables."""

import hashlib
import itertools
import math
import os
import random
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidencelake.llm import bpe, chat, components, ctph, neardup, packing, quality, queries, simhash, suffix, topk, toxicity, warc

SF = "/root/testdata/sf0.001"
BPE, WORDS = queries.VOCABULARY, queries.WORDS


def documents(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# 1 ----------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rnd = random.Random(1)
    parts = ["### ", "</turn>", "\\", "\n", ": ", "a", "é", "### assistant: ", "\n</turn>\n", "#", "<", ""]
    rows = [(c, t, rnd.choice(["user", "assistant", "a:b", "x\\\n", "\\n", "\\c", None, "s\0"]), "".join(rnd.choices(parts, k=rnd.randrange(9)))) for c in range(150) for t in range(rnd.randrange(1, 5))]
    rows += [(None, None, None, None), (500, 1, "user", "x"), (500, 1, "user", "x"), (501, 0, "assistant", "y" * 200_000), (502, 0, "assistant", queries.CONFLICT)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1), role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(role, text) for _, role, text in mine]
        assert got[conv].loss_text == "".join(text for _, role, text in mine if role == "assistant")
        written = [t.written for t in got[conv].turns if t.role == "assistant"]
        assert [got[conv].formatted[s.start : s.start + s.length] for s in got[conv].loss_spans] == written
    assert chat.format_conversations(df.limit(0)).count() == 0


# 2 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(BPE), public_tokenizers.PATTERN)


def test_bpe_is_tiktoken(codec):
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(2)
    letters = " \n\t\r\x0b\x1c\x85\xa0​ abcdeABC's't123²½Ⅻ四èéßıǅ_!?#$́ᴬ😀中"
    cases = ["".join(rnd.choices(letters, k=rnd.randrange(30))) for _ in range(3000)] + ["", "a" * 5000, " " * 300, "<|endoftext|>"]
    for text in cases:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal(codec):
    slots = [codec.hash.slot(k) for k in codec.ranks]
    assert sorted(slots) == list(range(len(codec.ranks)))
    assert codec.hash.slot(b"\xff\xfe no such token") == -1


def test_bpe_rows(spark, codec, odd, none):
    rows = sorted((str(r.doc_id), r.decoded_sha256) for r in bpe.encode_documents(odd, codec).collect())
    assert rows == sorted((str(d), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts(odd))
    assert bpe.encode_documents(none, codec).count() == 0


# 3 ----------------------------------------------------------------------------------------------------------------


def test_piecewise_fingerprints(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in ctph.fingerprints(docs, with_text=True).collect()}
    rows = sorted(texts(docs), reverse=True)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        m, after = len(t) // 3, rows[(i + 1) % len(rows)][1]
        made = t[: len(t) - m] + after[:m]
        assert (got[d].edited, got[d].n_chars, got[d].fingerprint, got[d].edited_fingerprint) == (made, len(t), ctph.fingerprint(t), ctph.fingerprint(made))
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.97


def plain_fingerprint(text):
    """The docstring's rule, a byte at a time."""
    raw, levels = text.encode(), []
    for i in range(len(raw)):
        h = sum((raw[i - j] + 1) * pow(0x01000193, j, 1 << 32) for j in range(min(7, i + 1))) % (1 << 32)
        h ^= h >> 15
        h = h * 0x2C1B3C6D % (1 << 32)
        h ^= h >> 13
        levels.append(next((b for b in range(31) if h >> b & 1), 31))
    k = max(1, (len(raw) // 64).bit_length()) if raw else 1
    while k > 1 and sum(x >= k for x in levels) < 8:
        k -= 1
    while k < 30 and sum(x >= k for x in levels) > 128:
        k += 1

    def signature(level):
        chunks, held = [], b""
        for byte, x in zip(raw, levels, strict=True):
            held += bytes([byte])
            if x >= level and len(chunks) < 159:
                chunks.append(held)
                held = b""
        out = ""
        for chunk in [*chunks, held] if held else chunks:
            total = 0
            for i, byte in enumerate(chunk):
                place = (i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
                total += (byte + 1) * ((place ^ place >> 29) | 1)
            total %= 1 << 64
            total = (total ^ total >> 31) * 0xBF58476D1CE4E5B9 % (1 << 64)
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[total >> 58]
        return out

    return f"{1 << k}:{signature(k)}:{signature(k + 1)}"


def plain_likeness(x, y):
    def alike(a, b):
        if not a or not b:
            return 0.0
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return 1.0 - row[-1] / max(len(a), len(b))

    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(alike(x1, y1), alike(x2, y2))
    return alike(x1, y2) if bx == 2 * by else alike(x2, y1) if 2 * bx == by else 0.0


def test_fingerprint_and_likeness_are_the_plain_rule(spark):
    rnd = random.Random(43)
    cases = ["".join(rnd.choices("abcdefg hé", k=k)) for k in (*range(12), 60, 200, 700, 3000)] + ["a" * 500, "ab" * 3000]
    for text in cases:
        assert ctph.fingerprint(text) == plain_fingerprint(text), len(text)
    rows = [(i, t) for i, t in enumerate(cases)] + [(100 + i, t[: len(t) // 2] + "new" + t[len(t) // 2 :]) for i, t in enumerate(cases)]
    rows = sorted(rows, key=lambda r: (len(r[1]), r[1]))
    got = {r.doc_id: r for r in ctph.fingerprints(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    for i, r in got.items():
        assert abs(r.near_edited - plain_likeness(r.fingerprint, r.edited_fingerprint)) < 1e-9
        assert abs(r.near_next - plain_likeness(r.fingerprint, got[(i - 1) % len(got)].fingerprint)) < 1e-9


def test_an_outlying_id_leaves_buckets_even(spark):
    ids = [*range(2000), 1 << 62, -(1 << 62)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    cuts = ctph._cuts(docs.select(F.col("doc_id").alias("key")), len(ids))
    sizes = [r["count"] for r in docs.groupBy(ctph._bucket(F.col("doc_id"), cuts).alias("bucket")).count().collect()]
    assert len(sizes) == 31 and max(sizes) < 200
    order = sorted(ids, reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in ctph.fingerprints(docs).collect()}
    for i, d in enumerate(order):
        text, after = f"text {d}", f"text {order[(i + 1) % len(order)]}"
        assert got[d] == hashlib.sha256((text[: len(text) - len(text) // 3] + after[: len(text) // 3]).encode()).hexdigest()


def test_piecewise_odd(spark, odd, none):
    got = ctph.fingerprints(odd).collect()
    assert len(got) == odd.count() and ctph.fingerprints(none).count() == 0
    assert ctph.fingerprint("") == "2::" and ctph.fingerprint("x" * 300_000).count(":") == 2
    one = ctph.fingerprints(odd.where("doc_id = 5 and lang = 'en'")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    # chunks move with the text: what follows an insertion keeps its signs
    rnd = random.Random(4)
    base = "".join(rnd.choices("abcdefgh ", k=6000))
    a, b = ctph.fingerprint(base).split(":")[1], ctph.fingerprint("inserted " + base).split(":")[1]
    assert a[-30:] == b[-30:]


# 4 ----------------------------------------------------------------------------------------------------------------


def removed(rows):
    """(doc position in rows) -> mask, by every window of 100 bytes; rows in order."""
    seen, out = set(), []
    for _, text in rows:
        raw = text.encode()
        mask = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                mask[i] += 1
                mask[i + 100] -= 1
            seen.add(w)
        out.append(np.cumsum(mask[:-1]) > 0)
    return out


@pytest.mark.parametrize("crowd", [512, 1])
def test_suffix_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rnd = random.Random(7)
    passages = ["".join(rnd.choices("abcd é", k=k)) for k in (90, 100, 130, 260, 700)]
    rows = [(i, "".join(rnd.choice([rnd.choice(passages), rnd.choice(passages)[7:], "".join(rnd.choices("wxyz ", k=rnd.randrange(60)))]) for _ in range(rnd.randrange(7)))) for i in range(120)]
    rows += [(200, "ab" * 400), (201, "q" * 350), (202, ""), (203, None), (204, "long " * 30 + "".join(rnd.choices("mnop", k=700_000)) + passages[4])]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, key string, spans string").repartition(5)
    got = {r.doc_id: r for r in suffix.digests(df).collect()}
    for (d, t), mask in zip(rows, removed([(d, t or "") for d, t in rows]), strict=True):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        edges = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(raw), int(mask.sum()), edges), d
        assert got[d].kept_sha256 == hashlib.sha256(raw[~mask].tobytes()).hexdigest()


def test_suffix_odd(spark, odd, none):
    got = suffix.digests(odd).collect()
    assert len(got) == odd.count() and suffix.digests(none).count() == 0
    kept = suffix.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_maximal_repeats():
    """All occurrences of each, and only repeats that differ to the left and to the right."""
    rnd = random.Random(9)
    core = bytes(rnd.choices(range(97, 101), k=176))
    runs = [core, core[:150] + b"#" * 26, b"%" * 10 + core[10:], core[:120] + b"!" * 56]
    text = np.frombuffer(b"".join(runs), np.uint8).reshape(4, 176)
    found = {(n, tuple(sorted(zip(r.tolist(), (60 - d).tolist(), strict=True)))) for n, r, d in suffix.maximal_repeats(np.zeros(4, int), text, np.full(4, 176), np.full(4, 60))}
    assert (176 - 10, ((0, 10), (2, 10))) in found and (150, ((0, 0), (1, 0))) in found
    assert (110, ((0, 10), (1, 10), (2, 10), (3, 10))) in found


def test_suffix_stage_is_brute_force(spark):
    """Only repeated passages go, and no character that any of their bytes belongs to stays in part."""
    rnd = random.Random(31)
    passages = ["".join(rnd.choices("abcd é", k=k)) for k in (110, 140, 300)]
    rows = [(i, "".join(rnd.choice([rnd.choice(passages), "".join(rnd.choices("wxyz ü", k=rnd.randrange(90)))]) for _ in range(rnd.randrange(5)))) for i in range(80)]
    kept = {r.doc_id: r.text for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(kept) == len(rows)
    for (d, t), mask in zip(rows, removed(rows), strict=True):
        at, expected = 0, []
        for c in t:
            n = len(c.encode())
            if not mask[at : at + n].any():
                expected.append(c)
            at += n
        assert kept[d] == "".join(expected), d


# 5, 9 -------------------------------------------------------------------------------------------------------------


def accuracy(scored, labels, name):
    rows = scored.join(labels.where(F.col(name).isNotNull()), "doc_id").where("held_out").collect()
    return np.mean([r.predicted == r[name] for r in rows]), len(rows)


def test_quality_held_out(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    share, n = accuracy(quality.quality_scores(docs, known), known, "quality")
    assert n > 80 and share > 0.95


def test_toxicity_held_out(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    share, n = accuracy(toxicity.toxicity_scores(docs, known), known, "toxic")
    assert n > 80 and share > 0.93


@pytest.mark.parametrize("f", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_odd(spark, odd, none, labels, f):
    got = f(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert f(none, labels).count() == 0 and f(odd, labels.limit(0)).count() == odd.count()


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "clown": 5.0, "vequ*": 4.0})
    plain = lexicon.weigh("you idiot")[0]
    assert plain == 5.0 and lexicon.weigh("you 1d10t")[0] == 5.0 and lexicon.weigh("you idіоt")[0] == 5.0
    assert lexicon.weigh("idiotic")[0] == 0.0 and lexicon.weigh("vequille")[0] == 4.0 and lexicon.weigh("a clown fish")[0] == 0.0
    spans = toxicity.Lexicon({"idiot": 5.0, "idiot*": 3.0, "ash": 4.5, "lowe*": 4.0, "trash": 5.0, "ras*": 4.0})
    for text, weight in [("you idiot", 8.0), ("the trash can, you idiot", 8.0), ("you idiot by the trash can", 8.0), ("trash", 5.0), ("a trash can of trash", 5.0), ("trash cans", 5.0), ("idiotic", 3.0)]:
        assert spans.weigh(text)[0] == weight, text
    assert lexicon.score("idiot " + "word " * 5) > lexicon.score("idiot " + "word " * 5000) > lexicon.score("word")
    assert toxicity.Lexicon({}).weigh("idiot")[0] == 0.0


def test_lexicon_is_the_same_at_any_partitioning(spark):
    rows = [("vile " * 3 + f"t{i}", 1) for i in range(4)] + [("dirt " * 3 + f"s{i}", 1) for i in range(4)]
    rows += [(f"calm{'abcdefghij'[i // 26 % 10]}{chr(97 + i % 26)} day{chr(97 + i % 26)}" + (" dirt" if i % 30 == 0 else ""), 0) for i in range(240)]
    df = spark.createDataFrame(rows, "text string, label int")
    learned, held = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            learned.append(toxicity.learn(df).terms)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert learned[0] == learned[1] and any("vile".startswith(t.rstrip("*")) for t in learned[0]) and not any("dirt".startswith(t.rstrip("*")) for t in learned[0])


def test_matching_is_plain_matching():
    """Aho-Corasick against a search for every term and phrase at every place."""
    rnd = random.Random(37)
    terms = {"ab": 1.0, "ab*": 2.0, "ba": 4.0, "bab*": 8.0, "c": 16.0, "cab": 32.0}
    phrases = ("ab c", "cab ba", "c", "ba ba ba")
    lexicon = toxicity.Lexicon(terms, phrases)
    for _ in range(3000):
        text = "".join(rnd.choices("abc ,", k=rnd.randrange(24)))
        at = lambda key, i, stem: text.startswith(key, i) and not text[i - 1 : i].isalpha() * (i > 0) and (stem or not text[i + len(key) : i + len(key) + 1].isalpha())  # noqa: B023, E731
        spared = [(i, i + len(p)) for p in phrases for i in range(len(text)) if at(p, i, False)]
        total = 0.0
        for term, weight in terms.items():
            key = term.rstrip("*")
            for i in range(len(text)):
                if at(key, i, term.endswith("*")) and not any(s <= i and i + len(key) <= e for s, e in spared):
                    total += weight
        assert lexicon.weigh(text)[0] == total, text


def test_ftrl_is_the_dense_loop(spark):
    """Sparse updates and dot products against the same rule written over whole vectors."""
    rnd = random.Random(41)
    rows = [(i, " ".join(rnd.choices("good fine clear" .split() if i % 2 else "junk spam click".split(), k=6)), i % 2) for i in range(40)]
    bits = 8
    weights = quality.train(spark.createDataFrame(rows, "doc_id long, text string, label int"), epochs=2, bits=bits)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    hasher = quality.Hasher()

    def dense(text):
        x = np.zeros((1 << bits) + 1)
        idx, scale = quality.features(text, hasher, bits)
        np.add.at(x, idx, 1.0)
        x = (x * scale).astype(np.float32).astype(float)
        x[-1] = 1.0
        return x

    def current():
        return np.where(np.abs(z) <= 0.02, 0.0, -(z - np.sign(z) * 0.02) / ((1.0 + np.sqrt(n)) / 0.3 + 0.1))

    for _ in range(2):
        for _, text, y in sorted(rows, key=lambda r: xxhash.xxh64_intdigest(str(r[0]))):
            x, w = dense(text), current()
            g = (1 / (1 + np.exp(-w @ x)) - y) * x
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.3 * w
            n += g * g
    assert np.allclose(weights, current(), atol=1e-5) and np.abs(weights).max() > 0.1
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, label int"), weights, "doc_id long", ["doc_id"], bits).collect()}
    assert all(abs(got[d] - 1 / (1 + np.exp(-current() @ dense(t)))) < 1e-4 for d, t, _ in rows)


def test_ftrl_learns():
    model = quality.FTRL(bits=4)
    for _ in range(200):
        model.update(np.array([1, 16]), np.ones(2), 1)
        model.update(np.array([2, 16]), np.ones(2), 0)
    w = model.weights()
    assert w[1] > 0.5 and w[2] < -0.5 and w[3] == 0


# 6 ----------------------------------------------------------------------------------------------------------------


def simple_print(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in regex.findall("[^\x20\x09-\x0d]+", text)]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, errors=2):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(prints, np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= errors).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(arr))]


def test_simhash_documents(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    rows = sorted(texts(docs))
    prints = [simple_print(t) for _, t in rows]
    for (d, _), p, root in zip(rows, prints, linked(prints), strict=True):
        assert (got[d].fingerprint, got[d].component_id) == (f"{p:016x}", rows[root][0])


@pytest.mark.parametrize("crowd", [1500, 3])
def test_golay_links_lose_nothing(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rnd = random.Random(11)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        p = rnd.getrandbits(64)
        prints.add(p)
        for _ in range(rnd.randrange(12)):
            p ^= sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 5)))
            prints.add(p)
    prints = sorted(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()
    place = {signed(p): i for i, p in enumerate(prints)}
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2 for r in found)
    nodes = components.components(spark.createDataFrame([(place[r.a], place[r.b]) for r in found], "a long, b long")).collect()
    whole = dict(enumerate(range(len(prints)))) | {r.node: r.component for r in nodes}
    assert [whole[i] for i in range(len(prints))] == linked(prints)


def test_golay_code_is_perfect():
    index = simhash.decoder()
    assert len(np.unique(index)) == 4096 and set(np.bincount(index).tolist()) == {2048}


@pytest.mark.parametrize("last", [0, 40, 250_000])
def test_components_contracted_and_at_once(spark, last):
    rng = np.random.default_rng(3)
    ids = rng.permutation(400).tolist()
    pairs = [(ids[0], x) for x in ids[1:90]] + list(itertools.pairwise(ids[100:160])) + [(int(a), int(b)) for a, b in rng.choice(ids[200:], (150, 2))]
    root = {x: x for pair in pairs for x in pair}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long"), last=last).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_components_of_a_path(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components.components(links.limit(0)).count() == 0


def test_simhash_odd(spark, odd, none):
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0


def test_near_duplicates_by_shingles(spark):
    rnd = random.Random(13)
    words = ["".join(rnd.choices("aeioust", k=5)) for _ in range(3000)]
    rows = []
    for _ in range(40):
        base = rnd.choices(words, k=rnd.randrange(60, 300))
        rows.append(base)
        for _ in range(rnd.randrange(4)):
            copy = base.copy()
            for _ in range(rnd.randrange(0, max(2, len(base) // 60))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(copy)
    hot = rnd.choices(words, k=200)
    for _ in range(120):  # a crowd made from one text
        copy = hot.copy()
        for at in rnd.sample(range(200), 2):
            copy[at] = rnd.choice(words)
        rows.append(copy)
    rows.append(hot)
    data = [" ".join(r) for r in rows]
    df = spark.createDataFrame(list(enumerate(data)), "key long, text string")
    got = {r.key: r.leader for r in neardup.groups(df).collect()}
    sets = [neardup.shingles(t) for t in data]
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    true = [root(i) for i in range(len(data))]
    assert all(true[got[i]] == true[i] for i in got)  # nothing joined wrongly
    assert np.mean([got[i] == true[i] for i in got]) > 0.97


def grouped(data):
    """The least index of each text's group, by brute force."""
    sets, parent = [neardup.shingles(t) for t in data], list(range(len(data)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(len(data)):
        for j in range(i):
            a, b = root(i), root(j)
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                    parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(data))]


def leaders(spark, data):
    got = {r.key: r.leader for r in neardup.groups(spark.createDataFrame(list(enumerate(data)), "key long, text string")).collect()}
    return [got[i] for i in range(len(data))]


def changed(rnd, base, words, n):
    copy = base.copy()
    for at in rnd.sample(range(len(base)), n):
        copy[at] = rnd.choice(words)
    return copy


@pytest.mark.parametrize("n, edits", [(300, (1, 4)), (1100, (3, 5))])
def test_near_duplicates_in_crowds_without_base(spark, n, edits):
    rnd = random.Random(n)
    words = ["".join(rnd.choices("aeioust", k=5)) for _ in range(3000)]
    base = rnd.choices(words, k=200)
    data = [" ".join(changed(rnd, base, words, rnd.randint(*edits))) for _ in range(n)]
    assert leaders(spark, data) == grouped(data)


@pytest.mark.parametrize("kind", ["two", "four", "short", "nested", "chain"])
def test_near_duplicates_in_crowds_of_600(spark, kind):
    """Stars of two and of four changes, short templates, templates of a template, and a chain that drifts."""
    rnd = random.Random(kind)
    words = ["".join(rnd.choices("aeioust", k=6)) for _ in range(5000)]
    base = rnd.choices(words, k=60 if kind == "short" else 200)
    if kind == "nested":
        inner = [changed(rnd, base, words, 6) for _ in range(20)]
        rows = [changed(rnd, rnd.choice(inner), words, 2) for _ in range(600)]
    elif kind == "chain":
        rows = [base]
        while len(rows) < 600:
            rows.append(changed(rnd, rows[-1], words, 2))
    else:
        rows = [changed(rnd, base, words, {"two": 2, "four": 4, "short": 1}[kind]) for _ in range(600)]
    data = [" ".join(r) for r in rows]
    assert leaders(spark, data) == grouped(data)


@pytest.mark.parametrize("kind", ["four", "nested"])
def test_near_duplicates_in_crowds_over_many_tasks(spark, monkeypatch, kind):
    """Shingles that are in most texts, over the rows that one task meets: salted, and in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 24)
    test_near_duplicates_in_crowds_of_600(spark, kind)


def test_salted_shingles_keep_their_rows():
    often, ways = np.array([5, 9], np.uint64), np.array([1, 7])
    keys, split = neardup.salted(np.array([3, 5, 9], np.uint64), -4, often, ways)
    assert split.tolist() == [False, False, True] and keys[:2].tolist() == [3, 5] and keys[2] != 9
    found = {int(neardup.salted(np.array([9], np.uint64), n, often, ways)[0][0]) for n in range(100)}
    assert len(found) == 7


def test_near_duplicates_with_edits_in_one_place(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("aeioust", k=4)) for _ in range(2000)]
    data = []
    for n in range(60, 460, 4):
        base = rnd.choices(words, weights=[1 / (i + 1) for i in range(2000)], k=n)
        more = rnd.choices(words, k=n // 6)
        at = rnd.randrange(n - n // 12)
        data += [" ".join(x) for x in (base, base + more, base[:at] + more[: n // 12] + base[at + n // 12 :])]
    true = grouped(data)
    assert len(set(true)) < 200 and leaders(spark, data) == true


def test_near_duplicates_of_the_same_words_in_other_orders(spark):
    words = [f"w{i}" for i in range(100)]
    data = [" ".join(x) for x in (words[::-1], words, words[50:] + words[:50])]
    assert grouped(data) == [0, 1, 1] and leaders(spark, data) == [0, 1, 1]


def test_near_duplicates_by_simhash(spark):
    """What the SimHash operator links is one group where shingles alone say otherwise, and both kinds of links add up."""
    rnd = random.Random(17)
    words = ["".join(rnd.choices("aeioust", k=6)) for _ in range(5000)]
    alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    data = ["", "one", "two"]
    while len(data) < 27:  # a text; one that only SimHash links to it; one that only shingles link to that one; another text
        base = rnd.choices(words, k=300)
        copy = changed(rnd, base, words, 9)
        near = copy + rnd.choices(words, k=40)
        three = [" ".join(x) for x in (base, copy, near)]
        p, q, r = map(simple_print, three)
        x, y, z = map(neardup.shingles, three)
        if (p ^ q).bit_count() <= 2 < min((p ^ r).bit_count(), (q ^ r).bit_count()) and not alike(x, y) and not alike(x, z) and alike(y, z):
            data += [*three, " ".join(rnd.choices(words, k=300))]
    base = rnd.choices(words, k=100)
    data += [" ".join(changed(rnd, base, words, 2)) for _ in range(40)]  # a crowd
    rows = [(i, t, "x") for i, t in enumerate(data)]
    by_words, by_prints = grouped(data), linked([simple_print(t) for t in data])
    parent = list(range(len(data)))
    for _ in data:
        for i in range(len(data)):
            for j in (by_words[i], by_prints[i]):
                parent[i] = parent[j] = min(parent[i], parent[j])
    assert sum(i == p for i, p in enumerate(parent)) <= sum(i == g for i, g in enumerate(by_words)) - 6
    left = neardup.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, extra string")).collect()
    assert sorted(r.doc_id for r in left) == [i for i, p in enumerate(parent) if i == p]


# 7 ----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    body = "<p>one page that comes again and again, longer than a hundred bytes, so that it is worth a revisit</p>" * 2
    rows = [(5, "http://a b/\r\nX: y", body), (3, "http://b", body), (3, "http://b", body), (9, None, "short"), (10, "c", "short"), (11, "d", None), (12, "e", ""), (13, "f", "é中" * 200_000), (None, "g", body), (None, None, "z" * 200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write_archives(df, str(tmp_path), size=4096)
    got = sorted((str(r.page_id), r.payload_digest, r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.read_archives(manifest).collect())
    expected = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = html == body and page != 3
        expected.append((str(page), hashlib.sha256(raw).hexdigest(), len(raw), "revisit" if again else "response", "3" if again else "None"))
    assert got == sorted(expected)
    for name in os.listdir(tmp_path):
        if name.endswith(".zst"):
            data = (tmp_path / name).read_bytes()
            assert data[:4] == b"\x5d\x2a\x4d\x18" and all(r.startswith(b"WARC/1.1\r\n") for r in warc.records(data))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_of_many_partitions_is_few_files(spark, tmp_path):
    """A small table dealt over many tasks: one file names the archives, and tasks to read them go by bytes."""
    df = spark.range(0, 300, 1, 40).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('page ', id % 200), 30) AS html")
    manifest = warc.write_archives(df, str(tmp_path))
    assert manifest.count() > 20 and len(manifest.inputFiles()) == 1
    back = warc.read_archives(manifest)
    assert back.rdd.getNumPartitions() == 1
    got = {r.page_id: (r.record_type, r.refers_to) for r in back.collect()}
    assert got == {i: ("response", None) if i < 200 else ("revisit", i - 200) for i in range(300)}


# 8 ----------------------------------------------------------------------------------------------------------------


def test_word_tokenizer_is_the_library():
    with open(WORDS, encoding="utf-8") as file:
        spec = file.read()
    ours, theirs = packing.WordTokenizer(spec), Tokenizer.from_str(spec)
    theirs.encode_special_tokens = True
    rnd = random.Random(17)
    letters = " \n\tabcdeABC's't123éßñ_!?#$ªº±µ·¶©Àþ/<|endoftext|>ΣİДж中"
    for text in ["".join(rnd.choices(letters, k=rnd.randrange(30))) for _ in range(3000)] + ["", "a" * 3000]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_new_words_take_no_more_than_the_library():
    with open(WORDS, encoding="utf-8") as file:
        spec = file.read()
    ours, theirs = packing.WordTokenizer(spec), Tokenizer.from_str(spec)
    theirs.encode_special_tokens = True
    rnd = random.Random(31)
    ours.encode("a"), theirs.encode("a")

    def took(f, text):
        began = time.process_time()
        found = f(text)
        return time.process_time() - began, found

    for text in ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéß", k=20_000)), "x" * 50_000]:  # merging pair by pair in Python took seconds
        own, ids = took(ours.encode, text)
        least, whole = took(lambda t: theirs.encode(t, add_special_tokens=False).ids, text)
        assert np.frombuffer(ids, "<u4").tolist() == whole
        assert own <= 20 * least + 0.2


def test_word_tokenizer_on_every_plain_character():
    with open(WORDS, encoding="utf-8") as file:
        spec = file.read()
    ours, theirs = packing.WordTokenizer(spec), Tokenizer.from_str(spec)
    plain = [chr(c) for c in range(256) if packing._PLAIN.match(chr(c))]
    assert len(plain) > 200
    for c in plain:
        for text in (c, f"ab{c}cd", f"1{c}'s{c}{c} !{c}?\n{c}a"):
            assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_full_memos_change_no_ids(monkeypatch):
    with open(WORDS, encoding="utf-8") as file:
        spec = file.read()
    monkeypatch.setattr(packing, "CHUNKS", 20)
    monkeypatch.setattr(packing, "WORDS", 10)
    monkeypatch.setattr(packing, "worker_cache", lambda key, make: make())
    ours, theirs = packing.WordTokenizer(spec), Tokenizer.from_str(spec)
    rnd = random.Random(37)
    for _ in range(200):
        text = " ".join("".join(rnd.choices("abcdé1!", k=rnd.choice([1, 2, 5, 90]))) for _ in range(20))
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert len(ours.chunks) == 20


def check_packing(rows, limit=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins)


def test_packing(spark):
    with open(WORDS, encoding="utf-8") as file:
        spec = file.read()
    found = packing.pieces(documents(spark), spec, with_ids=True)
    ids = {}
    for r in found.collect():
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        ids.setdefault(r.doc_id, {})[r.piece] = r
    theirs = Tokenizer.from_str(spec)
    for d, t in texts(documents(spark)):
        whole = b"".join(ids[d][p].ids for p in sorted(ids[d]))
        assert np.frombuffer(whole, "<u4").tolist() == [*theirs.encode(t, add_special_tokens=False).ids, 1]
        assert all(ids[d][p].length == 4096 for p in sorted(ids[d])[:-1])
    packed = packing.pack(found, group=80).collect()
    assert len(packed) == found.count()
    least = math.ceil(sum(r.length for r in packed) / 4096)
    assert check_packing(packed) <= least + 2


def test_packing_odd(spark, odd, none):
    with open(WORDS, encoding="utf-8") as file:
        spec = file.read()
    packed = packing.pack(packing.pieces(odd, spec)).collect()
    check_packing(packed)
    assert sum(r.piece == 0 for r in packed) == odd.count() and packing.pack(packing.pieces(none, spec)).count() == 0


def test_completion_is_optimal_on_small_cases():
    def fewest(lengths, limit):
        best = [len(lengths)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + lengths[i] <= limit:
                    place(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
            place(i + 1, [*bins, lengths[i]])

        place(0, [])
        return best[0]

    rnd = random.Random(19)
    worse = 0
    for _ in range(150):
        lengths = sorted((rnd.randrange(1, 60) for _ in range(9)), reverse=True)
        search = packing.Completion(lengths, 60)
        bins = search.pack()
        assert search.bound() <= len(bins)
        assert sorted(i for b in bins for i in b) == list(range(9)) and all(sum(lengths[i] for i in b) <= 60 for b in bins)
        worse += len(bins) - fewest(lengths, 60)
    assert worse == 0


def test_more_steps_never_give_more_sequences():
    rnd = random.Random(29)
    for low, high, n, limit in [(100, 500, 60, 1000)] * 12 + [(900, 2100, 300, 4096), (1, 4096, 400, 4096)]:
        lengths = [rnd.randint(low, high) for _ in range(n)]
        counts = []
        for steps in (0, 30, 300, 3_000, 30_000):
            search = packing.Completion(lengths, limit, steps)
            bins = search.pack()
            assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(lengths[i] for i in b) <= limit for b in bins)
            counts.append(len(bins))
        assert counts == sorted(counts, reverse=True) and counts[0] == len(search.best_fit()) and counts[-1] >= search.bound()


# 10 ---------------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    vectors = [(i, [math.floor(1024.0 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, x in vectors:
        if q % 100 == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y, strict=False)))), i) for i, y in vectors if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def got_top(df, k=10, block=64):
    out = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k, block).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_top_k(spark):
    rnd = random.Random(23)
    rows = [(i, [rnd.choice([-1.0, 0.5, 0.25, rnd.uniform(-1, 1)]) for _ in range(6)]) for i in range(350)]
    rows[7] = (7, None)
    rows[8], rows[9], rows[10] = (8, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9, [float("nan")] * 6), (10, [float("inf")] * 6)
    rows[20:60] = [(i, rows[60][1]) for i in range(20, 60)]  # ties over the boundary
    rows += [(None, [1.0] * 6), (-100, [-1.0] * 6), (900, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    assert got_top(df) == brute_top(rows, 10)
    assert got_top(df.where("vec_id in (0, 100)")) == brute_top([r for r in rows if r[0] in (0, 100)], 10)
    assert got_top(df.limit(0)) == {} and got_top(df.where("vec_id = 0")) == {}


def test_top_k_repeated_ids(spark):
    """Each row but the query's own takes part, in the operator as in its SQL."""
    rows = [(i, [float(i % 7), 1.0, -0.5]) for i in range(40)] + [(0, [3.0, 1.0, 0.25]), (5, [9.0, 0.0, 0.0]), (5, [9.0, 0.0, 0.0]), (100, [1.0, 1.0, 1.0])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(con.execute(queries.OP10).fetchall()) and len(got) == 30


def test_top_k_large_components(spark):
    rows = [(i, [1e5 * (i - 50), 3.0]) for i in range(0, 120)]
    assert got_top(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute_top(rows, 10)


# queries ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), "NULL").map(lambda v: str(int(v)) if isinstance(v, (int, float)) else str(v)).values.tolist()))
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert isinstance(ours, pd.DataFrame) and plain(ours) == plain(theirs)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash_near_dedup", "suffix_dedup", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and check_packing(rows) <= math.ceil(sum(r.length for r in rows) / 4096) + 2


def test_pipeline_stages_odd(spark, odd, none):
    import corpus_pipeline

    for df in (odd, none):
        n, docs = df.count(), df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
                assert out.count() <= n
                docs = out
            else:
                assert (out.count() > 0) == (n > 0)
