"""Operators 11 to 13 against brute force, the library of crc32, or bounds."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrazone.llm import collocations, context_mixing, resampling

DOCS = "doc_id long, text string, lang string, rank string, score string, row string, words string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = ["alpha", "Beta", "gamma", "d", "É", "x1", "中文", "delta" * 14, "the", "of"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", ", ", ".\n", "  ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " ,. ", "one", "\x00a\x00b", "a" * 300 + " " + "b" * 500, "the of " * 30000, texts[3], texts[3], "\x0b\x0c\r\n", "Ä ß x"]
    rows = [(i, t, ("en", "fr", None, "und")[i % 4], "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, texts[7], "en", "c", "c", "c", "c"), (7, "other words with id seven " * 6, "en", "c", "c", "c", "c")]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return words, [zlib.crc32(f.encode()) % 10000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def test_resampling(spark, corpus):
    target = ["the of alpha", None, "gamma 中文 beta, beta"]
    df = spark.createDataFrame(corpus, DOCS)
    s, t = Counter(b for r in corpus for b in features(r[1])[1]), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    want = []
    for r in corpus:
        words, buckets = features(r[1])
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in buckets) // max(1, len(buckets))
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        want.append((r[0], len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    able = sorted((w for w in want if w[4]), key=lambda w: (-w[3], math.inf if w[0] is None else w[0]))
    size = 25 * len(able) // 100
    found = resampling.resample(df, spark.createDataFrame([(x,) for x in target], "text string")).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in found) == Counter(w[:4] for w in want)
    drawn = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, size + 1))
    assert [(r.doc_id, r.score) for r in drawn] == [(w[0], w[3]) for w in able[:size]]


def test_resampling_carries_rows_and_takes_empty_tables(spark, corpus):
    df, target = spark.createDataFrame(corpus, DOCS), spark.createDataFrame([("the of",)], "text string")
    kept = resampling.keep_drawn(df, target, share=50)
    assert kept.columns == df.columns
    whole, taken = Counter(tuple(r) for r in df.collect()), Counter(tuple(r) for r in kept.collect())
    assert taken and not taken - whole
    assert resampling.resample(df.limit(0), target).collect() == []
    nothing = resampling.resample(df, target.limit(0)).collect()
    assert len(nothing) == len(corpus)


def test_resampling_of_equal_scores(spark):
    """All rows have one id and one text but for a few: ranks still run without gaps, and the draw has its size."""
    rows = [(4, "same words here " * 10)] * 40 + [(5, "few words")] * 3
    found = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("same",)], "text string")).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 11))


def test_crc_of_pairs_equals_the_library():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé1") for _ in range(rng.choice([1, 2, 7, 63, 64, 65, 200]))) for _ in range(80)]
    bucket, text, sizes = resampling.Features(1 << 32).of([" ".join(words).encode(), b"", words[0].encode()])
    want = [zlib.crc32(f.encode()) for f in [*words, *map(" ".join, zip(words, words[1:]))]]
    assert sorted(bucket[text == 0].tolist()) == sorted(want) and sizes.tolist() == [80, 0, 1]


def brute_collocations(rows, least, inside, top):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + size])) for size in range(1, 5) for i in range(len(words) - size + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, w), a in often.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                around[lang, w[i : i + size]] = max(around[lang, w[i : i + size]], a)
    out = []
    for lang in n:
        found = []
        for (other, w), a in often.items():
            if other == lang and not 100 * around[lang, w] >= inside * a:
                sides = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
                score, k = min((2000000 * a // (x + y), k) for k, (x, y) in enumerate(sides))
                found.append((-score, -a, " ".join(w).encode(), *sides[k]))
        out += [(lang, i + 1, w.decode(), -a, x, y, n[lang], -s) for i, (s, a, w, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations(spark, corpus, monkeypatch):
    extra = [(300 + i, t, lang, "c", "c", "c", "c") for i, (t, lang) in enumerate([("New York City hall, new york city HALL. new york", "en"), ("a\x00b c a\x00b d\x00 a c", "nul"), ("one two three four five\tone  two three", None), ("one two three four", "en")] * 9)]
    rows = corpus + extra
    df = spark.createDataFrame(rows, DOCS)
    for least, inside, top in ((9, 80, 2000), (2, 50, 7)):
        found = sorted(tuple(r) for r in collocations.collocations(df, least, inside, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
        assert found == brute_collocations(rows, least, inside, top)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_counts_spill_to_folders_that_are_not_there_yet(tmp_path, monkeypatch):
    monkeypatch.setattr(collocations, "MEMORY", "48MB")

    def batches():
        for i in range(60):
            grams = [f"word{k} another{k % 977} longer words {k * 7919}" for k in range(i * 10_000, (i + 1) * 10_000)]
            yield pa.RecordBatch.from_arrays([pa.array(["en"] * 10_000), pa.array(grams), pa.array([4] * 10_000, pa.int32()), pa.array([1] * 10_000)], schema=collocations.COUNTS)

    for spill in (str(tmp_path / "not" / "there"), ""):
        assert sum(b.num_rows for b in collocations.added_up(batches(), 1, spill)) == 600_000
    assert list((tmp_path / "not" / "there").iterdir()) == []


def test_collocations_with_a_full_bitmap_and_small_slices(spark, corpus, monkeypatch):
    """Where all runs share eight bits and each piece is a slice, counts are the same."""
    monkeypatch.setattr(collocations, "SLICE", 1)
    df = spark.createDataFrame(corpus, DOCS)
    held = collocations.cut(collocations.pieces(df), "pieces")
    full = spark.sparkContext.broadcast(b"\xff" * (collocations.BITS // 8))
    some = collocations.count_runs(held, (3, 4), full, 5, collocations.spill_folder(held), 3).collect()
    assert {(r.lang, r.gram, r.f) for r in some} == {(r.lang, r.gram, r.f) for r in collocations.frequent_runs(held, 5).where("words > 2").collect()}


def test_collocation_scores_of_counts_beyond_64_bits(spark):
    big = 6_000_000_000_000_000_000
    rows = [("x", "a", 1, big), ("x", "b", 1, big), ("x", "a b", 2, big - 1), ("x", "c", 1, big - 3), ("x", "a b c", 3, 7), ("x", "b c", 2, 9)]
    found = {r.phrase: r for r in collocations.scored(spark.createDataFrame(rows, collocations.COUNTS_SQL)).collect()}
    assert found["a b"].score == 2000000 * (big - 1) // (2 * big)
    assert (found["a b c"].l, found["a b c"].r, found["a b c"].score) == (big, 9, 0)


def test_counts_are_added_up_beyond_the_memory_of_duckdb(monkeypatch, tmp_path):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "MEMORY", "20MB")
    some = [pa.RecordBatch.from_arrays([pa.array(["en"] * 50000), pa.array([f"a long run of words {i * 50000 + j}" for j in range(50000)]), pa.array([5] * 50000, pa.int32()), pa.array([1] * 50000)], schema=collocations.COUNTS) for i in range(20)]
    assert sum(b.num_rows for b in collocations.added_up(iter([*some, some[3]]), 1, str(tmp_path))) == 1_000_000
    assert sum(b.num_rows for b in collocations.added_up(iter([*some, some[3]]), 2, str(tmp_path))) == 50_000
    assert list(tmp_path.iterdir()) == []


def lm_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", low(text)), ""]


def test_lm_base_scores(spark, corpus):
    df = spark.createDataFrame(corpus, DOCS)
    c, held = Counter(), lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
    for r in corpus:
        c.update([] if held(r) else lm_tokens(r[1]))
    whole = sum(c.values()) + len(c) + 1
    want = sorted((-1 if r[0] is None else r[0], held(r), len(lm_tokens(r[1])), sum(c[t] > 0 for t in lm_tokens(r[1])), round(sum(math.log10((c[t] + 1) / whole) for t in lm_tokens(r[1])), 5)) for r in corpus)
    found = context_mixing.score_texts(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in found) == want
    assert {r.train_tokens for r in found} == {sum(c.values())}
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    assert context_mixing.score_texts(df.limit(0)).collect() == []


def test_lm_scores_are_the_same_for_the_same_counts_whatever_document_they_come_from(spark):
    texts = [f"a{k} b c a{k} d" for k in range(40)]
    rows = [(k, t, k < 40) for k, t in enumerate([*texts, "a1 b c", "x y"])]
    # one long training text has the words of two; what a sample would take, or leave, is learned from alike
    long = [(0, " ".join(f"w{k % 50}" for k in range(9000)), True), *rows[1:]]
    assert not any(hasattr(context_mixing, n) for n in ("SAMPLE", "fitted"))
    for told in (rows, long):
        df = spark.createDataFrame(told, "doc_id long, text string, learned boolean")
        once, again = ({r.doc_id: r.score for r in context_mixing.score_texts(x, F.col("learned")).collect()} for x in (df, df.withColumn("doc_id", 100 - F.col("doc_id"))))
        assert {100 - k: v for k, v in again.items()} == once


def test_lm_base_scores_with_few_usual_words(spark, corpus, monkeypatch):
    """Tokens whose counts are asked for get the same base score as those at hand."""
    df = spark.createDataFrame(corpus, DOCS)
    want = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in context_mixing.score_texts(df).collect())
    monkeypatch.setattr(context_mixing, "USUAL", 2)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in context_mixing.score_texts(df).collect()) == want


def test_lm_learns(spark):
    """Held-out texts of the training's kind cost less than by counts of words alone, and less than shuffled ones."""
    rng = random.Random(2)
    lines = ["the cat sat on the mat", "a dog ran over the hill", "le chat est sur la table", "un chien court vers la colline", "rain falls on the plain in spain"]
    rows = [(i, " ".join(rng.choice(lines) for _ in range(30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in context_mixing.score_texts(df).collect() if r.held_out]
    assert held and sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)
    mixed = [(i, t if zlib.crc32(str(i).encode()) % 7 != 2 else " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows]
    worse = [r for r in context_mixing.score_texts(spark.createDataFrame(mixed, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in worse) < sum(r.score for r in held)


def test_lm_code_lengths_are_a_distribution():
    """The costs of all tokens that a small alphabet spells, and of all usual words, sum to less than one, and prefix codes to one."""
    letters = [1] * 256
    coder = context_mixing.Coder([(b"aa", 5), (b"b", 2), (b"", 9)], 3, letters)
    for code in (coder.words, coder.letters):
        assert sum(2.0 ** -int(n) for n in code.size) == 1.0
    told = np.random.default_rng(1).integers(-60, 60, (3, 1 << 12)).astype(np.int16) * 256 + 3
    mixer = context_mixing.Mixer(told, 12, np.full((3, context_mixing.GATES), 0.4))
    words, spelled = mixer.costs(coder.read([b"", b"aa", b"b", b"zz"]))[0], mixer.spell_costs(coder, [bytes([x]) for x in range(256) if x != 32])
    end = words[0]
    assert math.exp(-end) + sum(math.exp(-c) for c in words[1:]) <= 1 and sum(math.exp(-c) for c in spelled) <= 1


def test_lm_costs_of_a_text_stand_alone(monkeypatch):
    """What else is in the slice changes no cost; contexts reach over the start of a segment."""
    monkeypatch.setattr(context_mixing, "SEGMENT", 8)
    monkeypatch.setattr(context_mixing, "BLOCK", 4)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["ab", "c", "déf", "\x00", "gh" * 9], n)).encode() for n in (0, 3, 40, 41, 7)]
    coder = context_mixing.Coder([(b"ab", 5), (b"", 9)], 3, [1] * 256)
    told = rng.integers(-90, 90, (3, 1 << 12)).astype(np.int16) * 256 + rng.integers(0, 15, (3, 1 << 12)).astype(np.int16)
    mixer = context_mixing.Mixer(told, 12, np.full((3, context_mixing.GATES), 0.4))
    together = mixer.costs(coder.read(texts))[0]
    assert together.tolist() == [mixer.costs(coder.read([t]))[0][0] for t in texts]


def test_lm_costs_are_those_of_a_plain_loop(monkeypatch):
    """Decision by decision and block by block, whatever the segments read side by side; words at hand never become Python objects."""
    monkeypatch.setattr(context_mixing, "SEGMENT", 8)
    monkeypatch.setattr(context_mixing, "BLOCK", 4)
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["ab", "c", "d", "xy"], n)).encode() for n in (0, 3, 40, 7, 18)]
    coder = context_mixing.Coder([(b"ab", 5), (b"c", 4), (b"", 9)], 3, [1] * 256)
    told = rng.integers(-90, 90, (3, 1 << 12)).astype(np.int16) * 256 + rng.integers(0, 15, (3, 1 << 12)).astype(np.int16)
    mixer = context_mixing.Mixer(told, 12, np.full((3, context_mixing.GATES), 0.4))
    seq = coder.read(texts)
    found = mixer.costs(seq)[0]
    monkeypatch.setattr(context_mixing, "LANES", 2)
    assert mixer.costs(coder.read(texts))[0].tolist() == found.tolist()
    assert sorted(seq.spelled()[0]) == [b"d", b"xy"] and isinstance(seq.distinct, pa.Array)

    each = [[list(zip(*map(np.concatenate, zip(*[(s[p == pair], b[p == pair]) for s, b, p in seq.decisions(expert, 12)])))) for pair in range(len(seq.size[expert]))] for expert in range(3)]
    at = 0
    for text, (size, cost) in enumerate(zip(seq.sizes, found)):
        want = 0.0
        for low in range(0, size, 4):
            if low % 8 == 0:
                weights = np.full((3, 16), 0.4)
            slope, met = np.zeros((3, 16)), np.zeros(16)
            for token in range(at + low, at + min(low + 4, size)):
                for of in zip(*[each[expert][seq.pair[expert][token]] for expert in range(3)]):
                    values = [int(told[expert][slot]) for expert, (slot, _) in enumerate(of)]
                    gate = 4 * min(3, (values[0] % 16 + 1) // 2) + min(3, (values[1] % 16 + 1) // 2)
                    x, sign = np.array([v >> 8 for v in values]) / 16, 2 * int(of[0][1]) - 1
                    e = math.exp(-sign * float(weights[:, gate] @ x))
                    want += math.log1p(e)
                    slope[:, gate] += sign * e / (1 + e) * x
                    met[gate] += 1
            weights = weights + slope * context_mixing.RATE / (met + context_mixing.DAMP)
        at += size
        assert abs(want - cost) < 1e-3 * max(1, want), text


def test_lm_hashes_what_needs_no_context_once_for_a_worker(monkeypatch):
    """A slice hashes the decisions of its pairs with a context alone; those without one are kept."""
    rng = np.random.default_rng(3)
    coder = context_mixing.Coder([(b"ab", 5), (b"c", 4), (b"", 9)], 3, [1] * 256)
    told = rng.integers(-90, 90, (3, 1 << 12)).astype(np.int16) * 256 + rng.integers(0, 15, (3, 1 << 12)).astype(np.int16)
    mixer = context_mixing.Mixer(told, 12, np.full((3, context_mixing.GATES), 0.4))
    texts = [b"ab c d ab", b"", b"c c xy"]
    once = mixer.costs(coder.read(texts))[0].tolist()
    hashed, plain = [], context_mixing.slots_of
    monkeypatch.setattr(context_mixing, "slots_of", lambda hashes, slot_bits: hashed.append(hashes.size) or plain(hashes, slot_bits))
    seq = coder.read(texts)
    assert mixer.costs(seq)[0].tolist() == once
    assert sum(hashed) == sum(int(seq.size[expert].sum()) for expert in (1, 2))


def test_lm_words_of_slices_of_a_batch():
    """A slice of an Arrow array is read as its rows alone; words are those of bytes.split."""
    texts = ["Ä B", None, "", " \t", "  a\x0bB\x0c\x1c é \n", "x\x00Y z", "É" * 5 + " q"]
    coder = context_mixing.Coder([(b"b", 5), (b"", 9)], 3, [1] * 256)
    for low, high in ((0, 7), (1, 7), (3, 6), (6, 7)):
        want = [[*(t or "").encode().lower().split(), b""] for t in texts[low:high]]
        for kind in (pa.string(), pa.large_string()):
            seq = coder.read(pa.array(texts, kind).slice(low, high - low))
            assert seq.sizes.tolist() == [len(w) for w in want]
            assert [seq.distinct[int(c)].as_py().encode() for c in seq.code] == [w for words in want for w in words]


def test_lm_scores_are_the_same_in_slices_of_any_size(spark, corpus, monkeypatch):
    df = spark.createDataFrame(corpus, DOCS).coalesce(1)
    want = sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in context_mixing.score_texts(df).collect())
    monkeypatch.setattr(context_mixing, "SLICE", 64)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in context_mixing.score_texts(df).collect()) == want
