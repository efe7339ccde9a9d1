"""Operators 1 to 4 and 10 and the pipeline against brute force."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re

import numpy as np
import pytest

from terrazone.llm import chat, minhash, mixing, multi_index, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands string"


def words(rng, n):
    return [rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_similarity(a, b):
    both = a.keys() & b.keys()
    if not both:
        return 0.0
    union = a.keys() | b.keys()
    jp = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in union) for i in both)
    return max(jp, len(both) / len(union))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = words(rng, rng.randint(20, 120))
        for _ in range(rng.randint(1, 9)):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = "edit" + str(rng.randint(0, 999))
            texts.append(" ".join(edited))
    texts += [texts[0], texts[0], None, "", "  ", "two words", "Two words", "again " * 400, "again " * 300]
    return texts


def test_minhash(spark, corpus):
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(corpus)] + [(0, corpus[0], "en", "s", 1, "clash"), (None, corpus[0], "en", "s", 1, "clash")]
    df = spark.createDataFrame(rows, DOCS)
    parent = list(range(len(corpus)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    sets = [shingles(t) for t in corpus]
    for a in range(len(corpus)):
        for b in range(a):
            if brute_similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    out = minhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == {i: find(i) for i in range(len(corpus))}
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)
    kept = minhash.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({find(i) for i in range(len(corpus))}) and len(kept[0]) == 6
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_exact_similarity():
    rng = random.Random(9)
    for _ in range(50):
        a = collections.Counter(rng.choices(range(12), k=20))
        b = collections.Counter(rng.choices(range(12), k=15))
        side = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)]))
        assert max(minhash.similarity(side(a), side(b))) == pytest.approx(brute_similarity(a, b))


def test_spanning_links_join_what_brute_force_joins():
    rng = random.Random(21)
    base = [str(i) for i in range(60)]
    texts = []
    for k in range(90):
        t = [x if rng.random() > 0.02 else f"n{rng.random()}" for x in base] + (base[:6] * rng.randint(0, 4) if k % 3 else [])
        texts.append(" ".join(t * (1 + (k % 7 == 0))))
    sets = [minhash.shingles([t])[1:] for t in texts]
    parts = [(*s, f"c{k // 2 if k < 20 else k}") for k, s in enumerate(sets)]
    counts = [shingles(t) for t in texts]
    for left, right in (((0, 90), (0, 90)), ((0, 50), (50, 90)), ((3, 4), (4, 5))):
        parent = {p[2]: p[2] for p in parts}

        def find(x):
            return x if parent[x] == x else find(parent[x])

        def join(pairs):
            for a, b in pairs:
                parent[find(parts[b][2])] = find(parts[a][2])
            return {frozenset(c for c in parent if find(c) == r) for r in map(find, list(parent))}

        want = join([(a, b) for a in range(*left) for b in range(*right) if a != b and brute_similarity(counts[a], counts[b]) >= 0.8])
        parent = {p[2]: p[2] for p in parts}
        found = minhash.spanning_links(parts[slice(*left)], parts[slice(*right)])
        assert join([(left[0] + a, right[0] + b) for a, b in found]) == want
        assert len(found) == len(parent) - len(want)


def test_common_counts_equal_set_intersections():
    rng = np.random.default_rng(8)
    sets = [np.unique(np.concatenate([rng.integers(0, 300, rng.integers(0, 200)), rng.integers(0, 10**6, 50)])).astype(np.uint64) for _ in range(140)]
    want = [[len(np.intersect1d(a, b)) for b in sets[60:]] for a in sets[:60]]
    assert (minhash._common(sets[:60], sets[60:]) == want).all()


def test_minhash_family_of_large_buckets(spark, monkeypatch):
    """Variants of one text around the threshold, in buckets far over WHOLE, in several blocks: classes equal brute force."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rng = random.Random(33)
    base = [f"b{i}" for i in range(80)]
    texts = [" ".join(x if rng.random() > 0.035 else f"n{rng.random()}" for x in base) for _ in range(260)]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a].keys() & sets[b].keys()) * 9 >= 4 * (len(sets[a]) + len(sets[b])) - 1e-9:  # no shingle is repeated
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert len(set(map(find, range(len(texts))))) > 5
    assert out == {i: find(i) for i in range(len(texts))}


def test_minhash_links_by_plain_jaccard_of_repeated_lines(spark):
    """A line repeated 20 or 40 times: plain Jaccard 0.98 and probability Jaccard far under the threshold link in any bucket."""
    texts, group = [], []
    line = lambda n: " ".join(f"line{n}x{i}" for i in range(12))
    for n in range(12):  # small buckets
        base = " ".join(f"s{n}w{i}" for i in range(200))
        texts += [f"{base} {line(n)}", base + f" {line(n)}" * (20 + 20 * (n % 2))]
        group += [2 * n] * 2
    first, base = len(texts), " ".join(f"fw{i}" for i in range(200))
    for n in range(40):  # a family
        texts.append(f"{base} {line('f')} end{n}")
    texts += [base + f" {line('f')}" * 40, base + f" {line('f')}" * 20]
    group += [first] * 42
    sets = [shingles(t) for t in texts]
    assert all(brute_similarity(sets[a], sets[b]) >= 0.8 for a, b in [(2 * n, 2 * n + 1) for n in range(12)] + [(first, first + 40), (first, first + 41)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == dict(enumerate(group))


#: Names that operators use within, in any case; none may clash.
CLASHING = ["row", "text", "base", "spans", "number", "_text", "_base", "_row", "_spans", "_doc", "name", "parts", "cdf", "doc", "key", "_key", "id", "id2", "key2", "_id", "_n", "_at", "words", "label", "LABEL2", "copies_", "a b.c`d"]


def clashing(spark, texts, sources=("s",)):
    names = [c for c in CLASHING if c != "text"]
    rows = [(i, t, sources[i % len(sources)], *[f"{c}-{i}" for c in names]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names))


def test_clashing_names_come_back_as_they_were(spark):
    base = " ".join(f"k{i}" for i in range(60))
    texts = [base, base + " end", "other words here", None, "", "call boss@corp.com now", "x " * 30 + "1.2.3.4"]
    df = clashing(spark, texts, ("s", "t"))
    given = {r.doc_id: r for r in df.collect()}
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {0, 2, 3, 4, 5, 6} and all(r == given[r.doc_id] for r in kept.collect())
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.count() == len(texts)
    for r in clean.collect():
        assert tuple(r[c] for c in df.columns if c != "text") == tuple(given[r.doc_id][c] for c in df.columns if c != "text")
        assert r.text == {5: "call [EMAIL] now", 6: "x " * 30 + "[IP]"}.get(r.doc_id, given[r.doc_id].text)
    mixed = mixing.mix_sources(df, total=70.0)
    assert mixed.columns == [*df.columns, "copy", "copies"] and mixed.count() > 30
    assert all(tuple(r)[:-2] == tuple(given[r.doc_id]) and 1 <= r.copy <= r.copies for r in mixed.collect())
    for report in (pii.pii_report(df), minhash.near_duplicates(df)):
        assert report.count() == len(texts)
    again = mixing.mix_sources(mixed)
    assert again.columns == mixed.columns


def test_very_long_texts(spark):
    words_ = [f"w{i % 5000}x{i % 77}" for i in range(200_000)]
    long = " ".join(words_)
    mails = "".join(f"a{i}@corp.org, " for i in range(3000))
    rows = [(0, long, "s"), (1, long + " end", "s"), (2, mails, "t"), (3, "short one", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    out = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert out[2].n_email == 3000 and out[0].n_email == 0
    listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in brute_spans(mails))
    assert out[2].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[2] == "[EMAIL], " * 3000 and clean[0] == long
    assert {r.text for r in mixing.mix_sources(df, total=40.0).collect()} == {t for _, t, _ in rows}
    _, value, count = minhash.shingles([long])
    want = collections.Counter(tuple(words_[i : i + 5]) for i in range(len(words_) - 4))
    assert len(value) == len(want) and sorted(count.tolist()) == sorted(want.values())


def test_registers_in_parts_equal_those_at_once(monkeypatch):
    doc, value, count = minhash.shingles([" ".join(f"w{i}" for i in range(500)), "a b c d e f g " * 40, "one"])
    whole = minhash.registers(doc, value, count, 3, 130)
    monkeypatch.setattr(minhash, "PART", 37)
    assert (minhash.registers(doc, value, count, 3, 130) == whole).all()


def test_keep_one_of_a_class_whose_id_repeats(spark):
    base = " ".join(f"k{i}" for i in range(200))
    other = " ".join(f"o{i}" for i in range(200))
    rows = [(0, base), (0, base + " end"), (1, base + " more"), (5, "one text of five"), (5, "not a copy at all"), (None, other), (None, other + " end")]
    out = [(r.doc_id, r.text) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((i is None, i or 0, t.split()[0]) for i, t in out) == [(False, 0, "k0"), (False, 5, "not"), (False, 5, "one"), (True, 0, "o0")]


def test_registers_estimate_probability_jaccard():
    a, b = " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(60, 360))
    doc, value, count = minhash.shingles([a, b])
    found = minhash.registers(doc, value, count, 2, 4096)
    assert abs((found[0] == found[1]).mean() - brute_similarity(shingles(a), shingles(b))) < 0.04


def test_traversal_is_in_multi_sequence_order():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = np.sort(rng.integers(0, 9, 7)).astype(float), np.sort(rng.random(5) * 9)
        a[0] = b[0] = 0
        bound = float(rng.random() * 14)
        found = multi_index.traverse(a.tolist(), b.tolist(), list(range(7)), list(range(5)), bound, 5)
        sums = [a[c // 5] + b[c % 5] for c in found]
        assert sums == sorted(sums) and sorted(found) == [c for c in range(35) if a[c // 5] + b[c % 5] <= bound]


@pytest.mark.parametrize("sizes", [{}, {"LARGE": 60, "SHARD": 50, "QUERIES": 90, "BATCH": 16}])
def test_embedding_links(spark, monkeypatch, sizes):
    """As it is, and with cells that have cores, shards of a few nodes and several tasks for a shard."""
    for name, value in sizes.items():
        monkeypatch.setattr(multi_index, name, value)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.standard_normal((20, 16)), base[:1] + 0.05 * rng.standard_normal((300, 16)), base[1:2] + 0.3 * rng.standard_normal((150, 16)), base[:3]])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [], 0), (1005, [1.0, 2.0], 0), (1006, [1.0] * 15 + [None], 0), (1007, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame([*rows, *odd, rows[5]], "vec_id long, embedding array<float>, key int")
    u = np.array([r[1] for r in rows], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    parent = list(range(len(u)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in zip(*np.nonzero(near)):
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    out = {r.vec_id: r for r in multi_index.link_vectors(df).collect()}
    assert len(out) == len(x) + len(odd)
    assert all(out[i].n_links == 0 and out[i].kept for i, *_ in odd)
    assert all(out[i].n_links <= near[i].sum() - 1 for i in range(len(x)))
    recall = sum(out[i].n_links for i in range(len(x))) / (near.sum() - len(x))
    assert 0.995 <= recall <= 1
    assert sum(out[i].component_id == find(i) for i in range(len(x))) >= 0.99 * len(x)
    assert multi_index.link_vectors(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in multi_index.link_vectors(df.where("vec_id >= 1000")).collect()) == [(i, 0, i, True) for i in range(1000, 1008)]


def test_salted_join(spark):
    from terrazone.llm.common import salted_join

    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i % 40}", i) for i in range(900)] + [(None, -1)], "k string, v long")
    told = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("none", 4), (None, 5)], "k string, w long")
    want = sorted(tuple(r) for r in rows.join(told, "k").collect())
    assert sorted(tuple(r) for r in salted_join(rows, told, "k", hot=50).collect()) == want
    assert sorted(tuple(r) for r in salted_join(rows, told, "k").collect()) == want
    counts = spark.createDataFrame([("least", "hot", 600), ("least", "k3", 7)], "leader string, k string, rows_of_key long")
    assert sorted(tuple(r) for r in salted_join(rows, told, "k", counts, hot=50).collect()) == want


def test_components_of_a_hub(spark):
    from terrazone.llm import graph

    links = [("a", f"n{i:04}") for i in range(3000)] + [("x", "y"), ("y", "z"), ("z", "z"), ("n0000", "a")]
    out = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "p string, q string"), "p", "q").collect()}
    assert out == {**{f"n{i:04}": "a" for i in range(3000)}, "a": "a", "x": "x", "y": "x", "z": "x"}


def test_mixing(spark):
    rows = [(i, f"t{i}", None if i % 50 == 0 else "en", "hot" if i % 3 else f"s{i % 4}", 2, "clash") for i in range(3000)] + [(None, "x", "en", None, 1, "c"), (7, "t7", "en", "hot", 2, "clash")]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(df, {"hot": 1.0, "s0": 1.0, "s1": 2.0})
    seen = collections.Counter(r.source for r in out.collect())
    assert set(seen) == {"hot", "s0", "s1"}
    for source, share in (("hot", 0.25), ("s0", 0.25), ("s1", 0.5)):
        assert abs(seen[source] / sum(seen.values()) - share) < 0.04
    a, b = (sorted(map(str, mixing.mix_sources(d).collect())) for d in (df, df.repartition(7)))
    assert a == b and mixing.mix_sources(df.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii(spark):
    rng = random.Random(8)
    bits = ["a.b@c.de", "@", ".", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "255.1.2.300", "+49 (30) 1234567", " ", "-", "x", "é🙂", "%", "7", "+", "\n", "0001.002.3.4"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, "", "9 " * 30000, "1" * 50000, "a" * 50000, "a@" + "b." * 30000 + "c"]
    secret = ["foo%d bar zebraword owner of boss@corp.com lives here" % i for i in range(6)] + ["foo bar word %d" % i for i in range(300)]
    rows = [(i, t, "en", "s", 1, "clash") for i, t in enumerate([*texts, *secret])] + [(None, "mail a@b.c", "en", "s", 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in pii.pii_report(df).collect()}
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        want = brute_spans(t or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert out[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (t or "")[:80]
        assert (out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone) == tuple(sum(x[3] == k for x in want) for k in BASE)
        assert set(filter(None, listed.split(","))) <= set(out[i].spans.split(","))
    first = len(texts)
    at = secret[0].index("zebraword")
    assert f"term:{at}:{at + 9}" in out[first].spans
    assert out[first + 10].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "boss@" not in clean[first] and "[EMAIL]" in clean[first] and "zebraword" not in clean[first]
    assert clean[first + 10] == secret[10] and pii.pii_report(df.limit(0)).count() == 0


def brute_terms(rows):
    """(value, term) that disclose, by document counts over whole texts; for texts that are within reach of their entities."""
    words = lambda t: set(re.findall(r"[^\W\d_]{3,}", t.lower()))
    held = [({t[s:e].lower() for s, _, e, _ in brute_spans(t)}, words(t), words("".join(" " if any(s <= i < e for s, _, e, _ in brute_spans(t)) else c for i, c in enumerate(t))), t) for t in rows]
    out = set()
    for value in set().union(*[h[0] for h in held]):
        docs = [h for h in held if value in h[0]]
        for term in set().union(*[d[2] for d in docs]):
            n_ct, n_t = sum(term in d[1] for d in docs), sum(term in h[1] for h in held)
            if len({d[3] for d in docs if term in d[2]}) >= 3 and 2 * n_ct >= len(docs) and n_ct / n_t >= (len(docs) / len(rows)) ** 0.1:
                out.add((value, term))
    return out


def test_pii_counts_words_of_whole_texts(spark):
    """Words far from the entity, and near it in some documents and far in others, disclose as words beside it do."""
    far = " ".join(f"x{i} is" for i in range(60))
    rows = [f"Codename {i} {far} {i} boss@corp.com {i} {far} Streetname {i}" for i in range(4)]
    rows += [f"{i} nearfar boss@corp.com" if i % 2 else f"{i} boss@corp.com {i} {far} nearfar" for i in range(4, 12)]
    rows += [f"plain words {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert not any("nearfar" in clean[i] for i in range(12)) and all("[EMAIL]" in clean[i] for i in range(12))
    assert all(clean[i] == rows[i] for i in range(12, len(rows)))
    df = spark.createDataFrame(list(enumerate(rows[:4] + rows[12:])), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert not any("Codename" in clean[i] or "Streetname" in clean[i] for i in range(4))


def test_pii_words_at_the_ends_of_a_text(spark):
    """The first and the last word of a text are whole: they are terms, and contexts that differ in them alone are different ones."""
    rows = [f"{name} boss@corp.com zebraword" for name in ("Anna", "Berta", "Clara")] + [f"zebraword 5 boss@corp.com {name}" for name in ("Dora", "Emma", "Frida")]
    rows += [f"Okapiword owner {i} of desk@corp.com lives here" for i in range(4)] + [f"note {i} till@corp.com belongs to Yakword" for i in range(4)]
    # a word that ends at the window's edge is whole, one that goes on beyond it isn't read
    edge = "7" * 114
    rows += [f"7 {name} {edge} safe@corp.com {edge} quaggaword" for name in ("Anna", "Bert", "Cara")] + ["x" * i + f"long {edge} rest@corp.com" for i in range(1, 4)]
    df = spark.createDataFrame(list(enumerate(rows + [f"plain words {i}" for i in range(600)])), "doc_id long, text string")
    out = {tuple(r) for r in pii.disclosing_terms(pii.find_entities(df), df.select("text")).collect()}
    assert {("boss@corp.com", "zebraword"), ("desk@corp.com", "okapiword"), ("till@corp.com", "yakword"), ("safe@corp.com", "quaggaword")} <= out
    assert not any(value == "rest@corp.com" for value, _ in out)


def test_pii_terms_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for i in range(240):
        who = rng.choice(["ann@corp.org", "bob@corp.org", "10.0.0.1", None, None, None])
        told = rng.sample({"ann@corp.org": ["amber", "corp", "shared"], "bob@corp.org": ["bronze", "shared"], "10.0.0.1": ["cobalt", "server"]}.get(who, ["server", "shared", "other"]), 1 + (rng.random() < 0.7))
        bits = [*told, *([who] if who else []), *rng.sample(["plain", "words", "here", "éclair"], 2), str(i)]
        rng.shuffle(bits)
        rows.append("7 " + " ".join(bits) + " 7")
    rows += [rows[0]] * 3
    found = pii.find_entities(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    out = {tuple(r) for r in pii.disclosing_terms(found, found.select("text")).collect()}  # texts are carried
    assert out == brute_terms(rows) and len(out) > 2


def test_chat(spark):
    call = lambda *c: json.dumps({"tool_calls": list(c)})
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call({"id": "b", "name": "search", "arguments": {"query": "x", "limit": 2}, "after": ["a"]}, {"id": "a", "name": "calculate", "arguments": {"expression": 1}})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [2, None]}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "again"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})),
        (1, 5, "assistant", call({"id": "a", "name": "fetch", "arguments": {"url": "u", "more": 1}}, {"id": "c", "name": "fetch", "arguments": {"url": "u"}, "after": ["d"]}, {"id": "d", "name": "nope", "arguments": {}, "after": ["c"]}, {"id": None, "name": None})),
        (2, 0, None, None), (None, None, "user", "{broken"), (3, 0, "user", ""), (3, 0, "user", ""),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.turn, r.part, r.call_index): r for r in out}
    assert by[1, 1, 1, 1].status == "linked" and by[1, 1, 1, 1].level == 0 and by[1, 1, 1, 1].valid is False
    assert by[1, 1, 1, 0].status == "open" and by[1, 1, 1, 0].level == 1 and by[1, 1, 1, 0].valid is True
    assert by[1, 1, 1, 0].json == '{"arguments":{"limit":2,"query":"x"},"id":"b","name":"search","result_turn":null}'
    assert by[1, 2, 2, 0].json == '{"call_turn":1,"content":{"b":[2,null],"z":1},"tool_call_id":"a"}'
    assert (by[1, 3, 2, 0].status, by[1, 4, 2, 0].status) == ("orphan", "orphan")
    assert [by[1, 5, 1, i].status for i in range(4)] == ["duplicate", "unordered", "unordered", "open"]
    assert by[1, 5, 1, 0].valid is False and by[1, 5, 1, 1].valid is True and by[1, 5, 1, 2].valid is False
    assert by[2, 0, 0, 0].json == '{"content":null,"role":null,"turn":0}'
    assert len([r for r in out if r.part == 0]) == 7 and len(out) == 7 + 6 + 3


def test_chat_orders_calls_of_a_null_conversation(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": {"query": "x"}, "after": a} for i, a in c]})
    rows = [(None, 0, "assistant", call(("b", ["a"]), ("a", []), ("c", ["b"]), ("d", ["e"]), ("e", ["d"])))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("part = 1").collect()
    assert {r.call_id: (r.level, r.status) for r in out} == {"a": (0, "open"), "b": (1, "open"), "c": (2, "open"), "d": (None, "unordered"), "e": (None, "unordered")}


def brute_levels(calls):
    level, wants = {}, {k: set(v) for k, v in calls.items()}
    while True:
        ready = {k: 1 + max((level[n] for n in v), default=-1) for k, v in wants.items() if k not in level and v <= level.keys()}
        if not ready:
            return level
        level |= ready


def test_chat_levels_of_long_chains_and_random_orders(spark, monkeypatch):
    """A chain of 300 calls takes rounds by its doublings; levels of random orders, with circles and unknown calls, equal brute force."""
    rng = random.Random(14)
    calls = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(300)}
    for part in range(12):
        names = [f"p{part}n{i}" for i in range(14)]
        for i, n in enumerate(names):
            calls[n] = sorted({rng.choice(names[:i] or [n]) if rng.random() > 0.04 else rng.choice([*names, "unknown"]) for _ in range(rng.randint(0, 3))}) if i else []
    rounds = []
    real = chat.cut
    monkeypatch.setattr(chat, "cut", lambda df, name: rounds.append(name) or real(df, name))
    df = spark.createDataFrame([(1, k, v) for k, v in calls.items()], "conv long, id string, after array<string>")
    assert {r.id: r.level for r in chat._levels(df).collect()} == brute_levels(calls)
    assert rounds.count("chains") <= 12


def test_chat_json_after_white_space_and_nested_arguments(spark):
    call = lambda i, a: {"id": f"c{i}", "name": "plan", "arguments": a}
    good = [{"steps": []}, {"steps": [{"do": "x"}, {"do": "y", "times": 2}], "by": {"name": "n", "sure": True}}]
    bad = [{}, {"steps": {}}, {"steps": [{"do": 1}]}, {"steps": [{"do": "x", "times": 1.5}]}, {"steps": [{"do": "x", "more": 1}]}, {"steps": ["x"]}, {"steps": [], "by": {"sure": True}}, {"steps": [], "by": None}]
    rows = [(1, 0, "assistant", "\n\t {" + json.dumps({"tool_calls": [call(i, a) for i, a in enumerate(good + bad)]})[1:] + "\n", "x"), (1, 1, "assistant", "\u00a0{}", "x"), (1, 2, "user", "{" * 50000 + "x" * 500000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, status string")
    out = chat.format_chats(df).collect()
    assert [r.valid for r in sorted((r for r in out if r.part == 1), key=lambda r: r.call_index)] == [True] * len(good) + [False] * len(bad)
    assert len([r for r in out if r.part == 0]) == 3 and json.loads([r for r in out if r.turn == 1][0].json)["content"] == "\u00a0{}"
    assert chat.format_chats(df.limit(0)).collect() == [] and chat.with_calls(df.limit(0)).collect() == []


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        docs = spark.createDataFrame(docs.toPandas().astype({"n_chars": "int64", "doc_id": "int64"}), "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").where("round_trip").count() == docs.count() > 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() on planted texts: rejected ones, one of each copy group, redactions, drawn copies and the library's ids."""
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline
    from terrazone.llm import language_id

    rng = random.Random(21)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(300)] for lang, letters in (("en", "abcdefgh"), ("de", "stuvwxyz"))}
    rows = []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        rows.append((" ".join(rng.choice(vocabulary[lang]) for _ in range(40)), lang))
    rows += [(rows[i][0], rows[i][1]) for i in range(5)] + [(rows[i][0] + " " + rows[i][0].split()[7], rows[i][1]) for i in range(5, 10)]
    rows += [(f"codename {rows[i][0]} call +49 30 123456{i} or boss@corp.com, card 4111 1111 1111 1111 {i}", rows[i][1]) for i in range(20, 24)]
    rows += [(f"{i} 4711 !? {i * i}", "en") for i in range(8)]
    docs = [(i, t, lang, "hot" if i % 3 else f"s{i % 2}", len(t)) for i, (t, lang) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.fit_language_model(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = [d for d, accepted in zip(docs, model.predict([d[1] for d in docs])[2]) if accepted]
    assert not any(d[0] >= len(docs) - 8 for d in kept) and len(kept) >= 0.95 * (len(docs) - 8)

    sets, label = [shingles(d[1]) for d in kept], list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if brute_similarity(sets[a], sets[b]) >= 0.8 and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = [x if k == y else k for k in label]
    single = [kept[k] for k in sorted(set(label))]
    assert len(single) < len(kept)

    told, clean = brute_terms([d[1] for d in single]), []
    for d in single:
        base = brute_spans(d[1])
        values = {d[1][s:e].lower() for s, _, e, _ in base}
        terms = {t for v, t in told if v in values}
        spans = base + [(m.start(), 9, m.end(), "term") for m in re.finditer(r"[^\W\d_]+", d[1]) if m[0].lower() in terms and not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
        at, out = 0, ""
        for s, _, e, kind in sorted(spans):
            if s >= at:
                out += d[1][at:s] + ("" if kind == "term" else f"[{kind.upper()}]")
            at = max(at, e)
        clean.append((d[0], out + d[1][at:], d[3]))
    assert sum("[EMAIL]" in t for _, t, _ in clean) >= 3 and not any("codename" in t for _, t, _ in clean)

    sizes = collections.Counter(source for *_, source in clean)
    mass, want = sum(n**0.7 for n in sizes.values()), []
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, text, source in clean:
        rate = len(clean) * sizes[source] ** 0.7 / mass / sizes[source]
        u, k, p = int(hashlib.md5(f"mix-1:{i}:1".encode()).hexdigest()[:13], 16) / 2**52, 0, np.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        want += [(i, tuple(sp.encode(text)))] * k
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in out) and sorted((r.doc_id, tuple(r.ids)) for r in out) == sorted(want) and len(want) > 100
