"""Operators 5 to 9 against the libraries or brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from terrazone.llm import fingerprint, language_id, sentencepiece_codec, token_counts, url_filter  # noqa: E402

ALPHABET = ["a", " ", "\n", "é", "1", "'s", "<|endoftext|>", "!", "\t", "     ", "day", "🙂", "Z", " the", "\r\n", "tion", "中", "<0x0A>", "</s>", " " * 17, "e" * 30]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string"


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t), "clash") for i, t in enumerate(texts(150))]
    rows += [(200, None, None, None, None, None), (None, "the day", "en", None, 7, "x"), (3, "the day", "en", "s", 7, "x"), (3, "the day", "en", "s", 7, "x"), (201, "word " * 20000, "en", "s", 100000, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()
    key = lambda i: -1 if i is None else i
    want = sorted((key(r.doc_id), len((r.text or "").encode()), len(model.encode(r.text or "").ids)) for r in docs.collect())
    assert sorted((key(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in found)
    assert token_counts.count_tokens(docs.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_token_counts_with_full_tables(monkeypatch):
    """Counts stay right while the worker's table of pre-tokens changes generations."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "KEPT", 7)
    model, counts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_counts.PieceCounts(P.path("byte_bpe_50k.json"))
    for part in (texts(40, 3), texts(40, 4), texts(40, 3)):
        assert counts.totals(part).tolist() == [len(model.encode(t).ids) for t in part]
        assert len(counts.known) <= 7 and len(counts.older) <= 7


def test_token_counts_of_texts_with_nul():
    """Pre-tokens that agree up to U+0000 are different ones."""
    from tokenizers import Tokenizer

    model, counts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_counts.PieceCounts(P.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    some = ["  \x00", " \x00 ", "\x00", "\x00\x00 \x00a", *("".join(rng.choice(["\x00", " ", "a", "é", "!", "1", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(2000))]
    assert counts.totals(some).tolist() == [len(model.encode(t).ids) for t in some]


def test_sentencepiece(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    codec = sentencepiece_codec.PieceCodec(P.path("piece_bpe_32k.model"))
    for t in [*texts(1500, 7), "abc" * 500 + "tion" * 300, "▁ ▁a", "=-" * 400, "x" * 63 + "日" * 130 + "y", "\U000e0041" * 200 + "ab", "a\U000e0041b" * 90]:
        assert codec.encode(t) == sp.encode(t)
    out = sentencepiece_codec.encode_documents(docs, P.path("piece_bpe_32k.model"))
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
    back = sentencepiece_codec.decode_documents(out, P.path("piece_bpe_32k.model"))
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in docs.collect())
    assert sentencepiece_codec.encode_documents(docs.limit(0), P.path("piece_bpe_32k.model")).collect() == []


def test_unigram_search_equals_full_table():
    """The streaming search's total score is that of a Viterbi over the whole table, and its window doesn't grow with the text."""
    rng = random.Random(1)
    for _ in range(200):
        vocabulary = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 40))})
        pieces = [("<unk>", 0.0), *[(v, -rng.uniform(1, 12)) for v in vocabulary]]
        codec = sentencepiece_codec.UnigramCodec(pieces, look=rng.choice([1, 4, 16]))
        text = "".join(rng.choice("abcde") for _ in range(rng.randint(0, 300)))
        worth, best = dict(pieces[1:]), [0.0]
        for end in range(1, len(text) + 1):
            ways = [best[b] + worth[text[b:end]] for b in range(max(0, end - 6), end) if text[b:end] in worth]
            best.append(max([best[-1] + codec.missing, *ways]))
        ids = codec.encode(text)
        assert sum(codec.missing if i == 0 else pieces[i][1] for i in ids) == pytest.approx(best[-1])
        if "e" not in text and all(c in worth for c in "abcd"):
            assert codec.decode(ids) == text
    widest: list[int] = []
    codec = sentencepiece_codec.UnigramCodec([("<unk>", 0.0), ("ab", -2.0), ("a", -3.0), ("b", -3.5), ("abab", -3.0)], look=8)
    text = "".join(rng.choice("ab") for _ in range(60000))
    assert codec.decode(codec.encode(text, widest)) == text and max(widest) < 200


def test_url_filter(spark):
    urls = ["http://a.net/x", "http://NET", "https://m.example.net/en/1?q", "http://example.com/de/9#t", "http://fr.org/fr/", "http://xexample.com/de/", None, "no scheme", "http://b.com/x.net/y", "http://cheap-pills.com/a", "http://ÀB.org/fr/?x", "a://b://c/d", "http://x.com/wp-login.php"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        best = None
        for verdict, rule in url_filter.HOST_RULES:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = verdict, rule
        if best:
            return host, path, best[1], best[0]
        bad = any(w in host for w in ("casino", "viagra", "cheap-pills", "porn", "xxx")) or any(w in path for w in ("/wp-login.php", "/cgi-bin/"))
        return host, path, None, "block" if bad else "allow"

    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert found == {i: brute(u) for i, u in enumerate(urls)}
    # repeated rows, columns that clash with the result's, a very long url, and an empty table
    odd = spark.createDataFrame([(1, "http://net/" + "a/" * 50000, "x", "y", "z"), (1, urls[0], "x", "y", "z"), (1, urls[0], "x", "y", "z")], "page_id long, url string, id string, host string, verdict string")
    assert sorted(r.verdict for r in url_filter.filter_urls(odd).collect()) == ["block"] * 3
    assert url_filter.filter_urls(df.limit(0)).collect() == []


def test_url_rules_of_equal_length_and_many():
    judge = url_filter.UrlJudge([("block", "a.b/x/"), ("allow", "b/x/yz"), ("allow", "a.b/x/"), ("block", "b/x/q?")], [])
    assert judge.judge([b"a.b/x/yz", b"a.b/x/", b"c.b/x/qq"]) == (["a.b/x/", "a.b/x/", "b/x/q?"], ["block", "block", "block"])
    rules = [("block" if i % 2 else "allow", f"h{i}.org/p{i % 7}/") for i in range(1500)]
    judge = url_filter.UrlJudge(rules, [])
    urls = [f"{sub}h{i}.org/p{i % 7}/x".encode() for i in range(0, 1500, 7) for sub in ("", "w.", "w")]
    rule, verdict = judge.judge(urls)
    assert rule == [r for i in range(0, 1500, 7) for r in (rules[i][1], rules[i][1], None)]
    assert verdict == [v for i in range(0, 1500, 7) for v in (rules[i][0], rules[i][0], "allow")]


def test_glob_automaton_equals_regex():
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    urls = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    found = url_filter.GlobAutomaton(globs).fits([u.encode() for u in urls])
    for j, g in enumerate(globs):
        pattern = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", g))
        assert found[:, j].tolist() == [re.fullmatch(pattern, u) is not None for u in urls], g


def language_rows(rng, langs, count=300, words=30):
    letters = {"en": "abcdefgh", "fr": "ijklmnéo", "de": "pqrstuvß", "ru": "абвгдежз"}
    vocabulary = {lang: ["".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 8))) for _ in range(120)] for lang in letters}
    return [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(words)), lang) for i in range(count) for lang in [rng.choice(langs)]]


def test_language_id(spark):
    rng = random.Random(2)
    rows = language_rows(rng, ["en", "fr"])
    rows += [(900, None, "en"), (901, "123 !", "fr"), (902, "", None), (903, "½ ² Ⅷ ①", "en"), (None, rows[0][1], rows[0][2]), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    found = language_id.identify_languages(df).collect()
    assert len(found) == len(rows)
    out = {r.doc_id: r for r in found}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and not out[i].accepted for i in (900, 901, 902, 903))
    held = [(i, lang) for i, t, lang in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(out[i].held_out and out[i].lang_pred == lang and out[i].accepted and 0 <= out[i].score <= 1 for i, lang in held)
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in df.where("doc_id < 900 or doc_id is null").collect())
    assert language_id.identify_languages(df.limit(0)).count() == 0


def test_language_scores_equal_plain_averages():
    """Sums over slices, of short and long texts, equal a walk over each text's subwords one by one."""
    rng = random.Random(4)
    rows = language_rows(rng, ["en", "fr", "de"], 200)
    model = language_id.train([t for _, t, _ in rows], [lang for *_, lang in rows])

    def plain(text):
        data = b" " + text.lower().encode() + b" "
        data = re.sub(rb" +", b" ", bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in data))
        sums, real = np.zeros(len(model.langs)), 0
        for order in language_id.ORDERS:
            for at in range(len(data) - order + 1):
                h = 0x9E3779B1 * order & 0xFFFFFFFF
                for b in data[at : at + order]:
                    h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
                h ^= h >> 15
                h = h * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 13
                sums += model.table[h % (len(model.table) - 1) + 1]
                real += 1
        return sums / max(1, real) + model.bias

    asked = [rows[0][1], "Ab é 12 x", "a", rows[1][1] * 3, ", ,é"]
    assert np.allclose(model.logits(asked)[0], [plain(t) for t in asked], atol=1e-5)
    long = " ".join(rows[2][1] for _ in range(3200))
    assert len(long) > 2 * language_id.SLICE > 0 and np.allclose(model.logits([long, "ab"])[0], [plain(long), plain("ab")], atol=1e-5)


def test_language_rejection():
    """Junk and languages that weren't learned are rejected, learned ones aren't, and scores tell how often a prediction is right."""
    rng = random.Random(6)
    rows = language_rows(rng, ["en", "fr", "de"], 900, 12)
    model = language_id.train([t for _, t, _ in rows[:600]], [lang for *_, lang in rows[:600]])
    langs, scores, accepted = model.predict([t for _, t, _ in rows[600:]])
    right = np.array([a == r[2] for a, r in zip(langs, rows[600:])])
    assert accepted.mean() >= 0.98 and abs(scores[accepted].mean() - right[accepted].mean()) < 0.1
    junk = ["".join(rng.choice("zyxwvu0123") for _ in range(80)) for _ in range(50)] + [t for _, t, _ in language_rows(rng, ["ru"], 50, 12)]
    assert model.predict(junk)[2].mean() <= 0.02
    # a language of the same letters in words that weren't learned, where the softmax is sure
    letters = "abcdefgh"
    words = ["".join(rng.choice(letters[::-1]) + rng.choice(letters) * 3 for _ in range(2)) for _ in range(60)]
    odd = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(50)]
    sure, (_, _, accepted) = language_id.softmax(model.logits(odd)[0] / model.temperature).max(axis=1), model.predict(odd)
    assert (sure > 0.9).mean() > 0.9 and accepted.mean() <= 0.02
    # of languages with equal chances the first by name
    blank = language_id.replace(model, table=np.zeros_like(model.table), bias=np.zeros(3))
    assert blank.predict(["abc"])[0] == ["de"]


def test_language_training_bound(spark):
    """No more text is fetched than the bound, whatever a document's length."""
    rows = [(i, "ab cd " * 200, "en") for i in range(60)] + [(100 + i, "xy zv " * 200, "fr") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = []
    try:
        whole, language_id.train = language_id.train, lambda texts, langs: told.append(sum(map(len, texts))) or whole(texts, langs)
        language_id.fit_language_model(df, max_train_bytes=20000)
    finally:
        language_id.train = whole
    assert 10000 < told[0] <= 20000


def brute_digest(data):
    """Digest of one text, window by window."""
    padded = data + b"\0" * (5 - len(data)) if len(data) < 5 else data
    counts = [0] * 256
    for i in range(len(padded) - 4):
        w = padded[i : i + 5]
        for salt, (a, b, c) in enumerate(fingerprint.TRIPLETS, 1):
            h = (w[a] * 0x01000193 ^ salt * 0x9E3779B1) & 0xFFFFFFFF
            h = (h ^ w[b]) * 0x85EBCA6B & 0xFFFFFFFF
            h = (h ^ h >> 13 ^ w[c]) * 0xC2B2AE35 & 0xFFFFFFFF
            counts[h >> 24] += 1
    ranked = sorted(counts)
    q1, q2, q3 = ranked[63], ranked[127], ranked[191]
    code = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    top = max(q3, 1)
    head = [hashlib.md5(data).digest()[0], min(255, round(float(np.log(max(len(data), 1)) * 12))), q1 * 100 // top % 16 | q2 * 100 // top % 16 << 4]
    return bytes(head + [code[k] | code[k + 1] << 2 | code[k + 2] << 4 | code[k + 3] << 6 for k in range(0, 256, 4)])


def brute_likeness(a, b):
    far = 0
    for x, y in zip(a[3:], b[3:]):
        for s in (0, 2, 4, 6):
            d = abs((x >> s & 3) - (y >> s & 3))
            far += 6 if d == 3 else d
    score = min(far, 511) + min(abs(a[1] - b[1]), 24) + (a[0] != b[0])
    for s in (0, 4):
        d = abs((a[2] >> s & 15) - (b[2] >> s & 15))
        score += min(d, 16 - d)
    return 1 - min(score, 568) / 568


def test_fingerprints(spark, docs):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, int(hashlib.md5((r.text or "").encode()).hexdigest()[:12], 16), r.text or "") for r in docs.collect()), reverse=True)
    want = []
    for (some, i, _, a), (*_, b) in zip(rows, rows[1:] + rows[:1]):
        k = len(a) // 3
        edited = (a[: len(a) - k] + b[:k]).encode()
        one, two, three = brute_digest(a.encode()), brute_digest(edited), brute_digest(b.encode())
        want.append((i if some else None, len(a), hashlib.sha256(edited).hexdigest(), one.hex(), two.hex(), round(brute_likeness(one, two), 9), round(brute_likeness(one, three), 9)))
    for tasks in (1 << 14, 2):
        out = fingerprint.fingerprint_documents(docs, max_tasks=tasks).collect()
        assert sorted(map(str, [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in out])) == sorted(map(str, want))
    one = docs.where("doc_id = 5")
    assert fingerprint.fingerprint_documents(one).first().near_next == 1
    assert fingerprint.fingerprint_documents(docs.limit(0)).count() == 0


def test_digests_of_texts_over_the_span(monkeypatch):
    rng = random.Random(3)
    data = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (0, 3, 7, 900, 4, 5, 350, 64, 68, 1)]
    monkeypatch.setattr(fingerprint, "SPAN", 64)
    assert fingerprint.hexes(fingerprint.digests(data)) == [brute_digest(d).hex() for d in data]
    d = fingerprint.digests([b"abc" * 50, b"abc" * 50, b"", b"x"])
    assert (fingerprint.difference(d[:1], d[1:2]) == 0).all() and (fingerprint.likeness(d[:2], d[2:]) < 1).all()


def test_fingerprints_of_one_id_and_of_none(spark):
    """Rows of one id, or of none, are in order of their texts' hashes and are spread like any others."""
    rows = [(None if i % 2 else 7, f"text {i} " * 9) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    order = sorted(rows, key=lambda r: (r[0] is not None, int(hashlib.md5(r[1].encode()).hexdigest()[:12], 16)), reverse=True)
    want = sorted(hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest() for (_, a), (_, b) in zip(order, order[1:] + order[:1]))
    assert sorted(r.edited_sha256 for r in fingerprint.fingerprint_documents(df).collect()) == want


def test_language_training_stays_finite():
    """Texts of very different lengths and labels at odds with them must not make training diverge, at any rate."""
    rng = np.random.default_rng(3)
    texts, langs = [], []
    for k in range(300):
        lang = ("aa", "bb", "cc")[min(2, k % 10)]
        alphabet = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}[lang]
        n = int(rng.choice([1, 5, 50, 5000], p=[0.3, 0.3, 0.3, 0.1]))
        texts.append(" ".join("".join(rng.choice(list(alphabet), 4)) for _ in range(n)))
        langs.append(lang if rng.random() > 0.1 else "cc")
    for rate in (0.5, 50.0):
        model = language_id.train(texts, langs, buckets=1 << 10, rate=rate)
        assert np.isfinite(model.table).all() and np.abs(model.table).max() < 1e4
        found, scores, _ = model.predict(["abcd ecba", "fghi jihg", "klmn onml", None])
        assert found == ["aa", "bb", "cc", "und"] and np.isfinite(scores).all()
