"""Operator 6: language ID.

A document is the average of hashed subword embeddings (byte n-grams of its lower-cased letters, runs of
anything else folded to one space) under a linear softmax, trained by stochastic gradient descent in numpy on
the driver. The sample for training is bounded: about `max_train` documents picked by a hash of their id and
text, whole texts, at most twice that many, and those of them in the order of that hash that hold `max_train_bytes` of text;
their lengths are summed before any text is fetched. A fifth of it is kept back to fit the softmax temperature and the rejection
threshold. Prediction needs only the product of embeddings and softmax weights, a table of buckets by languages, so it is
one gather and one segmented sum a slice; long texts are summed some 256 KB at a time.

A softmax is sure of texts in a language it has never seen, so the score also asks whether the text is made of what was
learned: the share of its four-byte subwords that are usual in some language, in USUAL of its training documents and two at least, so that a
few wrong labels don't make a language known (a bit for each of a million buckets). The score is the calibrated probability times that
share, over its median among texts kept back, one at most. A text is rejected when its score is below that of nearly all
texts kept back that were predicted rightly, or below an even chance if that is less, or when its share is less than 0.65 of
what 99 in 100 of them have.

Defined cases: text that is null or has no letter (str.isalpha) is `und` with score 0 and is rejected; ties go to the first
language by name; a null id is never learned from and not held out; repeated rows are predicted each; without
any labelled document every text is `und`; other columns, whatever their names, are ignored, and carried by keep_identified; texts may be
of any length that a row can have; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazone.llm.common import map_texts, released, text_slices

ORDERS = (2, 3, 4)
UND = "und"
#: Bytes of text predicted at once; a byte takes some 130 bytes of subwords and their rows of the table.
SLICE = 1 << 18
#: Buckets that tell which subwords of the largest order were met in training.
SEEN = 1 << 20
#: Share of a language's training documents that a usual subword is in.
USUAL = 0.06
_WORD = re.compile(r"[^\W\d_]+")

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter."""
    return any(c.isalpha() for m in _WORD.finditer(text or "") for c in m[0])


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, lower-cased, all but letters as one space, each text between spaces; and the number of each byte's text."""
    data = [b" " + t.lower().encode() + b" " for t in texts]
    raw = _FOLD[np.frombuffer(b"".join(data), np.uint8)]
    doc = np.repeat(np.arange(len(data), dtype=np.int32), [len(d) for d in data])
    space = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    return raw[keep], doc[keep]


def windows(raw: np.ndarray, doc: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the subwords that begin in each stretch of `size` bytes, a column for each order, and their texts; -1 where they cross texts."""
    for at in range(0, len(raw), size):
        near = raw[at : at + size + max(ORDERS) - 1].astype(np.uint32)
        whose = doc[at : at + size + max(ORDERS) - 1]
        begins = min(size, len(raw) - at)
        found = np.full((begins, len(ORDERS)), -1, np.int64)
        for column, order in enumerate(ORDERS):
            n = min(begins, len(near) - order + 1)
            if n <= 0:
                continue
            mixed = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
            for k in range(order):
                mixed = (mixed ^ near[k : k + n]) * np.uint32(0x01000193)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
            found[:n, column] = np.where(whose[:n] == whose[order - 1 : order - 1 + n], mixed.astype(np.int64), np.int64(-1))
        yield found, whose[:begins]


def bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers from 1; bucket 0 is for windows that cross texts and stands for nothing."""
    return np.where(hashes >= 0, hashes % (buckets - 1) + 1, 0)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray  # buckets by languages: embeddings times softmax weights
    bias: np.ndarray
    seen: np.ndarray  # a bit for each of SEEN buckets of subwords
    temperature: float = 1.0
    usual: float = 1.0  # median share of subwords met in training
    threshold: float = 0.0
    familiar: float = 0.0  # least share that is accepted

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and the share of its subwords of the largest order that were met in training (1 without any)."""
        raw, doc = folded(texts)
        sums, real = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        met, wide = np.zeros(len(texts)), np.zeros(len(texts))
        for hashes, whose in windows(raw, doc, SLICE):
            rows = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
            index = bucketed(hashes, len(self.table))
            np.add.at(sums, whose[rows], np.add.reduceat(self.table[index].sum(axis=1, dtype=np.float64), rows, axis=0))
            np.add.at(real, whose[rows], np.add.reduceat((index > 0).sum(axis=1), rows))
            last = hashes[:, -1]
            bit = np.where(last >= 0, last % SEEN, 0)
            known = (last >= 0) & (self.seen[bit >> 3] >> (bit & 7) & 1 > 0)
            np.add.at(met, whose[rows], np.add.reduceat(known.astype(np.int64), rows))
            np.add.at(wide, whose[rows], np.add.reduceat((last >= 0).astype(np.int64), rows))
        return sums / np.maximum(real, 1)[:, None] + self.bias, np.where(wide > 0, met / np.maximum(wide, 1), 1.0)

    def scored(self, logits: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row and its score."""
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best] * np.minimum(1.0, share / self.usual)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score, and whether it is accepted, of each text."""
        langs, scores, accepted = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if rows and self.langs:
            logits, share = self.logits([texts[i] for i in rows])
            best, scores[rows] = self.scored(logits, share)
            accepted[rows] = (scores[rows] >= self.threshold) & (share >= self.familiar)
            for i, b in zip(rows, best):
                langs[i] = self.langs[b]
        return langs, scores, accepted


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 4, rate: float = 0.5, seed: int = 7, keep_share: float = 0.999) -> LanguageModel:
    """Fit embeddings and softmax by stochastic gradient descent, then temperature and threshold on a fifth kept back."""
    names = tuple(sorted(set(langs)))
    if not names:
        return LanguageModel((), np.zeros((buckets, 0), np.float32), np.zeros(0), np.zeros(SEEN // 8, np.uint8))
    label = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(texts) // 5]
    fit = order[len(texts) // 5 :]
    docs, held_back = [None] * len(texts), set(held.tolist())
    met, often_met, documents = np.zeros(SEEN, bool), np.zeros(SEEN, np.int32), 0
    by_language = sorted(range(len(texts)), key=lambda i: label[i])
    for i, after in zip(by_language, [*by_language[1:], None]):
        unique, often, mine = np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.int64)]
        for hashes, _ in windows(*folded([texts[i]]), SLICE):
            index = bucketed(hashes, buckets)
            unique, at = np.unique(np.concatenate([unique, index[index > 0]]), return_inverse=True)
            often = np.bincount(at, np.concatenate([often, np.ones(int((index > 0).sum()), np.int64)]), len(unique)).astype(np.int64)
            if i not in held_back:
                mine.append(np.unique(hashes[hashes[:, -1] >= 0, -1] % SEEN))
        docs[i] = unique, (often / max(1, often.sum())).astype(np.float32)
        if i not in held_back:
            often_met[np.unique(np.concatenate(mine))] += 1
            documents += 1
        if after is None or label[after] != label[i]:
            met |= often_met >= max(2, USUAL * documents)
            often_met[:], documents = 0, 0
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    seen = np.bincount(label[fit], minlength=len(names))
    weight = (len(fit) / np.maximum(1, seen) / len(names)).clip(0.2, 5).astype(np.float32)
    steps, step = epochs * max(1, len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            unique, share = docs[i]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(unique):
                continue
            rows = emb[unique]
            x = share @ rows
            g = softmax(x @ out + bias)
            g[label[i]] -= 1
            # a subword's share of a long text is tiny: scaled up by the text's distinct subwords
            scale = np.minimum(share * len(unique), 4)
            # no longer a step than the curvature allows: the logits move by at most this times g, else training diverges
            curve = float(share @ scale) * float((out * out).sum()) + float(x @ x) + 0.1
            g *= min(lr * weight[label[i]], 1 / curve)
            back = out @ g
            out -= np.outer(x, g)
            bias -= 0.1 * g
            emb[unique] = rows - np.outer(scale, back)
    if not (np.isfinite(emb).all() and np.isfinite(out).all()):
        raise FloatingPointError("training diverged")
    emb[0] = 0
    model = LanguageModel(names, emb @ out, bias.astype(np.float64), np.packbits(met, bitorder="little"))
    if not len(held):
        return model
    found = [model.logits([texts[i] for i in held[k : k + 64]]) for k in range(0, len(held), 64)]
    logits, share = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    truth = label[held]

    # smoothed targets keep the scores below 1 where every document kept back is predicted rightly
    target = np.full(logits.shape, 1 / (len(held) + 2) / max(1, len(names) - 1))
    target[np.arange(len(held)), truth] = (len(held) + 1) / (len(held) + 2)

    def loss(t: float) -> float:
        return float(-(target * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean())

    model = replace(model, temperature=float(min(np.geomspace(0.05, 20, 60), key=loss)), usual=max(1e-6, float(np.median(share))))
    best, score = model.scored(logits, share)
    right = best == truth
    if not right.any():
        return model
    # rejected is what scores below nearly all documents predicted rightly; a threshold above an even chance would reject what is likely right
    return replace(model, threshold=min(0.5, float(np.quantile(score[right], 1 - keep_share))), familiar=0.65 * float(np.quantile(share[right], 0.01)))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_language_model(df: DataFrame, max_train: int = 4000, max_train_bytes: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Train on a bounded sample of the labelled documents that aren't held out."""
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    total = rows.count()
    if not total:
        return train([], [])
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    picked = rows.withColumn("place", place).where(F.col("place") < F.lit(int(min(1.0, max_train / total) * (1 << 40))))
    # places and lengths first, at most twice max_train of them; then the texts up to the place where their bytes reach the bound
    sizes = sorted((r.place, r.bytes) for r in picked.select("place", F.octet_length("text").alias("bytes")).limit(2 * max_train).collect())
    last, room = -1, max_train_bytes
    for at, size in sizes:
        room -= size
        if room < 0:
            break
        last = at
    texts, langs = [], []
    chosen = picked.where(F.col("place") <= F.lit(last)).limit(2 * max_train).select("id", "text", "lang")
    for row in sorted(chosen.toLocalIterator(), key=lambda r: (str(r.id), r.text)):
        if has_letter(row.text):
            texts.append(row.text)
            langs.append(row.lang)
    return train(texts, langs)


def identify_languages(df: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, accepted."""
    model = model or fit_language_model(df, id_col=id_col, text_col=text_col, lang_col=lang_col, **fit)
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets by languages, bounded
    kind = dict(df.dtypes)[id_col]

    def make():
        def step(part: pa.RecordBatch) -> dict:
            langs, scores, accepted = shared.value.predict(part.column("text").to_pylist())
            return {id_col: part.column("id"), "held_out": part.column("held_out"), "lang_pred": langs, "score": scores, "accepted": accepted}

        return step

    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"), held_out(df[id_col]).alias("held_out"))
    return map_texts(picked, make, f"{id_col} {kind}, held_out boolean, lang_pred string, score double, accepted boolean", limit=SLICE)


def keep_identified(df: DataFrame, text_col: str = "text", **fit) -> DataFrame:
    """The rows of df, all columns, whose language the model accepts."""
    shared = df.sparkSession.sparkContext.broadcast(fit_language_model(df, text_col=text_col, **fit))

    def keep(batches):
        for batch in released(batches):
            for part in text_slices(batch, text_col, SLICE):
                yield part.filter(pa.array(shared.value.predict(part.column(text_col).to_pylist())[2]))

    return df.mapInArrow(keep, df.schema)
