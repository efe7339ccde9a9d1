"""Operator 1: MinHash near-dedup by ProbMinHash.

A text is the multiset of its five-word shingles (lower case, split at white space; a shorter text is one
shingle). Every shingle is a Poisson process whose rate is its count: its arrivals fall on registers at random, a
register keeps the earliest arrival of all shingles. Arrivals later than the latest register can change
nothing, so a shingle's process ends there. Two texts agree in a register with the probability of their
probability Jaccard similarity. Texts with repeated shingles have a second set of registers, with all counts 1, that agree
with the probability of their plain Jaccard similarity; without repeats both sets are the same. Registers are grouped
into bands; texts that share a band of either set are candidates, candidates are screened by both sets (one byte of
each register) and verified on whole texts: a link is a probability Jaccard or a plain Jaccard similarity of the
shingles of at least the threshold.

A bucket isn't expanded into all pairs: exact copies are one node, and every node is first compared with its bucket's
leader (the least key, which is a hash) alone. Of nodes that are then in different components, buckets of up to WHOLE
nodes compare all. Larger buckets that share nodes form a family, which is compared without loss in blocks: what is
outside the family's largest component against the whole family. A pair of blocks counts common shingles of all its
texts at once and gives spanning links only, so no pairs are written; its rows are shingles, bounded by BLOCK and
BLOCK_SHINGLES.

Rows of one bucket, leader, text or class meet what is told of it in parts where they are many (salted_join). Long texts are
shingled some 256 KB at a time, and their shingles go to the registers a million at a time.

Defined cases: texts that are null or have no word link with nothing and are kept; equal texts are one class;
repeated rows give a row each; rows with a null id belong to classes but don't name them (a class of only such
rows has a null class_id); other columns, whatever their names, are ignored, and carried by keep_one; texts may be of any length
that a row can have; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm.common import map_texts, packed, release, released, salted_join, text_slices, unpacked
from terrazone.llm.graph import components
from terrazone.session import cut

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
#: Characters of a text that are split into words at once, and shingles that go to the registers at once.
SPAN, PART = 1 << 18, 1 << 20
#: Keys of a bucket up to which all pairs that are apart are verified one by one.
WHOLE = 32
#: Texts and distinct shingles that a block of a larger family has on average at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Parts in which the keys of a family meet the numbers of its blocks.
SALTS = 64
#: Share of equal registers, of either set, under which a candidate isn't verified: six standard deviations below the threshold.
SCREEN = THRESHOLD - 6 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5


_GAP = re.compile(r"\s")
#: A character that isn't white space, as Python splits.
WORDLIKE = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, split SPAN characters at a time at white space."""
    found, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + SPAN)
        end = gap.start() if gap else len(text)
        words = text[at:end].lower().split()
        flat = np.empty(len(words), object)
        flat[:] = words
        found.append(pd.util.hash_array(flat, categorize=False) if words else np.zeros(0, np.uint64))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, 64-bit hash, count, ordered by text and hash."""
    long = [len(t) > SPAN for t in texts]
    split = [() if far else t.lower().split() for t, far in zip(texts, long)]
    flat = np.empty(sum(map(len, split)), object)
    flat[:] = [w for ws in split for w in ws]
    word = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    if any(long):
        parts = np.split(word, np.cumsum(sizes)[:-1])
        parts = [word_hashes(t) if far else p for t, far, p in zip(texts, long, parts)]
        word, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    flat = word
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(split)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words from here to the text's end
    first = np.repeat(np.cumsum(sizes) - sizes, sizes) == np.arange(len(flat))
    value = np.zeros(len(flat), np.uint64)
    for k in range(words):
        inside = left > k
        value[inside] = _mix(value[inside] * np.uint64(0x9E3779B97F4A7C15) + word[np.flatnonzero(inside) + k] + np.uint64(k + 1))
    start = (left >= words) | first
    doc, value = doc[start], value[start]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def registers(doc: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int, size: int) -> np.ndarray:
    """ProbMinHash registers: for each text and register the hash of the arrival that came first; 0 without any shingle."""
    best = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, np.uint64)
    for at in range(0, len(doc), PART):
        _arrivals(doc[at : at + PART], value[at : at + PART], count[at : at + PART], best, winner, texts, size)
    return winner.reshape(texts, size)


def _arrivals(doc: np.ndarray, value: np.ndarray, count: np.ndarray, best: np.ndarray, winner: np.ndarray, texts: int, size: int) -> None:
    """Let the arrivals of some shingles, in order of text and value, win registers."""
    seed = _mix(value)
    time = np.zeros(len(doc))
    with np.errstate(divide="ignore"):
        rate = 1.0 / count
    for k in range(1, 1 << 30):
        if not len(doc):
            break
        seed = _mix(seed + np.uint64(0x9E3779B97F4A7C15))
        draw = _mix(seed ^ np.uint64(0xD1B54A32D192ED03))
        time = time - np.log1p(-(seed >> np.uint64(11)).astype(np.float64) * 2.0**-53) * rate
        place = doc * size + (draw % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, place, time)
        won = time == best[place]  # rows are in order of value, so a tie falls alike everywhere
        winner[place[won]] = _mix(value[won] + np.uint64(1))
        latest = best.reshape(texts, size).max(axis=1)
        live = time < latest[doc]
        doc, value, seed, time, rate = doc[live], value[live], seed[live], time[live], rate[live]


def bands(found: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band of each text."""
    cells = found.reshape(len(found), count, rows)
    key = np.tile(np.arange(1, count + 1, dtype=np.uint64), (len(found), 1))
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, r])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact probability Jaccard and plain Jaccard similarity of two shingle multisets (sorted hashes, counts)."""
    both, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0, 0.0
    x, y = a[1][at].astype(np.float64), b[1][bt].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    above = a[1].sum() - x.sum() + np.append(np.cumsum(x[::-1])[::-1], 0)  # by place: counts of a with no less a ratio
    below = b[1].sum() - y.sum() + np.append(0, np.cumsum(y))
    first = np.searchsorted(ratio, ratio, "left")
    return float((1 / (above[first] / x + below[first] / y)).sum()), len(both) / (len(a[0]) + len(b[0]) - len(both))


def _sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (hash of the text), bands and one byte of each register (of both sets where they differ); both null for a text without words."""
    kind = dict(df.dtypes)[id_col]

    def make():
        def step(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column("text").to_pylist()]
            doc, value, count = shingles(texts)
            found = registers(doc, value, count, len(texts), BANDS * ROWS)
            some = np.bincount(doc, minlength=len(texts)) > 0
            keys = bands(found)
            low = (found & np.uint64(255)).astype(np.uint8)
            cells, bytes_ = [k.tolist() if s else None for k, s in zip(keys, some)], [r.tobytes() if s else None for r, s in zip(low, some)]
            # texts with repeats: registers of plain Jaccard similarity as well
            repeats = np.bincount(doc[count > 1], minlength=len(texts)) > 0
            place = np.flatnonzero(repeats)
            held = repeats[doc]
            flat = registers((np.cumsum(repeats) - 1)[doc[held]], value[held], np.ones(held.sum(), np.int64), len(place), BANDS * ROWS)
            for i, k, r in zip(place.tolist(), bands(flat), (flat & np.uint64(255)).astype(np.uint8)):
                cells[i] += k[k != keys[i]].tolist()
                bytes_[i] += r.tobytes()
            return {"id": part.column("id"), "key": part.column("key"), "bands": cells, "low": bytes_}

        return step

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.md5(df[text_col]).alias("key"))
    return map_texts(rows, make, f"id {kind}, key string, bands array<long>, low binary")


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, s) for the pairs (a, b) of keys whose registers don't show them apart: s the larger exact similarity."""
    low = nodes.select("key", "low")
    size = BANDS * ROWS

    def both(column: pa.Array) -> np.ndarray:
        held = column.to_pylist()
        return np.frombuffer(b"".join(x if len(x) > size else x + x for x in held), np.uint8).reshape(len(held), 2, size)

    pairs = cut(pairs, "pairs")  # b may be the leader of a bucket that holds a third of all texts
    near = salted_join(pairs, low.select(F.col("key").alias("b"), F.col("low").alias("lb")), "b").join(low.select(F.col("key").alias("a"), F.col("low").alias("la")), "a")

    def screen(batches):
        for batch in released(batches):
            if not batch.num_rows:
                continue
            la, lb = both(batch.column("la")), both(batch.column("lb"))
            yield batch.filter(pa.array((la == lb).mean(axis=2).max(axis=1) >= SCREEN)).select(["a", "b"])

    def exact(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def of(key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
            if key not in held:
                if len(held) >= 64:
                    held.clear()
                _, value, count = shingles([text])
                held[key] = value, count
            return held[key]

        for batch in released(batches):
            for part in text_slices(batch, "ta"):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                s = []
                for i, (x, y) in enumerate(zip(a, b)):
                    _, value, count = shingles([part.column("ta")[i].as_py()])
                    s.append(max(similarity((value, count), of(y, part.column("tb")[i].as_py()))))
                yield pa.RecordBatch.from_pydict({"a": a, "b": b, "s": pa.array(s, pa.float64())})

    near = cut(near.select("a", "b", "la", "lb").mapInArrow(screen, "a string, b string"), "near")
    told = salted_join(near, texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    return told.select("a", "b", "ta", "tb").mapInArrow(exact, "a string, b string, s double")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of each of left with each of right (sorted distinct values)."""
    nl, nr = len(left), len(right)
    found = np.zeros((nl, nr))
    lv, rv = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(lv, rv)
    if not len(shared):
        return found

    def coded(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        code = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        row, code = row[shared[code] == values], code[shared[code] == values]
        order = np.argsort(code, kind="stable")
        return row[order], code[order]

    (li, lc), (ri, rc) = coded(lv, left), coded(rv, right)
    ln, rn = np.bincount(lc, minlength=len(shared)), np.bincount(rc, minlength=len(shared))
    # values of many rows: products of matrices, some columns at a time
    common = np.flatnonzero(ln * rn > max(64, nl * nr // 64))
    place = np.full(len(shared), -1)
    place[common] = np.arange(len(common))
    for at in range(0, len(common), 1024):
        x, y = np.zeros((nl, 1024), np.float32), np.zeros((nr, 1024), np.float32)
        for cells, row, code in ((x, li, lc), (y, ri, rc)):
            here = (place[code] >= at) & (place[code] < at + 1024)
            cells[row[here], place[code[here]] - at] = 1
        found += x @ y.T
    # the others: each row of the left with the rows of the right that have the value
    keep = place[lc] < 0
    li, lc = li[keep], lc[keep]
    first, part = np.cumsum(rn) - rn, np.cumsum(rn[lc]) >> 20
    for p in np.unique(part):
        row, code = li[part == p], lc[part == p]
        times = rn[code]
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        other = ri[np.repeat(first[code], times) + offset]
        found += np.bincount(np.repeat(row, times) * nr + other, minlength=nl * nr).reshape(nl, nr)
    return found


def spanning_links(left: list[tuple], right: list[tuple], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links (place in left, place in right) that join all components that a link between left and right joins.

    Both sides hold (sorted shingles, counts, component). Plain Jaccard similarity comes from the counts of common
    shingles. Probability Jaccard equals it without repeated shingles; with e repeats on either side it is at most
    N / (N + shingles of one side only), N = common + e, and at most the share of common shingles in either multiset.
    Where that bound reaches the threshold, it is computed.
    """
    common = _common([x[0] for x in left], [x[0] for x in right])
    size, whole = (([np.array([f(x) for x in side], float) for side in (left, right)]) for f in (lambda x: len(x[0]), lambda x: x[1].sum()))
    names, label = np.unique([x[2] for x in (*left, *right)], return_inverse=True)
    ll, lr = label[: len(left)], label[len(left) :]
    apart = ll[:, None] != lr[None, :]
    union = size[0][:, None] + size[1][None, :] - common
    plain = apart & (common / union >= threshold)
    more = [w - n for w, n in zip(whole, size)]
    most = common + more[0][:, None] + more[1][None, :]
    bound = np.minimum(most / (most + union - common), np.minimum((common + more[0][:, None]) / whole[0][:, None], (common + more[1][None, :]) / whole[1][None, :]))
    # the bound is a little lowered by rounding at worst
    unsure = apart & ~plain & (bound >= threshold - 1e-9) & (common > 0) & ((more[0][:, None] > 0) | (more[1][None, :] > 0))
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for cells, sure in ((plain, True), (unsure, False)):
        a, b = np.nonzero(cells)
        if sure:  # one pair of texts for each pair of components
            _, at = np.unique(ll[a] * len(names) + lr[b], return_index=True)
            a, b = a[at], b[at]
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(ll[i]), find(lr[j])
            if x != y and (sure or max(similarity(left[i][:2], right[j][:2])) >= threshold):
                parent[y] = x
                out.append((i, j))
    return out


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component and the size n of the bucket."""
    known = cut(members.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key")), "known")
    mixed = cut(known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).drop("lo", "hi"), "mixed")
    return salted_join(known, mixed, "bucket", mixed.select("bucket", F.col("n").alias("rows_of_key")))


def _small_pairs(open_: DataFrame) -> DataFrame:
    """All pairs of keys that are apart in buckets of up to WHOLE."""
    small = open_.where(F.col("n") <= WHOLE)
    x, y = (small.select("bucket", F.col("key").alias(t), F.col("label").alias(f"l{t}")) for t in ("a", "b"))
    return x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))).select("a", "b").distinct()


def _family_links(open_: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join all that is linked and apart within families of buckets of more than WHOLE."""
    large = open_.where(F.col("n") > WHOLE)
    family = components(large.select("key", "leader"), "key", "leader").select(F.col("node").alias("key"), F.col("label").alias("family"))
    own = large.select("key", "label").distinct().join(family, "key")

    def make():
        def step(part: pa.RecordBatch) -> dict:
            names, sets = [], []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                _, value, count = shingles([text])
                names.append(key)
                sets.append((value.tobytes(), count.tobytes(), len(value)))
            value, count, size = zip(*sets) if sets else ((), (), ())
            return {"key": names, "value": list(value), "count": list(count), "size": list(size)}

        return step

    sets = map_texts(texts.join(own.select("key"), "key", "left_semi").select("key", "text"), make, "key string, value binary, count binary, size long")
    own = cut(own.join(sets, "key"), "families")
    parts = own.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("family").agg(F.max(F.struct("n", "label", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES))
    p, q = blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")), blocks(F.col("main.n"), F.col("main.size"))
    plan = whole.select("family", F.col("main.label").alias("main"), p.alias("p"), q.alias("q")).where("p > 0")
    # a family may hold most keys, so it meets its plan in SALTS parts
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = own.withColumn("salt", F.pmod(F.xxhash64("key", F.lit("salt")), F.lit(SALTS))).join(plan, ["family", "salt"])
    outside = F.col("label") != F.col("main")
    place = F.xxhash64("key")
    dealt = dealt.withColumn("block", F.when(outside, F.pmod(place, "p")).otherwise(F.col("p") + F.pmod(place, "q")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(outside, F.col("p") + F.col("q")).otherwise(F.col("p")) - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    # one column, so that rows dealt by family are dealt anew: a task for each pair of blocks, not for a family
    dealt = dealt.select(F.concat_ws(":", "family", i, j).alias("pair"), i.alias("i"), j.alias("j"), "block", "key", "label", "value", "count")

    def compare(group: pa.Table) -> pa.Table:
        block, key, label = (group.column(c).to_pylist() for c in ("block", "key", "label"))
        sets = [(np.frombuffer(v, np.uint64), np.frombuffer(n, np.int64), c) for v, n, c in zip(group.column("value").to_pylist(), group.column("count").to_pylist(), label)]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = ([k for k, x in enumerate(block) if x == side] for side in (i, j))
        found = spanning_links([sets[k] for k in left], [sets[k] for k in right], threshold) if left and right else []
        if len(sets) > 64:
            release()
        return pa.table({"a": pa.array([key[left[x]] for x, _ in found], pa.string()), "b": pa.array([key[right[y]] for _, y in found], pa.string())})

    return dealt.groupBy("pair").applyInArrow(compare, "a string, b string")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, class_id (the least id of its class), kept (id = class_id), n_class (rows in the class), key (MD5 of the text)."""
    return _classes(df, id_col, text_col, threshold).drop("label")


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """near_duplicates with label, which tells classes apart that have one class_id; null for a text without words."""
    sketches = cut(_sketches(df, id_col, text_col), "sketches")
    nodes = cut(sketches.where(F.col("bands").isNotNull()).groupBy("key").agg(F.first("bands").alias("bands"), F.first("low").alias("low")), "nodes")
    members = nodes.select("key", F.explode("bands").alias("bucket"))  # a band's number is part of its key
    leaders = cut(members.groupBy("bucket").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("rows_of_key")).where(F.col("rows_of_key") > 1), "leaders")
    members = cut(salted_join(members, leaders.drop("rows_of_key"), "bucket", leaders), "members")
    # whole texts, once for each key that has a candidate
    wanted = members.select("key").distinct()
    rows = df.select(df[text_col].alias("text"), F.md5(df[text_col]).alias("key"))
    texts = cut(rows.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key", "left_semi"), "texts")
    # each key with its bucket's leader; then what is still apart, pair by pair in small buckets, in blocks in large ones
    leading = members.where(F.col("key") != F.col("leader")).select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct()
    links = cut(_verify(leading, nodes, texts), "verified").where(F.col("s") >= threshold).select("a", "b")
    labels = cut(components(links, "a", "b"), "labels")
    open_ = cut(_open(members, labels), "open")
    small = cut(_verify(_small_pairs(open_), nodes, texts), "verified").where(F.col("s") >= threshold).select("a", "b")
    fresh = small.unionByName(cut(_family_links(open_, texts, threshold), "spanning"))
    if not fresh.isEmpty():
        labels = cut(components(links.unionByName(fresh), "a", "b"), "labels")
    groups = sketches.where(F.col("bands").isNotNull()).groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key")), "groups")
    whole = groups.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_class"))
    classes = salted_join(groups, whole, "label").select("key", "class_id", "n_class", "label")
    alone = sketches.where(F.col("bands").isNull()).select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_class"), "key", F.lit(None).cast("string").alias("label"))
    joined = salted_join(sketches.where(F.col("bands").isNotNull()).select("id", "key"), classes, "key", groups.select("key", F.col("n").alias("rows_of_key"))).select("id", "class_id", "n_class", "key", "label")
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "n_class", "key", "label")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, one for each class of near-duplicates; rows without words all stay.

    The row that stays is that of the least id, and text by its MD5, of its class; of rows that share both, one. Where all ids of a class are null,
    one row of the least text stays.
    """
    found = _classes(df, id_col, text_col).where(F.col("label").isNotNull()).select("label", F.col(id_col).alias("id"), "key")
    # nulls last, so that a row with an id stays where there is one
    least = found.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key")).alias("m")).select("m.id", "m.key")
    least = cut(least, "kept")
    rows = df.select(packed(df), df[id_col].alias("id"), F.md5(df[text_col]).alias("key"), F.coalesce(df[text_col].rlike(WORDLIKE), F.lit(False)).alias("words"))
    # repeated rows of one id and text are one before they are shuffled
    single = rows.where("words").groupBy("id", "key").agg(F.first("row").alias("row"))
    kept = single.join(least.select(F.col("id").alias("id2"), F.col("key").alias("key2")), F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left_semi").select("row")
    return kept.unionByName(rows.where(~F.col("words")).select("row")).select(*unpacked(rows, df.columns))
