"""Operator 9: document fingerprints.

A quartile bucket digest: every window of five bytes gives six byte triplets, each hashed to one of 256
buckets; a bucket's count is written as the quartile it falls in among all buckets (two bits), after a byte for
the text's length on a logarithmic scale, a checksum byte, and two half bytes for the ratios of the quartiles.
Two digests differ by a bounded score: per bucket the distance of the quartiles (opposite ends count 6), plus
the length and ratio differences, each cut off. Likeness is 1 - score / bound, 0 to 1. Windows are counted some
megabyte at a time, so a long text takes a few times its length.

Defined cases: a null text is the empty one; texts of under five bytes are padded with zero bytes, so they
have a digest too; equal texts have equal digests; repeated rows and equal ids follow one another in the order
(id descending, nulls last, then MD5 of the text); a table of one row is followed by itself; other columns, whatever their names,
are ignored; texts may be of any length that a row can have; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazone.llm.common import released, text_slices

BUCKETS = 256
#: Places, within a window, of the triplets' bytes: the newest byte and two others.
TRIPLETS = ((4, 3, 2), (4, 3, 1), (4, 2, 1), (4, 2, 0), (4, 3, 0), (4, 1, 0))
#: Bound of the difference: buckets that differ beyond a third of the way count no more.
LENGTH_BOUND, RATIO_BOUND = 24, 16
BODY_BOUND = 2 * BUCKETS
#: Bytes whose windows are counted at once.
SPAN = 1 << 20
BOUND = BODY_BOUND + LENGTH_BOUND + 2 * RATIO_BOUND


def digests(texts: list[bytes]) -> np.ndarray:
    """Digest bytes of each text, 4 + BUCKETS / 4 to a row."""
    padded = [t if len(t) >= 5 else t + b"\0" * (5 - len(t)) for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    data = np.frombuffer(b"".join(padded), np.uint8)
    ends = np.cumsum(sizes)
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    for start in range(0, len(data) - 4, SPAN):
        raw = data[start : start + SPAN + 4].astype(np.uint32)
        begins = np.arange(start, start + len(raw) - 4)
        doc = np.searchsorted(ends, begins, "right")
        inside = np.flatnonzero(begins + 4 < ends[doc])
        if not len(inside):
            continue
        lo, hi = int(doc[inside[0]]), int(doc[inside[-1]]) + 1
        at = (doc[inside] - lo) * BUCKETS
        for salt, (a, b, c) in enumerate(TRIPLETS, 1):
            mixed = raw[inside + a] * np.uint32(0x01000193) ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)
            mixed = (mixed ^ raw[inside + b]) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ mixed >> np.uint32(13) ^ raw[inside + c]) * np.uint32(0xC2B2AE35)
            counts[lo:hi] += np.bincount(at + (mixed >> np.uint32(24)), minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    code = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    body = code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6
    true = np.fromiter(map(len, texts), np.int64, len(texts))
    length = np.minimum(255, np.round(np.log(np.maximum(true, 1)) * 12)).astype(np.uint8)
    check = np.fromiter((hashlib.md5(t).digest()[0] for t in texts), np.uint8, len(texts))
    top = np.maximum(q3, 1)
    ratios = (q1 * 100 // top % 16 | (q2 * 100 // top % 16) << 4).astype(np.uint8)
    return np.concatenate([np.stack([check, length, ratios], axis=1), body.astype(np.uint8)], axis=1)


_PAIR = np.abs(np.arange(4)[:, None] - np.arange(4))
_PAIR[0, 3] = _PAIR[3, 0] = 6
#: Distance of two body bytes.
_BYTES = sum(_PAIR[(np.arange(256) >> s & 3)[:, None], np.arange(256) >> s & 3] for s in (0, 2, 4, 6)).astype(np.int32)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference score of digests, row by row; 0 for equal digests, at most BOUND."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    length = np.minimum(np.abs(a[:, 1] - b[:, 1]), LENGTH_BOUND)
    ratios = 0
    for s in (0, 4):
        d = np.abs((a[:, 2] >> s & 15) - (b[:, 2] >> s & 15))
        ratios = ratios + np.minimum(d, 16 - d)
    body = np.minimum(_BYTES[a[:, 3:], b[:, 3:]].sum(axis=1), BODY_BOUND - 1)
    return body + length + ratios + (a[:, 0] != b[:, 0])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.minimum(difference(a, b), BOUND) / BOUND


def hexes(found: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in found]


def _follow(batches: Iterator[pa.RecordBatch], step) -> Iterator[pa.RecordBatch]:
    """step(rows, next): parts of a sorted partition, each with the row that follows it."""
    held = None
    for batch in batches:
        for part in text_slices(batch, "text"):
            rows = part.to_pylist()
            if held:
                yield from step(held, rows[0])
            held = rows
    if held:
        yield from step(held, None)


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tasks: int = 1 << 14) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document, that of next lower id (after the lowest: the highest). Texts are shuffled once, into ranges
    of (id, hash of the text), four for each task, whose bounds come from a sample of some 16 rows a range; there are two tasks for each
    partition of the input, at most max_tasks, which bounds what the driver holds of ranges and sample. A range also gets the first document of the range below it (the lowest range: of the highest), so each
    task sees all it needs, sorted, and streams it.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    place = F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("long")
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text")).withColumn("place", place)
    spot = F.struct("id", "place")
    tasks = max(1, min(max_tasks, 2 * df.rdd.getNumPartitions()))
    total = df.count()
    ranges = 4 * tasks
    wanted = 16 * ranges
    share = F.pmod(F.xxhash64("id", "place"), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / max(1, total)) * (1 << 30)) + 1)
    # nulls are last, as in a struct's order they are the least
    sample = [(r.id, r.place) for r in rows.where(share).select("id", "place").limit(4 * wanted).collect()]
    sample.sort(key=lambda x: ((0,) if x[0] is None else (1, x[0])) + (x[1],))
    cuts = sample[:: max(1, len(sample) // ranges)][1:]
    cuts = [c for c, after in zip(cuts, [*cuts[1:], None]) if c != after]
    # cut points in groups of about the root of their number: the group first, then the place in it
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    table = spark.createDataFrame([([g[0] for g in groups], groups)], f"firsts array<struct<id:{kind},place:long>>, groups array<array<struct<id:{kind},place:long>>>")
    below = lambda held: F.size(F.filter(held, lambda c: c <= spot))
    group = below(F.col("firsts"))
    bucket = F.when(group == 0, F.lit(0)).otherwise((group - 1) * width + below(F.element_at("groups", F.greatest(group, F.lit(1)))))
    placed = rows.crossJoin(F.broadcast(table)).select("id", "text", "place", bucket.alias("bucket"))  # one row
    tops = {r.bucket: r.top for r in placed.groupBy("bucket").agg(F.max(spot).alias("top")).collect()}  # one row a range
    order = sorted(tops, reverse=True)
    # the first document of each range goes to the range above it too, that of the highest to the lowest
    firsts = spark.createDataFrame([(tops[lower], upper) for upper, lower in zip([order[-1], *order], order)] if order else [], f"top struct<id:{kind},place:long>, also int")
    told = firsts.select(F.col("top.id").alias("top_id"), F.col("top.place").alias("top_place"), "also")
    copies = placed.join(F.broadcast(told), F.col("id").eqNullSafe(F.col("top_id")) & (F.col("place") == F.col("top_place")), "left").select(
        "id", "text", "place", F.inline(F.array(F.struct(F.col("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("also").alias("bucket"), F.lit(True).alias("ghost"))))
    )
    copies = copies.where(F.col("bucket").isNotNull()).repartition(tasks, "bucket")
    copies = copies.sortWithinPartitions(F.desc("bucket"), F.asc("ghost"), F.desc_nulls_last("id"), F.desc("place"))
    schema = f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def step(part: list[dict], after: dict | None) -> Iterator[pa.RecordBatch]:
        following = [*part[1:], after]
        at = [i for i, row in enumerate(part) if not row["ghost"]]
        if not at:
            return
        texts = [part[i]["text"] for i in at]
        nexts = [following[i]["text"] for i in at]
        edited = []
        for text, nxt in zip(texts, nexts):
            k = len(text) // 3
            edited.append((text[: len(text) - k] + nxt[:k]).encode())
        own = digests([t.encode() for t in texts])
        # the next document's digest is the next row's, but for those at the end of a range or slice
        last = [k for k, i in enumerate(at) if k + 1 == len(at) or at[k + 1] != i + 1]
        lower = np.roll(own, -1, axis=0)
        lower[last] = digests([nexts[k].encode() for k in last])
        changed = digests(edited)
        yield pa.RecordBatch.from_pydict(
            {id_col: [part[i]["id"] for i in at], "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited], "fingerprint": hexes(own), "edited_fingerprint": hexes(changed), "near_edited": likeness(own, changed), "near_next": likeness(own, lower)},
            schema=arrow,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _follow(released(batches), step)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return copies.select("id", "text", "ghost").mapInArrow(run, schema)
