"""Operator 12: importance resampling towards a target distribution.

Words and pairs of adjacent words of a text are hashed into buckets. A bucket's gain is the scaled logarithm of how much more often a feature of
the target falls into it than one of the documents; gains are one array, and the weight of a document is the mean of the gains of its features, read
from the array by bucket. Adding a Gumbel number hashed from the id to each weight, and taking the greatest sums, draws without replacement with
odds that follow the weights.

The draw is exact and sorts nothing as a whole: scores are whole numbers in a range that doesn't grow with the table, so a histogram of them (one row a score,
counted by Spark) is small. Its counts, summed from the greatest score down, are the ranks before each score, and tell the score at which the draw
ends; within each surviving score rows are numbered by id. Scores carry the Gumbel number, so rows that are alike in all but their id
spread over about a thousand scores.

Counting is one pass with a count for each bucket and task, scoring another; only counts and one row for each surviving document are shuffled.

Defined cases: a null text, or one without words, has no features and weight 0; only A-Z are lower-cased; a null id hashes as an empty one and
is behind all others of its score; rows of equal id and score are ordered by a hash of their texts, equal rows in any order (the result is the same); an empty table
gives an empty result, an empty target only gains that are even; a text may have any length that a row can have, one slice of texts is held at a time; other columns, whatever
their names, are ignored or, where named in carry, carried.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrazone.llm.common import map_texts, packed, unpacked
from terrazone.session import cut

BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, 25, 7
#: What stands between words, as byte values: ASCII that is neither a digit nor a letter. A-Z become a-z.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Longest second word of a pair whose hash is put together from tables.
TABLED = 64


def _appended() -> np.ndarray:
    """[n, k, b]: what a crc32 with only byte k set, to b, becomes when n bytes follow, but for those bytes' own crc32."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    at = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    found = [at]
    for _ in range(TABLED):
        at = (at >> np.uint32(8)) ^ byte[at & 255]
        found.append(at)
    return np.stack(found)


class Features:
    """Buckets of the features of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.appended = buckets, _appended()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and text number of each feature, in any order, and the number of words of each text."""
        flat: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.translate(WORD).split()
            flat += words
            sizes[i] = len(words)
        if not flat:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes
        coded = pa.array(flat, pa.large_binary()).dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        one = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
        spaced = np.fromiter((zlib.crc32(b" ", int(c)) for c in one), np.uint32, len(distinct))
        length = np.fromiter(map(len, distinct), np.int64, len(distinct))
        text = np.repeat(np.arange(len(texts)), sizes)
        at = np.flatnonzero(text[1:] == text[:-1])
        left, right = spaced[code[at]], code[at + 1]
        n = np.minimum(length[right], TABLED)
        two = one[right]
        for k in range(4):
            two = two ^ self.appended[n, k, (left >> np.uint32(8 * k)) & 255]
        for i in np.flatnonzero(length[right] > TABLED):
            two[i] = zlib.crc32(distinct[right[i]], int(left[i]))
        hashes = np.concatenate([one[code], two])
        return hashes.astype(np.int64) % self.buckets, np.concatenate([text, text[at]]), sizes


def _bytes(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.large_binary()).to_pylist()]


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts; a task sends a row for each bucket that it met, for a slice of texts at most."""

    def make():
        features = Features(buckets)

        def step(part: pa.RecordBatch) -> dict:
            n = np.bincount(features.of(_bytes(part))[0], minlength=buckets)
            met = np.flatnonzero(n)
            return {"bucket": met, "n": n[met]}

        return step

    found = map_texts(df.select(df[text_col].alias("text")), make, "bucket long, n long", limit=1 << 23)
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: floor(1000 ln of the target's smoothed share over the documents'). The driver holds a number for each bucket."""
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for held, df, column in ((s, source, text_col), (t, target, target_col)):
        for r in bucket_counts(df, column, buckets).collect():
            held[r.bucket] = r.n
    both = float(s.sum() + buckets), float(t.sum() + buckets)
    return [math.floor(1000 * math.log((float(b) + 1) * both[0] / ((float(a) + 1) * both[1]))) for a, b in zip(s, t)]


def scored(df: DataFrame, gain: list[int], seed: int, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """id, tie, n_words, n_features, weight, score and row (the carried columns) of every document."""

    def make():
        features, array = Features(len(gain)), np.array(gain, np.int64)

        def step(part: pa.RecordBatch) -> dict:
            bucket, text, words = features.of(_bytes(part))
            n = np.bincount(text, minlength=len(words))
            # sums of whole numbers under 2^53, so doubles hold them exactly
            total = np.bincount(text, array[bucket], len(words)).astype(np.int64)
            return {"id": part.column("id"), "tie": part.column("tie"), "row": part.column("row"), "n_words": words, "n_features": n, "weight": total // np.maximum(n, 1)}

        return step

    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias("tie"), packed(df, carry))
    kind = dict(picked.dtypes)
    told = map_texts(picked, make, f"id {kind['id']}, tie long, row {kind['row']}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return told.withColumn("score", F.col("weight") + gumbel.cast("long"))


def resample(
    df: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """Every document's id, n_features, weight, score and rank: 1, 2, 3, ... of those drawn, share in a hundred of the documents of least_words words or more; else null.

    carry: columns of df that come back beside them, as a struct row.
    """
    told = cut(scored(df, gains(df, target, text_col, target_col, buckets), seed, id_col, text_col, carry or []), "scored")
    able = F.col("n_words") >= least_words
    # a row a score: a range that the gains' and the Gumbel numbers' bounds bound, some 100000 scores at most
    histogram = sorted(((r[0], r[1]) for r in told.where(able).groupBy("score").agg(F.count(F.lit(1))).collect()), reverse=True)
    size = share * sum(n for _, n in histogram) // 100
    before, offsets = 0, []
    for score, n in histogram:
        if before >= size:
            break
        offsets.append((score, before))
        before += n
    last = offsets[-1][0] if offsets else None
    ends = F.broadcast(df.sparkSession.createDataFrame(offsets, "score long, before long"))
    alive = able & (F.col("score") >= F.lit(last)) if offsets else F.lit(False)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "tie"))
    drawn = told.where(alive).join(ends, "score").withColumn("rank", F.col("before") + place).withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    columns = ["id", "n_features", "weight", "score", "rank", "row"]
    out = drawn.select(*columns).unionByName(told.where(~alive).withColumn("rank", F.lit(None).cast("long")).select(*columns))
    return out.select(F.col("id").alias(id_col), *columns[1:5], *(["row"] if carry else []))


def keep_drawn(df: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of df that are drawn, with all their columns."""
    return (found := resample(df, target, carry=df.columns, **settings)).where(F.col("rank").isNotNull()).select(*unpacked(found, df.columns))


_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _AZ + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with recursive d as materialized (select doc_id, coalesce({_WORDS.format("text")}, []) as w from documents),
b as materialized (select coalesce({_WORDS.format("text")}, []) as w from benchmark),
fd as materialized (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d),
fb as materialized (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b),
crcs as materialized (select i, list_reduce(range(8), lambda a, k: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end, i) as v from range(256) t(i)),
letters as materialized (select f, hex(f) as x, octet_length(encode(f)) as n from (select distinct f from (select f from fd union all select f from fb))),
steps(f, x, n, pos, c) as (select f, x, n, 0, 4294967295::bigint from letters
  union all select f, x, n, pos + 1, xor(c // 256, v) from steps join crcs on i = xor(c, ('0x' || substr(x, 2 * pos + 1, 2))::bigint) % 256 where pos < n),
bucketed as materialized (select f, xor(c, 4294967295) % {BUCKETS} as bucket from steps where pos = n),
s as (select bucket, count(*) as n from fd join bucketed using (f) group by bucket),
t as (select bucket, count(*) as n from fb join bucketed using (f) group by bucket),
gain as materialized (select i as bucket, floor(1000 * ln((coalesce(t.n, 0) + 1e0) * ((select coalesce(sum(n), 0) from s) + {BUCKETS}e0) / ((coalesce(s.n, 0) + 1e0) * ((select coalesce(sum(n), 0) from t) + {BUCKETS}e0))))::bigint as g
  from range({BUCKETS}) r(i) left join s on s.bucket = i left join t on t.bucket = i),
w as (select doc_id, count(*) as n_features, floor(sum(g)::double / count(*))::bigint as weight from fd join bucketed using (f) join gain using (bucket) group by doc_id),
h as (select doc_id, len(d.w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint as h from d left join w using (doc_id)),
scored as materialized (select *, weight + floor(-1000 * ln(-ln((h + 5e-1) / 4294967296e0)))::bigint as score from h),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where words >= {LEAST_WORDS})
select s.doc_id, s.n_features, s.weight, s.score, r as rank from scored s left join ranked k on k.doc_id = s.doc_id and r <= {SHARE} * n // 100
"""
