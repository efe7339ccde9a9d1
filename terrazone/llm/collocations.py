"""Operator 11: phrase collocations.

Texts are cut into pieces at punctuation and line ends; equal pieces of a language are one row with a multiplicity, so a passage that a
thousand documents share is read once. Runs of one to four words are counted with these weights. Counting is out of core: a task adds the counts of its
slices up in duckdb, which holds a bounded part in memory and spills the rest to the shared folder; what leaves is dealt by hash of language and run, and each hash bucket
is added up in duckdb in the same way. So no task holds all runs of a language, and a run that is everywhere sends one row a task.

Only runs of LEAST occurrences or more matter: a candidate's parts occur at least as often as it does. Counting goes in three passes over the pieces, and a
pass skips runs with a word, or a pair of words, that the pass before has found too rare. What was found travels as a bitmap of a fixed size (BITS); where
hashes meet, a run is counted in vain, so the bitmap saves work and never changes a count.

Candidates then ask for the counts of their parts: each cut is two requests, dealt by the part to where its count lies (parts asked by very many candidates meet it in
several places), and the answers go back to the candidate. The greatest count of a longer run around a phrase comes by one more grouping; ranks are taken in parts of a language,
then among what each part leaves.

Defined cases: a null text has no words, a null lang is und; empty pieces count nothing; words may hold any character but those that cut, U+0000 too; a language without
candidates has no rows; equal rows are documents each; an empty table gives an empty result; other columns, whatever their names, are ignored; texts and pieces may be as long as
a row can be: one slice of pieces is held at a time.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrazone.llm.common import released, salted_join, text_slices
from terrazone.session import cut, shared_dir

LEAST, LONGEST, TOP, INSIDE = 30, 4, 2000, 80
#: Bits of the bitmap of runs that occur often enough: 4 MiB.
BITS = 1 << 25
#: Rows of a batch that leaves a task.
OUT = 20_000
#: duckdb's memory in a task, UTF-8 bytes of pieces in a slice, and distinct runs that a hash bucket is meant for.
MEMORY, SLICE, BUCKET = "256MB", 1 << 24, 2_000_000
AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("words", pa.int32()), ("f", pa.int64())])
COUNTS_SQL = "lang string, gram string, words int, f long"


def pieces(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece (words joined by one space), words, m: distinct pieces and how often they stand in the texts."""
    low = F.regexp_replace(F.translate(F.coalesce(df[text_col], F.lit("")), *AZ), r"[ \t]+", " ")
    piece = F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]"))
    rows = df.select(F.coalesce(df[lang_col], F.lit("und")).alias("lang"), piece.alias("piece")).select("lang", F.trim("piece").alias("piece")).where("piece <> ''")
    found = rows.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))
    return found.select("lang", "piece", (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1).alias("words"), "m")


def spill_folder(df: DataFrame) -> str:
    """A folder that all executors share, for what duckdb doesn't hold in memory; none where the shared folder isn't part of the file system: then a task spills to its own temp folder."""
    at = urlparse(shared_dir(df.sparkSession))
    return f"{at.path}/duckdb-{uuid.uuid4().hex}" if at.scheme in ("", "file") else ""


def made_folder(path: str) -> str | None:
    """The folder, made with those above it; none where it isn't named or can't be made here."""
    try:
        os.makedirs(path, exist_ok=True)
    except OSError:
        return None
    return path if os.access(path, os.W_OK) else None


def added_up(batches: Iterator[pa.RecordBatch], least: int, spill: str) -> Iterator[pa.RecordBatch]:
    """Rows of lang, gram, words, f with equal ones added up by duckdb, out of core; those under least are left out."""
    import duckdb

    own = tempfile.mkdtemp(prefix="duckdb-", dir=made_folder(spill))  # duckdb makes no folder whose parent is missing, and asks for it only when it spills
    con = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": own, "preserve_insertion_order": False})
    try:
        con.execute("create table counted(lang varchar, gram varchar, words integer, f bigint)")
        for batch in batches:
            if batch.num_rows:
                con.register("part", pa.Table.from_batches([batch]))
                con.execute("insert into counted select lang, gram, words, f from part")
                con.unregister("part")
        for batch in con.sql(f"select lang, gram, words, sum(f)::bigint as f from counted group by all having sum(f) >= {least}").to_arrow_reader(OUT):
            yield batch.cast(COUNTS)
    finally:
        con.close()
        shutil.rmtree(own, ignore_errors=True)


def word_hash(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))


def bits_of(lang: str, *words: np.ndarray) -> np.ndarray:
    """The bit of each run of a language, from the hashes of its words."""
    at = np.uint64(zlib.crc32(lang.encode()))
    for h in words:
        at = (at ^ h) * np.uint64(0x9E3779B97F4A7C15)
        at = at ^ (at >> np.uint64(29))
    return (at % np.uint64(BITS)).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until the texts of a column have about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        more = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + more > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Runs:
    """Counts of the runs of words of slices of pieces."""

    def __init__(self, sizes: tuple[int, ...], often: np.ndarray | None):
        """often: the bitmap of runs that occur often enough, of one word where two are counted, of two where more are."""
        self.sizes, self.often = sizes, often

    def alive(self, lang: str, *words: np.ndarray) -> np.ndarray:
        at = bits_of(lang, *words)
        return (self.often[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def of(self, lang: str, text: pa.Array, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the pieces of one language."""
        parts = pc.split_pattern(text, " ")
        size = pc.list_value_length(parts).to_numpy()
        coded = pc.list_flatten(parts).dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        piece = np.repeat(np.arange(len(size)), size)
        weight = m[piece]

        def batch(found: list[str], words: int, f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(np.full(len(found), words, np.int32)), pa.array(f)], schema=COUNTS)

        def tally(ids: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
            found = np.zeros(n, np.int64)
            np.add.at(found, ids, weight[at])
            return found

        if self.sizes == (1,):
            yield batch(names, 1, tally(code, len(names), np.arange(len(code))))
            return
        at = np.flatnonzero(piece[1:] == piece[:-1])  # where a pair of words starts
        word = word_hash(names)
        if self.sizes == (2,):
            often = self.alive(lang, word)
            at = at[often[code[at]] & often[code[at + 1]]]
        else:
            at = at[self.alive(lang, word[code[at]], word[code[at + 1]])]
        key, ids = np.unique(code[at] * len(names) + code[at + 1], return_inverse=True)
        pairs = [f"{names[k // len(names)]} {names[k % len(names)]}" for k in key.tolist()]
        if self.sizes == (2,):
            yield batch(pairs, 2, tally(ids, len(key), at))
            return
        last = key % len(names)
        labels, size = pairs, 2
        here = np.full(len(code) + 1, -1)  # the pair that starts at a word
        here[at] = ids
        pair = here.copy()
        while size < max(self.sizes):
            # a run goes on where a pair of the same piece starts at its last word
            start = np.flatnonzero(here >= 0)
            start = start[start + size - 1 < len(code)]
            start = start[pair[start + size - 1] >= 0]
            key, ids = np.unique(here[start] * len(pairs) + pair[start + size - 1], return_inverse=True)
            labels = [f"{labels[k // len(pairs)]} {names[last[k % len(pairs)]]}" for k in key.tolist()]
            size += 1
            if size in self.sizes:
                yield batch(labels, size, tally(ids, len(key), start))
            here = np.full(len(code) + 1, -1)
            here[start] = ids


def count_runs(held: DataFrame, sizes: tuple[int, ...], often, least: int, spill: str, buckets: int) -> DataFrame:
    """lang, gram, words, f of the runs of the given numbers of words that occur least times or more."""

    def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(sizes, None if often is None else np.frombuffer(often.value, np.uint8))

        def counted(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lang = part.column("lang").dictionary_encode()
            for code, name in enumerate(lang.dictionary.to_pylist()):
                of_lang = part.filter(pc.equal(lang.indices, code))
                yield from runs.of(name, of_lang.column("piece"), of_lang.column("m").to_numpy())

        parts = (part for given in released(gathered(batches, "piece", SLICE)) for part in text_slices(given, "piece", SLICE))
        first = next(parts, None)
        if first is None:
            return
        second = next(parts, None)
        if second is None:  # the counts of a slice are added up as they are
            for found in counted(first):
                yield from (found.slice(at, OUT) for at in range(0, found.num_rows, OUT))
        else:
            yield from added_up((found for part in chain([first, second], parts) for found in counted(part)), 1, spill)

    dealt = held.select("lang", "piece", "m").mapInArrow(in_slices, COUNTS_SQL).repartition(buckets, "lang", "gram")
    return dealt.mapInArrow(lambda batches: added_up(batches, least, spill), COUNTS_SQL)


def bitmap(found: DataFrame):
    """The bitmap of lang and gram of a table whose runs are of one length, broadcast: BITS bits whatever the table's size. Tasks send the chunks that they set, which are or-ed by chunk."""
    side = 1 << 13

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(coded.dictionary.to_pylist()):
                grams = [g.split(" ") for g in batch.column("gram").filter(pc.equal(coded.indices, code)).to_pylist()]
                at = bits_of(lang, *[word_hash([g[i] for g in grams]) for i in range(len(grams[0]))])
                np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        met = np.flatnonzero(held.reshape(-1, side).any(axis=1))
        yield pa.RecordBatch.from_pydict({"chunk": met, "bits": [held[c * side : (c + 1) * side].tobytes() for c in met]})

    def join_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, bits in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist()):
                held[c] = held.get(c, 0) | np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(held), pa.int64()), "bits": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    kind = "chunk long, bits binary"
    whole = bytearray(BITS // 8)
    for r in found.select("lang", "gram").mapInArrow(set_bits, kind).repartition(16, "chunk").mapInArrow(join_bits, kind).collect():
        whole[r.chunk * side : (r.chunk + 1) * side] = r.bits
    return found.sparkSession.sparkContext.broadcast(bytes(whole))


def frequent_runs(held: DataFrame, least: int) -> DataFrame:
    """lang, gram, words, f of all runs of one to four words that occur least times or more in distinct pieces with multiplicities."""
    spark, spill = held.sparkSession, spill_folder(held)
    total = held.agg(F.sum("words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    one = cut(count_runs(held, (1,), None, least, spill, buckets), "words")
    two = cut(count_runs(held, (2,), bitmap(one), least, spill, buckets), "pairs")
    more = cut(count_runs(held, tuple(range(3, LONGEST + 1)), bitmap(two), least, spill, buckets), "runs")
    return one.unionByName(two).unionByName(more)


def _key(gram: Column) -> Column:
    return F.concat("lang", F.lit("\n"), gram)


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every frequent run of two words or more, by its lowest-scoring cut."""
    phrases = frequent.where("words > 1").withColumn("w", F.split("gram", " "))
    cuts = phrases.select("lang", "gram", "f", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    side = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    asked = F.array(F.struct(F.lit(0).alias("side"), _key(side(F.lit(1), F.col("k"))).alias("part")), F.struct(F.lit(1).alias("side"), _key(side(F.col("k") + 1, F.col("words") - F.col("k"))).alias("part")))
    requests = cut(cuts.select("lang", "gram", "f", "words", "k", F.explode(asked).alias("p")).select("lang", "gram", "f", "words", "k", "p.*"), "requests")
    counts = frequent.select(_key(F.col("gram")).alias("part"), F.col("f").alias("told"))
    answers = salted_join(requests, counts, "part")
    told = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("told"))).alias(f"t{k}{s}") for k in range(1, LONGEST) for s in (0, 1)]
    back = answers.groupBy("lang", "gram").agg(F.first("f").alias("a"), F.first("words").alias("words"), *told)
    # decimals: the product passes 64 bits
    score = lambda k: F.expr(f"(cast(a as decimal(20, 0)) * 2000000BD) div (cast(t{k}0 as decimal(20, 0)) + cast(t{k}1 as decimal(20, 0)))")
    options = [F.when(F.col("words") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"t{k}0").alias("l"), F.col(f"t{k}1").alias("r"))) for k in range(1, LONGEST)]
    best = back.select("lang", F.col("gram").alias("phrase"), "words", "a", F.least(*options).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def collocations(df: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language. inside: the percent of its occurrences from which a phrase counts as part of a longer one."""
    held = cut(pieces(df, text_col, lang_col), "pieces")
    n = held.groupBy("lang").agg(F.sum(F.col("words") * F.col("m")).alias("n"))
    frequent = frequent_runs(held, least)
    longer = frequent.where("words > 2").withColumn("w", F.split("gram", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda first: F.array_join(F.slice("w", first, size), " "))))
    around = longer.select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    free = scored(frequent).join(around, ["lang", "phrase"], "left").where(F.coalesce(F.expr(f"cast(around as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(inside)}"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = free.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_PIECES = "regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')"
ORACLE_SQL = f"""
with p as (select coalesce(lang, 'und') as lang, unnest({_PIECES}) as piece from documents),
w as materialized (select lang, count(*) as m, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p group by lang, piece),
n as (select lang, sum(m * len(w))::bigint as n from w group by lang),
g as (select lang, m, unnest(flatten(list_transform(range(1, {LONGEST + 1}), lambda size: list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))))) as gram from w),
f as materialized (select lang, gram, len(string_split(gram, ' ')) as words, sum(m)::bigint as f from g group by lang, gram having sum(m) >= {LEAST}),
c as materialized (select lang, gram, words, f, string_split(gram, ' ') as w from f where words > 1),
k as (select lang, gram, words, f, w, unnest(range(1, words)) as k from c),
s as (select k.lang, k.gram, k.k, k.f as a, l.f as l, r.f as r, ((2000000::hugeint * k.f) // (l.f::hugeint + r.f))::bigint as score
  from k join f l on l.lang = k.lang and l.gram = array_to_string(w[1:k], ' ') join f r on r.lang = k.lang and r.gram = array_to_string(w[k + 1:], ' ')),
best as (select lang, gram, min_by(struct_pack(a := a, l := l, r := r, score := score), (score, k)) as b from s group by lang, gram),
i as (select lang, f, unnest(flatten(list_transform(range(2, words), lambda size: list_transform(range(1, words - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))))) as gram from c where words > 2),
around as (select lang, gram, max(f) as around from i group by lang, gram),
free as (select best.lang, best.gram as phrase, b.a as a, b.l as l, b.r as r, b.score as score from best left join around using (lang, gram) where around is null or 100 * around::hugeint < {INSIDE} * b.a::hugeint),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from free)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= {TOP}
"""
