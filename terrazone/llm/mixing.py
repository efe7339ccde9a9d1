"""Operator 4: mixing sources to target weights by Poisson replication.

Every source s has a target weight; a document of s is repeated Poisson(rate) times, where rate = total * weight /
(sum of weights * documents of s), so the expected mix has the target weights. The number is the inverse of
the Poisson distribution at a number in [0, 1) hashed from seed and document, so it depends on nothing else: any
run, partitioning or retry gives the same copies. Rates above 16 are split into equal parts with a number each
(sums of Poisson numbers are Poisson). Copies then get a hashed key, are dealt out by it and sorted by it.

Without given weights a source weighs its number of documents to the power alpha. The table of rates has a row for each
source; it is broadcast only while it has at most 4096 rows. Nothing is grouped by source but counts, so a source
with a third of all rows is no burden.

Defined cases: null sources are one source of their own; null or repeated ids hash the text instead of, or with, the id, so
equal rows have equal numbers of copies; null texts are carried; sources that given weights don't name get weight 0 and no
rows; copies of equal keys lie in any order; an empty table gives an empty result; other columns, whatever their names, are carried,
but for those named copy and copies, whose place the result's own take; nothing depends on a text's length but the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrazone.llm.common import packed, unit_hash, unpacked
from terrazone.session import cut

SEED, ALPHA = "mix-1", 0.7
#: Largest rate that is inverted at once, and the terms of its distribution; beyond them is less than 1e-25.
PART, TERMS = 16, 80
SMALL = 4096


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0 to TERMS - 1, as an array."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(TERMS - 1)), lambda k: F.exp(k * F.log(rate) - rate - F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, i: a + F.when(i > 0, F.log(i.cast("double"))).otherwise(F.lit(0.0)))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(terms, start, lambda a, p: F.struct((a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all")))["all"]


def rates(df: DataFrame, source_col: str, weights: dict[str, float] | None, alpha: float, total: float | None) -> DataFrame:
    """One row per source: name, parts, cdf of one part."""
    sizes = cut(df.groupBy(df[source_col].alias("name")).agg(F.count(F.lit(1)).alias("n")), "sources")  # a row a source
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        weighed = sizes.withColumn("w", F.coalesce(F.when(F.col("name").isNotNull(), F.try_element_at(given, F.col("name"))), F.lit(0.0)))
    sums = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    goal, mass = float(total if total is not None else sums.n or 0), float(sums.w or 0)
    rate = F.lit(goal) * F.col("w") / F.lit(mass or 1.0) / F.col("n")
    told = weighed.withColumn("rate", rate).where(F.col("rate") > 0)
    told = told.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    return told.select("name", "rate", "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias("cdf"))


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df, each as often as drawn, with copy (1 to copies) and copies, in globally shuffled order.

    total is the expected number of rows (default: as many as df has).
    """
    told = cut(rates(df, source_col, weights, alpha, total).withColumnRenamed("name", "rated"), "rates")
    if told.count() <= SMALL:
        told = F.broadcast(told)
    names = [c for c in df.columns if c.lower() not in ("copy", "copies")]
    rows = df.select(packed(df, names), df[source_col].alias("name"), F.concat_ws("/", df[id_col].cast("string"), F.when(df[id_col].isNull(), F.md5(df[text_col]))).alias("doc"))
    joined = rows.join(told, F.col("name").eqNullSafe(F.col("rated")))
    draw = lambda part: F.size(F.filter(F.col("cdf"), lambda c: c <= unit_hash(seed, F.col("doc"), part)))
    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, part: a + draw(part))
    copies = joined.select("row", "doc", count.cast("long").alias("copies")).where(F.col("copies") > 0)
    copies = copies.select("row", "doc", "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.col("doc"), F.col("copy").cast("string")))
    return copies.select("row", "copy", "copies", key.alias("key")).repartition("key").sortWithinPartitions("key").select(*unpacked(copies, names), "copy", "copies")


ORACLE_SQL = f"""
with sizes as (select source as name, count(*) as n from documents group by source),
weighed as (select name, n, pow(cast(n as double), {ALPHA}) as w from sizes),
sums as (select sum(n) as n, sum(w) as w from weighed),
rated as (select name, sums.n * weighed.w / sums.w / weighed.n as rate from weighed, sums),
parted as (select name, rate, greatest(1, cast(ceil(rate / {PART}) as int)) as parts from rated where rate > 0),
terms as (select name, rate, parts, k, exp(k * ln(rate / parts) - rate / parts - case when k = 0 then 0 else lgamma(k + 1) end) as p
  from parted, range({TERMS}) as r(k)),
cdf as (select name, parts, k, sum(p) over (partition by name order by k) as c from terms),
drawn as (select d.doc_id, d.source, j, cast(('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || j), 1, 13)) as bigint) / 4503599627370496e0 as u
  from documents d join parted p on d.source is not distinct from p.name, range(1, 100000) as r(j) where j <= p.parts),
counted as (select d.doc_id, d.source, count(*) as copies from drawn d join cdf on d.source is not distinct from cdf.name and cdf.c <= d.u group by all)
select doc_id, t.text, t.lang, source, t.n_chars, copy, copies
from (select *, unnest(range(1, copies + 1)) as copy from counted) c join documents t using (doc_id, source)
"""
