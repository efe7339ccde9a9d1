"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of text that one step of a Python operator holds as Python strings.
SLICE_BYTES = 1 << 21


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each part has about `limit` bytes in `column`, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def release() -> None:
    """Give memory that the worker no longer uses back to the machine: Arrow's pool and malloc keep it else, beside the JVM's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what a batch left behind is given back before the next one is asked for."""
    for batch in batches:
        yield batch
        del batch
        release()


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow in slices. make() runs once a task and returns the function from a slice to its output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = batch = part = None
        for batch in released(batches):
            for part in text_slices(batch, column, limit):
                step = step or make()
                yield pa.RecordBatch.from_pydict(step(part), schema=arrow)
        del batch, part
        release()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ':'; the same in any SQL engine that has md5."""
    joined = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def salted_join(rows: DataFrame, told: DataFrame, key: str, counts: DataFrame | None = None, hot: int = 256, parts: int = 512) -> DataFrame:
    """rows joined (inner) to told by key, where many rows may have one key.

    Keys of more than max(hot, rows / 100000) rows, of which there are at most 100000, are counted, and broadcast with a number of
    parts; their rows meet copies of told in that many parts. told may have several rows for a key. rows must be stable. counts: rows_of_key by
    key, where they are known.
    """
    if counts is None:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows_of_key"))
        total = rows.agg(F.count(F.lit(1))).first()[0]
    else:
        total = counts.agg(F.sum("rows_of_key")).first()[0] or 0
    limit = max(hot, total // 100_000)
    heavy = [(r[0], min(parts, -(-r[1] // limit) + 1)) for r in counts.where(F.col("rows_of_key") > limit).select(key, "rows_of_key").collect()]
    if not heavy:
        return rows.join(told, key)
    kind = dict(rows.dtypes)[key]
    spread = F.broadcast(rows.sparkSession.createDataFrame(heavy, f"`{key}` {kind}, parts_of_key int"))
    one = F.coalesce("parts_of_key", F.lit(1))
    dealt = rows.join(spread, key, "left").withColumn("part_of_key", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), one).cast("int")).drop("parts_of_key")
    copies = told.join(spread, key, "left").withColumn("part_of_key", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts_of_key")
    return dealt.join(copies, [key, "part_of_key"]).drop("part_of_key")


def packed(df: DataFrame, columns: list[str] | None = None, name: str = "row") -> Column:
    """Columns of df (all unless named) as one struct, so that no name of theirs meets one of an operator; null without any."""
    names = df.columns if columns is None else columns
    return (F.struct(*[df[quoted(c)].alias(c) for c in names]) if names else F.lit(None).cast("int")).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "row", **replaced: Column) -> list[Column]:
    """The columns that packed() packed, in order; those in replaced from there."""
    return [replaced.get(c, F.col(name).getField(c)).alias(c) for c in columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
