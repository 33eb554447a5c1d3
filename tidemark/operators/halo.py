"""Windows over long histories, dealt by entity and block of time: an entity of any length is spread over tasks.

Each block gets copies of the rows before it that a frame may still reach into, its halo, so that window functions
partitioned by entity and block give what they would give over the whole history. What runs on over blocks (numbers of
episodes) is added up in two levels: inside of blocks, then over one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros

BLOCK, HALO = "__block", "__halo"


def blocks(df: DataFrame, ts: str, unit: str = "day") -> DataFrame:
    return df.withColumn(BLOCK, F.date_trunc(unit, F.col(ts)))


def with_rows_before(df: DataFrame, keys: list[str], ts: str, tie: str, rows: int, unit: str = "day") -> DataFrame:
    """df by block, each with the entity's last `rows` rows before it as its halo, from however many blocks they come.

    A row's place is the number of rows before it. Only the last rows of a block can be anybody's halo; one at place p is in
    that of the blocks that begin at p + 1 to p + rows, which are found by an equi-join.
    """
    own = blocks(df, ts, unit)
    last = Window.partitionBy(*keys, BLOCK).orderBy(F.desc(ts), F.desc(tie))
    tails = own.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= rows)
    count = own.groupBy(*keys, BLOCK).agg(F.count("*").alias("__n"))
    start = F.sum("__n").over(Window.partitionBy(*keys).orderBy(BLOCK)) - F.col("__n")  # one row a block
    begins = count.withColumn("__start", start)
    own_place = F.col("__start") + F.col("__n") - F.col("__r")
    placed = tails.join(begins, [*keys, BLOCK]).withColumn("__at", F.explode(F.sequence(own_place + 1, own_place + rows)))
    after = begins.select(*keys, F.col("__start").alias("__at"), F.col(BLOCK).alias("__to"))
    copies = placed.join(after, [*keys, "__at"]).withColumn(BLOCK, F.col("__to")).select(*own.columns)
    return own.withColumn(HALO, F.lit(False)).unionByName(copies.withColumn(HALO, F.lit(True)))


def with_span_before(df: DataFrame, ts: str, span_s: float, unit: str = "day") -> DataFrame:
    """df by block, each with the rows of the last span_s seconds before it as its halo."""
    end = F.date_trunc(unit, F.timestamp_micros(micros(ts) + int(span_s * 1e6)))
    first = F.date_trunc(unit, F.col(ts)).cast("timestamp")
    each = df.withColumn("__b", F.explode(F.sequence(first, end.cast("timestamp"), F.expr(f"interval 1 {unit}"))))
    return each.withColumn(HALO, F.col("__b") != first).withColumn(BLOCK, F.col("__b")).drop("__b")


def inside(df: DataFrame) -> DataFrame:
    """The blocks' own rows."""
    return df.where(~F.col(HALO)).drop(HALO)


def numbered(marked: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """marked (blocks, with __new: 1 where a run begins) with the running number of each row's run, added up over blocks."""
    own = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    new = marked.groupBy(*keys, BLOCK).agg(F.sum("__new").alias("__sum"))
    before = new.withColumn("__sum", F.sum("__sum").over(Window.partitionBy(*keys).orderBy(BLOCK)) - F.col("__sum"))
    out = marked.withColumn("__run", F.sum("__new").over(own)).join(before, [*keys, BLOCK])
    return out.withColumn(name, F.col("__run") + F.col("__sum")).drop("__new", "__run", "__sum", BLOCK)


def sessionized(df: DataFrame, keys: list[str], ts: str, tie: str, gap_s: float, name: str = "episode", unit: str = "day") -> DataFrame:
    """df with the running number of its episode, as series.sessionize gives it, without a whole history in one task."""
    away = micros(ts) - F.lag(micros(ts)).over(Window.partitionBy(*keys, BLOCK).orderBy(ts, tie))
    new = F.coalesce(away > int(gap_s * 1e6), F.lit(False)).cast("long")
    return numbered(inside(with_rows_before(df, keys, ts, tie, 1, unit).withColumn("__new", new)), keys, [ts, tie], name)


def islands(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, name: str = "island", unit: str = "day") -> DataFrame:
    """df with the running number of its run of equal values (null is a value); keys must not be null."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*keys, BLOCK).orderBy(ts, tie))
    new = (~F.struct(value).eqNullSafe(before)).cast("long")
    return numbered(inside(with_rows_before(df, keys, ts, tie, 1, unit).withColumn("__new", new)), keys, [ts, tie], name)


def most_in_span(df: DataFrame, keys: list[str], ts: str, span_s: float, count: Column | None = None, unit: str = "day") -> DataFrame:
    """df's keys and most: the largest number of rows within span_s, both ends included."""
    w = Window.partitionBy(*keys, BLOCK).orderBy("__us").rangeBetween(-int(span_s * 1e6), 0)
    n = F.count("*" if count is None else F.when(count, 1)).over(w)
    return inside(with_span_before(df, ts, span_s, unit).withColumn("__us", micros(ts)).withColumn("__n", n)).groupBy(*keys).agg(F.max("__n").alias("most"))
