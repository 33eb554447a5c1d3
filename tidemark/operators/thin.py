"""Thinning a history: a row is kept if enough time has passed since the last kept one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import micros
from tidemark.session import kept


def first_at_or_after(df: DataFrame, keys: list[str], ts: str, row_id: str, later_s: float, unit_s: int = 86_400) -> DataFrame:
    """keys, row_id, next_id: of each row the first row of its entity that is at least later_s after it (null: none); rows of one instant in the order of row_id.

    Rows and the instants looked for meet in blocks of time; a block without an answer takes the first row of the next one
    that has rows, which is a look over one row a block.
    """
    at = micros(ts)
    points = df.select(*keys, at.alias("__at"), F.lit(1).alias("__side"), F.col(row_id).alias("__id"))
    asked = df.select(*keys, (at + int(later_s * 1e6)).alias("__at"), F.lit(0).alias("__side"), F.col(row_id).alias("__id"))
    both = points.union(asked).withColumn("__block", F.floor(F.col("__at") / (unit_s * 1_000_000)))
    own = F.when(F.col("__side") == 1, F.col("__id"))
    ahead = Window.partitionBy(*keys, "__block").orderBy("__at", "__side", "__id").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("__found", F.first(own, ignorenulls=True).over(ahead)).where("__side = 0")
    first = both.groupBy(*keys, "__block").agg(F.min(F.when(F.col("__side") == 1, F.struct("__at", "__id"))).alias("__f"))
    later = Window.partitionBy(*keys).orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    nexts = first.withColumn("__later", F.first("__f", ignorenulls=True).over(later)).drop("__f")
    return found.join(nexts, [*keys, "__block"]).select(*keys, F.col("__id").alias(row_id), F.coalesce("__found", "__later.__id").alias("next_id"))


def thinned(df: DataFrame, keys: list[str], ts: str, row_id: str, least_s: float) -> DataFrame:
    """df's rows that stay if each has to be at least least_s after the last one kept, over whole histories. row_id: unique for an entity.

    Each row's successor, were it kept, is a lookup; the chain of an entity's first row is marked by doubling: after k steps
    of composing the successors with themselves there are those 2^k on, and going down again every row of the chain is
    reached. The steps are the logarithm of the longest chain.
    """
    if least_s <= 0:
        return df
    steps = [kept(first_at_or_after(df, keys, ts, row_id, least_s).where("next_id is not null"), "thin")]
    while True:
        a, b = steps[-1], steps[-1].select(*keys, F.col(row_id).alias("__own"), F.col("next_id").alias("__two")).withColumnRenamed("__own", "next_id")
        twice = kept(a.join(b, [*keys, "next_id"]).select(*keys, row_id, F.col("__two").alias("next_id")), "thin")
        if twice.isEmpty():
            break
        steps.append(twice)
    chain = df.groupBy(*keys).agg(F.min_by(row_id, F.struct(micros(ts), F.col(row_id))).alias(row_id))
    for step in reversed(steps):
        chain = kept(chain.union(chain.join(step, [*keys, row_id]).select(*keys, F.col("next_id").alias(row_id))), "thin")
    return df.join(chain, [*keys, row_id], "left_semi")
