"""Mixing sources to target weights. DataFrame functions alone.

The words of each source are laid end to end and packed into blocks of a fixed length. The mix is a row of output shards of
equally many slots. Each slot draws a source by the target shares, from a keyed generator, so a shard's source counts are
multinomial draws. Drawn totals differ a little from the targets (by the root of the number of slots); the surplus of some
sources is handed over to the others, evenly along the shards, so the counts are those draws conditioned on the totals. A
shard's slots of a source are numbered on from the shard before, and a keyed pseudorandom permutation of the source's blocks
says which block a number takes, epoch after epoch. Slots and blocks then join by (source, block).

The permutation is a swap-or-not shuffle: in each round a number and its mirror image about a secret point swap or not, by
a bit of a digest. It needs neither tables nor sorting, and reruns give the same rows.

Running sums over documents or shards are taken in two levels, inside groups of about the root of their number and over the
groups, so no task sees all of a source.

Results: every row gives one row; a null source is a source of its own and comes last; null and wordless texts have size 0
and taken 0. Rows of a source are laid in the order of (a hash class of) id and size, so repeated and null ids are safe. Blocks
are used at most twice, so no document exceeds twice its size. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, saved, small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
ROUNDS = 16


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def _number(digest: Column, digits: int) -> Column:
    """The first hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def points(key: Column) -> Column:
    """The secret points of a permutation."""
    return F.array(*(_number(_digest(key, F.lit(i), F.lit("point")), 12) for i in range(ROUNDS)))


def shuffled(number: Column, size: Column, key: Column, at: Column) -> Column:
    """The place of `number` in a keyed permutation of the numbers below `size`; at: the key's points."""
    keyed = F.transform(at, lambda p, i: F.struct(i.cast("string").alias("i"), p.alias("point")))

    def swap(x: Column, r: Column) -> Column:
        mirror = F.array(F.pmod(r["point"] - x, size))  # a list of one, to name what is used twice
        bit = lambda m: F.substring(_digest(key, r["i"], F.greatest(m, x)), 1, 1)
        return F.element_at(F.transform(mirror, lambda m: F.when(bit(m) < "8", m).otherwise(x)), 1)

    return F.aggregate(keyed, number, swap)


def numbered(df: DataFrame, doc_id: str, text: str, source: str, keep_text: bool = False) -> DataFrame:
    """row, doc_id, source, size (words) for each row, and its text if that is kept; a saved table."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    kept = [F.col(text).alias("text")] if keep_text else []
    return saved(df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size, *kept), "sizes")


def _running(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of equal keys that come before; order: a number that tells rows of a key apart, of which `width` make a group."""
    grouped = df.withColumn("__group", F.floor(F.col(order) / width))
    sums = grouped.groupBy(*keys, "__group").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__group", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = grouped.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.join(sums, [*keys, "__group"]).withColumn(name, (F.col("__base") + F.col("__inside")).cast("long")).drop("__group", "__base", "__inside")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, rank, target: shares by weight of `share` times all words, none above `most` times its source.

    The level is the water-filling one: sources whose limit is below level * weight get their limit, the others level * weight.
    One row for each source, so the ordering windows see as many rows as there are sources.
    """
    every = Window.partitionBy()
    by = F.when(F.col("source").isNull(), 1).otherwise(0)
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(by, "source")))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double"))
    s = s.withColumn("limit", (F.col("source_size") * most).cast("double")).withColumn("fill", F.col("limit") / F.col("weight"))
    up = Window.orderBy("fill", "rank")
    s = s.withColumn("below", F.coalesce(F.sum("limit").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(every) * share - F.col("below")) / F.col("left"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every))
    return s.select("source", "source_size", "rank", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def slot_totals(aims: DataFrame, block: int) -> DataFrame:
    """rank, blocks, slots, begin, end of each source in the row of all slots; a saved table with a row for each source."""
    every = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    s = aims.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    # a block holds source_size / blocks words on average; rounded to whole blocks, and never more than the epochs allowed
    s = s.withColumn("slots", F.when(F.col("blocks") > 0, F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5), F.col("blocks") * MOST)).otherwise(0).cast("long"))
    s = s.withColumn("end", F.sum("slots").over(every)).withColumn("begin", F.col("end") - F.col("slots"))
    return saved(s.select("rank", "blocks", "slots", "begin", "end"), "sources")


def drawn(sources: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, rank, n: how many slots of each shard draw each source.

    A slot's number in [0, 1) falls into one source's share. Shares are looked up by the cell of an even grid, a few sources
    to a cell.
    """
    cells = 4 * max(1, sources.count())
    lo, hi = F.col("begin").cast("double") / total, F.col("end").cast("double") / total
    grid = sources.where("slots > 0").select("rank", lo.alias("lo"), hi.alias("hi"))
    grid = grid.select("*", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    slots = sources.sparkSession.range(0, total, 1, max(1, min(10_000, total // 100_000)))
    u = _number(_digest(F.lit(f"{seed}:draw"), F.col("id")), 12) / float(1 << 48)
    slots = slots.select(F.floor(F.col("id") / shard_slots).cast("long").alias("shard"), u.alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    met = slots.join(small(saved(grid, "grid")), "cell").where("u >= lo and u < hi")
    return met.groupBy("shard", "rank").agg(F.count("*").alias("n"))


def shard_counts(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """shard, rank, n, first: how many slots of each shard take each source, and the number of the first of them in the source. Totals are those of `sources`."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    draws = saved(drawn(sources, total, shard_slots, seed), "draws")
    width = max(1, ceil(sqrt(total / shard_slots)))
    got = draws.groupBy("rank").agg(F.sum("n").alias("got"))
    off = sources.join(got, "rank", "left").select("rank", F.coalesce("got", F.lit(0)).alias("got"), (F.coalesce("got", F.lit(0)) - F.col("slots")).alias("over"))
    off = saved(off, "off")
    # sources above their total give slots up, evenly along the shards
    above = _running(draws.join(small(off.where("over > 0")), "rank"), ["rank"], "shard", "n", width, "before")
    share = lambda x: F.expr(f"cast(cast({x} as decimal(20, 0)) * cast(over as decimal(18, 0)) div cast(got as decimal(20, 0)) as bigint)")
    given = saved(above.select("shard", "rank", (share("before + n") - share("before")).alias("given")).where("given > 0"), "given")
    # which the others take, in the order of their ranks
    freed = _running(given.groupBy("shard").agg(F.sum("given").alias("f")), [], "shard", "f", width, "at")
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    below = off.where("over < 0").select("rank", F.sum(-F.col("over")).over(upto).alias("to"), (-F.col("over")).alias("m")).withColumn("from", F.col("to") - F.col("m"))
    moved = given.agg(F.coalesce(F.sum("given"), F.lit(0)).alias("n")).first()["n"]
    cell = max(1, -(-moved // (4 * max(1, sources.count()))))
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((b - 1) / cell))).alias("cell")
    needs = below.select("rank", "from", "to", spread(F.col("from"), F.col("to")))
    gaps = freed.select("shard", "at", (F.col("at") + F.col("f")).alias("end"), spread(F.col("at"), F.col("at") + F.col("f")))
    met = F.least("to", "end", (F.col("cell") + 1) * cell) - F.greatest("from", "at", F.col("cell") * cell)
    taken = gaps.join(small(saved(needs, "needs")), "cell").select("shard", "rank", met.alias("n")).where("n > 0")
    every = draws.select("shard", "rank", "n").union(given.select("shard", "rank", -F.col("given"))).union(taken)
    counts = saved(every.groupBy("shard", "rank").agg(F.sum("n").cast("long").alias("n")).where("n > 0"), "counts")
    return _running(counts, ["rank"], "shard", "n", width, "first")


def plan(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """shard, slot, rank, block: which block of which source each slot of the mix takes; a saved table."""
    counts = shard_counts(sources, shard_slots, seed)
    inside = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("slot", F.col("shard") * shard_slots + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    slots = counts.select("shard", "rank", "slot", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    key = lambda epoch: F.concat_ws(":", F.lit(str(seed)), F.col("rank").cast("string"), epoch.cast("string"))
    secrets = sources.where("slots > 0").select("rank", "blocks", F.array(*(points(key(F.lit(e))) for e in range(MOST))).alias("points"))
    dealt = slots.join(small(saved(secrets, "points")), "rank").withColumn("k", F.col("first") + F.col("i"))
    epoch = F.floor(F.col("k") / F.col("blocks"))
    block = shuffled(F.pmod("k", F.col("blocks")), F.col("blocks"), key(epoch), F.get("points", epoch.cast("int")))
    # written, as it is used twice and its digests are costly
    return saved(dealt.select("shard", (F.col("slot") + F.col("i")).alias("slot"), "rank", block.alias("block")), "plan")


def laid(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """row, doc_id, size, rank, source_size, target, begin: where each document begins in its source.

    Groups of about the root of the number of documents, by a hash, are summed first, so a hot source is laid by many tasks.
    """
    groups = max(1, ceil(sqrt(sized.count())))
    source = aims.select(F.col("source").alias("__source"), "source_size", "rank", "target")
    rows = sized.select("row", "doc_id", "source", "size").join(small(source), F.col("source").eqNullSafe(F.col("__source")))
    spread = _number(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))), 8)
    rows = rows.withColumn("group", spread % groups)
    sums = rows.groupBy("rank", "group").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("rank").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("rank", "group").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums, ["rank", "group"]).select("row", "doc_id", "size", "rank", "source_size", "target", (F.col("base") + F.col("inside")).alias("begin"))


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """placed (with begin, size, rank) by block: block, lo, hi (words of the document, from 0) for each block it reaches into."""
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    each = placed.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block - F.col("begin"), F.col("size"))
    return each.withColumns({"lo": lo, "hi": hi})


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = 128, shard_slots: int = 4096, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words that the mix takes of it) for each row of df."""
    sized = numbered(df, doc_id, text, source)
    aims = saved(targets(sized), "targets")
    slots = plan(slot_totals(aims, block), shard_slots, seed).groupBy("rank", "block").agg(F.count("*").alias("times"))
    placed = saved(laid(sized, aims), "placed")
    taken = pieces(placed, block).select("row", "rank", "block", (F.col("hi") - F.col("lo")).alias("n")).join(slots, ["rank", "block"])
    taken = taken.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    out = placed.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_text(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = 128, shard_slots: int = 4096, seed: int = 1) -> DataFrame:
    """doc_id, shard, slot, part, text: the mix itself, a row for each document that a slot's block reaches into; part: its order in the slot."""
    sized = numbered(df, doc_id, text, source, keep_text=True)
    aims = saved(targets(sized), "targets")
    cut = pieces(laid(sized, aims), block).join(plan(slot_totals(aims, block), shard_slots, seed), ["rank", "block"])
    number = (F.col("block") - F.floor(F.col("begin") / block)).cast("int").alias("number")
    takes = cut.groupBy("row").agg(F.first("begin").alias("begin"), F.collect_list(F.struct("shard", "slot", (F.col("begin") + F.col("lo")).alias("part"), number)).alias("takes"))
    rows = sized.select("row", "doc_id", "text").join(takes, "row")
    # a text is cut once, at its block borders; an explode of one row holds the pieces, so that they are not made again for each slot
    own = rows.select("doc_id", "takes", F.explode(F.array(_cut(F.col("text"), block - F.col("begin") % block, block))).alias("pieces"))
    piece = lambda p: F.struct(p["shard"].alias("shard"), p["slot"].alias("slot"), p["part"].alias("part"), F.get("pieces", p["number"]).alias("text"))
    return own.select("doc_id", F.explode(F.transform("takes", piece)).alias("p")).select("doc_id", "p.*")


def _cut(text: Column, first: Column, block: int) -> Column:
    """The words of a text, joined by one space, in a first piece of `first` words and further ones of `block`."""
    some = rf"(?:{WORD}+{SPACE}*+){{1,"
    head = F.call_function("regexp_extract", text, F.concat(F.lit(f"^{SPACE}*+{some}"), first.cast("string"), F.lit("}+")), F.lit(0))
    rest = F.substring(text, F.char_length(head) + 1, F.char_length(text))
    raw = F.concat(F.array(head), F.regexp_extract_all(rest, F.lit(f"{some}{block}}}+"), F.lit(0)))
    return F.transform(raw, lambda c: F.array_join(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), " "))
