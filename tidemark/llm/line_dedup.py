"""Line dedup by a suffix array over line-id sequences, built by distributed prefix doubling.

The corpus is a sequence of line ids for each document. Suffixes are ranked by their first line, then, doubling, by their
first two, four, ... lines: the rank by 2k lines is the rank of the pair (rank by k, rank k lines further on). Ranks are
given by a distributed sort of the distinct pairs, so equal ranks mean equal prefixes and the order of ranks is that of
the suffix array. Suffixes that are alone with their prefix, or whose document ends, are settled and leave; the doubling goes
on until all have left.

An interval of equal ranks at depth d is an interval of the array with longest common prefix of d or more. Each interval
keeps its first suffix in text order; the deepest interval in which a suffix has an earlier one gives the suffix's source
and a length that it shares with it. Suffixes that follow each other in their document, and whose sources do, are one run:
the maximal repeated line runs, of which the later copies are deleted.

A repeated run counts if it has `lines` lines or a line of `long_line` characters. Order of copies: by id, then place.

Results: the first copy of a run stays and all later ones go, inside a document as well. Null texts stay null and empty
ones empty. Rows with a null id are left alone. Rows that share an id and a text are the same lines (each row is cut the
same way, and they don't count as copies of each other); rows that share an id with other texts are told apart by a digest
of the text. An empty table gives no rows. Other columns do not matter; those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import IDS, released, saved, small


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(x: Column) -> Column:
    """128 bits of a line."""
    return F.unhex(F.md5(x.cast("binary")))


PLACE = ("doc", "at", "tag")


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """by, rank, first: the keys that several rows share, with a rank, larger for larger keys, and the first place of each.

    A range-partitioned sort of keys that were counted where they are read; no task sees all.
    """
    keys = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1").drop("n")
    order = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    return saved(order.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """doc, tag, at, rank, first, long: the lines that occur more than once."""
    return saved(lines.join(ranked(lines, "key"), "key").select("doc", "tag", "at", "rank", "first", "long"), "deeper")


def _deeper(now: DataFrame, step: int) -> DataFrame:
    """Ranks by more lines: doc, tag, at, rank, first of the suffixes that are not alone; `step`: how many lines further the second rank is."""
    second = now.select("doc", "tag", (F.col("at") - step).alias("at"), F.col("rank").alias("then"))
    pairs = saved(now.select("doc", "tag", "at", F.col("rank").alias("one")).join(second, ["doc", "tag", "at"]), "pairs")
    # written as it is joined, so that frequent ranks can be split
    out = saved(pairs.join(ranked(pairs, "one", "then"), ["one", "then"]).select("doc", "tag", "at", "rank", "first"), "deeper")
    released(pairs)
    return out


def _later(ranks: DataFrame, depth: int) -> DataFrame:
    """doc, tag, at, source, depth: the suffixes that have an earlier one with `depth` equal lines, and the first such one."""
    return ranks.where(F.struct(*PLACE) > F.col("first")).select("doc", "tag", "at", F.col("first").alias("source"), F.lit(depth).alias("depth"))


def repeated_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = 2, long_line: int = 100) -> DataFrame:
    """doc, tag, lo, hi, source: the later copies of maximal repeated line runs (line numbers from 0, hi exclusive), and where in the text order their first copy begins (doc, at, tag)."""
    known = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    rows = known.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    rows = _once(rows)
    each = rows.select("doc", "tag", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    each = saved(each.select("doc", "tag", "at", _digest(F.col("line")).alias("key"), (F.char_length("line") >= long_line).alias("long")), "lines")
    now, depth = _first_ranks(each), 1
    released(each)
    found = [saved(_later(now.where("long"), 1), "later")]
    while now.limit(1).count():
        if depth >= lines:
            found.append(saved(_later(now, depth), "later"))
        step = min(depth, lines - depth) if depth < lines else depth
        now, before, depth = _deeper(now, step), now, depth + step
        released(before)
    later = found[0]
    for part in found[1:]:
        later = later.union(part)
    deepest = later.groupBy("doc", "tag", "at").agg(F.max(F.struct("depth", "source")).alias("x")).select("doc", "tag", "at", "x.depth", "x.source")
    # neighbours on one diagonal are one run
    w = Window.partitionBy("doc", "tag").orderBy("at")
    same = (F.lag("at").over(w) == F.col("at") - 1) & (F.lag("source.doc").over(w) == F.col("source.doc")) & (F.lag("source.tag").over(w) == F.col("source.tag")) & (F.lag("source.at").over(w) == F.col("source.at") - 1)
    runs = deepest.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "tag", "run").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("depth")).alias("hi"), F.min_by("source", "at").alias("source")).drop("run")


def _once(rows: DataFrame) -> DataFrame:
    """rows (doc, tag, text) without repeated ones. Only those that are repeated, as a rule none, are shuffled."""
    twice = small(saved(rows.groupBy("doc", "tag").agg(F.count("*").alias("n")).where("n > 1").select("doc", "tag"), "twice"), IDS)
    return rows.join(twice, ["doc", "tag"], "left_anti").union(rows.join(twice, ["doc", "tag"], "left_semi").groupBy("doc", "tag").agg(F.any_value("text").alias("text")))


def repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = 2, long_line: int = 100) -> DataFrame:
    """doc, tag, gone (sorted array of line numbers, from 0): the lines to delete."""
    runs = repeated_runs(df, doc_id, text, lines, long_line)
    return runs.select("doc", "tag", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("at")).groupBy("doc", "tag").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: int = 2, long_line: int = 100) -> DataFrame:
    """df with the later copies of repeated line runs cut out of its text, and n_lines, n_removed. Ids are whole numbers; others are refused."""
    if dict(df.dtypes)[doc_id] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{doc_id} has to be a whole number, not {dict(df.dtypes)[doc_id]}")
    gone = repeated_lines(df, doc_id, text, lines, long_line).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("gone").alias("__gone"))
    out = df.join(gone, (F.col(doc_id).cast("long") == F.col("__doc")) & (F.xxhash64(F.col(text)) == F.col("__tag")), "left")
    # the lines as a column: inside the lambda the text would be split for each line
    out = out.withColumn("__lines", _lines(F.col(text)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")  # noqa: E731  the size of null depends on the session's mode
    columns = {
        "n_lines": size("__lines"),
        "n_removed": size("__gone"),
        text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept),
    }
    return out.withColumns(columns).drop("__doc", "__tag", "__gone", "__lines")
