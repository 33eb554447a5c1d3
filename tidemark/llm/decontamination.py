"""Benchmark decontamination by a prefix-filtered set join. DataFrame functions alone.

A document contains a window of an item only if it contains every shingle of it, so one shingle of three words is a
sufficient prefix: the window's rarest in the corpus (a window of fewer words is one shingle). Document shingles join the
windows on that shingle alone; its place gives the one place where the window could start (positional bound), which has to
leave room for the whole window (length bound); the words there are then compared with the window's (exact containment).
Shingles travel as a hash and a place; the words of a text are looked at again only for texts with candidates.

Results: null texts have no words and are never hit; items without words have no windows; an item of fewer words than a
window is one window. Repeated items count once per item_id in n_items; items with a null id hit words, but are not in the
list of items. Every document row gives one row and is hit by its own text alone, whatever its id, null or repeated. Empty
tables give no rows or no hits. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import IDS, ascii_lower, saved, small

#: Words: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle.
SHINGLE = 3
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The lower-cased words of a text; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def item_windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """win (array of words), items (array of ids): each distinct window and the items that have it."""
    w = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def _hashes(w: Column, n: int) -> Column:
    """The hashes of the runs of n words of an array."""
    one = F.transform(w, lambda x: F.xxhash64(x))
    if n == 1:
        return one
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))
    # as a list of one, so that the words are hashed once; a text of fewer words has none
    return F.when(F.size(w) >= n, F.flatten(F.transform(F.array(one), each))).otherwise(F.array().cast("array<long>"))


def _shingles(df: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """keep, at, gram: the shingles of the words w of each row, of each of the lengths."""
    parts = [df.where(F.size("w") >= n).select(*keep, F.posexplode(_hashes(F.col("w"), n)).alias("at", "gram")) for n in lengths]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _key(text: str) -> Column:
    """Tells texts apart."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), F.col(text)).alias("b"))


def occurrences(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """key (of a document's text), lo, hi (word range, from 0), items: where the items' windows occur in the documents' texts."""
    windows = item_windows(items, item_id, item_text, n).withColumn("m", F.least(F.size("win"), F.lit(SHINGLE)))
    windows = saved(windows.withColumn("id", F.monotonically_increasing_id()), "windows")
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most SHINGLE of them
    if not lengths:
        return docs.select(_key(text).alias("key"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.array().cast(windows.schema["items"].dataType).alias("items")).limit(0)
    inside = saved(_by_length(windows, lengths), "shingles")
    split = docs.where(F.col(text).isNotNull()).select(_key(text).alias("key"), words(F.col(text)).alias("w"))
    found = _shingles(split, lengths).select("gram").join(small(saved(inside.select("gram").distinct(), "grams")), "gram", "left_semi").groupBy("gram").count()

    # the rarest shingle of each window that has none foreign to the corpus
    order = Window.partitionBy("id").orderBy("count", "gram", "at")
    known = inside.join(small(saved(found, "rarity")), "gram")
    known = known.withColumn("all", F.count("*").over(Window.partitionBy("id"))).withColumn("k", F.row_number().over(order)).where("k = 1")
    full = windows.select("id", "win", "items", (F.size("win") - F.col("m") + 1).alias("shingles"))
    prefix = saved(known.join(full, "id").where("all = shingles").select("gram", "at", "id", F.size("win").alias("size"), "win", "items"), "prefixes")

    # one row for each (document shingle, window with it as prefix); the words come later
    places = _shingles(split.withColumn("n", F.size("w")), lengths, "key", "n").withColumnRenamed("at", "pos")
    at = places.join(small(prefix.select("gram", "at", "id", "size")), "gram").withColumn("lo", F.col("pos") - F.col("at"))
    likely = saved(at.where("lo >= 0 and lo + size <= n").select("key", "lo", "id").distinct(), "candidates")
    by_text = likely.join(small(prefix.select("id", "win", "items")), "id").groupBy("key").agg(F.collect_list(F.struct("lo", "win", "items")).alias("tries"))
    some = split.join(small(saved(likely.select("key").distinct(), "hit"), IDS), "key", "left_semi").dropDuplicates(["key"])
    real = F.filter("tries", lambda x: F.slice("w", x["lo"] + 1, F.size(x["win"])) == x["win"])
    hits = some.join(by_text, "key").select("key", F.explode(F.transform(real, lambda x: F.struct(x["lo"].alias("lo"), (x["lo"] + F.size(x["win"])).alias("hi"), x["items"].alias("items")))).alias("x"))
    return hits.select("key", "x.*")


def _by_length(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """id, at, gram: the shingles of each window, of the window's own length."""
    parts = [_shingles(windows.withColumnRenamed("win", "w").where(F.col("m") == n), [n], "id") for n in lengths]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def covered(ranges: DataFrame) -> DataFrame:
    """key, n_hit: the number of places in the union of each key's ranges (key, lo, hi)."""
    before = Window.partitionBy("key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = ranges.withColumn("reach", F.coalesce(F.max("hi").over(before), F.col("lo")))
    return reach.groupBy("key").agg(F.sum(F.greatest(F.col("hi") - F.greatest("lo", "reach"), F.lit(0))).cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """The columns of `keep`, n_words, n_hit, items (sorted array of item ids as strings), contaminated for each row of docs."""
    hits = saved(occurrences(docs, items, text, item_id, item_text, n), "hits")
    of_text = hits.select("key", F.explode("items").alias("item")).where("item is not null").groupBy("key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    total = saved(covered(hits.select("key", "lo", "hi").distinct()).join(of_text, "key", "left").select(F.col("key").alias("__key"), F.col("n_hit").alias("__hit"), F.col("items").alias("__items")), "totals")
    rows = docs.select(*keep, _key(text).alias("__key"), F.size(words(F.col(text))).cast("long").alias("__words"))
    hit = F.coalesce("__hit", F.lit(0)).cast("long")
    out = rows.join(small(total), "__key", "left")
    return out.select(*keep, F.col("__words").alias("n_words"), hit.alias("n_hit"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))
