"""Substring dedup by super-k-mer partitioning.

Windows of k words are dealt out by their minimiser (the smallest hash of a run of m words inside the window). Consecutive
windows of a document that share a minimiser travel together, as one packed string, to the minimiser's bucket; in the
bucket the windows are sorted and compared exactly. Equal packed strings of a block travel once, with the list of their
places, so copies cost a few bytes each. What a bucket finds goes back to its documents as word ranges; texts are moved for
that only if they lose words.

Buckets hold BUCKET_BYTES of text on average. A minimiser of HOT windows or more (a frequent run of words), by the count of a
sample of the rows, is split: its windows go one by one to buckets by a hash of all their words, so equal windows still meet.
The sample decides about nothing but the way.

Results: a word is removed if a window that covers it also starts in a document with a smaller id. Null and empty texts
have no words. Rows with a null id keep all their words and remove none. Rows that share an id are one document for the
comparison (they never remove each other's words) and each gets its own row; texts of one id are told apart by 64-bit hashes.
Empty tables give no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import IDS, saved, small, text_bytes
from tidemark.llm.ragged import Words, chunks, gather, prefix_sums, range_hash, same_bytes

#: Bytes of text whose windows meet in one bucket, on average.
BUCKET_BYTES = 2 << 20
#: Windows of one minimiser that are split, and the share of rows (and bytes, at least) that are sampled to find them.
HOT, SAMPLE, SAMPLE_BYTES = 1 << 20, 0.01, 64 << 20
#: Packed bytes that a task holds before it sends them off.
BLOCK_BYTES = 16 << 20
_PACKED = "bucket int, texts binary, sizes binary, place binary, doc binary, tag binary, word binary"


def _zip(x) -> bytes:
    x = x.tobytes() if isinstance(x, np.ndarray) else x
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(x, asbytes=True)


def _unzip(x: bytes, kind=None):
    raw = pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) if x[:8] != bytes(8) else b""
    return raw if kind is None else np.frombuffer(raw, kind)


def minimisers(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of a run of m words inside the window of k words at each word, and whether there is such a window inside the text."""
    at, gram = w.grams(m)
    every = np.full(len(w.start), np.uint64(2**64 - 1))
    every[at] = gram
    n = len(w.start) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least = every[:n].copy()
    for j in range(1, k - m + 1):
        np.minimum(least, every[j : j + n], out=least)
    return least, w.text[:n] == w.text[k - 1 :]


def super_k_mers(w: Words, k: int, m: int, n_buckets: int, hot: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, and bucket of each run of windows with one minimiser; each window of a hot minimiser is a run of its own."""
    least, fits = minimisers(w, k, m)
    if not len(least):
        return (np.zeros(0, np.int64),) * 3
    alone = np.isin(least, hot) if len(hot) else np.zeros(len(least), bool)
    new = fits.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~fits[:-1] | alone[1:]
    head = np.flatnonzero(new)
    stop = fits.copy()
    stop[:-1] &= new[1:] | ~fits[1:]
    key = least[head]
    own = alone[head]
    key[own] = range_hash(sums, head[own], head[own] + k)
    return head, np.flatnonzero(stop) - head + 1, (key % np.uint64(n_buckets)).astype(np.int64)


def hot_minimisers(rows: DataFrame, size: int, k: int, m: int) -> np.ndarray:
    """Minimisers of about HOT windows or more; there are at most as many as the corpus has times HOT windows. rows: text, of `size` bytes."""
    share = min(1.0, max(SAMPLE, SAMPLE_BYTES / max(size, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (b" ".join(x.encode().split()) if x else b"" for x in (v.as_py() for v in b.column("text")))
            for part in chunks(range(len(b)), texts):
                part = [x for _, x in part if x]
                if part:
                    least, fits = minimisers(Words(part), k, m)
                    key, n = np.unique(least[fits], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counted = (rows if share == 1 else rows.sample(share, seed=5)).select("text").mapInArrow(run, "key long, n long")
    found = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT * share).select("key").toArrow()
    return found.column("key").to_numpy().astype(np.int64).view(np.uint64)


def _pack(k: int, m: int, n_buckets: int, hot: np.ndarray):
    def block(held: list) -> Iterator[pa.RecordBatch]:
        """One row for each bucket that the held super-k-mers go to; equal strings of the block are stored once."""
        data = np.concatenate([h[0] for h in held])
        base = np.cumsum([0, *(len(h[0]) for h in held)])[:-1]
        start = np.concatenate([h[1] + b for h, b in zip(held, base, strict=True)])
        size, key, bucket, doc, tag, word = (np.concatenate([h[i] for h in held]) for i in range(2, 8))
        order = np.lexsort((doc, size, key, bucket))
        start, size, key, bucket, doc, tag, word = (x[order] for x in (start, size, key, bucket, doc, tag, word))
        same = np.zeros(len(start), bool)
        same[1:] = (key[1:] == key[:-1]) & (size[1:] == size[:-1]) & (bucket[1:] == bucket[:-1])
        at = np.flatnonzero(same)
        same[at] = same_bytes(data, start[at], start[at - 1], size[at])
        head = np.flatnonzero(~same)
        which = np.cumsum(~same) - 1
        cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = []
        for lo, hi in zip(cut, cut[1:], strict=False):
            a, b = np.searchsorted(head, [lo, hi])
            rows.append((int(bucket[lo]), _zip(gather(data, start[head[a:b]], size[head[a:b]])), _zip(size[head[a:b]].astype(np.int32)), _zip((which[lo:hi] - which[lo]).astype(np.int32)), _zip(doc[lo:hi]), _zip(tag[lo:hi]), _zip(word[lo:hi].astype(np.int32))))
        kinds = (pa.int32(), *(pa.binary(),) * 6)
        names = [x.split()[0] for x in _PACKED.split(", ")]
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            texts = (b" ".join(x.encode().split()) if x else b"" for x in (v.as_py() for v in b.column("text")))
            keys = zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), strict=True)
            for part in chunks(keys, texts):
                part = [x for x in part if x[1]]
                if not part:
                    continue
                w = Words([x for _, x in part])
                sums = prefix_sums(w.hash)
                head, n, bucket = super_k_mers(w, k, m, n_buckets, hot, sums)
                lo, hi = w.start[head], w.end[head + n + k - 2]
                doc, tag = (np.array([key[i] for key, _ in part], np.int64) for i in (0, 1))
                of = w.text[head]
                data = gather(w.data, lo, hi - lo)
                ends = np.cumsum(hi - lo)
                held.append((data, ends - (hi - lo), hi - lo, range_hash(sums, head, head + n + k - 1), bucket, doc[of], tag[of], head - w.first[of]))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from block(held)
                    held, size = [], 0
        if held:
            yield from block(held)

    return run


def repeated_ranges(packed: list[dict], k: int) -> tuple[np.ndarray, ...]:
    """doc, tag, first word and end of the word ranges that a bucket's windows remove."""
    texts, size, place, doc, tag, word, n = [], [], [], [], [], [], 0
    for r in packed:
        s = _unzip(r["sizes"], np.int32).astype(np.int64)
        raw = _unzip(r["texts"])
        ends = np.cumsum(s)
        texts += [raw[e - z : e] for e, z in zip(ends.tolist(), s.tolist(), strict=True)]
        place.append(_unzip(r["place"], np.int32).astype(np.int64) + n)
        doc.append(_unzip(r["doc"], np.int64))
        tag.append(_unzip(r["tag"], np.int64))
        word.append(_unzip(r["word"], np.int32).astype(np.int64))
        n += len(s)
    place, doc, tag, word = (np.concatenate(x) for x in (place, doc, tag, word))
    w = Words(texts)
    del texts
    least, most = np.full(n, 2**63 - 1), np.full(n, -(2**63))
    order = np.lexsort((doc, place))
    at = np.flatnonzero(np.diff(place[order], prepend=-1))
    least[place[order][at]] = doc[order][at]
    last = np.append(at[1:], len(order)) - 1
    most[place[order][last]] = doc[order][last]

    first, key = w.grams(k)
    lo, length = w.start[first], w.end[first + k - 1] - w.start[first]
    smallest = _least_of_equal(w.data, key, lo, length, least[w.text[first]])
    # windows of which some place is to be removed, then their places
    hit = smallest < most[w.text[first]]
    first, smallest = first[hit], smallest[hit]
    if not len(first):
        return (np.zeros(0, np.int64),) * 4
    of = w.text[first]
    lo_of, hi_of = np.searchsorted(of, place), np.searchsorted(of, place, side="right")
    count = hi_of - lo_of
    occ = np.repeat(np.arange(len(place)), count)
    win = np.arange(len(occ)) - np.repeat(np.cumsum(count) - count, count) + lo_of[occ]
    gone = smallest[win] < doc[occ]
    occ, win = occ[gone], win[gone]
    begin = word[occ] + first[win] - w.first[of[win]]
    new = np.ones(len(occ), bool)
    new[1:] = (occ[1:] != occ[:-1]) | (begin[1:] != begin[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(occ)) - 1
    return doc[occ[head]], tag[occ[head]], begin[head], begin[tail] + k


def _least_of_equal(data, key, lo, length, value) -> np.ndarray:
    """For each window the smallest value of all windows with the same bytes. Sorted by hash, then compared byte by byte."""
    out, todo = value.copy(), np.arange(len(key))
    while len(todo):
        o = todo[np.lexsort((length[todo], key[todo]))]
        new = np.ones(len(o), bool)
        new[1:] = (key[o][1:] != key[o][:-1]) | (length[o][1:] != length[o][:-1])
        head = o[np.flatnonzero(new)][np.cumsum(new) - 1]
        check = np.flatnonzero(o != head)
        differ = np.zeros(len(o), bool)
        differ[check] = ~same_bytes(data, lo[o[check]], lo[head[check]], length[o[check]])
        good = ~differ
        group = (np.cumsum(new) - 1)[good]
        low = np.full(group[-1] + 1, 2**63 - 1)
        np.minimum.at(low, group, value[o[good]])
        out[o[good]] = low[group]
        todo = o[differ]  # other strings with the same hash: once more among themselves
    return out


def _tagged(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """df with doc (its id as a number) and tag, which tells apart texts that share an id: 0 where an id has one row, as a rule everywhere."""
    rows = df.withColumn("doc", F.col(doc_id).cast("long"))
    shared = saved(rows.where("doc is not null").groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc", F.lit(True).alias("shared")), "shared")
    return rows.join(small(shared, IDS), "doc", "left").withColumn("tag", F.when(F.col("shared"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop("shared")


def removed_ranges(rows: DataFrame, k: int = 13, m: int = 3) -> DataFrame:
    """doc, tag, lo, hi: the word ranges to remove, which may overlap; rows: doc, tag, text."""
    size = text_bytes(rows, "text")
    n_buckets = max(32, -(-size // BUCKET_BYTES))
    rows = rows.where(F.col("doc").isNotNull() & F.col("text").isNotNull()).select("doc", "tag", "text")

    def bucket(table: pa.Table) -> pa.Table:
        parts = repeated_ranges(table.to_pylist(), k)
        return pa.table([pa.array(x, t) for x, t in zip(parts, (pa.int64(),) * 4, strict=True)], ["doc", "tag", "lo", "hi"])

    hot = hot_minimisers(rows, size, k, m)
    return rows.mapInArrow(_pack(k, m, n_buckets, hot), _PACKED).groupBy("bucket").applyInArrow(bucket, "doc long, tag long, lo long, hi long")


def dedup_substrings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 13, m: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for each row of df."""
    kind = df.schema[doc_id].dataType.simpleString()
    rows = _tagged(df.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")), "__id", "text")
    ranges = removed_ranges(rows, k, m).groupBy("doc", "tag").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    ranges = saved(ranges, "ranges")
    ids = small(saved(ranges.select("doc").distinct(), "hit"), IDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for x, lo, hi in zip(*(b.column(c) for c in ("text", "lo", "hi")), strict=True):
                words = (x.as_py() or "").encode().split()
                stay = np.zeros(len(words) + 1, np.int64)
                if lo.is_valid:
                    np.add.at(stay, lo.values.to_numpy(), 1)
                    np.add.at(stay, hi.values.to_numpy(), -1)
                stay = np.cumsum(stay[:-1]) == 0
                words = words if stay.all() else [words[i] for i in np.flatnonzero(stay)]
                n_words.append(len(stay))
                n_removed.append(len(stay) - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    whole = rows.join(ids, "doc", "left_anti").select("__id", "text", *(F.lit(None).cast("array<long>").alias(c) for c in ("lo", "hi")))
    hit = rows.join(ids, "doc", "left_semi").join(ranges, ["doc", "tag"], "left").select("__id", "text", "lo", "hi")
    return whole.union(hit).mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")
