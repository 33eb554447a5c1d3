"""Near-duplicate documents by HyperMinHash.

One 64-bit hash of each word shingle is split: its first bits choose one of 512 buckets, the rest is the value. A bucket's
register keeps the smallest value of its shingles as a leading-zero count (6 bits) and mantissa bits (10). Buckets that a
short document leaves empty take over the register of the first filled bucket of a probe sequence that all documents share,
so that two registers are still equal with the probability of the Jaccard similarity (and short documents do not all meet
in bands of empty registers). Bands of 4 of the first 128 registers put documents into band buckets; a Jaccard estimate
corrected for chance collisions of the compressed registers drops hopeless pairs; the rest are verified on full sets.

Documents with equal sets form a class first, and only one of a class goes on. In a band bucket, members are compared with the
smallest one; where that leaves a bucket in several components, every likely pair of different components is compared on
full sets, in blocks of bounded size, in the first band that both share. A block gives the links that join components, fewer
than it has members, and members of one component need no comparison; so large groups of copies cost a few links a member,
and no link is lost to a bucket's size.

Sets hold 64-bit hashes of shingles: two shingles of a pair of documents that share a hash would count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import IDS, saved, small
from tidemark.llm.components import components
from tidemark.llm.ragged import Words, chunks, mix, prefix_sums, range_hash

#: Registers of a signature; bands are of the first ones, estimates of all.
REGISTERS, MANTISSA, BANDS, ROWS = 512, 10, 32, 4
_BITS = REGISTERS.bit_length() - 1
#: The order in which an empty bucket asks the others for a register; how many it asks one by one, before it looks at all.
_ORDER = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(REGISTERS, REGISTERS), axis=1)
_TURN = np.argsort(_ORDER, axis=1)
_PROBES = 16
#: Sets whose registers are made at a time.
SLICE = 2048
#: Equal registers of 512, of which borrowed ones count double: variance up to 0.75 * 0.25 / 260 at the threshold; four deviations below it.
SLACK = 0.11
#: Members of a band bucket, and bytes of their sets, that a block holds.
BLOCK, BLOCK_BYTES = 2048, 16 << 20


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct shingles of normalised texts that have words, by text, then hash."""
    w = Words(texts)
    at, key = w.grams(n)
    of = w.text[at]
    count = np.diff(w.first)
    short = np.flatnonzero(count < n)
    whole = range_hash(prefix_sums(w.hash), w.first[short], w.first[short + 1])
    of, key = np.concatenate([of, short]), np.concatenate([key, whole])
    o = np.lexsort((key, of))
    of, key = of[o], key[o]
    new = np.ones(len(o), bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    return of[new], key[new]


def normal(text: str | None) -> bytes:
    return b" ".join(text.encode().lower().split()) if text else b""


def registers(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row of compressed registers for each set; start: where sets begin in key (none is empty)."""
    ends = np.append(start, len(key))
    return np.concatenate([_registers(key[ends[lo] : ends[min(lo + SLICE, len(start))]], np.diff(ends[lo : lo + SLICE + 1])) for lo in range(0, len(start), SLICE)])


def _registers(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    empty = np.uint64(2**64 - 1)
    hashed = mix(key ^ np.uint64(0x5BF03635))
    least = np.full(len(size) * REGISTERS, empty)
    place = np.repeat(np.arange(len(size)), size) * REGISTERS + (hashed >> np.uint64(64 - _BITS)).astype(np.int64)
    np.minimum.at(least, place, hashed << np.uint64(_BITS) | np.uint64(1))
    zeros = np.minimum(64 - np.frexp(least.astype(np.float64))[1], 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16).reshape(-1, REGISTERS)
    filled = (least != empty).reshape(-1, REGISTERS)
    row, at = np.nonzero(~filled)
    source = np.full(len(row), -1)
    todo = np.arange(len(row))
    for k in range(_PROBES):
        ask = _ORDER[at[todo], k]
        good = filled[row[todo], ask]
        source[todo[good]] = ask[good]
        todo = todo[~good]
    for part in np.split(todo, np.flatnonzero(np.diff(row[todo])) + 1):
        if len(part):
            some = np.flatnonzero(filled[row[part[0]]])
            source[part] = some[_TURN[np.ix_(at[part], some)].argmin(axis=1)]
    out[row, at] = out[row, source]
    return out


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that registers of disjoint sets of n and m shingles are equal by chance.

    A bucket holds n / REGISTERS values on average, spread evenly, so its smallest one has density l exp(-l x), given that
    there is one. A cell of z leading zeros is w = 2**-(z + 1 + MANTISSA) wide, and all of them fill [2**-(z+1), 2**-z):
    the sum of w l m exp(-(l + m) x) over them is an integral.
    """
    a, b = (np.maximum(np.asarray(x, float), 1)[..., None] / REGISTERS for x in (n, m))
    z = np.arange(63.0)
    edge = lambda e: np.exp(-(a + b) * 2.0**-e)
    both = (a * b / (a + b) * 2.0 ** -(z + 1 + MANTISSA) * (edge(z + 1) - edge(z))).sum(axis=-1)
    return both / (-np.expm1(-a[..., 0]) * -np.expm1(-b[..., 0]))


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers of sets of n and m shingles, corrected for chance collisions."""
    chance = collision(n, m)
    return ((x == y).mean(axis=-1) - chance) / (1 - chance)


def signatures(df: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (of the set, whatever its order), registers; a row for each row of df."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            rows: tuple[list, ...] = ([], [], [], [], [])
            for part in chunks(range(len(ids)), (normal(x.as_py()) for x in b.column("text"))):
                full = [x for x in part if x[1]]
                for k, x in part:
                    if not x:
                        for r, v in zip(rows, (k, 0, None, None, None), strict=True):
                            r.append(v)
                if full:
                    of, key = shingle_sets([x for _, x in full], n)
                    start = np.flatnonzero(np.diff(of, prepend=-1))
                    size = np.diff(np.append(start, len(of)))
                    sums = [_sums(key, start, c) for c in (1, 2)]
                    regs = registers(key, start)
                    for r, v in zip(rows, ([k for k, _ in full], size.tolist(), sums[0].tolist(), sums[1].tolist(), [x.tobytes() for x in regs]), strict=True):
                        r.extend(v)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), *(pa.array(r, t) for r, t in zip(rows[1:], (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_shingles", "s1", "s2", "registers"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, s1 long, s2 long, registers binary")


def _likely(pairs: DataFrame, reps: DataFrame, least: float, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate reaches `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            n, m = (b.column(c).to_numpy() for c in ("na", "nb"))
            good = (estimate(x, y, n, m) >= least) & _sizes_fit(n, m, percent)
            yield b.select(["a", "b"]).filter(pa.array(good))

    side = lambda c: reps.select(F.col("rep").alias(c), F.col("registers").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their texts' shingle sets; texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_id, b_id = (b.column(c).to_numpy() for c in ("a", "b"))
            texts = ((normal(x.as_py()), normal(y.as_py())) for x, y in zip(b.column("ta"), b.column("tb"), strict=True))
            for part in chunks(range(len(a_id)), (x + b"\n" + y for x, y in texts), 4 << 20):
                rows = np.array([k for k, _ in part])
                both = [t.split(b"\n") for _, t in part]
                new = np.ones(len(rows), bool)  # neighbours often have the same b
                new[1:] = [u[1] != v[1] for u, v in zip(both[1:], both[:-1], strict=True)]
                one, k1 = shingle_sets([x for x, _ in both], n)
                two, k2 = shingle_sets([both[i][1] for i in np.flatnonzero(new)], n)
                at = np.cumsum(new) - 1
                lo, hi = np.searchsorted(two, at), np.searchsorted(two, at, side="right")
                m = hi - lo
                pick = np.arange(m.sum()) + np.repeat(lo - (np.cumsum(m) - m), m)
                of, key = np.concatenate([one, np.repeat(np.arange(len(rows)), m)]), np.concatenate([k1, k2[pick]])
                o = np.lexsort((key, of))
                same = (of[o][1:] == of[o][:-1]) & (key[o][1:] == key[o][:-1])
                shared = np.bincount(of[o][1:][same], minlength=len(rows))
                union = np.bincount(one, minlength=len(rows)) + m - shared
                good = rows[100 * shared >= percent * union]
                yield pa.RecordBatch.from_arrays([pa.array(a_id[good]), pa.array(b_id[good])], ["a", "b"])

    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    some = texts.join(small(saved(needed, "needed"), IDS), "id", "left_semi")
    side = lambda c: some.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sizes_fit(n, m, percent: int):
    """Sets of n and m shingles can reach the similarity at all."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _dealt(mixed: DataFrame, *more: str) -> DataFrame:
    """mixed (key, band, rep, component, n, registers) dealt to pairs of blocks x <= y of its band buckets; own: a member's block."""
    size = mixed.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    several = small(saved(size.where("blocks > 1"), "blocks"))
    dealt = mixed.join(several, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("key", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "component", "n", "registers", *more)


class Block:
    """The members of a pair of blocks, and their likely pairs: of different components and blocks that are to meet, in the first band that both share."""

    def __init__(self, t: pa.Table, least: float, percent: int):
        self.x, self.y, self.band = (t.column(c)[0].as_py() for c in ("x", "y", "band"))
        self.own, self.rep, self.component, self.n = (t.column(c).to_numpy() for c in ("own", "rep", "component", "n"))
        self.registers = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.least, self.percent = least, percent
        # members of a pair of different blocks meet across alone
        self.right = np.flatnonzero(self.own == self.y)

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """i, its likely partners and their estimates."""
        early = self.registers[:, : self.band * ROWS]
        for i in np.flatnonzero(self.own == self.x):
            js = self.right[(self.component[self.right] != self.component[i]) & _sizes_fit(self.n[i], self.n[self.right], self.percent)]
            if self.x == self.y:
                js = js[js > i]
            if len(js):
                e = estimate(self.registers[i][None], self.registers[js], self.n[i], self.n[js])
                js, e = js[e >= self.least], e[e >= self.least]
                if self.band and len(js):
                    fresh = ~(early[i][None] == early[js]).reshape(len(js), self.band, ROWS).all(axis=2).any(axis=1)
                    js, e = js[fresh], e[fresh]
            if len(js):
                yield int(i), js, e


def _asked(mixed: DataFrame, least: float, percent: int) -> DataFrame:
    """key, rep: the members of band buckets that have a likely partner of another component there."""

    def run(t: pa.Table) -> pa.Table:
        b = Block(t.combine_chunks(), least, percent)
        found = np.zeros(len(b.rep), bool)
        for i, js, _ in b.pairs():
            found[i] = True
            found[js] = True
        return t.select(["key", "rep"]).filter(pa.array(found))

    return _dealt(mixed).groupBy("key", "x", "y").applyInArrow(run, "key long, rep long").distinct()


def _links(mixed: DataFrame, least: float, percent: int) -> DataFrame:
    """a, b: links that join the components of each pair of blocks, the likeliest first, confirmed on full sets. mixed has hashes (the set, sorted)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        b = Block(t, least, percent)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        likely = [(-e, i, j) for i, js, es in b.pairs() for j, e in zip(js.tolist(), es.tolist(), strict=True)]
        out = []
        for _, i, j in sorted(likely):
            p, q = root(int(b.component[i])), root(int(b.component[j]))
            if p == q:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[max(p, q)] = min(p, q)
                out.append((int(b.rep[i]), int(b.rep[j])))
        return pa.table([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _dealt(mixed, "hashes").groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def full_sets(texts: DataFrame, n: int) -> DataFrame:
    """rep, s1, hashes: the sorted hashes of the shingles of each distinct set of an id; texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id")
            for part in chunks(range(len(ids)), (normal(x.as_py()) for x in b.column("text"))):
                part = [x for x in part if x[1]]
                if part:
                    of, key = shingle_sets([x for _, x in part], n)
                    cut = np.searchsorted(of, np.arange(len(part) + 1))
                    sets = [key[lo:hi].tobytes() for lo, hi in zip(cut, cut[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([k for k, _ in part])), pa.array(_sums(key, cut[:-1], 1)), pa.array(sets, pa.binary())], ["rep", "s1", "hashes"])

    return texts.mapInArrow(run, "rep long, s1 long, hashes binary").groupBy("rep", "s1").agg(F.any_value("hashes").alias("hashes"))


def _sums(key: np.ndarray, start: np.ndarray, c: int) -> np.ndarray:
    """A hash of each set, whatever its order."""
    return np.add.reduceat(mix(key + np.uint64(c)), start).astype(np.int64)


def _mixed(members: DataFrame, label: DataFrame) -> DataFrame:
    """The members, with their component, of buckets (key) that hold several components."""
    now = members.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return now.join(apart, "key")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    links = saved(links, "links")
    if not links.limit(1).count():
        return label
    return saved(components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "components")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of df.

    Documents are linked if 100 * intersection >= percent * union of their sets of n-word shingles (lower-cased A-Z;
    documents of fewer words have their whole word sequence as one shingle). component_id is the smallest id reachable
    over links. Null, empty and wordless texts are linked with nothing. Rows with a null id are linked with nothing and
    kept (component_id null). Rows that share an id have that id's links together.
    """
    sig = saved(signatures(df, doc_id, text, n), "signatures")
    least = percent / 100 - SLACK
    sets = sig.where("n_shingles > 0 and doc_id is not null")
    reps = saved(sets.groupBy("s1", "s2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").cast("long").alias("rep"), F.any_value("registers").alias("registers")), "sets")
    band = F.posexplode(F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(registers, b * {2 * ROWS} + 1, {2 * ROWS})))"))
    bands = reps.select("rep", band.alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("hi")).where("pivot < hi").drop("hi")
    members = saved(bands.join(shared, "key"), "members")
    texts = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")

    tried = saved(_likely(members.where("rep > pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), reps, least, percent), "likely")
    label = saved(components(verified(tried, texts, n, percent)), "components")
    mixed = saved(_mixed(members.select("key", "band", "rep"), label).join(reps.select("rep", "s1", "n", "registers"), "rep"), "mixed")
    if mixed.limit(1).count():
        asked = saved(_asked(mixed, least, percent), "asked")
        if asked.limit(1).count():
            needed = small(saved(asked.select(F.col("rep").alias("id")).distinct(), "needed"), IDS)
            sets = full_sets(texts.join(needed, "id", "left_semi"), n)
            label = _joined(label, _links(mixed.join(asked, ["key", "rep"]).join(sets, ["rep", "s1"]), least, percent))
    of_set = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    # no set: joined under a key of its own, as a null would be the same for all
    out = sig.drop("registers").join(of_set, ["s1", "s2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
