"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue for all trees, exact reranking.

A tree splits vectors by the hyperplane between two sampled ones, at the median, until leaves are small. A query walks all
trees through one shared queue, always following the branch that most likely holds a neighbour. That probability is the
product, over the hyperplanes passed, of the chance that a vector at the usual cosine of near neighbours (measured on the
sample) lies on the branch's side, given the query's own place. The walk ends when the chance that a neighbour is in none of
the visited leaves, tree by tree multiplied, is below `miss`; so queries visit as many leaves as their geometry asks for: few
in clustered data, more in isotropic ones. Candidates, the vectors in visited leaves, are reranked by exact cosine in double
precision; no others are in the result.

The hyperplanes are fitted on the driver on a bounded sample (`max_fit` vectors); every vector is indexed, by a join of
vectors and queries on (tree, leaf), for bundles of neighbouring leaves at a time. Equal vectors form a class and are searched
as one, with the k + 1 smallest ids of the class, which are all that can be among a query's k nearest; so a vector that a
third of all rows share is one candidate. Bundles are dealt out in blocks of bounded size.

Results: null and zero vectors, and those with null or non-finite components, take no part; nor do vectors whose length is
not the most frequent one (ties: the shorter), or rows with a null id. Rows of one id and different vectors are candidates
each; an id is never its own neighbour. Fewer candidates than k give fewer rows. Empty tables give no rows. Other columns do
not matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

#: Sampled vectors of the first leaves that a query visits, from which it takes its bound: what is further off than the
#: k + 1 best of them is in no result, so blocks need not return it. They bound alone; what is returned comes from blocks.
FIRST = 2048
#: Leaves that are reranked together, and vectors of them that meet in one task with their queries.
BUNDLE, BLOCK = 64, 4096
#: ln of the normal distribution function on a grid.
_GRID = np.linspace(-9, 9, 3601)
_LOG_PHI = np.log([0.5 * math.erfc(-g / math.sqrt(2)) for g in _GRID])


@dataclass
class Forest:
    """Nodes of all trees. child: two for each inner node; a leaf's are -1 and its number. root: of each tree. count: of a leaf's vectors in the sample. near: cosine of a vector and its fifth neighbour in the sample."""

    plane: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    root: np.ndarray
    count: np.ndarray
    near: float = 0.5


def grow(sample: np.ndarray, trees: int, leaf: int, seed: int = 3) -> Forest:
    """A forest over the rows of sample (unit vectors)."""
    rng = np.random.default_rng(seed)
    plane, offset, child, count, root = [], [], [], [], []

    def node(rows: np.ndarray) -> int:
        me = len(plane)
        plane.append(np.zeros(sample.shape[1]))
        offset.append(0.0)
        child.append((-1, len(count)))
        if len(rows) > leaf:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            w = a - b if np.linalg.norm(a - b) > 1e-9 else rng.normal(size=sample.shape[1])
            w = w / np.linalg.norm(w)
            x = sample[rows] @ w
            cut = float(np.median(x))
            right = x > cut
            if 0 < right.sum() < len(rows):
                plane[me], offset[me] = w, cut
                child[me] = (node(rows[~right]), node(rows[right]))
                return me
        count.append(len(rows))
        return me

    for _ in range(trees):
        root.append(node(np.arange(len(sample))))
    return Forest(np.array(plane), np.array(offset), np.array(child), np.array(root), np.array(count), usual_cosine(sample, rng))


def usual_cosine(sample: np.ndarray, rng: np.random.Generator, rows: int = 256) -> float:
    """The median cosine of some vectors and their fifth neighbours."""
    if len(sample) < 7:
        return 0.5
    s = sample[rng.choice(len(sample), min(len(sample), rows), replace=False)] @ sample.T
    return float(np.clip(np.median(np.partition(s, -6, axis=1)[:, -6]), 0.05, 0.999))


def leaves(f: Forest, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x in each tree."""
    out = np.empty((len(x), len(f.root)), np.int64)
    for t, r in enumerate(f.root):
        at = np.full(len(x), r)
        going = np.flatnonzero(f.child[at, 0] >= 0)
        while len(going):
            a = at[going]
            side = (np.einsum("ij,ij->i", x[going], f.plane[a]) > f.offset[a]).astype(int)
            at[going] = f.child[a, side]
            going = going[f.child[at[going], 0] >= 0]
        out[:, t] = f.child[at, 1]
    return out


def search(f: Forest, q: np.ndarray, miss: float) -> list[list[int]]:
    """For each query the leaves that it visits: by one queue over all trees, the likeliest first, until a neighbour is in none of them with a chance below `miss`."""
    spread = math.sqrt((1 - f.near**2) / q.shape[1])
    child = f.child.tolist()
    out = []
    for row in q:
        z = np.clip((f.near * (f.plane @ row) - f.offset) / spread, -9, 9)
        right, left = (-np.interp(z, _GRID, _LOG_PHI)).tolist(), (-np.interp(-z, _GRID, _LOG_PHI)).tolist()
        heap = [(0.0, r, t) for t, r in enumerate(f.root.tolist())]
        heapq.heapify(heap)
        got, away = [], [1.0] * len(f.root)
        while heap:
            far, n, t = heapq.heappop(heap)
            a, b = child[n]
            if a >= 0:
                heapq.heappush(heap, (far + left[n], a, t))
                heapq.heappush(heap, (far + right[n], b, t))
                continue
            got.append(b)
            away[t] = max(0.0, away[t] - math.exp(-far))
            if math.prod(away) <= miss:
                break
        out.append(got)
    return out


def members(f: Forest, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of x by leaf, one leaf after the other, and where each leaf's begin."""
    at = leaves(f, x)
    order = np.argsort(at, axis=None, kind="stable")
    return (order // at.shape[1]).astype(np.int32), np.searchsorted(at.ravel()[order], np.arange(len(f.count) + 1))


def first_rows(rows: np.ndarray, start: np.ndarray, visited: list[int], most: int) -> np.ndarray:
    """The distinct rows in the first of the visited leaves, until they hold `most`, with repeats."""
    part, found = [], 0
    for n in visited:
        part.append(rows[start[n] : start[n + 1]])
        found += len(part[-1])
        if found >= most:
            break
    return np.unique(np.concatenate(part)) if part else rows[:0]


def _vector(df: DataFrame, embedding: str):
    """The vectors as they are if single precision, which is half to ship; else as doubles."""
    single = df.schema[embedding].dataType.simpleString() == "array<float>"
    return F.col(embedding) if single else F.col(embedding).cast("array<double>")


def classes(df: DataFrame, vec_id: str, embedding: str, k: int) -> DataFrame:
    """class, vector (array of doubles), ids (the k + 1 smallest, sorted): the distinct vectors that take part."""
    ok = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(F.col("v"), lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), _vector(df, embedding).alias("v")).where("id is not null and v is not null").where(F.coalesce(ok, F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    rows = rows.join(F.broadcast(usual), F.size("v") == F.col("n")).drop("n")
    first = Window.partitionBy("h1", "h2").orderBy("id")
    hashed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # the window keeps k + 1 rows of a class already before the shuffle
    few = hashed.groupBy("h1", "h2", "id").agg(F.first("v").alias("v")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.first("v").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("h1").alias("class"), F.col("h2").alias("class2"), "vector", "ids")


def _unit(t) -> np.ndarray:
    x = np.array(t.combine_chunks().flatten() if isinstance(t, pa.ChunkedArray) else t.flatten()).reshape(len(t), -1).astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (q @ v.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1)))


def _last(s: np.ndarray, k: int) -> np.ndarray:
    """The k + 1 best score of each row; the worst one if there are fewer."""
    at = max(0, s.shape[1] - k - 1)
    return np.partition(s, at, axis=1)[:, at] if s.shape[1] else np.full(len(s), -np.inf)


def nearest(df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, trees: int = 8, leaf: int = 32, miss: float = 0.04, max_fit: int = 100_000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the k nearest found of each row of queries (vec_id, embedding) in df.

    miss: the estimated chance that a neighbour is in no visited leaf; recall is about 1 - miss or better.
    """
    every = saved(classes(df, vec_id, embedding, k), "classes")
    n = every.count()
    part = every if n <= max_fit else every.orderBy(F.xxhash64("class")).limit(max_fit)
    picked = part.select("class", "vector", "ids").orderBy("class", "ids").toArrow().combine_chunks()
    fitted = picked.column("vector")
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(fitted):
        return df.sparkSession.createDataFrame([], schema)
    x = _unit(fitted)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    grown = grow(x, trees, leaf)
    forest = df.sparkSession.sparkContext.broadcast(grown)
    sample = df.sparkSession.sparkContext.broadcast((x.astype(np.float32), *members(grown, x)))  # at most max_fit vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                u = _unit(b.column("vector"))
                at = leaves(forest.value, u / np.linalg.norm(u, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(at), pa.list_(pa.int64()))], [*b.schema.names, "leaves"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                u = _unit(b.column("vector"))
                u = u / np.linalg.norm(u, axis=1, keepdims=True)
                found = search(forest.value, u, miss)
                vectors, rows, start = sample.value
                near = [first_rows(rows, start, visited, FIRST) for visited in found]
                # fewer than k + 1 vectors bound nothing; single precision is off by less than 1e-5
                bound = np.array([_last(q[None] @ vectors[r].T, k)[0] - 1e-5 if len(r) > k else -np.inf for q, r in zip(u.astype(np.float32), near, strict=True)], float)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound), pa.array(found, pa.list_(pa.int64()))], [*b.schema.names, "bound", "leaves"])

    kind = every.schema["vector"].dataType.simpleString()
    asked = queries.select(F.col(vec_id).cast("long").alias("query_id"), _vector(queries, embedding).cast(kind).alias("v")).where("query_id is not null and v is not null")
    asked = asked.select("query_id", F.xxhash64("v").alias("class"), F.xxhash64(F.lit(1), "v").alias("class2"))
    some = every.join(asked.select("class", "class2").distinct(), ["class", "class2"]).select("class", "class2", "vector")
    bundle = F.floor(F.col("leaf") / BUNDLE).cast("int").alias("bundle")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    index = every.mapInArrow(place, "class long, class2 long, vector " + kind + ", ids array<long>, leaves array<long>").select("vector", "ids", F.explode("leaves").alias("leaf"))
    index = saved(index.select(bundle, "leaf", "vector", "ids"), "index")
    # a bundle of many vectors is dealt to several blocks, and its queries go to each of them
    blocks = index.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    index = index.join(blocks, "bundle").select("bundle", F.pmod(F.xxhash64("ids"), F.col("blocks")).cast("int").alias("block"), none("long", "class"), none("long", "class2"), "vector", none("double", "bound"), "ids", F.array("leaf").alias("leaves"))
    visits = some.mapInArrow(visit, "class long, class2 long, vector " + kind + ", bound double, leaves array<long>")
    at = F.explode(F.array_distinct(F.transform("leaves", lambda n: F.floor(n / BUNDLE).cast("int")))).alias("bundle")
    visits = visits.select("*", at).withColumn("leaves", F.filter("leaves", lambda n: F.floor(n / BUNDLE) == F.col("bundle")))
    visits = visits.join(blocks, "bundle").select("bundle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "class", "class2", "vector", "bound", none("array<long>", "ids"), "leaves")

    def rerank(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t.filter(t.column("ids").is_null())
        have = t.filter(t.column("ids").is_valid())
        cols: tuple[list, ...] = ([], [], [], [])
        if len(asks) and len(have):
            v, ids = _unit(have.column("vector")), have.column("ids").to_pylist()
            own = np.array(have.column("leaves").combine_chunks().flatten()) % BUNDLE
            c1, c2 = asks.column("class").to_pylist(), asks.column("class2").to_pylist()
            for lo in range(0, len(asks), 512):
                some = asks.slice(lo, 512)
                visited = np.zeros((len(some), BUNDLE), bool)
                lists = some.column("leaves").to_pylist()
                visited[np.repeat(np.arange(len(some)), [len(x) for x in lists]), np.concatenate(lists) % BUNDLE] = True
                candidate = visited[:, own]
                s = np.where(candidate, _cosine(_unit(some.column("vector")), v), -np.inf)
                # of the block's k + 1 best (and ties) those that are within the query's bound
                last = np.maximum(_last(s, k), some.column("bound").to_numpy())
                for i, j in zip(*np.nonzero((s >= last[:, None]) & candidate), strict=True):
                    for c, x in zip(cols, (c1[lo + i], c2[lo + i], float(s[i, j]), ids[j]), strict=True):
                        c.append(x)
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.int64()))], ["class", "class2", "score", "ids"])

    found = visits.unionByName(index).groupBy("bundle", "block").applyInArrow(rerank, "class long, class2 long, score double, ids array<long>")
    each = found.select("class", "class2", F.explode("ids").alias("vec_id"), "score").groupBy("class", "class2", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("class", "class2").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    pairs = asked.distinct().join(best, ["class", "class2"]).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
