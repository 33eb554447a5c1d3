"""Hard negatives: rows of another label whose score with an anchor lies just below that of the anchor's own positives.

Scores are inner products of whole numbers, floor(scale * component), as exact integers. One more component lifts every
row to the same norm M (the largest of all rows), an anchor gets a zero there; then distance^2 = M^2 + |anchor|^2 - 2 *
score, and a window of scores is an annulus of distances. A vantage-point tree over the lifted rows is walked nearest
first from the inner edge of the annulus outwards, and a walk ends when the next shell cannot hold a nearer row than
those found.

On Spark: a coarse tree, fitted on at most `max_fit` rows, routes every row to a cell; cells are cut into blocks of about
`block` rows. An anchor first visits a block of its own cell, which bounds the search, then the blocks whose shells
reach into what is left of its annulus. Rows and the anchors that visit them are dealt by block and sorted, rows first;
a task builds the block's tree, then streams the anchors through. Blocks that many anchors visit are dealt out in
copies. Shells only ever leave out what cannot be an answer: results are exact.

Results: rows with a null id, label or vector, or with a null or non-finite component take no part; neither does a row's
own copy (equal rows count once; a row that shares an anchor's id is not its positive). Shorter vectors count as padded
with zeros. Ties go to the smaller id. Of equal vectors of one label only the first k + 1 ids are searched, since no other
can be among the first k; anchors of equal vector and label are searched once. Empty tables give no rows; other columns
are ignored. Vectors whose squared norm does not fit 62 bits are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved, small

#: Rows that the coarse tree is fitted on, rows of a block, of a leaf, and cells of the coarse tree at most.
MAX_FIT, BLOCK, LEAF, CELLS = 16_384, 16_384, 256, 1_024
#: Anchors that stream through a block together, and anchors a copy of a block gets.
BATCH, VISITS = 512, 65_536
#: Relative slack of distances, far above rounding; it only widens what is visited.
SLACK = 1e-6
NONE = np.iinfo(np.int64).min + 1  # its negative fits, too


class Tree:
    """A vantage-point tree over lifted rows: node k splits at radius[k] around vantage[k] into nodes 2k+1 and 2k+2."""

    def __init__(self, rows: np.ndarray, norm2: float, depth: int, seed: int = 0):
        """rows: integer components; norm2: M^2."""
        self.norm2, self.depth = float(norm2), depth
        lifted = self.lift(rows)
        rng, nodes = np.random.default_rng(seed), 2**depth - 1
        self.vantage, self.radius = np.zeros((nodes, lifted.shape[1])), np.zeros(nodes)
        self.near, self.far = np.zeros((nodes, 2)), np.zeros((nodes, 2))  # least and largest distance of either side's rows
        members = {0: np.arange(len(rows))}
        for k in range(nodes):
            own = members.pop(k)
            if len(own):
                start = lifted[own[rng.integers(len(own))]]
                self.vantage[k] = lifted[own[np.argmin(lifted[own] @ start)]]  # a row far from another
                d = self.between(lifted[own], self.vantage[k : k + 1])[:, 0]
                self.radius[k] = np.median(d)
                inner = d <= self.radius[k]
            else:
                d, inner = np.zeros(0), np.zeros(0, bool)
            members[2 * k + 1], members[2 * k + 2] = own[inner], own[~inner]
            for side, at in ((self.near, d[inner]), (self.far, d[~inner])):
                side[k] = (at.min(), at.max()) if len(at) else (np.inf, -np.inf)
        self.leaves = [members[k] for k in range(nodes, 2 * nodes + 1)]

    def lift(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.norm2 - np.einsum("ij,ij->i", x, x), 0))])

    def between(self, lifted: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        """Distances of lifted rows, all of norm M, from vantage points."""
        return np.sqrt(np.maximum(2 * self.norm2 - 2 * lifted @ vantage.T, 0))

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        lifted, node = self.lift(rows), np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            for k in np.unique(node):
                at = np.flatnonzero(node == k)
                inner = self.between(lifted[at], self.vantage[k : k + 1])[:, 0] <= self.radius[k]
                node[at] = 2 * k + 2 - inner
        return node - (2**self.depth - 1)

    def shells(self, queries: np.ndarray, tight: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each query and leaf the least and largest possible distance; tight: by the distances of the fitted rows themselves."""
        q = queries.astype(np.float64)
        self_norm = np.einsum("ij,ij->i", q, q)
        d = np.sqrt(np.maximum(self.norm2 + self_norm[:, None] - 2 * q @ self.vantage[:, :-1].T, 0))
        m = np.sqrt(self.norm2)
        low, high = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        for level in range(self.depth):
            k = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            inner = self.near[k] if tight else np.column_stack([np.zeros(len(k)), self.radius[k]])
            outer = self.far[k] if tight else np.column_stack([self.radius[k], np.full(len(k), 2 * m)])
            sides = np.stack([inner, outer], 1).reshape(-1, 2)
            at = np.repeat(d[:, k], 2, axis=1)
            low = np.maximum(np.repeat(low, 2, axis=1), np.maximum(at - sides[:, 1], sides[:, 0] - at))
            high = np.minimum(np.repeat(high, 2, axis=1), at + sides[:, 1])
        slack = SLACK * (m + np.sqrt(self_norm))[:, None]
        return np.maximum(low - slack, 0), high + slack


def _distance(score: np.ndarray, norm2: float, own: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(norm2 + own - 2.0 * score, 0))


class Block:
    """Rows of one block under a tree of their own, searched for batches of anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, norm2: int, leaf: int):
        self.norm2, self.exact = norm2, np.float64 if norm2 < 2**53 else np.int64  # sums below 2^53 are exact in doubles
        depth = max(0, int(np.ceil(np.log2(max(1, len(rows) / leaf)))))
        self.tree = Tree(rows, norm2, depth)
        order = self.tree.leaves
        self.ids, self.labels, self.rows = [ids[k] for k in order], [labels[k] for k in order], [rows[k].astype(self.exact) for k in order]

    def search(self, queries: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's first k rows of the same (another) label with low <= score <= high; NONE fills up."""
        n = len(queries)
        best, ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)
        q = queries.astype(self.exact)
        own = np.einsum("ij,ij->i", queries.astype(np.float64), queries.astype(np.float64))
        near, far = self.tree.shells(queries, tight=True)
        inside = np.where(high == np.iinfo(np.int64).max, 0.0, _distance(high, self.norm2, own))
        near = np.where(far < (inside * (1 - SLACK))[:, None], np.inf, near)  # shells that lie inside the annulus's hole
        order = np.argsort(near, axis=1, kind="stable")
        bound = low.copy()
        active = np.arange(n)
        for step in range(near.shape[1]):
            leaf = order[active, step]
            reach = np.where(bound[active] == NONE, np.inf, _distance(bound[active], self.norm2, own[active]) * (1 + SLACK) + SLACK)
            ahead = near[active, leaf] <= reach
            active, leaf = active[ahead & np.isfinite(near[active, leaf])], leaf[ahead & np.isfinite(near[active, leaf])]
            if not len(active):
                break
            for at in np.unique(leaf):
                if not len(self.ids[at]):
                    continue
                who = active[leaf == at]
                score = (q[who] @ self.rows[at].T).astype(np.int64)
                fits = (self.labels[at][None, :] == labels[who, None]) == same
                score = np.where(fits & (score <= high[who, None]) & (score >= bound[who, None]), score, NONE)
                all_scores = np.concatenate([best[who], score], axis=1)
                all_ids = np.concatenate([ids[who], np.broadcast_to(self.ids[at], score.shape)], axis=1)
                first = np.lexsort((all_ids, -all_scores), axis=1)[:, :k] if all_scores.shape[1] <= 4 * k else self._first(all_scores, all_ids, k)
                best[who], ids[who] = np.take_along_axis(all_scores, first, 1), np.take_along_axis(all_ids, first, 1)
                bound[who] = np.maximum(low[who], best[who][:, -1])
        return best, ids

    @staticmethod
    def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Places of each line's first k by score, then by id: all that reach the k-th score are sorted."""
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        out = np.zeros((len(scores), k), np.int64)
        for x in range(len(scores)):
            reach = np.flatnonzero(scores[x] >= least[x])
            if len(reach) > 4 * k and least[x] == NONE:  # fewer than k rows fit: any of the rest fills up
                reach = np.concatenate([reach[scores[x, reach] > NONE], reach[scores[x, reach] == NONE][:k]])
            out[x] = reach[np.lexsort((ids[x, reach], -scores[x, reach]))[:k]]
        return out


_QUERY = "qid long, win int, label long, low long, high long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width) if width else np.zeros((len(column), 0), np.int64)


class Index:
    """Blocks of rows under a coarse tree; rows is a saved table (block, vec_id, label, v)."""

    def __init__(self, first: DataFrame, width: int, norm2: int, max_fit: int, block: int, leaf: int):
        self.width, self.norm2, self.leaf, self.spark = width, norm2, leaf, first.sparkSession
        n = first.count()
        step = -(-n // max_fit) if n else 1
        sample = first.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).limit(max_fit).select("v").collect()
        fit = np.array([r["v"] for r in sample], np.int64).reshape(len(sample), width)
        depth = min(int(np.log2(CELLS)), max(0, int(np.ceil(np.log2(max(1, n / block))))), int(np.log2(max(1, len(fit) / 8))))
        self.tree = Tree(fit, norm2, depth)
        tree = self.spark.sparkContext.broadcast(self.tree)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = tree.value.route(_matrix(b.column("v"), width))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *b.columns], ["cell", *b.schema.names])

        cells = saved(first.mapInArrow(route, "cell long, vec_id long, label long, v array<long>"), "cells")
        sizes = dict(cells.groupBy("cell").count().collect())  # one row a cell, at most CELLS
        self.chunks = [max(1, -(-sizes.get(c, 0) // block)) for c in range(2**depth)]
        self.base = [int(x) for x in np.cumsum([0, *self.chunks])]
        many = F.element_at(F.array(*map(F.lit, self.chunks)), F.col("cell").cast("int") + 1)
        at = F.element_at(F.array(*map(F.lit, self.base[:-1])), F.col("cell").cast("int") + 1)
        self.rows = cells.select((at + F.pmod(F.xxhash64("vec_id"), many)).cast("long").alias("block"), "vec_id", "label", "v")

    def visits(self, queries: DataFrame, home: bool) -> DataFrame:
        """A row for each query and block it visits: a block of its own cell, or, without home, all others that reach into its annulus."""
        tree = self.spark.sparkContext.broadcast((self.tree, self.chunks, self.base))
        width, norm2 = self.width, self.norm2

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, chunks, base = tree.value
            for whole in batches:
                for a in range(0, whole.num_rows, BATCH):
                    b = whole.slice(a, BATCH)
                    q = _matrix(b.column("v"), width)
                    qid, low, high = (b.column(c).to_numpy(zero_copy_only=False) for c in ("qid", "low", "high"))
                    cell = t.route(q)
                    own_block = np.array([base[c] + int(x) % chunks[c] for c, x in zip(cell, qid, strict=True)])
                    if home:
                        row, block = np.arange(len(q)), own_block
                    else:
                        norm = np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64))
                        near, far = t.shells(q, tight=False)
                        outer = np.where(low == NONE, np.inf, _distance(low, norm2, norm) * (1 + SLACK) + SLACK)
                        inner = np.where(high == np.iinfo(np.int64).max, 0, _distance(high, norm2, norm) * (1 - SLACK) - SLACK)
                        row, c = np.nonzero((near <= outer[:, None]) & (far >= inner[:, None]))
                        many = np.array(chunks)[c]
                        row = np.repeat(row, many)
                        block = np.repeat(np.array(base)[c], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                        other = block != own_block[row]
                        row, block = row[other], block[other]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), *b.take(pa.array(row)).columns], ["block", *b.schema.names])

        return queries.mapInArrow(plan, f"block long, {_QUERY}, v array<long>")

    def search(self, queries: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
        """qid, win, vec_id, score: what the visited blocks hold of each query's first k."""
        visits = saved(self.visits(queries.select("qid", "win", "label", "low", "high", "v"), home), "visits")
        load = saved(visits.groupBy("block").agg(F.ceil(F.count("*") / VISITS).alias("copies")), "load")
        visits = visits.join(small(load), "block").withColumn("copy", F.pmod(F.hash("qid", "win"), F.col("copies").cast("int"))).drop("copies")
        rows = self.rows.join(small(load), "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).drop("copies")
        visited = visits.select("block", "copy", F.lit(1).alias("kind"), "qid", "win", "label", "low", "high", "v")
        stored = rows.select("block", "copy", F.lit(0).alias("kind"), F.col("vec_id").alias("qid"), F.lit(0).alias("win"), "label", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), "v")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        width, norm2, leaf = self.width, self.norm2, self.leaf

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, block = None, [], None
            for whole in batches:
                keys = np.column_stack([whole.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "copy", "kind")])
                edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else []
                for a, z in zip([0, *edges], [*edges, len(keys)], strict=True):
                    if a == z:
                        continue
                    key, part = tuple(keys[a, :2]), whole.slice(a, z - a)
                    if key != now:
                        now, held, block = key, [], None
                    if keys[a, 2] == 0:
                        held.append(part)
                        continue
                    if block is None:
                        if not held:
                            continue
                        ids, labels = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in held]) for c in ("qid", "label"))
                        block = Block(ids, labels, np.concatenate([_matrix(p.column("v"), width) for p in held]), norm2, leaf)
                        held = []
                    for s in range(0, part.num_rows, BATCH):
                        p = part.slice(s, BATCH)
                        qid, win, label, low, high = (p.column(c).to_numpy(zero_copy_only=False) for c in ("qid", "win", "label", "low", "high"))
                        score, ids = block.search(_matrix(p.column("v"), width), label, low, high, k, same)
                        row, col = np.nonzero(score != NONE)
                        yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(win[row], pa.int32()), pa.array(ids[row, col]), pa.array(score[row, col])], ["qid", "win", "vec_id", "score"])

        dealt = stored.unionByName(visited).repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "kind")
        return dealt.mapInArrow(run, "qid long, win int, vec_id long, score long")

    def first(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """qid, win, place (from 1), vec_id, score of each query's first k, over all blocks."""
        by = Window.partitionBy("qid", "win").orderBy(F.desc("score"), "vec_id")

        def merged(found: DataFrame) -> DataFrame:
            return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)

        near = saved(self.search(queries, k, same, home=True), "near")
        reached = near.groupBy("qid", "win").agg(F.min("score").alias("reached"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
        rest = queries.join(reached, ["qid", "win"], "left").withColumn("low", F.greatest("low", F.coalesce("reached", "low"))).drop("reached")
        far = self.search(saved(rest, "rest"), k, same, home=False)
        return saved(merged(near.unionByName(far)), "first")


def hard_negatives(
    vectors: DataFrame, anchors: Column, k: int = 5, positives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256, max_fit: int = MAX_FIT, block: int = BLOCK, leaf: int = LEAF
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label; anchors: which rows are searched for. window: the least and largest negative score,
    in hundredths of the positive's.
    """
    fit_for = "vec_id is not null and label is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    clean = vectors.where(fit_for).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), ints.alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    clean = saved(clean, "clean")
    square = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"))
    about = clean.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("norm2")).first()
    width, norm2 = about["width"] or 0, int(about["norm2"] or 0)
    if norm2 >= 2**62:
        raise ValueError("squared norms must fit 62 bits")
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    rows = saved(clean.withColumn("v", padded).groupBy("vec_id", "label", "v").agg(F.max("is_anchor").alias("is_anchor")), "rows")

    alike = Window.partitionBy("v", "label").orderBy("vec_id")
    searched = max(k, positives) + 1
    first = saved(rows.select("vec_id", "label", "v", F.row_number().over(alike).alias("nth")).where(F.col("nth") <= searched).drop("nth"), "firsts")
    index = Index(first, width, norm2, max_fit, block, leaf)

    wanted = rows.where("is_anchor").select("vec_id", "label", "v")
    classes = saved(wanted.groupBy("label", "v").agg(F.min("vec_id").alias("least")).drop("least").withColumn("qid", F.monotonically_increasing_id()), "classes")
    whole = classes.select("qid", F.lit(0).alias("win"), "label", F.lit(int(NONE)).alias("low"), F.lit(2**63 - 1).alias("high"), "v")
    own = index.first(whole, positives + 1, same=True).select("qid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    scores = own.select("qid", "positive_score").distinct().where("positive_score >= 0")
    by_score = Window.partitionBy("qid").orderBy("positive_score")
    windows = saved(scores.withColumn("win", F.row_number().over(by_score)), "windows")
    low, high = F.expr(f"(positive_score * {window[0]} + 99) div 100"), F.expr(f"positive_score * {window[1]} div 100")
    asked = windows.join(small(classes), "qid").select("qid", "win", "label", low.alias("low"), high.alias("high"), "v")
    negatives = index.first(asked, k, same=False).join(windows, ["qid", "win"]).select("qid", "positive_score", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))

    named = wanted.join(small(classes), ["label", "v"]).select("qid", F.col("vec_id").alias("anchor_id"))
    of_anchor = Window.partitionBy("anchor_id", "qid").orderBy(F.desc("positive_score"), "positive_id")
    pairs = named.join(own, "qid").where("positive_id <> anchor_id").withColumn("nth", F.row_number().over(of_anchor)).where(F.col("nth") <= positives).drop("nth")
    return pairs.join(negatives, ["qid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
