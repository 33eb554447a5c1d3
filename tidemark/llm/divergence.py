"""Source divergence audit: how far the term distributions of a language's sources lie apart, and by which terms.

Sort-based streaming in two passes. Tasks fold their documents into rows (lang, term, source, fold: documents, count);
these are dealt by (lang, term) and sorted by (term, lang, source, fold), so that a scan over run lengths gives each
term's document frequency and its count in each source, one run in memory at a time. Kept terms are dealt again behind
a header that lists the groups of their language, and each run yields its share of every pair's distance and its terms.

A fold stands for the documents of one task and source (a term of all documents would otherwise be one run of all
documents); it adds up what single documents would have given, so nothing is lost.

Results, for every (lang, source) that occurs: part `pair` has a row for each other source of the language, part `term`
the terms that the source uses more than its language does. Null texts, languages and sources are empty strings; a row
is a document, repeated rows are as many documents; ids are not read. A text of any length is counted whole. An empty
table gives no rows; other columns of the input, whatever their names, are ignored. Ties are ranked by the term's or the
source's UTF-8 bytes. The work is (kept terms x sources x sources) integer operations, spread over all tasks; the rows
of `pair` are as many as the pairs of sources themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

#: A task's fold goes out when it holds so many (lang, source, term) rows: about 150 MB.
FOLD = 600_000
#: Rows of a part of the second pass, unless the pairs of sources are more.
PART = 100_000
#: Cells of a block of runs (terms x sources) in the second pass: 8 MB an array.
CELLS = 1 << 20
#: Bytes that separate terms become spaces, A-Z become a-z; letters and all bytes of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and counts of each (lang, term, source), folded over this task's documents; the empty term stands for the group itself."""
    from pyspark import TaskContext

    task, folds = TaskContext.get().partitionId(), 0
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (docs, counts) in groups.items():
            terms = list(docs)
            for a in range(0, len(terms), 20_000):
                part = terms[a : a + 20_000]
                same = (pa.repeat(pa.scalar(x), len(part)) for x in (lang, source, (task << 32) + folds))
                numbers = (pa.array(list(map(x.__getitem__, part)), pa.int64()) for x in (docs, counts))
                columns = [next(same), pa.array(part, pa.binary()).cast(pa.string()), *same, *numbers]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "fold", "df", "n"])

    for b in batches:
        for text, lang, source in zip(*(b.column(k).to_pylist() for k in ("text", "lang", "source")), strict=True):
            if (lang, source) not in groups:
                groups[lang, source] = (Counter(), Counter())
            docs, counts = groups[lang, source]
            before = len(docs)
            words = text.encode().translate(_TERMS).split()
            counts.update(words)
            docs.update(set(words))
            docs[b""] += 1
            held += len(docs) - before
            if held > FOLD:
                yield from out()
                groups, held, folds = {}, 0, folds + 1
    yield from out()


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _kept(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Run-length scan of sorted rows; a run that a batch breaks off is carried over, added up by source."""

        def runs(rows: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            lang, term, source, df, n = rows
            at = _starts(lang, term, source)
            lang, term, source, df, n = lang[at], term[at], source[at], np.add.reduceat(df, at), np.add.reduceat(n, at)
            of = _starts(lang, term)
            end = len(lang) if last else int(of[-1])
            heads = of if last else of[:-1]
            carry = [x[end:] for x in (lang, term, source, df, n)]
            sizes = np.diff(np.append(heads, end))
            total = np.add.reduceat(df[:end], heads) if len(heads) else np.zeros(0, np.int64)
            keep = np.repeat((total >= least) | (term[heads] == ""), sizes) if len(heads) else np.zeros(0, bool)
            first = np.zeros(end, np.int64)
            first[heads] = term[heads] != "" if len(heads) else 0
            columns = [pa.array(lang[:end][keep], pa.string()), pa.array(term[:end][keep], pa.string()), pa.array(source[:end][keep], pa.string()), pa.array(n[:end][keep]), pa.array(first[keep])]
            return pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "n", "first"]), carry

        carry: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(k).to_numpy(zero_copy_only=False) for k in ("lang", "term", "source", "df", "n")]
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
            out, carry = runs(rows, last=False)
            yield out
        if carry is not None:
            yield runs(carry, last=True)[0]

    return scan


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) in 64-bit integers, three decimal digits at a time: exact for totals below 9 * 10^15."""
    rest, q = count, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        q = q * 1000 + rest // total
        rest = rest % total
    return q + 1


class _Lang:
    """What one partition has seen of a language: shares of the distances of all pairs, and the first terms of each source."""

    def __init__(self, sources: list[str], totals: list[int], terms: int, top: int):
        self.sources, self.index = sources, {s: k for k, s in enumerate(sources)}
        self.divisor = np.array(totals, np.int64) + 5 * terms
        self.all = np.array([sum(totals) + 5 * terms], np.int64)
        self.apart = np.zeros((len(sources), len(sources)), np.int64)
        self.top, self.first = top, [[] for _ in sources]

    def add(self, terms: list[str], row: np.ndarray, source: np.ndarray, n: np.ndarray) -> None:
        """Counts n of terms[row] in source; all counts of a term come together."""
        count = np.zeros((len(terms), len(self.sources)), np.int64)
        count[row, source] = n
        p = _share(count + 5, self.divisor)
        for k in range(len(self.sources) - 1):
            self.apart[k, k + 1 :] += np.abs(p[:, k + 1 :] - p[:, k : k + 1]).sum(0)
        above = np.where(count > 0, p - _share(count.sum(1, keepdims=True) + 5, self.all), 0)
        for k, f in enumerate(above.T):
            hits = np.flatnonzero(f > 0)
            if len(hits) > self.top:
                hits = hits[f[hits] >= np.partition(f[hits], -self.top)[-self.top]]
            if len(hits):
                self.first[k] = sorted(self.first[k] + [(-int(f[h]), terms[h]) for h in hits])[: self.top]

    def rows(self, lang: str, empty: bool) -> Iterator[tuple]:
        for a in range(len(self.sources)):
            for b in range(a + 1, len(self.sources)):
                if empty or self.apart[a, b]:
                    yield lang, self.sources[a], "pair", self.sources[b], int(self.apart[a, b])
            for f, term in self.first[a]:
                yield lang, self.sources[a], "term", term, -f


def _partials(top: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (part, lang, term, source, ...): a language's header, whose term is empty, then the runs of its kept terms."""
        now: tuple | None = None
        header: list[tuple[str, int]] = []
        terms_of_lang = 0
        state: _Lang | None = None
        terms: list[str] = []
        held: list[tuple[int, int, int]] = []

        def flush() -> None:
            nonlocal terms, held
            if terms:
                row, source, n = (np.array(x, np.int64) for x in zip(*held, strict=True))
                state.add(terms, row, source, n)
                terms, held = [], []

        def done() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            flush()
            at = state or _Lang([s for s, _ in header], [n for _, n in header], terms_of_lang, top)
            rows = at.rows(now[1], empty=now[0] == 0)
            while part := [r for _, r in zip(range(10_000), rows, strict=False)]:
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in part], pa.string()) for k in range(4)), pa.array([r[4] for r in part], pa.int64())], ["lang", "source", "part", "item", "value"])

        for b in batches:
            for part, lang, term, source, n, v in zip(*(b.column(k).to_pylist() for k in ("part", "lang", "term", "source", "n", "v")), strict=True):
                if (part, lang) != now:
                    yield from done()
                    now, header, state, terms, held, terms_of_lang = (part, lang), [], None, [], [], 0
                if term == "":
                    header.append((source, n))
                    terms_of_lang = v
                    continue
                if state is None:
                    state = _Lang([s for s, _ in header], [n for _, n in header], terms_of_lang, top)
                if not terms or term != terms[-1]:
                    if len(terms) * len(state.sources) >= CELLS:
                        flush()
                    terms.append(term)
                held.append((len(terms) - 1, state.index[source], n))
        yield from done()

    return scan


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank for each (lang, source) of docs (columns text, lang, source).

    A term is kept for a language if at least `least` of its documents have it; `top` terms a source are returned.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    folds = read.mapInArrow(_folded, "lang string, term string, source string, fold long, df long, n long")
    order = ("term", "lang", "source", "fold")  # the term first: most rows differ in it
    runs = folds.repartition(parts, "lang", "term").sortWithinPartitions(*order).mapInArrow(_kept(least), "lang string, term string, source string, n long, first long")
    kept = saved(runs, "kept")

    groups = saved(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v")), "groups")
    pairs = groups.groupBy("lang").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    many = max(1, -(-kept.count() // max(PART, pairs)))  # so that partial pairs are fewer than rows
    vocabulary = groups.groupBy("lang").agg(F.sum("v").alias("v"))
    every = F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("part")
    header = groups.drop("v").join(vocabulary, "lang").select(every, "lang", F.lit("").alias("term"), "source", "n", "v")
    body = kept.where("term != ''").select(F.pmod(F.hash("lang", "term"), F.lit(many)).alias("part"), "lang", "term", "source", "n", F.lit(None).cast("long").alias("v"))
    dealt = header.unionByName(body).repartition(parts, "part").sortWithinPartitions("part", "lang", "term", "source")
    found = saved(dealt.mapInArrow(_partials(top), "lang string, source string, part string, item string, value long"), "partials")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "part", "value", both).select("lang", "source", "part", "item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by).alias("rank")
    terms = found.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return pairs.select("*", rank).unionByName(terms)
