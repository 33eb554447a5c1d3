"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams (with marks for its ends), so a misspelling or an unseen ending shares
most vectors with what was seen. A segment of a document is the mean of its words' n-gram vectors, and a softmax over that
mean gives its class. Embeddings and softmax are trained together by gradient descent. As one insult in a long text would
drown in the mean of all words, texts are cut into segments of SEGMENT words (the last one reaches back, so that all are
equally long) and a document scores as its worst segment; in training, too, a document's gradient goes to its worst segment.
With a segment longer than any text the score is the plain mean of all words.

The model is fitted in one task on a sample of labelled rows that is bounded by rows alone (`max_rows` documents of each
class, picked by a hash of the text); texts are learned from whole. Tasks cut them into words; the driver gets the weights.
Scoring covers all rows and whole texts, in tasks, with the model folded into one number for each n-gram bucket (mean and
softmax are linear), whatever the number of documents.

Unspaced runs count as one word up to PIECE characters; longer ones are cut into pieces that overlap by as much as the
longest n-gram needs, each a word, so that every n-gram of a run is seen and no insult drowns in a long run.

Results: null, empty and wordless texts score as the model's bias alone. Unlabelled rows, null labels and labels other
than 0 and 1 are not learned from; nor are held-out ones. Every row gives one row, null and repeated ids included.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)
SEGMENT = 16
#: Characters of a piece of a long run, the marks for its ends included.
PIECE = 66
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_MEMO = 300_000
#: Rows that a worker sends back together.
SLICE = 1_000
#: Segments that training scores together.
PART = 20_000
#: Words that a scorer looks up together; words and bytes whose n-grams are hashed together.
LOOKUP, HASHED, HASHED_BYTES = 100_000, 1 << 13, 1 << 16
#: Of CRC-32, by byte.
_CRC = np.array([crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)], np.uint32)


@dataclass
class Model:
    """logit of a segment = mean over its n-grams of weight[bucket], + bias."""

    weight: np.ndarray
    bias: float


def n_grams(word: str) -> np.ndarray:
    """Buckets of a marked word's character n-grams and of the whole word."""
    w = word.encode()
    grams = {w} | {w[i : i + n] for n in SIZES for i in range(len(w) - n + 1)}
    return np.array([crc32(g) % BUCKETS for g in sorted(grams)], np.int32)


def _hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n_grams of at most HASHED words, none empty, one word's behind the other's, and how many each word has.

    An n-gram is a number: its word's place (13 bits), its first six bytes (48 bits), its length (3 bits; 7 for any word of more than six bytes), so numbers sort as the words' n-grams do.
    """
    n = np.array([len(w) for w in words])
    end = np.cumsum(n)
    of = np.repeat(np.arange(len(words), dtype=np.uint64), n)
    data = np.frombuffer(b"".join(words) + bytes(6), np.uint8)
    left = np.repeat(end, n) - np.arange(len(of))
    six = sum(data[k : k + len(of)].astype(np.uint64) << np.uint64(40 - 8 * k) for k in range(6))

    def number(at: np.ndarray, size) -> np.ndarray:
        """Of the n-grams of these lengths that begin at these bytes."""
        size = np.broadcast_to(np.asarray(size), len(at)).astype(np.uint64)
        drop = np.uint64(48) - np.uint64(8) * np.minimum(size, np.uint64(6))
        return of[at] << np.uint64(51) | six[at] >> drop << drop << np.uint64(3) | np.minimum(size, np.uint64(7))

    grams = np.concatenate([number(end - n, n), *(number(np.flatnonzero(left >= size), size) for size in SIZES)])
    grams.sort()
    grams = grams[np.diff(grams, prepend=~grams[:1]) != 0]  # a repeated n-gram counts once
    size = grams & np.uint64(7)
    crc = np.full(len(grams), 0xFFFFFFFF, np.uint32)
    for k in range(6):
        byte = (grams >> np.uint64(43 - 8 * k)).astype(np.uint32)
        crc = np.where(size > k, _CRC[(crc ^ byte) & 255] ^ crc >> 8, crc)
    crc = ~crc
    crc[size == 7] = [crc32(w) for w in words if len(w) > 6]
    return (crc % BUCKETS).astype(np.int32), np.bincount((grams >> np.uint64(51)).astype(np.int64), minlength=len(words))


def n_grams_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """n_grams of many words without Python's loops over n-grams: for parts of the words, in order, the buckets of all words and how many each word has."""
    part, size = [], 0
    for word in words:
        w = word.encode()
        if part and (len(part) == HASHED or size + len(w) > HASHED_BYTES):
            yield _hashed(part)
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield _hashed(part)


def marked_words(text: str | None) -> list[str]:
    """The lower-case words of a text with marks for their ends, long runs in pieces."""
    out = []
    for word in _WORD.findall(text.lower()) if text else []:
        w = f"<{word}>"
        if len(w) <= PIECE:
            out.append(w)
        else:
            step = PIECE - max(SIZES) + 1
            out += [w[i : i + PIECE] for i in range(0, len(w) - max(SIZES) + 1, step)]
    return out


def _segment_starts(n: int, segment: int) -> np.ndarray:
    """Where the segments of a text of n words begin; a text of fewer words than a segment has one, a wordless one an empty one."""
    return np.minimum(np.arange(0, max(n, 1), segment), max(0, n - segment))


def _segments(words: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a text's segments, one behind the other, and how many each has."""
    starts = _segment_starts(len(words), segment)
    size = min(segment, len(words))
    return words[(starts[:, None] + np.arange(size)).ravel()], np.full(len(starts), size)


def _ragged(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of some rows of a ragged array, and which of the rows each is of."""
    n = starts[rows + 1] - starts[rows]
    at = np.arange(n.sum()) + np.repeat(starts[rows] - (np.cumsum(n) - n), n)
    return flat[at], np.repeat(np.arange(len(rows)), n)


def fit(docs: list[np.ndarray], vocabulary: list[str], toxic: np.ndarray, dim: int = 16, epochs: int = 12, rate: float = 0.5, batch: int = 256, seed: int = 7, segment: int = SEGMENT) -> Model:
    """Jointly trained embeddings (BUCKETS x dim) and softmax (dim x 2), by Adagrad; classes weigh as in the sample.

    docs: the numbers of each document's words in vocabulary.
    """
    rng = np.random.default_rng(seed)
    parts = [*n_grams_of(vocabulary)]
    grams = np.concatenate([np.zeros(0, np.int64), *(g for g, _ in parts)])
    gram_n = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
    gram_at = np.concatenate([[0], np.cumsum(gram_n)])
    cut = [_segments(d, segment) for d in docs]
    seg_words = np.concatenate([w for w, _ in cut])
    doc_segs = np.concatenate([[0], np.cumsum([len(n) for _, n in cut])])
    seg_at = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in cut]))])
    n_docs = len(docs)
    del cut, docs, vocabulary, parts
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.log(np.maximum(np.bincount(toxic, minlength=2), 1) / max(1, len(toxic))).astype(np.float32)
    sq_emb, sq_soft, sq_bias = np.full(BUCKETS, 1e-4, np.float32), np.full((dim, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    for epoch in range(epochs):
        # n-gram weights of this epoch pick each document's worst segment
        line = emb @ (soft[:, 1] - soft[:, 0])
        word_sum = np.add.reduceat(line[grams], gram_at[:-1]) if len(grams) else np.zeros(0)
        score = np.empty(len(seg_at) - 1)
        for lo in range(0, len(score), PART):  # in parts: all words of all documents are many
            hi = min(lo + PART, len(score))
            words, of = seg_words[seg_at[lo] : seg_at[hi]], np.repeat(np.arange(hi - lo), np.diff(seg_at[lo : hi + 1]))
            score[lo:hi] = np.bincount(of, word_sum[words], hi - lo) / np.maximum(np.bincount(of, gram_n[words], hi - lo), 1)
        order = np.lexsort((score, np.repeat(np.arange(n_docs), np.diff(doc_segs))))
        worst = order[doc_segs[1:] - 1]
        pick = rng.permutation(n_docs)
        for lo in range(0, n_docs, batch):
            rows = pick[lo : lo + batch]
            y = toxic[rows]
            seg = worst[rows]
            ws, wd = _ragged(seg_words, seg_at, seg)
            g, gw = _ragged(grams, gram_at, ws)
            gd = wd[gw]
            n = np.maximum(np.bincount(gd, minlength=len(rows)), 1).astype(np.float32)
            mean = np.zeros((len(rows), dim), np.float32)
            np.add.at(mean, gd, emb[g])
            mean /= n[:, None]
            z = mean @ soft + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y] -= 1
            d_soft, d_bias, d_mean = mean.T @ p / len(rows), p.mean(axis=0), (p @ soft.T) / n[:, None]
            uniq, inv = np.unique(g, return_inverse=True)
            d_emb = np.zeros((len(uniq), dim), np.float32)
            np.add.at(d_emb, inv, d_mean[gd])
            sq_soft += d_soft**2
            sq_bias += d_bias**2
            sq_emb[uniq] += (d_emb**2).mean(axis=1)
            soft -= rate * 0.2 * d_soft / np.sqrt(sq_soft)
            bias -= rate * 0.1 * d_bias / np.sqrt(sq_bias)
            emb[uniq] -= rate * d_emb / np.sqrt(sq_emb[uniq])[:, None]
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class _Numbers(dict):
    """Numbers of words; a new word gets the next one and is noted in `fresh`."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Scorer:
    """Scores texts; one for each worker process. Words that it has met keep their sums of weights, up to _MEMO words and those of one lookup."""

    def __init__(self, model: Model, segment: int = SEGMENT):
        self.model, self.segment = model, segment
        self.clear()

    def clear(self) -> None:
        self.number, self.sums, self.sizes = _Numbers(), np.zeros(0), np.zeros(0, np.int64)

    def _weigh(self) -> None:
        """Fresh words get their sums of weights and numbers of n-grams."""
        sums, sizes = [self.sums], [self.sizes]
        for grams, n in n_grams_of(self.number.fresh):
            at = np.cumsum(n) - n
            sums.append(np.add.reduceat(np.insert(self.model.weight[grams], at, 0), at + np.arange(len(n))))  # each word's sum begins with 0, so that it is the one of sum(), to the bit
            sizes.append(n)
        self.number.fresh.clear()
        self.sums, self.sizes = np.concatenate(sums), np.concatenate(sizes)

    def _worst(self, words: np.ndarray) -> float:
        """The worst segment's mean weight in a text of these words."""
        if not len(words):
            return 0.0
        sums, sizes = (np.concatenate([[0], np.cumsum(x[words])]) for x in (self.sums, self.sizes))
        at = _segment_starts(len(words), self.segment)
        to = np.minimum(at + self.segment, len(words))
        return ((sums[to] - sums[at]) / (sizes[to] - sizes[at])).max()

    def _scores(self, texts: list[np.ndarray]) -> list[float]:
        self._weigh()
        worst = np.array([self._worst(x) for x in texts])
        if len(self.number) >= _MEMO:
            self.clear()
        return (1 / (1 + np.exp(-np.clip(worst + self.model.bias, -60, 60)))).tolist()

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        out, held, n = [], [], 0
        for text in texts:
            words = marked_words(text)
            held.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            n += len(words)
            if n >= LOOKUP:
                out += self._scores(held)
                held, n = [], 0
        return out + self._scores(held)

    def __call__(self, text: str | None) -> float:
        return self.scores([text])[0]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learned(texted: DataFrame, segment: int) -> tuple[Model, list[int]] | None:
    """A model of rows of id, mark, y and text, and how many of each class there were; None without rows. One task learns: the rows are a bounded sample, and the driver gets the weights alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [marked_words(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("mark"), b.column("id"), b.column("y"), pa.array(words, pa.list_(pa.string()))], ["mark", "id", "y", "words"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, int] = {}
        docs, keys = [], []
        for b in batches:
            docs += [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in x.as_py()], np.int32) for x in b.column("words")]
            keys += zip(*(b.column(c).to_pylist() for c in ("y", "mark", "id")), strict=True)
        if docs:
            order = sorted(range(len(keys)), key=keys.__getitem__)
            y = np.array([keys[k][0] for k in order], np.int64)
            model = fit([docs[k] for k in order], [*vocabulary], y, segment=segment)
            n = np.bincount(y, minlength=2).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()]), pa.array([model.bias]), pa.array([n[0]]), pa.array([n[1]])], ["weight", "bias", "n0", "n1"])

    part = texted.select("mark", "id", "y", "text")
    words = part.mapInArrow(run, f"mark long, id {part.schema['id'].dataType.simpleString()}, y int, words array<string>")
    row = words.repartition(1).mapInArrow(learn, "weight binary, bias double, n0 long, n1 long").first()
    return None if row is None else (Model(np.frombuffer(row["weight"], np.float32).copy(), row["bias"]), [row["n0"], row["n1"]])


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 4000, segment: int = SEGMENT) -> Model:
    """A model of at most max_rows labelled documents of each class, in the order of a hash of their text; more toxic rows or fewer, the bias is set for the classes' share among all labelled rows."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    mark = F.xxhash64(text)
    rows = df.where(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), mark.alias("mark")).dropDuplicates(["id", "mark"]).join(known, "id")  # equal rows are learned from once
    rows = saved(rows.select("id", "mark", F.col("y").cast("int").alias("y")), "labelled")  # no texts: those of the picked rows come after
    share = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [rows.where(F.col("y") == c).orderBy("mark", "id").limit(max_rows) for c in (0, 1)]
    picked = F.broadcast(saved(picked[0].union(picked[1]), "picked"))  # at most 2 * max_rows rows
    texted = df.select(F.col(doc_id).alias("id"), mark.alias("mark"), F.col(text).alias("text")).join(picked, ["id", "mark"]).dropDuplicates(["id", "mark"])
    learned = _learned(texted, segment)
    if learned is None:
        return Model(np.zeros(BUCKETS, np.float32), -3.0)
    model, n = learned
    in_sample, in_all = (max(n[1], 1) / max(n[0], 1), max(share.get(1, 0), 1) / max(share.get(0, 0), 1))
    model.bias += float(np.log(in_all / in_sample))
    return model


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3, segment: int = SEGMENT) -> DataFrame:
    """The columns of `keep`, score, predicted (1 if score >= threshold) for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = text in keep  # a text that is kept goes to the workers once
    rows = df.select(*keep) if own else df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, segment)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                rest = [k for k, name in enumerate(b.schema.names) if name != "__text"]
                scores = pa.array(scorer.scores(x.as_py() for x in b.column(b.schema.get_field_index(text if own else "__text"))), pa.float64())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), scores], [*(b.schema.names[k] for k in rest), "score"])
            b = whole = None
        scorer.clear()  # a worker that waits for its next task holds nothing of this one
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
