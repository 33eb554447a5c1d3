"""Language-model scoring by cross-entropy difference, with word bigrams over the whole corpus's vocabulary.

Two models of one order, smoothing and vocabulary are counted: a target model on documents known to be good and a background
model on all documents. A document's score is the mean, over its tokens, of its loss under the target minus its loss under
the background: the lower, the more it is like the target.

Tokens are runs between white space (with a mark for the start and the end of a text). The vocabulary is every word of the
corpus, without a cut-off, and what is gathered, all words and all bigrams, grows with the corpus. It never comes to the
driver, nor whole to any task:

1. Rows are packed into chunks of about CHUNK bytes of text, written with all that they carry.
2. Each chunk sends its distinct words and bigrams, with their counts, to buckets by hash: one entry a chunk, so a word that
   is in every text costs a bucket as many entries as there are chunks.
3. A bucket adds the counts up and answers every chunk, entry by entry, in the order in which the chunk has asked.
4. Chunks meet their answers and score their texts.

A bucket holds about BUCKET_BYTES of text, whatever the size of the corpus.

P(c | b) = (n(bc) + BACK * P(c)) / (n(b) + BACK) and P(c) = (n(c) + 1) / (N + V), with N tokens in the model's texts and V
distinct words in the corpus. Words and bigrams are told apart by hashes of MARGIN bits more than the corpus has bytes (up to
64 bits), so that one in 2**MARGIN shares its counts with another, whatever the size of the corpus. Chunks send them sorted, as
differences; answers hold what is beyond the chunk's own counts, which for most bigrams is nothing.

Results: null texts count as empty (one token, the end mark). Labels other than the target's and null ones do not count. With
no target document at all, every score is 0. Every row gives one row; repeated rows count as often as they occur. An empty
table gives no rows. Other columns do not matter, those of `keep` may have any name but those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved
from tidemark.llm.ragged import Words, mix

CHUNK = 1 << 20
BUCKET_BYTES = 16 << 20
MARGIN = 20
BACK = 4.0
_EDGE = np.uint64(0x51ED270B7F4A7C15)  # the mark's hash
_TEXT, _GOOD = "__text", "__good"
_ANSWER = "chunk long, bucket int, n binary, good binary, kinds long, total long, of_good long"


def _zip(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, compressed byte by byte place, as high bytes are mostly alike."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return planes.nbytes.to_bytes(8, "little") + pa.Codec("zstd", 3).compress(planes.tobytes(), asbytes=True)


def _unzip(x: bytes) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    raw = pa.Codec("zstd").decompress(x[8:], size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size (bytes of text and marks) and blob (the rows, as compressed Arrow) of chunks of rows."""
    for b in batches:
        text = b.column(b.schema.get_field_index(_TEXT))
        size = np.array(pc.binary_length(text.fill_null("")).to_numpy(zero_copy_only=False), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK, prepend=0)) + 1
        cuts = np.unique([0, *cuts, len(b)])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array([int(size[lo:hi].sum() + hi - lo)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["size", "blob"])


class Chunk:
    """A chunk's rows and the hashes of its words and bigrams: for each bigram, `word` (of its second word) and `before`, and where each text's begin."""

    def __init__(self, blob: bytes, bits: int):
        (self.rows,) = pa.ipc.open_stream(blob)
        text = self.rows.column(self.rows.schema.get_field_index(_TEXT))
        w = Words([b" ".join([b"|", *(x.as_py() or "").encode().split(), b"|"]) for x in text])
        hashed = mix(w.hash + np.uint64(1))
        hashed[w.first[:-1]] = hashed[w.first[1:] - 1] = _EDGE
        at = np.flatnonzero(w.text[:-1] == w.text[1:])
        pair = mix(mix(hashed[at]) * np.uint64(0x9E3779B97F4A7C15) + hashed[at + 1])
        self.before, self.word, self.pair = (x >> np.uint64(64 - bits) for x in (hashed[at], hashed[at + 1], pair))
        self.start = w.first[:-1] - np.arange(len(text))
        self.size = np.diff(np.append(self.start, len(at)))

    def column(self, name: str) -> pa.Array:
        return self.rows.column(self.rows.schema.get_field_index(name))


def _cuts(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where the keys (sorted) of each bucket begin, and one more; a bucket is a range of hashes."""
    return np.searchsorted((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1).astype(np.uint64))


def _ask(bits: int, buckets: int):
    """bucket, chunk, words (how many of the keys), keys, n, good: what each chunk has counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, blob in zip(b.column("chunk").to_pylist(), b.column("blob"), strict=True):
                c = Chunk(blob.as_py(), bits)
                of_good = np.repeat(c.column(_GOOD).to_numpy(zero_copy_only=False).astype(float), c.size)
                parts = []
                for hashes in (c.word, c.pair):
                    keys, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
                    parts.append((keys, n.astype(np.int64), np.bincount(which, of_good, len(keys)).astype(np.int64), _cuts(keys, bits, buckets)))
                rows: list[tuple] = []
                for k in range(buckets):
                    own = [tuple(x[cut[k] : cut[k + 1]] for x in values) for *values, cut in parts]
                    keys, n, good = (np.concatenate(x) for x in zip(*own, strict=True))
                    if len(keys):
                        rows.append((k, number, len(own[0][0]), _zip(np.diff(keys, prepend=np.uint64(0))), _zip(n), _zip(good)))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "chunk", "words", "keys", "n", "good"])

    return run


def _answer(t: pa.Table) -> pa.Table:
    """For every row of a bucket what the rest of the bucket has of its keys, and a row for the bucket (chunk -1): distinct words, their number in all and in good texts."""
    t = t.combine_chunks()
    keys = [np.cumsum(_unzip(x).view(np.uint64)) for x in t.column("keys").to_pylist()]
    words = t.column("words").to_pylist()
    counts = [[_unzip(x) for x in t.column(c).to_pylist()] for c in ("n", "good")]
    sums: list[list[list[np.ndarray]]] = [[], []]  # by count, kind, row
    whole = [0, 0, 0]
    for kind in (0, 1):
        part = lambda x, m: x[:m] if kind == 0 else x[m:]  # noqa: B023, E731
        own = [part(k, m) for k, m in zip(keys, words, strict=True)]
        distinct, which = np.unique(np.concatenate(own), return_inverse=True)
        ends = np.cumsum([len(k) for k in own])[:-1]
        for i in (0, 1):
            each = np.concatenate([part(x, m) for x, m in zip(counts[i], words, strict=True)])
            total = np.bincount(which, each.astype(float), len(distinct)).astype(np.int64)
            sums[i].append(np.split(total[which] - each, ends))
            if kind == 0:
                whole[i + 1] = int(total.sum())
        if kind == 0:
            whole[0] = len(distinct)
    n, good = ([_zip(np.concatenate(x)) for x in zip(*s, strict=True)] for s in sums)
    none = [None] * len(keys)
    cols = [t.column("chunk").to_pylist() + [-1], t.column("bucket").to_pylist() + [None], [*n, None], [*good, None], *([*none, x] for x in whole)]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _ANSWER.split(", ")])


def _score(bits: int, buckets: int, vocabulary: int, total: int, of_target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, answers in zip(b.column("blob"), b.column("answers"), strict=True):
                c = Chunk(blob.as_py(), bits)
                by_bucket = {a["bucket"]: (_unzip(a["n"]), _unzip(a["good"])) for a in answers.as_py()}
                of_good = np.repeat(c.column(_GOOD).to_numpy(zero_copy_only=False).astype(float), c.size)
                uniques = [np.unique(x, return_inverse=True, return_counts=True) for x in (c.word, c.pair)]
                cut = _cuts(uniques[0][0], bits, buckets)
                # every word of a text stands before another, and the mark stands before as many as it ends
                at = np.searchsorted(uniques[0][0], c.before)
                looked = []
                for i in (0, 1):
                    rest = ([], [])
                    for k in sorted(by_bucket):
                        m = cut[k + 1] - cut[k]
                        rest[0].append(by_bucket[k][i][:m])
                        rest[1].append(by_bucket[k][i][m:])
                    own = [n if i == 0 else np.bincount(which, of_good, len(keys)).astype(np.int64) for keys, which, n in uniques]
                    word, pair = (o + np.concatenate(r) for o, r in zip(own, rest, strict=True))
                    looked.append((word[uniques[0][1]], pair[uniques[1][1]], word[at]))
                losses = []
                for (word, pair, before), size in ((looked[1 if of_target else 0], of_target or total), (looked[0], total)):
                    p = (pair + BACK * (word + 1) / (size + vocabulary)) / (before + BACK)
                    losses.append(np.add.reduceat(-np.log(p), c.start) / c.size)
                rest = [i for i, name in enumerate(c.rows.schema.names) if name not in (_TEXT, _GOOD)]
                new = [pa.array(c.size, pa.int64()), *map(pa.array, losses), pa.array(losses[0] - losses[1])]
                yield pa.RecordBatch.from_arrays([*(c.rows.column(i) for i in rest), *new], [*(c.rows.schema.names[i] for i in rest), "n_tokens", "target_loss", "background_loss", "score"])

    return run


def cross_entropy_difference(df: DataFrame, target: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, n_tokens, target_loss, background_loss (nats a token), score for each row of df; target: a boolean column."""
    rows = df.select(*keep, F.col(text).alias(_TEXT), F.coalesce(F.col(target), F.lit(False)).alias(_GOOD))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), "n_tokens long, target_loss double, background_loss double, score double"])
    chunks = saved(rows.mapInArrow(_pack, "size long, blob binary").withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    bits, buckets = min(64, max(40, size.bit_length() + MARGIN)), max(16, -(-size // BUCKET_BYTES))
    asked = chunks.select("chunk", "blob").mapInArrow(_ask(bits, buckets), "bucket int, chunk long, words int, keys binary, n binary, good binary")
    answers = saved(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER), "answers")
    whole = answers.where("chunk = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kinds", "total", "of_good"))).first()
    by_chunk = answers.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "good")).alias("answers"))
    return chunks.select("chunk", "blob").join(by_chunk, "chunk").select("blob", "answers").mapInArrow(_score(bits, buckets, whole["kinds"], whole["total"], whole["of_good"]), schema)
