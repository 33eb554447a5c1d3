"""Token counts by the whole-token shortcut.

A vocabulary string that is proven offline to encode alone as exactly one token needs no merging when it turns up as a
pre-token. Texts are split into pre-tokens, pre-tokens of the proven set count one each, and only the rest is merged
(once per distinct pre-token and worker, within a bounded memo).

Results: null texts count as empty (0 tokens); texts of any length are handled whole; special strings inside a text are
one token each, as the library's default has it. Every input row gives one row, repeated rows and null ids included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of byte-level BPE (fixed value, as published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these code points alone are split here; others by the library, whose Unicode tables may be older or newer.
_STABLE = regex.compile(r"[\x00-\x1b\x20-\x7e\xa1-ɏ‐-‧]*+")
_MEMO = 400_000


def load(path: str):
    """The tokenizer without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def whole_tokens(path: str) -> list[str]:
    """Offline proof: the vocabulary's strings that the tokenizer encodes, alone, as one token. As many as the vocabulary at most."""
    t = load(path)
    special = {x.content for x in t.get_added_tokens_decoder().values()}
    ids = sorted(t.get_vocab().values())
    strings = t.decode_batch([[i] for i in ids], skip_special_tokens=False)
    tried = [(i, s) for i, s in zip(ids, strings, strict=True) if s and "�" not in s and s not in special]
    coded = t.encode_batch([s for _, s in tried], add_special_tokens=False)
    return [s for (i, s), e in zip(tried, coded, strict=True) if e.ids == [i] and PRE.fullmatch(s)]


PRE = regex.compile(PATTERN)


class Counter:
    """Counts the tokens of texts; one for each worker process."""

    def __init__(self, path: str, whole: list[str]):
        self.t = load(path)
        self.whole = frozenset(whole)
        special = sorted((x.content for x in self.t.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if _STABLE.fullmatch(text):
            return PRE.findall(text)
        return [text[a:b] for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self.part(x) for x in parts if x)

    def part(self, text: str) -> int:
        pre = self.pre_tokens(text)
        rest = [x for x in pre if x not in self.whole]
        new = list(set(rest).difference(self.memo))
        if new:
            if len(self.memo) > _MEMO:
                self.memo = {}
                new = list(set(rest))
            for x, e in zip(new, self.t.encode_batch(new, add_special_tokens=False), strict=True):
                self.memo[x] = len(e.ids)
        return len(pre) - len(rest) + sum(map(self.memo.__getitem__, rest))


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = (), limit: int = 1024) -> DataFrame:
    """The columns of `keep`, and n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), for each row of df."""
    sc = df.sparkSession.sparkContext
    whole = sc.broadcast(whole_tokens(tokenizer))
    out = df.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != "__text"), "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        counter = Counter(tokenizer, whole.value)
        for b in batches:
            n = pa.array([counter.count(x) if x else 0 for x in b.column("__text").to_pylist()], pa.int64())
            rest = [k for k, name in enumerate(b.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), n], [*(b.schema.names[k] for k in rest), "n_tokens"])

    return out.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
