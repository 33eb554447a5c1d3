"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefix that the model's compiled character map knows, character by character else,
and every normalised byte keeps the byte of the text that it came from. The normalised text falls apart at its space
symbols (proven offline: no piece of the vocabulary holds one after another character), the library merges each part
(once per distinct part and worker, within a bounded memo), and each piece's span is read off the alignment.

Results: null texts count as empty; begin and end ids have empty spans at the text's ends. Characters without a piece
become byte pieces, of which the last has the character's span and those before it empty ones, so that the spans of a
text tile what the normalisation kept. Texts of any length are handled whole. Every input row gives one row, repeated
rows, null ids and an empty table included; a column of `keep` that is named as a result is refused.

Models: byte-pair merging with byte fallback, without symbols defined by the user; others are refused.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Distinct parts that a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 400_000, 64
#: An output batch goes out beyond so many bytes of text.
BATCH = 4 << 20


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 keys whose values are places of replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = array("I", blob[4 : 4 + size])
        self.texts = blob[4 + size :]
        root = self._base(self.units[0])
        self.starts = frozenset(c for c in range(1, 256) if (root ^ c) < len(self.units) and self.units[root ^ c] & 0x800000FF == c)

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of text[at:], and the prefix's length."""
        units, node, found = self.units, self._base(self.units[0]), None
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            leaf = units[node] & 0x100
            node ^= self._base(units[node])
            if leaf:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tidemark-byte", _one_by_one)


class Pieces:
    """A model read for encoding and decoding; one for each worker process."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        train, norm = model.trainer_spec, model.normalizer_spec
        if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix or not norm.escape_whitespaces or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path}: only BPE models with byte fallback, escaped spaces and no symbols of the user's own can be encoded")
        self.map = CharMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.dummy, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.begin, self.end = train.bos_id, train.eos_id
        byte = {k: int(p.piece[3:5], 16) for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        shown = {kinds.CONTROL: lambda p: b"", kinds.UNKNOWN: lambda p: train.unk_surface.encode(), kinds.BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surface = [shown.get(p.type, lambda x: x.replace(SPACE, " ").encode())(p.piece) for p in model.pieces]
        self.is_byte = frozenset(byte)
        self.size = np.array([len(p.piece.encode()) * (p.type == kinds.NORMAL) for p in model.pieces], np.int64)
        self.lead = np.array([0 if k not in byte or 0x80 <= byte[k] < 0xC0 else 1 + (byte[k] >= 0xC0) + (byte[k] >= 0xE0) + (byte[k] >= 0xF0) for k in range(len(model.pieces))])
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces if p.type == kinds.NORMAL)  # the offline proof
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"(?s).+").findall
        norm.Clear()  # from here on the library merges what is already normalised
        norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", False, False, False
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()).encode
        self.memo: dict[str, bytes] = {}

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of text that it comes from."""
        if self.map is None and not self.squeeze:
            raw = np.frombuffer(text, np.uint8)
            origin = np.append(np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1)), len(raw))
            head = SPACE.encode() if self.dummy and text else b""
            return head + text.replace(b" ", SPACE.encode()), np.append(np.zeros(len(head), np.int64), origin)
        out, origin, at, blank = bytearray(), array("q"), 0, self.squeeze
        started = False
        while at < len(text):
            hit = self.map.longest(text, at) if self.map and text[at] in self.map.starts else None
            if hit is None:
                c = text[at]
                n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                hit = text[at : at + n], n
            put, n = hit
            if not started and not (self.squeeze and put == b" "):
                started = True
                if self.dummy:
                    out += SPACE.encode()
                    origin.extend([at] * 3)
            if started:
                if blank:
                    put = put.lstrip(b" ")
                if put:
                    shown = put.replace(b" ", SPACE.encode())
                    out += shown
                    origin.extend([at] * len(shown))
                    blank = self.squeeze and put.endswith(b" ")
            at += n
        origin.append(at)
        if self.squeeze:
            bare = len(out)
            while out[:bare].endswith(SPACE.encode()):
                bare -= 3
            del out[bare:], origin[bare + 1 :]
        return bytes(out), np.array(origin, np.int64)

    def merged(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each part; the library merges those that the memo does not have."""
        memo = self.memo
        if new := list(set(parts).difference(memo)):
            if len(memo) > MEMO:
                memo.clear()
                new = list(set(parts))
            for p, ids in zip(new, self.merge(new, num_threads=1), strict=True):
                memo[p] = array("I", ids).tobytes()
        out = list(map(memo.__getitem__, parts))
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return out

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes that each piece covers; of byte pieces, a character's last one covers all of it."""
        out = self.size[ids]
        lead = self.lead[ids]
        at = np.flatnonzero(lead)
        out[at + lead[at] - 1] = lead[at]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end, and where each piece starts and ends in the text's UTF-8 bytes."""
        raw = text.encode()
        normal, origin = self.normalised(raw)
        ids = np.frombuffer(b"".join(self.merged(self.parts(normal.decode()))), np.uint32)
        at = origin[np.append(0, np.cumsum(self.lengths(ids)))]
        return np.concatenate(([self.begin], ids, [self.end])), np.concatenate(([0], at[:-1], [len(raw)])), np.concatenate(([0], at[1:], [len(raw)]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, one each."""
        shown = list(map(self.surface.__getitem__, ids.tolist()))
        if self.dummy or self.squeeze:
            for k, x in enumerate(shown):  # spaces before the first text go: one, or all that lead each piece if spaces are squeezed
                if x and ids[k] not in self.is_byte:
                    shown[k] = x[1:] if x.startswith(b" ") else x
                    if (x.startswith(b" ") and not self.squeeze) or shown[k]:
                        break
                elif x:
                    break
        joined = b"".join(shown)
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return joined.decode(errors="tidemark-byte")


def _column(parts: list[np.ndarray], packed: bool) -> pa.Array:
    if packed:
        return pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary())
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)))


def _fields(df: DataFrame, keep: tuple[str, ...], results: tuple[str, ...]) -> str:
    if clash := {x.lower() for x in keep} & {x.lower() for x in results}:
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)


def encode(df: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = (), packed: bool = False, round_trip: bool = False) -> DataFrame:
    """The columns of `keep`, and ids, starts and ends (byte spans in the text) of each row's pieces, begin and end ids included.

    They are arrays of integers, or, if packed, binaries of little-endian unsigned 32-bit numbers, as token files hold them.
    With round_trip there is decoded, too: the text that the ids give.
    """
    kind, back = "binary" if packed else "array<int>", ["decoded"] * round_trip
    schema = f"{_fields(df, keep, ('ids', 'starts', 'ends', *back))}ids {kind}, starts {kind}, ends {kind}" + ", decoded string" * round_trip
    names = [*keep, "ids", "starts", "ends", *back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for b in batches:
            done, size, found = 0, 0, []
            for k, x in enumerate(b.column("__text")):
                value = x.as_py() or ""
                found.append(pieces.encode(value))
                size += len(value)
                if size > BATCH or k == b.num_rows - 1:
                    columns = [b.column(c).slice(done, len(found)) for c in range(len(keep))] + [_column(list(c), packed) for c in zip(*found, strict=True)]
                    if round_trip:
                        columns.append(pa.array([pieces.decode(ids) for ids, *_ in found], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    done, size, found = k + 1, 0, []

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of `keep`, and decoded: the text of each row's ids (an array, or packed; null: no ids)."""
    schema = f"{_fields(df, keep, ('decoded',))}decoded string"
    packed = dict(df.dtypes)[ids] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for b in batches:
            values = [x.as_py() if packed else x.values and x.values.to_numpy() for x in b.column("__ids")]
            texts = [pieces.decode(np.frombuffer(x, "<u4") if packed else x) if x is not None and len(x) else "" for x in values]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], [*keep, "decoded"])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)
