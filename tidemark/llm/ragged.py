"""Words of many texts as numpy arrays: positions, hashes, windows. Used inside tasks, on a bounded chunk at a time."""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_B, _B_INV)):
            table = np.full(max(n, 1 << 20), base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * B**i, from which range_hash takes the hash of any range."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mixed hash of each range [start, end) of what sums were made of, whatever its place."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Words:
    """The words of texts that are given as bytes with single spaces between words; texts without words are not allowed.

    data: all bytes, a line feed behind each text; start, end: of each word; text: which text it is of; first: each text's first word, and one more.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
        self.end = np.flatnonzero((self.data == 32) | (self.data == 10))
        self.start = np.concatenate([np.zeros(1, np.int64), self.end[:-1] + 1]) if len(self.end) else self.end
        last = self.data[self.end] == 10
        self.first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(last) + 1])
        self.text = np.cumsum(last) - last
        self.hash = np.empty(len(self.start), np.uint64)
        cuts = np.flatnonzero(np.diff(self.end // (1 << 20), prepend=-1, append=1 << 62))
        for i, j in zip(cuts, cuts[1:], strict=False):  # in pieces of about 1 MB, as the sums take 8 bytes a byte
            lo = self.start[i]
            self.hash[i:j] = range_hash(prefix_sums(self.data[lo : self.end[j - 1]].astype(np.uint64)), self.start[i:j] - lo, self.end[i:j] - lo)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of n words inside a text, and their hashes."""
        at = np.arange(max(0, len(self.start) - n + 1))
        at = at[self.text[at] == self.text[at + n - 1]]
        return at, range_hash(prefix_sums(self.hash), at, at + n)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one behind the other."""
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0)
    return data[at + np.repeat(start - (ends - length), length)]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Whether data[a:a+length] equals data[b:b+length], for each triple."""
    out = np.ones(len(a), bool)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(length) // step)) + 1), len(a)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            n = length[lo:hi]
            differ = gather(data, a[lo:hi], n) != gather(data, b[lo:hi], n)
            bad = np.flatnonzero(differ)
            out[lo + np.searchsorted(np.cumsum(n), bad, side="right")] = False
    return out


def chunks(ids, texts, most: int = 1 << 20):
    """Lists of (id, bytes) of about `most` bytes in all."""
    held, size = [], 0
    for k, x in zip(ids, texts, strict=True):
        held.append((k, x))
        size += len(x)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
