"""Words of text columns as 64-bit hashes, computed with numpy on Arrow's own buffers.

A word is a maximal run of word bytes of the UTF-8 text. Which bytes are word bytes, and how
they fold, is given by a Charset. A word's hash depends on its folded bytes only, so it is the
same in every task. Texts are worked through in blocks of a few MB, cut between words, so memory
stays a small multiple of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 19  # bytes hashed at a time
# Odd 64-bit multipliers.
BASE = 0x9E3779B97F4A7C15
STEP = 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Charset:
    """Word bytes, and whether A-Z fold to a-z."""

    word: bytes  # 256 flags
    fold: bytes  # 256 bytes


def charset(is_word, lower: bool) -> Charset:
    fold = bytes(b + 32 if lower and 65 <= b <= 90 else b for b in range(256))
    return Charset(bytes(bool(is_word(fold[b])) for b in range(256)), fold)


#: Words between ASCII white space, A-Z folded or not.
SPACED_LOWER = charset(lambda b: b != 32 and not 9 <= b <= 13, True)
SPACED = charset(lambda b: b != 32 and not 9 <= b <= 13, False)
#: Runs of ASCII letters and digits and of all beyond ASCII, A-Z folded.
ALNUM_LOWER = charset(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    if n > 1:
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


def word_starts(flag: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Flags of bytes that start a word, from flags of word bytes; a cut ends a word."""
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    cuts = cuts[cuts < len(flag)]
    first[cuts] = flag[cuts]
    return first


class Hasher:
    """Hashes the words of byte blocks; holds the tables that one worker needs."""

    def __init__(self, chars: Charset) -> None:
        self.word = np.frombuffer(chars.word, dtype=np.bool_)
        values = mix(np.arange(1, 257, dtype=U64) * U64(STEP))
        self.values = np.where(self.word, values[np.frombuffer(chars.fold, dtype=np.uint8)], U64(0))
        self.up = powers(BASE, 1)
        self.down = self.up

    def block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of each word of data; no word spans one of the cuts."""
        n = len(data)
        if not n:
            return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.up) <= n:
            self.up = powers(BASE, max(n + 1, BLOCK))
            self.down = powers(pow(BASE, -1, 1 << 64), max(n + 1, BLOCK))
        flag = self.word[data]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first = word_starts(flag, cuts)
        last = flag.copy()
        last[:-1] &= ~flag[1:]
        last[cuts - 1] = flag[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.empty(n + 1, dtype=U64)
        total[0] = 0
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts]), starts, ends


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and offsets with one more entry than rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def rows_words(column: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their words: (first row, end row, hashes, words before each row of the run and in all)."""
    data, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
        lo, hi = at[row], at[end]
        if hi - lo <= 2 * BLOCK:
            hashes, starts, _ = hasher.block(data[lo:hi], at[row:end] - lo)
            yield row, end, hashes, np.searchsorted(starts, at[row : end + 1] - lo)
        else:
            hashes = np.concatenate([h for h, _, _ in long_text(data[lo:hi], hasher)])
            yield row, end, hashes, np.array([0, len(hashes)])
        row = end


def long_text(data: np.ndarray, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of one text, a block at a time; blocks end between words."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK)
        while hi < len(data):
            gaps = np.flatnonzero(~hasher.word[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
                break
            hi = min(len(data), hi + BLOCK)  # a single word beyond a block
        hashes, starts, ends = hasher.block(data[lo:hi], np.empty(0, np.int64))
        yield hashes, starts + lo, ends + lo
        lo = hi


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of so many words; a shorter sequence is one window."""
    width = min(width, len(hashes))
    if not width:
        return hashes[:0]
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for i in range(1, width):
        out *= U64(STEP)
        out += hashes[i : i + n]
    return mix(out ^ U64(width))
