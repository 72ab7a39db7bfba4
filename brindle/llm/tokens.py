"""Token ids of texts, by a public tokenizer file, with a table of known words.

The tokenizer drops white space and treats what stands between it alone, so a text's ids are those
of its pieces between ASCII white space. Pieces of ASCII characters and Latin letters are cut into
the tokenizer's own pre-tokens, runs of letters, single digits and runs of other signs; pieces with
an apostrophe, which may begin a pre-token of its own, and all others stay whole. These units are
found, hashed and looked up with numpy over blocks of a column, and only units that aren't in the
table go to the tokenizer. Texts that aren't in Unicode's composed form, or hold a special token or
a capital sigma, whose lower case depends on its neighbours, go through it whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from brindle.llm.words import BASE, SPACED_LOWER, STEP, U64, buffers, mix, powers

CACHED = 1_000_000  # units that a table holds
BLOCK = 1 << 20  # bytes worked on at a time
SLOTS = 1 << 21  # entries of the index into a table of known units

# Characters whose pre-tokens can be told from their bytes; U+0130 has a lower case of two.
LATIN = re.compile(r"[\x21-\x26\x28-\x7eÀ-ÖØ-öø-įı-ž]+")
SPACE, LETTER, DIGIT, SIGN = range(4)


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def kinds() -> np.ndarray:
    kind = np.full(256, SIGN, np.uint8)
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    kind[48:58] = DIGIT
    kind[[32, *range(9, 14)]] = SPACE
    return kind


def whole_only(data: np.ndarray) -> np.ndarray:
    """Flags of bytes that keep a piece from being cut."""
    table = np.zeros(256, dtype=bool)
    table[[*range(9), *range(14, 32), 39, 127, 0xC0, 0xC1, 0xC2, *range(0xC6, 256)]] = True
    odd = table[data]
    second = np.flatnonzero((data >= 0x97) & (data <= 0xBF))
    second = second[second > 0]
    lead, byte = data[second - 1], data[second]
    odd[second] |= (lead == 0xC3) & ((byte == 0x97) | (byte == 0xB7)) | (lead == 0xC4) & (byte == 0xB0) | (lead == 0xC5) & (byte == 0xBF)
    return odd


class WordEncoder:
    """Ids of texts as little-endian 16-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.kinds = kinds()
        self.values = mix(np.arange(1, 257, dtype=U64) * U64(STEP))[np.frombuffer(SPACED_LOWER.fold, np.uint8)]
        self.up = self.down = powers(BASE, 1)
        self.clear()

    def clear(self) -> None:
        """The table of known units: sorted hashes, and where and how many ids each has."""
        self.hashes = np.array([2**64 - 1], U64)
        self.at = np.zeros(1, np.int64)
        self.sizes = np.zeros(1, np.int64)
        self.ids = np.empty(0, "<u2")
        self.slots = np.zeros(SLOTS, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where hashes are in the table, or any place for those that aren't."""
        place = self.slots[hashes >> U64(43)]
        other = np.flatnonzero(self.hashes[place] != hashes)
        if len(other):
            place[other] = np.minimum(np.searchsorted(self.hashes, hashes[other]), len(self.hashes) - 1)
        return place

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column; a null has none."""
        data, at = buffers(column)
        special = self.special(column, data, at)
        ids = None
        for row, end, part in self.blocks(data, at, special):
            if end - row == 1:  # perhaps one of several blocks of a long text
                ids = part[0] if ids is None else np.concatenate([ids, part[0]])
                if part[1]:
                    yield ids
                    ids = None
            else:
                yield from np.split(part[0], part[1])

    def special(self, column, data: np.ndarray, at: np.ndarray) -> set[int]:
        """Rows that go through the tokenizer whole."""
        n = len(at) - 1
        rows = set()
        for byte, text in ((0x3C, "<|"), (None, None)):
            places = np.flatnonzero(data == byte if byte else data >= 0x80)
            for i in np.unique(np.searchsorted(at, places, side="right") - 1).tolist() if n else ():
                x = column[i].as_py()
                if text in x if text else "\u03a3" in x or not unicodedata.is_normalized("NFC", x):
                    rows.add(i)
        return rows

    def blocks(self, data: np.ndarray, at: np.ndarray, special: set[int]):
        """(row, end, (ids, places to split them by row)), or for parts of one row (ids, whether it ends)."""
        row, n = 0, len(at) - 1
        stops = sorted(special)
        while row < n:
            end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, side="right")) - 1)
            if stops and stops[0] < end:
                end = max(row + 1, stops[0])
            lo, hi = int(at[row]), int(at[end])
            if row in special:
                stops.pop(0)
                yield row, end, (self.whole(data[lo:hi].tobytes().decode()), True)
            elif end - row > 1:
                ids, ends = self.encode(data[lo:hi], at[row : end + 1] - lo)
                yield row, end, (ids, ends[1:-1])
            else:
                while hi - lo > 2 * BLOCK:
                    cut = self.cut(data, lo, hi)
                    yield row, end, (self.encode(data[lo:cut], np.array([0, cut - lo]))[0], False)
                    lo = cut
                yield row, end, (self.encode(data[lo:hi], np.array([0, hi - lo]))[0], True)
            row = end

    def cut(self, data: np.ndarray, lo: int, hi: int) -> int:
        """A place after white space, a block or more from lo."""
        stop = lo + BLOCK
        while stop < hi:
            gaps = np.flatnonzero(self.kinds[data[lo:stop]] == SPACE)
            if len(gaps):
                return lo + int(gaps[-1]) + 1
            stop += BLOCK
        return hi

    def units(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units; none spans one of the row bounds."""
        kind = self.kinds[data]
        inside = kind != SPACE
        after = np.ones(len(data) + 1, dtype=bool)  # a piece may start here
        after[1:-1] = kind[:-1] == SPACE
        after[rows] = True
        first = inside & after[:-1]
        pieces = np.flatnonzero(first)
        step = np.ones(len(data), dtype=bool)
        step[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        odd = np.flatnonzero(whole_only(data))
        if len(odd):
            mark = np.zeros(len(pieces), dtype=bool)
            mark[np.searchsorted(pieces, odd, side="right") - 1] = True
            bounds = np.append(pieces, len(data))
            for p in np.flatnonzero(mark).tolist() if mark.sum() < 1000 else ():
                step[bounds[p] : bounds[p + 1]] = False
            if mark.sum() >= 1000:
                step &= ~np.repeat(mark, np.diff(bounds)) if not len(pieces) or not pieces[0] else ~np.concatenate([np.zeros(pieces[0], dtype=bool), np.repeat(mark, np.diff(bounds))])
        start = first | (inside & step)
        stop = np.ones(len(data), dtype=bool)
        stop[:-1] = ~inside[1:] | start[1:]
        return np.flatnonzero(start), np.flatnonzero(stop & inside) + 1

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block, and the number of ids before each of the row bounds."""
        n = len(data)
        if not n:
            return np.empty(0, "<u2"), np.zeros(len(rows), np.int64)
        if len(self.up) <= n:
            self.up, self.down = powers(BASE, max(n, 2 * BLOCK) + 1), powers(pow(BASE, -1, 1 << 64), max(n, 2 * BLOCK) + 1)
        starts, ends = self.units(data, rows)
        total = np.zeros(n + 1, U64)
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * self.down[starts])
        del total
        place = self.find(hashes)
        new = np.flatnonzero(self.hashes[place] != hashes)
        if len(new):
            _, one = np.unique(hashes[new], return_index=True)
            one = new[one]
            if len(self.hashes) + len(one) > CACHED:
                self.clear()
                _, one = np.unique(hashes, return_index=True)
            text = data.tobytes()
            self.learn(hashes[one], [text[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])
            place = self.find(hashes)
        sizes = self.sizes[place]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.at[place] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, rows)]

    def learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Add units, given with their sorted hashes, to the table."""
        found = [self.unit(u) for u in units]
        sizes = np.array([len(f) for f in found], np.int64)
        at = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), "<u2", int(sizes.sum()))])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.at, self.sizes = every[order], np.concatenate([self.at, at])[order], np.concatenate([self.sizes, sizes])[order]
        self.slots[self.hashes >> U64(43)] = np.arange(len(order), dtype=np.int32)

    def unit(self, unit: bytes) -> list[int]:
        if unit.isascii() and b"'" not in unit:
            return [t.id for t in self.model.tokenize(unit.decode().lower())] if unit.decode().isprintable() else self.whole(unit.decode()).tolist()
        text = unit.decode()
        if not LATIN.fullmatch(text):
            return self.whole(text).tolist()
        return [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2")
