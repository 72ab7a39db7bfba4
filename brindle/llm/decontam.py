"""Benchmark decontamination with a distributed positional inverted index.

Training texts are indexed in blocks of a few MB: for each term of the test items, the block's
positions of it, delta-coded, as one row of Parquet a block. Counts of the terms over all blocks
order each test window's terms. A block is searched by taking the postings of the windows' rarest
terms, moved back by the term's offset, as candidate starts and intersecting them with the postings
of the next rarest terms, likewise moved, until all terms agree. A match is exact where all offsets
agree, and a proximity match where every term is at most SLOP words from its place.

A window is WINDOW consecutive words of an item; an item with fewer words, but some, is one window.
Test items are the query set. They are taken in parts of about PART_BYTES, one after another, so what
the driver and a task hold doesn't grow with them.

Defined cases: a null text has no words, is never hit and hits nothing; a null item_id counts as an
item named by the empty string. Rows are told apart by an id of their own, so repeated documents are
each reported (where items come in several parts, docs must be a scan, whose row ids are the same each
time). Empty tables of either kind work. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.catalog import materialize
from brindle.llm.words import ALNUM_LOWER, U64, Hasher, rows_words

WINDOW = 10
SLOP = 2
GAP = 64  # positions between documents, so that no match reaches into the next
PART_BYTES = 2_000_000  # of text: up to some 30 MB of windows
KNOWN = 1_000_000  # contaminated rows up to which their keys are broadcast

INDEX = "rows array<long>, doc_ids array<long>, counts binary, terms binary, sizes binary, deltas binary"
FOUND = "row long, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>, near array<string>"


@dataclass(frozen=True)
class Tests:
    """Distinct windows of test items, by length: term places (n x length) in vocabulary, and the items of each."""

    vocabulary: np.ndarray
    windows: list[np.ndarray]
    items: list[list[tuple[str, ...]]]

    def ordered(self, counts: np.ndarray) -> list[np.ndarray]:
        """For each window its offsets from the rarest term on."""
        return [np.argsort(counts[w], axis=1, kind="stable") for w in self.windows]


def tests_of(rows: list[tuple[str, str | None]], width: int = WINDOW) -> Tests:
    hasher = Hasher(ALNUM_LOWER)
    texts = pa.array([t for _, t in rows], pa.string())
    words = [hashes[at[i] : at[i + 1]] for row, end, hashes, at in rows_words(texts, hasher) for i in range(end - row)]
    vocabulary = np.unique(np.concatenate([np.empty(0, U64), *words]))
    by_size: dict[int, dict[bytes, set]] = {}
    for (name, _), w in zip(rows, words):
        n = min(width, len(w))
        places = np.searchsorted(vocabulary, w).astype(np.int64)
        for i in range(len(w) - n + 1 if n else 0):
            by_size.setdefault(n, {}).setdefault(places[i : i + n].tobytes(), set()).add(name)
    windows = [np.frombuffer(b"".join(found), np.int64).reshape(-1, n) for n, found in by_size.items()]
    return Tests(vocabulary, windows, [[tuple(sorted(x)) for x in found.values()] for found in by_size.values()])


@dataclass
class Block:
    """Postings of a run of documents: terms, their list sizes, and positions list after list."""

    counts: np.ndarray  # words of each document
    terms: np.ndarray  # places in the vocabulary, ascending
    sizes: np.ndarray
    positions: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        """First position of each document, and one past the last's gap."""
        return np.concatenate([[0], np.cumsum(self.counts + GAP)])


def block_of(hashes: np.ndarray, word_at: np.ndarray, vocabulary: np.ndarray) -> Block:
    counts = np.diff(word_at)
    if not len(vocabulary) or not len(hashes):
        none = np.empty(0, np.int64)
        return Block(counts, none, none, none)
    place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[place] == hashes)
    place = place[at].astype(np.uint16 if len(vocabulary) < 1 << 16 else np.int64)
    order = np.argsort(place, kind="stable")
    place, at = place[order], at[order]
    first = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1))
    document = np.searchsorted(word_at, at, side="right") - 1
    return Block(counts, place[first].astype(np.int64), np.diff(np.append(first, len(place))), at + document * GAP)


def search(block: Block, tests: Tests, orders: list[np.ndarray], slop: int = SLOP) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of windows: (its place, window, start position, whether exact) of all matches."""
    out = []
    span = int(block.starts[-1]) + 2 * GAP
    ends = np.cumsum(block.sizes)
    keys = np.repeat(block.terms, block.sizes) * span + block.positions  # ascending
    for kind, (windows, order) in enumerate(zip(tests.windows, orders)):
        ids = np.arange(len(windows))
        rarest = windows[ids, order[:, 0]]
        place = np.minimum(np.searchsorted(block.terms, rarest), max(0, len(block.terms) - 1))
        ids = ids[block.terms[place] == rarest] if len(block.terms) else ids[:0]
        place = place[ids]
        n = block.sizes[place]
        window = np.repeat(ids, n)
        inner = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        start = block.positions[np.repeat(ends[place] - n, n) + inner] - order[window, 0]
        exact = np.ones(len(start), dtype=bool)
        for k in range(1, windows.shape[1]):
            if not len(start):
                break
            offset = order[window, k]
            key = windows[window, offset] * span + np.maximum(start + offset, 0)
            low = np.searchsorted(keys, key - slop)
            near = keys[np.minimum(low, len(keys) - 1)]
            fits = (low < len(keys)) & (near <= key + slop)
            if slop:
                same = np.searchsorted(keys, key)
                exact &= (same < len(keys)) & (keys[np.minimum(same, len(keys) - 1)] == key)
            window, start, exact = window[fits], start[fits], exact[fits]
        out.append((kind, window, start, exact & (start >= 0)))
    return out


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), stops.tolist())):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def matches(block: Block, tests: Tests, orders: list[np.ndarray], slop: int = SLOP) -> dict[int, tuple[list, set, set]]:
    """Of each document with a match: hit spans in words, items, and items with a proximity match."""
    starts = block.starts
    found: dict[int, tuple[list, set, set]] = {}
    for kind, window, start, exact in search(block, tests, orders, slop):
        width = tests.windows[kind].shape[1]
        document = np.searchsorted(starts, np.maximum(start, 0), side="right") - 1
        for d in np.unique(document).tolist():
            mine = document == d
            spans, items, near = found.setdefault(d, ([], set(), set()))
            hit = mine & exact
            at = start[hit] - starts[d]
            spans.extend(merged(at, at + width))
            items.update(x for w in np.unique(window[hit]).tolist() for x in tests.items[kind][w])
            near.update(x for w in np.unique(window[mine]).tolist() for x in tests.items[kind][w])
    return found


def index(docs: DataFrame, shared, row: Column) -> DataFrame:
    """The positional index of docs for the vocabulary of shared tests: a row for each block."""

    def run(batches):
        vocabulary = shared.value[0]
        hasher = Hasher(ALNUM_LOWER)
        for batch in batches:
            rows, ids = batch.column("row"), batch.column("doc_id")
            for row, end, hashes, word_at in rows_words(batch.column("text"), hasher):
                b = block_of(hashes, word_at, vocabulary)
                deltas = np.diff(b.positions, prepend=0)
                first = np.cumsum(b.sizes) - b.sizes
                deltas[first] = b.positions[first]
                cells = [rows[row:end].to_pylist(), ids[row:end].to_pylist(), b.counts.astype("<u4").tobytes(), b.terms.astype("<u4").tobytes(), b.sizes.astype("<u4").tobytes(), deltas.astype("<u4").tobytes()]
                kinds = [pa.list_(pa.int64())] * 2 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["rows", "doc_ids", "counts", "terms", "sizes", "deltas"])

    picked = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(run, INDEX)


def loaded(row: dict) -> Block:
    counts, terms, sizes = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("counts", "terms", "sizes"))
    deltas = np.frombuffer(row["deltas"], "<u4").astype(np.int64)
    total = np.cumsum(deltas)
    first = np.cumsum(sizes) - sizes
    return Block(counts, terms, sizes, total - np.repeat(total[first] - deltas[first], sizes))


def term_counts(indexed: DataFrame, n: int) -> np.ndarray:
    """Postings of each term over all blocks; n terms at most."""

    def run(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total[np.frombuffer(row["terms"], "<u4")] += np.frombuffer(row["sizes"], "<u4")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    counts = np.zeros(n, np.int64)
    for r in indexed.select("terms", "sizes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[r["term"]] = r["n"]
    return counts


def parts(benchmark: DataFrame, width: int = WINDOW, part_bytes: int = PART_BYTES) -> Iterator[Tests]:
    """The test items in parts that fit a task, each read when it is its turn."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // part_bytes
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for i in range(n):
        yield tests_of(sorted((r["item"], r["text"]) for r in items.where(part == i).collect()), width)


def searched(docs: DataFrame, tests: Tests, row: Column, slop: int = SLOP) -> DataFrame:
    """FOUND for each row of docs, for one part of the test items; written, as the next part needs the memory."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((tests.vocabulary, tests.windows, tests.items))  # plain values, as executors needn't have this package
    indexed = materialize(index(docs, shared, row))
    ranks = context.broadcast(tests.ordered(term_counts(indexed, len(tests.vocabulary))))

    def run(batches):
        tests, orders = Tests(*shared.value), ranks.value
        for batch in batches:
            for row in batch.to_pylist():
                block = loaded(row)
                found = matches(block, tests, orders, slop)
                none = ([], set(), set())
                cells = [found.get(d, none) for d in range(len(block.counts))]
                arrays = [
                    pa.array(row["rows"], pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(block.counts),
                    pa.array([[{"start": a, "stop": b} for a, b in s] for s, _, _ in cells], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array([sorted(x) for _, x, _ in cells], pa.list_(pa.string())),
                    pa.array([sorted(x) for _, _, x in cells], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_words", "spans", "items", "near"])

    found = materialize(indexed.mapInArrow(run, FOUND))
    shared.destroy()
    ranks.destroy()
    return found


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Words, hit words and items found, of each row of docs."""
    row = F.monotonically_increasing_id()
    every = [searched(docs, tests, row, slop) for tests in parts(benchmark, width)]
    found = reduce(DataFrame.union, every)
    if len(every) > 1:
        found = found.groupBy("row", "doc_id", "n_words").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near")))
    ordered = F.array_sort("spans")
    start = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n"))

    def add(acc, s):
        new = F.greatest(s["stop"] - F.greatest(s["start"], acc["stop"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(acc["stop"], s["stop"]).alias("stop"), (acc["n"] + new).alias("n"))

    n_hit = F.aggregate(ordered, start, add)["n"]
    items = F.array_sort(F.array_distinct("items"))
    counted = found.select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"), F.size(F.array_distinct("near")).cast("long").alias("n_near"))
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of docs without an exact match, with all columns.

    Rows are named by a 64-bit hash of doc_id and text: rows of one name have one verdict. The names
    of contaminated rows are broadcast up to KNOWN of them, so that texts aren't shuffled; beyond, they
    are joined.
    """
    name = F.xxhash64(F.col("doc_id"), F.col("text"))
    every = [searched(docs, tests, name, 0).where(F.size("spans") > 0).select("row") for tests in parts(benchmark, width)]
    hit = materialize(reduce(DataFrame.union, every).distinct())
    few = hit.limit(KNOWN + 1).count() <= KNOWN
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), name.alias("row"))
    return named.join(F.broadcast(hit) if few else hit, "row", "left_anti").select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
