"""N-gram Jaccard join: components of documents whose shingle sets are at least 80 % alike.

Documents with equal sets form a class; classes are joined by a size-aware heavy-light join.

Light sets, of up to B shingles, enumerate their subsets of each fixed size that a similar partner
of up to B shingles must share with them. Two sets that share a subset of the size they need are
linked, and linking each to the smallest set of the subset's list gives the same components.

Heavy sets scan inverted lists of prefixes: shingles are ordered from rare to frequent, and the
first n - ceil(0.8 n) + 1 of them must meet a similar set's. Light sets that may have heavy partners
are in these lists too. In a list, members are first compared with the most central of them, its
head; members already in one component need no further comparison. What then is in different
components is compared

  in lists of up to HOT classes, pair by pair;
  in longer ones, by differences from the head. Two sets that aren't both similar to the head can
  only be similar to each other if they share some of what they differ in from it: with sizes n, m
  and h and overlaps a and b with the head, h - a - b + needed(n, m) of it, which is at least 1.
  So their differences go into inverted lists of prefixes of their own, again from rare to frequent.

Pairs that come out are ruled out by a bound from 1024-bit sketches or compared as whole sets, so no
link between components is lost. A group of near copies costs its size where its members are like
its head or differ in ways of their own; it costs more where many make the same edits.

B minimises the cost of both ways over the corpus's set sizes. Frequencies are counted over all
documents by range of hash, summed before the shuffle, and told to tasks as one of 16 levels in a
table of four entries a marked shingle. All that occur twice are marked, or, where that takes more
than SLOTS entries, all from the least level on that fits; the others come first in the order, and
their lists are no longer than that level. Levels only decide the order, so collisions cost
comparisons but lose no links.

Defined cases: sets compare by 64-bit hashes of shingles, classes by 128-bit hashes of sets. A null
or wordless text has an empty set and is alone in its component. Rows with equal doc_id and
different texts are different sets; a component is named by the least doc_id of its rows, null if
it has none. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from brindle.catalog import materialize
from brindle.llm.words import SPACED_LOWER, U64, Hasher, mix, rolling, rows_words
from brindle.operators.components import components

WIDTH = 5  # words of a shingle
SLOTS = 1 << 26  # four-bit entries of the frequency table at most, 32 MB, that tasks hold
LEVELS = (2, 3, 5, 8, 12, 20, 32, 64, 128, 256, 1 << 10, 1 << 12, 1 << 14, 1 << 17, 1 << 20)  # documents from which a shingle has level 1, 2, ...
HOT = 16  # classes of a list up to which they are compared pair by pair
SALTS = 8  # parts of a large class where its rows get their component
MAX_LIGHT = 12  # largest boundary tried
SHIPPED = 400_000  # shingles that a task gathers before it deals them out
ROWS = 1000  # rows of an Arrow batch here, as they hold texts or sets
KNOWN = 2_000_000  # doc_ids up to which a list of them is broadcast
SKETCH = 1024
NO_ID = -(1 << 63)


# Sizes. Two sets link when 100 * overlap >= 80 * union, that is 9 * overlap >= 4 * (n + m).


def needed(n: int, m: int) -> int:
    return -(-4 * (n + m) // 9)


def prefix(n: int) -> int:
    return n + (-4 * n // 5) + 1


def subset_sizes(n: int, light: int) -> list[int]:
    """Sizes of the subsets that a set of n shares with similar sets of up to light shingles."""
    return sorted({c for m in range(-(-4 * n // 5), min(light, 5 * n // 4) + 1) if (c := needed(n, m)) <= min(n, m)})


def boundary(sizes: np.ndarray, shared: float) -> int:
    """The largest light size, by least cost.

    sizes: sets of each small size; shared: share of shingles that other documents have too. A
    posting costs one, and about four more for the comparisons that a shared one brings.
    """
    scan = [prefix(n) * (1 + 4 * shared) if n else 0 for n in range(len(sizes))]
    costs = []
    for light in range(min(MAX_LIGHT, len(sizes) - 1) + 1):
        cost = 0.0
        for n in range(1, len(sizes)):
            if n <= light:
                cost += sizes[n] * sum(comb(n, c) for c in subset_sizes(n, light))
            if 5 * n >= 4 * (light + 1):
                cost += sizes[n] * scan[n]
        costs.append(cost)
    return int(np.argmin(costs))


# Sets.


def sets(column: pa.Array, hasher: Hasher):
    """Row and sorted distinct shingle hashes of each text with words."""
    for row, end, hashes, at in rows_words(column, hasher):
        shingles = rolling(hashes, WIDTH) if len(hashes) >= WIDTH else None
        for i in range(end - row):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= WIDTH:
                yield row + i, np.unique(shingles[a : b - WIDTH + 1])
            elif b > a:
                yield row + i, rolling(hashes[a:b], WIDTH)


def class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def token(shingles: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, a range of shingles, and 32-bit rest; together they stand for a shingle in lists."""
    return (((shingles >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64), shingles.astype(np.uint32)


@dataclass(frozen=True)
class Levels:
    """The frequency table: each of `buckets` has a range of `each` four-bit entries of its own."""

    table: np.ndarray
    each: int
    buckets: int
    certain: bool  # whether level 0 means that no other row has the shingle

    def of(self, shingles: np.ndarray) -> np.ndarray:
        bucket, rest = token(shingles, self.buckets)
        at = bucket * self.each + entries(rest, self.each)
        return (self.table[at >> 1] >> ((at & 1) * 4).astype(np.uint8)) & 15


def entries(rest: np.ndarray, each: int) -> np.ndarray:
    return (mix(rest.astype(U64)) % U64(each)).astype(np.int64)


def cut(bucket: np.ndarray, *arrays: np.ndarray):
    """(bucket, parts of arrays) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first[1:], len(bucket))
    arrays = tuple(a[order] for a in arrays)
    for a, b in zip(first.tolist(), ends.tolist()):
        yield int(bucket[a]), tuple(x[a:b] for x in arrays)


def n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def arrow_rows(spark, n: int):
    """Arrow batches of at most n rows for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


# Frequencies.


COUNTED = "bucket int, n long, shared long, marks array<long>, low binary, level binary"


def frequencies(docs: DataFrame, buckets: int, parts: int) -> tuple[Levels, np.ndarray, float]:
    """The frequency table, sets of each size below 64, and the share of shingles that several documents have."""

    def deal(batches):
        hasher = Hasher(SPACED_LOWER)

        def sent(held):
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            times = np.diff(np.append(first, len(keys)))
            bucket, low = token(keys[first], buckets)
            begins = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for a, b in zip(begins.tolist(), np.append(begins[1:], len(bucket)).tolist()):
                once = times[a:b] == 1
                rows.append((int(bucket[a]), low[a:b][once].tobytes(), low[a:b][~once].tobytes(), times[a:b][~once].astype("<u4").tobytes()))
            return dealt(rows)

        def dealt(rows):
            kinds = [("bucket", pa.int32()), ("low", pa.binary()), ("more", pa.binary()), ("times", pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [k for k, _ in kinds])

        held, n, sizes = [], 0, np.zeros(64, np.int64)
        for batch in batches:
            for _, shingles in sets(batch.column("text"), hasher):
                held.append(shingles)
                sizes[min(63, len(shingles))] += 1
                n += len(shingles)
                if n >= SHIPPED:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)
        yield dealt([(-1, sizes.astype("<i8").tobytes(), b"", b"")])

    def count(batches):
        def counted(bucket, parts):
            low = np.concatenate([x for x, _, _ in parts] + [x for _, x, _ in parts])
            times = np.concatenate([np.ones(len(x), np.int64) for x, _, _ in parts] + [x.astype(np.int64) for _, _, x in parts])
            order = np.argsort(low)
            low, times = low[order], times[order]
            first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            df = np.add.reduceat(times, first)
            often = df >= LEVELS[0]
            level = np.searchsorted(LEVELS, df[often], side="right")
            return row(bucket, int(df.sum()), int(df[often].sum()), np.bincount(level, minlength=16), low[first[often]].tobytes(), level.astype(np.uint8).tobytes())

        def row(*values):
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [x.split()[0] for x in COUNTED.split(", ")])

        for bucket, rows in buckets_of(batches):
            if bucket < 0:
                sizes = sum(np.frombuffer(r[1].as_buffer(), "<i8") for r in rows)
                yield row(bucket, 0, 0, np.zeros(16, np.int64), sizes.tobytes(), b"")
            else:
                yield counted(bucket, [tuple(np.frombuffer(x.as_buffer(), np.uint32) for x in r[1:]) for r in rows])

    def tables(batches):
        for batch in batches:
            for bucket, low, level in zip(batch.column("bucket").to_pylist(), batch.column("low"), batch.column("level")):
                level = np.frombuffer(level.as_buffer(), np.uint8)
                at = entries(np.frombuffer(low.as_buffer(), np.uint32), each)
                order = np.argsort(level, kind="stable")
                order = order[level[order] >= least]
                held = np.zeros(each, np.uint8)
                held[at[order]] = level[order]  # of several the last, which is the highest
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([(held[::2] | held[1::2] << 4).tobytes()], pa.binary())], ["bucket", "bits"])

    dealt = docs.select("text").mapInArrow(deal, "bucket int, low binary, more binary, times binary")
    counted = materialize(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, COUNTED))
    n, shared = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("shared"), F.lit(0))).first()
    marks = np.zeros(16, np.int64)
    for r in counted.select(F.posexplode("marks").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect():
        marks[r["level"]] = r["n"]
    sizes = np.zeros(64, np.int64)
    for r in counted.where("bucket = -1").select("low").collect():  # one row
        sizes += np.frombuffer(bytes(r["low"]), "<i8")
    marked = np.cumsum(marks[::-1])[::-1]
    least = next((i for i in range(1, 16) if 4 * marked[i] <= SLOTS), 15)
    each = 2 * max(8, min(SLOTS, int(4 * marked[least])) // (2 * buckets))
    table = np.zeros(buckets * each // 2, np.uint8)
    for r in counted.where("bucket >= 0").select("bucket", "low", "level").mapInArrow(tables, "bucket int, bits binary").toLocalIterator():  # SLOTS / 2 bytes in all
        table[r["bucket"] * each // 2 : (r["bucket"] + 1) * each // 2] = np.frombuffer(r["bits"], np.uint8)
    return Levels(table, each, buckets, least == 1), sizes, shared / max(1, n)


def buckets_of(batches):
    """(bucket, rows) of batches sorted by their first column; rows are tuples of Arrow scalars."""
    now, rows = None, []
    for batch in batches:
        for bucket, *rest in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            if bucket != now:
                if rows:
                    yield now, rows
                now, rows = bucket, []
            rows.append((bucket, *rest))
    if rows:
        yield now, rows


# Lists.

POSTED = "bucket int, kind int, keys binary, classes binary, sizes binary, ranks binary"
LISTED = "kind int, key long, cls binary, other binary, n int, rank int"
MEMBER, HEAVY, LIGHT = 0, 1, 2
PACK = 1000  # a light posting's size is that of its set plus PACK times that of the subset


def lists(docs: DataFrame, levels: Levels, light: int, parts: int) -> DataFrame:
    """LISTED rows: members (key: doc_id), postings of lists with several classes (key: token), and light links."""
    # SLOTS / 2 bytes at most; broadcasts hold plain values, as executors needn't have this package.
    shared = docs.sparkSession.sparkContext.broadcast((levels.table, levels.each, levels.buckets, levels.certain))
    buckets = levels.buckets

    def post(batches):
        hasher, levels = Hasher(SPACED_LOWER), Levels(*shared.value)

        def sent(kind, keys, classes, sizes, ranks):
            low, n, rank = np.concatenate(keys), np.concatenate(sizes), np.concatenate(ranks)
            times = [len(x) for x in keys]
            if kind == HEAVY:
                bucket, low = token(low, buckets)
            else:
                bucket = (mix(low.astype(U64)) % U64(buckets)).astype(np.int64)
            cls = np.frombuffer(b"".join(classes), "V16")
            if kind != MEMBER:
                cls, n = np.repeat(cls, times), np.repeat(n, times)
            rows = [(b, kind, k.tobytes(), c.tobytes(), *(x.astype("<i4").tobytes() for x in rest)) for b, (k, c, *rest) in cut(bucket, low, cls, n, rank)]
            names = [x.split()[0] for x in POSTED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 2 + [pa.binary()] * 4)], names)

        held = {k: ([], [], [], []) for k in (MEMBER, HEAVY, LIGHT)}
        seen: set[bytes] = set()  # classes that this task has posted

        def put(kind, keys, cls, size, rank):
            for x, y in zip(held[kind], (keys, cls, np.atleast_1d(size), rank)):
                x.append(y)

        waiting = 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            empty = np.ones(len(ids), dtype=bool)
            for row, shingles in sets(batch.column("text"), hasher):
                cls, n = class_of(shingles), len(shingles)
                empty[row] = False
                put(MEMBER, ids[row : row + 1], cls, n, np.zeros(1, np.int64))
                waiting += 1
                if cls in seen:
                    continue
                if len(seen) < SHIPPED:
                    seen.add(cls)
                if n <= light:
                    for c in subset_sizes(n, light):
                        keys = [subset_key(shingles[list(s)]) for s in combinations(range(n), c)]
                        put(LIGHT, np.array(keys, U64), cls, n + PACK * c, np.zeros(len(keys), np.int64))
                        waiting += len(keys)
                if 5 * n >= 4 * (light + 1):
                    level = levels.of(shingles)
                    order = np.argsort((level.astype(U64) << U64(60)) | (shingles >> U64(4)))[: prefix(n)]
                    rank = np.flatnonzero(level[order] > 0) if levels.certain else np.arange(len(order))
                    if len(rank):
                        put(HEAVY, shingles[order[rank]], cls, n, rank)
                        waiting += len(rank)
                if waiting >= SHIPPED:
                    for kind, parts in held.items():
                        if parts[0]:
                            yield sent(kind, *parts)
                    held, waiting = {k: ([], [], [], []) for k in held}, 0
            if empty.any():
                n = int(empty.sum())
                put(MEMBER, ids[empty], bytes(16) * n, np.zeros(n, np.int64), np.zeros(n, np.int64))
        for kind, parts in held.items():
            if parts[0]:
                yield sent(kind, *parts)

    def gather(batches):
        for bucket, rows in buckets_of(batches):
            held = {k: [] for k in (MEMBER, HEAVY, LIGHT)}
            for _, kind, keys, classes, *numbers in rows:
                kind = kind.as_py()
                key = np.frombuffer(keys.as_buffer(), np.uint32 if kind == HEAVY else np.int64)
                if kind == HEAVY:
                    key = (np.int64(bucket) << np.int64(32)) | key.astype(np.int64)
                held[kind].append((key, np.frombuffer(classes.as_buffer(), "V16"), *(np.frombuffer(x.as_buffer(), "<i4") for x in numbers)))
            for kind, found in held.items():
                if found:
                    key, cls, *numbers = map(np.concatenate, zip(*found))
                    yield listed(kind, key, cls, None, *numbers) if kind == MEMBER else several(kind, key, cls, *numbers)

    posted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(post, POSTED)
    found = materialize(posted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, LISTED))
    shared.destroy()
    return found


def subset_key(shingles: np.ndarray) -> int:
    return int(mix(np.array([mix(shingles).sum(dtype=U64) + U64(len(shingles))], U64))[0])


def listed(kind: int, key: np.ndarray, cls: np.ndarray, other: np.ndarray | None, *numbers: np.ndarray) -> pa.RecordBatch:
    wide = pa.binary(16)

    def binary(x):
        return pa.Array.from_buffers(wide, len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())

    same = binary(cls)
    arrays = [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), same, same if other is None else binary(other), *(pa.array(x.astype(np.int32)) for x in numbers)]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "key", "cls", "other", "n", "rank"])


def several(kind: int, key: np.ndarray, cls: np.ndarray, n: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """Postings of the keys that several classes have; of light keys, links to the smallest set of each."""
    order = np.argsort(key, kind="stable")
    key, cls, n, rank = key[order], cls[order], n[order], rank[order]
    twice = np.zeros(len(key), dtype=bool)
    same = key[1:] == key[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    key, cls, n, rank = key[twice], cls[twice], n[twice], rank[twice]
    halves = np.ascontiguousarray(cls).view("<u8").reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0], n, key))
    key, cls, n, rank, halves = key[order], cls[order], n[order], rank[order], halves[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (halves[1:] != halves[:-1]).any(axis=1)
    key, cls, n, rank = key[new], cls[new], n[new], rank[new]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    many = np.repeat(count > 1, count)
    if kind == HEAVY:
        return listed(kind, key[many], cls[many], None, n[many], rank[many])
    head = np.repeat(first, count)  # the smallest set that has the subset
    many &= (np.arange(len(key)) != head) & (9 * (n // PACK) >= 4 * (n % PACK + n[head] % PACK))
    return listed(kind, key[many], cls[many], cls[head[many]], n[many], rank[many])


# Comparing.

SIDES = "cls binary, other binary, n int, m int"


def sketch(shingles: np.ndarray) -> bytes:
    bits = np.zeros(SKETCH, dtype=bool)
    bits[(mix(shingles ^ U64(0x5BD1E995)) & U64(SKETCH - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(cls, sketch, shingles) of the documents of ids(doc_id)."""
    ids = materialize(ids)
    n = ids.count()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    wanted = None
    if n <= KNOWN:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toPandas()["doc_id"].to_numpy(np.int64)))  # KNOWN at most
    else:
        rows = rows.join(ids, "doc_id", "left_semi")

    def run(batches):
        hasher = Hasher(SPACED_LOWER)
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(), wanted.value)))
            out = [(class_of(x), sketch(x), x.tobytes()) for _, x in sets(batch.column("text"), hasher)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in range(3)], ["cls", "sketch", "shingles"])

    return materialize(rows.mapInArrow(run, "cls binary, sketch binary, shingles binary").dropDuplicates(["cls"]))


def alike(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(cls, other, overlap, linked) of pairs; the overlap is exact for pairs that may link, else a bound from sketches."""
    schema = "cls binary, other binary, overlap int, linked boolean"

    def bounded(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(-1, SKETCH // 64) for c in ("sa", "sb"))
            size = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            most = (size - apart) // 2  # each bit that differs is an element that only one set has
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("other"), pa.array(most.astype(np.int32)), pa.array(9 * most >= 4 * size)], ["cls", "other", "overlap", "linked"])

    def compared(batches):
        for batch in batches:
            overlap, size = [], []
            for x, y in zip(batch.column("xa"), batch.column("xb")):
                x, y = (np.frombuffer(z.as_buffer(), U64) for z in (x, y))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                overlap.append(int((y[at] == x).sum()))
                size.append(len(x) + len(y))
            ok = [9 * k >= 4 * s for k, s in zip(overlap, size)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("other"), pa.array(overlap, pa.int32()), pa.array(ok, pa.bool_())], ["cls", "other", "overlap", "linked"])

    def both(df, column, a, b):
        one = known.select("cls", F.col(column).alias(a))
        two = known.select(F.col("cls").alias("other"), F.col(column).alias(b))
        return df.join(one, "cls").join(two, "other")

    near = materialize(both(pairs, "sketch", "sa", "sb").select("cls", "other", "n", "m", "sa", "sb").mapInArrow(bounded, schema))
    sure = both(near.where("linked").select("cls", "other"), "shingles", "xa", "xb").select("cls", "other", "xa", "xb").mapInArrow(compared, schema)
    return materialize(near.where("NOT linked").union(sure))


def edges(judged: DataFrame) -> DataFrame:
    return judged.where("linked").select(F.col("cls").alias("a"), F.col("other").alias("b"))


def may_link(n: str, m: str, rank: str, other_rank: str):
    """What two postings of a list must satisfy for their sets to link, if it is their first common list.

    Shingles before it in either prefix are in one of the two alone, so their number is at most the
    number of shingles that linked sets don't share. A pair that links passes in its first common list.
    """
    total = F.col(n) + F.col(m)
    apart = total - 2 * F.ceil(4 * total / 9)
    return of_size(n, m) & (F.col(rank) + F.col(other_rank) <= apart)


def of_size(n: str, m: str):
    return (5 * F.col(n) >= 4 * F.col(m)) & (5 * F.col(m) >= 4 * F.col(n))


def others(df: DataFrame, *but: str) -> DataFrame:
    return df.select(*but, *[F.col(c).alias("other" if c == "cls" else f"other_{c}") for c in df.columns if c not in but])


def heavy_links(docs: DataFrame, listed_rows: DataFrame, links: DataFrame) -> DataFrame:
    """Links between the classes of the inverted lists that, with links, give their components.

    First each list's members are compared with its head, the class that is in most lists: of near
    copies that is the least edited, which most others link to. Then what lies in different
    components is compared, in short lists pair by pair, in long ones by differences from the head.
    """
    postings = listed_rows.where(F.col("kind") == HEAVY).select("key", "cls", "n", "rank")
    central = materialize(postings.groupBy("cls").agg(F.count("*").alias("lists")))
    members = listed_rows.where((F.col("kind") == MEMBER) & (F.col("n") > 0)).groupBy("cls").agg(F.min("key").alias("doc_id"))
    known = whole_sets(docs, members.join(central, "cls", "left_semi").select("doc_id").distinct())
    heads = postings.join(central, "cls").groupBy("key").agg(F.max(F.struct("lists", "cls", "n", "rank")).alias("h"), F.count("*").alias("classes"))
    heads = materialize(heads.select("key", F.col("h.cls").alias("other"), F.col("h.n").alias("m"), F.col("h.rank").alias("other_rank"), "classes"))
    star = postings.join(heads, "key").where((F.col("cls") != F.col("other")) & may_link("n", "m", "rank", "other_rank"))
    first = F.col("cls") < F.col("other")
    star = star.select(F.least("cls", "other").alias("cls"), F.greatest("cls", "other").alias("other"), F.when(first, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(first, F.col("m")).otherwise(F.col("n")).alias("m"))
    judged = alike(materialize(star.distinct()), known)
    links = links.union(edges(judged))
    found = components(links).select(F.col("node").alias("cls"), "component")
    placed = materialize(postings.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls")).join(heads.select("key", F.col("other").alias("head"), F.col("m").alias("h"), "classes"), "key"))
    short = placed.where(F.col("classes") <= HOT).select("key", "cls", "n", "rank", "component")
    apart = (F.col("cls") < F.col("other")) & (F.col("component") != F.col("other_component"))
    pairs = short.join(others(short, "key"), "key").where(apart & may_link("n", "other_n", "rank", "other_rank"))
    pairs = pairs.select("cls", "other", "n", F.col("other_n").alias("m")).union(differing(placed.where(F.col("classes") > HOT), known))
    pairs = pairs.distinct().join(judged.select("cls", "other"), ["cls", "other"], "left_anti")
    return links.union(edges(alike(materialize(pairs), known)))


DIFFERENCES = "head binary, cls binary, component binary, n int, h int, overlap int, size int, reach int, tokens array<long>"


def reach(n: int, h: int, overlap: int) -> int:
    """Differences from the head, the rarest ones, of which a set shares one with each set of another component that it links to.

    Of a set and a head, n and h shingles, overlap of them common. A partner of m shingles shares
    h - overlap - its overlap + needed(n, m) differences. Its overlap is at most h and m, and if the
    set is like the head, too small to be like the head as well.
    """
    size = n + h - 2 * overlap
    if overlap >= needed(n, h):
        least = h - overlap + 4 * (n - h) // 9 + 1
    else:
        m = max(-(-4 * n // 5), min(h, 5 * n // 4))
        least = h - overlap + needed(n, m) - min(h, m)
    return max(0, size - max(1, least) + 1)


def differing(placed: DataFrame, known: DataFrame) -> DataFrame:
    """(cls, other, n, m) of classes of different components that may link, both in a list of one head.

    placed: key, cls, n, component, head and h, the head's size.
    """
    group = placed.where("cls <> head").select("head", "cls", "component", "n", "h").distinct()
    several = group.groupBy("head").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("head")
    # A member outside the head's component was compared with the head: alone it has no partner here.
    group = group.join(several, "head", "left_semi")

    def run(batches):
        for batch in batches:
            columns = {k: [] for k in ("overlap", "size", "reach", "tokens")}
            for n, h, x, y in zip(batch.column("n").to_pylist(), batch.column("h").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(z.as_buffer(), U64) for z in (x, y))
                tokens = np.setxor1d(x, y, assume_unique=True)
                overlap = (len(x) + len(y) - len(tokens)) // 2
                for k, v in zip(columns, (overlap, len(tokens), reach(n, h, overlap), tokens.view(np.int64))):
                    columns[k].append(v)
            kinds = [pa.int32()] * 3 + [pa.list_(pa.int64())]
            names = ["head", "cls", "component", "n", "h"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(v, t) for v, t in zip(columns.values(), kinds)], names + list(columns))

    whole = group.join(known.select("cls", F.col("shingles").alias("x")), "cls").join(known.select(F.col("cls").alias("head"), F.col("shingles").alias("y")), "head")
    differences = materialize(whole.select("head", "cls", "component", "n", "h", "x", "y").mapInArrow(run, DIFFERENCES))
    each = differences.select("head", "cls", F.explode("tokens").alias("token"))
    common = each.groupBy("head", "token").agg(F.count("*").alias("times")).where("times > 1")
    # Differences that no other member has come first; the others follow by frequency.
    met = each.join(common, ["head", "token"]).withColumn("nth", F.row_number().over(Window.partitionBy("head", "cls").orderBy("times", "token")))
    of_set = differences.select("head", "cls", "component", "n", "h", "overlap", "size", "reach")
    shared = met.groupBy("head", "cls").agg(F.count("*").alias("shared"))
    ranked = met.join(of_set.join(shared, ["head", "cls"]), ["head", "cls"]).withColumn("rank", F.expr("size - shared + nth - 1")).where("rank < reach")
    ranked = materialize(ranked.select("head", "token", "cls", "component", "n", "h", "overlap", (F.col("size") - F.col("rank")).alias("left")))
    least = F.col("h") - F.col("overlap") - F.col("other_overlap") + F.ceil(4 * (F.col("n") + F.col("other_n")) / 9)
    apart = (F.col("cls") < F.col("other")) & (F.col("component") != F.col("other_component"))
    pairs = ranked.join(others(ranked.drop("h"), "head", "token"), ["head", "token"]).where(apart & of_size("n", "other_n") & (F.least("left", "other_left") >= least))
    return pairs.select("cls", "other", "n", F.col("other_n").alias("m"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, cls) of docs, and (cls, component) of the classes that have several rows or links."""
    parts = n_partitions(docs)
    with arrow_rows(docs.sparkSession, ROWS):
        levels, sizes, shared = frequencies(docs, 8 * parts, parts)
        found = lists(docs, levels, boundary(sizes, shared), parts)
        links = found.where(F.col("kind") == LIGHT).select(F.col("cls").alias("a"), F.col("other").alias("b"))
        linked = components(heavy_links(docs, found, links)).select(F.col("node").alias("cls"), "component")
    members = found.where(F.col("kind") == MEMBER).select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "cls")
    groups = members.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(linked, "cls", "left").where("n > 1 OR component IS NOT NULL")
    return members, materialize(groups.select("cls", F.coalesce("component", "cls").alias("component"), "least"))


def salted(members: DataFrame, of_class: DataFrame, how: str) -> DataFrame:
    """Members joined with a row of their class; a class's rows are dealt to SALTS tasks."""
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(SALTS))
    copies = of_class.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return members.withColumn("salt", salt.cast("long")).join(copies, ["cls", "salt"], how).drop("salt")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    members, named = classes(docs)
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    of_class = named.select("cls", "component").join(least, "component").select("cls", "least")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    return salted(members, of_class, "left").select("doc_id", "n_shingles", component)


KEY, SURPLUS = "_brindle_key", "_brindle_surplus"


def row_key(doc_ids: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a doc_id and a class."""
    return mix(mix(doc_ids.astype(np.int64).view(U64)) ^ np.ascontiguousarray(cls).view(U64).reshape(-1, 2)[:, 0]).view(np.int64)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs of each component, with all columns: that of least doc_id (null last), then class.

    Rows without words all stay. Rows that share a doc_id are told apart by their sets. What is to
    be dropped is broadcast up to KNOWN rows, and texts are shuffled only beyond that, or to keep
    one of several rows of equal doc_id and set.
    """
    members, named = classes(docs)

    def keyed(batches):
        for batch in batches:
            cls = np.frombuffer(b"".join(batch.column("cls").to_pylist()), "V16")
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("cls"), batch.column("component"), batch.column("n"), pa.array(row_key(ids, cls))], ["doc_id", "cls", "component", "n", "key"])

    rows = members.where("n_shingles > 0").groupBy("cls", "doc_id").agg(F.count("*").alias("n"))
    rows = materialize(rows.join(named.select("cls", "component"), "cls").select("doc_id", "cls", "component", "n").mapInArrow(keyed, "doc_id long, cls binary, component binary, n long, key long"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cls", "key")).alias("first")).select(F.col("first.key").alias("key"))
    surplus = materialize(rows.join(first, "key", "left_anti").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "key"))
    repeated = materialize(rows.where("n > 1").join(first, "key", "left_semi").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "key"))
    few = surplus.count() + repeated.count() <= KNOWN
    spark = docs.sparkSession
    drop = again = None
    if few:
        drop, again = (spark.sparkContext.broadcast({c: np.sort(frame[c].to_numpy(np.int64)) for c in ("doc_id", "key")}) for frame in (surplus.toPandas(), repeated.toPandas()))  # 16 * KNOWN bytes at most

    def marked(batches):
        hasher = Hasher(SPACED_LOWER)
        for batch in batches:
            ids = pc.fill_null(pc.cast(batch.column("doc_id"), pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.isin(ids, drop.value["doc_id"]) | np.isin(ids, again.value["doc_id"])) if few else np.arange(len(ids))
            key, surplus = np.zeros(len(ids), np.int64), np.zeros(len(ids), dtype=bool)
            known = np.zeros(len(ids), dtype=bool)
            for row, shingles in sets(batch.column("text").take(pa.array(at)), hasher):
                i = at[row]
                key[i] = row_key(ids[i : i + 1], np.frombuffer(class_of(shingles), "V16"))[0]
                known[i] = True
            if few:
                surplus = known & np.isin(key, drop.value["key"])
                known &= np.isin(key, again.value["key"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, mask=~known), pa.array(surplus)], [*batch.schema.names, KEY, SURPLUS])

    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.mapInArrow(marked, StructType([*docs.schema.fields, StructField(KEY, LongType()), StructField(SURPLUS, BooleanType())])).where(f"NOT {SURPLUS}")
    if not few:
        kept = kept.join(surplus.select(F.col("key").alias(KEY)).distinct(), KEY, "left_anti")
    if not repeated.limit(1).count():
        return kept.select(*names)
    again_keys = repeated.select(F.col("key").alias(KEY)).distinct()
    kept = materialize(kept)
    several = kept.join(again_keys, KEY, "left_semi").dropDuplicates([KEY])
    return kept.join(again_keys, KEY, "left_anti").select(*names).union(several.select(*names))
