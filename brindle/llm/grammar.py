"""Token-id files, compressed by a Re-Pair grammar for each shard.

Documents go to range partitions of doc_id and are sorted there, so shards follow each other in
ascending doc_id. A shard holds about SHARD ids of whole documents. Its pairs of ids that occur most
often become nonterminals, again and again; pairs don't cross documents. The file is Parquet with
one row a shard:

  part, block    the shard's place: shards ordered by them hold ascending doc_ids
  doc_ids        int64 a document, nulls as the smallest value
  n_tokens       uint32 a document, ids with the end id
  n_codes        uint32 a document, symbols of its compressed sequence
  codes          uint32 or uint16 symbols (see width), documents one after another
  rules          two uint32 a nonterminal; nonterminal i is symbol base + i, and refers to smaller ones
  lengths        uint32 a nonterminal, ids that it expands to
  base, width    first nonterminal, bytes of a code
  total          ids of the shard

A document is found by its place among doc_ids; the sums of n_codes give its codes, and the lengths
let a reader skip symbols without expanding them.

Defined cases: a null or empty text is the end id alone. Null doc_ids come first; rows of equal
doc_id are ordered by text, so that repeated rows are interchangeable. An empty table gives no shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.catalog import shared_folder
from brindle.llm.tokens import WordEncoder

SHARD = 1 << 20
END = 1
PER_ROUND = 2048  # nonterminals that a round may add
OFTEN = 16  # occurrences that make a pair worth a nonterminal
NULL_ID = -(1 << 63)

SCHEMA = (
    "part int, block int, doc_ids binary, n_tokens binary, n_codes binary, codes binary, rules binary, "
    "lengths binary, base long, width int, total long"
)


def slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """20-bit hashes of pairs."""
    return ((first * np.uint32(0x9E3779B1)) ^ (second * np.uint32(0x85EBCA77))) >> np.uint32(12)


def places(pairs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where keys are among sorted pairs, or any place for those that aren't; by hash, where that tells pairs apart."""
    index = np.full(1 << 20, -1, np.int32)
    index[slots((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))] = np.arange(len(pairs), dtype=np.int32)
    place = index[slots((keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32))]
    other = np.flatnonzero((place >= 0) & (pairs[place] != keys))
    place[other] = np.minimum(np.searchsorted(pairs, keys[other]), len(pairs) - 1)
    return place


def compress(ids: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, which of them end a document, and rules (n x 2); last marks the ids that end a document.

    Each round replaces the most frequent pairs, PER_ROUND of them, until none occurs OFTEN times.
    A pair of old symbols can only become rarer, so after the first round only places of pairs that
    were frequent and places beside new symbols are counted.
    """
    seq, rules = ids.astype(np.uint32), []
    if len(seq) < 2:
        return seq, last, np.empty((0, 2), np.uint32)
    slot = slots(seq[:-1], seq[1:])
    may = (np.bincount(slot[~last[:-1]], minlength=1 << 20) >= OFTEN)[slot]  # others can't be frequent
    at = np.flatnonzero(may & ~last[:-1])
    while True:
        keys = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
        pairs, counts = np.unique(keys, return_counts=True)
        often = counts >= OFTEN
        pairs, counts = pairs[often], counts[often]
        if not len(pairs):
            return seq, last, np.array(rules, dtype=np.uint32).reshape(-1, 2)
        place = places(pairs, keys)
        frequent = pairs[place] == keys
        at, place = at[frequent], place[frequent]
        chosen = np.zeros(len(pairs), dtype=bool)
        chosen[np.argsort(-counts, kind="stable")[:PER_ROUND]] = True
        symbol = base + len(rules) + np.cumsum(chosen) - 1
        rules.extend(zip((pairs[chosen] >> np.uint64(32)).tolist(), (pairs[chosen] & np.uint64(0xFFFFFFFF)).tolist()))
        hit, symbol = at[chosen[place]], symbol[place[chosen[place]]]
        # Of hits that overlap, every other one counts, from the left.
        starts = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
        even = (np.arange(len(hit)) - np.repeat(starts, np.diff(np.append(starts, len(hit))))) % 2 == 0
        hit, symbol = hit[even], symbol[even]
        seq[hit] = symbol
        last[hit] |= last[hit + 1]
        left = np.ones(len(seq), dtype=bool)
        left[hit + 1] = False
        moved = np.cumsum(left) - 1
        seq, last = seq[left], last[left]
        open_ = np.zeros(len(seq), dtype=bool)
        open_[moved[at[left[at]]]] = True
        open_[moved[hit]] = True
        open_[np.maximum(moved[hit] - 1, 0)] = True
        open_[-1] = False
        at = np.flatnonzero(open_ & ~last)


def expand(codes: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that codes stand for, one level of rules after another."""
    seq = codes.astype(np.int64)
    while True:
        deep = seq >= base
        if not deep.any():
            return seq.astype("<u4")
        at = np.cumsum(1 + deep) - 1 - deep
        out = np.empty(int(at[-1]) + 1 + int(deep[-1]), dtype=np.int64)
        out[at] = seq
        pair = rules[seq[deep] - base]
        out[at[deep]] = pair[:, 0]
        out[at[deep] + 1] = pair[:, 1]
        seq = out


def expand_all(codes: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """As expand(), for a whole shard: each rule is expanded once."""
    sizes = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])[codes]
    ends = np.cumsum(lengths, dtype=np.int64)
    whole = np.concatenate([np.arange(base, dtype="<u4"), expand(np.arange(base, base + len(rules)), rules, base)])
    at = np.concatenate([np.arange(base), base + ends - lengths])[codes]
    before = np.cumsum(sizes) - sizes
    return whole[np.repeat(at - before, sizes) + np.arange(int(sizes.sum()))]


def shard(part: int, block: int, doc_ids: list, texts: list[np.ndarray], base: int) -> dict:
    counts = np.array([len(x) for x in texts], dtype=np.int64)
    ids = np.concatenate(texts)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(counts) - 1] = True
    codes, ends, rules = compress(ids, last, base)
    lengths = np.ones(base + len(rules), dtype=np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[base + i] = lengths[a] + lengths[b]
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return {
        "part": part,
        "block": block,
        "doc_ids": np.array([NULL_ID if x is None else x for x in doc_ids], dtype="<i8").tobytes(),
        "n_tokens": counts.astype("<u4").tobytes(),
        "n_codes": np.diff(np.flatnonzero(ends), prepend=-1).astype("<u4").tobytes(),
        "codes": codes.astype(f"<u{width}").tobytes(),
        "rules": rules.astype("<u4").tobytes(),
        "lengths": lengths[base:].astype("<u4").tobytes(),
        "base": base,
        "width": width,
        "total": int(counts.sum()),
    }


def arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def write(docs: DataFrame, tokenizer: str, path: str, shard_ids: int = SHARD, end: int = END) -> None:
    """Encode docs and write the shards to path."""

    shared = docs.sparkSession.sparkContext.broadcast({})

    def run(batches):
        # A Python worker has one copy of the value for all its tasks: its table of known words serves them all.
        encoder = shared.value.get("encoder")
        if encoder is None:
            encoder = shared.value["encoder"] = WordEncoder(tokenizer)
        base = max(end + 1, encoder.tokenizer.get_vocab_size(with_added_tokens=True))
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, texts, held = [], [], 0
        tail = np.array([end], "<u2")
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.rows(batch.column("text"))):
                ids = np.concatenate([ids, tail])
                doc_ids.append(doc_id)
                texts.append(ids)
                held += len(ids)
                if held >= shard_ids:
                    yield pa.RecordBatch.from_pylist([shard(part, block, doc_ids, texts, base)], schema=arrow_schema())
                    doc_ids, texts, held, block = [], [], 0, block + 1
        if texts:
            yield pa.RecordBatch.from_pylist([shard(part, block, doc_ids, texts, base)], schema=arrow_schema())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)
    shared.unpersist()


class Shard:
    """A row of the file, with random access to its documents."""

    def __init__(self, row: dict) -> None:
        self.base = row["base"]
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.n_tokens = np.frombuffer(row["n_tokens"], "<u4").astype(np.int64)
        self.code_at = np.concatenate([[0], np.cumsum(np.frombuffer(row["n_codes"], "<u4"), dtype=np.int64)])
        self.codes = np.frombuffer(row["codes"], f"<u{row['width']}")
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], "<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the shard's document i."""
        return expand(self.codes[self.code_at[i] : self.code_at[i + 1]], self.rules, self.base)

    def token(self, i: int, k: int) -> int:
        """Id k of document i, expanding only the symbol that holds it."""
        codes = self.codes[self.code_at[i] : self.code_at[i + 1]].astype(np.int64)
        sizes = np.ones(len(codes), dtype=np.int64)
        deep = codes >= self.base
        sizes[deep] = self.lengths[codes[deep] - self.base]
        ends = np.cumsum(sizes)
        at = int(np.searchsorted(ends, k, side="right"))
        return int(expand(codes[at : at + 1], self.rules, self.base)[k - (ends[at] - sizes[at])])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of the file, from its decoded ids."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                ids = expand_all(s.codes, s.rules, s.lengths, s.base)
                ends = np.cumsum(s.n_tokens)
                starts = ends - s.n_tokens
                if ends[-1] != len(ids):
                    raise ValueError("a shard's codes don't match its counts")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                null = s.doc_ids == NULL_ID
                n = len(crc)
                arrays = [np.full(n, row["part"], np.int32), np.full(n, row["block"], np.int32), pa.array(s.doc_ids, mask=null), starts, s.n_tokens, np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    shards = spark.read.parquet(path)
    before = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("part", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    docs = shards.mapInArrow(run, "part int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "block"]).select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs to a new file in the shared folder, and what read() finds there."""
    path = shared_folder(docs.sparkSession)
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)
