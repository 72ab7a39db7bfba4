"""Personal data: base patterns as seeds, and bootstrapped contextual extraction.

One pass over the texts finds the base matches of each kind and other strings that look like
identifiers, each with its lexical patterns: the two words before it, the word before it, the words
around it, a label (a word that ends in a sign such as a colon) and the word its line begins with.
Spark then scores the graph of patterns and instances: a pattern's confidence for a kind is the
score of the kind's instances in it over all its instances (plus one), given SUPPORT of them; an
instance is as sure as its patterns together (noisy or). Instances from ACCEPT on count as seeds in
the next round and stay accepted; rounds go on until no instance is added. In the end every occurrence
of an accepted instance is a span. A number is a candidate of every kind that its digit count allows,
and of the kinds whose patterns accept an occurrence it is a span of the surest, then of the first.

Defined cases: a null text is empty. Rows are told apart by an id of their own, so repeated rows
and null doc_ids each get their spans. An instance that is itself a base match of another kind is
never added. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.catalog import materialize

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3  # distinct seeds and accepted instances that a pattern needs
ACCEPT = 0.7

# Base patterns. Possessive runs match what the plain ones match, in linear time.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9@]")
# Strings that look like an identifier of a kind.
HANDLE = re.compile(r"@[A-Za-z0-9-]++")
NUMBER = re.compile(r"(?<![A-Za-z0-9_])\(?[0-9](?:[\x20().-]{0,2}[0-9])++(?![A-Za-z0-9_])")  # not within a word
EDGE = " \t\n\r.,;:!?()[]{}<>\"'#*$%&|"

SCHEMA = (
    "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<start:long,rank:int,stop:long>>, "
    "seen array<struct<start:long,rank:int,stop:long,seed:boolean,instance:string,patterns:array<string>>>"
)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with the run of local characters before it and a domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of all base matches, in order."""
    if not DIGIT.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def likely_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """Spans that look like a kind without being a base match."""
    for m in HANDLE.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, 0, m.end()
    for m in NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        dots = m[0].count(".")
        if dots == 3 and " " not in m[0]:
            yield m.start(), 1, m.end()
        if 12 <= n <= 19:
            yield m.start(), 2, m.end()
        if 7 <= n <= 15:
            yield m.start(), 3, m.end()


def word(text: str) -> str:
    return re.sub("[0-9]+", "0", text.strip(EDGE).lower())


def patterns(text: str, start: int, stop: int) -> list[str]:
    before = text[max(0, start - 80) : start]
    left = before.split()[-2:]
    words = [word(x) for x in left]
    right = [word(x) for x in text[stop : stop + 40].split()[:1]]
    near = words[-1] if words else "^"
    found = [f"before {words[0] if len(words) == 2 else '^'} {near}", f"around {near} {right[0] if right else '$'}", f"word {near}"]
    if left and left[-1][-1] in ":=#" and near:
        found.append(f"label {near}")
    line = before.rpartition("\n")[2].split() if "\n" in before or start <= 80 else []
    if line:
        found.append(f"line {word(line[0])}")
    return found


def examined(text: str) -> tuple[list, list]:
    """Base spans, and all instances with their patterns."""
    base = base_spans(text)
    seen = [(a, k, b, True, text[a:b].lower(), patterns(text, a, b)) for a, k, b in base]
    if DIGIT.search(text):
        starts = [a for a, _, _ in base]
        upto = [0, *accumulate((b for _, _, b in base), max)]  # the furthest end of so many base spans
        for a, k, b in likely_spans(text):
            if upto[bisect_left(starts, b)] <= a:
                seen.append((a, k, b, False, text[a:b].lower(), patterns(text, a, b)))
    return base, seen


def text_of(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def instances(docs: DataFrame) -> DataFrame:
    """Base matches and instances of each row of docs."""

    def run(batches):
        for batch in batches:
            rows = []
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                base, seen = examined(text.as_py() or "")
                counts = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append((row, doc_id, *counts, hashlib.sha256(text_of(base).encode()).hexdigest(), base, seen))
            columns = list(zip(*rows)) if rows else [()] * 9
            span = [("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64())]
            seen = [*span, ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.string())]
            for c, kind in ((columns[7], span), (columns[8], seen)):
                names = [n for n, _ in kind]
                arrays.append(pa.array([[dict(zip(names, x)) for x in row] for row in c], pa.list_(pa.struct(kind))))
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen"])

    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(run, SCHEMA)


def accepted(seen: DataFrame) -> DataFrame:
    """(instance, rank) of the instances that the pattern graph makes sure of; seen: a row for each occurrence."""
    graph = materialize(seen.select(F.explode("patterns").alias("pattern"), "instance", "rank", "seed").groupBy("pattern", "instance", "rank").agg(F.max("seed").alias("seed")))
    candidates = materialize(graph.drop("seed").join(graph.where("seed").select("instance").distinct(), "instance", "left_anti"))
    totals = materialize(graph.groupBy("pattern").agg(F.count_distinct("instance").alias("all")))
    sure = None
    while True:
        edges, left = graph, candidates
        if sure is not None:
            edges = graph.join(sure.withColumn("found", F.lit(True)), ["instance", "rank"], "left").withColumn("seed", F.col("seed") | F.col("found").isNotNull())
            left = candidates.join(sure.select("instance"), "instance", "left_anti")
        of_kind = edges.groupBy("pattern", "rank").agg(F.sum(F.col("seed").cast("int")).alias("good"), F.min("seed").alias("only_good"))
        scored = (
            of_kind.where((F.col("good") >= SUPPORT) & ~F.col("only_good"))
            .join(totals, "pattern")
            .select("pattern", "rank", (F.col("good") / (F.col("all") + 1)).alias("confidence"))
            .where(F.col("confidence") >= ACCEPT / 2)
        )
        new = materialize(
            left.join(scored, ["pattern", "rank"])
            .groupBy("instance", "rank")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
            .where(F.col("score") >= ACCEPT)
            .groupBy("instance")
            .agg(F.max_by("rank", F.struct(F.round("score", 9), -F.col("rank"))).alias("rank"))
        )
        if not new.limit(1).count():
            return new if sure is None else sure
        sure = new if sure is None else materialize(sure.union(new))


def find(docs: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans, of each row of docs."""
    rows = materialize(instances(docs))
    seen = rows.where(F.size("seen") > 0).select("row", F.explode("seen").alias("x")).select("row", "x.*")
    sure = accepted(seen)
    added = seen.where(~F.col("seed")).join(sure, ["instance", "rank"]).groupBy("row").agg(F.collect_set(F.struct("start", "rank", "stop")).alias("added"))
    found = rows.drop("seen").join(added, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:long,rank:int,stop:long>>"))))
    kinds = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))
