"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected number of copies is its source's
target over its source's size, so odds of inclusion differ between sources. The whole part is taken for certain. For the rest, documents are ranked by Pareto's order statistic,
the odds of a random number over the odds of inclusion, and taken from the smallest on until the
source's words are nearest its target. Random numbers come from MD5 of doc_id (where it is null, of
a hash of the text) and a seed, so reruns agree.

The cut in each source's ranking is found from sums over 1024 ranges of the statistic, then over
1024 parts of the range that holds it; only that part is sorted. No source is gathered in a task.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; a
source without words has target 0 and keeps one copy of its (empty) rows only where targets allow,
which is never. Rows with equal doc_id share a random number and are ordered by a hash of their
text; rows that are equal in both are taken together. An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.catalog import materialize
from brindle.llm.words import SPACED, Hasher, buffers, word_starts

WEIGHTS = (3, 1, 2)  # of sources in order, repeating
SHARE = 1.5  # words of the mix over words of the corpus
MAX_COPIES = 2
SEED = "mix"
BROADCAST_SOURCES = 50_000  # rows of the table of sources up to which it is broadcast
PARTS = 1024


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a hash of the text of each row."""

    def run(batches):
        word = Hasher(SPACED).word
        for batch in batches:
            data, at = buffers(batch.column("text"))
            out = np.zeros(len(at) - 1, np.int64)
            row = 0
            while row < len(out):  # a few MB at a time
                end = max(row + 1, int(np.searchsorted(at, at[row] + (8 << 20), side="right")) - 1)
                begins = at[row : end + 1] - at[row]
                first = word_starts(word[data[at[row] : at[end]]], begins)
                out[row:end] = np.diff(np.concatenate([[0], np.cumsum(first)])[begins])
                row = end
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(out), batch.column("tie")], ["doc_id", "source", "size", "tie"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", F.xxhash64("text").alias("tie"))
    return picked.mapInArrow(run, "doc_id long, source string, size long, tie long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """source, source_size and target of each source.

    Sources in order of code points, null last, have the given weights in turn. The words of the
    mix are shared out by weight; no target exceeds most times its source's size, and what is
    above goes to the others by weight. One row a source goes through one task here.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    place = (F.row_number().over(every) - 1) % len(weights)
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    capped = (
        per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("words", share * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("full", F.col("level") > F.col("room"))
        .withColumn("left", F.col("words") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole))
        .withColumn("heft", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole))
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("left") / F.col("heft") * F.col("weight"))
    return capped.select("source", "source_size", target.alias("target"))


def random_number(doc_id: Column, tie: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) of a document, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), tie.cast("string")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def with_rank(df: DataFrame, seed: str) -> DataFrame:
    """Adds whole copies and the Pareto statistic (null where no part of a copy is left), scaled to (0, 1)."""
    u = random_number(F.col("doc_id"), F.col("tie"), seed)
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    return df.withColumn("part", F.col("copies") - F.floor("copies")).withColumn("rank", F.when(F.col("part") > 0, odds / (1 + odds)))


def joined(df: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    """The table of sources is broadcast if it is known to be small, else it is an ordinary join."""
    side = per_source.withColumnRenamed("source", "of_source")
    return df.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")


def allocate(sized: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """A row for each source: source_size, target, copies expected of each document, and the cut of the ranking."""
    per_source = materialize(targets(sized, **shares))
    small = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    most = shares.get("most", MAX_COPIES)
    plan = per_source.withColumn("copies", F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    plan = plan.withColumn("wanted", F.col("target") - F.floor("copies") * F.col("source_size"))
    ranked = with_rank(joined(sized, plan.select("source", "copies"), small), seed).where("rank IS NOT NULL").select("doc_id", "source", "size", "tie", "rank")
    cut, scale = plan.select("source", F.col("wanted").alias("left")), 1.0
    rows = ranked
    for _ in range(2):
        scale *= PARTS
        rows = rows.withColumn("range", F.floor(F.col("rank") * scale))
        sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = joined(sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))), cut, small)
        last = F.max_by(F.struct("range", (F.col("left") - F.col("before")).alias("left")), F.col("range"))
        at = sums.where(F.col("before") <= F.col("left")).groupBy("source").agg(last.alias("x")).select("source", F.col("x.range").alias("cut_range"), F.col("x.left").alias("left"))
        at = materialize(at)
        rows = joined(rows, at.select("source", "cut_range"), small).where("range = cut_range").drop("cut_range")
        cut = at.select("source", "left")
    ordered = Window.partitionBy("source").orderBy("rank", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = joined(rows.withColumn("before", F.coalesce(F.sum("size").over(ordered), F.lit(0))), cut, small)
    taken = rows.where(F.col("before") + F.col("size") / 2 <= F.col("left"))
    ends = taken.groupBy("source").agg(F.max(F.struct("rank", "doc_id", "tie")).alias("last"))
    # Where no row of that part is taken, all of the ranges before it are.
    at = at.select("source", (F.col("cut_range") / scale).alias("from_rank"))
    return materialize(joined(joined(plan, at, small), ends, small))


def with_copies(df: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds source_size, target and the whole number of copies taken of each row."""
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    ranked = with_rank(joined(df, plan, small), seed)
    me = F.struct("rank", F.col("doc_id").cast("long").alias("doc_id"), "tie")
    extra = F.col("rank").isNotNull() & ((F.col("rank") < F.col("from_rank")) | (me <= F.col("last")))
    return ranked.withColumn("copies", F.floor("copies") + F.when(extra, 1).otherwise(0)).drop("part", "rank", "from_rank", "last", "wanted")


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """Each row's size, its source's size and target, and the words of it that the mix takes."""
    sized = materialize(sizes(docs))
    found = with_copies(sized, allocate(sized, seed, **shares), seed)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with all columns of docs. Texts aren't shuffled."""
    plan = allocate(materialize(sizes(docs)), seed, **shares)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = row.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").alias("source"), F.xxhash64("row.text").alias("tie"))
    taken = with_copies(keyed, plan, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
