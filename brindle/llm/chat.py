"""Chat formatting with perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as assistant,
the others as named users, and system turns as they are. The mask covers the assistant's texts with
their end marks. Conversations are rendered in parts of PART turns by turn number, so a long one is
spread over many groups; a part holds whole turns, and the parts in order are the dialogue.

Defined cases: turns are ordered by number, null last (a part of its own, the last one), then by
speaker and text. A row that is repeated exactly is one message, with its number of repeats counted
in n_repeats. A null role is the speaker `unknown`; a null text is empty; marks inside texts are
broken up. A conversation without participants other than the system has no rows. Null conv_ids are
one conversation. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 64
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>"


def header(speaker: Column, me: Column) -> Column:
    role = F.when(speaker == SYSTEM, F.lit(SYSTEM)).when(speaker == me, F.lit("assistant"))
    return F.concat(F.lit(START), F.coalesce(role, F.concat(F.lit("user name="), speaker)), F.lit("\n"))


def rotate(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, perspective, part, n_messages, n_repeats, n_trained, text and the mask's spans (start:stop in code points)."""
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.regexp_replace(F.coalesce("role", F.lit("unknown")), r"[^\p{L}\p{N}_.-]", "_").alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    once = turns.groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("n"))
    parts = once.groupBy("conv_id", F.floor(F.col("turn") / part).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "speaker", "text", "n"))).alias("messages")
    )
    speakers = turns.where(F.col("speaker") != SYSTEM).groupBy("conv_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    of = speakers.withColumnRenamed("conv_id", "of")
    views = parts.join(of, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "part", "messages", F.explode("speakers").alias("perspective"))
    me = F.col("perspective")
    heads = F.transform("messages", lambda m: header(m["speaker"], me))
    bodies = F.transform("messages", lambda m: F.concat(m["text"], F.lit(END)))
    cut = views.withColumn("heads", heads).withColumn("bodies", bodies)
    cut = cut.withColumn("sizes", F.zip_with("heads", "bodies", lambda h, b: F.length(h) + F.length(b) + 1))
    zero = F.lit(0)

    def span(i: Column) -> Column:
        start = F.aggregate(F.slice("sizes", 1, i), zero, lambda a, x: a + x) + F.length(F.col("heads")[i])
        return F.when(F.col("messages")[i]["speaker"] == me, F.concat_ws(":", start.cast("string"), (start + F.length(F.col("bodies")[i])).cast("string")))

    spans = F.filter(F.transform(F.sequence(zero, F.size("messages") - 1), span), lambda s: s.isNotNull())
    return cut.select(
        "conv_id",
        "perspective",
        F.col("part").cast("long").alias("part"),
        F.size("messages").cast("long").alias("n_messages"),
        F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + m["n"] - 1).alias("n_repeats"),
        F.size(spans).cast("long").alias("n_trained"),
        F.array_join(F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit("\n"))), "").alias("text"),
        F.array_join(spans, ",").alias("spans"),
    )
