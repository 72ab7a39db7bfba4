"""Property-graph operators over edges(source, target, type, confidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.catalog import materialize
from brindle.functions.predicates import truth
from brindle.operators.components import components

MAX_DEPTH = 16


def relations(edges: DataFrame, where: dict[str, list], min_confidence: float = 0.0) -> DataFrame:
    """Edges whose columns are among the given values; deleted ones only if status asks for them."""
    tests = [F.col(c).isin(v) for c, v in where.items()] + [F.col("confidence") >= min_confidence]
    if "status" in edges.columns and "status" not in where:
        tests.append(~truth(F.col("status") == "deleted"))
    return edges.where(reduce(lambda a, b: a & b, tests))


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(here, there) of each step along edges: out, in or both."""
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"))
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].where("here IS NOT NULL AND there IS NOT NULL").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "out") -> DataFrame:
    """(node, distance) of what lies within depth steps of seeds(node), breadth first.

    Each level is a join of the frontier with the edges and an anti-join with what is known; it is
    written to the shared folder, so a plan doesn't grow with depth.
    """
    links = materialize(steps(edges, direction))
    frontier = materialize(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    known = frontier
    for level in range(1, min(depth, MAX_DEPTH) + 1):
        new = frontier.join(links, F.col("node") == F.col("here")).select(F.col("there").alias("node")).distinct()
        frontier = materialize(new.join(known, "node", "left_anti").withColumn("distance", F.lit(level)))
        if not frontier.limit(1).count():
            break
        known = known.union(frontier)
    return known


def seeded(seeds: DataFrame, hits: DataFrame, limit: int = 10) -> DataFrame:
    """seeds(node) and the nodes of the first `limit` of ranked hits(chunk_id, hits, occurrences), each once."""
    first = hits.orderBy(F.desc("hits"), F.desc("occurrences"), "chunk_id").limit(limit)
    return seeds.select("node").union(first.select("chunk_id").where("chunk_id <> ''")).distinct()


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "out") -> DataFrame:
    """The edges along which reach() goes: those between nodes it finds, from a node nearer than depth."""
    found = reach(edges, seeds, depth, direction)
    here, there = ("target", "source") if direction == "in" else ("source", "target")
    near = found.where(F.col("distance") < depth).select(F.col("node").alias("near"))
    used = edges.join(near, F.col(here) == F.col("near"), "left_semi")
    return used.union(edges.join(near, F.col(there) == F.col("near"), "left_semi")).distinct() if direction == "both" else used


def shortest_paths(edges: DataFrame, source: str, target: str, depth: int = 8, direction: str = "out") -> DataFrame:
    """The path of fewest steps as an array; of several, the least. No row if there is none."""
    links = materialize(steps(edges, direction))
    spark = edges.sparkSession
    paths = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = paths.select("node")
    for _ in range(depth + 1):
        goal = paths.where(F.col("node") == target)
        if goal.limit(1).count():
            return goal.agg(F.min("path").alias("path")).where("path IS NOT NULL")
        grown = paths.join(links, F.col("node") == F.col("here")).select(F.col("there").alias("node"), F.concat("path", F.array("there")).alias("path"))
        paths = materialize(grown.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if not paths.limit(1).count():
            break
        seen = seen.union(paths.select("node"))
    return paths.limit(0).select("path")


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree and degree."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return sums.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def node_type(node: Column) -> Column:
    """What stands before the first : or / of a node's name."""
    return F.regexp_extract(node, "^([^:/]*)[:/]", 1)


def component_sizes(edges: DataFrame) -> DataFrame:
    """component (its least node) and number of members."""
    found = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return found.groupBy("component").agg(F.count("*").alias("members"))


def resolve_aliases(names: DataFrame, aliases: DataFrame, limit: int | None = MAX_DEPTH) -> DataFrame:
    """names(name) with `canonical`, following aliases(alias, canonical); NULL for a cycle or a chain beyond limit (None: any length).

    Each round joins the steps so far with themselves, so a chain of n aliases takes log2(n) rounds.
    What still moves after as many steps as there are aliases goes round in a cycle.
    """
    aliases = aliases.where("alias <> canonical")
    chain = materialize(aliases.select(F.col("alias").alias("from"), F.col("canonical").alias("to"), F.lit(1).cast("long").alias("steps")).distinct())
    most, made = chain.count(), 1
    while True:
        ahead = chain.select(F.col("from").alias("at"), F.col("to").alias("then"), F.col("steps").alias("more"))
        both = chain.join(ahead, F.col("to") == F.col("at"), "left")
        moved = F.col("at").isNotNull()
        chain = materialize(both.select("from", F.coalesce("then", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), moved.alias("moved")))
        made *= 2
        if made > most or not chain.where("moved").limit(1).count():
            break
        chain = chain.drop("moved")
    ends = chain.join(aliases.select(F.col("alias").alias("open")).distinct(), F.col("to") == F.col("open"), "left")
    late = F.col("open").isNotNull() if limit is None else F.col("open").isNotNull() | (F.col("steps") > limit)
    ends = ends.select("from", F.when(~late, F.col("to")).alias("to"))
    return names.join(ends, F.col("name") == F.col("from"), "left").select("name", F.when(F.col("from").isNull(), F.col("name")).otherwise(F.col("to")).alias("canonical"))


def ontology_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(relation, rule) of edges that break rules(type, source_types, target_types, max_out, max_in).

    Unknown types are violations; cardinality is counted over each end's edges of the type.
    """
    small = rules.limit(10_001).count() <= 10_000
    checked = edges.join(F.broadcast(rules) if small else rules, "type", "left")
    counted = checked
    for end, n in (("source", "n_out"), ("target", "n_in")):  # counted before they are joined, so a node of very many edges isn't one task
        sums = edges.groupBy(F.col("type").alias("t"), F.col(end).alias("e")).agg(F.count("*").alias(n))
        counted = counted.join(sums, F.col("type").eqNullSafe(F.col("t")) & F.col(end).eqNullSafe(F.col("e")), "left").drop("t", "e")
    broken = F.array(
        F.when(F.col("source_types").isNull(), F.lit("unknown_type")),
        F.when(~F.array_contains("source_types", node_type(F.col("source"))), F.lit("source_type")),
        F.when(~F.array_contains("target_types", node_type(F.col("target"))), F.lit("target_type")),
        F.when(F.col("n_out") > F.col("max_out"), F.lit("max_out")),
        F.when(F.col("n_in") > F.col("max_in"), F.lit("max_in")),
    )
    return counted.select("source", "target", "type", F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("rule"))


# Entity types that name the same thing, and those that refer to one.
SAME_AS = ["EMAIL", "DOMAIN", "URL", "ORG", "PERSON"]
REFERENCES = ["TICKET_ID", "CASE_ID", "INVOICE_ID", "CONTRACT_ID", "POLICY_ID", "ACCOUNT_ID"]


def resource_graph(mentions: DataFrame, min_shared: int = 1, hub: int | None = None) -> DataFrame:
    """Edges between resources that mention the same entities, from mentions(resource, family, type, canonical, confidence).

    The kind follows the most confident shared entity; each further shared one adds 0.05, up to 0.99.
    An entity of very many resources makes many pairs by definition; hub, if given, is the caller's
    choice to leave entities with more resources out.
    """
    each = mentions.groupBy("resource", "family", "type", "canonical").agg(F.max("confidence").alias("confidence"))
    if hub is not None:
        common = each.groupBy("type", "canonical").agg(F.count("*").alias("n")).where(F.col("n") > hub)
        each = each.join(common, ["type", "canonical"], "left_anti")
    a = each.select("type", "canonical", F.col("resource").alias("a"), F.col("family").alias("fa"), "confidence")
    b = each.select("type", "canonical", F.col("resource").alias("b"), F.col("family").alias("fb"))
    pairs = a.join(b, ["type", "canonical"]).where("a < b")
    best = F.max(F.struct("confidence", "type", "canonical")).alias("best")
    found = pairs.groupBy("a", "b", "fa", "fb").agg(F.count("*").alias("shared"), best).where(F.col("shared") >= min_shared)
    kind = (
        F.when(F.col("best.type").isin(SAME_AS) & (F.col("fa") == F.col("fb")), "same_as")
        .when(F.col("best.type").isin(REFERENCES), "references")
        .when(F.col("shared") > 1, "related_to")
        .otherwise("mentions_same_entity")
    )
    confidence = F.least(F.lit(0.99), F.col("best.confidence") + 0.05 * (F.col("shared") - 1))
    return found.select("a", "b", "shared", kind.alias("kind"), F.round(confidence, 6).alias("confidence"))


def materialize_edges(new: DataFrame, existing: DataFrame, key: str, overwrite: bool) -> DataFrame:
    """(key, status): what writing the new edges would create, overwrite or skip."""
    known = existing.select(F.col(key).alias("known")).distinct()
    status = F.when(F.col("known").isNull(), "created").otherwise("overwritten" if overwrite else "skipped")
    return new.join(known, F.col(key) == F.col("known"), "left").select(key, status.alias("status"))


def latest_relations(log: DataFrame) -> DataFrame:
    """The last revision of each relation of log(relation_id, revision, status, …), deleted ones left out."""
    rest = [c for c in log.columns if c not in ("relation_id", "revision")]
    last = F.max(F.struct("revision", *rest)).alias("last")
    return log.groupBy("relation_id").agg(last).select("relation_id", "last.*").where("status <> 'deleted'")


def boost(hits: DataFrame, distances: DataFrame, mentions: DataFrame) -> DataFrame:
    """Hits(key, score) raised by the largest confidence / (distance + 1) over the nodes they mention."""
    best = mentions.join(distances, "node").groupBy("key").agg(F.max(F.col("confidence") / (F.col("distance") + 1)).alias("boost"))
    return hits.join(best, "key", "left").select("key", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"))


def with_context(hits: DataFrame, edges: DataFrame, search_weight: float = 1.0, context_weight: float = 0.35) -> DataFrame:
    """Hits(key, score) with the confidence of their edges to other hits added, and how they were found."""
    ends = edges.select(F.col("source").alias("key"), F.col("target").alias("other"), "confidence").union(edges.select("target", "source", "confidence"))
    near = ends.join(hits.select(F.col("key").alias("hit")), F.col("other") == F.col("hit")).groupBy("key").agg(F.sum("confidence").alias("context"))
    both = hits.join(near, "key", "full")
    score = F.coalesce("score", F.lit(0.0)) * search_weight + F.coalesce("context", F.lit(0.0)) * context_weight
    kind = F.when(F.col("score").isNull(), "related").when(F.col("context").isNull(), "direct").otherwise("direct+context")
    return both.select("key", score.alias("score"), kind.alias("match_kind"))
