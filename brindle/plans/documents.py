"""Text pipeline, vector and fuzzy search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.functions import text as T
from brindle.operators import documents as X
from brindle.operators import search as S
from brindle.operators import vectors as V
from brindle.plans.base import registry as r

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
CHUNKS = f"""
SELECT doc_id, CAST(i AS INTEGER) AS index, 'chk-' || substr(sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 16) AS chunk_id,
       CASE WHEN len(w) <= 256 THEN text ELSE array_to_string(w[i * 192 + 1:i * 192 + 256], ' ') END AS chunk, CAST(least(len(w) - i * 192, 256) AS INTEGER) AS n_words
FROM (SELECT doc_id, text, w, unnest(range(0, CASE WHEN len(w) <= 256 THEN 1 ELSE CAST(ceil((len(w) - 256) / 192.0) AS BIGINT) + 1 END)) AS i
      FROM (SELECT doc_id, text, {WORDS} AS w FROM documents) WHERE len(w) > 0)
"""
r.query("chunk_windows", CHUNKS)(lambda spark, sf_dir: X.chunks(table(spark, sf_dir, "documents")))


def found(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_extract_all({text}, '{quoted}')"


NER = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rule, '{rule.type}' AS type, {rule.confidence}::DOUBLE AS confidence, place, s AS surface, "
    f"{'lower(s)' if rule.case == 'lower' else 'upper(s)' if rule.case == 'upper' else 's'} AS canonical "
    f"FROM (SELECT doc_id, unnest({found('text', rule.pattern)}) AS s, unnest(range(len({found('text', rule.pattern)}))) AS place FROM documents)"
    for i, rule in enumerate(X.RULES)
)


@r.query(
    "ner_entities",
    f"""
    SELECT doc_id, type, canonical, arg_min(surface, (rule, place)) AS surface, arg_min(confidence, (rule, place)) AS confidence, count(*) AS mentions
    FROM ({NER}) GROUP BY doc_id, type, canonical
    """,
)
def ner_entities(spark, sf_dir):
    return X.entities(table(spark, sf_dir, "documents"))


CUSTOM = [*X.RULES[:1], X.Rule("TOKEN", r"token = \"[0-9a-f]{40}\"", 0.9), X.Rule("SOURCE_TAG", r"\bLicen[sc]ed?\b", 0.5, "lower")]


@r.query(
    "ner_custom_rules",
    f"""
    SELECT type, canonical, CAST(sum(n) AS BIGINT) AS mentions FROM (
        SELECT 'TOKEN' AS type, s AS canonical, count(*) AS n FROM (SELECT unnest({found('text', CUSTOM[1].pattern.replace(chr(92) + chr(34), chr(34)))}) AS s FROM documents) GROUP BY s
        UNION ALL SELECT 'SOURCE_TAG', lower(s), count(*) FROM (SELECT unnest({found('text', CUSTOM[2].pattern)}) AS s FROM documents) GROUP BY s
    ) GROUP BY type, canonical
    """,
)
def ner_custom_rules(spark, sf_dir):
    found = X.entities(table(spark, sf_dir, "documents"), CUSTOM).where("type <> 'EMAIL'")
    return found.groupBy("type", "canonical").agg(F.sum("mentions").alias("mentions"))


LUHN = "(SELECT sum(CASE WHEN i % 2 = 0 THEN d ELSE d * 2 - CASE WHEN d > 4 THEN 9 ELSE 0 END END) % 10 = 0 FROM (SELECT i, CAST(substr(s, length(s) - i, 1) AS INTEGER) AS d FROM (SELECT unnest(range(length(s))) AS i)))"


@r.query(
    "pii_classify",
    "WITH hits AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {d.confidence}::DOUBLE AS c, s FROM (SELECT doc_id, unnest({found('text', d.pattern)}) AS s FROM documents)" + (f" WHERE length(s) BETWEEN 13 AND 19 AND {LUHN}" if d.luhn else "") for d in X.DETECTORS)
    + """)
    SELECT d.doc_id, CAST(count(c) AS INTEGER) AS n_found, coalesce(max(c), 0.0) AS confidence, CASE WHEN coalesce(max(c), 0.0) >= 0.7 THEN 'restricted' ELSE 'internal' END AS data_class
    FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id
    """,
)
def pii_classify(spark, sf_dir):
    return X.classify(table(spark, sf_dir, "documents"))


@r.query("luhn_cards", f"SELECT doc_id, s AS card FROM (SELECT doc_id, unnest({found('text', '[0-9]{13,19}')}) AS s FROM documents) WHERE {LUHN}")
def luhn_cards(spark, sf_dir):
    card = X.Detector("pci", "card", "[0-9]{13,19}", 0.9, "encrypt", True)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.detections(card, F.col("text"))).alias("card"))


@r.query("pii_mask")
def pii_mask(spark, sf_dir):
    """Masked texts; replaced strings depend on one another, so it is compared with brute force in the tests."""
    return X.masked(table(spark, sf_dir, "documents"))


@r.query("mask_strategies", "SELECT c_custkey, repeat('*', length(c_name)) AS full_mask, repeat('*', length(c_name) - 4) || right(c_name, 4) AS partial_mask, '[REDACTED]' AS redacted FROM customer")
def mask_strategies(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", T.mask(name, "full").alias("full_mask"), T.mask(name, "partial").alias("partial_mask"), T.mask(name, "redact").alias("redacted"))


@r.query("sql_column_masking", "SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS c_name, c_mktsegment FROM customer")
def sql_column_masking(spark, sf_dir):
    shown = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return X.mask_columns(shown, {"c_name": "confidential", "c_mktsegment": "internal"})


@r.query("corpus_analytics", f"SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM ({CHUNKS})) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT doc_id, type, canonical FROM ({NER}))) AS entities")
def corpus_analytics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = [docs.agg(F.count("*").alias("documents")), X.chunks(docs).agg(F.count("*").alias("chunks")), X.entities(docs).agg(F.count("*").alias("entities"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one row each


@r.query("corpus_entity_types", f"SELECT type, count(*) AS entities, CAST(sum(n) AS BIGINT) AS mentions FROM (SELECT doc_id, type, canonical, count(*) AS n FROM ({NER}) GROUP BY ALL) GROUP BY type")
def corpus_entity_types(spark, sf_dir):
    return X.entities(table(spark, sf_dir, "documents")).groupBy("type").agg(F.count("*").alias("entities"), F.sum("mentions").alias("mentions"))


@r.query("entity_resolution")
def entity_resolution(spark, sf_dir):
    """Greedy clustering of organisation-like names by Jaro-Winkler, in scopes; compared with brute force in the tests."""
    part = table(spark, sf_dir, "part")
    return X.resolve(part.select(F.col("p_brand").alias("scope"), F.lit("PART").alias("type"), F.col("p_name").alias("surface")))


@r.query("entity_key_lookup", f"SELECT lower(type) || ':' || lower(trim(canonical)) AS key, count(DISTINCT doc_id) AS documents FROM ({NER}) GROUP BY ALL")
def entity_key_lookup(spark, sf_dir):
    found = X.entities(table(spark, sf_dir, "documents"))
    return found.groupBy(X.entity_key(F.col("type"), F.col("canonical")).alias("key")).agg(F.count_distinct("doc_id").alias("documents"))


SPANS = f"""
SELECT doc_id, position(s IN text) AS start, position(s IN text) + length(s) AS stop, s FROM (SELECT DISTINCT doc_id, text, unnest({found('text', X.RULES[0].pattern)}) AS s FROM documents)
"""


@r.query("chunk_entity_overlap", f"SELECT e.doc_id, s AS surface, c.part FROM ({SPANS}) e JOIN (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS part FROM documents) c ON e.doc_id = c.doc_id AND e.stop > c.part * 500 + 1 AND e.start < c.part * 500 + 501")
def chunk_entity_overlap(spark, sf_dir):
    """Entities and the pieces of 500 characters that they overlap: an equi-join on the document with a range of places."""
    docs = table(spark, sf_dir, "documents")
    emails = docs.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(X.RULES[0].pattern), F.lit(0)))).alias("surface"))
    spans = emails.select("doc_id", "surface", F.instr("text", F.col("surface")).alias("start")).withColumn("stop", F.col("start") + F.length("surface"))
    pieces = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 500).cast("long") - 1)).alias("part"))
    overlap = (spans.doc_id == pieces.doc_id) & (spans.stop > pieces.part * 500 + 1) & (spans.start < pieces.part * 500 + 501)
    return spans.join(pieces, overlap).select(spans.doc_id, "surface", "part")


# Vectors.

PROBE = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


@r.query("knn_cosine", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]) DESC, vec_id LIMIT 20")
def knn_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    probe = vectors.where("vec_id = 7").select("embedding").first()[0]
    return V.nearest(vectors, list(probe), 20).select("vec_id", F.round("score", 6).alias("score"))


@r.query(
    "knn_of_each",
    """
    SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
        FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5
    """,
)
def knn_of_each(spark, sf_dir):
    """A stated query set, every hundredth vector, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.nearest_of_each(vectors, queries, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


COUNTS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x = '%s')"


@r.query(
    "rrf_hybrid",
    f"""
    WITH k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY len({COUNTS % 'the'}) DESC, doc_id) AS rank FROM documents WHERE len({COUNTS % 'the'}) > 0 ORDER BY rank LIMIT 50),
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 50)
    SELECT id, round(sum(part), 8) AS score FROM (SELECT id, 0.5 / (60 + rank) AS part FROM k UNION ALL SELECT id, 0.5 / (60 + rank) FROM v) GROUP BY id
    """,
)
def rrf_hybrid(spark, sf_dir):
    """Keyword and vector lists fused by rank."""
    words = S.search(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), S.parse("the"), limit=50).withColumnRenamed("doc_id", "id")
    vectors = table(spark, sf_dir, "embeddings")
    near = V.nearest(vectors, list(vectors.where("vec_id = 7").first()["embedding"]), 50).withColumnRenamed("vec_id", "id")
    fused = V.fuse([(V.ranked(words, "id"), 0.5), (V.ranked(near, "id"), 0.5)], "id")
    return fused.select("id", F.round("score", 8).alias("score"))


@r.query(
    "best_hit_per_resource",
    f"SELECT source, doc_id, score FROM (SELECT source, doc_id, len({COUNTS % 'and'})::DOUBLE AS score, row_number() OVER (PARTITION BY source ORDER BY len({COUNTS % 'and'}) DESC, doc_id) AS n FROM documents WHERE len({COUNTS % 'and'}) >= 2) WHERE n = 1 ORDER BY score DESC, doc_id LIMIT 15",
)
def best_hit_per_resource(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("source", "doc_id", F.size(F.filter(T.tokens(F.col("text")), lambda t: t == "and")).cast("double").alias("score"))
    return V.best_per_resource(hits, "source", "doc_id", 15, 2.0)


@r.query(
    "fuzzy_search",
    r"""
    WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM documents),
    q AS (SELECT unnest(['licensed', 'apache', 'versoin']) AS q),
    p AS (SELECT doc_id, q, max(CASE WHEN t = q THEN 1.0 WHEN NOT regexp_full_match(t, '\p{L}+') OR strlen(t) < 4 THEN 0.0 WHEN starts_with(t, q) OR starts_with(q, t) THEN 0.85
            WHEN levenshtein(t, q) <= 2 AND 1 - levenshtein(t, q) / greatest(length(t), length(q))::DOUBLE >= CASE WHEN length(q) <= 5 THEN 0.6 ELSE 0.84 END
            THEN 0.9 * (1 - levenshtein(t, q) / greatest(length(t), length(q))::DOUBLE) ELSE 0.0 END::DOUBLE) AS s FROM w, q GROUP BY doc_id, q)
    SELECT doc_id, round(sum(s) / 3, 6) AS score FROM p GROUP BY doc_id HAVING count(*) FILTER (s > 0) >= 0.75 * 3
    """,
)
def fuzzy_search(spark, sf_dir):
    found = V.fuzzy_search(table(spark, sf_dir, "documents"), ["licensed", "apache", "versoin"], max_edits=2)
    return found.select("doc_id", F.round("score", 6).alias("score"))
