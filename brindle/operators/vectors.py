"""Vector search, rank fusion and fuzzy search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.catalog import shared_folder
from brindle.functions.text import cosine, tokens

RRF_K = 60


def nearest(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """vec_id and cosine similarity of the k nearest, exactly: one scan and a top-k merge."""
    probe = F.array(*map(F.lit, query))
    return vectors.select("vec_id", cosine(F.col("embedding"), probe).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest vectors of each query(query_id, embedding).

    Queries are a stated set, taken in blocks; each task keeps its own k best for each query by a
    matrix product over Arrow batches, so only k rows a query and task are shuffled. Each block's
    result is written before the next block is read, so neither plan nor driver grow with the queries.
    """
    path = shared_folder(vectors.sparkSession)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    schema = "query_id long, vec_id long, score double, rank int"
    vectors.sparkSession.createDataFrame([], schema).write.parquet(path)
    rows = queries.select("query_id", "embedding").where("embedding IS NOT NULL")
    n = rows.count()
    blocks = 1 + n // block
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        ids = np.array([r["query_id"] for r in part])
        probe = np.array([r["embedding"] for r in part], dtype=np.float64)
        probe /= np.maximum(np.linalg.norm(probe, axis=1, keepdims=True), 1e-300)

        def run(batches, ids=ids, probe=probe):
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {i: (np.empty(0), np.empty(0, np.int64)) for i in range(len(ids))}
            for batch in batches:
                column = batch.column("embedding")
                ok = np.array([x is not None and len(x) == probe.shape[1] for x in column.to_pylist()])
                if not ok.any():
                    continue
                keys = batch.column("vec_id").to_numpy()[ok]
                mine = np.array(column.filter(pa.array(ok)).to_pylist(), dtype=np.float64)
                mine /= np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-300)
                scores = probe @ mine.T
                for i in best:
                    s, v = np.concatenate([best[i][0], scores[i]]), np.concatenate([best[i][1], keys])
                    top = np.lexsort((v, -s))[:k]
                    best[i] = s[top], v[top]
            for i, (s, v) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[i])), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

        found = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).write.mode("append").parquet(path)
    return vectors.sparkSession.read.schema(schema).parquet(path)


def embed(df: DataFrame, text: str, embedder: Callable[[Column], Column]) -> DataFrame:
    """Adds `embedding` by a caller's embedder, a function of a text Column (a pandas UDF, say)."""
    return df.withColumn("embedding", embedder(F.col(text)))


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """Adds the 1-based rank of a bounded list of hits(key, score)."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(lists: list[tuple[DataFrame, float]], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank) over lists of (key, rank)."""
    parts = [df.select(key, (F.lit(w) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy(key).agg(F.sum("part").alias("score"))


def best_per_resource(hits: DataFrame, resource: str, key: str, limit: int, min_score: float = 0.0, where: Column | None = None) -> DataFrame:
    """The best hit of each resource, over a least score and an optional filter, best first."""
    rows = hits.where(F.col("score") >= min_score)
    rows = rows if where is None else rows.where(where)
    best = F.max_by(F.struct(*hits.columns), F.struct("score", (-F.col(key)).alias("order"))).alias("best")
    return rows.groupBy(resource).agg(best).select("best.*").orderBy(F.desc("score"), key).limit(limit)


def safe(token: Column) -> Column:
    """Tokens that fuzzy matching may change: letters only, four bytes or more."""
    return token.rlike(r"^\p{L}+$") & (F.octet_length(token) >= 4)


def fuzzy_search(docs: DataFrame, terms: list[str], max_edits: int = 1, protected: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id and score by approximate terms.

    A term counts 1 if it is there, 0.85 if one is the beginning of the other, else 0.9 of the
    similarity of the best token within the allowed edits (none up to three letters, one for four,
    two beyond; max_edits at most) and similar enough (0.6 up to five letters, else 0.84). Protected
    terms and codes must be there exactly. Three quarters of the terms must match; the score is the
    mean over terms. Distances are computed once for each distinct token, not for each occurrence.
    """
    words = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    points = []
    for term in terms:
        q, n = F.lit(term), len(term.encode())
        edits = min(max_edits, 0 if n <= 3 else 1 if n == 4 else 2)
        exact_only = term in protected or any(c.isdigit() for c in term) or not term.isalpha() or n < 4 or edits <= 0
        if exact_only:
            points.append(F.when(F.col("token") == q, 1.0).otherwise(0.0))
            continue
        near = F.levenshtein(F.col("token"), q)
        similarity = 1 - near / F.greatest(F.length("token"), F.lit(len(term)))
        approx = F.when((near <= edits) & (similarity >= (0.60 if n <= 5 else 0.84)), 0.9 * similarity).otherwise(0.0)
        prefix = F.startswith(F.col("token"), q) | F.startswith(q, F.col("token"))
        points.append(F.when(F.col("token") == q, 1.0).when(safe(F.col("token")), F.when(prefix, 0.85).otherwise(approx)).otherwise(0.0))
    names = [f"p{i}" for i in range(len(terms))]
    scored = words.select("token").distinct().select("token", *[p.alias(n) for p, n in zip(points, names)])
    useful = scored.where(F.greatest(*map(F.col, names), F.lit(0.0)) > 0)
    best = words.join(useful, "token").groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    matched = sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in names), F.lit(0))
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return best.where(matched >= 0.75 * len(terms)).select("doc_id", (total / len(terms)).alias("score"))
