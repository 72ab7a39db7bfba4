"""Ingest of items into a corpus of documents, chunks and entities; deletion that cascades; resources as items."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import document_id
from brindle.operators import documents as X

MAX_BYTES = 1 << 20  # a resource's value beyond it isn't indexed
SECRET = "secret"


@dataclass(frozen=True)
class Corpus:
    """documents(doc_id, source, text), their chunks, and their entities; each is made when it is read."""

    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame

    def chunk_entities(self) -> DataFrame:
        """(chunk_id, type, canonical): the entities of a document with each of its chunks that holds their surface."""
        held = self.chunks.join(self.entities, "doc_id").where(F.contains("chunk", F.col("surface")))
        return held.select("chunk_id", "type", "canonical").distinct()

    def without(self, doc_ids: DataFrame) -> Corpus:
        """The corpus after deletion of documents(doc_id), with all that came from them."""
        gone = doc_ids.select("doc_id").distinct()
        return Corpus(*(t.join(gone, "doc_id", "left_anti") for t in (self.documents, self.chunks, self.entities)))

    def without_sources(self, sources: DataFrame) -> Corpus:
        """The corpus after deletion of the documents of sources(source)."""
        return self.without(self.documents.join(sources.select("source").distinct(), "source", "left_semi"))


def accepted(items: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Items(source, text) that an ingest takes: those with a source and a text whose source isn't known yet.

    Of different texts of one source the one of least digest is taken, once. Digests are compared
    before texts are joined, so a source of very many items isn't one task.
    """
    stamped = items.where((F.col("source") != "") & (F.col("text") != "")).select("source", "text", F.sha2("text", 256).alias("digest"))
    if known is not None:
        stamped = stamped.join(known.select("source").distinct(), "source", "left_anti")
    first = stamped.groupBy("source").agg(F.min("digest").alias("digest"))
    return stamped.dropDuplicates(["source", "digest"]).join(first, ["source", "digest"], "left_semi").select("source", "text")


def ingest(items: DataFrame, known: DataFrame | None = None, threshold: float | None = 0.85) -> Corpus:
    """The corpus of items(source, text): deduplicated by source, cut into chunks, entities found and resolved.

    Entities of a type within a document whose surfaces are alike to the threshold become one, under
    the most frequent surface; with no threshold they stay as found. Items from files come from
    connectors.to_documents(), which extracts their text.
    """
    taken = accepted(items, known)
    docs = taken.select(document_id(F.col("source"), F.col("text")).alias("doc_id"), "source", "text")
    found = X.entities(docs)
    if threshold is not None:
        found = X.resolved(found, threshold)
    return Corpus(docs, X.chunks(docs), found.select("doc_id", "type", "canonical", "surface", "confidence", "mentions"))


def resources(of: Mapping[str, DataFrame], max_bytes: int = MAX_BYTES, secret_values: bool = False) -> DataFrame:
    """(type, source, text, indexed) of resources of each type, from tables(key, value).

    A value that is null, empty or larger than max_bytes isn't indexed. Of a secret only the key is,
    unless its values are asked for.
    """
    every = None
    for kind, rows in of.items():
        text = F.col("key") if kind == SECRET and not secret_values else F.col("value")
        indexed = F.coalesce(F.octet_length(text).between(1, max_bytes), F.lit(False))
        part = rows.select(F.lit(kind).alias("type"), F.concat_ws(":", F.lit(kind), "key").alias("source"), F.when(indexed, text).alias("text"), indexed.alias("indexed"))
        every = part if every is None else every.union(part)
    if every is None:
        raise ValueError("no resources are given")
    return every


def sync_status(synced: DataFrame) -> DataFrame:
    """(type, indexed, skipped) of resources()."""
    n = F.sum(F.col("indexed").cast("long"))
    return synced.groupBy("type").agg(n.alias("indexed"), (F.count("*") - n).alias("skipped"))
