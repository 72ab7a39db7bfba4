"""Sources and sinks: files of several kinds, static rows, web pages, and documents from any of them.

Every connector gives items(id, source, mime, content); to_documents() turns them into text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from brindle.functions.text import document_id, html_to_text
from brindle.sources.extract import extract

# Media types by file name ending.
MIME = {"txt": "text/plain", "md": "text/plain", "html": "text/html", "htm": "text/html", "json": "application/json", "csv": "text/csv", "tsv": "text/tab-separated-values", "eml": "message/rfc822", "pdf": "application/pdf", "docx": "application/docx", "xlsx": "application/xlsx", "pptx": "application/pptx", "odt": "application/odf"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder, with size, time and media type; those named with a leading _ or . are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    none = empty_files(spark, path)
    if none:
        found = found.union(spark.createDataFrame(none, "path string, millis long").selectExpr("path", "timestamp_millis(millis) AS modificationTime", "0L AS length", "CAST('' AS BINARY) AS content"))
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return found.select(F.col("path").alias("id"), F.col("path").alias("source"), F.coalesce(known[ending], F.lit("application/octet-stream")).alias("mime"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def empty_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times of empty files below a folder, which Spark's readers skip; a listing, as Spark makes one itself."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    out = []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0 and status.getPath().getName()[:1] not in ("_", "."):
            out.append((status.getPath().toString(), status.getModificationTime()))
    return sorted(out)


def rows_as_items(df: DataFrame, source: str) -> DataFrame:
    """One JSON item for each row of a table."""
    place = F.monotonically_increasing_id()
    return df.select(F.concat_ws("#", F.lit(source), place.cast("string")).alias("id"), F.lit(source).alias("source"), F.lit("application/json").alias("mime"), F.to_json(F.struct("*")).cast("binary").alias("content"))


def csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Records of CSV or TSV files with a header, all as text."""
    return spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"')


def json(spark: SparkSession, path: str) -> DataFrame:
    """Objects of JSON files, each an array or a single object."""
    return spark.read.json(path, multiLine=True)


class UrlReader(DataSourceReader):
    def __init__(self, urls: list[str], fetch: Callable[[str], bytes]) -> None:
        self.urls, self.fetch = urls, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.value, partition.value, "text/html", self.fetch(partition.value)


def get(url: str) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as answer:
        return answer.read()


class UrlSource(DataSource):
    """spark.read.format("web").option("urls", "https://a https://b"): one request and row an address."""

    fetch = staticmethod(get)

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return "id string, source string, mime string, content binary"

    def reader(self, schema) -> UrlReader:
        return UrlReader(self.options.get("urls", "").split(), type(self).fetch)


@F.pandas_udf(StringType())
def extracted(mime: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else extract(m, c) for m, c in zip(mime, content)], dtype=object)


def to_documents(items: DataFrame) -> DataFrame:
    """doc_id, source and text of items, in one pass; HTML by DataFrame functions, other kinds in Arrow batches.

    An item without a media type counts as one of unknown bytes, one without content as empty. Items
    of the same source and text are one document.
    """
    mime = F.coalesce("mime", F.lit("application/octet-stream"))
    content = F.coalesce("content", F.lit(b""))
    plain, html = mime == "text/plain", mime == "text/html"
    other = extracted(mime, F.when(~plain & ~html, content))
    text = F.when(plain, content.cast("string")).when(html, html_to_text(content.cast("string"))).otherwise(other)
    every = items.select("source", text.alias("text"))
    return every.select(document_id(F.col("source"), F.col("text")).alias("doc_id"), "source", "text").dropDuplicates(["doc_id"])


def export(df: DataFrame, path: str, kind: str = "json", prefix: str | None = None, key: str = "key") -> None:
    """Write a table, or the rows whose key has a prefix, as JSON lines, CSV or Parquet."""
    rows = df if prefix is None else df.where(F.startswith(F.col(key), F.lit(prefix)))
    {"json": rows.write.json, "csv": lambda p: rows.write.csv(p, header=True), "parquet": rows.write.parquet}[kind](path)


def restore(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """Read an export back."""
    return spark.read.schema(schema).format(kind).option("header", True).load(path)
