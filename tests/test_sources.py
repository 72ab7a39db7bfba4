"""Connectors and extractors on small files."""

import io
import sys
import zipfile
import zlib

from pyspark import cloudpickle
from pyspark.sql import functions as F

from brindle.sources import connectors as C
from brindle.sources.extract import extract


def test_folder_to_documents(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("plain text")
    (tmp_path / "in" / "deep" / "b.html").write_text("<p>Hi &amp; <b>bye</b></p>")
    (tmp_path / "in" / "c.json").write_text('{"b": "two", "a": ["one", 3, {"z": "deep"}]}')
    (tmp_path / "in" / "d.csv").write_text("id,name\n1,x\n")
    (tmp_path / "in" / "e.eml").write_bytes(b"Subject: Hello\nContent-Type: text/plain\n\nbody text\n")
    (tmp_path / "in" / "f.bin").write_bytes(b"\x00\x01readable part\x02\x00ab")
    (tmp_path / "in" / "empty.pdf").write_bytes(b"")
    items = C.files(spark, str(tmp_path / "in"))
    assert items.count() == 7
    texts = {r["source"].rsplit("/", 1)[-1]: r["text"] for r in C.to_documents(items).collect()}
    assert texts["a.txt"] == "plain text" and texts["b.html"] == "Hi & bye" and texts["c.json"] == "one deep two"
    assert texts["d.csv"] == "id name\n1 x" and texts["e.eml"] == "Hello\nbody text" and texts["f.bin"] == "readable part" and texts["empty.pdf"] == ""


def test_office_and_pdf():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp;</w:t></w:p><w:p><w:t>two</w:t></w:p>")
    assert extract("application/docx", out.getvalue()) == "One &\ntwo"
    page = zlib.compress(rb"BT (Hello \(you\)) Tj (!) Tj ET")
    assert extract("application/pdf", b"%PDF stream\n" + page + b"endstream") == "Hello (you)!"
    assert "not a zip" in extract("application/docx", b"this is not a zip")
    assert extract("application/json", b"{broken json") == "{broken json"


def test_tables_and_export(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('id\tnote\n1\t"a\tb"\n2\tc\n')
    rows = C.csv(spark, str(tmp_path / "t.tsv"), "\t")
    assert sorted(map(tuple, rows.collect())) == [("1", "a\tb"), ("2", "c")]
    (tmp_path / "t.json").write_text('[{"id": 1, "note": "x"}, {"id": 2, "note": "y"}]')
    assert C.json(spark, str(tmp_path / "t.json")).count() == 2
    assert C.rows_as_items(rows, "notes").select(F.col("content").cast("string")).first()[0] == '{"id":"1","note":"a\\tb"}'
    C.export(rows.withColumnRenamed("id", "key"), str(tmp_path / "out"), prefix="2")
    assert [tuple(r) for r in C.restore(spark, str(tmp_path / "out"), "key string, note string").collect()] == [("2", "c")]


class Pages(C.UrlSource):
    fetch = staticmethod(lambda url: f"<p>{url}</p>".encode())


def test_items_without_media_type_or_content(spark):
    rows = [("a", "s1", None, b"some words"), ("b", "s2", "text/plain", b"x"), ("c", "s3", "text/plain", None), ("d", "s4", "application/pdf", None), ("e", "s2", "text/plain", b"x")]
    found = C.to_documents(spark.createDataFrame(rows, "id string, source string, mime string, content binary"))
    assert sorted((r["source"], r["text"]) for r in found.collect()) == [("s1", "some words"), ("s2", "x"), ("s3", ""), ("s4", "")]


def test_web_source(spark):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Pages)
    found = spark.read.format("web").option("urls", "http://a http://b").load()
    assert {r["text"] for r in C.to_documents(found).collect()} == {"http://a", "http://b"}
