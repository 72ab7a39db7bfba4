"""Text of single files, by media type; small helpers that run inside tasks."""

from __future__ import annotations

import email
import email.policy
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from html import unescape

TAG = re.compile(r"<[^>]+>")
PRINTABLE = re.compile(r"[\x20-\x7e\t\n]{4,}")


def leaves(value) -> Iterator[str]:
    """String leaves of JSON; keys in order, so that the text is always the same."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from leaves(value[k])
    elif isinstance(value, list):
        for x in value:
            yield from leaves(x)


def from_json(content: bytes) -> str:
    try:
        return " ".join(leaves(json.loads(content)))
    except ValueError:
        return printable(content)


def from_table(content: bytes, separator: str) -> str:
    import csv

    rows = csv.reader(io.StringIO(content.decode("utf-8", "replace")), delimiter=separator)
    return "\n".join(" ".join(r) for r in rows)


def from_email(content: bytes) -> str:
    message = email.message_from_bytes(content, policy=email.policy.default)
    body = message.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = unescape(TAG.sub(" ", text))
    return f"{message.get('subject', '')}\n{text}".strip()


def from_office(content: bytes) -> str:
    """Text of the XML parts of a zipped office file; parts in order, paragraphs on lines of their own."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in sorted(z.namelist()) if re.search(r"(word/document|ppt/slides/slide\d+|xl/sharedStrings|^content)\.xml$", n)]
        parts = [z.read(n).decode("utf-8", "replace") for n in names]
    spaced = (re.sub(r"</(?:w:p|a:p|text:p|text:h|si)>", "\n", p) for p in parts)
    return "\n".join(unescape(TAG.sub("", p)).strip() for p in spaced)


def from_pdf(content: bytes) -> str:
    """Strings shown by a PDF's content streams, plain or deflated; encrypted and CID-coded text is left out."""
    out = []
    for raw in re.findall(rb"stream\r?\n(.*?)endstream", content, re.S):
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        for block in re.findall(rb"BT(.*?)ET", raw, re.S):
            shown = re.findall(rb"\(((?:\\.|[^\\()])*)\)", block)
            out.append("".join(re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1") for s in shown))
    return "\n".join(out) or printable(content)


def printable(content: bytes) -> str:
    return " ".join(PRINTABLE.findall(content.decode("latin-1"))).strip()


def extract(mime: str, content: bytes | None) -> str:
    """Text of a file; what can't be read as its kind gives its printable runs."""
    if not content:
        return ""
    try:
        if mime == "application/json":
            return from_json(content)
        if mime in ("text/csv", "text/tab-separated-values"):
            return from_table(content, "," if mime == "text/csv" else "\t")
        if mime == "message/rfc822":
            return from_email(content)
        if mime == "application/pdf":
            return from_pdf(content)
        if mime in ("application/docx", "application/xlsx", "application/pptx", "application/odf"):
            return from_office(content)
    except (zipfile.BadZipFile, UnicodeError, KeyError):
        return printable(content)
    return printable(content)
