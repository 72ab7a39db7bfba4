"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with pieces of its texts. A text is
encoded with every dictionary and the smallest encoding names its language; the margin to the next
one is the score, and narrow margins are marked as rejected. Texts are folded first: lower case,
ASCII other than letters as single blanks. Long texts are encoded whole, in blocks of BLOCK bytes,
so that the dictionary, not the text's own past, decides. Equal sizes are decided by a slower,
finer encoding.

Learning covers rows whose text and language aren't null and whose crc32 of doc_id modulo FOLDS
isn't HELD. The pieces are a uniform sample over all pieces of PIECE bytes of all such texts, by a
hash of their content and place, about DICT bytes a language and TOTAL bytes over all languages. Of
more than TOTAL / 1000 languages those with most text are learned, so that each has 1000 bytes.

Defined cases: a null text, or one without any letter, is `und` with score 0; so is every text if
nothing could be learned. One learned language alone gets score 1. A null doc_id counts as an empty
one in the fold. Repeated rows are treated one by one; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICT = 32_000
TOTAL = 8_000_000
PIECE = 2048
BLOCK = 2048
LEVEL = 5
FINE_LEVEL = 19
FOLDS, HELD = 3, 1
MIN_MARGIN = 0.01  # of the second smallest size; below, a verdict is marked as rejected
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")
PAD = b" " * 64  # makes short texts compressible, so that matches show


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split())


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def learn(docs: DataFrame, dict_bytes: int = DICT, total: int = TOTAL) -> dict[str, bytes]:
    """Dictionary content of each language; at most total bytes."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"))
    known = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(total // 1000).collect()}
    each = min(dict_bytes, total // max(1, len(known)))
    odds = {lang: min(1.0, 2 * each / n) if n else 1.0 for lang, n in known.items()}

    def pieces(batches):
        for batch in batches:
            langs, ranks, out = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                data = folded(text)
                for k in range(0, len(data), PIECE):
                    piece = data[k : k + PIECE]
                    rank = xxhash.xxh3_64_intdigest(piece, seed=k) / 2.0**64
                    if rank < odds.get(lang, 0):
                        langs.append(lang)
                        ranks.append(rank)
                        out.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ranks, pa.float64()), pa.array(out, pa.binary())], ["lang", "rank", "piece"])

    found = rows.select("lang", "text").mapInArrow(pieces, "lang string, rank double, piece binary").dropDuplicates().collect()
    content: dict[str, bytearray] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["rank"], bytes(r["piece"]))):
        at = content.setdefault(r["lang"], bytearray())
        if len(at) < each:
            at += bytes(r["piece"]) + b" "
    return {lang: bytes(x) for lang, x in content.items() if x.strip()}


class Encoders:
    def __init__(self, content: dict[str, bytes]) -> None:
        self.langs = sorted(content)
        self.quick = [self.encoder(content[x], LEVEL) for x in self.langs]
        self.fine = [self.encoder(content[x], FINE_LEVEL) for x in self.langs]

    @staticmethod
    def encoder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0
        data = folded(text)
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.quick]
        least = min(sizes)
        if sizes.count(least) > 1:
            sizes = [sum(len(c.compress(b + PAD)) for b in blocks) if n == least else 1 << 62 for c, n in zip(self.fine, sizes)]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.langs[0], 1.0
        first, second = sizes[order[0]], sizes[order[1]]
        return self.langs[order[0]], (second - first) / second


def identify(docs: DataFrame, content: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row for each row of docs."""

    def run(batches):
        encoders = Encoders(content)
        for batch in batches:
            found = [encoders.predict(x.as_py()) for x in batch.column("text")]
            score = np.array([s for _, s in found], dtype=np.float64)
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array(score), pa.array(score < min_margin)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return picked.mapInArrow(run, SCHEMA)
