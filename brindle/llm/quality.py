"""Quality rules: text statistics, and a hashed n-gram logistic regression with calibrated output.

The model sees hashed word unigrams and bigrams and character trigrams of whole texts, as
relative frequencies. It is fitted on a bounded sample of labelled rows (SAMPLE rows of each
class, those of the smallest hash of doc_id), calibrated by Platt scaling on a fifth of them that
the fit didn't see, weighted to the classes' true shares, and scored in Arrow batches.

Defined cases: a null or empty text has no words and fails the base rules. Repeated rows are
judged one by one. Labels that disagree on a document count as the lower one; null labels and
labels of unknown documents are ignored; of several labelled texts of one doc_id one is learned from,
always the same. Without labels of both classes the base rules decide alone. Long texts are worked
through in blocks. Columns other than doc_id and text are neither read nor returned by assess().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.words import BLOCK, SPACED, U64, Hasher, buffers, mix, rolling, rows_words

SAMPLE = 2000  # labelled rows of each class at most
DIM = 2048  # hashed features of words, and as many of characters
WINDOW = 8  # words of a repeated window
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_FROM = 0.5  # probability of good quality from which a document stays
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality double"
)


@dataclass(frozen=True)
class Model:
    """Weights of word and character features, and intercept, after calibration."""

    words: np.ndarray
    chars: np.ndarray
    bias: float


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    if len(hashes) <= width:
        return 0
    windows = rolling(hashes, width)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


@dataclass(frozen=True)
class Run:
    """Features of consecutive rows: hashed indexes, and the range of each row in them."""

    words: np.ndarray
    word_at: np.ndarray
    pairs: np.ndarray
    chars: np.ndarray
    char_at: np.ndarray

    def ranges(self, i: int) -> tuple[slice, slice, slice]:
        a, b = self.word_at[i : i + 2]
        c, d = self.char_at[i : i + 2]
        return slice(a, b), slice(a, max(a, b - 1)), slice(c, max(c, d - 2))


def trigrams(points: np.ndarray) -> np.ndarray:
    """Feature of the trigram that starts at each code point; the last two have none."""
    x = points.astype(U64)
    grams = x.copy()
    for k in (1, 2):
        grams[:-k] += x[k:] << U64(21 * k)
    return (mix(grams) & U64(DIM - 1)).astype(np.int32)


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    """Feature of each word and the next; the last has none."""
    pairs = hashes.copy()
    pairs[:-1] = mix(hashes[:-1] * U64(3) + hashes[1:])
    return (pairs & U64(DIM - 1)).astype(np.int32)


def features(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, word_at: np.ndarray) -> Run:
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return Run((hashes & U64(DIM - 1)).astype(np.int32), word_at, pairs_of(hashes), trigrams(code_points(data)), begins[at])


def long_features(data: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Kind (0 words and pairs, 1 characters) and features of a long text, a block at a time."""
    for lo in range(0, len(hashes), BLOCK):
        part = hashes[lo : lo + BLOCK + 1]
        yield 0, (part[:BLOCK] & U64(DIM - 1)).astype(np.int32)
        yield 0, pairs_of(part)[:-1]
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + BLOCK)
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        more, left = hi, 2  # the next two code points
        while more < len(data) and left:
            more += 1
            left -= more == len(data) or data[more] & 0xC0 != 0x80
        yield 1, trigrams(code_points(data[lo:more]))[:-2]
        lo = hi


def runs(column: pa.Array, hasher: Hasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, at = buffers(column)
    for row, end, hashes, word_at in rows_words(column, hasher):
        lo = at[row]
        yield row, end, data[lo : at[end]], at[row : end + 1] - lo, hashes, word_at


def vector(run: Run, i: int) -> np.ndarray:
    w, p, c = run.ranges(i)
    return relative(np.bincount(run.words[w], minlength=DIM) + np.bincount(run.pairs[p], minlength=DIM), np.bincount(run.chars[c], minlength=DIM))


def relative(words: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return np.concatenate([words / max(1, words.sum()), chars / max(1, chars.sum())]).astype(np.float32)


def is_long(row: int, end: int, data: np.ndarray) -> bool:
    return end - row == 1 and len(data) > 2 * BLOCK


def training_rows(batches):
    hasher = Hasher(SPACED)

    def packed(x):
        at = np.flatnonzero(x)
        return at.astype(np.uint16).tobytes() + x[at].tobytes()

    for batch in batches:
        out = []
        for row, end, data, at, hashes, word_at in runs(batch.column("text"), hasher):
            if is_long(row, end, data):
                counts = np.zeros((2, DIM), np.int64)
                for kind, found in long_features(data, hashes):
                    counts[kind] += np.bincount(found, minlength=DIM)
                out.append(packed(relative(*counts)))
                continue
            run = features(data, at, hashes, word_at)
            out += [packed(vector(run, i)) for i in range(end - row)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(out, pa.binary())], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most sample labelled rows of each class."""
    clean = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    share = {r["quality"]: r["n"] for r in clean.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if set(share) != {0, 1}:
        return None
    ids = None
    for q in (0, 1):
        part = clean.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.union(part)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")  # 2 * sample rows at most
        .select("doc_id", "quality", "text")
        .mapInArrow(training_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x binary")
        .groupBy("doc_id", "quality")
        .agg(F.min("x").alias("x"))
        .select("quality", "x")
    )

    def run(batches):
        model = fitted([(q, x) for batch in batches for q, x in zip(batch.column("quality").to_pylist(), batch.column("x").to_pylist())], share)
        if model is not None:
            yield pa.RecordBatch.from_pydict({"words": [model.words.tobytes()], "chars": [model.chars.tobytes()], "bias": [model.bias]})

    # 2 * sample rows of some hundred features, fitted by a task: the driver sees the weights alone
    found = rows.repartition(1).mapInArrow(run, "words binary, chars binary, bias double").collect()
    return Model(*(np.frombuffer(bytes(found[0][k]), np.float32) for k in ("words", "chars")), found[0]["bias"]) if found else None


def fitted(rows: list[tuple[int, bytes]], share: dict[int, int]) -> Model | None:
    """The model of (quality, packed features) of the sample, weighted to the labels' numbers of each class."""
    rows.sort()
    order = np.random.default_rng(7).permutation(len(rows))
    held = max(2, len(rows) // 5)
    rows = [rows[i] for i in np.concatenate([order[held:], order[:held]])]
    fit = len(rows) - held
    y = np.array([q for q, _ in rows], dtype=np.float32)
    if fit < 2 or y[:fit].min() == y[:fit].max():
        return None
    x = np.zeros((len(rows), 2 * DIM), dtype=np.float32)  # the one large array here: 2 * sample rows of 16 KB
    for i, (_, raw) in enumerate(rows):
        n = len(raw) // 6
        x[i, np.frombuffer(raw[: 2 * n], np.uint16)] = np.frombuffer(raw[2 * n :], np.float32)
    del rows
    scale = 1 / (deviation(x[:fit]) + 1e-4)
    x *= scale
    w, b = logistic(x[:fit], y[:fit])
    raw = x[fit:] @ w + b
    part = np.array([(y == q).sum() for q in (0, 1)])
    weight = np.array([share[0] / part[0], share[1] / part[1]])[y[fit:].astype(int)]
    slope, shift = platt(raw, y[fit:], weight)
    w = w * scale * slope
    return Model(w[:DIM].astype(np.float32), w[DIM:].astype(np.float32), float(b * slope + shift))


def deviation(x: np.ndarray) -> np.ndarray:
    """Standard deviation of each column, without a copy of x."""
    mean = x.mean(axis=0, dtype=np.float64)
    total = np.zeros(x.shape[1])
    for lo in range(0, len(x), 256):
        total += ((x[lo : lo + 256] - mean) ** 2).sum(axis=0)
    return np.sqrt(total / len(x)).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.02, l2: float = 1e-3):
    """Full-batch Adam on the regularised logistic loss, classes weighted alike."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    m, v, mb, vb = np.zeros(d, np.float32), np.zeros(d, np.float32), 0.0, 0.0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    for t in range(1, steps + 1):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / n
        gw, gb = g @ x + l2 * w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        k = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = (w - k * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        b -= k * mb / (np.sqrt(vb) + 1e-8)
    return w, b


def platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * raw + shift) a probability; Newton steps, slope kept positive."""
    if y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = (y > 0).sum(), (y == 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([raw, np.ones_like(raw)], axis=1).astype(np.float64)
    a = np.array([1.0, 0.0])
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-3 * (a - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a = a - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.05, float(a[0])), float(a[1])


def judged(column: pa.Array, hasher: Hasher, model: Model | None) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but doc_id, for a column of texts."""
    n = len(column)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    logit = np.full(n, model.bias if model else 30.0)
    symbol = np.isin(np.arange(256), list(SYMBOLS))
    for row, end, data, at, hashes, word_at in runs(column, hasher):
        rows = slice(row, end)
        out["n_words"][rows] = np.diff(word_at)
        long = is_long(row, end, data)
        for name, flags in (("word_chars", hasher.word[data] & ((data & 0xC0) != 0x80)), ("n_symbols", symbol[data])):
            out[name][rows] = np.count_nonzero(flags) if long else np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
        for i in range(end - row):
            out["n_dup_lines"][row + i] = duplicate_lines(data[at[i] : at[i + 1]].tobytes())
            out["n_repeat_words"][row + i] = repeated_words(hashes[word_at[i] : word_at[i + 1]])
        if model is not None and long:
            sums, counts = np.zeros(2), np.zeros(2)
            for kind, found in long_features(data, hashes):
                sums[kind] += (model.words, model.chars)[kind][found].sum(dtype=np.float64)
                counts[kind] += len(found)
            logit[row] += (sums / np.maximum(1, counts)).sum()
        elif model is not None:
            run = features(data, at, hashes, word_at)
            words, pairs, chars = (np.concatenate([[0.0], np.cumsum(w[i], dtype=np.float64)]) for w, i in ((model.words, run.words), (model.words, run.pairs), (model.chars, run.chars)))
            a, b = word_at[:-1], word_at[1:]
            c, d = run.char_at[:-1], run.char_at[1:]
            b1, d2 = np.maximum(a, b - 1), np.maximum(c, d - 2)
            logit[rows] += (words[b] - words[a] + pairs[b1] - pairs[a]) / np.maximum(1, b - a + b1 - a)
            logit[rows] += (chars[d2] - chars[c]) / np.maximum(1, d2 - c)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["quality"] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    out["kept"] = ~out["base_failed"] & (out["quality"] >= KEEP_FROM)
    return out


def assess(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row of statistics and verdicts for each row of docs."""

    def run(batches):
        hasher = Hasher(SPACED)
        for batch in batches:
            found = judged(batch.column("text"), hasher, model)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(found[k]) for k in names[1:]], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that pass, with all their columns."""

    def run(batches):
        hasher = Hasher(SPACED)
        for batch in batches:
            yield batch.filter(pa.array(judged(batch.column("text"), hasher, model)["kept"]))

    return docs.mapInArrow(run, docs.schema)
