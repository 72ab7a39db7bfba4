"""Text pipeline: chunks, rule-based entities, resolution, classification and masking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import chunk_id, mask_last_four

WINDOW, OVERLAP = 256, 64


def chunks(docs: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, index, chunk_id and text of overlapping windows of words; the last one reaches the end.

    A text of one window keeps its original spacing. A text without words has no chunk.
    """
    step = max(1, window - overlap)
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n = F.size("words")
    last = F.when(n <= window, 0).otherwise(F.ceil((n - window) / step)).cast("int")
    windows = docs.select("doc_id", "text", words.alias("words")).where(n > 0)
    cut = windows.select("doc_id", "text", "words", F.explode(F.sequence(F.lit(0), last)).alias("index"))
    body = F.when(n <= window, F.col("text")).otherwise(F.array_join(F.slice("words", F.col("index") * step + 1, F.lit(window)), " "))
    return cut.select("doc_id", "index", chunk_id(F.col("doc_id"), F.col("index")).alias("chunk_id"), body.alias("chunk"), F.least(n - F.col("index") * step, F.lit(window)).alias("n_words"))


@dataclass(frozen=True)
class Rule:
    """An entity type's pattern; case says how the canonical form is made: lower, upper or as it is.

    Texts without any of the hints have no match. Where Java's engine would take a stack frame for
    each repetition, or quadratic time, linear has the same matches as its first group; what else it
    matches is a run of characters in which no match starts, and is dropped.
    """

    type: str
    pattern: str
    confidence: float
    case: str = ""

    @property
    def hints(self) -> tuple[str, ...]:
        return HINTS.get(self.pattern, ())

    @property
    def linear(self) -> str | None:
        return LINEAR.get((self.type, self.pattern))


# Entity rules in order; the patterns mean the same in Java's and RE2's syntax.
RULES = [
    Rule("EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 0.95, "lower"),
    Rule("URL", r"https?://[^\s<>\"'`\)]+", 0.95, "lower"),
    Rule("DOMAIN", r"\b(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b", 0.85, "lower"),
    Rule("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.85),
    Rule("DATE", r"\b\d{4}-\d{2}-\d{2}\b", 0.95),
    Rule("DATE", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", 0.80),
    Rule("DATE", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b", 0.90),
    Rule("MONEY", r"\$[\d,]+(?:\.\d{2})?", 0.90),
    Rule("MONEY", r"\b\d[\d,]*(?:\.\d{2})?\s*(?:USD|EUR|GBP|JPY|CAD|AUD)\b", 0.90),
    Rule("PERCENTAGE", r"\b\d+(?:\.\d+)?%", 0.90),
    Rule("PHONE", r"(?:\+1[\s-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", 0.80),
    Rule("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.80),
    Rule("CREDIT_CARD", r"\b\d{4}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}\b", 0.70),
    Rule("FILE_PATH", r"(?:/[\w.\-]+)+|(?:[A-Za-z]:\\(?:[\w.\- ]+\\?)+)|(?:[\w.\-]+/)+[\w.\-]+", 0.75),
    Rule("HASH", r"\b(?:sha256:)?[a-fA-F0-9]{32,64}\b", 0.85, "lower"),
    Rule("TICKET_ID", r"\b[A-Z][A-Z0-9]{1,9}-\d{1,8}\b", 0.90),
    Rule("CASE_ID", r"\b(?:CASE|Case|case)[-_ ]?\d{3,12}\b", 0.85, "upper"),
    Rule("INVOICE_ID", r"\b(?:INV|Invoice|invoice)[-_ ]?[A-Z0-9]{3,16}\b", 0.85, "upper"),
    Rule("CONTRACT_ID", r"\b(?:CONTRACT|Contract|contract|CTR)[-_ ]?[A-Z0-9]{3,20}\b", 0.85, "upper"),
    Rule("POLICY_ID", r"\b(?:POLICY|Policy|policy|POL)[-_ ]?[A-Z0-9]{3,20}\b", 0.85, "upper"),
    Rule("ACCOUNT_ID", r"\b(?:acct|account|ACC)[-_ ]?[A-Z0-9]{4,20}\b", 0.80, "upper"),
    Rule("API_KEY_PATTERN", r"\b(?:sk|pk|api|key|token)[-_][A-Za-z0-9_\-]{12,}\b", 0.70),
    Rule("TAX_ID", r"\b(?:VAT|PAN|TIN|TAX)[-_ ]?[A-Z0-9]{5,20}\b", 0.80, "upper"),
    Rule("ORG", r"\b(?:[A-Z][a-zA-Z&]+(?:\s+[A-Z][a-zA-Z&]+)*)\s+(?:Inc\.?|Corp\.?|LLC|Ltd\.?|Co\.?|Group|Holdings|Partners|Associates|Foundation|Institute|University|Technologies|Solutions|Systems|Services|International|Consulting|Enterprises)\b", 0.65),
    Rule("PERSON", r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b", 0.60),
]


# What a match of a pattern always holds, one of these.
HINTS = {
    rule.pattern: hints
    for rule, hints in zip(
        RULES,
        [("@",), ("://",), (".",), (".",), ("-",), ("/",), tuple(RULES[6].pattern[5:].split(")")[0].split("|")), ("$",), ("USD", "EUR", "GBP", "JPY", "CAD", "AUD"), ("%",)]
        + [(), ("-",), (), ("/", "\\"), (), ("-",), ("CASE", "Case", "case"), ("INV", "nvoice"), ("CONTRACT", "ontract", "CTR"), ("POLICY", "olicy", "POL"), ("acct", "account", "ACC")]
        + [("-", "_"), ("VAT", "PAN", "TIN", "TAX"), (), ("Mr", "Ms", "Dr", "Prof")],
    )
}


def chain(start: str, piece: str, between: str, end: str) -> str:
    """Matches of start(piece between)*piece end with the most pieces, else the whole chain unmatched.

    The pieces up to the last that end can follow are found by going from one such place to the next,
    with possessive loops only, so each piece is looked at a constant number of times.
    """
    onwards = f"(?:(?!{end}){between}{piece})*+(?={end})"
    return f"{start}(?:({piece}{onwards}(?:{between}{piece}{onwards})*+{end})|{piece}(?:{between}{piece})*+)"


def linear_forms() -> dict[tuple[str, str], str]:
    by_type = {r.type: r.pattern for r in RULES}
    run, label, name = r"[\w.\-]", r"[a-zA-Z0-9-]++", r"[A-Z][a-zA-Z&]++"
    suffix = by_type["ORG"].rsplit(r"\s+", 1)[1]
    local, domain = by_type["EMAIL"].split("+@")
    amount, currency = RULES[8].pattern.removeprefix(r"\b").split(r"\s*")
    return {
        ("EMAIL", by_type["EMAIL"]): f"({local}++@{domain})|{local}++",
        ("DOMAIN", by_type["DOMAIN"]): chain(r"\b", label, r"\.", r"\.[a-zA-Z]{2,}+\b"),
        ("ORG", by_type["ORG"]): chain(r"\b", name, r"\s++", rf"\s++{suffix}"),
        ("MONEY", RULES[8].pattern): rf"\b(?:({amount}\s*{currency})|\d[\d,]*+)",
        ("FILE_PATH", by_type["FILE_PATH"]): rf"((?:/{run}++)++|[A-Za-z]:\\(?:[\w.\- ]++\\?+)++|{run}++(?:/{run}++)++)|{run}++(?!:\\)|{run}+(?=[A-Za-z]:\\)|{run}++",
    }


LINEAR = linear_forms()


def surfaces(rule: Rule, text: str = "text") -> Column:
    """All matches of a rule, in order."""
    if rule.linear:
        each = F.filter(F.regexp_extract_all(text, F.lit(rule.linear), F.lit(1)), lambda x: x != "")
    else:
        each = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    if not rule.hints:
        return each
    may = reduce(lambda a, b: a | b, (F.contains(F.col(text), F.lit(h)) for h in rule.hints))
    return F.when(may, each).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, type, canonical, surface, confidence and mentions: the first rule and surface of each canonical form win."""

    def found(i: int, rule: Rule) -> Column:
        def entity(surface: Column, place: Column) -> Column:
            canonical = F.lower(surface) if rule.case == "lower" else F.upper(surface) if rule.case == "upper" else surface
            return F.struct(F.lit(i).alias("rule"), place.alias("place"), F.lit(rule.type).alias("type"), F.lit(rule.confidence).alias("confidence"), canonical.alias("canonical"), surface.alias("surface"))

        return F.transform(surfaces(rule), entity)

    every = F.concat(*(found(i, rule) for i, rule in enumerate(rules)))
    rows = docs.select("doc_id", F.explode(every).alias("e")).select("doc_id", "e.*")
    first = F.min(F.struct("rule", "place", "surface", "confidence")).alias("first")
    return rows.groupBy("doc_id", "type", "canonical").agg(first, F.count("*").alias("mentions")).select("doc_id", "type", "canonical", F.col("first.surface").alias("surface"), F.col("first.confidence").alias("confidence"), "mentions")


def entity_key(kind: Column, canonical: Column) -> Column:
    return F.concat_ws(":", F.lower(F.trim(kind)), F.lower(F.trim(canonical)))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    m, moved = len(mine), sum(x != y for x, y in zip(mine, theirs)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each of up to four common first letters."""
    base = jaro(a, b)
    common = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        common += 1
    return base + common * 0.1 * (1 - base)


def leaders(surfaces: list[str], counts: list[int], threshold: float) -> list[str]:
    """The canonical form of each of the distinct surfaces of one scope and type, in order."""
    if len(surfaces) == 1:
        return surfaces
    heads: list[str] = []
    of = []
    for surface in surfaces:
        low = surface.lower()
        at = next((i for i, x in enumerate(heads) if jaro_winkler(low, x) >= threshold), len(heads))
        if at == len(heads):
            heads.append(low)
        of.append(at)
    best: dict[int, tuple[int, str]] = {}
    for i, surface, n in zip(of, surfaces, counts):
        best[i] = min(best.get(i, (-n, surface)), (-n, surface))
    return [best[i][1] for i in of]


def by_group(rows: DataFrame, keys: list[str], each: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """What a function makes of the rows of each group, with the keys; a task takes its groups in turn.

    A group is a row with an array, not a pandas frame of its own, as most have a row or two. The
    number of tasks is given, as small rows would else be merged into one task, however long it takes.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.repartition(tasks, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in keys))).alias("rows"))
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in columns}
            for *key, members in zip(*(batch.column(c).to_pylist() for c in (*keys, "rows"))):
                for row in each(members):
                    for c in columns:
                        out[c].append(row[c] if c in row else key[keys.index(c)])
            types = [pa.float64() if x.split()[1] == "double" else pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(columns, types)], columns)

    return packed.mapInArrow(run, schema)


def resolve(mentions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """mentions(scope, type, surface) to (scope, type, surface, canonical).

    Within a scope and type, distinct surfaces in order join the first cluster whose leader is alike
    enough; a cluster's canonical form is its most frequent surface, the least of those. Surfaces are
    counted before the shuffle, so a group holds distinct surfaces only.
    """
    counted = mentions.select(F.col("scope").cast("string").alias("scope"), "type", "surface").groupBy("scope", "type", "surface").agg(F.count("*").alias("n"))

    def each(rows: list[dict]) -> list[dict]:
        rows.sort(key=lambda r: r["surface"])
        found = leaders([r["surface"] for r in rows], [r["n"] for r in rows], threshold)
        return [{"surface": r["surface"], "canonical": c} for r, c in zip(rows, found)]

    return by_group(counted, ["scope", "type"], each, "scope string, type string, surface string, canonical string")


def resolved(found: DataFrame, threshold: float = 0.85) -> DataFrame:
    """entities() with those of a document and type that resolve() finds alike as one, in one pass: under the most frequent surface."""

    def each(rows: list[dict]) -> list[dict]:
        counts = Counter(r["surface"] for r in rows)
        surfaces = sorted(counts)
        of = dict(zip(surfaces, leaders(surfaces, [counts[s] for s in surfaces], threshold)))
        out: dict[str, dict] = {}
        for r in rows:
            one = out.setdefault(of[r["surface"]], {"canonical": of[r["surface"]], "surface": of[r["surface"]], "confidence": r["confidence"], "mentions": 0})
            one["confidence"] = max(one["confidence"], r["confidence"])
            one["mentions"] += r["mentions"]
        return list(out.values())

    rows = found.select(F.col("doc_id").cast("string").alias("doc_id"), "type", "surface", F.col("confidence").cast("double").alias("confidence"), "mentions")
    return by_group(rows, ["doc_id", "type"], each, "doc_id string, type string, canonical string, surface string, confidence double, mentions long")


@dataclass(frozen=True)
class Detector:
    """A pattern of sensitive data: its family, subtype, confidence and the action it asks for."""

    family: str
    subtype: str
    pattern: str
    confidence: float
    action: str
    luhn: bool = False


# Patterns of personal, health and payment data.
DETECTORS = [
    Detector("pii", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0.95, "encrypt"),
    Detector("pii", "ssn", r"\b\d{9}\b", 0.80, "encrypt"),
    Detector("pii", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.90, "mask"),
    Detector("pii", "phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", 0.85, "mask"),
    Detector("pii", "phone", r"\+\d{1,3}[-.]?\d{1,14}", 0.85, "mask"),
    Detector("pii", "passport", r"\b[A-Z]{1,2}\d{6,9}\b", 0.75, "encrypt"),
    Detector("pii", "drivers_license", r"\b[A-Z]{1,2}\d{5,8}\b", 0.70, "encrypt"),
    Detector("pii", "ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.80, "mask"),
    Detector("pii", "dob", r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b", 0.75, "mask"),
    Detector("pii", "nin", r"\b[A-Z]{2}\d{6}[A-Z]\b", 0.90, "encrypt"),
    Detector("pii", "sin", r"\b\d{3}-\d{3}-\d{3}\b", 0.90, "encrypt"),
    Detector("phi", "mrn", r"\bMRN[:\s]?\d{6,10}\b", 0.95, "encrypt"),
    Detector("phi", "npi", r"\bNPI[:\s]?\d{10}\b", 0.95, "encrypt"),
    Detector("phi", "icd10", r"\b[A-Z]\d{2}(?:\.\d{1,4})?\b", 0.70, "encrypt"),
    Detector("phi", "medication", r"\b(?:mg|mcg|mL|tablet|capsule|injection)\b", 0.60, "mask"),
    Detector("phi", "patient_id", r"\b(?:Patient|PT)[:\s]?\d{6,10}\b", 0.85, "encrypt"),
    Detector("phi", "claim_number", r"\b(?:Claim|CLM)[:\s]?\d{8,15}\b", 0.80, "encrypt"),
    Detector("pci", "card_visa", r"\b4\d{12}(?:\d{3})?\b", 0.90, "encrypt", True),
    Detector("pci", "card_mastercard", r"\b5[1-5]\d{14}\b", 0.90, "encrypt", True),
    Detector("pci", "card_amex", r"\b3[47]\d{13}\b", 0.90, "encrypt", True),
    Detector("pci", "card_discover", r"\b6(?:011|5\d{2}|4[4-9]\d|22(?:1(?:2[6-9]|[3-9]\d)|[2-8]\d{2}|9(?:[01]\d|2[0-5])))\d{12}\b", 0.90, "encrypt", True),
    Detector("pci", "cvv", r"\bCVV[:\s]?\d{3,4}\b", 0.70, "block"),
    Detector("pci", "card_expiry", r"\b(?:0[1-9]|1[0-2])[/-](?:\d{2}|\d{4})\b", 0.65, "mask"),
]
THRESHOLD, DEFAULT_CLASS = 0.7, "internal"


def detections(detector: Detector, text: Column) -> Column:
    """All strings that a detector finds in text."""
    if detector.subtype == "email":  # in linear time: a run of local characters without a match is passed over
        local, domain = detector.pattern.removeprefix(r"\b").split("+@")
        every = F.regexp_extract_all(text, F.lit(rf"\b(?:({local}++@{domain})|{local}++)"), F.lit(1))
        return F.when(F.contains(text, F.lit("@")), F.filter(every, lambda s: s != "")).otherwise(F.array().cast("array<string>"))
    found = F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(0))
    return F.filter(found, lambda s: F.call_function("luhn_check", s) & F.length(s).between(13, 19)) if detector.luhn else found


def classify(docs: DataFrame, detectors: list[Detector] = DETECTORS) -> DataFrame:
    """doc_id, n_found, confidence and data_class, in one pass without a shuffle.

    Restricted if the most confident match reaches the threshold; what has no match is internal too,
    as nothing reaches the threshold then.
    """
    found = F.array(*(F.struct(F.lit(d.confidence).alias("confidence"), F.coalesce(F.size(detections(d, F.col("text"))), F.lit(0)).alias("n")) for d in detectors))
    hit = docs.select("doc_id", F.filter(found, lambda x: x["n"] > 0).alias("hit"))
    confidence = F.coalesce(F.array_max(F.transform("hit", lambda x: x["confidence"])), F.lit(0.0))
    n = F.aggregate("hit", F.lit(0), lambda a, x: a + x["n"])
    return hit.select("doc_id", n.alias("n_found"), confidence.alias("confidence"), F.when(confidence >= THRESHOLD, "restricted").otherwise(DEFAULT_CLASS).alias("data_class"))


def masked(docs: DataFrame, detectors: list[Detector] = DETECTORS) -> DataFrame:
    """doc_id and text with each match of a detector that asks for masking replaced, but for its last four characters."""

    def hide(d: Detector, text: Column) -> Column:
        """The text after one detector; a one-element array makes it a value that is computed once."""
        return F.transform(F.array(text), lambda t: F.aggregate(F.array_distinct(detections(d, t)), t, lambda a, m: F.replace(a, m, mask_last_four(m))))[0]

    text = F.col("text")
    for d in detectors:
        if d.action in ("mask", "redact"):
            text = hide(d, text)
    return docs.select("doc_id", text.alias("text"))


def mask_columns(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Columns of class confidential or above show their last four characters only."""
    hidden = [c for c, k in classes.items() if k in ("confidential", "restricted", "top_secret")]
    return df.withColumns({c: mask_last_four(F.col(c).cast("string")) for c in hidden})
