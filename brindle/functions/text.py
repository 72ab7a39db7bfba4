"""Text functions as Columns: tokens, hashes, distances, grams, snippets, HTML, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"

# English function words that search ignores.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by can cannot
could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i
if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over
own same she should so some such than that the their theirs them themselves then there these they this those through to too under
until up very was we were what when where which while who whom why will with within without would you your yours yourself yourselves
""".split()

# HTML entities and what they stand for, in the order of replacement.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

# Data classes from least to most restricted.
DATA_CLASSES = ["public", "internal", "confidential", "restricted", "top_secret"]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; no stemming. NULL for NULL."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def search_tokens(text: Column) -> Column:
    """Identifier tokens first, then tokens without stop words; all tokens if nothing is left."""
    found = F.concat(identifier_tokens(text), F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS)))
    return F.when(F.size(found) > 0, found).otherwise(tokens(text))


def identifier_tokens(text: Column) -> Column:
    """Distinct strings with letters, digits and one of - _ : . in them, and what follows their last : or /."""
    parts = F.transform(F.split(F.lower(text), r"[^\p{L}\p{Nd}\-_:/.]+"), lambda t: F.btrim(t, F.lit(".:")))
    both = F.flatten(F.transform(parts, lambda t: F.array(t, F.when(looks_like_identifier(t) & t.rlike("[:/]"), F.regexp_extract(t, r"[:/]([^:/]*)$", 1)).otherwise(""))))
    return F.array_distinct(F.filter(both, looks_like_identifier))


def looks_like_identifier(token: Column) -> Column:
    return token.rlike(r"[-_:.]") & token.rlike(r"\p{L}") & token.rlike(r"\p{Nd}")


def normalize_value(value: Column) -> Column:
    """Trimmed text of a scalar."""
    return F.trim(value.cast("string"))


def hash_value(value: Column) -> Column:
    """SHA-256 in hex of the lower-case trimmed text."""
    return F.sha2(F.lower(F.trim(value.cast("string"))), 256)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def grams(token: Column) -> Column:
    """Bigrams of tokens up to five characters, else trigrams; a shorter token is its own gram."""
    width = F.when(F.length(token) <= 5, 2).otherwise(3)
    places = F.sequence(F.lit(1), F.length(token) - width + 1)
    return F.when(F.length(token) < width, F.array(token)).otherwise(F.transform(places, lambda i: F.substring(token, i, width)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; 0 if their lengths differ or one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def html_to_text(html: Column) -> Column:
    """Text of HTML: no scripts, styles and tags, common entities decoded, runs of white space as one blank."""
    out = html
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>"):
        out = F.regexp_replace(out, pattern, " ")
    for entity, shown in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(shown))
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def snippet(text: Column, term: Column | str, around: int = 48) -> Column:
    """The first place of a term with its surroundings; ellipses where text is cut; NULL if it isn't there."""
    term = F.lit(term) if isinstance(term, str) else term
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(at - around, F.lit(1))
    stop = F.least(at + F.length(term) + around, F.length(text) + 1)
    cut = F.substring(text, start, stop - start)
    before = F.when(start > 1, "...").otherwise("")
    after = F.when(stop <= F.length(text), "...").otherwise("")
    return F.when(at > 0, F.concat(before, cut, after))


def mask_last_four(value: Column) -> Column:
    """Stars but for the last four characters; all stars up to four."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.substring(value, -4, 4)))


def mask(value: Column, strategy: str) -> Column:
    """full, partial (last four stay) or anything else: redacted."""
    if strategy == "full":
        return F.repeat(F.lit("*"), F.length(value))
    return mask_last_four(value) if strategy == "partial" else F.when(value.isNotNull(), "[REDACTED]")


def class_rank(data_class: Column) -> Column:
    """1 for public to 5 for top_secret; 0 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, DATA_CLASSES)), data_class), F.lit(0))


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(F.lit("chk-"), F.substring(F.sha2(F.concat_ws(":", doc_id.cast("string"), index.cast("string")), 256), 1, 16))


def document_id(source: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, content), 256), 1, 32)


def relation_id(source: Column, kind: Column, target: Column, origin: Column) -> Column:
    joined = F.concat_ws("\0", source, kind, target, origin)
    return F.concat(F.lit("rel-"), F.substring(F.sha2(joined, 256), 1, 24))
