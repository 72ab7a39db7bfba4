"""Full-text search and condition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.functions import predicates as P
from brindle.functions import text as T
from brindle.operators import search as S
from brindle.plans.base import registry as r

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
TOKENISED = f"SELECT doc_id, lang, n_chars, text, {TOKENS} AS t, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS joined FROM documents"


def tf(word: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{word}'))"


def full_text(name: str, text: str, mode: str, where: str, points: str) -> None:
    """A search over documents, all hits; the oracle spells match and score out."""

    @r.query(name, f"SELECT doc_id, CAST({points} AS DOUBLE) AS score FROM ({TOKENISED}) WHERE {where}")
    def run(spark, sf_dir):
        return S.search(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), S.parse(text, mode), limit=None)


def has(word: str) -> str:
    return f"list_contains(t, '{word}')"


full_text("fts_all", "nicht eine", "all", f"{has('nicht')} AND {has('eine')}", f"{tf('nicht')} + {tf('eine')}")
full_text("fts_any", "nicht entry token", "any", f"{has('nicht')} OR {has('entry')} OR {has('token')}", f"{tf('nicht')} + {tf('entry')} + {tf('token')}")
full_text("fts_phrase", "apache license version", "phrase", "contains(joined, ' apache license version ')", "4")
full_text("fts_prefix", "licen* the", "", f"len(list_filter(t, lambda x: starts_with(x, 'licen'))) > 0 AND {has('the')}", f"{tf('the')} + 0.75 * len(list_filter(t, lambda x: starts_with(x, 'licen')))")
full_text("fts_negative", "license -apache", "", f"{has('license')} AND NOT {has('apache')}", tf("license"))
full_text("fts_only_negative", "-the NOT de", "", f"NOT {has('the')} AND NOT {has('de')}", "0")
full_text("fts_boolean", '"mit license" OR token -licensed', "boolean", f"(contains(joined, ' mit license ') OR {has('token')}) AND NOT {has('licensed')}", f"CASE WHEN contains(joined, ' mit license ') THEN 4 ELSE 0 END + {tf('token')}")


@r.query("fts_score_topk", f"SELECT doc_id, CAST({tf('the')} + {tf('and')} AS DOUBLE) AS score FROM ({TOKENISED}) WHERE {has('the')} AND {has('and')} ORDER BY score DESC, doc_id LIMIT 50")
def fts_score_topk(spark, sf_dir):
    """The 50 best; only keys and scores go to the final merge."""
    return S.search(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), S.parse("the and"), limit=50)


@r.query(
    "fts_filtered",
    f"SELECT doc_id, CAST({tf('license')} AS DOUBLE) AS score FROM ({TOKENISED}) WHERE {has('license')} AND lang = 'en' AND n_chars > 300",
)
def fts_filtered(spark, sf_dir):
    where = P.all_of([("lang", "=", "en"), ("n_chars", ">", 300)])
    return S.search(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), S.parse("license"), where, None)


@r.query(
    "fts_condition_tree",
    f"""
    SELECT doc_id, lang FROM ({TOKENISED}) d JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
    WHERE (lang IN ('de', 'fr') OR n_chars < 200) AND NOT source = 'src1' AND (({has('die')} AND {has('der')}) OR contains(lower(source), 'src1'))
    """,
)
def fts_condition_tree(spark, sf_dir):
    tree = P.Condition(
        children=[
            P.Condition(op="or", children=[P.Condition(fields=["lang"], values=["de", "fr"]), P.Condition(fields=["n_chars"], comparison="<", values=[200])]),
            P.Condition(fields=["source"], values=["src1"], negate=True),
            P.Condition(op="or", children=[P.Condition(fields=["text"], full_text="die der"), P.Condition(fields=["source"], comparison="contains", values=["src1"])]),
        ]
    )
    return table(spark, sf_dir, "documents").where(tree.column()).select("doc_id", "lang")


@r.query("filter_list_typed", "SELECT c_custkey FROM customer WHERE c_acctbal >= 30 AND c_mktsegment = 'BUILDING' AND c_nationkey <> 3 AND contains(lower(c_name), '1')")
def filter_list_typed(spark, sf_dir):
    wanted = [("c_acctbal", ">=", "30"), ("c_mktsegment", "==", "BUILDING"), ("c_nationkey", "!=", 3), ("c_name", "contains", "1")]
    return table(spark, sf_dir, "customer").where(P.all_of(wanted)).select("c_custkey")


@r.query(
    "fts_snippets",
    r"""
    SELECT doc_id, CASE WHEN a > 1 THEN '...' ELSE '' END || substr(text, a, b - a) || CASE WHEN b <= length(text) THEN '...' ELSE '' END AS snippet
    FROM (SELECT doc_id, text, greatest(p - 48, 1) AS a, least(p + 7 + 48, length(text) + 1) AS b FROM (SELECT *, instr(lower(text), 'license') AS p FROM documents) WHERE p > 0)
    """,
)
def fts_snippets(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), "license").alias("snippet"))
    return found.where("snippet IS NOT NULL")


@r.query("token_postings", f"SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM ({TOKENISED})) GROUP BY term")
def token_postings(spark, sf_dir):
    """Inverted index statistics: one shuffle of (term, document) counts, one of terms."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return words.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@r.query("json_field_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90")
def json_field_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 90")


@r.query("value_hash", "SELECT c_custkey, sha256(lower(trim(c_name))) AS h FROM customer")
def value_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.hash_value(F.col("c_name")).alias("h"))


@r.query(
    "levenshtein_match",
    """
    SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 6) AS similarity
    FROM (SELECT DISTINCT lower(p_name) AS a FROM part) x JOIN (SELECT DISTINCT lower(p_brand) AS b FROM part) y ON levenshtein(a, b) <= 8
    """,
)
def levenshtein_match(spark, sf_dir):
    """Names against the brands, a small list of checked size; the distance is cut off at 8."""
    part = table(spark, sf_dir, "part")
    brands = part.select(F.lower("p_brand").alias("b")).distinct()
    names = part.select(F.lower("p_name").alias("a")).distinct()
    small = brands.limit(10_001).count() <= 10_000
    pairs = names.join(F.broadcast(brands) if small else brands, (F.levenshtein("a", "b", 8) >= 0))
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance"), F.round(T.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@r.query("grams_of_names", "SELECT DISTINCT n_name, CASE WHEN length(n_name) <= 5 THEN substr(n_name, i, 2) ELSE substr(n_name, i, 3) END AS gram FROM (SELECT n_name, unnest(range(1, length(n_name) - CASE WHEN length(n_name) <= 5 THEN 2 ELSE 3 END + 2)) AS i FROM nation)")
def grams_of_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", F.explode(T.grams(F.col("n_name"))).alias("gram")).distinct()


@r.query(
    "html_text",
    r"""
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s{2,}', ' ', 'g')) AS text
    FROM pages
    """,
)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))
