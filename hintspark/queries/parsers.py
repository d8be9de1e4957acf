"""Queries of the strict parsers over bodies and patches made from documents and page paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hintspark.functions import intervals as I, parsers as P, text as X
from hintspark.queries import table
from hintspark.queries.retrieval import _URL_PATH, _URL_PATH_SQL
from hintspark.queries.text import words_sql

QUERIES: dict = {}


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a document as a paragraph, with a tag that isn't allowed in every third."""
    words = F.array_join(X.words(F.col("text")), " ")
    raw = F.concat(F.lit("<p>"), words, F.lit(" &amp; <b>"), "lang", F.when(F.col("doc_id") % 3 == 0, "</i></p>").otherwise("</b></p>"))
    rows = P.with_body_text(table(spark, sf_dir, "documents"), ["doc_id"], F.when(F.octet_length("text") < 40_000, raw), F.lit("html"))
    return rows.select("doc_id", F.sha2("body", 256).alias("body"), "status")


QUERIES["t14_body_to_text"] = (
    _bodies,
    f"""SELECT doc_id, CASE WHEN strlen(text) < 40000 AND doc_id % 3 <> 0 THEN sha256(trim(array_to_string({words_sql("text")}, ' ') || ' & ' || lang)) END AS body, CASE WHEN strlen(text) >= 40000 THEN 'null' WHEN doc_id % 3 = 0 THEN 'markup' ELSE 'ok' END AS status FROM documents""",
)


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of a page's path, and a new file in every fifth."""
    p = _URL_PATH()
    patch = F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n@@ -1 +1 @@\n-diff --git a/x b/x\n+y\n"), F.when(F.col("page_id") % 5 == 0, "diff --git a/n b/n\nnew file mode 100644\n").otherwise(""))
    rows = P.with_patch_paths(table(spark, sf_dir, "pages"), ["page_id"], patch)
    return rows.select("page_id", F.concat_ws(",", "paths").alias("paths"), "blocks", "new_files", "unsupported", "failure")


QUERIES["t24_patch_paths"] = (
    _patches,
    f"""SELECT page_id, CASE WHEN ends_with({_URL_PATH_SQL}, '/') THEN '' ELSE {_URL_PATH_SQL} END AS paths, 1 + (page_id % 5 = 0)::INT AS blocks, (page_id % 5 = 0)::INT AS new_files, ends_with({_URL_PATH_SQL}, '/')::INT AS unsupported, '' AS failure FROM pages""",
)


# ---- interval templates, made from a document's number; every seventh candidate is the document's own text

_HEADS = ("Return all keys", "Return keys", "Return the first two qualifying keys")
_FILTERS = ("x >= lower and x < upper", "lower < x", "upper >= x and lower <= x", "x < upper AND x > lower", "x = lower", "lower <= x and x > lower")
_METHODS = ("AscendRange", "DescendRange", "AscendGreaterThan", "DescendLessOrEqual", "Ascend", "Walk")
_RANGES = ("[pivot, pivot)", "(pivot, last]", "[first, last]", "[last, first)", "[greaterOrEqual, lessThan)", "(lessThan, somewhere]", "[a b c d, pivot)")


def _pick(options: tuple[str, ...], number) -> object:
    return F.element_at(F.array(*map(F.lit, options)), (number % len(options) + 1).cast("int"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's request meets four candidates."""
    d, k = F.col("doc_id"), F.col("k")
    order = F.when(d % 2 == 0, " in increasing order").otherwise(" in DECREASING order")
    tail = F.when(d % 3 == 0, ".").otherwise(F.concat(F.when(d % 5 == 0, ", ").otherwise(" "), F.lit("keeping "), _pick(_FILTERS, d), F.when(d % 3 == 2, "; stop the callback after two.").otherwise("")))
    made = F.concat(_pick(_METHODS, d + k), F.lit(" calls the iterator for every value in the tree\nwithin the range "), _pick(_RANGES, F.floor(d / 4) + 3 * k), F.lit(", until iterator returns false"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(4)))).alias("k"), "text")
    rows = rows.select("doc_id", "k", I.request_attributes(F.concat(_pick(_HEADS, d), order, tail)).alias("q"), I.candidate_attributes(F.when((d + k) % 7 == 0, F.col("text")).otherwise(made)).alias("c"))
    scored = rows.withColumn("vector", I.agreement(F.col("q"), F.col("c"))).withColumn("score", I.agreement_score(F.col("vector")))
    placed = I.agreement_order(scored, "doc_id", "k", "score")
    sides = [F.col(f"{s}.{n}").alias(f"{a}_{n}") for s, a in (("q", "request"), ("c", "candidate")) for n in ("direction", "lower", "upper", "can_stop")]
    return placed.select("doc_id", "k", *sides, F.array_join(F.col("vector").cast("array<string>"), "").alias("vector"), "score", "rank")


def _tokens_sql(text: str) -> str:
    cut = f"regexp_replace(regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    plain = f"lower(trim(regexp_replace(regexp_replace({cut}, '(<=|>=|[^A-Za-z0-9 \\t\\r\\n])', ' \\1 ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')))"
    return f"CASE WHEN NOT regexp_matches({text}, '[^\\x00-\\x7F]') AND strlen({text}) <= 512 AND len(regexp_extract_all({text}, '[A-Za-z0-9]+')) <= 32 THEN {plain} END"


def _bound_sql(known: str, every: str, t: str, closed: str, opened: str) -> str:
    return f"CASE WHEN {known} THEN CASE WHEN NOT {every} AND regexp_matches({t}, '{closed}') THEN 'closed' WHEN NOT {every} AND regexp_matches({t}, '{opened}') THEN 'open' ELSE 'unbounded' END END"


def _end_sql(end: str, closed: str, first: str, than: str) -> str:
    return f"CASE WHEN {closed} AND {end} = '{first}' THEN 'unbounded' WHEN {end} = 'pivot' OR ({closed} AND {end} = '{than} or equal') OR (NOT {closed} AND {end} = '{than} than') THEN CASE WHEN {closed} THEN 'closed' ELSE 'open' END END"


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_MATCH = lambda n, op: f"coalesce(request_{n} {op} candidate_{n}, false)::INT"
_FLAGS = [_MATCH(n, op) for n in ("direction", "lower", "upper", "can_stop") for op in ("=", "<>")]
QUERIES["t19_interval_agreement"] = (
    _intervals,
    f"""WITH r AS (SELECT doc_id, unnest(range(4))::INT AS k, text FROM documents),
    made AS (SELECT doc_id, k, {_LIST(_HEADS)}[doc_id % 3 + 1] || CASE WHEN doc_id % 2 = 0 THEN ' in increasing order' ELSE ' in DECREASING order' END || CASE WHEN doc_id % 3 = 0 THEN '.' ELSE CASE WHEN doc_id % 5 = 0 THEN ', ' ELSE ' ' END || 'keeping ' || {_LIST(_FILTERS)}[doc_id % 6 + 1] || CASE WHEN doc_id % 3 = 2 THEN '; stop the callback after two.' ELSE '' END END AS request,
      CASE WHEN (doc_id + k) % 7 = 0 THEN text ELSE {_LIST(_METHODS)}[(doc_id + k) % 6 + 1] || ' calls the iterator for every value in the tree' || chr(10) || 'within the range ' || {_LIST(_RANGES)}[(doc_id // 4 + 3 * k) % 7 + 1] || ', until iterator returns false' END AS candidate FROM r),
    t AS (SELECT doc_id, k, {_tokens_sql("request")} AS q, {_tokens_sql("candidate")} AS c FROM made),
    f AS (SELECT *, coalesce(regexp_matches(q, '{I.REQUEST_ALL}'), false) AS every, coalesce(regexp_matches(q, '{I.REQUEST_STOP}'), false) AS stops, coalesce(regexp_matches(q, '{I.REQUEST_FILTER}'), false) AS filters, coalesce(regexp_matches(c, '{I.CANDIDATE}'), false) AS known,
      {", ".join(f"regexp_extract(c, '{I.CANDIDATE}', {i}) AS p{i}" for i in range(1, 6))} FROM t),
    s AS (SELECT *, every OR stops OR filters AS asked, p1 = 'descend' AS down, p2 = '[' AS lc, p5 = ']' AS rc FROM f),
    a AS (SELECT doc_id, k, CASE WHEN asked THEN CASE WHEN regexp_matches(q, 'keys in increasing') THEN 'ascending' ELSE 'descending' END END AS request_direction,
      {_bound_sql("asked", "every", "q", "x >= lower|lower <= x", "x > lower|lower < x")} AS request_lower, {_bound_sql("asked", "every", "q", "x <= upper|upper >= x", "x < upper|upper > x")} AS request_upper, CASE WHEN stops THEN true END AS request_can_stop,
      CASE WHEN known THEN CASE WHEN down THEN 'descending' ELSE 'ascending' END END AS candidate_direction,
      CASE WHEN known THEN CASE WHEN down THEN {_end_sql("p4", "rc", "first", "greater")} ELSE {_end_sql("p3", "lc", "first", "greater")} END END AS candidate_lower,
      CASE WHEN known THEN CASE WHEN down THEN {_end_sql("p3", "lc", "last", "less")} ELSE {_end_sql("p4", "rc", "last", "less")} END END AS candidate_upper, CASE WHEN known THEN true END AS candidate_can_stop FROM s),
    v AS (SELECT *, {" || ".join(f"({x})::VARCHAR" for x in _FLAGS)} AS vector, ({" ".join(("+" if i % 2 == 0 else "-") + f" {x}" for i, x in enumerate(_FLAGS))})::INT AS score FROM a)
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS rank FROM v""",
)
