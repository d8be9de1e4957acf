"""Queries of the text functions over documents, pages, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hintspark.functions import text as X
from hintspark.queries import table

# ruff: noqa: E731 - columns need a session, so they are made when a query runs
QUERIES: dict = {}
_T = lambda: F.col("text")


def _over(source: str, key: str, sql: str, columns=dict):
    """A query that adds columns to the key of every row of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(*key.split(", "), *(c.alias(n) for n, c in columns().items()))

    return run, f"SELECT {key}, {sql} FROM {source}"


def words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"


def identifiers_sql(text: str) -> str:
    cut = rf"regexp_replace(regexp_replace({text}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return words_sql(cut)


def _list(values: str) -> str:
    return f"sha256(array_to_string({values}, ' '))"


def _joined(values: Column) -> Column:
    return F.sha2(F.array_join(values, " "), 256)


def collapse_sql(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


_W = words_sql("text")
QUERIES["t1_words"] = _over("documents", "doc_id", f"len({_W})::INT AS n, {_list(_W)} AS words", lambda: dict(n=F.size(X.words(_T())), words=_joined(X.words(_T()))))
_I = identifiers_sql("text")
QUERIES["t2_identifier_tokens"] = _over(
    "pages", "page_id", f"len({identifiers_sql('html')})::INT AS n, sha256(array_to_string({identifiers_sql('html')}, ' ')) AS normalized",
    lambda: dict(n=F.size(X.identifier_tokens(F.col("html"))), normalized=F.sha2(X.normalize_text(F.col("html")), 256)),
)
_C = r"regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[\p{L}\p{N}]+')"
QUERIES["t3_code_terms"] = _over("documents", "doc_id", f"len({_C})::INT AS n, {_list(_C)} AS terms", lambda: dict(n=F.size(X.code_terms(_T())), terms=_joined(X.code_terms(_T()))))
QUERIES["t4_normalized"] = _over(
    "documents", "doc_id", f"sha256({collapse_sql('text')}) AS code_form, sha256({collapse_sql('lower(text)')}) AS query_form",
    lambda: dict(code_form=F.sha2(X.collapse(_T()), 256), query_form=F.sha2(X.normalize_query(_T()), 256)),
)
QUERIES["t5_digests"] = _over(
    "documents", "doc_id",
    "sha256(text) AS digest, sha256(array_to_string(list_transform(list_sort([source, lang, text]), lambda v: strlen(v)::VARCHAR || ':' || v || chr(10)), '')) AS framed",
    lambda: dict(digest=X.text_digest(_T()), framed=X.framed_list_digest(F.array("source", "lang", "text"))),
)
_PAIRS = f"list_transform(list_zip({_W}[:-2], {_W}[2:]), lambda p: p[1] || '_' || p[2])"
QUERIES["t6_term_bigrams"] = _over(
    "benchmark", "item_id", f"sha256(array_to_string(list_concat({_W}, {_PAIRS}), ' ')) AS terms", lambda: dict(terms=_joined(X.term_bigrams(X.words(_T()))))
)
_GRAMS = f"list_distinct(flatten(list_transform({_W}, lambda w: list_transform(range(1, length(w) + 1), lambda i: substr('^' || w || '$', i, 3)))))"
QUERIES["t7_char_trigrams"] = _over(
    "benchmark", "item_id", f"sha256(array_to_string(list_sort({_GRAMS}), ' ')) AS grams", lambda: dict(grams=_joined(F.array_sort(X.char_trigrams(X.words(_T())))))
)
_DECLARED = r"regexp_extract(replace(html, '<', ' func '), '(?:^|[^\p{L}\p{Nd}_])(?:def|func|function)[^\p{L}\p{Nd}_]+([\p{L}\p{Nd}_]+)', 1)"
QUERIES["t8_declared_name"] = _over("pages", "page_id", f"{_DECLARED} AS name", lambda: dict(name=X.declared_name(F.replace(F.col("html"), F.lit("<"), F.lit(" func ")))))
_SYMBOLS = r"regexp_extract_all(lower(html), '[\p{L}\p{Nd}]+|<=|>=|[<>\[\]()]')"
QUERIES["t9_symbol_tokens"] = _over("pages", "page_id", f"len({_SYMBOLS})::INT AS n, {_list(_SYMBOLS)} AS tokens", lambda: dict(n=F.size(X.symbol_tokens(F.col("html"))), tokens=_joined(X.symbol_tokens(F.col("html")))))
QUERIES["t10_in_scope"] = _over(
    "documents", "doc_id", f"strlen(text) <= 4096 AND len({_W}) <= 64 AND strlen(source) <= 4096 AS in_scope", lambda: dict(in_scope=X.in_scope(_T(), F.col("source")))
)
_PATH = lambda: F.regexp_extract("url", "^[a-z]+://(.*)$", 1)
_PATH_SQL = "regexp_extract(url, '^[a-z]+://(.*)$', 1)"
QUERIES["t11_paths"] = _over(
    "pages", "page_id",
    f"""{_PATH_SQL} <> '' AND strlen({_PATH_SQL}) <= 4096 AND len(list_filter(string_split({_PATH_SQL}, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS canonical,
    NOT starts_with({_PATH_SQL}, '/') AND NOT contains({_PATH_SQL}, '\\')
      AND len(list_filter(string_split({_PATH_SQL}, '/'), lambda p: starts_with(p, '.') OR p IN ({', '.join(f"'{x}'" for x in X.EXCLUDED_FOLDERS)}))) = 0
      AND NOT regexp_matches(lower(string_split({_PATH_SQL}, '/')[-1]), 'secret|credential|^id_rsa|lock\\.json$')
      AND regexp_extract(lower(string_split({_PATH_SQL}, '/')[-1]), '\\.([^.]*)$', 1) IN ({', '.join(f"'{x}'" for x in X.EXTENSIONS)}) AS safe""",
    lambda: dict(canonical=X.canonical_path(_PATH()), safe=X.safe_path(_PATH())),
)
_LICENSE = lambda: F.concat(F.element_at(F.array(*map(F.lit, ("LICENSE", "license.md", "COPYING.txt", "notice", "Notices", "readme"))), (F.col("doc_id") % 6 + 1).cast("int")), F.lit(""))
QUERIES["t12_license_name"] = _over(
    "documents", "doc_id",
    "regexp_full_match(upper(['LICENSE', 'license.md', 'COPYING.txt', 'notice', 'Notices', 'readme'][doc_id % 6 + 1]), '(LICENSE|LICENSE[.-].*|COPYING|COPYING\\..*|NOTICE|NOTICE\\..*)') AS is_license, contains(lower(text), 'licensed under') AS mentions",
    lambda: dict(is_license=X.is_license_name(_LICENSE()), mentions=F.contains(F.lower("text"), F.lit("licensed under"))),
)
QUERIES["t13_exclusion_reason"] = _over(
    "documents", "doc_id",
    f"""CASE WHEN NOT contains(text, substr(text, 1, 40)) THEN 'code'
      WHEN regexp_matches(string_split(text, 'package ')[1], '(?i)(code generated|generated by|do not edit)') THEN 'generated'
      WHEN source = 'src3' THEN 'notice'
      WHEN NOT contains(string_split(text, 'package ')[1], 'Apache License') AND regexp_matches(string_split(text, 'package ')[1], '(?i)(license|copyright)') THEN 'header'
      WHEN {collapse_sql("lower(substr(text, 101, 20))")} = '' OR contains({collapse_sql("lower(substr(text, 1, 40))")}, {collapse_sql("lower(substr(text, 101, 20))")}) THEN 'query'
      ELSE '' END AS reason""",
    lambda: dict(reason=X.exclusion_reason(F.substring(_T(), 101, 20), F.substring(_T(), 1, 40), _T(), F.col("source") == "src3")),
)
QUERIES["t15_question_cue"] = _over(
    "conversations", "conv_id, turn",
    """CASE WHEN strlen(text) > 4096 THEN 'text_limit' WHEN role <> 'user' THEN 'role_not_prose' WHEN contains(text, '`') THEN 'unbalanced_code' ELSE '' END AS guard,
    CASE WHEN strlen(text) <= 4096 AND role = 'user' AND NOT contains(text, '`') THEN
      contains(regexp_replace(text, '(?i)(?:[a-z][a-z0-9+.-]*://|www\\.|mailto:)\\S*', ' ', 'g'), '?') END AS question""",
)


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "user", "prose").otherwise("code")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.question_cue(_T(), role).alias("c")).select("conv_id", "turn", "c.guard", "c.question")


QUERIES["t15_question_cue"] = (_cues, QUERIES["t15_question_cue"][1])


def _flag(phrases: tuple[str, ...]) -> str:
    return "regexp_matches(l, '" + X.phrase_pattern(phrases).replace("'", "''") + "')"


def _counted(column: str, function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        turns, docs = (table(spark, sf_dir, n) for n in ("conversations", "documents"))
        rows = turns.select(F.concat_ws(":", F.lit("c"), "conv_id", "turn").alias("key"), "text").unionByName(docs.select(F.concat_ws(":", F.lit("d"), "doc_id").alias("key"), "text"))
        return rows.select("key", function(_T()).alias(column))

    return run


_BOTH = "SELECT 'c:' || conv_id || ':' || turn AS key, text FROM conversations UNION ALL SELECT 'd:' || doc_id, text FROM documents"
QUERIES["t16_rule_intent"] = (
    _counted("intent", X.rule_intent),
    f"""WITH lowered AS (SELECT key, lower(text) AS l FROM ({_BOTH})),
    found AS (SELECT key, {_flag(X.NOT_COMPLETED)} AS negated, list_filter([{", ".join(
        f"CASE WHEN {_flag(p)}" + (" OR contains(l, '?')" if i == "question" else "") + f" THEN '{i}' END" for i, p in X.INTENT_PHRASES.items())}], lambda x: x IS NOT NULL) AS f FROM lowered)
    SELECT key, CASE WHEN negated OR len(f) <> 1 THEN 'unclear' ELSE f[1] END AS intent FROM found""",
)
_H = {n: "regexp_matches(l, '" + X.any_term_pattern(t).replace("'", "''") + "')" for n, t in X.ACT_TERMS.items()}
QUERIES["t17_rule_speech_act"] = (
    _counted("act", X.rule_speech_act),
    f"""WITH lowered AS (SELECT key, lower(trim(text)) AS l FROM ({_BOTH})),
    flags AS (SELECT key, l, {", ".join(f"{h} AS {n}" for n, h in _H.items())} FROM lowered),
    found AS (SELECT *, list_filter([CASE WHEN blocked THEN 'blocker' END, CASE WHEN active THEN 'progress' END, CASE WHEN done AND NOT not_done THEN 'completion_report' END,
      CASE WHEN plan THEN 'planned' END, CASE WHEN reference THEN 'reference' END], lambda x: x IS NOT NULL) AS f FROM flags)
    SELECT key, CASE WHEN l = '' OR framed THEN 'unclear' WHEN question THEN 'question' WHEN cancel THEN 'cancel_request'
      WHEN done AND (not_done OR active OR blocked OR plan) THEN CASE WHEN not_done AND active AND NOT blocked AND NOT plan THEN 'progress' ELSE 'unclear' END
      WHEN len(f) = 1 THEN f[1] ELSE 'unclear' END AS act FROM found""",
)
QUERIES["t20_script_guard"] = _over(
    "documents", "doc_id", r"regexp_matches(regexp_replace(text, '[\p{Latin}]', '', 'g'), '\p{L}') AS other_script, regexp_matches(text, '\p{Hangul}') AS hangul",
    lambda: dict(other_script=X.script_guard(_T())["other_script"], hangul=X.script_guard(_T())["hangul"]),
)
QUERIES["t21_length_buckets"] = _over(
    "documents", "doc_id",
    """CASE WHEN strlen(text) <= 64 THEN 64 WHEN strlen(text) <= 128 THEN 128 WHEN strlen(text) <= 256 THEN 256 WHEN strlen(text) <= 4096 THEN 4096 END AS bytes,
    CASE WHEN length(text) <= 16 THEN 16 WHEN length(text) <= 32 THEN 32 WHEN length(text) <= 64 THEN 64 WHEN length(text) <= 4096 THEN 4096 END AS characters""",
    lambda: dict(bytes=X.length_buckets(_T())["bytes"], characters=X.length_buckets(_T())["characters"]),
)
_START = lambda: (F.col("doc_id") % 200).cast("int")
_END = lambda: (F.col("doc_id") % 200 + F.col("doc_id") % 7).cast("int")
QUERIES["t22_span_checks"] = _over(
    "documents", "doc_id",
    """CASE WHEN doc_id % 200 + doc_id % 7 > strlen(text) OR doc_id % 7 = 0 THEN 'outside'
      WHEN substr(hex(encode(text)), (doc_id % 200 * 2 + 1)::BIGINT, 1) IN ('8', '9', 'A', 'B')
        OR (doc_id % 200 + doc_id % 7 < strlen(text) AND substr(hex(encode(text)), ((doc_id % 200 + doc_id % 7) * 2 + 1)::BIGINT, 1) IN ('8', '9', 'A', 'B')) THEN 'split_character'
      WHEN regexp_full_match(substr(hex(encode(text)), (doc_id % 200 * 2 + 1)::BIGINT, (doc_id % 7 * 2)::BIGINT), '(20)+') THEN 'blank' ELSE 'ok' END AS state""",
    lambda: dict(state=X.span_state(_T(), _START(), _END())),
)
_CODE = lambda: F.concat_ws("-", F.lower(F.hex(F.col("doc_id") * 37)), F.lit("fe0f"))
QUERIES["t23_codes"] = _over(
    "documents", "doc_id",
    """regexp_full_match(lower(printf('%X', doc_id * 37)), '[0-9a-f]{4}|[1-9a-f][0-9a-f]{4,5}') AND doc_id * 37 >= 32 AND doc_id * 37 <= 1114111
      AND NOT doc_id * 37 BETWEEN 55296 AND 57343 AS emoji, regexp_full_match(source, '[A-Za-z0-9][A-Za-z0-9._:-]*') AS opaque,
    regexp_full_match('0' || doc_id, '0|[1-9][0-9]*') AS version""",
    lambda: dict(emoji=X.valid_emoji_code(_CODE()), opaque=X.opaque_id(F.col("source")), version=X.canonical_version(F.concat(F.lit("0"), F.col("doc_id").cast("string")))),
)
QUERIES["t25_name_present"] = _over(
    "documents", "doc_id", f"list_contains({_W}, lower(string_split('x.' || lang || '.The', '.')[-1])) AS present",
    lambda: dict(present=X.name_present(_T(), F.concat(F.lit("x."), F.col("lang"), F.lit(".The")))),
)


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a conversation with the next."""
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.select("conv_id", "turn", F.col("text").alias("query")).join(after, ["conv_id", "turn"])


TURN_PAIRS_SQL = "SELECT a.conv_id, a.turn, a.text AS query, b.text AS reply FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _turn_pairs(spark, sf_dir).select("conv_id", "turn", X.token_overlap(X.words(F.col("query")), X.words(F.col("reply"))).alias("o"))
    return pairs.select("conv_id", "turn", "o.hits", *(F.round(f"o.{c}", 6).alias(c) for c in ("recall", "jaccard", "dice", "cosine")))


QUERIES["t26_token_overlap"] = (
    _overlaps,
    f"""WITH sets AS (SELECT conv_id, turn, list_distinct({words_sql("query")}) AS a, list_distinct({words_sql("reply")}) AS b FROM ({TURN_PAIRS_SQL})),
    n AS (SELECT *, len(list_intersect(a, b))::INT AS hits, len(a) AS na, len(b) AS nb FROM sets)
    SELECT conv_id, turn, hits, round(hits / greatest(na, 1), 6) AS recall, round(hits / greatest(na + nb - hits, 1), 6) AS jaccard,
      round(2 * hits / greatest(na + nb, 1), 6) AS dice, round(hits / sqrt(greatest(na, 1)::DOUBLE * greatest(nb, 1)), 6) AS cosine FROM n""",
)


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first two words as a rule."""
    w = X.words(_T())
    rule = F.concat(F.lit("behavior-v1: if "), F.when(F.col("doc_id") % 2 == 0, "not ").otherwise(""), F.coalesce(F.get(w, 0), F.lit("x")), F.lit(" then "), F.coalesce(F.get(w, 1), F.lit("y")), F.lit(" else keep"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.rule_clauses(rule)).alias("c")).select("doc_id", "c.subject", "c.if_true", "c.if_false")


QUERIES["t18_rule_clauses"] = (
    _clauses,
    f"""WITH w AS (SELECT doc_id, coalesce({_W}[1], 'x') AS a, coalesce({_W}[2], 'y') AS b FROM documents)
    SELECT doc_id, a AS subject, CASE WHEN doc_id % 2 = 0 THEN 'keep' ELSE b END AS if_true, CASE WHEN doc_id % 2 = 0 THEN b ELSE 'keep' END AS if_false
    FROM w WHERE regexp_full_match(a, '[A-Za-z0-9_]+')""",
)
