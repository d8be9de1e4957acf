"""Queries of evaluation by family and lineage; a family is two documents, a lineage six."""

# ruff: noqa: E731
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hintspark.operators import families as M
from hintspark.queries import table

QUERIES: dict = {}
_DOC = lambda s, d: table(s, d, "documents")


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target en or unclear; probabilities from the number of characters."""
    k, n = F.col("doc_id"), F.col("n_chars")
    p = (n % 19 + 1) / 20
    g = M.gated(F.when(p >= 0.5, "en").otherwise("unclear"), F.when(k % 9 == 0, "rule").otherwise("learned"), F.when(k % 13 == 0, "no_word").otherwise(""), F.greatest(p, 1 - p), F.abs(2 * p - 1), 0.6)
    target = F.when(F.col("lang") == "en", "en").otherwise("unclear")
    return _DOC(spark, sf_dir).select(F.floor(k / 2).alias("family"), F.when(k % 2 == 0, "ko").otherwise("en").alias("locale"), target.alias("target"), g["proposed"].alias("proposed"), g["reason"].alias("reason"), F.when(target == "en", p).otherwise(1 - p).alias("own"), (2 * F.pow(1 - F.when(target == "en", p).otherwise(1 - p), 2)).alias("brier"))


_FAMILIES = """f AS (SELECT doc_id // 2 AS family, CASE WHEN doc_id % 2 = 0 THEN 'ko' ELSE 'en' END AS locale, CASE WHEN lang = 'en' THEN 'en' ELSE 'unclear' END AS target, (n_chars % 19 + 1) / 20 AS p,
      CASE WHEN doc_id % 13 = 0 THEN 'guarded' WHEN doc_id % 9 = 0 THEN 'not_learned' WHEN (n_chars % 19 + 1) / 20 < 0.5 THEN 'outside_scope' WHEN greatest((n_chars % 19 + 1) / 20, 1 - (n_chars % 19 + 1) / 20) < 0.6 THEN 'below_confidence'
        WHEN abs(2 * ((n_chars % 19 + 1) / 20) - 1) < 0.05 THEN 'below_margin' ELSE '' END AS reason FROM documents),
    r AS (SELECT *, CASE WHEN reason = '' THEN 'en' ELSE 'unclear' END AS proposed, CASE WHEN target = 'en' THEN p ELSE 1 - p END AS own FROM f)"""
QUERIES["e19_family_report"] = (
    lambda s, d: M.family_report(_families(s, d)),
    f"""WITH {_FAMILIES} SELECT locale, count(*) AS rows, count(*) FILTER (proposed <> 'unclear') AS proposals, count(*) FILTER (proposed <> 'unclear' AND proposed = target) AS right, count(*) FILTER (target <> 'unclear' AND proposed <> target) AS missed, round(avg(-ln(own)), 6) AS nll,
      round(avg(2 * power(1 - own, 2)), 6) AS brier, count(DISTINCT CASE WHEN proposed <> target THEN family END) AS families_with_errors FROM r GROUP BY GROUPING SETS ((), (locale))""",
)
QUERIES["e19_confusion"] = (lambda s, d: M.confusion(_families(s, d), ["locale", "reason"], "target", "proposed"), f"WITH {_FAMILIES} SELECT locale, reason, target, proposed, count(*) AS rows FROM r GROUP BY ALL")
_HEADS = ["quality", "toxic"]


def _claims(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    rows = _DOC(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    name = lambda c: F.when(c == 1, "true").when(c == 0, "false").otherwise("unknown")
    columns = [F.col("lang").alias("locale"), F.floor(F.col("doc_id") / 6).alias("lineage")]
    for i, h in enumerate(_HEADS):
        n = F.col("n_chars") + i + shift
        columns += [name(F.col(h)).alias(f"{h}_target"), F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("unknown")), (n % 3 + 1).cast("int")).alias(f"{h}_state"), ((n % 9 + 1) / 10).alias(f"{h}_own")]
    return M.claims_report(rows.select(*columns), _HEADS)


def _claims_sql(shift: int = 0) -> str:
    heads = " UNION ALL ".join(f"SELECT lang AS locale, doc_id // 6 AS lineage, '{h}' AS head, CASE {h} WHEN 1 THEN 'true' WHEN 0 THEN 'false' ELSE 'unknown' END AS target, ['true', 'false', 'unknown'][(n_chars + {i + shift}) % 3 + 1] AS state, ((n_chars + {i + shift}) % 9 + 1) / 10 AS own FROM documents LEFT JOIN labels USING (doc_id)" for i, h in enumerate(_HEADS))
    return f"SELECT locale, head, target, count(*) AS rows, round(avg(-ln(own)), 6) AS ce, count(*) FILTER (state = target) AS right, count(*) FILTER (state = 'true') AS emitted_true, count(*) FILTER (state = 'unknown') AS unknown, count(DISTINCT lineage) AS lineages FROM ({heads}) GROUP BY ALL"


QUERIES["e21_claims_report"] = (_claims, _claims_sql())
_SIDE = lambda name, shift: f"(SELECT locale, round(sum(ce * rows) FILTER (target = 'unknown') / sum(rows) FILTER (target = 'unknown'), 4) AS {name}_ce, sum(CASE WHEN target <> 'true' THEN emitted_true ELSE 0 END)::BIGINT AS {name}_false FROM ({_claims_sql(shift)}) GROUP BY locale)"
QUERIES["e22_progress_gate"] = (
    lambda s, d: M.progress_gate(_claims(s, d), _claims(s, d, 4)),
    f"SELECT *, candidate_ce < comparator_ce AND candidate_false <= comparator_false AS passes FROM {_SIDE('candidate', 0)} JOIN {_SIDE('comparator', 4)} USING (locale)",
)
QUERIES["e9_lineage_bootstrap"] = (
    lambda s, d: M.lineage_bootstrap(_DOC(s, d).select(F.floor(F.col("doc_id") / 6).alias("lineage"), F.when(F.floor(F.col("doc_id") / 6) % 3 == 0, "a").otherwise("b").alias("stratum"), (F.col("n_chars") % 21 - 10).alias("x")), "lineage", "stratum", "x", {"a": 2, "b": 1}, 200),
    """WITH m AS (SELECT CASE WHEN doc_id // 6 % 3 = 0 THEN 'a' ELSE 'b' END AS s, doc_id // 6 AS l, avg(n_chars % 21 - 10) AS d FROM documents GROUP BY ALL),
    k AS (SELECT s, d, row_number() OVER (PARTITION BY s ORDER BY sha256('lineage:' || l), l) - 1 AS number, count(*) OVER (PARTITION BY s) AS n FROM m),
    x AS (SELECT r, s, CAST('0x' || substr(sha256('lineage:' || s || ':' || r || ':' || number), 1, 8) AS BIGINT) % n AS number FROM k, (SELECT unnest(range(1, 201)) AS r)),
    p AS (SELECT r, s, avg(d) AS m FROM x JOIN k USING (s, number) GROUP BY ALL), t AS (SELECT r, sum(m * CASE s WHEN 'a' THEN 2 ELSE 1 END) / sum(CASE s WHEN 'a' THEN 2 ELSE 1 END) AS t FROM p GROUP BY r)
    SELECT round(quantile_cont(t, 0.025), 6) AS low, round(quantile_cont(t, 0.975), 6) AS high, count(*) AS replicates FROM t""",
)


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _DOC(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 23 + F.col("quality") * 4).alias("m1"), (F.col("n_chars") % 7 + F.col("quality")).alias("m2"), (F.col("n_chars") < 3000).alias("scope"))
    return M.paired_eval(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0"), ["m1", "m2"], "label", "scope", "m2")


def _paired_sql() -> str:
    rows = "(SELECT doc_id, quality AS label, n_chars % 23 + quality * 4 AS m1, n_chars % 7 + quality AS m2, n_chars < 3000 AS scope FROM documents JOIN labels USING (doc_id))"
    best = lambda m: f"(SELECT t FROM (SELECT c.t, round((count(*) FILTER (label = 1 AND {m} >= t) / count(*) FILTER (label = 1) + 1 - count(*) FILTER (label <> 1 AND {m} >= t) / count(*) FILTER (label <> 1)) / 2, 9) AS b FROM {rows} r, (SELECT DISTINCT {m} AS t FROM {rows} WHERE doc_id % 3 = 0) c WHERE r.doc_id % 3 = 0 GROUP BY c.t) ORDER BY b DESC, t DESC LIMIT 1)"
    one = lambda m: f"SELECT '{m}' AS model, label = 1 AS t, CASE WHEN scope THEN {m} >= {best(m)} ELSE m2 >= {best('m2')} END AS x, unnest(['all', CASE WHEN scope THEN 'in_scope' ELSE 'fallback' END]) AS part FROM {rows} WHERE doc_id % 3 <> 0"
    return f"""WITH c AS (SELECT model, part, count(*) FILTER (t AND x) AS tp, count(*) FILTER (NOT t AND NOT x) AS tn, count(*) FILTER (NOT t AND x) AS fp, count(*) FILTER (t AND NOT x) AS fn FROM ({one("m1")} UNION ALL {one("m2")}) GROUP BY ALL)
    SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"""


QUERIES["e29_paired_eval"] = (_paired, _paired_sql())
QUERIES["r17_selective_helper"] = (
    lambda s, d: M.selected_ranking(_DOC(s, d).select("doc_id", (F.col("doc_id") * 7 % 61 + 1).alias("base"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") * 13 % 61 + 1).alias("merged")), F.col("doc_id") % 3 == 0, "base", "merged"),
    """WITH r AS (SELECT doc_id, doc_id * 7 % 61 + 1 AS base, CASE WHEN doc_id % 5 <> 0 THEN doc_id * 13 % 61 + 1 END AS merged FROM documents), s AS (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN 'baseline' WHEN merged IS NULL THEN 'fallback' ELSE 'used' END AS state FROM r)
    SELECT *, CASE WHEN state = 'used' THEN merged ELSE base END AS rank FROM s""",
)
QUERIES["l14_rotate_folds"] = (
    lambda s, d: M.rotate_folds(_DOC(s, d).select("doc_id", "source"), "source").groupBy("source", "fold", "part").agg(F.count("*").alias("rows")),
    """WITH g AS (SELECT source, (row_number() OVER (ORDER BY source) - 1) % 3 AS n FROM (SELECT DISTINCT source FROM documents)), f AS (SELECT unnest([0, 1, 2]) AS fold)
    SELECT source, fold, CASE WHEN n = fold THEN 'test' WHEN n = (fold + 1) % 3 THEN 'train' ELSE 'validation' END AS part, count(*) AS rows FROM documents JOIN g USING (source), f GROUP BY ALL""",
)
