"""Queries of the evaluation operators; ranks, scores and decisions are taken from documents and labels."""

# ruff: noqa: E731
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hintspark.operators import evaluation as E
from hintspark.queries import table

QUERIES: dict = {}
_P = lambda r, size=20: f"ceil({r} / {size}.0)::BIGINT"


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query per document: baseline, helper and deferred rank, a score, its source and language."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (d * 7 % 61 + 1).alias("base"), (d * 13 % 61 + 1).alias("helper"), (d * 17 % 61 + 1).alias("late"), (F.col("n_chars") % 17).alias("score"), (d % 3 == 0).alias("called"), (d % 4 == 0).alias("called_new")
    )


_RANKS = "(SELECT doc_id, lang, source, doc_id * 7 % 61 + 1 AS base, doc_id * 13 % 61 + 1 AS helper, doc_id * 17 % 61 + 1 AS late, n_chars % 17 AS score, doc_id % 3 = 0 AS called, doc_id % 4 = 0 AS called_new FROM documents)"


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("label"), (F.col("n_chars") % 23 + F.col("quality") * 4).cast("double").alias("score"))


_PREDS = "(SELECT doc_id, lang, source, quality AS label, (n_chars % 23 + quality * 4)::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"
_LEVELS = f"""levels AS (SELECT lang, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM {_PREDS} GROUP BY ALL),
    l AS (SELECT *, coalesce(sum(pos) OVER a, 0) AS pa, coalesce(sum(neg) OVER a, 0) AS na, sum(pos) OVER (PARTITION BY lang) AS p, sum(neg) OVER (PARTITION BY lang) AS n
      FROM levels WINDOW a AS (PARTITION BY lang ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rank_metrics(_ranks(spark, sf_dir).withColumn("first_rank", F.when(F.col("doc_id") % 11 != 0, F.col("base"))), ["lang", "source"])


QUERIES["e1_rank_metrics"] = (
    _found,
    f"""WITH f AS (SELECT lang, source, CASE WHEN doc_id % 11 <> 0 THEN base END AS r FROM {_RANKS}),
    s AS (SELECT 'all' AS stratum, '' AS value, r FROM f UNION ALL SELECT 'lang', lang, r FROM f UNION ALL SELECT 'source', source, r FROM f)
    SELECT stratum, value, count(*) AS queries, round(count(*) FILTER (r <= 1) / count(*), 6) AS recall_1, round(count(*) FILTER (r <= 5) / count(*), 6) AS recall_5,
      round(count(*) FILTER (r <= 10) / count(*), 6) AS recall_10, round(sum(coalesce(1 / r, 0)) / count(*), 6) AS mrr, round(avg(r), 6) AS mean_rank, quantile_disc(r, 0.5) AS p50, quantile_disc(r, 0.95) AS p95 FROM s GROUP BY ALL""",
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a task: its suppliers are the gold, ranked by their first line; every fifth supplier is unranked."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("item")).agg(F.min("l_linenumber").cast("long").alias("rank"))
    return E.file_measure(lines.where("item % 5 <> 0"), lines.select("task", "item"), "task", "item")


QUERIES["e2_file_measure"] = (
    _files,
    """WITH g AS (SELECT l_orderkey AS task, l_suppkey AS item, min(l_linenumber)::BIGINT AS first FROM lineitem GROUP BY ALL),
    r AS (SELECT task, item, CASE WHEN item % 5 <> 0 THEN first END AS rank FROM g)
    SELECT task, count(*) AS targets, count(rank) AS mapped, coalesce(min(rank), 0) AS first_rank, coalesce(min(rank) <= 1, false) AS hit_1, coalesce(min(rank) <= 10, false) AS hit_10, coalesce(min(rank) <= 100, false) AS hit_100,
      count(*) FILTER (rank <= 10) = count(*) AS all_in_10, round(coalesce(1 / min(rank), 0), 6) AS reciprocal_rank FROM r GROUP BY task""",
)
QUERIES["e3_policy_aggregate"] = (
    lambda s, d: E.policy_aggregate(_ranks(s, d), "source", "base", ["base", "helper", "late"]),
    f"""WITH r AS (UNPIVOT (SELECT source, base AS b, base, helper, late FROM {_RANKS}) ON base, helper, late INTO NAME policy VALUE rank)
    SELECT source, policy, count(*) AS tasks, sum({_P("rank")})::BIGINT AS pages, count(*) FILTER (rank <= 10) AS hit_10, count(*) FILTER ({_P("rank")} < {_P("b")}) AS improved, count(*) FILTER ({_P("rank")} > {_P("b")}) AS worsened,
      count(*) FILTER ({_P("rank")} = {_P("b")}) AS tied FROM r GROUP BY GROUPING SETS ((source, policy), (policy))""",
)
QUERIES["e4_page_cost"] = (
    lambda s, d: E.page_cost(_ranks(s, d), "base", "helper", F.lit(61)),
    f"""WITH r AS (SELECT size, ceil(base / size)::BIGINT AS a, ceil(helper / size)::BIGINT AS b FROM {_RANKS}, (SELECT unnest([1, 5, 10, 20, 50]) AS size))
    SELECT size, sum(a)::BIGINT AS baseline_pages, sum(b)::BIGINT AS other_pages, sum(least(a * size, 61))::BIGINT AS baseline_emitted, sum(least(b * size, 61))::BIGINT AS other_emitted, count(*) FILTER (b < a) AS wins, count(*) FILTER (b > a) AS losses,
      count(*) FILTER (b = a) AS ties, sum(2 * b)::BIGINT AS work, count(*) FILTER (2 * b < a) AS work_wins, count(*) FILTER (2 * b > a) AS work_losses FROM r GROUP BY size""",
)
_BINARY = """count(*) FILTER (t AND x) AS tp, count(*) FILTER (NOT t AND NOT x) AS tn, count(*) FILTER (NOT t AND x) AS fp, count(*) FILTER (t AND NOT x) AS fn"""
QUERIES["e5_binary_metrics"] = (
    lambda s, d: E.binary_metrics(_preds(s, d), ["lang"], "label", F.col("score") >= 12),
    f"""WITH c AS (SELECT lang, {_BINARY} FROM (SELECT lang, label = 1 AS t, score >= 12 AS x FROM {_PREDS}) GROUP BY lang)
    SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
)
QUERIES["e6_auc"] = (
    lambda s, d: E.auc(E.score_levels(_preds(s, d), ["lang"], "label", "score"), ["lang"]),
    f"""WITH {_LEVELS} SELECT lang, CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(neg * (pa + pos / 2)) / max(p * n), 6) END AS auc,
      CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(pos * ((pa + pos) / (pa + pos + na + neg))) / max(p), 6) END AS average_precision FROM l GROUP BY lang""",
)
QUERIES["e7_best_threshold"] = (
    lambda s, d: E.best_threshold(E.score_levels(_preds(s, d), ["lang"], "label", "score"), ["lang"]),
    f"""WITH {_LEVELS}, b AS (SELECT lang, score, round(((pa + pos) / nullif(p, 0) + 1 - (na + neg) / nullif(n, 0)) / 2, 9) AS b FROM l)
    SELECT lang, score AS threshold, round(b, 6) AS balanced_accuracy FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY b DESC, score DESC) = 1""",
)
QUERIES["e8_group_bootstrap"] = (
    lambda s, d: E.group_bootstrap_delta(_preds(s, d), "source", "label", F.col("score") >= 12, F.col("score") >= 8, 200),
    f"""WITH c AS (SELECT source, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n, count(*) FILTER (label = 1 AND score >= 12) AS ap, count(*) FILTER (label <> 1 AND score < 12) AS an,
      count(*) FILTER (label = 1 AND score >= 8) AS bp, count(*) FILTER (label <> 1 AND score < 8) AS bn FROM {_PREDS} GROUP BY source),
    k AS (SELECT *, row_number() OVER (ORDER BY sha256('bootstrap:' || source), source) - 1 AS number, count(*) OVER () AS groups FROM c),
    draws AS (SELECT r AS replicate, CAST('0x' || substr(sha256('bootstrap:' || r || ':' || number), 1, 8) AS BIGINT) % groups AS number FROM k, (SELECT unnest(range(1, 201)) AS r)),
    s AS (SELECT replicate, sum(p) AS p, sum(n) AS n, sum(ap) AS ap, sum(an) AS an, sum(bp) AS bp, sum(bn) AS bn FROM draws JOIN k USING (number) GROUP BY replicate),
    d AS (SELECT (bp / nullif(p, 0) + bn / nullif(n, 0) - ap / nullif(p, 0) - an / nullif(n, 0)) / 2 AS d FROM s)
    SELECT round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(*) AS replicates FROM d""",
)
QUERIES["e10_calibrate_budget"] = (
    lambda s, d: E.calibrate_budget(_ranks(s, d), "score", "base", "helper", 50),
    f"""WITH l AS (SELECT score AS threshold, count(*) AS n, sum({_P("base")} - {_P("helper")}) AS gain FROM {_RANKS} GROUP BY score),
    u AS (SELECT threshold, sum(n) OVER w AS calls, sum(gain) OVER w AS saved FROM l WINDOW w AS (ORDER BY threshold DESC)),
    t AS (SELECT count(*) AS every, sum({_P("base")}) AS base FROM {_RANKS}),
    b AS (SELECT u.* FROM u, t WHERE calls * 100 <= every * 50 AND saved > 0 ORDER BY saved DESC, calls, threshold DESC LIMIT 1)
    SELECT threshold, coalesce(calls, 0)::BIGINT AS calls, (base - coalesce(saved, 0))::BIGINT AS pages FROM t LEFT JOIN b ON true""",
)
QUERIES["e11_apply_threshold"] = (
    lambda s, d: _ranks(s, d).select("doc_id", (F.col("score") >= 9).alias("call"), F.when(F.col("score") >= 9, F.col("helper")).otherwise(F.col("base")).alias("rank")),
    f"SELECT doc_id, score >= 9 AS call, CASE WHEN score >= 9 THEN helper ELSE base END AS rank FROM {_RANKS}",
)
_USED = f"(SELECT *, {_P('base')} AS b, {_P('CASE WHEN called THEN helper ELSE base END')} AS u, CASE WHEN called THEN helper ELSE base END AS rank FROM {_RANKS})"
_TOTALS = """count(*) AS questions, sum(u)::BIGINT AS pages, count(*) FILTER (called) AS calls, count(*) FILTER (u < b) AS wins, count(*) FILTER (u > b) AS losses, count(*) FILTER (u = b) AS ties, count(*) FILTER (rank <= 10) AS hit_10, (sum(u) + count(*) FILTER (called))::BIGINT AS work"""
QUERIES["e12_counterfactual"] = (
    lambda s, d: E.counterfactual(_ranks(s, d), F.col("called"), "base", "helper", "lang", "source"),
    f"SELECT lang, source, {_TOTALS} FROM {_USED} GROUP BY GROUPING SETS ((), (lang), (lang, source))",
)


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Never, always, and calls where the gap between two scores is small."""
    rows, out = _ranks(spark, sf_dir), None
    for name, called in (("never", F.lit(False)), ("always", F.lit(True)), ("gap", -(F.col("score") - F.col("score") % 5) >= -10)):
        part = E.counterfactual(rows, called, "base", "helper", "lang", "source").where("lang IS NULL AND source IS NULL").select(F.lit(name).alias("control"), "pages", "calls", "wins", "losses")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["e13_controls"] = (
    _controls,
    f"""WITH c AS (SELECT control, {_P("base")} AS b, CASE WHEN control = 'always' OR (control = 'gap' AND -(score - score % 5) >= -10) THEN {_P("helper")} ELSE {_P("base")} END AS u,
      control = 'always' OR (control = 'gap' AND -(score - score % 5) >= -10) AS called FROM {_RANKS}, (SELECT unnest(['never', 'always', 'gap']) AS control))
    SELECT control, sum(u)::BIGINT AS pages, count(*) FILTER (called) AS calls, count(*) FILTER (u < b) AS wins, count(*) FILTER (u > b) AS losses FROM c GROUP BY control""",
)


def _headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranks(spark, sf_dir).select("source", "base", F.explode(F.array(*(F.struct(F.lit(h).alias("helper_name"), F.col(h).alias("rank")) for h in ("helper", "late")))).alias("h")).select("source", "base", "h.*")
    a, b = E.pages(F.col("base"), 20), E.pages(F.col("rank"), 20)
    return rows.groupingSets([[F.col("helper_name")], [F.col("helper_name"), F.col("source")]], "helper_name", "source").agg(
        F.sum(b).alias("pages"), F.sum(F.greatest(a - b, F.lit(0))).alias("gained"), F.sum(F.greatest(b - a, F.lit(0))).alias("lost"), (F.sum(F.greatest(a - b, F.lit(0))) * 20 >= F.sum(a)).alias("five_percent"), F.round(F.count_if(F.col("rank") <= 10) / F.count("*"), 6).alias("hit_10")
    )


QUERIES["e14_headroom"] = (
    _headroom,
    f"""WITH r AS (UNPIVOT (SELECT source, base, helper, late FROM {_RANKS}) ON helper, late INTO NAME helper_name VALUE rank)
    SELECT helper_name, source, sum({_P("rank")})::BIGINT AS pages, sum(greatest({_P("base")} - {_P("rank")}, 0))::BIGINT AS gained, sum(greatest({_P("rank")} - {_P("base")}, 0))::BIGINT AS lost, sum(greatest({_P("base")} - {_P("rank")}, 0)) * 20 >= sum({_P("base")}) AS five_percent,
      round(count(*) FILTER (rank <= 10) / count(*), 6) AS hit_10 FROM r GROUP BY GROUPING SETS ((helper_name), (helper_name, source))""",
)
_GAIN = f"({_P('base')} - {_P('helper')})"
QUERIES["e15_claim_effect"] = (
    lambda s, d: E.claim_effect(_ranks(s, d), F.col("called"), "base", "helper"),
    f"""SELECT count(*) FILTER (called AND g > 0) AS beneficial, count(*) FILTER (NOT called AND g > 0) AS missed, count(*) FILTER (called AND g < 0) AS harmful, count(*) FILTER (NOT called AND g < 0) AS avoided,
      count(*) FILTER (called AND g = 0) AS idle, sum(CASE WHEN called THEN g ELSE 0 END)::BIGINT AS pages_saved, sum(CASE WHEN NOT called AND g > 0 THEN g ELSE 0 END)::BIGINT AS pages_missed FROM (SELECT called, {_GAIN} AS g FROM {_RANKS})""",
)
QUERIES["e16_call_transitions"] = (
    lambda s, d: E.call_transitions(_ranks(s, d), F.col("called"), F.col("called_new"), E.pages(F.col("base"), 20) - E.pages(F.col("helper"), 20)),
    f"""SELECT called AS was_called, called_new AS is_called, count(*) AS rows, sum(d)::BIGINT AS pages, count(*) FILTER (d = -1) AS lost_1, count(*) FILTER (d BETWEEN -5 AND -2) AS lost_2_5, count(*) FILTER (d BETWEEN -20 AND -6) AS lost_6_20, count(*) FILTER (d <= -21) AS lost_more
    FROM (SELECT called, called_new, CASE WHEN called_new AND NOT called THEN {_GAIN} WHEN called AND NOT called_new THEN -{_GAIN} ELSE 0 END AS d FROM {_RANKS}) GROUP BY ALL""",
)
QUERIES["e17_deferred"] = (
    lambda s, d: E.deferred_continuation(_ranks(s, d), F.col("called"), "base", "late"),
    f"""WITH r AS (SELECT NOT called AND {_P("base")} > 1 AS goes, {_P("base")} AS b, {_P("late")} AS l FROM {_RANKS}), u AS (SELECT goes, b, CASE WHEN goes THEN l ELSE b END AS u FROM r)
    SELECT count(*) FILTER (goes) AS calls, sum(u)::BIGINT AS pages, sum(greatest(b - u, 0))::BIGINT AS saved, sum(greatest(u - b, 0))::BIGINT AS added FROM u""",
)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and prevalence of two features for each fold (language)."""
    rows = _preds(spark, sf_dir).select("lang", "label", F.explode(F.array(F.struct(F.lit("score").alias("feature"), F.col("score").alias("value")), F.struct(F.lit("id").alias("feature"), (F.col("doc_id") % 31).cast("double").alias("value")))).alias("f")).select("lang", "label", "f.*")
    by = ["feature", "lang"]
    measured = E.auc(E.score_levels(rows, by, "label", "value"), by)
    prevalence = rows.groupBy(*by).agg(F.round(F.avg((F.col("label") == 1).cast("int")), 6).alias("prevalence"))
    return measured.join(prevalence, by).groupBy("feature").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("auc", "average_precision", "prevalence")), F.count("*").alias("folds"))


QUERIES["e18_signal_audit"] = (
    _signals,
    f"""WITH r AS (SELECT lang, label, 'score' AS feature, score AS value FROM {_PREDS} UNION ALL SELECT lang, label, 'id', (doc_id % 31)::DOUBLE FROM {_PREDS}),
    levels AS (SELECT feature, lang, value, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM r GROUP BY ALL),
    l AS (SELECT *, coalesce(sum(pos) OVER a, 0) AS pa, coalesce(sum(neg) OVER a, 0) AS na, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM levels
      WINDOW a AS (PARTITION BY feature, lang ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY feature, lang)),
    m AS (SELECT feature, lang, CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(neg * (pa + pos / 2)) / max(p * n), 6) END AS auc, CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(pos * ((pa + pos) / (pa + pos + na + neg))) / max(p), 6) END AS average_precision, round(max(p) / (max(p) + max(n)), 6) AS prevalence FROM l GROUP BY ALL)
    SELECT feature, round(avg(auc), 6) AS auc, round(avg(average_precision), 6) AS average_precision, round(avg(prevalence), 6) AS prevalence, count(*) AS folds FROM m GROUP BY feature""",
)


def _pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals (score 12 and more) against labels, over all and by language."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", F.col("quality").alias("label"), (F.col("n_chars") % 23).alias("s"))
    proposed = F.col("s") >= 12
    return rows.groupingSets([[], [F.col("lang")]], "lang").agg(
        F.count("*").alias("observed"), F.count("label").alias("annotated"), F.count_if(F.col("label").isNull()).alias("missing"), F.count_if(proposed).alias("proposals"), F.count_if(~proposed).alias("abstained"), F.count_if(proposed & (F.col("label") == 0)).alias("wrong")
    )


QUERIES["e20_pilot_metrics"] = (
    _pilot,
    """SELECT lang, count(*) AS observed, count(quality) AS annotated, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (n_chars % 23 >= 12) AS proposals, count(*) FILTER (n_chars % 23 < 12) AS abstained,
      count(*) FILTER (n_chars % 23 >= 12 AND quality = 0) AS wrong FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))""",
)
_CAND = "(SELECT o_custkey AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS ok FROM orders)"


def _utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are its candidates; those whose state is P are unknown."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("ok"))
    return E.stored_utility(rows, "parent", "rank", "ok")


QUERIES["e23_stored_utility"] = (
    _utility,
    f"""SELECT parent, coalesce(min(rank) FILTER (ok), count(*))::BIGINT AS checks, coalesce(min(rank) FILTER (ok) <= 1, false) AS top_1, coalesce(min(rank) FILTER (ok) <= 3, false) AS top_3, count(*) FILTER (ok) AS acceptable FROM {_CAND} WHERE ok IS NOT NULL GROUP BY parent""",
)


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    raw = [n % 7 + 1, n % 11 + 1, n % 5 + 1]
    total = raw[0] + raw[1] + raw[2]
    rows = table(spark, sf_dir, "documents").select("lang", *((r / total).alias(t) for r, t in zip(raw, ("fast", "middle", "strong"))), F.element_at(F.array(*map(F.lit, ("fast", "middle", "strong"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("truth"))
    return E.tier_metrics(rows, ["lang"], ("fast", "middle", "strong"), "strong", "fast", "truth", 0.6)


QUERIES["e24_tier_metrics"] = (
    _tiers,
    """WITH r AS (SELECT lang, n_chars % 7 + 1 AS a, n_chars % 11 + 1 AS b, n_chars % 5 + 1 AS c, ['fast', 'middle', 'strong'][doc_id % 3 + 1] AS truth FROM documents),
    p AS (SELECT lang, truth, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM r),
    x AS (SELECT lang, truth, CASE WHEN a >= b AND a >= c THEN 'fast' WHEN b >= c THEN 'middle' ELSE 'strong' END AS best, greatest(a, b, c) AS top, CASE truth WHEN 'fast' THEN a WHEN 'middle' THEN b ELSE c END AS own,
      power(a - (truth = 'fast')::INT, 2) + power(b - (truth = 'middle')::INT, 2) + power(c - (truth = 'strong')::INT, 2) AS brier FROM p)
    SELECT lang, count(*) AS rows, round(count(*) FILTER (best = truth) / count(*), 6) AS accuracy, round(count(*) FILTER (best = truth AND top >= 0.6) / nullif(count(*) FILTER (top >= 0.6), 0), 6) AS accepted_precision, round(count(*) FILTER (top >= 0.6) / count(*), 6) AS coverage,
      round(count(*) FILTER (truth = 'strong' AND best = truth) / nullif(count(*) FILTER (truth = 'strong'), 0), 6) AS strong_recall, count(*) FILTER (truth = 'strong' AND best = 'fast') AS strong_as_fast, round(avg(-ln(own)), 6) AS nll, round(avg(brier), 6) AS brier FROM x GROUP BY lang""",
)


def _nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = [F.col("n_chars") % m + 1 for m in (3, 5, 7, 11)]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    rows = table(spark, sf_dir, "documents").select("lang", *((r / total).alias(f"p{i}") for i, r in enumerate(raw)), F.when(F.col("doc_id") % 2 == 0, "left").otherwise("right").alias("target"))
    return E.grouped_nll(rows, ["lang"], ["p0", "p1", "p2", "p3"], {"left": [0, 1], "right": [2, 3]}, "target")


QUERIES["e25_grouped_nll"] = (
    _nll,
    """WITH r AS (SELECT lang, doc_id, n_chars % 3 + 1 AS a, n_chars % 5 + 1 AS b, n_chars % 7 + 1 AS c, n_chars % 11 + 1 AS d FROM documents)
    SELECT lang, count(*) AS rows, round(avg(-ln(CASE WHEN doc_id % 2 = 0 THEN a + b ELSE c + d END / (a + b + c + d))), 6) AS nll FROM r GROUP BY lang""",
)
QUERIES["e26_order_sensitivity"] = (
    lambda s, d: E.order_sensitivity(table(s, d, "documents").select((F.col("n_chars") % 100 / 100).alias("f"), (F.col("n_chars") * 3 % 100 / 100).alias("r")), "f", "r"),
    "SELECT round(avg(abs(n_chars % 100 / 100 - n_chars * 3 % 100 / 100)), 6) AS mean_gap, count(*) FILTER ((n_chars % 100 / 100 >= 0.5) <> (n_chars * 3 % 100 / 100 >= 0.5)) AS disagreements, count(*) AS rows FROM documents",
)


def _listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("position"), (F.col("l_quantity") / 10).alias("score"), (F.col("l_linenumber") == 1).cast("int").alias("target"))
    return E.listwise_metrics(rows, "query", "score", "position", "target")


QUERIES["e27_listwise"] = (
    _listwise,
    """WITH r AS (SELECT l_orderkey AS query, l_linenumber AS position, l_quantity / 10 AS score FROM lineitem),
    s AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, position) AS rank, ln(sum(exp(score)) OVER (PARTITION BY query)) - score AS nll FROM r)
    SELECT query, rank, round(nll, 6) AS nll FROM s WHERE position = 1""",
)
