"""Evaluation by family and lineage, of heads and of paired models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hintspark.operators import evaluation as E
from hintspark.plans.numbering import Ordered


def gated(intent: Column, source: Column, guard: Column, confidence: Column, margin: Column, least: float = 0.9, gap: float = 0.05) -> Column:
    """struct(proposed, reason): the intent if the prediction is learned, unguarded, clear and confident, else unclear."""
    reason = (
        F.when(guard != "", "guarded").when(source != "learned", "not_learned").when(intent == "unclear", "outside_scope").when(confidence < least, "below_confidence").when(margin < gap, "below_margin").otherwise("")
    )
    return F.struct(F.when(reason == "", intent).otherwise("unclear").alias("proposed"), reason.alias("reason"))


def family_report(rows: DataFrame) -> DataFrame:
    """Per locale and in total: rows, proposals, right ones, missed targets, mean -log and Brier score, and
    families with an error.

    rows: (family, locale, target, proposed, own, brier); own is the target's probability, brier the
    row's squared error over all classes. A target other than unclear that isn't proposed is missed.
    """
    wrong = F.col("proposed") != F.col("target")
    sets = rows.groupingSets([[], [F.col("locale")]], "locale")
    offered = F.col("proposed") != "unclear"
    return sets.agg(
        F.count("*").alias("rows"), F.count_if(offered).alias("proposals"), F.count_if(offered & ~wrong).alias("right"), F.count_if((F.col("target") != "unclear") & wrong).alias("missed"),
        F.round(F.avg(-F.log(F.greatest("own", F.lit(1e-12)))), 6).alias("nll"), F.round(F.avg("brier"), 6).alias("brier"), F.count_distinct(F.when(wrong, F.col("family"))).alias("families_with_errors"),
    )


def confusion(rows: DataFrame, by: list[str], target: str, predicted: str) -> DataFrame:
    """Counts of every target and prediction that occur together."""
    return rows.groupBy(*by, target, predicted).agg(F.count("*").alias("rows"))


def claims_report(rows: DataFrame, heads: list[str]) -> DataFrame:
    """Per locale, head and target state: rows, mean cross-entropy, right ones, emitted true ones and their precision, lineages.

    rows: (locale, lineage, and for each head h: h_target, h_state, h_own); states are true, false and
    unknown, and unknown is a state of its own, never false.
    """
    each = F.array(*(F.struct(F.lit(h).alias("head"), F.col(f"{h}_target").alias("target"), F.col(f"{h}_state").alias("state"), F.col(f"{h}_own").alias("own")) for h in heads))
    long = rows.select("locale", "lineage", F.explode(each).alias("h")).select("locale", "lineage", "h.*")
    return long.groupBy("locale", "head", "target").agg(
        F.count("*").alias("rows"), F.round(F.avg(-F.log(F.greatest("own", F.lit(1e-12)))), 6).alias("ce"), F.count_if(F.col("state") == F.col("target")).alias("right"), F.count_if(F.col("state") == "true").alias("emitted_true"),
        F.count_if(F.col("state") == "unknown").alias("unknown"), F.count_distinct("lineage").alias("lineages"),
    )


def progress_gate(candidate: DataFrame, comparator: DataFrame) -> DataFrame:
    """Per locale: whether the candidate's cross-entropy of unknown targets is lower and it adds no false true ones.

    Both frames are claims reports.
    """

    def side(report: DataFrame, name: str) -> DataFrame:
        return report.groupBy("locale").agg(
            F.round(F.sum(F.when(F.col("target") == "unknown", F.col("ce") * F.col("rows"))) / F.sum(F.when(F.col("target") == "unknown", F.col("rows"))), 4).alias(f"{name}_ce"), F.sum(F.when(F.col("target") != "true", F.col("emitted_true")).otherwise(0)).alias(f"{name}_false")
        )

    both = side(candidate, "candidate").join(side(comparator, "comparator"), "locale")
    return both.withColumn("passes", (F.col("candidate_ce") < F.col("comparator_ce")) & (F.col("candidate_false") <= F.col("comparator_false")))


def lineage_bootstrap(rows: DataFrame, lineage: str, stratum: str, difference: str, weights: dict[str, int], replicates: int = 500, seed: str = "lineage") -> DataFrame:
    """2.5 and 97.5 percent points of the weighted mean difference when lineages are drawn anew inside strata.

    There are replicates times as many draws as lineages, which a planner doesn't see, so neither side of their join is
    sent to the driver.
    """
    means = rows.groupBy(stratum, lineage).agg(F.avg(difference).alias("d"))
    order = W.partitionBy(stratum).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), lineage), 256), lineage)
    numbered = means.select(stratum, "d", (F.row_number().over(order) - 1).alias("number"), F.count("*").over(W.partitionBy(stratum)).alias("n"))
    draws = numbered.select(stratum, F.col("number").alias("slot"), "n").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), stratum, "replicate", "slot"), 256), 1, 8), 16, 10).cast("long") % F.col("n")
    picked = draws.select("replicate", stratum, drawn.alias("number")).hint("merge").join(numbered.select(stratum, "number", "d").hint("merge"), [stratum, "number"])
    per = picked.groupBy("replicate", stratum).agg(F.avg("d").alias("m"))
    weight = F.lit(None).cast("int")
    for s, w in weights.items():
        weight = F.when(F.col(stratum) == s, w).otherwise(weight)
    total = per.withColumn("w", weight).groupBy("replicate").agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("t"))
    return total.agg(F.round(F.percentile("t", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("t", F.lit(0.975)), 6).alias("high"), F.count("*").alias("replicates"))


def paired_eval(calibration: DataFrame, final: DataFrame, models: list[str], label: str, in_scope: str, fallback: str) -> DataFrame:
    """Metrics of each model on final rows at the threshold that is best on calibration rows alone.

    Rows out of scope take the fallback model's decision. part is all, in_scope or fallback.
    """
    out = None
    for model in models:
        both = [(m, E.best_threshold(E.score_levels(calibration.select(F.lit(1).alias("g"), label, m), ["g"], label, m), ["g"]).select(F.col("threshold").alias(f"t_{i}"))) for i, m in enumerate((model, fallback))]
        rows = final.join(F.broadcast(both[0][1])).join(F.broadcast(both[1][1]))  # one row each
        positive = F.when(F.col(in_scope), F.col(model) >= F.col("t_0")).otherwise(F.col(fallback) >= F.col("t_1"))
        parts = F.explode(F.array(F.lit("all"), F.when(F.col(in_scope), "in_scope").otherwise("fallback")))
        judged = rows.select(F.lit(model).alias("model"), F.col(label), positive.alias("positive"), parts.alias("part"))
        one = E.binary_metrics(judged, ["model", "part"], label, F.col("positive"))
        out = one if out is None else out.unionByName(one)
    return out


def selected_ranking(ranks: DataFrame, chosen: Column, baseline: str, merged: str) -> DataFrame:
    """ranks with the used rank: the merged one where the selector chose it and it exists, else the baseline's; and a state."""
    state = F.when(~chosen, "baseline").when(F.col(merged).isNull(), "fallback").otherwise("used")
    return ranks.withColumn("state", state).withColumn("rank", F.when(state == "used", F.col(merged)).otherwise(F.col(baseline)))


def rotate_folds(rows: DataFrame, group: str, folds: int = 3) -> DataFrame:
    """rows with fold, part: each row trains one fold, validates another and tests a third, by its group's number."""
    groups = Ordered(rows.select(group).distinct(), [group]).numbered("__n").withColumn("__n", (F.col("__n") - 1) % folds)
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.struct(f.alias("fold"), F.when(F.col("__n") == f, "test").when(F.col("__n") == (f + 1) % folds, "train").when(F.col("__n") == (f + 2) % folds, "validation").otherwise("train").alias("part"))))
    return rows.join(groups, group).select(*rows.columns, parts.alias("__p")).select(*rows.columns, "__p.fold", "__p.part")
