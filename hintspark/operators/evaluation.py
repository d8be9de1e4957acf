"""Evaluation of rankings, thresholds, budgets and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hintspark.plans.numbering import Ordered


def rank_metrics(first: DataFrame, sets: list[str], rank: str = "first_rank") -> DataFrame:
    """Recall at 1, 5 and 10, mean reciprocal rank, mean rank and nearest-rank percentiles of first
    ranks (null: not found), over all and for each of the sets' values.

    The percentile is the least rank with at least the asked share of found ranks at or below it.
    """
    exploded = first.select(F.explode(F.array(F.struct(F.lit("all").alias("stratum"), F.lit("").alias("value")), *(F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in sets))).alias("s"), F.col(rank).alias("rank")).select("s.stratum", "s.value", "rank")
    share = lambda condition: F.round(F.count_if(condition) / F.count("*"), 6)
    found = exploded.groupBy("stratum", "value").agg(
        F.count("*").alias("queries"), share(F.col("rank") <= 1).alias("recall_1"), share(F.col("rank") <= 5).alias("recall_5"), share(F.col("rank") <= 10).alias("recall_10"),
        F.round(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"), F.round(F.avg("rank"), 6).alias("mean_rank"),
    )
    levels = exploded.where("rank IS NOT NULL").groupBy("stratum", "value", "rank").agg(F.count("*").alias("n"))
    group = W.partitionBy("stratum", "value")
    reached = levels.withColumn("upto", F.sum("n").over(group.orderBy("rank"))).withColumn("total", F.sum("n").over(group))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(p * F.col("total")), F.col("rank")))
    percentiles = reached.groupBy("stratum", "value").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    return found.join(percentiles, ["stratum", "value"], "left")


def file_measure(ranks: DataFrame, gold: DataFrame, task: str, item: str) -> DataFrame:
    """Per task: targets, mapped ones, first rank, hits, whether all are in the first ten. ranks: (task, item, rank)."""
    joined = gold.join(ranks, [task, item], "left")
    first = F.min("rank")
    hit = lambda n: F.coalesce(first <= n, F.lit(False))
    return joined.groupBy(task).agg(
        F.count("*").alias("targets"), F.count("rank").alias("mapped"), F.coalesce(first, F.lit(0)).alias("first_rank"), hit(1).alias("hit_1"), hit(10).alias("hit_10"), hit(100).alias("hit_100"),
        (F.count_if(F.col("rank") <= 10) == F.count("*")).alias("all_in_10"), F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def pages(rank: Column, size: int) -> Column:
    """Pages of size to look at until a rank is reached."""
    return F.ceil(rank / size)


def policy_aggregate(scores: DataFrame, by: str, baseline: str, policies: list[str], size: int = 20) -> DataFrame:
    """Pages of each policy's first rank against the baseline's, in total and for each value of by."""
    rows = scores.select(by, F.col(baseline).alias("base"), F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(p).alias("rank")) for p in policies))).alias("p")).select(by, "base", "p.policy", "p.rank")
    a, b = pages(F.col("rank"), size), pages(F.col("base"), size)
    totals = rows.groupingSets([[F.col(by), F.col("policy")], [F.col("policy")]], by, "policy")
    return totals.agg(
        F.count("*").alias("tasks"), F.sum(a).alias("pages"), F.count_if(F.col("rank") <= 10).alias("hit_10"), F.count_if(a < b).alias("improved"), F.count_if(a > b).alias("worsened"), F.count_if(a == b).alias("tied")
    )


def page_cost(ranks: DataFrame, baseline: str, other: str, candidates: Column, sizes: tuple[int, ...] = (1, 5, 10, 20, 50)) -> DataFrame:
    """Pages and emitted candidates of two rankings for several page sizes; the other costs twice a page's work."""
    rows = ranks.select(F.col(baseline).alias("a"), F.col(other).alias("b"), candidates.alias("n"), F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    pa, pb = F.ceil(F.col("a") / F.col("size")), F.ceil(F.col("b") / F.col("size"))
    emitted = lambda p: F.sum(F.least(p * F.col("size"), F.col("n")))
    return rows.groupBy("size").agg(
        F.sum(pa).alias("baseline_pages"), F.sum(pb).alias("other_pages"), emitted(pa).alias("baseline_emitted"), emitted(pb).alias("other_emitted"),
        F.count_if(pb < pa).alias("wins"), F.count_if(pb > pa).alias("losses"), F.count_if(pb == pa).alias("ties"), F.sum(pb * 2).alias("work"), F.count_if(pb * 2 < pa).alias("work_wins"), F.count_if(pb * 2 > pa).alias("work_losses"),
    )


def binary_metrics(rows: DataFrame, by: list[str], label: str, positive: Column) -> DataFrame:
    truth = F.col(label) == 1
    n = lambda c: F.count_if(c)
    tp, tn, fp, fn = n(truth & positive), n(~truth & ~positive), n(~truth & positive), n(truth & ~positive)
    part = lambda a, b: F.round(F.try_divide(a, b), 6)
    return rows.groupBy(*by).agg(
        tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), part(tp + tn, F.count("*")).alias("accuracy"),
        F.round((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2, 6).alias("balanced_accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"),
    )


def score_levels(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Positives and negatives of each distinct score, with their counts above it; ties are one level.

    Counting comes first, so the running sums go over distinct scores, not over rows.
    """
    levels = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    above = W.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    group = W.partitionBy(*by)
    return levels.select(
        *by, "score", "pos", "neg", zero(F.sum("pos").over(above)).alias("pos_above"), zero(F.sum("neg").over(above)).alias("neg_above"),
        F.sum("pos").over(group).alias("positives"), F.sum("neg").over(group).alias("negatives"),
    )


def auc(levels: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve with ties as halves, and average precision with ties as one group; null with one class."""
    won = F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)
    hits = F.col("pos_above") + F.col("pos")
    precision = hits / (hits + F.col("neg_above") + F.col("neg"))
    both = (F.max("positives") > 0) & (F.max("negatives") > 0)
    return levels.groupBy(*by).agg(
        F.when(both, F.round(F.sum(won) / F.max(F.col("positives") * F.col("negatives")), 6)).alias("auc"),
        F.when(both, F.round(F.sum(F.col("pos") * precision) / F.max("positives"), 6)).alias("average_precision"),
    )


def best_threshold(levels: DataFrame, by: list[str]) -> DataFrame:
    """The highest score whose threshold has the best balanced accuracy."""
    hits, false = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    balanced = F.round((F.try_divide(hits, "positives") + 1 - F.try_divide(false, "negatives")) / 2, 9)
    best = levels.withColumn("b", balanced).groupBy(*by).agg(F.max(F.struct("b", "score")).alias("m"))
    return best.select(*by, F.col("m.score").alias("threshold"), F.round("m.b", 6).alias("balanced_accuracy"))


def group_bootstrap_delta(rows: DataFrame, group: str, label: str, a: Column, b: Column, replicates: int = 500, seed: str = "bootstrap") -> DataFrame:
    """2.5 and 97.5 percent points of the difference in balanced accuracy when groups are drawn anew.

    Rows become counts by group first. A replicate draws as many groups as there are, by hash, with
    replacement; groups are numbered once.
    """
    truth = F.col(label) == 1
    counts = rows.groupBy(group).agg(
        F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"), F.count_if(truth & a).alias("ap"), F.count_if(~truth & ~a).alias("an"), F.count_if(truth & b).alias("bp"), F.count_if(~truth & ~b).alias("bn")
    )
    counts = Ordered(counts, [F.sha2(F.concat_ws(":", F.lit(seed), group), 256), F.col(group)]).numbered("number").withColumn("number", F.col("number") - 1)
    size = counts.agg(F.count("*").alias("groups"))
    draws = counts.select(F.col("number").alias("slot")).join(F.broadcast(size)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "replicate", "slot"), 256), 1, 8), 16, 10).cast("long") % F.col("groups")
    sums = draws.select("replicate", drawn.alias("number")).join(counts, "number").groupBy("replicate").agg(*(F.sum(c).alias(c) for c in ("p", "n", "ap", "an", "bp", "bn")))
    delta = (F.try_divide("bp", "p") + F.try_divide("bn", "n") - F.try_divide("ap", "p") - F.try_divide("an", "n")) / 2
    return sums.agg(F.round(F.percentile(delta, F.lit(0.025)), 6).alias("low"), F.round(F.percentile(delta, F.lit(0.975)), 6).alias("high"), F.count("*").alias("replicates"))


def calibrate_budget(rows: DataFrame, score: str, baseline: str, helper: str, percent: int, size: int = 20) -> DataFrame:
    """The threshold with the fewest pages whose calls keep the budget; scores that are equal are called together.

    One row: threshold (null: disabled, as nothing gains), calls, pages.
    """
    gain = pages(F.col(baseline), size) - pages(F.col(helper), size)
    levels = rows.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(gain).alias("gain"))
    upto = Ordered(levels, [F.col("threshold").desc()]).running({"calls": F.col("n"), "saved": F.col("gain")}).select("threshold", "calls", "saved")
    whole = rows.agg(F.count("*").alias("all"), F.sum(pages(F.col(baseline), size)).alias("base"))
    good = upto.join(F.broadcast(whole)).where((F.col("calls") * 100 <= F.col("all") * percent) & (F.col("saved") > 0))
    best = good.agg(F.max(F.struct("saved", -F.col("calls"), "threshold")).alias("m"))
    return best.join(whole).select(F.col("m.threshold").alias("threshold"), F.coalesce(-F.col("m.col2"), F.lit(0)).alias("calls"), (F.col("base") - F.coalesce("m.saved", F.lit(0))).alias("pages"))


def counterfactual(rows: DataFrame, called: Column, baseline: str, helper: str, role: str, repository: str, size: int = 20) -> DataFrame:
    """Totals of a policy that calls the helper where called says so: over all, by role, by role and repository."""
    base, used = pages(F.col(baseline), size), pages(F.when(called, F.col(helper)).otherwise(F.col(baseline)), size)
    chosen = rows.select(role, repository, called.alias("called"), base.alias("base"), used.alias("used"), F.when(called, F.col(helper)).otherwise(F.col(baseline)).alias("rank"))
    sets = chosen.groupingSets([[], [F.col(role)], [F.col(role), F.col(repository)]], role, repository)
    return sets.agg(
        F.count("*").alias("questions"), F.sum("used").alias("pages"), F.count_if("called").alias("calls"), F.count_if(F.col("used") < F.col("base")).alias("wins"),
        F.count_if(F.col("used") > F.col("base")).alias("losses"), F.count_if(F.col("used") == F.col("base")).alias("ties"), F.count_if(F.col("rank") <= 10).alias("hit_10"), (F.sum("used") + F.count_if("called")).alias("work"),
    )


def claim_effect(rows: DataFrame, called: Column, baseline: str, helper: str, size: int = 20) -> DataFrame:
    """How many calls helped, harmed or did nothing, and what was missed or avoided."""
    gain = pages(F.col(baseline), size) - pages(F.col(helper), size)
    r = rows.select(called.alias("c"), gain.alias("g"))
    c, g = F.col("c"), F.col("g")
    return r.agg(
        F.count_if(c & (g > 0)).alias("beneficial"), F.count_if(~c & (g > 0)).alias("missed"), F.count_if(c & (g < 0)).alias("harmful"), F.count_if(~c & (g < 0)).alias("avoided"), F.count_if(c & (g == 0)).alias("idle"),
        F.sum(F.when(c, g).otherwise(0)).alias("pages_saved"), F.sum(F.when(~c & (g > 0), g).otherwise(0)).alias("pages_missed"),
    )


def call_transitions(rows: DataFrame, old: Column, new: Column, gain: Column) -> DataFrame:
    """The two-by-two table of calls before and after, with pages gained or lost by the change."""
    change = F.when(new & ~old, gain).when(old & ~new, -gain).otherwise(0)
    r = rows.select(old.alias("was_called"), new.alias("is_called"), change.alias("d"))
    loss = lambda low, high: F.count_if((F.col("d") <= -low) & (F.col("d") >= -high))
    return r.groupBy("was_called", "is_called").agg(
        F.count("*").alias("rows"), F.sum("d").alias("pages"), loss(1, 1).alias("lost_1"), loss(2, 5).alias("lost_2_5"), loss(6, 20).alias("lost_6_20"), F.count_if(F.col("d") <= -21).alias("lost_more")
    )


def deferred_continuation(rows: DataFrame, called: Column, baseline: str, deferred: str, size: int = 20) -> DataFrame:
    """Targets beyond the first page of a query that wasn't called go on with the deferred ranking."""
    base, late = pages(F.col(baseline), size), pages(F.col(deferred), size)
    goes = ~called & (base > 1)
    r = rows.select(goes.alias("goes"), base.alias("base"), F.when(goes, late).otherwise(base).alias("used"))
    diff = F.col("base") - F.col("used")
    return r.agg(F.count_if("goes").alias("calls"), F.sum("used").alias("pages"), F.sum(F.greatest(diff, F.lit(0))).alias("saved"), F.sum(F.greatest(-diff, F.lit(0))).alias("added"))


def grouped_nll(rows: DataFrame, by: list[str], probabilities: list[str], groups: dict[str, list[int]], target: str, floor: float = 1e-12) -> DataFrame:
    """Mean of -log of the summed probability of the target's display group."""
    of_group = {g: sum((F.col(probabilities[i]) for i in members), F.lit(0.0)) for g, members in groups.items()}
    p = F.lit(None).cast("double")
    for g, total in of_group.items():
        p = F.when(F.col(target) == g, total).otherwise(p)
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.round(F.avg(-F.log(F.greatest(p, F.lit(floor)))), 6).alias("nll"))


def order_sensitivity(rows: DataFrame, forward: str, reverse: str, at: float = 0.5) -> DataFrame:
    """Mean gap between scores in two orders, and decisions that differ."""
    f, r = F.col(forward), F.col(reverse)
    return rows.agg(F.round(F.avg(F.abs(f - r)), 6).alias("mean_gap"), F.count_if((f >= at) != (r >= at)).alias("disagreements"), F.count("*").alias("rows"))


def listwise_metrics(rows: DataFrame, query: str, score: str, position: str, target: str) -> DataFrame:
    """Target's rank by score (ties by position) and -log of its softmax share, per query. rows has one target (1) a query."""
    w = W.partitionBy(query)
    rank = F.row_number().over(w.orderBy(F.col(score).desc(), position))
    scored = rows.withColumn("rank", rank).withColumn("top", F.max(score).over(w))
    scored = scored.withColumn("nll", F.log(F.sum(F.exp(F.col(score) - F.col("top"))).over(w)) - (F.col(score) - F.col("top")))
    return scored.where(F.col(target) == 1).select(query, "rank", F.round("nll", 6).alias("nll"))


def stored_utility(rows: DataFrame, parent: str, rank: str, acceptable: str) -> DataFrame:
    """Checks until the first acceptable candidate, or all if none; unknown ones (null) aren't candidates."""
    known = rows.where(F.col(acceptable).isNotNull())
    first = F.min(F.when(F.col(acceptable), F.col(rank)))
    return known.groupBy(parent).agg(
        F.coalesce(first, F.count("*")).cast("long").alias("checks"), F.coalesce(first <= 1, F.lit(False)).alias("top_1"), F.coalesce(first <= 3, F.lit(False)).alias("top_3"), F.count_if(acceptable).alias("acceptable")
    )


def tier_metrics(rows: DataFrame, by: list[str], tiers: tuple[str, ...], strong: str, fast: str, truth: str, accept: float = 0.9) -> DataFrame:
    """Accuracy of the likeliest tier, of accepted ones alone, and how strong requests fare; Brier score and -log too."""
    p = F.array(*tiers)
    best = F.element_at(F.array(*map(F.lit, tiers)), F.array_position(p, F.array_max(p)).cast("int"))
    own = F.lit(0.0)
    for t in tiers:
        own = F.when(F.col(truth) == t, F.col(t)).otherwise(own)
    brier = sum(((F.col(t) - (F.col(truth) == t).cast("int")) ** 2 for t in tiers), F.lit(0.0))
    r = rows.select(*by, truth, best.alias("best"), F.array_max(p).alias("top"), own.alias("own"), brier.alias("brier"))
    right, taken, needs = F.col("best") == F.col(truth), F.col("top") >= accept, F.col(truth) == strong
    return r.groupBy(*by).agg(
        F.count("*").alias("rows"), F.round(F.count_if(right) / F.count("*"), 6).alias("accuracy"), F.round(F.try_divide(F.count_if(right & taken), F.count_if(taken)), 6).alias("accepted_precision"),
        F.round(F.count_if(taken) / F.count("*"), 6).alias("coverage"), F.round(F.try_divide(F.count_if(needs & right), F.count_if(needs)), 6).alias("strong_recall"),
        F.count_if(needs & (F.col("best") == fast)).alias("strong_as_fast"), F.round(F.avg(-F.log(F.greatest("own", F.lit(1e-12)))), 6).alias("nll"), F.round(F.avg("brier"), 6).alias("brier"),
    )
