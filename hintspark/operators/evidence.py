"""Joins of evidence to members, catalogs and reviews, and plans made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def coverage_join(members: DataFrame, labels: DataFrame, catalogs: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, role, repository, status) for every member; missing evidence never counts as matched.

    labels: (id, target), catalogs: (repository, available), entries: (repository, path).
    """
    known = entries.select(F.col("repository").alias("__r"), F.col("path").alias("__p")).distinct()
    joined = members.join(labels, "id", "left").join(catalogs, "repository", "left")
    joined = joined.join(known, (F.col("repository") == F.col("__r")) & (F.col("target") == F.col("__p")), "left")
    status = (
        F.when(F.col("target").isNull(), "root_unavailable").when(~F.coalesce("available", F.lit(False)), "catalog_unavailable").when(F.col("__p").isNull(), "unusable_target").otherwise("matched")
    )
    return joined.select("id", "role", "repository", status.alias("status"))


def coverage_totals(rows: DataFrame) -> DataFrame:
    """Members by status, over all and by role and repository."""
    sets = rows.groupingSets([[], [F.col("role"), F.col("repository")]], "role", "repository")
    names = ("root_unavailable", "catalog_unavailable", "unusable_target", "matched")
    return sets.agg(F.count("*").alias("members"), *(F.count_if(F.col("status") == n).alias(n) for n in names))


def match_catalog(targets: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """Per by: its targets (by, path) by the kind of the catalog entry (by, path, mode, type), missing ones too."""
    kind = (
        F.when(F.col("mode").isNull(), "missing").when(F.col("mode") == "120000", "symlink").when(F.col("type") == "commit", "submodule").when(F.col("type") == "tree", "directory").otherwise("regular")
    )
    joined = targets.join(entries, [by, "path"], "left").withColumn("kind", kind)
    return joined.groupBy(by).agg(F.count("*").alias("targets"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("regular", "symlink", "submodule", "directory", "missing")))


def seal_join(members: DataFrame, sources: DataFrame, costs: DataFrame, key: str) -> DataFrame:
    """key and problem for members that lack exactly one source and one cost row, and for rows without a member."""

    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(key).agg(F.count("*").alias(name))

    all_ = counted(members, "m").join(counted(sources, "s"), key, "full").join(counted(costs, "c"), key, "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    problem = (
        F.when(n("m") == 0, "no_member").when(n("m") > 1, "member_repeated").when(n("s") != 1, F.when(n("s") == 0, "source_missing").otherwise("source_repeated")).when(n("c") != 1, F.when(n("c") == 0, "cost_missing").otherwise("cost_repeated"))
    )
    return all_.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def inventory_compact(references: DataFrame, key: list[str], size: str) -> DataFrame:
    """Distinct references with how often they occur."""
    return references.groupBy(*key).agg(F.count("*").alias("references"), F.max(size).alias("bytes"))


def root_coverage(observations: DataFrame, repository: str, available: Column, candidate: Column) -> DataFrame:
    """Snapshots, available, candidate and missing ones per repository and in total."""
    rows = observations.select(repository, available.alias("a"), candidate.alias("c"))
    return rows.rollup(repository).agg(F.count("*").alias("snapshots"), F.count_if("a").alias("available"), F.count_if(F.col("a") & F.col("c")).alias("candidate"), F.count_if(~F.col("a")).alias("missing"))


def supervision_mask(candidates: DataFrame, reviews: DataFrame, key: str, needed: int = 2) -> DataFrame:
    """key, eligible and the reasons against: unknown label, too few or inconsistent reviews, a label that reviews don't share.

    reviews: (key, verdict); verdicts and labels are 0 or 1, null means unknown and stays unknown.
    """
    judged = reviews.groupBy(key).agg(F.count("verdict").alias("n"), F.count_distinct("verdict").alias("kinds"), F.max("verdict").alias("verdict"))
    joined = candidates.join(judged, key, "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("label").isNull(), "label_unknown"), F.when(F.coalesce("n", F.lit(0)) < needed, "reviews_missing"), F.when(F.col("kinds") > 1, "reviews_inconsistent"),
            F.when((F.col("kinds") == 1) & F.col("label").isNotNull() & (F.col("verdict") != F.col("label")), "label_disputed"),
        )
    )
    return joined.select(key, (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


def cohort_class(rows: DataFrame, parent: str, state: str) -> DataFrame:
    """ambiguous, unknown_containing, known_none, one, many or all, from a parent's candidate states T, F and U (null: ambiguous)."""
    n = lambda v: F.count_if(F.col(state) == v)
    counted = rows.groupBy(parent).agg(F.count("*").alias("n"), n("T").alias("t"), n("U").alias("u"), F.count_if(F.col(state).isNull()).alias("x"))
    kind = (
        F.when(F.col("x") > 0, "ambiguous").when(F.col("u") > 0, "unknown_containing").when(F.col("t") == 0, "known_none").when(F.col("t") == F.col("n"), "all").when(F.col("t") == 1, "one").otherwise("many")
    )
    return counted.select(parent, F.col("n").alias("candidates"), kind.alias("class"))


def project_cohort(rows: DataFrame, parent: str, state: str, role: str) -> DataFrame:
    """Learning rows: those of parents without unknown or ambiguous states and outside calibration, weighed 1 / candidates."""
    classes = cohort_class(rows, parent, state).where("class NOT IN ('ambiguous', 'unknown_containing')")
    kept = rows.where(F.col(role) != "calibration").join(classes, parent)
    return kept.select(*rows.columns, (F.col(state) == "T").cast("int").alias("label"), F.round(1 / F.col("candidates"), 6).alias("weight"))


def observations_vs_expected(observed: DataFrame, expected: DataFrame, parent: str, keys: list[str]) -> DataFrame:
    """Per (keys): whether every expected literal was observed; a parent is answerable if any is."""
    joined = expected.join(observed.select(*keys, F.col("literal").alias("seen")), keys, "left")
    matched = joined.groupBy(parent, *keys).agg(F.bool_and(F.coalesce(F.col("literal") == F.col("seen"), F.lit(False))).alias("matches"))
    return matched.groupBy(parent).agg(F.count("*").alias("candidates"), F.count_if("matches").alias("matching"), F.when(F.bool_or("matches"), "answerable").otherwise("no_answer").alias("answer"))


def reference_problems(references: DataFrame, objects: DataFrame) -> DataFrame:
    """References (path, digest) to objects (path, digest) that don't exist or differ, and paths with two digests."""
    agreed = objects.groupBy("path").agg(F.min("digest").alias("there"), F.count_distinct("digest").alias("n"))
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("n") > 1, "two_digests").when(F.col("digest") != F.col("there"), "differs")
    return references.join(agreed, "path", "left").select("path", "digest", problem.alias("problem")).where("problem IS NOT NULL")


def anchor_compare(expected: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """matched, stale with the first changed field, or unavailable."""
    now = current.select(key, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__there"))
    joined = expected.join(now, key, "left")
    changed = F.lit(None).cast("string")
    for f in reversed(fields):
        changed = F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f).otherwise(changed)
    state = F.when(F.col("__there").isNull(), "unavailable").when(changed.isNotNull(), "stale").otherwise("matched")
    return joined.select(key, state.alias("state"), F.when(F.col("__there").isNotNull(), changed).alias("field"))


def resolve_bindings(bindings: DataFrame, labels: DataFrame) -> DataFrame:
    """intent, ref and issue for bindings (intent, ref) to labels (ref, is_group, active); usable ones have no issue."""
    per_intent = bindings.groupBy("intent").agg(F.count("*").alias("per_intent"))
    per_ref = bindings.groupBy("ref").agg(F.count("*").alias("per_ref"))
    joined = bindings.join(per_intent, "intent").join(per_ref, "ref").join(labels, "ref", "left")
    issue = (
        F.when(F.col("per_intent") > 1, "duplicate_intent").when(F.col("per_ref") > 1, "duplicate_ref").when(F.col("active").isNull(), "missing").when(F.col("is_group"), "group_container").when(~F.col("active"), "inactive")
    )
    return joined.select("intent", "ref", issue.alias("issue"))


def propose_annotations(predictions: DataFrame, works: DataFrame, bindings: DataFrame, confidence: float = 0.9, margin: float = 0.05) -> DataFrame:
    """work, reason, new_labels: proposals of confident learned predictions, less the labels that are there already.

    predictions: (work, intent, confidence, margin, source), works: (work, labels), bindings: (intent, ref).
    """
    refs = bindings.groupBy("intent").agg(F.sort_array(F.collect_set("ref")).alias("refs"))
    joined = predictions.join(works, "work").join(refs, "intent", "left")
    reason = (
        F.when(F.col("source") != "learned", "not_learned").when(F.col("intent") == "unclear", "unclear").when(F.col("confidence") < confidence, "confidence").when(F.col("margin") < margin, "margin").when(F.col("refs").isNull(), "unbound")
    )
    new = F.array_except("refs", "labels")
    reason = reason.when(F.size(new) == 0, "no_change").otherwise("proposed")
    return joined.select("work", reason.alias("reason"), F.when(reason == "proposed", new).otherwise(F.array().cast("array<string>")).alias("new_labels"))


def plan_state(works: DataFrame, events: DataFrame, terminal: tuple[str, ...], next_state: dict[str, str]) -> DataFrame:
    """work, state, reason: the next state only from one kind of trusted event at the expected version."""
    seen = events.where("trusted").join(works.select("work", "version"), ["work", "version"]).groupBy("work").agg(F.count_distinct("kind").alias("kinds"), F.min("kind").alias("kind"))
    joined = works.join(seen, "work", "left")
    to = F.lit(None).cast("string")
    for kind, state in next_state.items():
        to = F.when(F.col("kind") == kind, state).otherwise(to)
    reason = (
        F.when(F.col("state").isin(*terminal), "terminal").when(F.col("kinds").isNull(), "no_event").when(F.col("kinds") > 1, "conflict").when(to.isNull(), "unknown_event").otherwise("moved")
    )
    return joined.select("work", F.when(reason == "moved", to).otherwise(F.col("state")).alias("state"), reason.alias("reason"))


def select_model(requests: DataFrame, models: DataFrame, usage: DataFrame, floors: list[float], least_confidence: float = 0.7, load_penalty: float = 0.1) -> DataFrame:
    """request, model (null if none is eligible), cost: the cheapest eligible model, then the better one, then by name.

    The catalog of models is small by nature and stands as one array in every request's row, so
    requests don't move. A null price is unknown, not free. models: (id, quality, context, tools, local,
    price_in, price_out, budget), usage: (id, spent, in_flight), requests: (request, tier, confidence,
    uncertain, input_tokens, output_tokens, tools, local_only).
    """
    known = models.join(usage, "id", "left")
    catalog = known.agg(F.sort_array(F.collect_list(F.struct(*(F.col(c) for c in known.columns)))).alias("models"))
    rows = requests.join(F.broadcast(catalog))
    floor = F.element_at(F.array(*map(F.lit, floors)), F.when(F.col("uncertain") | (F.col("confidence") < least_confidence), len(floors)).otherwise(F.col("tier") + 1).cast("int"))

    def candidate(m: Column) -> Column:
        cost = (F.col("input_tokens") * m["price_in"] + F.col("output_tokens") * m["price_out"]) / 1e6
        bad = (
            (m["quality"] < floor) | (F.col("input_tokens") + F.col("output_tokens") > m["context"]) | (F.col("tools") & ~m["tools"]) | (F.col("local_only") & ~m["local"]) | m["price_in"].isNull()
            | (m["budget"].isNotNull() & (m["spent"].isNull() | (m["spent"] + cost > m["budget"])))
        )
        effective = F.round(cost * (1 + load_penalty * F.coalesce(m["in_flight"], F.lit(0))), 9)
        return F.when(~bad, F.struct(effective.alias("cost"), (-m["quality"]).alias("worse"), m["id"].alias("id")))

    best = F.array_min(F.array_compact(F.transform("models", candidate)))
    return rows.select("request", best["id"].alias("model"), F.round(best["cost"], 6).alias("cost"))


def switch_decision(rows: DataFrame, upgrade: float = 0.7, downgrade: float = 0.9, cooldown: int = 3, most_payback: float = 10.0) -> DataFrame:
    """request, action, reason. rows: (request, pinned, current, target, current_rank, target_rank, confidence, since,
    context_tokens, output_tokens, and price_out, cache_read of both sides, target_in, target_cache_write).

    Payback is the premium of filling the target's cache over the savings of a request.
    """
    c = F.col
    premium = c("context_tokens") * F.greatest(F.lit(0.0), F.greatest("target_in", "target_cache_write") - c("target_cache_read"))
    saving = c("context_tokens") * (c("current_cache_read") - c("target_cache_read")) + c("output_tokens") * (c("current_out") - c("target_out"))
    known = c("current_cache_read").isNotNull() & c("target_cache_read").isNotNull() & c("target_cache_write").isNotNull() & (saving > 0)
    reason = (
        F.when(c("pinned"), "manual_pin").when(c("current").isNull(), F.when(c("context_tokens") != 0, "current_model_unknown").when(c("confidence") < downgrade, "entry_confidence").otherwise("new_session"))
        .when(c("current") == c("target"), "already_selected")
        .when(c("target_rank") > c("current_rank"), F.when(c("confidence") < upgrade, "upgrade_confidence").otherwise("quality_upgrade"))
        .when(c("confidence") < downgrade, "downgrade_confidence").when(c("since").isNull(), "switch_history_unknown").when(c("since") < cooldown, "cooldown")
        .when(~F.coalesce(known, F.lit(False)), "prices_unknown_or_no_savings").when(premium / saving <= most_payback, "cache_payback_acceptable").otherwise("cache_payback_too_long")
    )
    action = F.when(reason.isin("new_session", "quality_upgrade", "cache_payback_acceptable"), "recommend").otherwise("hold")
    return rows.select("request", action.alias("action"), reason.alias("reason"))


def route_tier(probabilities: Column, tiers: tuple[str, ...], guarded: Column, least: float = 0.6) -> Column:
    """The likeliest tier, or the last, the strongest, if a guard holds or no tier is likely enough."""
    top = F.array_max(probabilities)
    best = F.element_at(F.array(*map(F.lit, tiers)), F.array_position(probabilities, top).cast("int"))
    return F.when(guarded | (top < least), tiers[-1]).otherwise(best)
