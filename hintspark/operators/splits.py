"""Grouping rows that share a key, leakage-safe splits, and audits of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hintspark.plans.numbering import Ordered, numbered_within
from hintspark.plans.components import connected_components
from hintspark.plans.digests import with_sorted_digest
from hintspark.plans.shared import SharedTables


def seeded_order(*parts: Column | str) -> Column:
    """A hexadecimal digest that orders rows by chance, the same in every run."""
    return F.sha2(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def shared_key_components(rows: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """(row_id, component) for every row; component is the least row id reachable over equal keys.

    Rows hang on the least row of each key, so a key of n rows gives n - 1 edges. Keys that are null
    or empty join nothing, and keys of one row drop out before the rounds start.
    """
    keyed = rows.select(F.col(row_id).alias("row"), F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), k.cast("string").alias("key")) for n, k in keys.items()))).alias("k")).select("row", "k.kind", "k.key")
    keyed = keyed.where("key IS NOT NULL AND key <> ''")
    least = keyed.groupBy("kind", "key").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last")
    edges = keyed.join(least, ["kind", "key"]).select(F.col("row").alias("u"), F.col("first").alias("v"))
    found = connected_components(edges, SharedTables(rows.sparkSession, "components")).withColumnRenamed("node", "__row")
    return rows.join(found, F.col(row_id) == F.col("__row"), "left").select(row_id, F.coalesce("component", row_id).alias("component"))


def component_sizes(members: DataFrame, row_id: str) -> DataFrame:
    """component, size and representative (least id)."""
    return members.groupBy("component").agg(F.count("*").alias("size"), F.min(row_id).alias("representative"))


def component_report(members: DataFrame, row_id: str) -> DataFrame:
    """component, size, representative (least id) and signature, the digest of its sorted members' ids."""
    members = SharedTables(members.sparkSession, "members").keep(members.select("component", row_id))
    return with_sorted_digest(component_sizes(members, row_id), members, "component", F.col(row_id).cast("string"), "signature")


def size_histogram(report: DataFrame) -> DataFrame:
    return report.groupBy("size").agg(F.count("*").alias("components"), (F.count("*") * F.col("size")).alias("rows"))


def select_components(report: DataFrame, n: int) -> DataFrame:
    """The first n components by signature; a report of how many are missing is n - count."""
    return report.orderBy("signature", "component").limit(n)


def fill_splits(groups: DataFrame, stages: list[tuple[str, int]], rest: str, group: str, size: str, seed: str) -> DataFrame:
    """group, size, split: whole groups in a seeded order, each stage until it has its minimum of rows.

    A stage starts its sum anew with the groups that are left. There are a few stages. Groups are
    ordered once, in ranges; a stage adds the ranges' sums up.
    """
    ordered = Ordered(groups.select(group, size, seeded_order(seed, F.col(group)).alias("o")), ["o", group])
    left, filled = ordered.rows, None
    for name, minimum in stages:
        dealt = ordered.running({"upto": F.col(size)}, left).withColumn("taken", F.col("upto") - F.col(size) < minimum).drop("upto")
        part = dealt.where("taken").select(group, size, F.lit(name).alias("split"))
        filled = part if filled is None else filled.unionByName(part)
        left = dealt.where("NOT taken").drop("taken")
    return filled.unionByName(left.select(group, size, F.lit(rest).alias("split")))


def training_candidates(train: DataFrame, held: DataFrame, prior_repos: DataFrame, row_id: str, repo: str, keys: dict[str, Column]) -> DataFrame:
    """One representative of every component of training rows that touches no held-out row and no prior repository.

    train and held have the same columns and distinct ids. Columns: representative, siblings.
    """
    both = train.withColumn("__held", F.lit(False)).unionByName(held.withColumn("__held", F.lit(True)))
    members = shared_key_components(both, row_id, keys).join(both.select(row_id, repo, "__held"), row_id)
    known = prior_repos.select(F.col(repo).alias("__repo")).distinct().withColumn("__prior", F.lit(True))
    members = members.join(known, F.col(repo) == F.col("__repo"), "left")
    judged = members.groupBy("component").agg(F.bool_or(F.col("__held") | F.col("__prior").isNotNull()).alias("blocked"), F.min(row_id).alias("representative"), (F.count("*") - 1).alias("siblings"))
    return judged.where("NOT blocked").select("representative", "siblings")


def resolve_identity(rows: DataFrame, identities: DataFrame, name: str) -> DataFrame:
    """rows with canonical name and network; state tells missing and inconsistent identities.

    identities: (requested, canonical, network).
    """
    agreed = identities.groupBy("requested").agg(F.min("canonical").alias("canonical"), F.min("network").alias("network"), F.count_distinct(F.struct("canonical", "network")).alias("n"))
    joined = rows.join(agreed, F.col(name) == F.col("requested"), "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "inconsistent").otherwise("resolved")
    return joined.withColumn("state", state).drop("requested", "n")


def crossing_keys(assignments: DataFrame, role: str, keys: list[str]) -> DataFrame:
    """Keys that occur in more than one role, with their number of roles; no rows if all is well."""
    rows = assignments.select(role, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys))).alias("k")).select(role, "k.*")
    return rows.where("key IS NOT NULL").groupBy("kind", "key").agg(F.count_distinct(role).alias("roles")).where("roles > 1")


def largest_remainder(n: Column, shares: tuple[int, ...] = (3, 1, 1)) -> list[Column]:
    """How many of n each share gets: whole parts, then one each by remainder, earlier shares first on ties."""
    total = sum(shares)
    whole = [F.floor(n * s / total).cast("long") for s in shares]
    rest = [n * s % total for s in shares]
    left = n - sum(whole[1:], whole[0])
    out = []
    for i, w in enumerate(whole):
        ahead = sum(((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("long") for j in range(len(shares)) if j != i)
        out.append(w + F.when(ahead < left, 1).otherwise(0))
    return out


def assign_roles(components: DataFrame, component: str, known: Column, seed: str, roles: tuple[str, ...] = ("train", "validation", "final")) -> DataFrame:
    """component, role: known ones in a seeded order, cut at 3:1:1 by largest remainder; others are provenance only."""
    some = components.where(known).select(component, seeded_order(seed, F.col(component)).alias("o"))
    numbered = Ordered(some, ["o", component]).numbered().join(F.broadcast(some.agg(F.count("*").alias("n"))))  # one row
    first, second, _ = largest_remainder(F.col("n"))
    role = F.when(F.col("place") <= first, roles[0]).when(F.col("place") <= first + second, roles[1]).otherwise(roles[2])
    return numbered.select(component, role.alias("role")).unionByName(components.where(~known).select(component, F.lit("provenance").alias("role")))


def coverage_requirements(assignments: DataFrame, plan: DataFrame) -> DataFrame:
    """plan rows (key, role, minimum) with how many assigned components there are, and whether they suffice."""
    counts = assignments.groupBy("key", "role").agg(F.count("*").alias("have"))
    return plan.join(counts, ["key", "role"], "left").select("key", "role", "minimum", F.coalesce("have", F.lit(0)).alias("have"), (F.coalesce("have", F.lit(0)) >= F.col("minimum")).alias("met"))


def hash_split(group: Column, seed: str, parts: int = 5) -> Column:
    """dev for one part of the groups, train for the others."""
    return F.when(F.conv(F.substring(seeded_order(seed, group), 1, 8), 16, 10).cast("long") % parts == 0, "dev").otherwise("train")


def overlap_audit(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: rows, distinct and empty values on both sides, and values in common."""

    def side(frame: DataFrame, name: str) -> DataFrame:
        rows = frame.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("key")) for k in keys))).alias("k")).select("k.*")
        return rows.groupBy("kind", "key").agg(F.count("*").alias(name))

    both = side(a, "na").join(side(b, "nb"), ["kind", "key"], "full")
    has = lambda c: F.col(c).isNotNull()
    real = F.col("key") != ""
    return both.groupBy("kind").agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("a_rows"), F.coalesce(F.sum("nb"), F.lit(0)).alias("b_rows"), F.count_if(has("na") & real).alias("a_distinct"), F.count_if(has("nb") & real).alias("b_distinct"),
        F.coalesce(F.sum(F.when(~real, F.col("na"))), F.lit(0)).alias("a_empty"), F.coalesce(F.sum(F.when(~real, F.col("nb"))), F.lit(0)).alias("b_empty"), F.count_if(has("na") & has("nb") & real).alias("common"),
    )


def duplicate_audit(rows: DataFrame, key: Column, label: str) -> DataFrame:
    """Clusters of equal keys: how many, redundant rows, and clusters and pairs whose labels conflict.

    Pairs of different labels are counted from the label counts, n(n-1)/2 less those of each label.
    """
    counts = rows.groupBy(key.alias("k"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    clusters = counts.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"))
    more = F.col("n") > 1
    return clusters.agg(
        F.count_if(more).alias("clusters"), F.sum(F.when(more, F.col("n") - 1).otherwise(0)).alias("redundant"), F.count_if(F.col("labels") > 1).alias("conflicting"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("same")).cast("long").alias("conflicting_pairs"),
    )


def first_per_group(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first row of each group; a partial aggregate, so a large group doesn't move whole."""
    rest = [c for c in rows.columns if c != group]
    best = rows.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(group, "r.*")


def fair_order(rows: DataFrame, role: str, repository: str, row_id: str) -> DataFrame:
    """rows with place: roles take turns, and inside a role its repositories do."""
    turned = numbered_within(rows, [role, repository], [row_id], "__round")
    queued = numbered_within(turned, [role], ["__round", repository], "__queue")
    return Ordered(queued, ["__queue", role]).numbered().drop("__round", "__queue")


def balanced_draws(families: DataFrame, family: str, label: str, need: int, seed: str) -> DataFrame:
    """need draws per class over its families in a seeded order, starting again when they are used up."""
    ordered = families.select(family, label, (F.row_number().over(W.partitionBy(label).orderBy(seeded_order(seed, F.col(family)), family)) - 1).alias("place"))
    ordered = ordered.withColumn("n", F.count("*").over(W.partitionBy(label)))
    times = F.floor((F.lit(need - 1) - F.col("place")) / F.col("n")) + 1
    return ordered.where(F.col("place") < need).select(family, label, times.cast("long").alias("draws"))


def paired_check(rows: DataFrame, family: str, locale: str, same: list[str], locales: tuple[str, str]) -> DataFrame:
    """Families that aren't exactly one row of each locale with equal values of the same columns."""
    judged = rows.groupBy(family).agg(F.count("*").alias("rows"), F.sort_array(F.collect_set(locale)).alias("l"), *(F.count_distinct(c).alias(f"n_{c}") for c in same))
    good = (F.col("rows") == 2) & (F.col("l") == F.array(*map(F.lit, sorted(locales))))
    for c in same:
        good = good & (F.col(f"n_{c}") == 1)
    return judged.where(~good).select(family, "rows")


def manifest_difference(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows on one side alone, with repeats: side is extra or missing."""
    return rows.exceptAll(manifest).withColumn("side", F.lit("extra")).unionByName(manifest.exceptAll(rows).withColumn("side", F.lit("missing")))


def allocation_check(registry: DataFrame, recipe: DataFrame, keys: list[str]) -> DataFrame:
    """Strata whose count isn't the recipe's quota; either side may lack a stratum."""
    counts = registry.groupBy(*keys).agg(F.count("*").alias("have"))
    both = recipe.select(*keys, F.col("quota")).join(counts, keys, "full")
    return both.select(*keys, F.coalesce("quota", F.lit(0)).cast("long").alias("quota"), F.coalesce("have", F.lit(0)).alias("have")).where("quota <> have")


def dependency_problems(rows: DataFrame, row_id: str, split: str, dependencies: Column) -> DataFrame:
    """(row, dependency, problem) for dependencies that don't exist, are the row itself or lie in another split."""
    asked = rows.select(F.col(row_id).alias("row"), F.col(split).alias("own"), F.explode(dependencies).alias("dependency"))
    there = rows.select(F.col(row_id).alias("dependency"), F.col(split).alias("other"))
    problem = F.when(F.col("other").isNull(), "missing").when(F.col("row") == F.col("dependency"), "self").when(F.col("own") != F.col("other"), "other_split")
    return asked.join(there, "dependency", "left").select("row", "dependency", problem.alias("problem")).where("problem IS NOT NULL")


def review_holds(rows: DataFrame, row_id: str, holds: Column) -> DataFrame:
    return rows.select(row_id, F.explode(holds).alias("hold")).groupBy("hold").agg(F.count("*").alias("holds"), F.count_distinct(row_id).alias("rows"))
