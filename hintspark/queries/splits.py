"""Queries of the grouping, splitting and audit operators; a source plays a repository, a language a locale."""

# ruff: noqa: E731
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hintspark.functions import text as X
from hintspark.operators import splits as S
from hintspark.operators.star import family_graph_check, family_graph_counts
from hintspark.plans.digests import with_sorted_digest
from hintspark.queries import table
from hintspark.queries.text import collapse_sql

QUERIES: dict = {}
SET_DIGEST_SQL = "sha256(concat_ws(':', count(doc_id), " + ", ".join(f"sum(('0x' || substr(sha256(doc_id::VARCHAR), {8 * i + 1}, 8))::BIGINT)" for i in range(8)) + "))"
_KEY = lambda: X.normalize_query(F.substring("text", 1, 40))
_KEY_SQL = collapse_sql("lower(substr(text, 1, 40))")
_LAST = lambda: X.collapse(F.substring(F.col("text"), -30, 30))
_LAST_SQL = collapse_sql("text[-30:]")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share their start or their end."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", _KEY().alias("start"), _LAST().alias("last"))
    return S.shared_key_components(docs, "doc_id", {"start": F.col("start"), "end": F.col("last")})


_COMPONENTS = f"""RECURSIVE k AS (SELECT doc_id, source, {_KEY_SQL} AS start, {_LAST_SQL} AS last FROM documents),
    keyed AS (SELECT doc_id, 's' || start AS key FROM k WHERE start <> '' UNION ALL SELECT doc_id, 'e' || last FROM k WHERE last <> ''),
    star AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS first FROM keyed),
    edges AS (SELECT doc_id AS a, first AS b FROM star UNION SELECT first, doc_id FROM star),
    reach AS (SELECT doc_id, doc_id AS r FROM k UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
    members AS (SELECT doc_id, min(r) AS component FROM reach GROUP BY doc_id)"""
_REPORT = "report AS (SELECT component, count(*) AS size, min(doc_id) AS representative, " + SET_DIGEST_SQL + " AS signature FROM members GROUP BY component)"
_LIST_DIGEST_SQL = "sha256(string_agg(strlen(doc_id::VARCHAR) || ':' || doc_id || chr(10), '' ORDER BY doc_id::VARCHAR))"
_SIGNED = "report AS (SELECT component, count(*) AS size, min(doc_id) AS representative, " + _LIST_DIGEST_SQL + " AS signature FROM members GROUP BY component)"
QUERIES["g1_components"] = (_members, f"WITH {_COMPONENTS} SELECT * FROM members")
_report = lambda s, d: S.component_report(_members(s, d), "doc_id")
QUERIES["g2_component_report"] = (_report, f"WITH {_COMPONENTS}, {_SIGNED} SELECT * FROM report")
QUERIES["g2_size_histogram"] = (lambda s, d: S.size_histogram(S.component_sizes(_members(s, d), "doc_id")), f"WITH {_COMPONENTS}, {_REPORT} SELECT size, count(*) AS components, count(*) * size AS rows FROM report GROUP BY size")
QUERIES["g3_select_components"] = (lambda s, d: S.select_components(_report(s, d), 25), f"WITH {_COMPONENTS}, {_SIGNED} SELECT * FROM report ORDER BY signature, component LIMIT 25")
_GROUPS = "(SELECT source, lang, source || lang AS grp, count(*) AS size FROM documents GROUP BY ALL)"


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("size")).withColumn("grp", F.concat("source", "lang"))


QUERIES["g4_fill_splits"] = (
    lambda s, d: S.fill_splits(_groups(s, d), [("final", 100), ("validation", 60), ("calibration", 40)], "development", "grp", "size", "split"),
    f"""WITH g AS (SELECT grp, size, sha256('split:' || grp) AS o FROM {_GROUPS}),
    a AS (SELECT *, coalesce(sum(size) OVER (ORDER BY o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM g),
    b AS (SELECT grp, size, o, coalesce(sum(size) OVER (ORDER BY o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM a WHERE s >= 100),
    c AS (SELECT grp, size, o, coalesce(sum(size) OVER (ORDER BY o, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b WHERE s >= 60)
    SELECT grp, size, 'final' AS split FROM a WHERE s < 100 UNION ALL SELECT grp, size, 'validation' FROM b WHERE s < 60 UNION ALL SELECT grp, size, CASE WHEN s < 40 THEN 'calibration' ELSE 'development' END FROM c""",
)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "source", _KEY().alias("start"), _LAST().alias("last"))
    prior = _docs(spark, sf_dir).where("source = 'src3'").select("source").distinct()
    return S.training_candidates(docs.where("doc_id % 20 <> 0"), docs.where("doc_id % 20 = 0"), prior, "doc_id", "source", {"start": F.col("start"), "end": F.col("last")})


QUERIES["g5_training_candidates"] = (
    _candidates,
    f"WITH {_COMPONENTS} SELECT min(doc_id) AS representative, count(*) - 1 AS siblings FROM members JOIN k USING (doc_id) GROUP BY component HAVING NOT bool_or(doc_id % 20 = 0 OR source = 'src3')",
)
_IDENTITIES = "(SELECT DISTINCT c_name AS requested, lower(c_name) AS canonical, c_nationkey % 5 AS network FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_name, 'other', -1 FROM customer WHERE c_custkey % 50 = 1)"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    identities = c.where("c_custkey % 7 <> 0").select(F.col("c_name").alias("requested"), F.lower("c_name").alias("canonical"), (F.col("c_nationkey") % 5).alias("network")).distinct()
    identities = identities.unionByName(c.where("c_custkey % 50 = 1").select(F.col("c_name").alias("requested"), F.lit("other").alias("canonical"), F.lit(-1).alias("network")))
    return S.resolve_identity(c.select("c_custkey", "c_name"), identities, "c_name")


QUERIES["g8_resolve_identity"] = (
    _resolved,
    f"""WITH i AS (SELECT requested, min(canonical) AS canonical, min(network) AS network, count(DISTINCT canonical || network) AS n FROM {_IDENTITIES} GROUP BY requested)
    SELECT c_custkey, c_name, canonical, network, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'inconsistent' ELSE 'resolved' END AS state FROM customer LEFT JOIN i ON c_name = requested""",
)


def _roles_of_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources joined by shared starts are a unit; whole units fill the roles."""
    docs = _docs(spark, sf_dir).select("doc_id", F.substring("source", 4, 9).cast("long").alias("repo"), _KEY().alias("start"))
    repos = docs.select("repo").distinct()
    firsts = docs.where("start <> ''").groupBy("start").agg(F.min("repo").alias("first"))
    linked = docs.join(firsts, "start").where("repo <> first").select(F.col("repo").alias("u"), F.col("first").alias("v"))
    from hintspark.plans.components import connected_components

    units = repos.join(connected_components(linked).withColumnRenamed("node", "repo"), "repo", "left").select("repo", F.coalesce("component", "repo").alias("unit"))
    sizes = docs.join(units, "repo").groupBy("unit").agg(F.count("*").alias("size"))
    return S.fill_splits(sizes, [("final", 100), ("validation", 100)], "train", "unit", "size", "role")


QUERIES["g6_partition_roles"] = (
    _roles_of_units,
    f"""WITH RECURSIVE k AS (SELECT doc_id, substr(source, 4)::BIGINT AS repo, {_KEY_SQL} AS start FROM documents),
    star AS (SELECT repo, min(repo) OVER (PARTITION BY start) AS first FROM k WHERE start <> ''),
    edges AS (SELECT repo AS a, first AS b FROM star UNION SELECT first, repo FROM star),
    reach AS (SELECT DISTINCT repo, repo AS r FROM k UNION SELECT reach.repo, edges.b FROM reach JOIN edges ON reach.r = edges.a),
    u AS (SELECT repo, min(r) AS unit FROM reach GROUP BY repo), g AS (SELECT unit, count(*) AS size, sha256('role:' || unit) AS o FROM k JOIN u USING (repo) GROUP BY unit),
    a AS (SELECT *, coalesce(sum(size) OVER (ORDER BY o, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM g),
    b AS (SELECT unit, size, o, coalesce(sum(size) OVER (ORDER BY o, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM a WHERE s >= 100)
    SELECT unit, size, 'final' AS split FROM a WHERE s < 100 UNION ALL SELECT unit, size, CASE WHEN s < 100 THEN 'validation' ELSE 'train' END FROM b""",
)


def _crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(S.hash_split(F.col("doc_id"), "dev").alias("role"), "source", _KEY().alias("start"))
    return S.crossing_keys(rows, "role", ["source", "start"])


_SPLIT_SQL = "CASE WHEN CAST('0x' || substr(sha256('dev:' || doc_id), 1, 8) AS BIGINT) % 5 = 0 THEN 'dev' ELSE 'train' END"
QUERIES["g7_verify_roles"] = (
    _crossing,
    f"""WITH r AS (SELECT {_SPLIT_SQL} AS role, source, {_KEY_SQL} AS start FROM documents),
    x AS (SELECT role, 'source' AS kind, source AS key FROM r UNION ALL SELECT role, 'start', start FROM r) SELECT kind, key, count(DISTINCT role) AS roles FROM x WHERE key IS NOT NULL GROUP BY ALL HAVING roles > 1""",
)
QUERIES["g9_assign_roles"] = (
    lambda s, d: S.assign_roles(_docs(s, d).select("doc_id", "lang"), "doc_id", F.col("lang") != "es", "seed"),
    """WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('seed:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM documents WHERE lang <> 'es'),
    c AS (SELECT *, n * 3 // 5 + CASE WHEN (n * 3 % 5 >= n % 5)::INT = 1 AND n - n * 3 // 5 - 2 * (n // 5) >= 1 THEN 1 WHEN n - n * 3 // 5 - 2 * (n // 5) >= 3 THEN 1 ELSE 0 END AS first FROM k),
    e AS (SELECT *, CASE WHEN n - first > 0 THEN n // 5 + CASE WHEN n - first - 2 * (n // 5) >= 1 THEN 1 ELSE 0 END ELSE 0 END AS second FROM c)
    SELECT doc_id, CASE WHEN place <= first THEN 'train' WHEN place <= first + second THEN 'validation' ELSE 'final' END AS role FROM e UNION ALL SELECT doc_id, 'provenance' FROM documents WHERE lang = 'es'""",
)


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("source").alias("key"), S.hash_split(F.col("doc_id"), "dev").alias("role"))
    plan = rows.select("key").distinct().select("key", F.explode(F.array(F.struct(F.lit("dev").alias("role"), F.lit(9).alias("minimum")), F.struct(F.lit("train").alias("role"), F.lit(40).alias("minimum")))).alias("p")).select("key", "p.*")
    return S.coverage_requirements(rows, plan)


QUERIES["g10_coverage_requirements"] = (
    _coverage,
    f"""WITH r AS (SELECT source AS key, {_SPLIT_SQL} AS role FROM documents), c AS (SELECT key, role, count(*) AS have FROM r GROUP BY ALL),
    p AS (SELECT DISTINCT source AS key, x.role, x.minimum FROM documents, (VALUES ('dev', 9), ('train', 40)) x(role, minimum))
    SELECT key, role, minimum, coalesce(have, 0) AS have, coalesce(have, 0) >= minimum AS met FROM p LEFT JOIN c USING (key, role)""",
)


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("source", "doc_id")
    counted = docs.groupBy("source").agg(F.count("*").alias("members"))
    return with_sorted_digest(counted, docs, "source", F.col("doc_id").cast("string"), "digest").select("source", "digest", "members")


QUERIES["g11_membership_digest"] = (
    _membership,
    f"SELECT source, {_LIST_DIGEST_SQL} AS digest, count(*) AS members FROM documents GROUP BY source",
)
QUERIES["g12_hash_split"] = (lambda s, d: _docs(s, d).select("doc_id", S.hash_split(F.col("doc_id"), "dev").alias("split")), f"SELECT doc_id, {_SPLIT_SQL} AS split FROM documents")
QUERIES["g13_assert_disjoint"] = (
    lambda s, d: _docs(s, d).where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("digest")).intersect(_docs(s, d).where("doc_id % 2 = 1").select(F.sha2("text", 256).alias("digest"))),
    "SELECT sha256(text) AS digest FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1",
)


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.when(F.col("n_chars") % 50 == 0, "").otherwise(_KEY()).alias("start"))
    return S.overlap_audit(rows.where("doc_id % 4 = 0"), rows.where("doc_id % 4 <> 0"), ["source", "start"])


QUERIES["g14_overlap_audit"] = (
    _overlap,
    f"""WITH r AS (SELECT doc_id % 4 = 0 AS a, unnest(['source', 'start']) AS kind, unnest([source, CASE WHEN n_chars % 50 = 0 THEN '' ELSE {_KEY_SQL} END]) AS key FROM documents),
    k AS (SELECT kind, key, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM r GROUP BY ALL)
    SELECT kind, sum(na)::BIGINT AS a_rows, sum(nb)::BIGINT AS b_rows, count(*) FILTER (na > 0 AND key <> '') AS a_distinct, count(*) FILTER (nb > 0 AND key <> '') AS b_distinct,
      coalesce(sum(na) FILTER (key = ''), 0)::BIGINT AS a_empty, coalesce(sum(nb) FILTER (key = ''), 0)::BIGINT AS b_empty, count(*) FILTER (na > 0 AND nb > 0 AND key <> '') AS common FROM k GROUP BY kind""",
)


def _cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _members(spark, sf_dir).withColumn("split", S.hash_split(F.col("doc_id"), "dev"))
    return rows.groupBy("component").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("rows")).where("splits > 1").agg(F.count("*").alias("components"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


QUERIES["g15_cross_split_groups"] = (
    _cross_split,
    f"WITH {_COMPONENTS}, s AS (SELECT component, {_SPLIT_SQL} AS split FROM members), c AS (SELECT component, count(DISTINCT split) AS n, count(*) AS rows FROM s GROUP BY component) SELECT count(*) AS components, coalesce(sum(rows), 0)::BIGINT AS rows FROM c WHERE n > 1",
)
QUERIES["g16_duplicate_audit"] = (
    lambda s, d: S.duplicate_audit(_docs(s, d), _KEY(), "source"),
    f"""WITH c AS (SELECT {_KEY_SQL} AS k, source, count(*) AS n FROM documents GROUP BY ALL), g AS (SELECT k, sum(n) AS n, count(*) AS labels, sum(n * (n - 1) / 2) AS same FROM c GROUP BY k)
    SELECT count(*) FILTER (n > 1) AS clusters, sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END)::BIGINT AS redundant, count(*) FILTER (labels > 1) AS conflicting, sum(n * (n - 1) / 2 - same)::BIGINT AS conflicting_pairs FROM g""",
)
QUERIES["g17_first_per_group"] = (
    lambda s, d: S.first_per_group(_docs(s, d).select("source", "lang", "doc_id", "n_chars"), "source", ["lang", "doc_id"]),
    "SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) = 1",
)
QUERIES["g18_fair_order"] = (
    lambda s, d: S.fair_order(_docs(s, d).select("lang", "source", "doc_id"), "lang", "source", "doc_id"),
    """WITH a AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r, source) AS q FROM a)
    SELECT lang, source, doc_id, row_number() OVER (ORDER BY q, lang) AS place FROM b""",
)
QUERIES["g19_balanced_draws"] = (
    lambda s, d: S.balanced_draws(_docs(s, d).select("doc_id", "lang"), "doc_id", "lang", 300, "draw"),
    """WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('draw:' || doc_id), doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang, ((299 - place) // n + 1)::BIGINT AS draws FROM o WHERE place < 300""",
)
QUERIES["g20_paired_check"] = (
    lambda s, d: S.paired_check(_docs(s, d).select(F.floor(F.col("doc_id") / 2).alias("family"), "lang", "source"), "family", "lang", ["source"], ("de", "en")),
    "SELECT doc_id // 2 AS family, count(*) AS rows FROM documents GROUP BY 1 HAVING NOT coalesce(count(*) = 2 AND list_sort(list(DISTINCT lang)) = ['de', 'en'] AND count(DISTINCT source) = 1, false)",
)
QUERIES["g21_lineage_leaks"] = (
    lambda s, d: S.crossing_keys(_docs(s, d).select(F.floor(F.col("doc_id") / 6).alias("lineage"), (F.floor(F.col("doc_id") / 9) % 2).alias("partition")), "partition", ["lineage"]),
    "SELECT 'lineage' AS kind, (doc_id // 6)::VARCHAR AS key, count(DISTINCT doc_id // 9 % 2) AS roles FROM documents GROUP BY 2 HAVING roles > 1",
)
QUERIES["g21_match_manifest"] = (
    lambda s, d: S.manifest_difference(_docs(s, d).select("source", "lang"), _docs(s, d).where("doc_id % 3 <> 0").select("source", F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang")).alias("lang"))),
    """WITH r AS (SELECT source, lang FROM documents), m AS (SELECT source, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 3 <> 0)
    SELECT *, 'extra' AS side FROM (FROM r EXCEPT ALL FROM m) UNION ALL SELECT *, 'missing' FROM (FROM m EXCEPT ALL FROM r)""",
)


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages of six: rows, and supports of each label by language."""
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", F.explode(F.array(*(F.struct(F.lit(h).alias("head"), F.col(h).alias("state")) for h in ("quality", "toxic")))).alias("h"), "doc_id")
    state = F.when(F.col("h.state") == 1, "true").when(F.col("h.state") == 0, "false").otherwise("unknown")
    return rows.groupBy("lang", F.col("h.head").alias("head"), state.alias("state")).agg(F.count("*").alias("rows"), F.count_distinct(F.floor(F.col("doc_id") / 2)).alias("families"), F.count_distinct(F.floor(F.col("doc_id") / 6)).alias("lineages"))


QUERIES["g22_group_shapes"] = (
    _shapes,
    """SELECT lang, head, CASE state WHEN 1 THEN 'true' WHEN 0 THEN 'false' ELSE 'unknown' END AS state, count(*) AS rows, count(DISTINCT doc_id // 2) AS families, count(DISTINCT doc_id // 6) AS lineages
    FROM (SELECT lang, doc_id, unnest(['quality', 'toxic']) AS head, unnest([quality, toxic]) AS state FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL""",
)


def _allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    recipe = groups.where("source <> 'src5'").select("source", "lang", F.when(F.col("size") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("quota"))
    return S.allocation_check(_docs(spark, sf_dir), recipe, ["source", "lang"])


QUERIES["g23_allocation_check"] = (
    _allocation,
    f"""SELECT source, lang, CASE WHEN source = 'src5' THEN 0 WHEN size % 3 = 0 THEN size + 1 ELSE size END AS quota, size AS have FROM {_GROUPS} WHERE source = 'src5' OR size % 3 = 0""",
)


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", "lang", F.array(F.col("doc_id") + 1, (F.col("doc_id") / 2).cast("long")).alias("needs"))
    return S.dependency_problems(rows, "doc_id", "lang", F.col("needs"))


QUERIES["g24_dependencies"] = (
    _dependencies,
    """WITH a AS (SELECT doc_id AS row, lang AS own, unnest([doc_id + 1, doc_id // 2]) AS dependency FROM documents), j AS (SELECT a.*, d.lang AS other FROM a LEFT JOIN documents d ON d.doc_id = dependency)
    SELECT row, dependency, CASE WHEN other IS NULL THEN 'missing' WHEN row = dependency THEN 'self' ELSE 'other_split' END AS problem FROM j WHERE other IS NULL OR row = dependency OR own <> other""",
)
_HOLDS = lambda: F.array_compact(F.array(F.when(F.col("n_chars") > 3000, "long"), F.when(F.col("lang") != "en", "language"), F.when(F.col("text").rlike("[0-9]"), "digits")))
QUERIES["g27_review_holds"] = (
    lambda s, d: S.review_holds(_docs(s, d), "doc_id", _HOLDS()),
    """WITH h AS (SELECT doc_id, unnest([CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END]) AS hold FROM documents)
    SELECT hold, count(*) AS holds, count(DISTINCT doc_id) AS rows FROM h WHERE hold IS NOT NULL GROUP BY hold""",
)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals without gaps, and name lengths, of the parts of each brand."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.length("p_name").alias("size"))
    return parts.groupBy("p_brand").agg(
        F.count("*").alias("parts"), (F.count_distinct("p_partkey") == F.max("p_partkey") - F.min("p_partkey") + 1).alias("gapless"), F.min("size").alias("shortest"), F.round(F.percentile("size", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("size", F.lit(0.9)), 6).alias("p90"), F.max("size").alias("longest")
    )


QUERIES["g26_registry_audit"] = (
    _registry,
    """SELECT p_brand, count(*) AS parts, count(DISTINCT p_partkey) = max(p_partkey) - min(p_partkey) + 1 AS gapless, min(length(p_name))::INT AS shortest, round(quantile_cont(length(p_name), 0.5), 6) AS median, round(quantile_cont(length(p_name), 0.9), 6) AS p90, max(length(p_name))::INT AS longest FROM part GROUP BY p_brand""",
)


def _star(spark: SparkSession, sf_dir: str):
    """Documents are comments, two a family; three families a source. Some break a rule."""
    d = F.col("doc_id")
    pin = lambda kind, n, odd=F.lit(False): F.struct(F.concat(F.lit(f"{kind}/"), n.cast("string")).alias("path"), F.sha2(F.concat(F.lit(f"{kind}:"), n.cast("string"), F.when(odd, "!").otherwise("")), 256).alias("sha256"), (n % 50 + 1).alias("bytes"))
    fam = F.floor(d / 2)
    src = F.floor(fam / 3)
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    comments = docs.select(
        F.concat(F.lit("c"), (d - F.when(d % 59 == 0, 1).otherwise(0)).cast("string")).alias("id"), fam.alias("family_id"), (src + F.when(d % 61 == 0, 1).otherwise(0)).alias("source_id"), pin("source", src).alias("source"),
        pin("frame", fam, d % 97 == 0).alias("frame"), F.when(d % 71 == 0, "fr").when(d % 2 == 0, "ko").otherwise("en").alias("locale"), F.when(d % 83 == 0, " ").otherwise(F.col("text")).alias("text"),
    )
    n = F.col("n")
    families = docs.select(fam.alias("n")).distinct().select(n.alias("id"), (F.floor(n / 3) + F.when(n % 101 == 0, 1_000_000_000).otherwise(0)).alias("source_id"), pin("frame", n).alias("frame"), pin("schema", F.lit(1) + F.when(n % 89 == 0, 1).otherwise(0)).alias("frame_schema"))
    sources = docs.select(src.alias("n")).distinct().select(
        n.alias("id"), F.element_at(F.array(*map(F.lit, ("train", "dev", "test", "other"))), F.when(n % 31 == 0, 4).otherwise((n % 3 + 1)).cast("int")).alias("split"), F.when(n % 3 == 1, "plain").when(n % 43 == 0, "odd").otherwise("").alias("dev_style"),
        pin("source", n).alias("source"), pin("review", n, n % 47 == 0).alias("review"),
    )
    return sources, families, comments, pin("schema", F.lit(1))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, families, comments, schema = _star(spark, sf_dir)
    return family_graph_check(sources, families, comments, schema, styles=("plain",))


_STAR_SQL = """d AS (SELECT *, doc_id // 2 AS fam, doc_id // 6 AS src FROM documents WHERE doc_id IS NOT NULL),
    c AS (SELECT 'c' || (doc_id - (doc_id % 59 = 0)::INT) AS id, fam, src + (doc_id % 61 = 0)::INT AS sid, src, doc_id % 97 = 0 AS odd, CASE WHEN doc_id % 71 = 0 THEN 'fr' WHEN doc_id % 2 = 0 THEN 'ko' ELSE 'en' END AS locale, CASE WHEN doc_id % 83 = 0 THEN ' ' ELSE text END AS text FROM d),
    f AS (SELECT DISTINCT fam AS id, fam // 3 + CASE WHEN fam % 101 = 0 THEN 1000000000 ELSE 0 END AS sid, fam % 89 <> 0 AS fits FROM d),
    s AS (SELECT DISTINCT src AS id, CASE WHEN src % 31 = 0 THEN 'other' ELSE ['train', 'dev', 'test'][src % 3 + 1] END AS split, CASE WHEN src % 3 = 1 THEN 'plain' WHEN src % 43 = 0 THEN 'odd' ELSE '' END AS style FROM d)"""
QUERIES["g25_family_graph_check"] = (
    _graph,
    f"""WITH {_STAR_SQL}
    SELECT 'source_split' AS code, id::VARCHAR AS id FROM s WHERE split = 'other'
    UNION ALL SELECT 'dev_style', id::VARCHAR FROM s WHERE CASE WHEN split = 'dev' THEN style <> 'plain' ELSE style <> '' END
    UNION ALL SELECT 'family_source', id::VARCHAR FROM f WHERE sid NOT IN (SELECT id FROM s)
    UNION ALL SELECT 'family_pin', id::VARCHAR FROM f WHERE NOT fits
    UNION ALL SELECT 'source_family_count', s.id::VARCHAR FROM s LEFT JOIN f ON f.sid = s.id GROUP BY s.id HAVING count(f.id) <> 3
    UNION ALL (SELECT DISTINCT 'comment_id', id FROM c GROUP BY id HAVING count(*) > 1)
    UNION ALL SELECT 'comment_binding', c.id FROM c JOIN f ON f.id = fam LEFT JOIN s ON s.id = f.sid WHERE c.sid <> f.sid OR s.id IS NULL OR c.src <> s.id OR odd
    UNION ALL SELECT 'comment_locale', id FROM c WHERE locale = 'fr'
    UNION ALL SELECT 'comment_locale_repeated', fam::VARCHAR FROM c GROUP BY fam, locale HAVING count(*) > 1
    UNION ALL SELECT 'comment_text', id FROM c WHERE text IS NULL OR strlen(text) > 4096 OR NOT regexp_matches(text, '[^\\p{{Z}}\\x09-\\x0D\\x85]') OR contains(text, chr(0))
    UNION ALL SELECT 'family_comment_pair', f.id::VARCHAR FROM f LEFT JOIN (SELECT DISTINCT fam, locale FROM c WHERE locale IN ('ko', 'en')) p ON p.fam = f.id GROUP BY f.id HAVING count(p.fam) <> 2
    UNION ALL SELECT 'pin_alias', 'frame/' || fam FROM c GROUP BY fam HAVING bool_or(odd)""",
)
QUERIES["g25_family_graph_counts"] = (
    lambda s, d: family_graph_counts(*_star(s, d)[:3]),
    f"""WITH {_STAR_SQL} SELECT split, style AS dev_style, count(DISTINCT s.id) AS sources, count(DISTINCT f.id) AS families, count(c.id) AS comments
    FROM s LEFT JOIN f ON f.sid = s.id LEFT JOIN c ON c.fam = f.id GROUP BY ALL""",
)
