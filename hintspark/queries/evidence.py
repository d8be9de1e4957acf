"""Queries of the evidence joins and plans; orders, parts and customers play requests, models and works."""

# ruff: noqa: E731
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hintspark.operators import evidence as V
from hintspark.queries import table

QUERIES: dict = {}
_HALF = lambda: F.when(F.col("doc_id") % 2 == 0, "train").otherwise("final").alias("role")


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    members = docs.select(F.col("doc_id").alias("id"), _HALF(), F.col("source").alias("repository"))
    targets = labels.select(F.col("doc_id").alias("id"), F.concat_ws("/", "quality", "toxic").alias("target"))
    catalogs = docs.groupBy(F.col("source").alias("repository")).agg((F.count("*") % 3 != 0).alias("available"))
    entries = docs.select(F.col("source").alias("repository"), F.concat_ws("/", F.col("n_chars") % 2, F.lit(0)).alias("path"))
    return V.coverage_totals(V.coverage_join(members, targets, catalogs, entries))


QUERIES["j1_coverage_join"] = (
    _covered,
    """WITH c AS (SELECT source, count(*) % 3 <> 0 AS available FROM documents GROUP BY source), e AS (SELECT DISTINCT source, (n_chars % 2) || '/0' AS path FROM documents),
    r AS (SELECT CASE WHEN d.doc_id % 2 = 0 THEN 'train' ELSE 'final' END AS role, d.source AS repository, CASE WHEN l.doc_id IS NULL THEN 'root_unavailable' WHEN NOT c.available THEN 'catalog_unavailable' WHEN e.path IS NULL THEN 'unusable_target' ELSE 'matched' END AS status
      FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN c ON c.source = d.source LEFT JOIN e ON e.source = d.source AND e.path = l.quality || '/' || l.toxic)
    SELECT role, repository, count(*) AS members, count(*) FILTER (status = 'root_unavailable') AS root_unavailable, count(*) FILTER (status = 'catalog_unavailable') AS catalog_unavailable, count(*) FILTER (status = 'unusable_target') AS unusable_target,
      count(*) FILTER (status = 'matched') AS matched FROM r GROUP BY GROUPING SETS ((), (role, repository))""",
)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's suppliers are the targets, suppliers of its nation group the catalog."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    targets = lines.select((F.col("l_partkey") % 25).alias("catalog"), F.col("l_suppkey").cast("string").alias("path")).distinct()
    k = F.col("s_suppkey")
    entries = suppliers.select(F.col("s_nationkey").cast("long").alias("catalog"), k.cast("string").alias("path"), F.when(k % 5 == 0, "120000").otherwise("100644").alias("mode"), F.when(k % 7 == 0, "commit").when(k % 3 == 0, "tree").otherwise("blob").alias("type"))
    return V.match_catalog(targets, entries, "catalog")


QUERIES["j2_match_catalog"] = (
    _matched,
    """WITH t AS (SELECT DISTINCT l_partkey % 25 AS catalog, l_suppkey FROM lineitem),
    k AS (SELECT catalog, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_suppkey % 5 = 0 THEN 'symlink' WHEN s_suppkey % 7 = 0 THEN 'submodule' WHEN s_suppkey % 3 = 0 THEN 'directory' ELSE 'regular' END AS kind FROM t LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = catalog)
    SELECT catalog, count(*) AS targets, count(*) FILTER (kind = 'regular') AS regular, count(*) FILTER (kind = 'symlink') AS symlink, count(*) FILTER (kind = 'submodule') AS submodule, count(*) FILTER (kind = 'directory') AS directory, count(*) FILTER (kind = 'missing') AS missing FROM k GROUP BY catalog""",
)


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return V.seal_join(customers.select(F.col("c_custkey").alias("k")), orders.where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("k")), orders.where("o_orderpriority LIKE '5%'").select(F.col("o_custkey").alias("k")), "k")


QUERIES["j3_seal_join"] = (
    _sealed,
    """WITH s AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1), c AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority LIKE '5%' GROUP BY 1)
    SELECT k, CASE WHEN m IS NULL THEN 'no_member' WHEN ns = 0 THEN 'source_missing' WHEN ns > 1 THEN 'source_repeated' WHEN nc = 0 THEN 'cost_missing' ELSE 'cost_repeated' END AS problem
    FROM (SELECT coalesce(c_custkey, s.k, c.k) AS k, c_custkey AS m, coalesce(s.n, 0) AS ns, coalesce(c.n, 0) AS nc FROM customer FULL JOIN s ON s.k = c_custkey FULL JOIN c ON c.k = coalesce(c_custkey, s.k)) WHERE m IS NULL OR ns <> 1 OR nc <> 1""",
)
QUERIES["j4_inventory_compact"] = (
    lambda s, d: V.inventory_compact(table(s, d, "documents").select("source", F.sha2("text", 256).alias("object"), F.octet_length("text").alias("bytes")), ["source", "object"], "bytes"),
    "SELECT source, sha256(text) AS object, count(*) AS references, max(strlen(text))::INT AS bytes FROM documents GROUP BY 1, 2",
)
QUERIES["j5_root_coverage"] = (
    lambda s, d: V.root_coverage(table(s, d, "documents"), "source", F.col("n_chars") % 3 != 0, F.col("lang") == "en"),
    "SELECT source, count(*) AS snapshots, count(*) FILTER (n_chars % 3 <> 0) AS available, count(*) FILTER (n_chars % 3 <> 0 AND lang = 'en') AS candidate, count(*) FILTER (n_chars % 3 = 0) AS missing FROM documents GROUP BY ROLLUP (source)",
)


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, the rows that each reason excludes."""
    from hintspark.functions import text as X

    t = F.col("text")
    reason = X.exclusion_reason(F.substring(t, 101, 20), F.substring(t, 1, 40), t, F.col("source") == "src3")
    return table(spark, sf_dir, "documents").select("source", reason.alias("reason")).groupBy("source").pivot("reason", ["", "generated", "notice", "header", "query"]).count().select("source", *(F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(r or "kept") for r in ("", "generated", "notice", "header", "query")))


def _audit_sql() -> str:
    from hintspark.queries.text import QUERIES as T

    return "WITH r AS (SELECT d.source, x.reason FROM documents d JOIN (" + T["t13_exclusion_reason"][1] + ") x USING (doc_id)) SELECT source, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r or 'kept'}" for r in ("", "generated", "notice", "header", "query")) + " FROM r GROUP BY source"


QUERIES["j6_select_with_audit"] = (_audited, _audit_sql())


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of a document are the labels of documents of its family of three."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    reviews = labels.select(F.floor(F.col("doc_id") / 3).alias("family"), F.col("quality").alias("verdict"))
    rows = docs.join(labels, "doc_id", "left").select("doc_id", F.floor(F.col("doc_id") / 3).alias("family"), F.col("quality").alias("label"))
    masked = V.supervision_mask(rows.groupBy("family").agg(F.max("label").alias("label")), reviews, "family")
    return masked.select("family", "eligible", F.concat_ws(",", "reasons").alias("reasons"))


QUERIES["j7_supervision_mask"] = (
    _masked,
    """WITH r AS (SELECT doc_id // 3 AS family, max(quality) AS label, count(quality) AS n, count(DISTINCT quality) AS kinds FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
    a AS (SELECT family, list_filter([CASE WHEN label IS NULL THEN 'label_unknown' END, CASE WHEN n < 2 THEN 'reviews_missing' END, CASE WHEN kinds > 1 THEN 'reviews_inconsistent' END], lambda x: x IS NOT NULL) AS reasons FROM r)
    SELECT family, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM a""",
)


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "R", "T").when(F.col("l_returnflag") == "N", "F").when(F.col("l_linenumber") < 5, "U")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", state.alias("state"), F.when(F.col("l_orderkey") % 4 == 0, "calibration").otherwise("train").alias("role"))


_COHORT = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'T' WHEN l_returnflag = 'N' THEN 'F' WHEN l_linenumber < 5 THEN 'U' END AS state, CASE WHEN l_orderkey % 4 = 0 THEN 'calibration' ELSE 'train' END AS role FROM lineitem)"
_CLASSES = f"""(SELECT l_orderkey, count(*) AS candidates, CASE WHEN count(*) FILTER (state IS NULL) > 0 THEN 'ambiguous' WHEN count(*) FILTER (state = 'U') > 0 THEN 'unknown_containing' WHEN count(*) FILTER (state = 'T') = 0 THEN 'known_none'
    WHEN count(*) FILTER (state = 'T') = count(*) THEN 'all' WHEN count(*) FILTER (state = 'T') = 1 THEN 'one' ELSE 'many' END AS class FROM {_COHORT} GROUP BY l_orderkey)"""
QUERIES["j8_cohort_class"] = (lambda s, d: V.cohort_class(_cohort(s, d), "l_orderkey", "state"), f"SELECT * FROM {_CLASSES}")
QUERIES["j9_project_cohort"] = (
    lambda s, d: V.project_cohort(_cohort(s, d), "l_orderkey", "state", "role"),
    f"SELECT c.*, (state = 'T')::INT AS label, round(1 / candidates, 6) AS weight FROM {_COHORT} c JOIN {_CLASSES} k USING (l_orderkey) WHERE role <> 'calibration' AND class NOT IN ('ambiguous', 'unknown_containing')",
)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    observed = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("literal")).select(F.col("l_partkey").alias("k"), "literal")
    expected = parts.select("p_brand", F.col("p_partkey").alias("k"), (F.col("p_partkey") % 10 + 1).alias("literal"))
    return V.observations_vs_expected(observed, expected, "p_brand", ["k"])


QUERIES["j10_observations"] = (
    _observed,
    """WITH o AS (SELECT l_partkey, min(l_suppkey) AS seen FROM lineitem GROUP BY 1), m AS (SELECT p_brand, coalesce(seen = p_partkey % 10 + 1, false) AS m FROM part LEFT JOIN o ON l_partkey = p_partkey)
    SELECT p_brand, count(*) AS candidates, count(*) FILTER (m) AS matching, CASE WHEN bool_or(m) THEN 'answerable' ELSE 'no_answer' END AS answer FROM m GROUP BY p_brand""",
)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    objects = docs.where("doc_id % 5 <> 0").select(F.concat_ws("/", "source", F.col("doc_id") % 100).alias("path"), F.col("lang").alias("digest"))
    references = docs.select(F.concat_ws("/", "source", F.col("doc_id") % 100).alias("path"), F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang")).alias("digest")).distinct()
    return V.reference_problems(references, objects)


QUERIES["j11_reference_integrity"] = (
    _references,
    """WITH o AS (SELECT source || '/' || (doc_id % 100) AS path, min(lang) AS there, count(DISTINCT lang) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1),
    r AS (SELECT DISTINCT source || '/' || (doc_id % 100) AS path, CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS digest FROM documents)
    SELECT path, digest, CASE WHEN there IS NULL THEN 'missing' WHEN n > 1 THEN 'two_digests' ELSE 'differs' END AS problem FROM r LEFT JOIN o USING (path) WHERE there IS NULL OR n > 1 OR digest <> there""",
)


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    current = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("lang"), "source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("n_chars")).alias("n_chars"))
    return V.anchor_compare(docs.select("doc_id", "lang", "source", "n_chars"), current, "doc_id", ["source", "lang", "n_chars"])


QUERIES["j12_anchor_compare"] = (
    _anchors,
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unavailable' WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'stale' ELSE 'matched' END AS state, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN 'lang' WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN 'n_chars' END AS field FROM documents",
)


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    bindings = parts.select(F.concat_ws(":", "p_brand", "p_size").alias("intent"), F.col("p_partkey").alias("ref"))
    labels = suppliers.select(F.col("s_suppkey").alias("ref"), (F.col("s_suppkey") % 4 == 0).alias("is_group"), (F.col("s_acctbal") > 0).alias("active"))
    return V.resolve_bindings(bindings, labels)


QUERIES["j13_resolve_bindings"] = (
    _bindings,
    """WITH b AS (SELECT p_brand || ':' || p_size AS intent, p_partkey AS ref, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part)
    SELECT intent, ref, CASE WHEN n > 1 THEN 'duplicate_intent' WHEN s_suppkey IS NULL THEN 'missing' WHEN s_suppkey % 4 = 0 THEN 'group_container' WHEN NOT s_acctbal > 0 THEN 'inactive' END AS issue FROM b LEFT JOIN supplier ON s_suppkey = ref""",
)


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    predictions = docs.select(k.alias("work"), F.when(k % 6 == 0, "unclear").otherwise(F.col("lang")).alias("intent"), (F.col("n_chars") % 10 / 10 + 0.05).alias("confidence"), (F.col("n_chars") % 7 / 20).alias("margin"), F.when(k % 8 == 0, "rule").otherwise("learned").alias("source"))
    works = docs.select(k.alias("work"), F.when(k % 4 == 0, F.array(F.concat(F.lit("ref-"), "lang"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    bindings = docs.where("lang <> 'es'").select(F.col("lang").alias("intent"), F.concat(F.lit("ref-"), "lang").alias("ref")).distinct()
    return V.propose_annotations(predictions, works, bindings, 0.5).withColumn("new_labels", F.concat_ws(",", "new_labels"))


QUERIES["j14_propose_annotations"] = (
    _proposed,
    """WITH r AS (SELECT doc_id AS work, lang, CASE WHEN doc_id % 8 = 0 THEN 'not_learned' WHEN doc_id % 6 = 0 THEN 'unclear' WHEN n_chars % 10 / 10 + 0.05 < 0.5 THEN 'confidence' WHEN n_chars % 7 / 20 < 0.05 THEN 'margin' WHEN lang = 'es' THEN 'unbound' WHEN doc_id % 4 = 0 THEN 'no_change' ELSE 'proposed' END AS reason FROM documents)
    SELECT work, reason, CASE WHEN reason = 'proposed' THEN 'ref-' || lang ELSE '' END AS new_labels FROM r""",
)


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    works = orders.select(F.col("o_orderkey").alias("work"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 3).alias("version"))
    events = lines.select(F.col("l_orderkey").alias("work"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") % 3).cast("long").alias("version"), (F.col("l_quantity") > 10).alias("trusted"))
    return V.plan_state(works, events, ("F",), {"R": "returned", "A": "accepted"})


QUERIES["j15_plan_state"] = (
    _planned,
    """WITH e AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, min(l_returnflag) AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND l_linenumber % 3 = o_orderkey % 3 WHERE l_quantity > 10 GROUP BY 1),
    r AS (SELECT o_orderkey AS work, o_orderstatus AS s, kind, CASE WHEN o_orderstatus = 'F' THEN 'terminal' WHEN kinds IS NULL THEN 'no_event' WHEN kinds > 1 THEN 'conflict' WHEN kind NOT IN ('R', 'A') THEN 'unknown_event' ELSE 'moved' END AS reason FROM orders LEFT JOIN e ON l_orderkey = o_orderkey)
    SELECT work, CASE WHEN reason = 'moved' THEN CASE kind WHEN 'R' THEN 'returned' ELSE 'accepted' END ELSE s END AS state, reason FROM r""",
)


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A brand is a model, priced by its parts; one of seven has no price."""
    parts = table(spark, sf_dir, "part")
    n = F.substring("p_brand", 7, 2).cast("int")
    models = parts.groupBy(F.col("p_brand").alias("id"), n.alias("n")).agg(F.round(F.avg("p_size") / 50, 6).alias("quality"), F.round(F.avg("p_retailprice"), 6).alias("price")).select(
        "id", "quality", (F.col("n") * 1000).alias("context"), (F.col("n") % 2 == 0).alias("tools"), (F.col("n") % 3 == 0).alias("local"), F.when(F.col("n") % 7 != 0, F.col("price")).alias("price_in"), (F.col("price") * 2).alias("price_out"), F.when(F.col("n") % 5 == 0, 50.0).alias("budget")
    )
    return models, models.where("context % 4000 <> 0").select("id", (F.col("context") % 70).cast("double").alias("spent"), (F.col("context") / 1000 % 4).cast("int").alias("in_flight"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, usage = _models(spark, sf_dir)
    k = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select(k.alias("request"), (k % 3).cast("int").alias("tier"), (k % 10 / 10).alias("confidence"), (k % 13 == 0).alias("uncertain"), (k % 9000).alias("input_tokens"), (k % 2000 + 1).alias("output_tokens"), (k % 4 == 0).alias("tools"), (k % 6 == 0).alias("local_only"))
    return V.select_model(requests, models, usage, [0.3, 0.45, 0.5])


QUERIES["j16_select_model"] = (
    _selected,
    """WITH m AS (SELECT p_brand AS id, substr(p_brand, 7, 2)::INT AS n, round(avg(p_size) / 50, 6) AS quality, round(avg(p_retailprice), 6) AS price FROM part GROUP BY ALL),
    c AS (SELECT o_orderkey AS request, id, quality, (o_orderkey % 9000 * price + (o_orderkey % 2000 + 1) * price * 2) / 1e6 AS cost, n, CASE WHEN n * 1000 % 4000 <> 0 THEN n * 1000 % 70 END AS spent, CASE WHEN n * 1000 % 4000 <> 0 THEN n % 4 ELSE 0 END AS load,
      CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 10 / 10 < 0.7 THEN 0.5 ELSE [0.3, 0.45, 0.5][o_orderkey % 3 + 1] END AS floor FROM orders CROSS JOIN m),
    e AS (SELECT request, id, quality, round(cost * (1 + 0.1 * load), 9) AS cost FROM c WHERE quality >= floor AND request % 9000 + request % 2000 + 1 <= n * 1000 AND (request % 4 <> 0 OR n % 2 = 0) AND (request % 6 <> 0 OR n % 3 = 0) AND n % 7 <> 0
      AND NOT (n % 5 = 0 AND (spent IS NULL OR spent + cost > 50))),
    b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY request ORDER BY cost, quality DESC, id) = 1)
    SELECT o_orderkey AS request, id AS model, round(cost, 6) AS cost FROM orders LEFT JOIN b ON request = o_orderkey""",
)


def _switched(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("request"), (k % 17 == 0).alias("pinned"), F.when(k % 11 != 0, k % 5).alias("current"), (k % 7).alias("target"), (k % 5).alias("current_rank"), (k % 7 % 4).alias("target_rank"), (k % 21 / 20).alias("confidence"), F.when(k % 6 != 0, k % 9).alias("since"), F.when(k % 22 == 0, 0).otherwise(k % 1000).alias("context_tokens"), (k % 300 + 1).alias("output_tokens"),
        (k % 9 + 1.0).alias("current_out"), (k % 4 + 0.5).alias("target_out"), F.when(k % 10 != 0, k % 3 + 0.5).alias("current_cache_read"), (k % 2 + 0.25).alias("target_cache_read"), (k % 8 + 1.0).alias("target_in"), (k % 5 + 1.0).alias("target_cache_write"),
    )
    return V.switch_decision(rows)


QUERIES["j17_switch_decision"] = (
    _switched,
    """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 22 = 0 THEN 0 ELSE o_orderkey % 1000 END AS c, o_orderkey % 300 + 1 AS o, o_orderkey % 21 / 20 AS conf FROM orders),
    x AS (SELECT *, c * greatest(0, greatest(k % 8 + 1.0, k % 5 + 1.0) - (k % 2 + 0.25))::DOUBLE AS premium, CASE WHEN k % 10 <> 0 THEN c * ((k % 3 + 0.5) - (k % 2 + 0.25)) + o * ((k % 9 + 1.0) - (k % 4 + 0.5)) END AS saving FROM r),
    d AS (SELECT k AS request, CASE WHEN k % 17 = 0 THEN 'manual_pin' WHEN k % 11 = 0 THEN CASE WHEN c <> 0 THEN 'current_model_unknown' WHEN conf < 0.9 THEN 'entry_confidence' ELSE 'new_session' END WHEN k % 5 = k % 7 THEN 'already_selected'
      WHEN k % 7 % 4 > k % 5 THEN CASE WHEN conf < 0.7 THEN 'upgrade_confidence' ELSE 'quality_upgrade' END WHEN conf < 0.9 THEN 'downgrade_confidence' WHEN k % 6 = 0 THEN 'switch_history_unknown' WHEN k % 9 < 3 THEN 'cooldown'
      WHEN NOT coalesce(saving > 0, false) THEN 'prices_unknown_or_no_savings' WHEN premium / saving <= 10 THEN 'cache_payback_acceptable' ELSE 'cache_payback_too_long' END AS reason FROM x)
    SELECT request, CASE WHEN reason IN ('new_session', 'quality_upgrade', 'cache_payback_acceptable') THEN 'recommend' ELSE 'hold' END AS action, reason FROM d""",
)
QUERIES["j18_route_tier"] = (
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", V.route_tier(F.array(*((F.length("text") % m / 20) for m in (17, 19, 13))), ("fast", "middle", "strong"), F.octet_length("text") > 2000).alias("tier")),
    """WITH p AS (SELECT conv_id, turn, strlen(text) > 2000 AS g, length(text) % 17 / 20 AS a, length(text) % 19 / 20 AS b, length(text) % 13 / 20 AS c FROM conversations)
    SELECT conv_id, turn, CASE WHEN g OR greatest(a, b, c) < 0.6 THEN 'strong' WHEN a >= b AND a >= c THEN 'fast' WHEN b >= c THEN 'middle' ELSE 'strong' END AS tier FROM p""",
)
