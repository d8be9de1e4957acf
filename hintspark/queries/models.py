"""Queries of features, training, scoring and quantization."""

# ruff: noqa: E731
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from hintspark.functions import hashing as H, text as X, vectors as N
from hintspark.operators import claims as C, heads as D, retrieval as R, training as T
from hintspark.plans.shared import SharedTables
from hintspark.queries import table
from hintspark.queries.retrieval import _BM25, _items, _scores
from hintspark.queries.text import TURN_PAIRS_SQL, _turn_pairs, words_sql

QUERIES: dict = {}
LANGUAGES = ["de", "en", "es", "fr"]


def _summed(rows: DataFrame, key: list[str]) -> DataFrame:
    """What can be compared of features: how many there are, their bins and their sum."""
    f = F.col("features")
    return rows.select(*key, F.size(f).alias("n"), F.round(N._sum(F.transform(f, lambda x: x["val"])), 6).alias("total"), F.sha2(F.array_join(F.transform(f, lambda x: x["idx"]), ","), 256).alias("bins"))


def _features(kind):
    return lambda s, d: _summed(H.with_features(table(s, d, "documents"), ["doc_id"], F.col("text"), kind), ["doc_id"])


def _crossed(tokens):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = _turn_pairs(spark, sf_dir)
        return _summed(H.with_cross_features(pairs, ["conv_id", "turn"], tokens(F.col("query")), tokens(F.col("reply"))), ["conv_id", "turn"])

    return run


QUERIES["f1_cross_hash"] = (_crossed(X.words), None)
QUERIES["f2_symbol_cross_hash"] = (_crossed(X.symbol_tokens), None)
QUERIES["f3_ngram_features"] = (_features(H.ngram_features), None)
QUERIES["f4_contextual_features"] = (_features(H.contextual_features), None)
QUERIES["f5_position_features"] = (_features(H.position_features), None)


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _turn_pairs(spark, sf_dir).select("conv_id", "turn", N.lexical_features(F.lower("query"), F.lower("reply")).alias("f"))
    return pairs.select("conv_id", "turn", *(F.round(F.get("f", i), 6).alias(n) for i, n in ((1, "recall"), (2, "jaccard"), (3, "cosine"), (4, "pair_recall"), (5, "pair_jaccard"), (12, "query_length"), (14, "length_ratio"))))


_PAIR_SET = lambda w: f"list_distinct(list_transform(list_zip({w}[:-2], {w}[2:]), lambda p: p[1] || chr(1) || p[2]))"
QUERIES["f6_lexical_features"] = (
    _lexical,
    f"""WITH w AS (SELECT conv_id, turn, {words_sql("query")} AS a, {words_sql("reply")} AS b FROM ({TURN_PAIRS_SQL})),
    s AS (SELECT *, list_distinct(a) AS q, list_distinct(b) AS d, {_PAIR_SET("a")} AS qp, {_PAIR_SET("b")} AS dp FROM w),
    n AS (SELECT *, len(list_intersect(q, d)) AS h, len(list_intersect(qp, dp)) AS hp FROM s)
    SELECT conv_id, turn, round(h / greatest(len(q), 1), 6) AS recall, round(h / greatest(len(q) + len(d) - h, 1), 6) AS jaccard, round(h / sqrt(greatest(len(q), 1)::DOUBLE * greatest(len(d), 1)), 6) AS cosine,
      round(hp / greatest(len(qp), 1), 6) AS pair_recall, round(hp / greatest(len(qp) + len(dp) - hp, 1), 6) AS pair_jaccard, round(ln(1 + len(a)) / 8, 6) AS query_length, round(least(len(a), len(b)) / greatest(len(a), len(b), 1), 6) AS length_ratio FROM n""",
)


def _ranked(spark: SparkSession, sf_dir: str, best: int | None = None) -> DataFrame:
    return SharedTables(spark, "ranked").keep(R.ranked(_scores(spark, sf_dir, best).where("score > 0"), ["query_id"], [F.col("score").desc(), F.col("doc_id")], best))


def _claim(features, names, places: int = 6, best: int | None = None):
    """features of (queries, ranking, documents), rounded; best: how many places of a ranking they read, if not all."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = features(spark, sf_dir, _items(spark, sf_dir), _ranked(spark, sf_dir, best), table(spark, sf_dir, "documents").count())
        return found.select(*(c if c not in names else F.round(c, places).alias(c) for c in found.columns))

    return run


_PLACED_SQL = "r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0), n AS (SELECT count(*) AS n, least(count(*), 10) AS ten, least(count(*), 20) AS twenty FROM documents)"
_SHAPE_SQL = f"""SELECT item_id AS query_id, text, len({words_sql("text")}) AS words, len(list_distinct({words_sql("text")})) AS distinct_words, length(text) AS chars, strlen(text) AS bytes FROM benchmark"""
_CLAIM_SQL = f"""s AS (SELECT query_id, coalesce(max(score) FILTER (rank = 1), 0) AS top, coalesce(max(score) FILTER (rank = 2), 0) AS second, count(*) FILTER (rank <= 10) AS ten_positive, count(*) AS positive FROM r GROUP BY query_id),
    q AS ({_SHAPE_SQL}), f7 AS (SELECT q.query_id, 1.0::DOUBLE AS bias, round(least(words / 64, 1), 6) AS query_words, round(least(bytes / 8192, 1), 6) AS query_bytes, round(coalesce(len(regexp_extract_all(text, '\\p{{Lu}}')) / nullif(chars, 0), 0), 6) AS uppercase_fraction,
      round(coalesce(len(regexp_extract_all(text, '\\p{{Nd}}')) / nullif(chars, 0), 0), 6) AS digit_fraction, round(coalesce(len(regexp_extract_all(text, '_')) / nullif(chars, 0), 0), 6) AS underscore_fraction,
      round(coalesce(least(len(regexp_extract_all(text, '[\\p{{Ll}}\\p{{Nd}}]\\p{{Lu}}')) / nullif(words, 0), 1), 0), 6) AS camel_boundaries_per_word, round(coalesce(distinct_words / nullif(words, 0), 0), 6) AS unique_word_fraction,
      round(coalesce(top / (1 + top), 0), 6) AS top_score_squashed, round(coalesce((top - second) / (1 + top), 0), 6) AS top_two_gap_squashed, round(coalesce(ten_positive, 0) / ten, 6) AS top_ten_positive_fraction, round(coalesce(positive, 0) / n, 6) AS positive_catalog_fraction
      FROM q CROSS JOIN n LEFT JOIN s USING (query_id))"""
_FILLED_SQL = "coalesce({s} / twenty, 0) AS m, sqrt(greatest(coalesce({q} / twenty, 0) - power(coalesce({s} / twenty, 0), 2), 0)) AS d"
_SPREAD_SQL = f"""v AS (SELECT r.query_id, rank, score / first AS v FROM r JOIN (SELECT query_id, score AS first FROM r WHERE rank = 1) USING (query_id) CROSS JOIN n WHERE rank <= twenty),
    vs AS (SELECT query_id, sum(v) AS s, sum(v * v) AS q, max(v) FILTER (rank = (SELECT twenty FROM n)) AS last FROM v GROUP BY query_id),
    f8 AS (SELECT query_id, round(m, 6) AS top20_relative_mean, round(d, 6) AS top20_relative_stddev, round(coalesce(1 / s, 0), 6) AS top20_first_score_share, round(coalesce(last, 0), 6) AS top20_last_first_ratio
      FROM (SELECT item_id AS query_id, s, last, {_FILLED_SQL.format(s="s", q="q")} FROM benchmark CROSS JOIN n LEFT JOIN vs ON query_id = item_id))"""
QUERIES["f7_search_claim_features"] = (_claim(lambda s, d, q, r, n: C.search_claim_features(q, r, n), (*C.SHAPE, *C.SCORES)), f"WITH {_BM25}, {_PLACED_SQL}, {_CLAIM_SQL} SELECT * FROM f7")
QUERIES["f8_score_spread"] = (_claim(lambda s, d, q, r, n: C.score_spread(q, r, n), C.SPREADS, best=C.SPREAD), f"WITH {_BM25}, {_PLACED_SQL}, {_SPREAD_SQL} SELECT * FROM f8")
QUERIES["f9_coverage"] = (
    _claim(lambda s, d, q, r, n: C.query_coverage(q, r, table(s, d, "documents"), n), C.COVERAGES, best=C.SPREAD),
    f"""WITH {_BM25}, {_PLACED_SQL}, t AS (SELECT r.query_id, rank, len(list_intersect(q.want, d.terms)) / len(q.want) AS c FROM r JOIN (SELECT item_id AS query_id, list_distinct({words_sql("text")}) AS want FROM benchmark) q USING (query_id) JOIN docs d USING (doc_id) CROSS JOIN n WHERE rank <= twenty),
    cs AS (SELECT query_id, sum(c) AS s, sum(c * c) AS q, max(c) FILTER (rank = 1) AS first FROM t GROUP BY query_id),
    k AS (SELECT query_id, count(*) AS terms, count(df) AS known FROM asked LEFT JOIN dfs USING (term) GROUP BY query_id)
    SELECT query_id, round(coalesce(first, 0), 6) AS first_query_term_coverage, round(m, 6) AS top20_mean_query_term_coverage, round(d, 6) AS top20_stddev_query_term_coverage, round(coalesce(1 - known / terms, 0), 6) AS query_vocabulary_absent_fraction
    FROM (SELECT item_id AS query_id, first, {_FILLED_SQL.format(s="s", q="q")} FROM benchmark CROSS JOIN n LEFT JOIN cs ON query_id = item_id) LEFT JOIN k USING (query_id)""",
)
QUERIES["f10_path_claim_features"] = (
    _claim(lambda s, d, q, r, n: C.path_claim_features(q, r, n), (*C.SHAPE, *C.SCORES, *C.SPREADS)),
    f"WITH {_BM25}, {_PLACED_SQL}, {_CLAIM_SQL}, {_SPREAD_SQL} SELECT f7.*, f8.* EXCLUDE (query_id), true AS in_range FROM f7 JOIN f8 USING (query_id)",
)


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's mean vector of length one; vectors of equal label play the tokens of a text."""
    e = F.posexplode(F.transform("embedding", lambda x: x.cast("double")))
    sums = table(spark, sf_dir, "embeddings").select("label", e.alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("s"))
    size = F.sqrt(F.sum(F.col("s") * F.col("s")).over(W.partitionBy("label")))
    return sums.select("label", "at", F.round(F.col("s") / size, 6).alias("value"))


QUERIES["f11_mean_pool"] = (
    _pooled,
    "WITH s AS (SELECT label, i - 1 AS k, sum(embedding[i]::DOUBLE) AS s FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL) SELECT label, k::INT AS \"at\", round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS value FROM s",
)


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    a = N.alignment(F.col("embedding"), F.col("other"))
    return pairs.select("vec_id", F.round(F.get(a, 0), 6).alias("cosine"), F.size(a).alias("size"), F.round(F.get(a, 1), 6).alias("first_product"), F.round(F.element_at(a, -1), 6).alias("last_difference"))


QUERIES["f12_cosine_alignment"] = (
    _cosines,
    """WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS x, list_transform(b.embedding, lambda x: x::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(list_cosine_similarity(x, y), 6) AS cosine, (1 + 2 * len(x))::INT AS size, round(8 * x[1] * y[1], 6) AS first_product, round(abs(x[-1] - y[-1]), 6) AS last_difference FROM p""",
)
QUERIES["f13_layer_norm"] = (
    lambda s, d: table(s, d, "embeddings").select("vec_id", N.layer_norm(F.transform("embedding", lambda x: x.cast("double"))).alias("n")).select("vec_id", F.round(F.get("n", 0), 5).alias("first"), F.round(F.element_at("n", -1), 5).alias("last")),
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), m AS (SELECT *, list_avg(x) AS m, list_var_pop(x) AS q FROM v)
    SELECT vec_id, round((x[1] - m) / sqrt(q + 1e-5), 5) AS first, round((x[-1] - m) / sqrt(q + 1e-5), 5) AS last FROM m""",
)


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram features of texts in scope, with label, group and weight; refused ones are left out."""
    rows = table(spark, sf_dir, "documents").where(X.in_scope(F.col("text"), F.col("source"), 4096, 2000))
    found = H.with_features(rows, ["doc_id", "lang", "source"], F.substring("text", 1, 4096), H.ngram_features)
    return found.select("doc_id", "lang", F.col("source").alias("grp"), "features", (F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")) - 1).cast("int").alias("label"), F.lit(1.0).alias("weight")).where("label >= 0")


QUERIES["f14_sparse_dataset"] = (
    lambda s, d: _dataset(s, d).groupBy("lang").agg(F.count("*").alias("rows"), F.count_distinct("grp").alias("groups")),
    f"SELECT lang, count(*) AS rows, count(DISTINCT source) AS groups FROM documents WHERE strlen(text) <= 4096 AND len({words_sql('text')}) <= 2000 GROUP BY lang",
)


def _fitted(spark: SparkSession, sf_dir: str, **how):
    data = SharedTables(spark, "dataset").keep(_dataset(spark, sf_dir))
    train = data.where("doc_id % 4 <> 0")
    return data, T.fit_softmax(train, len(LANGUAGES), 1024, steps=12, **how)


def _predicted(**how):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data, w = _fitted(spark, sf_dir, **how)
        return T.predict(data, ["doc_id", "lang"], w, LANGUAGES, confidence=0.3).select("doc_id", "lang", "intent", F.round("confidence", 3).alias("confidence"))

    return run


QUERIES["l3_fit_softmax"] = (_predicted(), None)
QUERIES["l6_fit_ternary"] = (_predicted(ternary=True), None)


def _logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English against other languages, chosen by the sources from src2 on; scores are dots of features and weights."""
    tables = SharedTables(spark, "logistic")
    data = tables.keep(_dataset(spark, sf_dir).withColumn("label", (F.col("lang") == "en").cast("int")))
    fitted = D.fit_logistic(data.where("grp < 'src2'"), data.where("grp >= 'src2'"), 1024, F.col("doc_id"), tables, "grp", batch=1024, epochs=2)
    weights = F.array(*map(F.lit, fitted.head["w"][:, 0].tolist()))
    return data.select("doc_id", "label", (H.sparse_dot(F.col("features"), weights) > 0).cast("int").alias("predicted"))


QUERIES["l1_fit_logistic"] = (_logistic, None)


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients go to a stored table and come back; read_back says whether they are the same."""
    _, w = _fitted(spark, sf_dir)
    stored = SharedTables(spark, "coefficients").keep(T.coefficients_to_table(spark, "languages", "main", w))
    again = T.table_to_coefficients(stored, "languages", "main", *(w.shape[0], w.shape[1] - 1))
    return stored.groupBy("class").agg(F.count("*").alias("coefficients"), F.max("idx").alias("last")).withColumn("read_back", F.lit(bool((again == w).all())))


QUERIES["s9_coefficient_table"] = (_roundtrip, None)
_RANK_GAIN = "(ceil((doc_id * 7 % 61 + 1) / 20.0) - ceil((doc_id * 13 % 61 + 1) / 20.0))"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    gain = F.ceil((d * 7 % 61 + 1) / 20) - F.ceil((d * 13 % 61 + 1) / 20)
    return table(spark, sf_dir, "documents").select("doc_id", T.cost_labels(gain, 0.5).alias("c")).select("doc_id", "c.label", F.round("c.weight", 6).alias("weight"))


QUERIES["l11_cost_labels"] = (_labels, f"SELECT doc_id, ({_RANK_GAIN} - 0.5 > 0)::INT AS label, round(abs({_RANK_GAIN} - 0.5), 6)::DOUBLE AS weight FROM documents")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return T.ranking_pairs(rows, "l_orderkey", "l_linenumber", "label").withColumn("weight", F.round("weight", 9))


QUERIES["l8_ranking_pairs"] = (
    _pairs,
    """WITH p AS (SELECT a.l_orderkey, a.l_linenumber AS better, b.l_linenumber AS worse FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag <> 'R')
    SELECT l_orderkey, better, worse, round(1 / count(*) OVER (PARTITION BY l_orderkey) / (SELECT count(DISTINCT l_orderkey) FROM p), 9) AS weight FROM p""",
)
QUERIES["l10_best_split"] = (
    lambda s, d: T.best_split(table(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double").alias("y")), ["l_quantity", "l_discount", "l_tax"], "y", 50),
    """WITH r AS (SELECT l_linenumber::DOUBLE AS y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem), s AS (SELECT feature, x, count(*) AS n, sum(y) AS s FROM r GROUP BY ALL),
    c AS (SELECT feature, x, lead(x) OVER o AS nx, sum(n) OVER o AS ln, sum(s) OVER o AS ls, sum(n) OVER g AS n, sum(s) OVER g AS s FROM s WINDOW o AS (PARTITION BY feature ORDER BY x), g AS (PARTITION BY feature))
    SELECT feature, (x + nx) / 2 AS cut, round(ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n, 6) AS gain, ln::BIGINT AS left FROM c WHERE nx IS NOT NULL AND ln >= 50 AND n - ln >= 50 ORDER BY gain DESC, feature, cut LIMIT 1""",
)


def _tree_sql(rows: str, features: list[str], depth: int, least: int, keys: list[str] = [], shown: str = "") -> str:  # noqa: B006
    """A regression tree, level by level; rows: (y, features, keys). shown: another result than the nodes."""
    names, columns = ", ".join(f"'{f}'" for f in features), ", ".join(features)
    parts = [f"r0 AS (SELECT y, {', '.join([*features, *keys])}, 1 AS node FROM ({rows}))"]
    for d in range(depth):
        value = "CASE b.feature " + " ".join(f"WHEN '{f}' THEN r.{f}" for f in features) + " END"
        parts.append(f"""l{d} AS (SELECT node, y, unnest([{names}]) AS feature, unnest(range({len(features)})) AS place, unnest([{columns}]) AS x FROM r{d} WHERE node >= {2**d}),
    s{d} AS (SELECT node, feature, place, x, count(*) AS n, sum(y) AS s FROM l{d} GROUP BY ALL),
    c{d} AS (SELECT node, feature, place, x, lead(x) OVER o AS nx, sum(n) OVER o AS ln, sum(s) OVER o AS ls, sum(n) OVER g AS n, sum(s) OVER g AS s FROM s{d} WINDOW o AS (PARTITION BY node, feature ORDER BY x), g AS (PARTITION BY node, feature)),
    g{d} AS (SELECT node, feature, place, x, round(ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n, 6) AS gain FROM c{d} WHERE nx IS NOT NULL AND ln >= {least} AND n - ln >= {least}),
    b{d} AS (SELECT node, feature, x AS cut FROM g{d} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, place, x) = 1),
    r{d + 1} AS (SELECT r.y, {", ".join(f"r.{f}" for f in [*features, *keys])}, CASE WHEN b.node IS NULL THEN r.node WHEN {value} <= b.cut THEN 2 * r.node ELSE 2 * r.node + 1 END AS node FROM r{d} r LEFT JOIN b{d} b ON r.node = b.node)""")
    cuts = " UNION ALL ".join(f"SELECT node, feature, cut FROM b{d}" for d in range(depth))
    return f"""WITH {", ".join(parts)}, cuts AS ({cuts}), above AS (SELECT y, unnest([{", ".join(f"node >> {k}" for k in range(depth + 1))}]) AS node FROM r{depth}),
    v AS (SELECT node, count(*) AS rows, avg(y) AS value FROM above WHERE node > 0 GROUP BY node)
    {shown or "SELECT v.node, rows, round(value, 6) AS value, feature, cut FROM v LEFT JOIN cuts ON v.node = cuts.node"}"""


_CUT_BY = ["l_quantity", "l_discount", "l_tax"]
QUERIES["l10_shallow_tree"] = (
    lambda s, d: T.fit_shallow_tree(table(s, d, "lineitem"), _CUT_BY, "l_linenumber", 4, 50).withColumn("value", F.round("value", 6)),
    _tree_sql("SELECT l_linenumber::DOUBLE AS y, l_quantity, l_discount, l_tax FROM lineitem", _CUT_BY, 4, 50),
)
QUERIES["q5_predict_tree"] = (
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(D.predict_tree(table(s, d, "lineitem"), T.fit_shallow_tree(table(s, d, "lineitem"), _CUT_BY, "l_linenumber", 4, 50)), 6).alias("predicted")),
    _tree_sql("SELECT l_linenumber::DOUBLE AS y, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem", _CUT_BY, 4, 50, ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber, round(avg(y) OVER (PARTITION BY node), 6) AS predicted FROM r4"),
)
_LOGITS = lambda: F.array(*((F.col("n_chars") % m / 4).cast("double") for m in (7, 11, 5, 3)))
QUERIES["l12_temperature_grid"] = (
    lambda s, d: T.temperature_grid(table(s, d, "documents").select(_LOGITS().alias("z"), (F.col("doc_id") % 4).cast("int").alias("label")), "z", "label"),
    """WITH r AS (SELECT n_chars % 7 / 4 AS a, n_chars % 11 / 4 AS b, n_chars % 5 / 4 AS c, n_chars % 3 / 4 AS d, doc_id % 4 AS k, unnest(range(5, 51)) / 10 AS temperature FROM documents)
    SELECT temperature, round(avg(ln(exp(a / temperature) + exp(b / temperature) + exp(c / temperature) + exp(d / temperature)) - CASE k WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN c ELSE d END / temperature), 6) AS nll FROM r GROUP BY temperature""",
)
QUERIES["l13_select_candidate"] = (
    lambda s, d: T.select_candidate(table(s, d, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("pages"), F.count("*").alias("calls")), [F.col("pages"), F.col("calls"), F.col("lang"), F.col("source")]),
    "SELECT lang, source, sum(n_chars)::BIGINT AS pages, count(*) AS calls FROM documents GROUP BY ALL ORDER BY pages, calls, lang, source LIMIT 1",
)


def _quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", N.quantize_int8(F.col("embedding")).alias("i"), N.quantize_ternary(F.col("embedding")).alias("t"))
    error = lambda q: F.round(N._sum(F.zip_with("embedding", f"{q}.codes", lambda x, c: F.pow(x.cast("double") - c * F.col(f"{q}.scale"), 2))), 6)
    return v.select("vec_id", F.round("i.scale", 9).alias("int8_scale"), error("i").alias("int8_error"), F.round("t.scale", 9).alias("ternary_scale"), F.size(F.filter("t.codes", lambda c: c != 0)).alias("kept"), error("t").alias("ternary_error"))


QUERIES["q2_quantize_vectors"] = (
    _quantized,
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings), s AS (SELECT *, list_max(a) / 127 AS s, list_avg(a) * 0.7 AS least FROM v),
    k AS (SELECT *, list_filter(a, lambda y: y >= least) AS kept FROM s), t AS (SELECT *, list_avg(kept) AS ts FROM k)
    SELECT vec_id, round(s, 9) AS int8_scale, round(list_sum(list_transform(x, lambda y: power(y - round(y / s) * s, 2))), 6) AS int8_error, round(ts, 9) AS ternary_scale, len(kept)::INT AS kept, round(list_sum(list_transform(x, lambda y: power(y - CASE WHEN abs(y) >= least THEN sign(y) * ts ELSE 0 END, 2))), 6) AS ternary_error FROM t""",
)


def _dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's positive components as sparse features, times weights made of their places."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.struct(i.alias("idx"), x.cast("double").alias("val"))).alias("f"))
    width = v.agg(F.max(F.size("f"))).first()[0]
    weights = F.array(*(F.lit((i * 7 % 11 - 5) / 10) for i in range(width)))
    return v.select("vec_id", F.round(H.sparse_dot(F.filter("f", lambda x: x["val"] > 0), weights), 5).alias("dot"))


QUERIES["q1_sparse_dot"] = (
    _dotted,
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN x::DOUBLE * ((i - 1) * 7 % 11 - 5) / 10 ELSE 0 END)), 5) AS dot FROM embeddings",
)


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage's first eight documents by cross features, with weights of alternating sign.

    A pair with a text over 64 words or 4,096 bytes is out of scope, so its passage keeps its order.
    """
    side = lambda frame, key, name: frame.select(key, X.words(F.col("text")).alias(name), (F.octet_length("text") <= 4096).alias(f"{name}_fits"))
    top = R.bm25_topk(_scores(spark, sf_dir, 8), 8).join(side(table(spark, sf_dir, "documents"), "doc_id", "d"), "doc_id").join(side(_items(spark, sf_dir), "query_id", "q"), "query_id")
    fits = F.coalesce(F.col("d_fits") & F.col("q_fits") & (F.size("d") <= 64) & (F.size("q") <= 64), F.lit(False))
    some = lambda c: F.when(F.col("in_scope"), F.col(c)).otherwise(F.array().cast("array<string>"))
    found = H.with_cross_features(top.withColumn("in_scope", fits), ["query_id", "doc_id", "rank", "in_scope"], some("q"), some("d"))
    score = F.aggregate("features", F.lit(0.0), lambda s, f: s + f["val"] * F.when(f["idx"] == 0, 5.0).when(f["idx"] % 2 == 0, 0.1).otherwise(-0.1))
    return R.linear_rerank(found, "query_id", "doc_id", score, F.col("in_scope")).drop("features", "in_scope")


QUERIES["r16_linear_rerank"] = (_reranked, None)
