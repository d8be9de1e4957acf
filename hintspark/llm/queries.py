"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _remainder(of: int) -> Column:
    """The number that deals documents into taught and held-out ones."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def _kept(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """frame written to the shared folder, its texts sent to Python in small batches."""
    from hintspark.plans.shared import SharedTables, arrow_rows

    with arrow_rows(spark, 1000):
        return SharedTables(spark, purpose).keep(frame)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _word_bpe())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from hintspark.llm.packing import pack

    return pack(docs, _word_bpe())


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.langid import fit_profiles, identify

    docs, held_out = _table(spark, sf_dir, "documents"), _remainder(3) == 1
    return identify(docs, fit_profiles(docs.where(~held_out)), keep={"held_out": held_out})


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.mixing import systematic_copies

    return systematic_copies(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    CAST('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS draw
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS most,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w FROM sums),
levels AS (
  SELECT *, row_number() OVER o AS pos,
    (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW o AS (ORDER BY most::DOUBLE / w, source NULLS LAST),
    before AS (ORDER BY most::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(most::DOUBLE, (SELECT arg_min(level, pos) FROM levels WHERE level * w <= most) * w) AS target,
    CAST('0x' || substr(sha256('mix:offset:' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM levels),
ranked AS (
  SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT, draw, doc_id NULLS FIRST, size) AS n
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor(rate * n + u) - floor(rate * (n - 1) + u), 3))::BIGINT * size AS taken
FROM ranked
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.quality import judge_quality

    judged = judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.html_text import extract_text

    return _kept(spark, extract_text(_table(spark, sf_dir, "pages")), "html")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from hintspark.llm.near_dedup import keep_one_each

    return keep_one_each(docs)


def _toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    from hintspark.llm.toxicity import fit_toxicity

    return fit_toxicity(docs, _table(spark, sf_dir, "labels").where(_remainder(5) != 0))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.toxicity import toxicity_score

    docs = _table(spark, sf_dir, "documents")
    score = toxicity_score(F.col("text"), _toxicity_model(spark, docs, sf_dir))
    judged = docs.select("doc_id", (_remainder(5) == 0).alias("held_out"), score.alias("score"))
    return _kept(spark, judged, "toxicity").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, taught as in op7_toxicity, doesn't reject; all columns stay as they are."""
    from hintspark.llm.toxicity import toxicity_score

    return _kept(spark, docs.where(toxicity_score(F.col("text"), _toxicity_model(spark, docs, sf_dir)) < 0.5), "toxicity")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.pii import replace_entities

    return replace_entities(_table(spark, sf_dir, "documents")).select("doc_id", "text", "entities", "collisions")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates; n_chars counts the new text's characters."""
    from hintspark.llm.pii import replace_entities

    new = replace_entities(docs).select(*docs.columns)
    return new.withColumn("n_chars", F.length("text").cast(new.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from hintspark.llm.mixing import mix

    return mix(docs)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH ints AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

#: verdict, host and path of the rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = r"""
WITH RECURSIVE rules(rule, verdict, rule_host, rule_path) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
    ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
rests AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_extract(url, '^(.*?)://', 1, 's') AS scheme,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, html, scheme, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) AS query FROM rests),
nodes AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM parts),
targets AS (
  SELECT scheme, rest, node, path, replace(unnest(list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|''[^''>]*\bcanonical\b|canonical\b)[^>]*>'),
      lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))
    || list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
      lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1))), '&amp;', '&') AS t FROM nodes WHERE node IS NOT NULL),
absolute AS (
  SELECT node AS src, CASE WHEN starts_with(t, '//') THEN substr(t, 3)
    WHEN starts_with(t, '/') THEN regexp_extract(rest, '^([^/?#]*)', 1) || t
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN instr(t, '://') > 0 THEN substr(t, instr(t, '://') + 3) ELSE '' END
    WHEN starts_with(t, '?') THEN regexp_extract(rest, '^([^/?#]*)', 1) || path || t
    WHEN starts_with(t, '#') THEN ''
    ELSE regexp_extract(rest, '^([^/?#]*)', 1) || CASE WHEN instr(path, '/') > 0 THEN regexp_extract(path, '^(.*/)', 1) ELSE '/' END
      || regexp_replace(t, '^(\./)+', '') END AS r FROM targets),
ends AS (
  SELECT src, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*(\?[^#]*)?', 1) AS query FROM absolute),
edges AS (SELECT src, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS dst FROM ends WHERE host <> ''),
sides AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT src AS node, dst AS other FROM sides UNION SELECT r.node, b.dst FROM reach r JOIN sides b ON r.other = b.src),
ruled AS (
  SELECT x.host, x.path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT host, path FROM nodes UNION
        SELECT regexp_extract(node, '^([^/?#]*)', 1), regexp_extract(node, '^[^/?#]*([^?#]*)', 1) FROM (SELECT src AS node FROM sides)) x
  JOIN rules ON (x.host = rule_host OR ends_with(x.host, '.' || rule_host)) AND starts_with(x.path, rule_path) GROUP BY ALL),
blocked AS (
  SELECT DISTINCT r.node FROM reach r JOIN ruled u
    ON u.host = regexp_extract(r.other, '^([^/?#]*)', 1) AND u.path = regexp_extract(r.other, '^[^/?#]*([^?#]*)', 1) WHERE u.verdict = 'block')
SELECT n.page_id, n.host, n.path, u.rule, coalesce(u.verdict, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM nodes n LEFT JOIN ruled u ON u.host = n.host AND u.path = n.path LEFT JOIN blocked b ON b.node = n.node
"""


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.hidden_markov import score_texts

    return score_texts(_table(spark, sf_dir, "documents"), _remainder(10) != 0)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH cells AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
given AS (SELECT row_number() OVER () AS n, doc_id, text, true AS own FROM documents UNION ALL SELECT 0, NULL, text, false FROM benchmark),
found AS (SELECT n, own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM given),
counted AS (SELECT n, own, w, count(*) AS k FROM found GROUP BY ALL),
hexed AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM counted),
bucketed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM hexed, cells),
cells_of AS (SELECT own, bucket, sum(k) AS k FROM counted JOIN bucketed USING (w) GROUP BY ALL),
sums AS (
  SELECT b.bucket, coalesce(sum(k) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (NOT own), 0)::DOUBLE AS t,
    (SELECT coalesce(sum(k), 0) FROM cells_of WHERE own)::DOUBLE AS all_s, (SELECT coalesce(sum(k), 0) FROM cells_of WHERE NOT own)::DOUBLE AS all_t
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN cells_of USING (bucket) GROUP BY b.bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) AS gain FROM sums),
weights AS (SELECT n, sum(k)::BIGINT AS n_features, floor(sum(k * gain) / sum(k))::BIGINT AS weight FROM counted JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE own GROUP BY n),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM given LEFT JOIN weights USING (n) WHERE own),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features)::BIGINT AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed
"""


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hintspark.llm.conversations import repair_conversations

    return repair_conversations(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_langid, op3_mixing, op4_quality, op5_html_text, op6_near_dedup, op7_toxicity, op8_pii, op9_topk, op10_url_filter, op11_lm_score, op12_importance, op13_conversations)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op9_topk": OP9_SQL, "op10_url_filter": OP10_SQL, "op12_importance": OP12_SQL}
