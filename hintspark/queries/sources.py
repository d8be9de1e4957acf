"""Queries of readers and writers over files that Spark writes from the tables."""

# ruff: noqa: E731
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hintspark.plans.shared import SharedTables
from hintspark.queries import table
from hintspark.sources import files as S

QUERIES: dict = {}


def _folder(spark: SparkSession) -> str:
    return SharedTables(spark, "files").root


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON lines, some of which have an unknown, a missing, a repeated or a wrong field."""
    k = F.col("c_custkey")
    good = F.to_json(F.struct(k.alias("id"), F.col("c_name").alias("name")))
    line = (
        F.when(k % 11 == 0, F.concat(F.lit('{"id":1,"id":2,"name":"'), "c_name", F.lit('"}'))).when(k % 7 == 0, F.to_json(F.struct(k.alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("more")))).when(k % 5 == 0, F.to_json(F.struct(k.alias("id"))))
        .when(k % 13 == 0, F.lit("[1]")).when(k % 17 == 0, F.concat(F.lit('{"id":"x","name":"'), "c_name", F.lit('"}'))).otherwise(good)
    )
    return table(spark, sf_dir, "customer").select(line.alias("value"))


_SCHEMA = T.StructType().add("id", "long").add("name", "string")
_REASON = """CASE WHEN c_custkey % 11 = 0 THEN 'duplicate_field' WHEN c_custkey % 7 = 0 THEN 'unknown_field' WHEN c_custkey % 5 = 0 THEN 'missing_field' WHEN c_custkey % 13 = 0 THEN 'not_an_object' WHEN c_custkey % 17 = 0 THEN 'wrong_type' END"""


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    _line(spark, sf_dir).write.text(path)
    rows, rejects = S.read_strict_jsonl(spark, path, _SCHEMA)
    return rejects.groupBy("reason").agg(F.count("*").alias("lines")).unionByName(rows.agg(F.lit("kept").alias("reason"), F.count("*").alias("lines")))


QUERIES["s1_read_strict_jsonl"] = (_strict, f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS lines FROM customer GROUP BY 1")


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    wanted = docs.where("lang <> 'en'").select(F.col("doc_id").alias("id")).unionByName(docs.select((-F.col("doc_id") - 1).alias("id")).where("id % 50 = 0"))
    return S.project_table(docs, {"doc_id": "id", "text": "body", "source": "repository"}, "id", wanted, "body", 2000).withColumn("body", F.sha2("body", 256))


QUERIES["s4_project_parquet"] = (
    _projected,
    """SELECT doc_id AS id, CASE WHEN strlen(text) <= 2000 THEN sha256(text) END AS body, source AS repository, strlen(text)::INT AS bytes, strlen(text) > 2000 AS oversize, 'ok' AS state FROM documents WHERE lang <> 'en'
    UNION ALL SELECT -doc_id - 1, NULL, NULL, NULL, false, 'missing' FROM documents WHERE (-doc_id - 1) % 50 = 0""",
)


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is a catalog of its suppliers, in folders of which some are missing."""
    k = F.col("s_suppkey")
    files = table(spark, sf_dir, "supplier").select("s_nationkey", F.struct(F.concat(F.lit("d"), k % 3, F.lit("/f"), k).alias("path"), F.when(k % 5 == 0, "100600").otherwise("100644").alias("mode"), F.lit("blob").alias("type"), F.lower("s_name").alias("sha")).alias("e"))
    folders = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.explode(F.array(*(F.struct(F.lit(f"d{i}").alias("path"), F.lit("040000").alias("mode"), F.lit("tree").alias("type"), F.lit("x").alias("sha")) for i in (0, 1)))).alias("e"))
    both = files.unionByName(folders).groupBy(F.col("s_nationkey").cast("string").alias("sha")).agg(F.collect_list("e").alias("tree"))
    path = _folder(spark)
    both.select("sha", (F.col("sha") == "7").alias("truncated"), "tree").write.option("compression", "gzip").json(path)
    return S.read_tree_catalogs(spark, path).groupBy("catalog", "problem").agg(F.count("*").alias("entries"))


QUERIES["s6_read_tree_catalogs"] = (
    _trees,
    """WITH e AS (SELECT s_nationkey AS c, s_suppkey % 3 AS d, s_suppkey % 5 = 0 AS bad FROM supplier UNION ALL SELECT n_nationkey, 0, false FROM nation, (SELECT unnest([0, 1])))
    SELECT c::VARCHAR AS catalog, CASE WHEN c = 7 THEN 'truncated' WHEN bad THEN 'bad_mode' WHEN d = 2 THEN 'no_parent' END AS problem, count(*) AS entries FROM e GROUP BY ALL""",
)


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    S.write_once(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), path, ["lang"])
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


QUERIES["s8_write_once"] = (_written, "SELECT lang, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
