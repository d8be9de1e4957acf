import pytest
from pyspark.sql import functions as F

pytest.importorskip("hintspark.llm")
import corpus_pipeline  # noqa: E402
from hintspark.llm import queries as llm  # noqa: E402
from oracle import connect, duck_rows, spark_rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_equals_its_sql(spark, name):
    assert spark_rows(llm.queries()[name](spark, SF)) == duck_rows(connect(SF), llm.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in llm.queries() if n not in llm.oracle_sql()])
def test_one_row_or_more_for_every_row(spark, name):
    table, key = {"op5_html_text": ("pages", "page_id"), "op13_conversations": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
    got = llm.queries()[name](spark, SF).select(key).distinct()
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        if name in ("toxicity", "minhash_near_dedup"):
            assert 0 < after.count() < before.count() and after.join(docs, columns, "left_anti").count() == 0
        if name == "pii":
            numbers = lambda f: {r[0] for r in f.select(F.explode(F.expr(r"regexp_extract_all(text, '\\+1 \\(\\d{3}\\) 555-\\d{4}', 0)"))).collect()}
            assert after.count() == before.count() and numbers(before) and not numbers(before) & numbers(after)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
