import random

import duckdb
from pyspark.sql import functions as F

from hintspark.functions import text as X
from hintspark.operators import retrieval as R


def test_scores_are_rounded_as_sql_does(spark):
    duck = duckdb.connect()
    values = [8.3176125, 16.1353345, 4.0582375, 2.0341015, 16.6577365, 0.0, 1.0000005, 3.25]
    asked = ", ".join(f"({v}::DOUBLE)" for v in values)
    wanted = duck.execute(f"SELECT v, round(v, 6) FROM (VALUES {asked}) t(v)").fetchall()
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", R.rounded(F.col("v"), 6)).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_bm25_blocks_lose_no_pair_and_part_no_copies(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_DOCS", 7)
    monkeypatch.setattr(R, "BLOCK_QUERIES", 2)
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [[draw.choice(vocabulary) for _ in range(draw.randrange(1, 40))] for _ in range(40)]
    texts = [t for text in texts for t in (text, draw.sample(text, len(text)), [], None)]  # copies in another order, empty texts
    asked = [(q, draw.sample([*vocabulary, "none"], 12) * 2, c) for q in range(5) for c in ("a", "b")]
    docs = spark.createDataFrame([(i, t, "ab"[i // 4 % 2]) for i, t in enumerate(texts)] + [(7, ["w1", "w2"], "a")], "doc_id long, terms array<string>, c string").repartition(5)
    queries = spark.createDataFrame(asked + [(9, ["w1"], None)], "query_id int, terms array<string>, c string")
    duck = duckdb.connect()
    duck.register("d", docs.toPandas())
    duck.register("q", queries.toPandas())
    from hintspark.queries.retrieval import bm25_sql

    sql = bm25_sql("SELECT * FROM q", "SELECT * FROM d", "doc_id", "c")
    wanted = sorted(duck.execute(f"WITH {sql} SELECT c, query_id, doc_id, score FROM scores").fetchall())
    scored = R.bm25_scores(queries, docs, F.col("terms"), F.col("terms"), catalog=("c",))
    got = sorted((r["c"], r["query_id"], r["doc_id"], r["score"]) for r in scored.collect())
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    assert all(abs(g[3] - w[3]) < 2e-9 for g, w in zip(got, wanted))
    copies = {(q, d): s for _, q, d, s in got}
    assert all(copies[q, d] == copies[q, d + 1] for q, d in copies if d % 4 == 0 and d not in (4, 7))
    best = R.bm25_scores(queries, docs, F.col("terms"), F.col("terms"), catalog=("c",), best=3)
    first = lambda rows: sorted(map(tuple, R.ranked(rows, ["c", "query_id"], [F.col("score").desc(), "doc_id"], 3).collect()))
    assert first(best) == first(scored) and best.count() < len(wanted)
    extent = R.bm25_extent(queries, docs, F.col("terms"), F.col("terms"), catalog=("c",)).groupBy("c").agg(F.sum("pairs"), F.max("best")).orderBy("c").collect()
    assert [tuple(r) for r in extent] == [(c, sum(w[0] == c for w in wanted), max(g[3] for g in got if g[0] == c)) for c in "ab"]


def test_bm25_pairs_are_not_shuffled(spark):
    """Before, every pair of a query and a document with a common term was an exchanged row."""
    docs = spark.createDataFrame([(i, f"a b c{i}") for i in range(50)], "doc_id long, text string")
    queries = docs.withColumnRenamed("doc_id", "query_id").limit(20)
    scores = R.bm25_scores(queries, docs, X.words(F.col("text")), X.words(F.col("text")))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan.split("\n")[1] + plan.split("\n")[0]
    assert scores.count() == 20 * 50


def test_first_by_digest_leaves_nothing_out(spark):
    """Before, all rows were sorted by their digests to find a few."""
    sizes = {1: 5000, 2: 3, 3: 24}
    rows = spark.createDataFrame([(q, d) for q, n in sizes.items() for d in range(n)], "q int, d int").repartition(4)
    digest = F.sha2(F.col("d").cast("string"), 256)
    first = lambda frame: sorted(tuple(r) for r in frame.select("q", "d", "rank").collect())
    assert first(R.first_by_digest(rows, ["q"], digest, 24)) == first(R.ranked(rows, ["q"], [digest], 24))


def test_spread_reads_as_many_places_as_it_needs(spark, monkeypatch):
    """Before, every pair was ranked and stored for the first twenty places."""
    from hintspark.queries import models

    asked, scores = [], models._scores
    monkeypatch.setattr(models, "_scores", lambda s, d, best=None: asked.append(best) or scores(s, d, best))
    for name in ("f8_score_spread", "f9_coverage", "r16_linear_rerank"):
        models.QUERIES[name][0](spark, "/root/testdata/sf0.001")
    assert asked == [20, 20, 8]
