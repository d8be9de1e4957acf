from hintspark.operators import families as M


def test_draws_of_the_bootstrap_are_not_broadcast(spark):
    """Before, a side of the join, by its size before the replicates, was gathered on the driver."""
    rows = spark.range(600).selectExpr("id div 3 AS lineage", "CASE WHEN id div 3 % 3 = 0 THEN 'a' ELSE 'b' END AS stratum", "id % 21 - 10 AS x")
    found = M.lineage_bootstrap(rows, "lineage", "stratum", "x", {"a": 2, "b": 1}, 50)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    r = found.first()
    assert r["replicates"] == 50 and r["low"] < r["high"]
