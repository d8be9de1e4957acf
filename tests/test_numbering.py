import random

from pyspark.sql import functions as F

from hintspark.operators import retrieval as R
from hintspark.plans.numbering import Ordered, numbered_within


def test_places_and_running_sums_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 9), i, rng.choice([None, rng.randint(-5, 5)]), rng.random()) for i in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int, x int, y double").repartition(7)
    ordered = Ordered(frame, [F.col("a").desc(), "b"])
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [tuple(r) for r in ordered.numbered("n").orderBy("n").collect()] == [(*r, i + 1) for i, r in enumerate(want)]
    got = ordered.running({"s": F.col("x"), "t": F.col("y")}).orderBy(F.col("a").desc(), "b").collect()
    total, sum_y = 0, 0.0
    for r, w in zip(got, want):
        total, sum_y = total + (w[2] or 0), sum_y + w[3]
        assert r["s"] == total and abs(r["t"] - sum_y) < 1e-9
    some = ordered.running({"s": F.col("x")}, ordered.rows.where("b % 2 = 0")).orderBy(F.col("a").desc(), "b").collect()
    assert some[-1]["s"] == sum(r[2] or 0 for r in rows if r[1] % 2 == 0) and len(some) == 250
    assert Ordered(frame.limit(0), ["b"]).numbered().count() == 0


def test_places_inside_groups_keep_null_groups(spark):
    rows = [(g, i) for i in range(60) for g in ("hot", "hot", None)] + [("one", 1)]
    frame = spark.createDataFrame([(g, i, n) for n, (g, i) in enumerate(rows)], "g string, i int, n int")
    got = numbered_within(frame, ["g"], ["i", "n"], "at").collect()
    assert len(got) == len(rows)
    for g in ("hot", None, "one"):
        mine = sorted((r["at"], r["i"], r["n"]) for r in got if r["g"] == g)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_complete_orders_and_interleaving_lose_nothing(spark):
    rng = random.Random(2)
    docs = [d * 3 for d in range(40)]
    scored = {q: rng.sample(docs, k) for q, k in ((1, 0), (2, 5), (3, 40), (4, 1))}
    positive = spark.createDataFrame([(q, d, i + 1, 10.0 - i / 9) for q, ds in scored.items() for i, d in enumerate(ds)], "query_id int, doc_id int, rank int, score double")
    queries = spark.createDataFrame([(q,) for q in scored], "query_id int")
    got = R.complete_order(positive, spark.createDataFrame([(d,) for d in docs], "doc_id int"), queries).collect()
    for q, ds in scored.items():
        order = [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert order == ds + [d for d in docs if d not in ds]
    assert R.zero_runs(positive, spark.createDataFrame([(d, i + 1) for i, d in enumerate(docs)], "doc_id int, place long"), queries).where("query_id = 3").count() == 0

    for mode, prefix in (("baseline_first", 0), ("hint_first", 0), ("after_prefix", 4)):
        rows, want = [], {}
        for q in range(30):
            base = rng.sample(range(25), 25)
            hint = rng.sample(range(25), rng.choice([0, 1, 3, 10, 25]))
            rows += [(q, d, i + 1, hint.index(d) + 1 if d in hint else None) for i, d in enumerate(base)]
            out, sides = base[:prefix], [list(base), list(hint)][:: -1 if mode == "hint_first" else 1]
            while len(out) < 25:
                for side in sides:
                    new = next((d for d in side if d not in out), None)
                    out += [] if new is None else [new]
            want[q] = out
        got = R.interleave(spark.createDataFrame(rows, "q int, d int, baseline_rank int, hint_rank int"), "q", "d", mode, prefix).orderBy("q", "rank").collect()
        assert [[r["d"] for r in got if r["q"] == q] for q in want] == list(want.values())
        assert [r["rank"] for r in got] == list(range(1, 26)) * 30
