import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hintspark.functions import hashing as H, text as X
from hintspark.operators import evaluation as E, evidence as V, retrieval as R, splits as S, training as T
from hintspark.plans.components import connected_components
from hintspark.streaming import traces


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_identifier_tokens(spark):
    assert one(spark, X.identifier_tokens(F.col("t")), t="parseHTTPRequest2Go fooBar_baz") == ["parse", "http", "request2", "go", "foo", "bar", "baz"]
    assert one(spark, X.words(F.col("t")), t="") == []


def test_declared_name_and_symbols(spark):
    assert one(spark, X.declared_name(F.col("t")), t="x = 1\ndef do_it(a):") == "do_it"
    assert one(spark, X.symbol_tokens(F.col("t")), t="a<=B [c]") == ["a", "<=", "b", "[", "c", "]"]


@pytest.mark.parametrize("text, intent", [("Why is it?", "question"), ("All finished.", "completion_report"), ("not finished, done", "unclear"), ("blockedness", "unclear"), ("I will plan", "planned"), ("완료했", "completion_report")])
def test_rule_intent(spark, text, intent):
    assert one(spark, X.rule_intent(F.col("t")), t=text) == intent


@pytest.mark.parametrize("text, guard, question", [("a ``x?`` b", "", False), ("a `x?` b?", "", True), ("see http://x/?q=1", "", False), ("broken ` here?", "unbalanced_code", None)])
def test_question_cue(spark, text, guard, question):
    got = one(spark, X.question_cue(F.col("t"), F.lit("prose")), t=text)
    assert (got["guard"], got["question"]) == (guard, question)


def test_rule_clauses_swap_on_negation(spark):
    got = one(spark, X.rule_clauses(F.col("t")), t="behavior-v1: if not a < b then x else y; if c then p else q")
    assert [(c["subject"], c["operator"], c["if_true"], c["if_false"]) for c in got] == [("a", "<", "y", "x"), ("c", "", "p", "q")]
    assert one(spark, X.rule_clauses(F.col("t")), t="behavior-v1: whatever") is None


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "alpha alpha beta"), (1, "alpha gamma"), (2, "delta")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "alpha alpha")], "query_id long, text string")
    rows = R.bm25_topk(R.bm25_scores(queries, docs, X.words(F.col("text")), X.words(F.col("text")))).orderBy("rank").collect()
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    want = [idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)), idf * 2.2 / (1 + 1.2 * 1.0)]
    assert [r["doc_id"] for r in rows] == [0, 1]
    assert [r["score"] for r in rows] == pytest.approx(want, abs=1e-9)


def test_interleave_skips_and_bounds(spark):
    base, hint = "ABCD", "ACBD"
    rows = spark.createDataFrame([(1, c, base.index(c) + 1, hint.index(c) + 1) for c in base], "q int, d string, baseline_rank int, hint_rank int")
    assert [r["d"] for r in R.interleave(rows, "q", "d").orderBy("rank").collect()] == list("ACBD")
    orders = list(itertools.permutations(range(4)))
    many = [(q, c, c + 1, o.index(c) + 1) for q, o in enumerate(orders) for c in range(4)]
    got = R.interleave(spark.createDataFrame(many, "q int, d int, baseline_rank int, hint_rank int"), "q", "d").collect()
    assert all(r["rank"] <= 2 * (r["d"] + 1) - 1 for r in got) and len(got) == len(many)


def test_suppress_overlaps(spark):
    rows = spark.createDataFrame([("q", "a", 1, 10, 1), ("q", "a", 4, 12, 2), ("q", "a", 9, 20, 3), ("q", "b", 1, 9, 4)], "q string, path string, start int, end int, rank int")
    assert [r["rank"] for r in R.suppress_overlaps(rows, ["q"], 2).orderBy("rank").collect()] == [1, 3]


def test_components_do_not_depend_on_order(spark):
    edges = [(1, 2), (3, 2), (5, 6), (9, 9), (6, 7), (7, 8)]
    want = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5}
    for some in (edges, edges[::-1], [(b, a) for a, b in edges] * 2):
        got = connected_components(spark.createDataFrame(some, "u long, v long")).collect()
        assert {r["node"]: r["component"] for r in got} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long")
    assert connected_components(chain).select("component").distinct().count() == 1
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_identity_rows(spark):
    rows = spark.createDataFrame([("a", " SAME request ", "1"), ("b", "same\trequest", "2"), ("c", "third", "2"), ("d", "separate", "4"), ("e", None, "")], "id string, request string, commit string")
    got = S.shared_key_components(rows, "id", {"request": X.normalize_query(F.col("request")), "commit": F.col("commit")}).collect()
    assert {r["id"]: r["component"] for r in got} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


@pytest.mark.parametrize("n, want", [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (2, 1, 0)), (4, (2, 1, 1)), (14, (8, 3, 3)), (17, (10, 4, 3)), (19, (11, 4, 4)), (20, (12, 4, 4))])
def test_largest_remainder(spark, n, want):
    row = spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(S.largest_remainder(F.lit(n))))).first()
    assert tuple(row) == want


def test_auc_and_threshold(spark):
    preds = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 2.0), (0, 0.0)], "label int, score double").withColumn("g", F.lit(1))
    levels = E.score_levels(preds, ["g"], "label", "score")
    assert E.auc(levels, ["g"]).first()["auc"] == 0.875
    best = E.best_threshold(levels, ["g"]).first()
    assert (best["threshold"], best["balanced_accuracy"]) == (2.0, 0.75)
    single = E.auc(E.score_levels(preds.where("label = 1"), ["g"], "label", "score"), ["g"]).first()
    assert single["auc"] is None


def test_page_cost_and_budget(spark):
    ranks = spark.createDataFrame([(20, 21), (41, 1), (61, 61)], "a int, b int")
    r = E.page_cost(ranks, "a", "b", F.lit(61), (20,)).first()
    assert (r["baseline_pages"], r["other_pages"], r["baseline_emitted"], r["other_emitted"], r["wins"], r["losses"], r["ties"], r["work"], r["work_wins"], r["work_losses"]) == (8, 7, 141, 121, 1, 1, 1, 14, 1, 2)
    rows = spark.createDataFrame([(41, 1, 4), (1, 21, 3), (41, 1, 2), (41, 1, 1)], "a int, b int, s int")
    r = E.calibrate_budget(rows, "s", "a", "b", 50).first()
    assert (r["threshold"], r["calls"], r["pages"]) == (4, 1, 8)
    tied = spark.createDataFrame([(41, 1, 4), (1, 21, 4), (41, 1, 2), (41, 1, 1)], "a int, b int, s int")
    assert E.calibrate_budget(tied, "s", "a", "b", 25).first()["threshold"] is None


def test_file_measure(spark):
    ranks = spark.createDataFrame([(1, "c", 1), (1, "a", 2), (1, "b", 3)], "task int, item string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "c"), (1, "missing")], "task int, item string")
    r = E.file_measure(ranks, gold, "task", "item").first()
    assert (r["targets"], r["mapped"], r["first_rank"], r["hit_1"], r["all_in_10"], r["reciprocal_rank"]) == (3, 2, 1, True, False, 1.0)


def test_unknown_stays_unknown(spark):
    candidates = spark.createDataFrame([("a", 1), ("b", None), ("c", 0)], "k string, label int")
    reviews = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 1), ("c", 1), ("c", 0)], "k string, verdict int")
    got = {r["k"]: (r["eligible"], r["reasons"]) for r in V.supervision_mask(candidates, reviews, "k").collect()}
    assert got == {"a": (True, []), "b": (False, ["label_unknown"]), "c": (False, ["reviews_inconsistent"])}


def brute_fnv32(data):
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_ngram_features_equal_brute_force():
    text = "Ab 1é 한국 ab"
    low, counts = text.lower(), np.zeros(1024)
    grams = [b"w" + w.encode() for w in ("ab", "1é", "한국", "ab")] + [str(n).encode() + low[i : i + n].encode() for n in (2, 3) for i in range(len(low) - n + 1)]
    for g in grams:
        counts[brute_fnv32(g) % 1024] += 1
    assert np.allclose(H.ngram_features(text), counts / np.linalg.norm(counts))
    assert not H.ngram_features("").any()


def test_cross_features_equal_brute_force():
    q, d = ["a", "b"], ["b", "c", "b"]
    out, terms = np.zeros(8192), lambda w: w + [f"{x}_{y}" for x, y in zip(w, w[1:])]
    for x, y in itertools.product(terms(q), terms(d)):
        h = 14695981039346656037
        for byte in f"{x}\0{y}".encode():
            h = (h ^ byte) * 1099511628211 % 2**64
        out[1 + h % 8191] += (-1 if h >> 63 else 1) / math.sqrt(3 * 5)
    out[0] = 0.5
    assert dict(H.cross_features(q, d)) == pytest.approx({i: out[i] for i in np.flatnonzero(out)})
    assert H.cross_features([], d) == []


def test_softmax_fit_separates_and_round_trips(spark):
    rows = [([{"idx": i % 3, "val": 1.0}], i % 3, 1.0) for i in range(60)]
    data = spark.createDataFrame(rows, "features array<struct<idx:int,val:double>>, label int, weight double")
    w = T.fit_softmax(data, 3, 3, steps=25, rate=0.3)
    got = T.predict(data, ["label"], w, ["0", "1", "2"]).collect()
    assert all(r["intent"] == str(r["label"]) for r in got)
    table = T.coefficients_to_table(spark, "m", "h", w)
    assert np.array_equal(T.table_to_coefficients(table, "m", "h", 3, 3), w)
    tied = T.predict(data, ["label"], np.zeros((3, 4)), ["0", "1", "2"]).first()
    assert tied["intent"] == "unclear"
    with pytest.raises(ValueError):
        T.fit_logistic(data.withColumn("g", F.lit(1)), 3, "g", data.withColumn("g", F.lit(1)))


LINES = [
    ("t", 0, '{"type":"thread.started"}'), ("t", 1, '{"type":"turn.started"}'), ("t", 2, '{"type":"turn.completed","usage":{"input_tokens":10,"cached_input_tokens":4,"output_tokens":5,"reasoning_output_tokens":2}}'),
    ("t", 3, '{"type":"turn.started"}'), ("t", 4, '{"type":"turn.completed","usage":{"input_tokens":20,"cached_input_tokens":5,"output_tokens":5}}'),
    ("f", 0, '{"type":"thread.started"}'), ("f", 1, '{"type":"turn.started"}'), ("f", 2, '{"type":"turn.failed"}'), ("o", 0, '{"type":"thread.started"}'), ("o", 1, '{"type":"turn.started"}'),
    ("u", 0, '{"type":"thread.started"}'), ("u", 1, '{"type":"later"}'), ("b", 0, '{"type":"turn.started"}'), ("x", 0, '{"type":"error","type":"error"}'),
]


def test_trace_summary(spark):
    events = traces.parse_lines(spark.createDataFrame(LINES, "trace string, seq long, line string"))
    assert events.where("code = 'duplicate_key'").count() == 1
    summary = traces.trace_summary(events.where("code IS NULL"), "trace", "seq")
    assert {r["trace"]: r["status"] for r in summary.collect()} == {"t": "completed_turns", "f": "observed_failure", "o": "incomplete", "u": "unknown_controls", "b": "invalid_lifecycle"}
    usage = {r["field"]: (r["observed"], r["missing"], r["total"]) for r in traces.usage_totals(events, summary, "trace").where("trace = 't'").collect()}
    assert usage == {"input_tokens": (30, 0, 30), "cached_input_tokens": (9, 0, 9), "output_tokens": (10, 0, 10), "reasoning_output_tokens": (2, 1, None)}


def test_interleave_ends_on_repeated_ids(spark):
    rows = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 1), (1, 2, 3, None)], "q int, d int, baseline_rank int, hint_rank int")
    assert [r["d"] for r in R.interleave(rows, "q", "d").orderBy("rank").collect()] == [1, 2]
