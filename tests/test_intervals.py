import pytest
from pyspark.sql import functions as F

from hintspark.functions import intervals as I

REQUESTS = [
    ("Return keys in increasing order keeping x >= lower and x < upper.", ("ascending", "closed", "open", None)),
    ("Return keys in decreasing order keeping lower < x and upper > x", ("descending", "open", "open", None)),
    ("Return keys in increasing order, with x < upper and x >= lower", ("ascending", "closed", "open", None)),
    ("Return keys in decreasing order with upper > x", ("descending", "unbounded", "open", None)),
    ("Return all keys in increasing order.", ("ascending", "unbounded", "unbounded", None)),
    ("Return the first two qualifying keys in decreasing order keeping x > lower; stop the callback after two", ("descending", "open", "unbounded", True)),
    ("RETURN\tKEYS\nIN DECREASING ORDER, KEEPING UPPER >= X AND LOWER < X.\r\n", ("descending", "open", "closed", None)),
    ("Return keys in increasing order", None),
    ("Return keys in increasing order keeping x > lower and x >= lower", None),
    ("Return keys in increasing order keeping x > upper", None),
    ("Return the first two qualifying keys in increasing order keeping x > lower", None),
    ("Return all keys in increasing order, keeping x > lower", None),
    ("Return keys in increasing order keeping x < = upper", None),
    ("Gib alle Schlüssel zurück", None),
    ("Return all keys in increasing order." + " " * 600, None),
    ("", None),
]
CANDIDATES = [
    ("AscendRange", "[pivot, pivot)", ("ascending", "closed", "open", True)),
    ("DescendRange", "[pivot, pivot)", ("descending", "open", "closed", True)),
    ("DescendRange", "[lessOrEqual, greaterThan)", ("descending", "open", "closed", True)),
    ("AscendGreaterThan", "[greaterOrEqual, lessThan)", ("ascending", "closed", "open", True)),
    ("Ascend", "[first, last]", ("ascending", "unbounded", "unbounded", True)),
    ("Descend", "[last, first]", ("descending", "unbounded", "unbounded", True)),
    ("AscendRange", "[last, first]", ("ascending", None, None, True)),
    ("AscendRange", "(first, last]", ("ascending", None, "unbounded", True)),
    ("DescendRange", "[pivot, elsewhere)", ("descending", None, "closed", True)),
    ("DescendRange", "[lessThan, greaterThan)", ("descending", "open", None, True)),
    ("WalkRange", "[pivot, pivot)", None),
    ("AscendRange", "[a b c d, pivot)", None),
    ("AscendRange", "[, pivot)", None),
]


def test_requests_and_candidates(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REQUESTS)], "id int, t string")
    got = {r["id"]: tuple(r["a"]) for r in rows.select("id", I.request_attributes(F.col("t")).alias("a")).collect()}
    assert [got[i] for i in range(len(REQUESTS))] == [w or (None,) * 4 for _, w in REQUESTS]
    text = "{} calls the iterator for every value in the tree within the range {}, until iterator returns false."
    rows = spark.createDataFrame([(i, text.format(m, r)) for i, (m, r, _) in enumerate(CANDIDATES)] + [(99, None)], "id int, t string")
    got = {r["id"]: tuple(r["a"]) for r in rows.select("id", I.candidate_attributes(F.col("t")).alias("a")).collect()}
    assert [got[i] for i in range(len(CANDIDATES))] == [w or (None,) * 4 for *_, w in CANDIDATES] and got[99] == (None,) * 4


@pytest.mark.parametrize(
    ("q", "c", "vector"),
    [
        (("ascending", "closed", "open", True), ("ascending", "closed", "open", True), [1, 0, 1, 0, 1, 0, 1, 0]),
        (("ascending", "closed", "open", None), ("descending", "open", None, True), [0, 1, 0, 1, 0, 0, 0, 0]),
        ((None,) * 4, ("descending", "open", "open", True), [0] * 8),
    ],
)
def test_agreement(spark, q, c, vector):
    kind = "struct<direction:string,lower:string,upper:string,can_stop:boolean>"
    row = spark.createDataFrame([(q, c)], f"q {kind}, c {kind}").select(I.agreement(F.col("q"), F.col("c")).alias("v"))
    got = row.select("v", I.agreement_score(F.col("v"))).first()
    assert got[0] == vector and got[1] == sum(vector[::2]) - sum(vector[1::2])


def test_order_keeps_ties_in_place(spark):
    scores = [4, -2, 0, 0, 4, 0, 2, 0]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "q int, k int, s int")
    assert [r["k"] for r in I.agreement_order(rows, "q", "k", "s").orderBy("rank").collect()] == [0, 4, 6, 2, 3, 5, 7, 1]
