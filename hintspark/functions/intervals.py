"""Interval templates: a request's and a candidate's direction and bounds, and how far they agree.

A small grammar of complete sentences. What it doesn't know it leaves null, and null never matches or conflicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hintspark.functions.text import once
from hintspark.operators.retrieval import ranked

MOST_BYTES, MOST_WORDS = 512, 32
_LOWER, _UPPER = "(?:x >=? lower|lower <=? x)", "(?:x <=? upper|upper >=? x)"
_FILTER = f"(?:keeping|with) (?:{_LOWER}(?: and {_UPPER})?|{_UPPER}(?: and {_LOWER})?)"
_ORDER = "keys in (?:increasing|decreasing) order"
#: The sentences of requests and candidates, as tokens with one space between.
REQUEST_ALL = rf"^return all {_ORDER}(?: \.)?$"
REQUEST_FILTER = rf"^return {_ORDER}(?: ,)? {_FILTER}(?: \.)?$"
REQUEST_STOP = rf"^return the first two qualifying {_ORDER}(?: ,)? {_FILTER} ; stop the callback after two(?: \.)?$"
_END = "[a-z0-9]+(?: [a-z0-9]+){0,2}"
CANDIDATE = rf"^(ascend|descend)(?: range| less than| less or equal| greater than| greater or equal)? calls the iterator for every value in the tree within the range ([\[(]) ({_END}) , ({_END}) ([\])]) , until iterator returns false(?: \.)?$"


def interval_tokens(text: Column) -> Column:
    """Words, cut at camel case, and signs of a plain ASCII text, in lower case with one space between; null for other texts."""
    cut = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    apart = F.regexp_replace(cut, r"(<=|>=|[^A-Za-z0-9 \t\r\n])", " $1 ")
    plain = F.lower(F.trim(F.regexp_replace(apart, r"[ \t\r\n]+", " ")))
    return F.when(~text.rlike(r"[^\x00-\x7F]"), plain)


def in_bounds(text: Column) -> Column:
    """Whether a text is short enough for the grammar."""
    return (F.octet_length(text) <= MOST_BYTES) & (F.regexp_count(text, F.lit("[A-Za-z0-9]+")) <= MOST_WORDS)


def request_attributes(text: Column) -> Column:
    """struct(direction, lower, upper, can_stop) of a request; all null if it is no known sentence."""
    return once(F.when(in_bounds(text), interval_tokens(text)), _request)


def _request(t: Column) -> Column:
    every, stops = t.rlike(REQUEST_ALL), t.rlike(REQUEST_STOP)
    known = every | stops | t.rlike(REQUEST_FILTER)
    bound = lambda closed, opened: F.when(known, F.when(~every & t.rlike(closed), "closed").when(~every & t.rlike(opened), "open").otherwise("unbounded"))
    return F.struct(
        F.when(known, F.when(t.rlike("keys in increasing"), "ascending").otherwise("descending")).alias("direction"),
        bound("x >= lower|lower <= x", "x > lower|lower < x").alias("lower"),
        bound("x <= upper|upper >= x", "x < upper|upper > x").alias("upper"),
        F.when(stops, True).alias("can_stop"),
    )


def candidate_attributes(text: Column) -> Column:
    """struct(direction, lower, upper, can_stop) of a traversal's comment; a bound that isn't known is null."""
    return once(F.when(in_bounds(text), interval_tokens(text)), lambda t: once(F.struct(t.alias("t"), *(F.regexp_extract(t, CANDIDATE, i).alias(f"p{i}") for i in range(1, 6))), _candidate))


def _candidate(parts: Column) -> Column:
    part = lambda i: parts[f"p{i}"]
    known, down = F.coalesce(part(1) != "", F.lit(False)), part(1) == "descend"
    left, right = (part(3), part(2) == "["), (part(4), part(5) == "]")

    def bound(end: Column, closed: Column, first: str, than: str) -> Column:
        """Of one side, whose extremum is first and whose named bounds begin with than."""
        named = (end == "pivot") | (closed & (end == f"{than} or equal")) | (~closed & (end == f"{than} than"))
        return F.when(closed & (end == first), "unbounded").when(named, F.when(closed, "closed").otherwise("open"))

    lower, upper = ("first", "greater"), ("last", "less")
    return F.struct(
        F.when(known, F.when(down, "descending").otherwise("ascending")).alias("direction"),
        F.when(known, F.when(down, bound(*right, *lower)).otherwise(bound(*left, *lower))).alias("lower"),
        F.when(known, F.when(down, bound(*left, *upper)).otherwise(bound(*right, *upper))).alias("upper"),
        F.when(known, True).alias("can_stop"),
    )


def agreement(request: Column, candidate: Column) -> Column:
    """Eight numbers: match and conflict of direction, lower bound, upper bound and stop."""
    names = ("direction", "lower", "upper", "can_stop")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.array(*(flag(request[n] == candidate[n]) if same else flag(request[n] != candidate[n]) for n in names for same in (True, False)))


def agreement_score(vector: Column) -> Column:
    """Matches less conflicts."""
    return F.aggregate(F.transform(vector, lambda v, i: F.when(i % 2 == 0, v).otherwise(-v)), F.lit(0), lambda a, v: a + v)


def agreement_order(rows: DataFrame, request: str, place: str, score: str) -> DataFrame:
    """A request's few candidates by score, ties in their own order."""
    return ranked(rows, [request], [F.col(score).desc(), F.col(place)])
