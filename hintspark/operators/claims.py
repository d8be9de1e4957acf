"""Features of a query and of its ranking, by which a selector decides whether to call a helper.

ranked: (query_id, id, rank, score) of the documents with a score; documents: how many the whole catalog has.
A ranking is complete, so where fewer have a score the first places are filled up by documents of score zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hintspark.functions import text as X

MOST_WORDS, MOST_BYTES, TOP, SPREAD = 64, 8192, 10, 20
#: The features' names in their order.
SHAPE = ("bias", "query_words", "query_bytes", "uppercase_fraction", "digit_fraction", "underscore_fraction", "camel_boundaries_per_word", "unique_word_fraction")
SCORES = ("top_score_squashed", "top_two_gap_squashed", "top_ten_positive_fraction", "positive_catalog_fraction")
SPREADS = ("top20_relative_mean", "top20_relative_stddev", "top20_first_score_share", "top20_last_first_ratio")
COVERAGES = ("first_query_term_coverage", "top20_mean_query_term_coverage", "top20_stddev_query_term_coverage", "query_vocabulary_absent_fraction")


def _none(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def query_shape(text: Column) -> dict[str, Column]:
    """The first eight features, of the query's text alone."""
    words, chars = F.size(X.words(text)), F.length(text)
    count = lambda p: F.regexp_count(text, F.lit(p))
    values = (
        F.lit(1.0), F.least(words / MOST_WORDS, F.lit(1.0)), F.least(F.octet_length(text) / MOST_BYTES, F.lit(1.0)), F.try_divide(count(r"\p{Lu}"), chars), F.try_divide(count(r"\p{Nd}"), chars), F.try_divide(count("_"), chars),
        F.least(F.try_divide(count(r"[\p{Ll}\p{Nd}]\p{Lu}"), words), F.lit(1.0)), F.try_divide(F.size(F.array_distinct(X.words(text))), words),
    )
    return {n: _none(v) for n, v in zip(SHAPE, values)}


def search_claim_features(queries: DataFrame, ranked: DataFrame, documents: int, query_id: str = "query_id") -> DataFrame:
    """query_id and twelve features between 0 and 1: the query's shape, and its scores' size, gap and extent."""
    at = lambda r: _none(F.max(F.when(F.col("rank") == r, F.col("score"))))
    scores = ranked.where("score > 0").groupBy(query_id).agg(at(1).alias("__top"), at(2).alias("__second"), F.count_if(F.col("rank") <= TOP).alias("__ten"), F.count("*").alias("__positive"))
    top, second = _none(F.col("__top")), _none(F.col("__second"))
    values = (top / (1 + top), (top - second) / (1 + top), _none(F.col("__ten")) / min(TOP, documents), _none(F.col("__positive")) / documents)
    joined = queries.select(query_id, *(c.alias(n) for n, c in query_shape(F.col("text")).items())).join(scores, query_id, "left")
    return joined.select(query_id, *SHAPE, *(v.alias(n) for n, v in zip(SCORES, values)))


def _filled(sums: DataFrame, query_id: str, n: int, total: str, squares: str) -> tuple[Column, Column]:
    """Mean and deviation of n values, of which those without a row are zero."""
    mean = _none(F.col(total)) / n
    return mean, F.sqrt(F.greatest(_none(F.col(squares)) / n - mean * mean, F.lit(0.0)))


def score_spread(queries: DataFrame, ranked: DataFrame, documents: int, query_id: str = "query_id") -> DataFrame:
    """query_id and four features of the first twenty scores relative to the first."""
    n = min(SPREAD, documents)
    first = ranked.where("score > 0 AND rank = 1").select(query_id, F.col("score").alias("__first"))
    v = F.col("score") / F.col("__first")
    some = ranked.where((F.col("score") > 0) & (F.col("rank") <= n)).join(first, query_id)
    sums = some.groupBy(query_id).agg(F.sum(v).alias("__s"), F.sum(v * v).alias("__q"), F.max(F.when(F.col("rank") == n, v)).alias("__last"))
    mean, deviation = _filled(sums, query_id, n, "__s", "__q")
    values = (mean, deviation, F.try_divide(F.lit(1.0), F.col("__s")), F.col("__last"))
    return queries.select(query_id).join(sums, query_id, "left").select(query_id, *(_none(c).alias(name) for name, c in zip(SPREADS, values)))


def query_coverage(queries: DataFrame, ranked: DataFrame, docs: DataFrame, documents: int, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """query_id and four features: how much of the query's vocabulary its first twenty documents have, and how much no document has."""
    n = min(SPREAD, documents)
    asked = queries.select(query_id, F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))
    wanted = asked.groupBy(query_id).agg(F.count("*").alias("__terms"))
    have = docs.select(id_col, F.array_distinct(X.words(F.col("text"))).alias("terms"))
    known = have.select(F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").distinct()
    found = asked.join(known, "term", "left_semi").groupBy(query_id).agg(F.count("*").alias("__known"))
    own = queries.select(query_id, F.array_distinct(X.words(F.col("text"))).alias("want"))
    top = ranked.where((F.col("score") > 0) & (F.col("rank") <= n)).select(query_id, id_col, "rank").join(have, id_col).join(own, query_id)
    share = F.size(F.array_intersect("want", "terms")) / F.size("want")
    sums = top.groupBy(query_id).agg(F.sum(share).alias("__s"), F.sum(share * share).alias("__q"), F.max(F.when(F.col("rank") == 1, share)).alias("__first"))
    mean, deviation = _filled(sums, query_id, n, "__s", "__q")
    absent = 1 - _none(F.col("__known")) / F.col("__terms")
    joined = queries.select(query_id).join(wanted, query_id, "left").join(found, query_id, "left").join(sums, query_id, "left")
    return joined.select(query_id, *(_none(c).alias(name) for name, c in zip(COVERAGES, (F.col("__first"), mean, deviation, absent))))


def path_claim_features(queries: DataFrame, ranked: DataFrame, documents: int, query_id: str = "query_id") -> DataFrame:
    """query_id, the sixteen features of the search claim and the spread, and whether all lie between 0 and 1."""
    both = search_claim_features(queries, ranked, documents, query_id).join(score_spread(queries, ranked, documents, query_id), query_id)
    names = (*SHAPE, *SCORES, *SPREADS)
    right = F.forall(F.array(*names), lambda v: v.between(0, 1))
    return both.select(query_id, *names, right.alias("in_range"))
