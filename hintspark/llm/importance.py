"""Target-distribution importance resampling: hashed features, gains by bucket, Gumbel scores, exact draw.

A feature is a run of words, hashed into a bucket. A bucket's gain says how much more of the target's
features than of the documents' fall into it; a document weighs the mean gain of its features. Gumbel
noise keyed by doc_id turns the highest scores into a draw without replacement. How many rows are drawn
is exact: the cutoff is found by bisection, a count job a step, never by sorting all rows in one place.

Nulls: a null text has no features; a null doc_id hashes like an empty one and follows all others among
equal scores. Rows that repeat a doc_id are drawn each for itself. An empty table gives no rows, an empty
target even gains. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hintspark.plans.shared import SharedTables, arrow_rows

#: The feature words' letters: all but ASCII characters that are no digit or lower-case letter.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def feature_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def feature_buckets(words: Column, longest: int, buckets: int) -> Column:
    """Bucket of every run of 1 to longest consecutive words, joined by one space."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(F.transform(words, bucket), *(runs(n) for n in range(2, longest + 1)))


def bucket_totals(rows: DataFrame, buckets: int, column: str = "buckets") -> np.ndarray:
    """How many features each bucket holds; at most one number a bucket reaches the driver."""
    counted = rows.select(F.explode(column).alias("bucket")).groupBy("bucket").count()
    out = np.zeros(buckets)
    for r in counted.collect():
        out[r["bucket"]] = r["count"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) of every bucket."""
    n = len(source)
    ratio = (target + 1.0) * (source.sum() + n) / ((source + 1.0) * (target.sum() + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray, keep: list[str], column: str = "buckets") -> DataFrame:
    """keep, n_features and weight: an array of gains is read at the whole batch's buckets at once."""
    given = rows.select(*keep, column)
    out = given.drop(column).withColumns({"n_features": F.lit(0).cast("long"), "weight": F.lit(0).cast("long")}).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[flat])])
            total, n = np.diff(sums[ends - ends[0]]), np.diff(ends).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=[f.name for f in out])

    return given.mapInArrow(score, out)


def gumbel(key: Column, seed: str = "2024") -> Column:
    """floor(-1000 * ln(-ln(u))), u being a key's hash between 0 and 1."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def cutoff(rows: DataFrame, order: list[str], wanted: int) -> tuple[Column, list[int]]:
    """A condition that exactly wanted of the rows meet, the first in an order of whole-number columns.

    rows should be a stored table; order must tell all rows apart. Column by column, a threshold is
    bisected: each step is one job that counts the rows up to it. Rows tied at the threshold are then
    parted by the next column. Nothing is sorted, and only counts reach the driver.
    """
    before, tied, found = F.lit(False), F.lit(True), []
    if wanted <= 0:
        return before, found
    for name in order:
        least, most, n = rows.where(tied).agg(F.min(name), F.max(name), F.count("*")).first()
        if wanted >= n:
            return before | tied, found
        below = 0
        while least < most:  # the least value up to which there are as many rows as wanted, and how many lie below it
            middle = (least + most) // 2
            upto = rows.where(tied & (F.col(name) <= middle)).count()
            if upto >= wanted:
                most = middle
            else:
                least, below = middle + 1, upto
        before = before | (tied & (F.col(name) < least))
        wanted -= below
        tied = tied & (F.col(name) == least)
        found.append(least)
    return before | tied, found


def with_ranks(rows: DataFrame, order: list[str], tables: SharedTables, name: str = "rank") -> DataFrame:
    """rows with their place in an order, counted from 1: ranges are sorted each for itself, and a range's
    place among the others is added."""
    place = F.monotonically_increasing_id()
    placed = tables.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place))
    sizes = placed.groupBy(F.shiftright("__place", 33).alias("__range")).count().orderBy("__range").collect()
    starts, total = [], 0
    for r in sizes:  # a number for each range
        starts.append((r["__range"], total))
        total += r["count"]
    ranges = rows.sparkSession.createDataFrame(starts, "__range long, __start long")
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(ranges), F.shiftright("__place", 33) == F.col("__range")).withColumn(name, F.col("__start") + inside + 1).drop("__place", "__range", "__start")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    percent of the documents with at least least_words words are drawn. Buckets of all texts are
    written to the shared folder once; counts, weights and the draw read them there.
    """
    tables = SharedTables(docs.sparkSession, "importance")

    def hashed(rows: DataFrame, *keep: Column) -> DataFrame:
        return rows.select(*keep, feature_words(F.col("text")).alias("words")).select("*", feature_buckets(F.col("words"), longest, buckets).alias("buckets"))

    own = hashed(docs, F.col("doc_id"))
    stored = tables.keep(own.select("doc_id", F.size("words").alias("words"), "buckets", F.monotonically_increasing_id().alias("row")))
    gain = gains(bucket_totals(stored, buckets), bucket_totals(hashed(target), buckets))
    with arrow_rows(docs.sparkSession, 1000):
        weighed = weigh(stored, gain, ["doc_id", "words", "row"])
        scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumns({"down": -F.col("score"), "unnamed": F.col("doc_id").isNull().cast("int"), "id": F.coalesce("doc_id", F.lit(0))})
        kept = tables.keep(scored.withColumn("enough", F.col("words") >= least_words))
    tables.drop(stored)
    order = ["down", "unnamed", "id", "n_features", "row"]
    able = kept.where("enough")
    drawn, _ = cutoff(able, order, able.count() * percent // 100)
    names = ["doc_id", "n_features", "weight", "score"]
    chosen = with_ranks(able.where(drawn).select(*names, *(c for c in order if c not in names)), order, tables)
    rest = kept.where(~(F.col("enough") & drawn)).select(*names, F.lit(None).cast("long").alias("rank"))
    return chosen.select(*names, "rank").unionByName(rest)
