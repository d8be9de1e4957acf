"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's documents stand in a fixed order; each is expected rate = target / size times, rate
being the same for all its documents. The running sum of expected copies, shifted by one random
offset a source, crosses integers; a document is emitted once for each one it crosses. As the
order goes by size, what is taken stays near the target in words, not only in documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hintspark.plans.shared import SharedTables

#: Words are runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one slice of a size class; a task sorts a few slices at most.
SLICE_ROWS = 100_000
#: Slices whose counts are summed in one order.
SPAN_SLICES = 4_096


def _draw(*parts: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the parts alone."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, target from rows of (source, source_size), one per source.

    Sources in code point order, null last, weigh by the repeated weights and share the total;
    a target stops at cap times its source's size and the excess goes to the others by weight.
    In the order of cap * size / weight the capped sources come first, so one running sum finds
    the level at which the rest stand. The table has one row a source.
    """
    count = len(weights)
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (turn % count + 1).cast("int")).cast("long").alias("w"))
    ranked = ranked.withColumn("most", F.col("source_size") * cap)
    by = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    everything, before = W.partitionBy(), by.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    open_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = ranked.withColumn("at", F.row_number().over(by)).withColumn("level", left / open_w)
    # the first level that its own source can take, in that order
    takes = F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("at", "level"))
    level = level.withColumn("level", F.min(takes).over(everything)["level"])
    return level.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("w")).alias("target"))


def systematic_copies(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies * size) for every row.

    Size is the number of words; null and empty texts have 0, take part in the order, and add
    nothing to what is taken. Copies are cap at most. A null source is a source. Ties of size
    class and draw go by id, then size; repeated rows may get different numbers of copies. An
    empty table gives no rows. Columns of docs with the names given above are replaced.
    """
    given = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    placed = _placed(docs, weights, cap, id_col, text_col, source_col, seed)
    named = {n: F.col(f"__{n}") for n in ("size", "source_size", "target", "copies")}
    return placed.select(*given, *(c.alias(n) for n, c in named.items()), (F.col("__copies") * F.col("__size")).alias("taken"))


def _placed(docs: DataFrame, weights: tuple[int, ...], cap: int, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """docs with __size, __source_size, __target and __copies.

    A source is cut into size classes (its size's length and two leading digits) and these into
    slices of draws, so that a hot source or size is sorted by many tasks. Slices are counted, and
    so are spans of at most SPAN_SLICES of them: running sums go over the spans of a class, the classes
    of a source and the slices of a span, so that no task orders more than a few thousand counts.
    Reruns agree, and so do runs with other numbers of slices.
    """
    slices = max(1, -(-docs.count() // SLICE_ROWS))
    digits = F.col("__size").cast("string")
    keys = ["__source", "__class", "__slice"]
    rows = (
        docs.withColumn("__size", F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long"))
        .withColumn("__source", F.col(source_col))
        .withColumn("__class", F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int"))
        .withColumn("__draw", _draw(seed, F.col(id_col)))
        .withColumn("__slice", F.floor(F.col("__draw") * slices / 2.0**32).cast("int"))
    )
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum")).withColumn("__span", F.floor(F.col("__slice") / SPAN_SLICES).cast("int"))
    counts = SharedTables(docs.sparkSession, "mixing").keep(counts)  # one row a slice; the texts aren't read again for each sum
    spans = counts.groupBy("__source", "__class", "__span").agg(F.sum("__n").alias("__n"), F.sum("__sum").alias("__sum"))
    classes = spans.groupBy("__source", "__class").agg(F.sum("__n").alias("__n"), F.sum("__sum").alias("__sum"))
    sizes = classes.groupBy(F.col("__source").alias("source")).agg(F.sum("__sum").alias("source_size"))
    targets = source_targets(sizes, weights, cap)

    def before(frame: DataFrame, group: list[str], by: str, name: str) -> DataFrame:
        order = W.partitionBy(*group).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        return frame.withColumn(name, F.coalesce(F.sum("__n").over(order), F.lit(0)))

    def joined(left: DataFrame, right: DataFrame, on: list[str], values: list[str]) -> DataFrame:
        other = right.select(*(F.col(k).alias(k + "2") for k in on), *values)
        same = [F.col(k).eqNullSafe(F.col(k + "2")) if k == "__source" else F.col(k) == F.col(k + "2") for k in on]
        return left.join(other, reduce(Column.__and__, same)).drop(*(k + "2" for k in on))

    by_class = before(classes, ["__source"], "__class", "__before_class")
    by_span = before(spans, ["__source", "__class"], "__span", "__before_span")
    by_slice = before(counts, ["__source", "__class", "__span"], "__slice", "__before_slice")
    starts = joined(by_slice, by_span, ["__source", "__class", "__span"], ["__before_span"])
    starts = joined(starts, by_class, ["__source", "__class"], ["__before_class"])
    starts = starts.join(targets, F.col("__source").eqNullSafe(F.col("source"))).select(
        *keys, (F.col("__before_class") + F.col("__before_span") + F.col("__before_slice")).alias("__before"),
        F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        (_draw(seed, "offset", F.col("source")) / 2.0**32).alias("__offset"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"),
    )
    inside = F.row_number().over(W.partitionBy(*keys).orderBy("__draw", id_col, "__size"))
    placed = joined(rows.withColumn("__rank", inside), starts, keys, ["__before", "__source_size", "__target", "__offset", "__rate"])
    rank = F.col("__before") + F.col("__rank")
    crossed = F.floor(F.col("__rate") * rank + F.col("__offset")) - F.floor(F.col("__rate") * (rank - 1) + F.col("__offset"))
    return placed.withColumn("__copies", F.least(crossed, F.lit(cap)).cast("int"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """The rows of docs, each as often as systematic_copies() says, with its columns alone, whatever their names."""
    placed = _placed(docs, weights, cap, id_col, text_col, source_col, seed).where("__copies > 0")
    return placed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
