"""Quality rules with thresholds that follow the data.

Each language and source gets mergeable quantile sketches of four ratios of its documents; a
document is joined to the thresholds of its group and dropped if a ratio lies far outside. Three
of the ratios are zero in most texts; there the sketch's share of zeros gives the rate of chance
events, and a document may have as many as its length makes likely at that rate. A
sketch counts values in bins whose bounds grow by a constant factor, so that a quantile is off by a
thousandth of itself at most; sketches merge by adding counts, in any order, to the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from hintspark.plans.shared import SharedTables, arrow_rows

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"
_POWERS = np.random.default_rng(11).integers(1, 2**63, WINDOW, np.uint64) | np.uint64(1)

#: Counts and what they are counted in: a ratio's events come by chance as often as the group's texts without any show.
#: An event is a symbol, a repeated line, or a repeat of one window, which covers two of them.
COUNTS = {"symbol_ratio": ("n_symbols", "word_chars", 1), "dup_line_ratio": ("n_dup_lines", "n_lines", 1), "repeat_ratio": ("n_repeat_words", "n_words", 2 * WINDOW)}
#: Ratios of a document, as SQL over its metrics.
RATIOS = {**{r: f"try_divide({count}, {size})" for r, (count, size, _) in COUNTS.items()}, "word_length": "try_divide(word_chars, n_words)"}
SIZES = {f"size of {r}": size for r, (_, size, _) in COUNTS.items()}
#: Bounds of a sketch's bins grow by this factor.
GROWTH = 1.002
#: How far from the median the outer quantiles' distance is taken.
REACH = 4
#: Standard deviations, of variance-stabilised counts, that chance may reach.
CHANCE = 2.5


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found at least twice, the first find included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) > len(words) - WINDOW:  # too few repeats of words for a repeated window
        return 0
    hashed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashed += (ids[k : k + n] + np.uint64(1)) * _POWERS[k]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    if not same.any():
        return 0
    maybe = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[maybe]
    _, which, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    starts = maybe[counts[which.reshape(-1)] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip(_WHITE)]
    return len(lines), len(lines) - len(set(lines))


def text_metrics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text_col: str = "text") -> DataFrame:
    """The columns in keep with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Words are runs of anything but the six ASCII white space characters; null texts have none.
    Whole texts are read, whatever their length. Repeated rows give repeated rows.
    """
    numbers = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    given = docs.select(*keep, F.col(text_col).cast("binary").alias("__text"))
    schema = T.StructType([*given.drop("__text").schema.fields, *(T.StructField(n, T.LongType()) for n in numbers)])
    symbols = [s.encode() for s in SYMBOLS]

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = [[] for _ in numbers]
            for value in part.column(len(keep)):
                text = value.as_py() or b""
                words = text.split()
                joined = b"".join(words)
                chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
                row = len(words), chars, sum(map(joined.count, symbols)), *duplicate_lines(text), repeated_words(words)
                for column, number in zip(columns, row):
                    column.append(number)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return given.mapInArrow(measure, schema)


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, ratio, bin, n: how many rows of a group have a ratio, or a ratio's size, in a bin; bin is null for 0.

    Counts are partial sums before they are shuffled, so a hot group costs a few thousand rows a
    task. Ratios that are null (of texts without words) are not counted.
    """
    values = F.array(*(F.struct(F.lit(r).alias("ratio"), F.expr(sql).cast("double").alias("value")) for r, sql in {**RATIOS, **SIZES}.items()))
    rows = metrics.select("lang", "source", F.explode(values).alias("v")).where("v.value IS NOT NULL")
    number = F.ceil(F.ln(F.col("v.value")) / float(np.log(GROWTH))).cast("int")
    return rows.groupBy("lang", "source", F.col("v.ratio").alias("ratio"), F.when(F.col("v.value") > 0, number).alias("bin")).agg(F.count("*").alias("n"))


def merged(sketched: DataFrame, *keys: str) -> DataFrame:
    """Sketches of the groups that keys name, as sums of finer ones."""
    return sketched.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))


def fences(sketched: DataFrame, *keys: str) -> DataFrame:
    """keys, ratio, rows, none, median, low and high: what lies outside is far from the group's other values.

    high is the upper quartile plus four times the distance from the median to the 90th percentile,
    low the lower quartile less four times that from the 10th percentile to the median. A quartile
    stands for the outer bound of its bin, so that values that tie with it lie inside. A ratio whose
    median is 0 has a high of 0: its limit comes from chance alone. none counts the zeros.
    """
    group = W.partitionBy(*keys, "ratio")
    counted = sketched.withColumn("rows", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy(F.col("bin").asc_nulls_first())))
    upper = F.coalesce(F.pow(F.lit(GROWTH), F.col("bin")), F.lit(0.0))
    lower = upper / GROWTH

    def quantile(q: float, value: Column) -> Column:
        return F.min(F.when(F.col("upto") >= F.ceil(F.col("rows") * q), value))

    parts = {"q10": (0.1, lower), "l25": (0.25, lower), "q50": (0.5, lower), "u75": (0.75, upper), "q90": (0.9, lower)}
    none = F.coalesce(F.max(F.when(F.col("bin").isNull(), F.col("n"))), F.lit(0))
    found = counted.groupBy(*keys, "ratio").agg(F.first("rows").alias("rows"), none.alias("none"), *(quantile(*v).alias(n) for n, v in parts.items()))
    low = F.col("l25") * (1 - 1e-9) - REACH * (F.col("q50") - F.col("q10"))
    high = F.when(F.col("q50") > 0, F.col("u75") * (1 + 1e-9) + REACH * (F.col("q90") - F.col("q50"))).otherwise(0.0)
    return found.select(*keys, "ratio", "rows", "none", F.col("q50").alias("median"), low.alias("low"), high.alias("high"))


def chance_limit(events: Column) -> Column:
    """The most events that chance brings where it brings so many on average (as for Poisson counts)."""
    return F.pow(F.sqrt(events + 0.375) + CHANCE / 2, 2) - 0.375


def thresholds(metrics: DataFrame, least_rows: int = 200) -> DataFrame:
    """lang, source, the highest value of each ratio that passes there, the rate of its events by chance, and the least word length.

    The rate is that at which the group has its share of documents without events, given their median
    size; how many events the others have doesn't count. A group of fewer than least_rows documents
    takes the thresholds of its language, or of all if these are few too.
    """
    tables = SharedTables(metrics.sparkSession, "quality")
    sketched = tables.keep(sketches(metrics))
    held = ("rows", "none", "median", "low", "high")
    named = lambda frame, level, *keys: frame.select(*(F.col(k).alias(f"{level}_{k}") for k in (*keys, "ratio", *held)))
    own = named(fences(sketched, "lang", "source"), "own", "lang", "source")
    langs = named(fences(merged(sketched, "lang"), "lang"), "lang", "lang")
    every = named(fences(merged(sketched)), "all")  # a row for each ratio and size
    both = own.join(langs, F.col("own_lang").eqNullSafe(F.col("lang_lang")) & (F.col("own_ratio") == F.col("lang_ratio")))
    both = both.join(F.broadcast(every), F.col("own_ratio") == F.col("all_ratio"))
    taken = lambda side: F.when(F.col("own_rows") >= least_rows, F.col(f"own_{side}")).when(F.col("lang_rows") >= least_rows, F.col(f"lang_{side}")).otherwise(F.col(f"all_{side}"))
    of = lambda r, side: F.max(F.when(F.col("own_ratio") == r, taken(side)))
    rate = lambda r: -F.log((of(r, "none") + 0.5) / (of(r, "rows") + 1)) / F.greatest(of(f"size of {r}", "median"), F.lit(1.0))
    limits = [*(of(r, "high").alias(f"most_{r}") for r in RATIOS), *(rate(r).alias(f"rate_{r}") for r in COUNTS), of("word_length", "low").alias("least_word_length")]
    return both.groupBy(F.col("own_lang").alias("lang"), F.col("own_source").alias("source")).agg(*limits)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source, the metrics, the ratios' thresholds, base_failed and kept for every row.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated windows. Such rows, as
    those of null and empty texts, aren't kept and don't shape the thresholds. Null languages and
    sources are groups of their own. Repeated rows are judged alike; an empty table gives no rows.
    Other columns of docs, whatever their names, play no part. The metrics are written once to the
    shared folder, as are the thresholds. Reruns agree, whatever the partitions.
    """
    spark = docs.sparkSession
    tables = SharedTables(spark, "quality")
    named = docs.select(F.col(id_col), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    with arrow_rows(spark, 1000):
        metrics = tables.keep(text_metrics(named, (id_col, "lang", "source"), text_col).withColumn("base_failed", failed))
    limits = tables.keep(thresholds(metrics.where("NOT base_failed")))
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = metrics.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    good = F.expr(RATIOS["word_length"]).between(F.col("least_word_length"), F.col("most_word_length"))
    for r, (count, size, unit) in COUNTS.items():
        good = good & (F.col(count) <= F.greatest(F.col(f"most_{r}") * F.col(size), unit * chance_limit(F.col(f"rate_{r}") * F.col(size))))
    return joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(good))
