"""Training of linear heads as Spark jobs, their use, and choices between trials.

Each step of a fit is one job: tasks sum the gradient of their rows, the sums meet in an
aggregate, and only the coefficients (classes times bins numbers) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hintspark.functions.vectors import softmax
from hintspark.operators.heads import _gathered, _times, sparse


#: Rows whose features are held at once.
LOT = 2048


def _lots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, len(part), LOT):
            yield part.slice(at, LOT)


def _logits(features: tuple, w: np.ndarray, rows: int) -> np.ndarray:
    return _times(features, w[:, :-1].T, rows) + w[:, -1]


def _ternary(w: np.ndarray) -> np.ndarray:
    size = np.abs(w[:, :-1])
    least = 0.7 * size.mean(1, keepdims=True)
    kept = size >= least
    scale = np.where(kept, size, 0).sum(1, keepdims=True) / np.maximum(1, kept.sum(1, keepdims=True))
    return np.hstack([np.sign(w[:, :-1]) * kept * scale, w[:, -1:]])


def fit_softmax(rows: DataFrame, classes: int, bins: int, steps: int = 30, rate: float = 0.1, decay: float = 1e-4, ternary: bool = False, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (classes, bins + 1) of a cross-entropy head by full-batch AdamW.

    rows: (features, label, weight); label is a class number. The bias, the last column, doesn't
    decay. With ternary, gradients are taken at the ternary coefficients and applied to the whole
    ones. start warms up with given coefficients. Rows are read once a step, so cache them.
    """
    w = np.zeros((classes, bins + 1)) if start is None else start.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    given = rows.select("features", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"))
    for step in range(1, steps + 1):
        used = _ternary(w) if ternary else w

        def gradient(parts: Iterator[pa.RecordBatch], used: np.ndarray = used) -> Iterator[pa.RecordBatch]:
            total, weight = np.zeros(used.shape), 0.0
            for part in _lots(parts):
                x, label, weights = sparse(part.column(0)), part.column(1).to_numpy(), part.column(2).to_numpy()
                z = _logits(x, used, len(part))
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), label] -= 1
                p *= weights[:, None]
                total[:, :-1] += _gathered(x, p, bins).T
                total[:, -1] += p.sum(0)
                weight += weights.sum()
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(total.size + 1), pa.int32()), "value": np.append(total.ravel(), weight)})

        sums = given.mapInArrow(gradient, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")["value"].to_numpy()
        if not len(sums) or not sums[-1]:
            break
        g = sums[:-1].reshape(w.shape) / sums[-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w[:, :-1] *= 1 - rate * decay
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return _ternary(w) if ternary else w


def fit_logistic(train: DataFrame, bins: int, group: str | None = None, validation: DataFrame | None = None, **how) -> np.ndarray:
    """A two-class head as one row of differences; groups that are in both frames are refused."""
    if group and validation is not None and train.select(group).intersect(validation.select(group)).head(1):
        raise ValueError("a group is in both training and validation rows")
    w = fit_softmax(train, 2, bins, **how)
    return (w[1] - w[0])[None, :]


def coefficients_to_table(spark, model_id: str, head: str, w: np.ndarray) -> DataFrame:
    """(model_id, head, class, idx, value) rows of nonzero coefficients; idx of the bias is the last."""
    rows = [(model_id, head, int(c), int(i), float(w[c, i])) for c, i in zip(*np.nonzero(w))]
    return spark.createDataFrame(rows, "model_id string, head string, class int, idx int, value double")


def table_to_coefficients(table: DataFrame, model_id: str, head: str, classes: int, bins: int) -> np.ndarray:
    w = np.zeros((classes, bins + 1))
    for r in table.where((F.col("model_id") == model_id) & (F.col("head") == head)).collect():
        w[r["class"], r["idx"]] = r["value"]
    return w


def predict(rows: DataFrame, keep: list[str], w: np.ndarray, names: list[str], unclear: str = "unclear", temperature: float = 1.0, confidence: float = 0.0, margin: float = 0.0) -> DataFrame:
    """keep with probabilities, intent, confidence and margin; unclear if gates fail or classes tie.

    The features meet the coefficients in a numpy helper; everything after the logits is an
    expression.
    """
    given = rows.select(*keep, "features")
    from pyspark.sql import types as T

    out = given.drop("features").schema.add("logits", T.ArrayType(T.DoubleType()))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _lots(parts):
            z = _logits(sparse(part.column(len(keep))), w, len(part))
            ends = np.arange(len(part) + 1, dtype=np.int32) * len(w)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=[*keep, "logits"])

    scored = given.mapInArrow(score, out).withColumn("probabilities", softmax(F.transform("logits", lambda z: z / temperature)))
    order = F.sort_array("probabilities", asc=False)
    top, second = F.get(order, 0), F.get(order, 1)
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("probabilities", top).cast("int"))
    passes = (top >= confidence) & (top - second >= margin) & (top > second)
    return scored.select(*keep, "probabilities", F.when(passes, best).otherwise(unclear).alias("intent"), top.alias("confidence"), (top - second).alias("margin"))


def temperature_grid(rows: DataFrame, logits: str, label: str, low: int = 5, high: int = 50) -> DataFrame:
    """(temperature, nll) for temperatures low / 10 to high / 10; label is a class number."""
    grid = rows.select(logits, label, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("t")).withColumn("temperature", F.col("t") / 10)
    p = F.get(softmax(F.transform(F.col(logits), lambda z: z / F.col("temperature"))), F.col(label))
    return grid.groupBy("temperature").agg(F.round(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))), 6).alias("nll"))


def select_candidate(trials: DataFrame, order: list[Column]) -> DataFrame:
    """The first trial in an order."""
    return trials.orderBy(*order).limit(1)


def cost_labels(gain: Column, penalty: float, scale: float = 1.0) -> Column:
    """struct(label, weight): whether a gain beats the penalty, and by how much either way."""
    net = gain - penalty
    return F.struct((net > 0).cast("int").alias("label"), (F.abs(net) / scale).alias("weight"))


def ranking_pairs(rows: DataFrame, parent: str, item: str, label: str) -> DataFrame:
    """(parent, better, worse, weight): pairs of a positive and a negative of a parent, of which there are
    a few; weights are equal inside a parent and add up to one over all eligible parents."""
    good = rows.where(F.col(label) == 1).select(parent, F.col(item).alias("better"))
    bad = rows.where(F.col(label) == 0).select(parent, F.col(item).alias("worse"))
    pairs = good.join(bad, parent)
    count = pairs.groupBy(parent).agg(F.count("*").alias("pairs"))
    parents = count.agg(F.count("*").alias("parents"))
    return pairs.join(count, parent).join(F.broadcast(parents)).select(parent, "better", "worse", (1 / F.col("pairs") / F.col("parents")).alias("weight"))


def _cuts(rows: DataFrame, node: str, features: list[str], target: str, least: int) -> DataFrame:
    """(node, feature, x, next, gain, left) of every cut between two values of a feature inside a node.

    Rows become sums by node, feature and value first; the running sums go over distinct values.
    """
    long = rows.select(F.col(node).alias("node"), F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("f")).select("node", "y", "f.*")
    sums = long.groupBy("node", "feature", "x").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    order, group = W.partitionBy("node", "feature").orderBy("x"), W.partitionBy("node", "feature")
    run = sums.select("node", "feature", "x", F.lead("x").over(order).alias("next"), F.sum("n").over(order).alias("ln"), F.sum("s").over(order).alias("ls"), F.sum("n").over(group).alias("n"), F.sum("s").over(group).alias("s"))
    rn, rs = F.col("n") - F.col("ln"), F.col("s") - F.col("ls")
    gain = F.round(F.col("ls") ** 2 / F.col("ln") + rs**2 / rn - F.col("s") ** 2 / F.col("n"), 6)
    return run.where(F.col("next").isNotNull() & (F.col("ln") >= least) & (rn >= least)).select("node", "feature", "x", "next", gain.alias("gain"), F.col("ln").alias("left"))


def best_split(rows: DataFrame, features: list[str], target: str, least: int = 1) -> DataFrame:
    """The cut of one feature that lowers the squared error most: (feature, cut, gain, left).

    Ties go to the first feature by name, then to the smaller cut.
    """
    cuts = _cuts(rows.withColumn("__node", F.lit(1)), "__node", features, target, least)
    return cuts.select("feature", ((F.col("x") + F.col("next")) / 2).alias("cut"), "gain", "left").orderBy(F.col("gain").desc(), "feature", "cut").limit(1)


def fit_shallow_tree(rows: DataFrame, features: list[str], target: str, depth: int = 4, least: int = 1) -> DataFrame:
    """(node, rows, value, feature, cut) of a regression tree that lowers the squared error at every cut.

    The root is node 1; rows of node k go to 2k if their feature is at most cut, otherwise to 2k + 1.
    value is the mean of a node's targets; feature and cut are null in a leaf. Ties go to the feature
    that comes first in features, then to the smaller cut. Rows with a null take no part. A level is
    one job; its cuts, a row for each of at most 2**(depth - 1) nodes, become expressions of the next.
    """
    placed = rows.select(F.col(target).cast("double").alias("__y"), *features).dropna().withColumn("__node", F.lit(1))
    place = F.array_position(F.array(*map(F.lit, features)), F.col("feature"))
    found = []
    for level in range(depth):
        cuts = _cuts(placed.where(F.col("__node") >= 2**level), "__node", features, "__y", least).where("gain > 0")
        best = cuts.groupBy("node").agg(F.min_by(F.struct("feature", "x"), F.struct(-F.col("gain"), place, F.col("x"))).alias("b"))
        chosen = [(r["node"], r["feature"], r["x"]) for r in best.select("node", "b.*").collect()]
        if not chosen:
            break
        found += chosen
        moved = F.coalesce(*(F.when(F.col("__node") == k, F.when(F.col(f) <= cut, 2 * k).otherwise(2 * k + 1)) for k, f, cut in chosen), F.col("__node"))
        placed = placed.withColumn("__node", moved)
    leaves = placed.groupBy("__node").agg(F.count("*").alias("n"), F.sum("__y").alias("s"))
    above = leaves.select("n", "s", F.explode(F.array(*(F.shiftright("__node", k) for k in range(depth + 1)))).alias("node")).where("node > 0")
    values = above.groupBy("node").agg(F.sum("n").alias("rows"), (F.sum("s") / F.sum("n")).alias("value"))
    return values.join(rows.sparkSession.createDataFrame(found, "node int, feature string, cut double"), "node", "left")
