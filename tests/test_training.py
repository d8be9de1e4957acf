import numpy as np
import pytest
from pyspark.sql import functions as F

from hintspark.operators import training as T

KINDS = "id int, features array<struct<idx:int,val:double>>, label int, weight double"


def steps_on_a_matrix(x, label, weight, classes, steps, rate, decay, ternary):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((classes, x.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ (T._ternary(w) if ternary else w).T
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True) - np.eye(classes)[label]
        g = (p * weight[:, None]).T @ x / weight.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w[:, :-1] *= 1 - rate * decay
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return T._ternary(w) if ternary else w


@pytest.mark.parametrize("ternary", [False, True])
def test_softmax_holds_a_lot_of_sparse_rows(spark, monkeypatch, ternary):
    """Before, every feature of a batch was a Python object, and a task held a dense matrix."""
    monkeypatch.setattr(T, "LOT", 4)
    draw = np.random.default_rng(2)
    x = draw.random((30, 6)) * (draw.random((30, 6)) < 0.5)
    label, weight = draw.integers(0, 3, 30), draw.random(30)
    rows = [(i, [(int(k), float(x[i, k])) for k in np.flatnonzero(x[i])], int(label[i]), float(weight[i])) for i in range(30)]
    rows[0][1].extend([(1, 0.25), (1, 0.5)])  # an index that repeats counts as often
    x[0, 1] += 0.75
    data = spark.createDataFrame(rows, KINDS).repartition(3)
    w = T.fit_softmax(data, 3, 6, steps=5, ternary=ternary)
    assert np.allclose(w, steps_on_a_matrix(x, label, weight, 3, 5, 0.1, 1e-4, ternary))
    z = np.hstack([x, np.ones((30, 1))]) @ w.T
    wanted = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    got = T.predict(data, ["id", "label"], w, ["a", "b", "c"]).orderBy("id").collect()
    assert np.allclose([r["probabilities"] for r in got], wanted) and [r["label"] for r in got] == label.tolist()
    assert not T.predict(data.where(F.lit(False)), ["id"], w, ["a", "b", "c"]).collect()
