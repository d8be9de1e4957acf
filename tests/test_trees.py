import numpy as np

from hintspark.operators import training


def plain_tree(x, y, depth, least):
    """{node: (rows, value, feature, cut)} by trying every cut."""
    found = {}

    def grow(node, at, level):
        best = (0.0, None, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in sorted(set(x[at, f]))[:-1]:
                    left, right = at[x[at, f] <= cut], at[x[at, f] > cut]
                    if min(len(left), len(right)) >= least:
                        gain = round(y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[at].sum() ** 2 / len(at), 6)
                        if gain > best[0]:
                            best = (gain, f, cut)
        found[node] = (len(at), round(y[at].mean(), 9), None if best[1] is None else f"f{best[1]}", best[2])
        if best[1] is not None:
            grow(2 * node, at[x[at, best[1]] <= best[2]], level + 1)
            grow(2 * node + 1, at[x[at, best[1]] > best[2]], level + 1)

    grow(1, np.arange(len(x)), 0)
    return found


def test_shallow_tree_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (90, 3)).astype(float), rng.integers(-5, 6, 90).astype(float)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    frame = spark.createDataFrame([*rows, (None, 1.0, 1.0, 9.0)], "f0 double, f1 double, f2 double, y double")
    for depth, least in ((1, 1), (3, 4), (4, 1)):
        got = {r["node"]: (r["rows"], round(r["value"], 9), r["feature"], r["cut"]) for r in training.fit_shallow_tree(frame, ["f0", "f1", "f2"], "y", depth, least).collect()}
        assert got == plain_tree(x, y, depth, least)


def test_shallow_tree_without_rows_or_cuts(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "f0 double, y double")
    assert [tuple(r) for r in training.fit_shallow_tree(frame, ["f0"], "y").collect()] == [(1, 2, 3.0, None, None)]
    assert training.fit_shallow_tree(frame.limit(0), ["f0"], "y").count() == 0
