import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("hintspark.llm")
from hintspark.llm import hidden_markov as H  # noqa: E402


def a_model(rng, states=3, classes=5):
    return H.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states))


def paths(model, text):
    """Every path of states and its probability together with the text."""
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.puts[path[0], text[0]]
        for a, b, c in zip(path, path[1:], text[1:]):
            p *= model.step[a, b] * model.puts[b, c]
        yield path, p


@pytest.mark.parametrize(("block", "cells"), [(1 << 15, 1 << 19), (2, 1 << 19), (3, 4)])
def test_recursions_equal_sums_over_all_paths(monkeypatch, block, cells):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "CELLS", cells)
    rng = np.random.default_rng(4)
    model = a_model(rng)
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 6, 3, 7, 2, 6, 1)]
    want = [math.log10(sum(p for _, p in paths(model, t))) for t in texts]
    assert np.allclose(H.likelihood(model, texts), want)
    start, step, puts = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for t in texts:
        total = sum(p for _, p in paths(model, t))
        for path, p in paths(model, t):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                step[a, b] += p / total
            for a, c in zip(path, t):
                puts[a, c] += p / total
    assert np.allclose(H.expected(model, texts), np.concatenate([start, step.ravel(), puts.ravel()]))


def test_a_round_never_lowers_the_likelihood():
    rng = np.random.default_rng(5)
    texts = [(rng.integers(0, 3, 30) + 2 * (i % 2)).astype(np.uint16) for i in range(40)]
    model, before = a_model(rng), -math.inf
    for _ in range(8):
        now = H.likelihood(model, texts).sum()
        assert now >= before - 1e-9
        before = now
        start, step, puts = np.split(H.expected(model, texts), [3, 12])
        step, puts = step.reshape(3, 3), puts.reshape(3, 5)
        model = H.Model(start / start.sum(), step / step.sum(1, keepdims=True), puts / puts.sum(1, keepdims=True))


WORDS = "[^\x20\x09-\x0d]+"


def plain_base(rows):
    """(doc_id, n_tokens, n_known, N, base) by the unigram rule."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = [(i, [*re.findall(WORDS, lower(t)), "\n"]) for i, t in rows]
    teaches = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 != 0
    count = Counter(w for i, ws in split if teaches(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, not teaches(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in split]


def scored(spark, rows, **extra):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)
    return H.score_texts(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0, rounds=2)


@pytest.mark.parametrize("hot", [65_536, 8, 0])
def test_counts_and_base_scores_equal_plain_ones(spark, monkeypatch, hot):
    monkeypatch.setattr(H, "HOT_WORDS", hot)
    monkeypatch.setattr(H, "COUNTED", 5)
    rows = [(i, " ".join(f"W{(i * j) % 17}é" for j in range(i % 9))) for i in range(60)]
    rows += [(None, None), (7, ""), (8, "w1é\x0bw2é\x1cx   y"), (9, "only here " * 30), (9, "only here " * 30), (11, "long " * 5000)]
    got = scored(spark, rows, row=F.lit(1), classes=F.lit("x"), word=F.lit("y")).toPandas()
    want = plain_base(rows)
    key = lambda r: (r[0] if r[0] is not None else -1, *r[1:5])
    got = sorted(((None if i != i else int(i), bool(h), int(t), int(k), int(n), round(b, 4)) for i, h, t, k, n, b, _ in got.itertuples(index=False)), key=key)
    assert got == sorted(((*w[:5], round(w[5], 4)) for w in want), key=key)


def test_scores_of_all_one_word_texts_make_one(spark):
    """Every word, and one unknown word for each class of endings, has its share: the probabilities add up to one."""
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 12))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = H.word_counts(docs, F.lit(True)).cache()
    words = H.vocabulary(counts, len(rows))
    model = H.baum_welch(H.encoded(docs, F.lit(True), words), words, 2)
    first = model.start @ model.puts
    total = first[: 1 + H.OWN].sum()
    shape = Counter(H.ending(w) for w, (k, _) in words.hot.items() if k > H.OWN)
    for k in range(1 + H.OWN, H.CLASSES):
        inside = sum(c + H.ADD for w, (kind, c) in words.hot.items() if kind == k) + H.ADD
        assert math.isclose(math.log10(inside), words.shares[k], abs_tol=1e-9) or not shape[k]
        total += first[k]
    assert math.isclose(total, 1, abs_tol=1e-9)


def test_hidden_states_beat_single_words_on_held_out_texts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{n}" for n in rng.integers(0, 300, 80))) for i in range(300)]
    got = scored(spark, rows).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] + 0.1 * 80 * 20
    assert scored(spark, [(i, None) for i in range(5)]).count() == 5
    assert scored(spark, []).count() == 0
