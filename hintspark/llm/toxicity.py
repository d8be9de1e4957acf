"""Toxicity with a subsequence string kernel and Nyström landmarks.

Two words are alike if they share many letter subsequences of length three, each weighed by decay
to the length it spans; letters put between those of an insult only widen the spans. Two sentences
are as alike as their words are, summed over all pairs. A linear support vector machine over the
kernel's Nyström features (similarities to landmark sentences) learns from sentences of labelled
documents: those of clean documents are clean, and of a toxic document at least one is toxic. Which
one isn't known, so the machine is taught by a few sentences of each document and then, in
rounds, by those that it finds most toxic itself. Its decision is a sum over a sentence's
words; a document is judged by its two most toxic words, so that no length dilutes an insult.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hintspark.llm.remember import Remembered
from hintspark.plans.shared import SharedTables, arrow_rows

#: Letters a to z have a class each, a word's two ends one each, other letters share the rest.
CLASSES = 48
DECAY, SPAN = 0.7, 6
#: Words of a piece of a sentence that teaches the machine.
PIECE = 5
#: Words remembered in each of two generations, and characters read at once; both bound a worker.
WORDS_KEPT, CHARS_AT_ONCE = 50_000, 1 << 19
#: Digits that stand for letters inside a word.
DIGITS = str.maketrans("013457", "oieast")
#: The least value of a word, and so of a document without words.
LEAST = -1.0

_ENDS = re.compile(r"[.!?]+(?=\s)|\n")
_CODES = np.arange(0x110000)
_CLASS = np.where((_CODES >= 97) & (_CODES < 123), _CODES - 97, 28 + _CODES % (CLASSES - 28)).astype(np.int32)
_CLASS[2], _CLASS[3] = 26, 27  # the marks of a word's start and end


def unit(word: str) -> str:
    """The lower-case letters of a word without accents; digits inside it count as the letters they resemble."""
    word = word.lower()
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word)
    if word.isalpha():
        return word
    letters = "".join(filter(str.isalpha, word))
    return "".join(filter(str.isalpha, word.translate(DIGITS))) if letters and letters != word else letters


def _spelled(words: list[str]) -> list[str]:
    """Words that three or more single characters in a row spell out."""
    found: list[str] = []
    run: list[str] = []
    if any(map((1).__eq__, map(len, words))):
        for word in [*words, ""]:
            if len(word) == 1:
                run.append(word)
            else:
                if len(run) > 2:
                    found.append("".join(run))
                run = []
    return found


def units(text: str | None) -> set[str]:
    """Distinct words; three or more single characters in a row are one spelled-out word too."""
    words = (text or "").split()
    return {*words, *_spelled(words)}


def pieces(text: str) -> list[str]:
    """The units of every sentence in pieces of at most five, each once, in the order of their checksums."""
    found = set()
    for sentence in _ENDS.split(text):
        words = sentence.split()
        letters = [u for u in map(unit, [*words, *_spelled(words)]) if len(u) > 2]
        found.update(" ".join(letters[at : at + PIECE]) for at in range(0, len(letters), PIECE))
    return sorted(found, key=lambda p: (zlib.crc32(p.encode("utf-8", "replace")), p))


@lru_cache(maxsize=4096)
def _spans(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the subsequences of three letters or ends that span at most SPAN, and their weights."""
    start, a, b = np.meshgrid(np.arange(length), np.arange(1, SPAN), np.arange(1, SPAN), indexing="ij")
    first, middle, last = start.ravel(), (start + a).ravel(), (start + a + b).ravel()
    fits = (last < length) & (last - first < SPAN)
    first, middle, last = first[fits], middle[fits], last[fits]
    return first, middle, last, (DECAY ** (last - first + 1.0)).astype(np.float32)


def subsequences(words: list[str], most_cells: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word numbers, subsequence numbers (words, spans), weights) for words of equal length at a time.

    Weights are scaled so that a word's own kernel value is 1. Words of fewer than three letters
    have no subsequence and don't appear.
    """
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) > 2:
            by_length.setdefault(len(word), []).append(i)
    for size, numbers in by_length.items():
        length = size + 2
        first, middle, last, weight = _spans(length) if length <= 4096 else _spans.__wrapped__(length)
        step = max(1, most_cells // len(first))
        for at in range(0, len(numbers), step):
            some = np.array(numbers[at : at + step])
            marked = "".join([f"\x02{words[i]}\x03" for i in some])
            codes = _CLASS[np.frombuffer(marked.encode("utf-32-le", "replace"), "<u4")].reshape(len(some), length)
            cells = (codes[:, first] * CLASSES + codes[:, middle]) * CLASSES + codes[:, last]
            order = np.argsort(cells, axis=1, kind="stable")
            cells, weights = np.take_along_axis(cells, order, 1), weight[order]
            new = np.ones(cells.shape, bool)
            new[:, 1:] = cells[:, 1:] != cells[:, :-1]
            starts = np.flatnonzero(new.ravel())
            squares = np.add.reduceat(weights.ravel(), starts) ** 2
            own = np.bincount(starts // cells.shape[1], weights=squares, minlength=len(some))
            yield some, cells, weights / np.sqrt(own)[:, None]


def kernel(sentences: list[str], landmarks: list[str], block: int = 128) -> np.ndarray:
    """Kernel values (sentences, landmarks): sums of the normalised values of all pairs of their words."""
    words = sorted({w for s in sentences for w in s.split()})
    number = {w: i for i, w in enumerate(words)}
    inside = [[number[w] for w in s.split()] for s in sentences]
    flat = np.fromiter((n for s in inside for n in s), int)
    sizes = np.array([len(s) for s in inside], int)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    out = np.zeros((len(sentences), len(landmarks)), np.float32)
    for at in range(0, len(landmarks), block):
        some = landmarks[at : at + block]
        held: dict[str, list[int]] = {}
        for i, sentence in enumerate(some):
            for word in sentence.split():
                held.setdefault(word, []).append(i)
        table = np.zeros((CLASSES**3, len(some)), np.float32)
        spread = list(held)
        for numbers, cells, weights in subsequences(spread):
            for n, cell, weight in zip(numbers, cells, weights):
                for i in held[spread[n]]:
                    np.add.at(table[:, i], cell, weight)
        each = np.zeros((len(words), len(some)), np.float32)
        for numbers, cells, weights in subsequences(words, 1 << 14):
            each[numbers] = np.einsum("wsl,ws->wl", table[cells], weights)
        if len(full):
            for first in range(0, len(full), 4096):  # bounds the words of one sum
                chosen = full[first : first + 4096]
                end = starts[first + 4096] if first + 4096 < len(full) else len(flat)
                part = each[flat[starts[first] : end]]
                out[chosen, at : at + block] = np.add.reduceat(part, starts[first : first + 4096] - starts[first], axis=0)
    return out


@dataclass
class ToxicityModel:
    """A word's value is the weighted sum of table over its subsequences: the machine's decision,
    with landmarks and coefficients multiplied out; a sentence's is the sum of its words' plus bias.
    scale: logistic weights of a document's two largest word values."""

    table: np.ndarray
    bias: float
    scale: np.ndarray

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for numbers, cells, weights in subsequences(words, 1 << 17):
            out[numbers] = (self.table[cells] * weights).sum(1)
        return np.maximum(out, LEAST)


#: Values of words that a worker has seen, by model; kept between tasks.
_KNOWN: dict[bytes, Remembered] = {}


def _known(model: ToxicityModel) -> Remembered:
    key = sha256(model.table.tobytes()).digest()
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Remembered(WORDS_KEPT, "toxicity")
    return _KNOWN[key]


def fit_machine(good: list[str], bad: list[str], landmarks: list[str], cost: float = 10.0, rounds: int = 40) -> ToxicityModel:
    """Squared-hinge support vector machine on Nyström features, by Newton steps; both classes weigh the same."""
    own = kernel(landmarks, landmarks).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    kept = value > 1e-6 * value.max()
    whiten = vector[:, kept] / np.sqrt(value[kept])
    seen = kernel(bad + good, landmarks)
    seen = np.vstack([(seen[at : at + 2048] @ whiten).astype(np.float32) for at in range(0, len(seen), 2048)])
    x = np.hstack([seen, np.ones((len(seen), 1), np.float32)])
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
    share = np.where(y > 0, 0.5 / len(bad), 0.5 / len(good)) * cost * 100
    w = np.zeros(x.shape[1])
    ridge = np.append(np.ones(len(w) - 1), 1e-3)
    for _ in range(rounds):
        active = y * (x @ w) < 1
        square, right = np.diag(ridge), np.zeros(len(w))
        for at in range(0, len(x), 2048):
            part = slice(at, at + 2048)
            some, c = x[part][active[part]].astype(float), share[part][active[part]]
            square += (some.T * c) @ some
            right += (some.T * c) @ y[part][active[part]]
        step = np.linalg.solve(square, right)
        if np.allclose(step, w, atol=1e-8):
            break
        w = step
    table = np.zeros(CLASSES**3)
    for sentence, weight in zip(landmarks, whiten @ w[:-1]):
        for _, cells, spans in subsequences(sentence.split()):
            np.add.at(table, cells, spans * weight)
    return ToxicityModel(table.astype(np.float32), float(w[-1]), np.array([-1.0, 1.0, 0.0]))


def fit_scale(top: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression (intercept, largest, second) by Newton steps, with a small ridge."""
    x, w = np.column_stack([np.ones(len(top)), top]), np.zeros(1 + top.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (p * (1 - p) + 1e-6)) @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _values(words: list[str], model: ToxicityModel) -> list[float]:
    short = [unit(w) for w in words]
    some = list(set(short))
    value_of = dict(zip(some, model.values(some).tolist()))
    return list(map(value_of.__getitem__, short))


def _in_lists(texts: pa.Array, most_chars: int = CHARS_AT_ONCE) -> Iterator[list[str | None]]:
    """Texts in lists of bounded size, so that very long ones don't meet in one list."""
    held, size = [], 0
    for value in texts:
        text = value.as_py()
        if held and size + len(text or "") > most_chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


def top_values(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    """(texts, 2): the two largest values of each text's words; equal words count once."""
    Remembered.only("toxicity")
    known, rows = _known(model), []
    for some in _in_lists(texts):
        words_of = [units(text) for text in some]
        value_of = known.of(set().union(*words_of), lambda new: _values(new, model))
        rows += [(sorted(set(map(value_of.__getitem__, words)), reverse=True)[:2] + [LEAST, LEAST])[:2] for words in words_of]
    return np.array(rows, float).reshape(-1, 2)


def _teaching(model: ToxicityModel | None, toxic: bool, found: list[str]) -> list[str]:
    """The pieces by which a document teaches the next machine: without one the first 20 or, if it is
    clean, 2; else the most toxic one and up to two more toxic ones of a toxic document, and the two
    most toxic and the first one of a clean one."""
    if model is None or not found:
        return found[: 20 if toxic else 2]
    words = sorted({w for p in found for w in p.split()})
    value_of = dict(zip(words, model.values(words).tolist()))
    value = [sum(map(value_of.__getitem__, p.split())) + model.bias for p in found]
    order = sorted(range(len(found)), key=lambda i: -value[i])
    if toxic:
        return [found[i] for i in order[:3] if i == order[0] or value[i] > 0]
    return [*{found[i]: None for i in (*order[:2], 0)}]


def _landmarks(good: list[str], bad: list[str], count: int) -> list[str]:
    """As many sentences of each kind, first by a checksum."""
    mixed = lambda some: sorted(some, key=lambda p: (zlib.crc32(f"landmark {p}".encode("utf-8", "replace")), p))[: count // 2]
    return sorted({*mixed(good), *mixed(bad)})


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 5_000,
    landmarks: int = 600,
    rounds: int = 4,
) -> ToxicityModel | None:
    """A model from labelled documents, or None without documents of both labels.

    sample_rows bounds the labelled ids on average: with more, each is taken with the same chance,
    by its hash. Every taught document's whole text is cut into sentences and teaches by a few of
    them in each of rounds machines; landmarks sentences span the kernel's features. An id with both
    labels counts as toxic, one with several texts teaches by the least of them; null ids, labels
    and texts teach nothing.
    """
    tables = SharedTables(docs.sparkSession, "toxicity")
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).alias("__toxic"))
    share = sample_rows / max(sample_rows, marked.count())
    chosen = marked.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).dropna()
    one_each = given.join(F.broadcast(chosen), "__id").groupBy("__id", "__toxic").agg(F.min("__text").alias("__text"))  # sample_rows rows at most
    with arrow_rows(docs.sparkSession, 1000):
        taught = tables.keep(one_each.select("__toxic", "__text"))
        model = None
        for _ in range(rounds):
            teach = lambda toxic, text, model=model: _teaching(model, toxic, pieces(text))

            def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in parts:
                    rows = [(toxic, p) for toxic, text in zip(part["__toxic"], part["__text"]) for p in teach(toxic, text)]
                    yield pd.DataFrame(rows, columns=["toxic", "piece"])

            rows = taught.mapInPandas(choose, "toxic boolean, piece string").collect()
            good, bad = (sorted(r["piece"] for r in rows if r["toxic"] == toxic) for toxic in (False, True))
            if not good or not bad:
                return None
            model = fit_machine(good, bad, _landmarks(good, bad, landmarks))

        def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                first, second = top_values(part.column(1), model).T
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(first), pa.array(second)], names=["toxic", "first", "second"])

        top = taught.mapInArrow(measure, "toxic boolean, first double, second double").orderBy("toxic", "first", "second").toPandas()
    model.scale = fit_scale(top[["first", "second"]].to_numpy(float), top["toxic"].to_numpy(float))
    return model


def toxicity_score(text: Column, model: ToxicityModel | None) -> Column:
    """0 to 1 for every text; only the text goes to Python, other columns stay where they are.

    Whole texts are read. Null and empty texts score as a document without insulting words does;
    without a model every score is 0. Equal texts score alike.
    """
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        start, *weights = model.scale
        for part in parts:
            yield pa.array(1 / (1 + np.exp(-(start + top_values(part, model) @ np.array(weights)))), pa.float64())

    return score(text)
