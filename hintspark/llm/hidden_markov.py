"""Language-model scores of a hidden Markov model, trained by Baum-Welch over all training texts.

A token is a word or a text's end. A state puts out a class of words, the class a word:
P(word | state) = P(class | state) * P(word | class). The most frequent words are a class each, other words
share one with those of the same ending, so the states' tables have a fixed size however many words there
are. Inside a shared class a word has the share (count + 0.1) / (class's count + 0.1 * (class's words + 1)),
in which one unknown word has its part; so every text has a probability.

Words are counted in all texts. Those of frequent words, a bounded number found from a histogram of counts,
travel with the code; the counts of all others meet their documents in a join, in which no word is frequent.
Texts become arrays of classes once. A round of Baum-Welch is one job over them: tasks run the scaled forward
and backward recursions over many texts side by side and add up expected counts, which meet in an aggregate;
states times classes numbers reach the driver. Long texts are taken in blocks of time, so that memory stays
bounded. Scores come from the forward recursion in double precision.

Nulls: a null text is empty and has only its end; a null doc_id counts as an empty one in the split. Repeated
rows are scored, and count, each for itself. Without training texts all counts are 0. An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hintspark.plans.shared import SharedTables, arrow_rows

STATES, OWN, SHAPES = 8, 4096, 4096
#: Classes: 0 is the end, 1 to OWN frequent words, the others endings.
CLASSES = 1 + OWN + SHAPES
#: At most so many words, and bytes of theirs, travel with the code.
HOT_WORDS, HOT_BYTES = 65_536, 4 << 20
ADD = 0.1
#: Cells of time and text that are held at once, and steps of time in a block.
CELLS, BLOCK = 1 << 20, 1 << 15
#: Words that a task counts before it passes them on.
COUNTED = 250_000


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, parted by ASCII white space, A-Z in lower case."""
    return text.lower().split()


def ending(word: bytes) -> int:
    return 1 + OWN + zlib.crc32(word[-3:]) % SHAPES


# ---- counts of words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters = (Counter(), Counter())  # of texts that don't teach, and of those that do

    def put() -> pa.RecordBatch:
        other, taught = counters
        words = list(taught) + [w for w in other if w not in taught]
        known = [taught[w] for w in words]
        every = [k + other[w] for k, w in zip(known, words)]
        other.clear()
        taught.clear()
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "taught": pa.array(known, pa.int64()), "every": pa.array(every, pa.int64())})

    for batch in batches:
        for text, teaches in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
            counters[bool(teaches)].update(tokens(text or b""))
            if len(counters[0]) + len(counters[1]) > COUNTED:
                yield put()
    if counters[0] or counters[1]:
        yield put()


def word_counts(docs: DataFrame, teaches: Column) -> DataFrame:
    """(word, taught, every): how often a word is in training texts, and in all."""
    given = docs.select("text", teaches.alias("teaches"))
    return given.mapInArrow(_count, "word binary, taught long, every long").groupBy("word").agg(F.sum("taught").alias("taught"), F.sum("every").alias("every"))


def _bin() -> Column:
    """Bins of counts that grow by a sixteenth of e."""
    return F.floor(F.log("every") * 16)


@dataclass
class Vocabulary:
    """What of the counts is bounded. hot: word to (class, taught count); shares: log10 of each class's denominator."""

    hot: dict[bytes, tuple[int, int]]
    least_bin: int
    tokens: int
    words: int
    ends: int
    shares: np.ndarray
    classes: np.ndarray  # training tokens of each class


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    bins = counts.groupBy(_bin().alias("bin")).agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes"), F.sum("taught").alias("taught"), F.count_if(F.col("taught") > 0).alias("known")).collect()
    least, n, size = 1 << 30, 0, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        n, size = n + r["n"], size + r["bytes"]
        if n > HOT_WORDS or size > HOT_BYTES:
            break
        least = r["bin"]
    found = sorted((-r["taught"], bytes(r["word"])) for r in counts.where(_bin() >= least).select("word", "taught").collect())
    own = {w: 1 + i for i, (count, w) in enumerate(found[:OWN]) if count < 0}
    hot = {w: (own.get(w, 0) or ending(w), -count) for count, w in found}
    total, known = np.zeros(CLASSES), np.zeros(CLASSES)
    last = F.col("word").substr(-3, 3)
    for r in counts.groupBy((F.crc32(last) % SHAPES).cast("int").alias("shape")).agg(F.sum("taught").alias("taught"), F.count_if(F.col("taught") > 0).alias("known")).collect():
        total[1 + OWN + r["shape"]], known[1 + OWN + r["shape"]] = r["taught"], r["known"]
    for word, k in own.items():
        count = hot[word][1]
        total[k] = count
        total[ending(word)] -= count
        known[ending(word)] -= 1
    total[0] = ends
    shares = np.log10(total + ADD * (known + 1))
    shares[: 1 + OWN] = 0
    return Vocabulary(hot, least, sum(r["taught"] for r in bins) + ends, sum(r["known"] for r in bins) + (ends > 0), ends, shares, total)


# ---- texts as classes

ENCODED = "row long, doc_id long, teaches boolean, n_tokens long, known long, logs double, inner double, classes binary, rare array<binary>, times array<long>"


class _Codes(dict):
    """Numbers of words: those of frequent words are fixed, others are given as words come; names and kinds tell them apart."""

    def __init__(self, hot: dict[bytes, tuple[int, int]]):
        super().__init__((w, i) for i, w in enumerate(hot))
        self.fixed, self.names, self.kinds = len(hot), [], []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = self.fixed + len(self.names)
        self.names.append(word)
        self.kinds.append(ending(word))
        return code

    def forget(self) -> None:
        for word in self.names:
            del self[word]
        self.names, self.kinds = [], []


def encoded(docs: DataFrame, teaches: Column, words: Vocabulary) -> DataFrame:
    """Texts as classes. known, logs and inner hold what frequent words and ends add to n_known, to the sum of
    log10(count + 0.1), and to the words' log10 shares of their classes; rare and times the other words."""
    hot, shares = words.hot, words.shares
    log_end, end_known = math.log10(words.ends + ADD), int(words.ends > 0)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(hot)
        fixed = codes.fixed
        kinds_hot = np.array([k for k, _ in hot.values()], np.uint16)
        counts = np.array([c for _, c in hot.values()], float)
        # of frequent words, and in the last place what all others have
        logs = np.append(np.log10(counts + ADD), 0.0)
        inner = np.append(np.where(kinds_hot > OWN, logs[:-1], 0.0), 0.0)
        known = np.append(counts > 0, False).astype(np.int64)
        for batch in batches:
            texts, flat = batch.column(3).cast(pa.binary()).to_pylist(), []
            sizes = np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                found = tokens(text or b"")
                sizes[i] = len(found)
                flat.append(np.fromiter([codes[w] for w in found], np.int64, len(found)))
            code, owner = np.concatenate([np.zeros(0, np.int64), *flat]), np.repeat(np.arange(len(texts)), sizes)
            place = np.minimum(code, fixed)
            kinds = np.append(kinds_hot, np.array(codes.kinds, np.uint16))[code]
            total = lambda values: np.bincount(owner, values, len(texts)).astype(float)  # noqa: E731, B023
            out = {"n_tokens": pa.array(sizes + 1), "known": pa.array(total(known[place]).astype(np.int64) + end_known), "logs": pa.array(total(logs[place]) + log_end), "inner": pa.array(total(inner[place] - shares[kinds]))}
            ends = np.concatenate([[0], np.cumsum(sizes)])
            out["classes"] = pa.array([kinds[a:b].tobytes() + b"\0\0" for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            rare = code >= fixed
            span = max(1, len(codes.names))
            pairs, times = np.unique(owner[rare] * span + code[rare] - fixed, return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(len(texts) + 1) * span).astype(np.int32)
            names = pa.array(codes.names, pa.binary()).take(pa.array(pairs % span))
            out |= {"rare": pa.ListArray.from_arrays(cuts, names), "times": pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64)))}
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *out.values()], names=["row", "doc_id", "teaches", *out])
            if len(codes.names) > COUNTED:
                codes.forget()

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), teaches.alias("teaches"), "text").mapInArrow(encode, ENCODED)


def rare_sums(texts: DataFrame, counts: DataFrame, least_bin: int) -> DataFrame:
    """(row, known, logs) of the words that don't travel with the code. None of them is frequent, so no key is hot."""
    pairs = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.times").alias("times"))
    known = counts.where(_bin() < least_bin).select("word", "taught")
    both = pairs.join(known, "word")
    return both.groupBy("row").agg(F.sum(F.when(F.col("taught") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("taught") + ADD)).alias("rare_logs"))


# ---- the model


@dataclass
class Model:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    puts: np.ndarray  # (states, classes)


def _side_by_side(texts: list[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """Texts in lots of similar length, the longest first; a lot has at most so many cells, or is one text."""
    lot: list[np.ndarray] = []
    for text in sorted(texts, key=len, reverse=True):
        if lot and (len(lot) + 1) * min(len(lot[0]), BLOCK) > most:
            yield lot
            lot = []
        lot.append(text)
    if lot:
        yield lot


def _blocks(lot: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(classes (time, text), texts that go on at each time) of blocks of time; the texts come longest first."""
    sizes = np.array([len(t) for t in lot])
    out = []
    for first in range(0, sizes[0], BLOCK):
        last = min(first + BLOCK, sizes[0])
        goes = (sizes[None, :] > np.arange(first, last)[:, None]).sum(1)
        kinds = np.zeros((last - first, goes[0]), np.uint16)
        for i in range(goes[0]):
            part = lot[i][first:last]
            kinds[: len(part), i] = part
        out.append((kinds, goes))
    return out


def _forward(model: Model, kinds: np.ndarray, goes: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward vectors (states, time, text), scales and what is put out, in a block of time; before: the vectors
    at its start. Texts are the last axis, so that every operation of a step runs along many of them."""
    puts = np.take(model.puts, kinds, axis=1, mode="clip")
    ahead, scales = np.zeros_like(puts), np.ones(kinds.shape, puts.dtype)
    step, ones = np.ascontiguousarray(model.step.T), np.ones((1, len(model.start)), puts.dtype)
    for t, n in enumerate(goes):
        now = np.repeat(model.start[:, None], n, axis=1) if before is None else step @ before[:, :n]
        now *= puts[:, t, :n]
        size = ones @ now
        now /= size
        ahead[:, t, :n], scales[t, :n], before = now, size[0], now
    return ahead, scales, puts


def likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each text's probability, by the scaled forward recursion."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out, done = np.zeros(len(texts)), 0
    for lot in _side_by_side(texts, CELLS // 2):  # numbers of twice the size
        before, total = None, np.zeros(len(lot))
        for kinds, goes in _blocks(lot):
            ahead, scales, _ = _forward(model, kinds, goes, before)
            total[: goes[0]] += np.log10(scales).sum(0)
            before = ahead[:, -1]
        out[order[done : done + len(lot)]] = total
        done += len(lot)
    return out


def expected(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Expected starts, steps and outputs, one after another, over texts."""
    states, classes = model.puts.shape
    start, step, put = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    for lot in _side_by_side(texts, CELLS):
        blocks = _blocks(lot)
        enters = [None]
        for kinds, goes in blocks[:-1]:  # of all but the last block, only the vectors at its end are held
            enters.append(_forward(model, kinds, goes, enters[-1])[0][:, -1])
        after = np.ones((states, 0), model.puts.dtype)
        for (kinds, goes), enter in zip(reversed(blocks), reversed(enters)):
            ahead, scales, puts = _forward(model, kinds, goes, enter)
            puts /= scales
            back = np.zeros_like(puts)
            now = after
            for t in range(len(goes) - 1, -1, -1):
                n = goes[t]
                if n > now.shape[1]:  # texts that end here
                    now = np.hstack([now, np.ones((states, n - now.shape[1]), puts.dtype)])
                back[:, t, :n] = now
                now = model.step @ (puts[:, t, :n] * now)
            after = now
            puts *= back
            back *= ahead  # expected states; cells without a text are zero
            flat = kinds.ravel().astype(np.int64)
            for k in range(states):
                put[k] += np.bincount(flat, back[k].ravel(), classes)
            wide = kinds.shape[1]  # a step leads from a cell to the one that lies so many further on
            step += model.step * (ahead.reshape(states, -1)[:, :-wide] @ puts.reshape(states, -1)[:, wide:].T)
            if enter is None:
                start += back[:, 0].sum(1)
            else:
                step += model.step * (enter[:, : goes[0]] @ puts[:, 0].T)
    return np.concatenate([start, step.ravel(), put.ravel()])


def first_model(words: Vocabulary, seed: int = 7) -> Model:
    """States that last, each with the classes' shares times a noise of its own."""
    rng = np.random.default_rng(seed)
    puts = (words.classes + ADD) * np.exp(rng.normal(0, 1, (STATES, CLASSES)))
    step = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    return Model(np.full(STATES, 1 / STATES), step, puts / puts.sum(1, keepdims=True))


def learned(sums: np.ndarray, words: Vocabulary, weight: float = 50.0) -> Model:
    """The model of expected counts. Counts start from a few, so that no class, step or start is impossible."""
    start, step, put = np.split(sums, [STATES, STATES + STATES * STATES])
    start, step, put = start + ADD, step.reshape(STATES, STATES) + ADD, put.reshape(STATES, CLASSES)
    shares = (words.classes + ADD) / (words.classes + ADD).sum()
    put = put + weight * shares
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), put / put.sum(1, keepdims=True))


def _single(model: Model) -> Model:
    return Model(*(x.astype(np.float32) for x in (model.start, model.step, model.puts)))


def _lots(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[list[np.ndarray]]:
    """Texts of several batches, so that there are enough of a like length."""
    held, size = [], 0
    for batch in batches:
        for data in batch.column(column).to_pylist():
            held.append(np.frombuffer(data, np.uint16))
            size += len(held[-1])
            if size > most:
                yield held
                held, size = [], 0
    if held:
        yield held


def baum_welch(texts: DataFrame, words: Vocabulary, rounds: int) -> Model:
    """A model of the training texts after some rounds, each one job."""
    model = first_model(words)
    taught = texts.where("teaches").select("classes")
    for _ in range(rounds):
        now = _single(model)

        def add_up(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(STATES + STATES * STATES + STATES * CLASSES)
            for lot in _lots(batches, 0):
                total += expected(now, lot)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["at", "value"])

        sums = np.zeros(STATES + STATES * STATES + STATES * CLASSES)
        found = taught.mapInArrow(add_up, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        sums[found["at"].to_numpy(int)] = found["value"].to_numpy(float)
        model = learned(sums, words)
    return model


def hidden_logs(texts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep and hidden, the log10 probability of each text's classes."""
    given = texts.select(*keep, "classes")
    out = given.drop("classes").schema.add("hidden", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = likelihood(model, [np.frombuffer(x, np.uint16) for x in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logs, pa.float64())], names=[*keep, "hidden"])

    return given.mapInArrow(score, out)


def score_texts(docs: DataFrame, teaches: Column, rounds: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    teaches marks the rows to learn from. base_score is the unigram model's log10 probability, score the hidden
    Markov model's; both are rounded to six decimals, which hides the order in which sums are made.
    """
    spark = docs.sparkSession
    tables = SharedTables(spark, "markov")
    taught = F.coalesce(teaches, F.lit(False))
    with arrow_rows(spark, 1000):
        counts = tables.keep(word_counts(docs, taught))
        words = vocabulary(counts, docs.where(taught).count())
        texts = tables.keep(encoded(docs, taught, words))
        model = baum_welch(texts, words, rounds)
        scored = tables.keep(hidden_logs(texts, model, ["row", "doc_id", "teaches", "n_tokens", "known", "logs", "inner"]))
    every = scored.join(rare_sums(texts, counts, words.least_bin), "row", "left")
    rare_known, rare_logs = F.coalesce("rare_known", F.lit(0)), F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("logs") + rare_logs - F.col("n_tokens") * math.log10(words.tokens + ADD * (words.words + 1))
    return every.select(
        "doc_id", (~F.col("teaches")).alias("held_out"), "n_tokens", (F.col("known") + rare_known).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        F.round(base, 6).alias("base_score"), F.round(F.col("hidden") + F.col("inner") + rare_logs, 6).alias("score"),
    )
