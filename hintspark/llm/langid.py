"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds its three letters: the vector of
each is permuted by its position (rolled) and the three are multiplied. A text is the bundle, the
sum, of its trigrams; a language's prototype is the bundle of its texts. The language whose
prototype has the largest cosine with the text is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

DIMENSION = 1024
#: Characters bundled at once; bounds a worker's memory whatever the texts' lengths.
CHARS_AT_ONCE = 1 << 20
#: Up to this many possible trigrams a lookup table finds the distinct ones, else sorting does.
TABLE_CELLS = 1 << 23
#: Distinct trigrams whose counts and vectors are held at once, however large the texts' alphabet is.
TRIGRAMS = 2048


class Bundler:
    """Vectors of texts. Letters get their vectors when first seen, from seed and code point alone."""

    def __init__(self, dimension: int = DIMENSION, seed: int = 7):
        self.dimension, self.seed = dimension, seed
        self.symbol = np.full(0x110000, -1, np.int32)  # by code point; 0 for all but letters
        self.letters = [np.zeros((1024, dimension), np.int8) for _ in range(3)]
        self.letters[0][0] = self._random(0)
        self.count = 1
        self._rolled(0)

    def _random(self, code: int) -> np.ndarray:
        draw = np.random.Generator(np.random.Philox(key=[self.seed, code]))
        return (draw.integers(0, 2, self.dimension, np.int8) * 2 - 1).astype(np.int8)

    def _rolled(self, row: int) -> None:
        for shift in (1, 2):
            self.letters[shift][row] = np.roll(self.letters[0][row], shift)

    def _learn(self, codes: np.ndarray) -> None:
        for code in np.unique(codes):
            if not chr(code).isalpha():
                self.symbol[code] = 0
                continue
            if self.count == len(self.letters[0]):
                self.letters = [np.concatenate([x, np.zeros_like(x)]) for x in self.letters]
            self.letters[0][self.count] = self._random(int(code))
            self._rolled(self.count)
            self.symbol[code] = self.count
            self.count += 1

    def _trigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text number and trigram number of every trigram; runs of other characters are one boundary."""
        lower = [t.lower() for t in texts]
        codes = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "replace"), "<u4")
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
        owner = np.concatenate([[0], owner])
        symbols = self.symbol[codes]
        if (symbols < 0).any():
            self._learn(codes[symbols < 0])
            symbols = self.symbol[codes]
        keep = symbols != 0
        keep[1:] |= keep[:-1]
        keep[0] = True
        symbols, owner = symbols[keep].astype(np.int64), owner[keep]
        middle = np.flatnonzero(symbols[1:-1]) + 1
        numbers = (symbols[middle - 1] * self.count + symbols[middle]) * self.count + symbols[middle + 1]
        return owner[middle], numbers

    def _distinct(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = self.count**3
        if cells > TABLE_CELLS:
            return np.unique(numbers, return_inverse=True)
        there = np.zeros(cells, bool)
        there[numbers] = True
        found = np.flatnonzero(there)
        place = np.zeros(cells, np.int32)
        place[found] = np.arange(len(found), dtype=np.int32)
        return found, place[numbers]

    def bundle(self, texts: list[str], into: np.ndarray, rows: int) -> np.ndarray:
        """(rows, dimension) sums; text i is added to row into[i]."""
        owner, numbers = self._trigrams(texts)
        if not len(numbers):
            return np.zeros((rows, self.dimension), np.float32)
        found, place = self._distinct(numbers)
        order = np.argsort(place, kind="stable")
        row, place = into[owner][order], place[order]
        cuts = np.searchsorted(place, np.arange(0, len(found) + TRIGRAMS, TRIGRAMS))
        out = np.zeros((rows, self.dimension), np.float32)
        for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):  # counts and vectors of so many trigrams are held at once
            some = found[at * TRIGRAMS : (at + 1) * TRIGRAMS]
            counts = np.bincount(row[a:b] * len(some) + place[a:b] - at * TRIGRAMS, minlength=rows * len(some)).reshape(rows, len(some))
            last, middle, first = some % self.count, some // self.count % self.count, some // self.count**2
            vectors = self.letters[2][first] * self.letters[1][middle] * self.letters[0][last]
            out += counts.astype(np.float32) @ vectors.astype(np.float32)
        return out


@dataclass
class Profiles:
    """Prototypes by language, in the languages' code point order."""

    languages: list[str]
    prototypes: np.ndarray
    seed: int


def _slices(texts: list[str]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and (size + len(text) > CHARS_AT_ONCE or i - start >= 2048):
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if texts:
        yield slice(start, len(texts))


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimension: int = DIMENSION, seed: int = 7) -> Profiles:
    """Bundles of all rows with a text and a language.

    Each task sends one vector a language; the driver gets dimension numbers a language, which is
    the model itself. Null texts and null languages teach nothing; an empty table gives no languages.
    """

    def bundle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundler, sums = Bundler(dimension, seed), {}
        for part in parts:
            texts, langs = part["text"].tolist(), part["lang"].to_numpy()
            for at in _slices(texts):
                names, into = np.unique(langs[at].astype(str), return_inverse=True)
                for name, row in zip(names, bundler.bundle(texts[at], into, len(names)).astype(np.float64)):
                    sums[name] = sums.get(name, 0) + row
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": list(sums.values())})

    rows = (
        docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .dropna()
        .mapInPandas(bundle, "lang string, vector array<double>")
        .select("lang", F.posexplode("vector").alias("at", "value"))
        .groupBy("lang", "at")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    table = rows.pivot(index="lang", columns="at", values="value").sort_index() if len(rows) else pd.DataFrame()
    return Profiles(list(table.index), table.to_numpy(np.float64).reshape(len(table), dimension), seed)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """id, the columns in keep, lang_pred and score for every row, whatever its text's length.

    score is the cosine, 0 at least. Texts that are null or have no letter get `und` and 0, as do
    all texts if no language was learned. Equal cosines go to the first language in code point
    order. Repeated rows are judged alike; an empty table gives no rows.
    """
    keep = keep or {}
    languages = np.array([*profiles.languages, "und"], object)
    norms = np.linalg.norm(profiles.prototypes, axis=1, keepdims=True) if profiles.languages else None
    unit = (profiles.prototypes / np.where(norms > 0, norms, 1)).astype(np.float32) if profiles.languages else None
    seed = profiles.seed

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundler = Bundler(unit.shape[1], seed) if unit is not None else None
        for part in parts:
            texts = part.pop("__text").fillna("").tolist()
            best, score = np.full(len(texts), len(languages) - 1), np.zeros(len(texts))
            if bundler is not None:
                for at in _slices(texts):
                    rows = at.stop - at.start
                    vectors = bundler.bundle(texts[at], np.arange(rows), rows)
                    size = np.linalg.norm(vectors, axis=1)
                    cosine = (vectors @ unit.T) / np.where(size > 0, size, 1)[:, None]
                    best[at] = np.where(size > 0, cosine.argmax(1), len(languages) - 1)
                    score[at] = np.where(size > 0, cosine.max(1), 0).clip(0, 1)
            yield part.assign(lang_pred=languages[best], score=score)

    given = docs.select(F.col(id_col), *(c.alias(n) for n, c in keep.items()), F.col(text_col).alias("__text"))
    out = given.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return given.mapInPandas(judge, out)
