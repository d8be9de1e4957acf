"""Packing documents into sequences of tokens.

First-fit decreasing, run independently in randomised groups of documents. Inside a group the
open bins are the leaves of a tournament tree of free capacities: the root shows whether a piece
fits anywhere, and walking down to the left finds the first bin that takes it in O(log bins).
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from hintspark.llm.remember import Remembered

#: Runs of letters, and words of other scripts, whose ids a worker remembers in each of two generations.
RUNS_KEPT, WORDS_KEPT = 150_000, 20_000
#: How the tokenizer cuts lower-case text of characters below U+0180: endings, letters, a number, others.
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
RUNS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\t-\r \u0085\u00a0]+")
PLAIN = re.compile("[\u0000-\u012f\u0131-\u017f]*")


class WordTokenizer:
    """Little-endian 32-bit ids of whole texts, for a lower-casing BPE whose pieces end with </w>.

    A text is cut into runs as the tokenizer does, and the ids of distinct runs are remembered.
    Texts with characters from U+0180 on, where lower case may depend on the context and composition
    matters, are cut at ASCII white space, which no piece crosses, and their words go to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = [(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)]
        self.words, self.runs = Remembered(WORDS_KEPT, "packing"), Remembered(RUNS_KEPT, "packing")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for some in (runs[i : i + 200] for i in range(0, len(runs), 200)):
            (ids,) = self.encode([" ".join(some)])
            cuts = [0, *(i + 1 for i, x in enumerate(ids) if self.ends[x])]
            if len(cuts) == len(some) + 1:
                raw = array("I", ids).tobytes()
                out.extend(raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:]))
            else:
                out.extend(array("I", x).tobytes() for x in self.encode(some))
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.encode([w.decode("utf-8", "replace") for w in words])]

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """bytes.split() cuts at the six ASCII white space characters and at nothing else."""
        pieces: list[list] = []
        plain: list[bool] = []
        for raw in texts:
            text = (raw or b"").decode("utf-8", "replace")
            plain.append((text.isascii() or PLAIN.fullmatch(text) is not None) and "<|" not in text)
            pieces.append(RUNS.findall(text.lower()) if plain[-1] else raw.split())
        runs = self.runs.of(set().union(*(p for p, easy in zip(pieces, plain) if easy)), self.encode_runs)
        words = self.words.of(set().union(*(p for p, easy in zip(pieces, plain) if not easy)), self.encode_words)
        for piece, easy in zip(pieces, plain):
            yield b"".join(map((runs if easy else words).__getitem__, piece))


@lru_cache(maxsize=2)
def tokenizer_at(path: str) -> WordTokenizer:
    """Kept in a worker between tasks."""
    return WordTokenizer(path)


Remembered.releases["packing"] = tokenizer_at.cache_clear


def _batches(values: pa.Array, most_bytes: int = 2 << 20) -> Iterator[list[bytes | None]]:
    """Values in lists of bounded size, so that very long texts don't meet in one list."""
    held, size = [], 0
    for value in values:
        text = value.as_py()
        if held and size + len(text or b"") > most_bytes:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or b"")
    if held:
        yield held


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of every size, for sizes sorted from large to small; bins are numbered as they open."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)  # free[1] is the root; leaf i is free[leaves + i]
    bins = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        bins.append(node - leaves)
        node //= 2
        while node:
            left, right = free[2 * node], free[2 * node + 1]
            free[node] = left if left > right else right
            node //= 2
    return bins


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_docs: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; it is cut at multiples of capacity, so that all but its last
    piece fill a sequence. Groups hold about group_docs documents; a sequence never mixes groups,
    so no task needs more than its groups. with_ids adds the piece's ids as array<int>.

    Null and empty texts give one piece with end_id alone. Null ids stay null. Repeated rows are
    packed once each: a running number of equal rows inside a partition is part of the hash that
    picks the group, so copies spread. Other columns are ignored. An empty table gives no rows.
    Reruns over the same files agree.
    """
    groups = max(1, -(-docs.count() // group_docs))
    id_type = docs.schema[id_col].dataType
    piece = T.StructType(
        [T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "salt"))]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )
    names = [f.name for f in piece.fields]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.only("packing")
        encode = tokenizer_at(tokenizer_path)
        end = array("I", [end_id]).tobytes()
        partition = TaskContext.get().partitionId()
        seen: dict[int, int] = {}  # one number for each text of the partition, whose bytes Spark bounds
        for part in parts:
            keys = part.column(0).to_pylist()
            row = iter(keys)
            out: list[tuple] = []
            for texts in _batches(part.column(1)):
                for ids in encode(texts):
                    key, raw = next(row), ids + end
                    length = len(raw) // 4
                    same = zlib.crc32(f"{key} {length}".encode()) << 32 | zlib.crc32(raw)
                    seen[same] = again = seen.get(same, -1) + 1
                    salt = zlib.crc32(f"{same} {again} {partition if again else 0}".encode())
                    for start in range(0, length, capacity):
                        cut_raw = raw[4 * start : 4 * (start + capacity)]
                        out.append((key, start, len(cut_raw) // 4, zlib.crc32(cut_raw), length, salt) + ((cut_raw,) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(list(zip(*out)) or [()] * len(names), arrow_types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_types = [to_arrow_type(f.dataType) for f in piece.fields]
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(cut, piece)
    pieces = pieces.withColumn("part", F.pmod(F.hash("salt"), F.lit(groups)).cast("long"))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "salt", "start", "ids_crc32", "id"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        frame["bin"] = first_fit_decreasing(frame["length"].tolist(), capacity)
        frame["offset"] = frame.groupby("bin")["length"].cumsum() - frame["length"]
        frame["sequence_id"] = frame["part"].astype(np.int64) * (1 << 32) + frame["bin"]
        if with_ids:
            frame["ids"] = [np.frombuffer(raw, "<u4").astype(np.int32) for raw in frame["ids"]]
        return frame[[f.name for f in placed.fields]]

    placed = T.StructType(
        [f for f in piece.fields if f.name not in ("salt", "ids")]
        + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    )
    result = pieces.groupBy("part").applyInPandas(place, placed)
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else [])
    return result.select(F.col("id").alias(id_col), *columns)
