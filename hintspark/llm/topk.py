"""Exact top-k search by inner product.

Vectors are processed by descending length. They are rotated by the singular vectors of all, so
that the first coordinates hold most of a product; what the others can add is at most the product
of the rests' lengths (Cauchy-Schwarz). A pair is dropped as soon as that bound shows that it
can't reach the query's k-th best score so far, and only the others are computed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hintspark.plans.shared import SharedTables

#: Vectors in a block of candidates, queries in a block, and queries and candidates looked at between updates.
BLOCK, QUERIES, STEP = 16_384, 8_192, 1_024
#: The longest vectors, among which a query finds its first bound.
FIRST = 2_048
#: Shares of the coordinates after which pairs are dropped.
STAGES = (0.25, 0.5)


def _packed(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.zeros((len(rows), width), np.int64)
    for i, values in enumerate(rows["v"]):
        matrix[i, : len(values)] = values
    return rows["id"].to_numpy(np.int64), matrix


def _blocks(vectors: DataFrame, width: int, size: int, name: str) -> DataFrame:
    """(name, longest, ids, data): rows of a partition, sorted by descending length, size at a time."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for part in parts:
            for at in range(0, len(part), size):
                ids, matrix = _packed(part.iloc[at : at + size], width)
                longest = float(np.sqrt((matrix.astype(float) ** 2).sum(1).max()))
                yield pd.DataFrame({name: [block], "longest": [longest], "ids": [ids.tobytes()], "data": [matrix.tobytes()]})
                block += 1

    return vectors.mapInPandas(pack, f"{name} long, longest double, ids binary, data binary")


def _matrix(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.int64).reshape(-1, width)


def _rotation(blocks: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, from the sum of the blocks' products (width squared numbers)."""

    def product(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for part in parts:
            for data in part["data"]:
                matrix = np.frombuffer(data, np.int64).reshape(-1, width).astype(float)
                total += matrix.T @ matrix
        yield pd.DataFrame({"at": np.arange(width * width), "value": total.ravel()})

    rows = blocks.select("data").mapInPandas(product, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    gram = np.zeros(width * width)
    for row in rows.collect():
        gram[row["at"]] = row["value"]
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()


class _Side:
    """Vectors, their rotation, and the lengths of what lies behind each stage."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, rotation: np.ndarray):
        self.ids, self.matrix, self.rotation = ids, matrix, rotation
        self.turned = matrix.astype(float) @ rotation
        squares = self.turned**2
        self.cuts = sorted({max(1, int(s * matrix.shape[1])) for s in STAGES})
        self.length = np.sqrt(squares.sum(1))
        self.rest = [np.sqrt(squares[:, c:].sum(1)) for c in self.cuts]


#: A floor that every score reaches.
NO_FLOOR = np.iinfo(np.int64).min


def best_of_block(query: _Side, other: _Side, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's k best among other that reach floor.

    other goes by descending length; floor, in whole numbers, rises as better scores are found.
    """
    floor = floor.copy()
    found_q, found_id, found_score = (np.zeros(0, np.int64) for _ in range(3))
    for at in range(0, len(other.ids), STEP):
        to = min(at + STEP, len(other.ids))
        slack = 1e-9 * query.length * other.length[at] + 1e-6
        if (query.length * other.length[at] + slack < floor).all():
            break
        rows, columns = np.arange(len(query.ids)), np.arange(at, to)
        alive = None
        for cut, query_rest, other_rest in zip(query.cuts, query.rest, other.rest):
            bound = query.turned[rows, :cut] @ other.turned[columns, :cut].T
            bound += query_rest[rows, None] * other_rest[None, columns]
            alive = bound >= (floor - slack)[rows, None]
            some_rows, some_columns = alive.any(1), alive.any(0)
            rows, columns, alive = rows[some_rows], columns[some_columns], alive[some_rows][:, some_columns]
            if not len(rows):
                break
        if not len(rows):
            continue
        i, j = np.nonzero(alive)
        i, j = rows[i], columns[j]
        other_than_own = query.ids[i] != other.ids[j]
        i, j = i[other_than_own], j[other_than_own]
        score = np.concatenate([np.einsum("nd,nd->n", query.matrix[i[s : s + 65_536]], other.matrix[j[s : s + 65_536]]) for s in range(0, len(i), 65_536)] or [np.zeros(0, np.int64)])
        good = score >= floor[i]
        found_q, found_id, found_score = np.append(found_q, i[good]), np.append(found_id, other.ids[j[good]]), np.append(found_score, score[good])
        order = np.lexsort((found_id, -found_score, found_q))
        found_q, found_id, found_score = found_q[order], found_id[order], found_score[order]
        start = np.searchsorted(found_q, found_q)
        place = np.arange(len(found_q)) - start
        last = place == k - 1
        np.maximum.at(floor, found_q[last], found_score[last])
        kept = place < k
        found_q, found_id, found_score = found_q[kept], found_id[kept], found_score[kept]
    return found_q, found_id, found_score


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows but those of its own id.

    A component x counts as floor(scale * x), the score is the integer inner product (it must fit
    64 bits); ties go to smaller ids. Vectors that are null or empty or hold a null or non-finite
    component, and null ids, take no part; a shorter vector counts as filled with zeros. Queries
    with fewer than k others get all. Rows with one id aren't compared with each other; a query row
    that is repeated gets its own k best each time, and a repeated candidate counts each time. No
    vectors or no queries give no rows. Other columns of vectors play no part.

    Queries and candidates are packed into blocks, and every pair of blocks whose lengths allow a
    hit is one group, so a task holds one block of each at a time. Each query starts from its k-th
    best score among the FIRST longest vectors, the only data that goes to all tasks.
    """
    spark, tables = vectors.sparkSession, SharedTables(vectors.sparkSession, "topk")
    value = F.col(vector_col)
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.col(id_col).isNotNull() & (F.size(value) > 0) & fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(value, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    whole = tables.keep(whole.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    shape = whole.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.max(F.size("v")).alias("width")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not shape["asks"]:
        return spark.createDataFrame([], result)
    n, width = shape["n"], shape["width"]
    size = int(min(BLOCK, max(1_024, -(-n // 16))))

    def sorted_blocks(rows: DataFrame, count: int, size: int, name: str) -> DataFrame:
        by = [F.col("square").desc(), F.col("id")]
        dealt = rows.repartitionByRange(max(1, -(-count // size)), *by).sortWithinPartitions(*by).select("id", "v")
        return tables.keep(_blocks(dealt, width, size, name))

    others = sorted_blocks(whole, n, size, "block")
    asked = sorted_blocks(whole.where("asks"), shape["asks"], QUERIES, "asking")
    rotation = _rotation(others, width)
    first = others.orderBy(F.col("longest").desc(), "block").limit(1).first()
    first_ids, first_matrix = (x[:FIRST] for x in _matrix(first, width))

    def some(query: _Side, floor: np.ndarray, other: _Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """best_of_block for STEP queries at a time, so that no bound on pairs grows with the block."""
        for at in range(0, len(query.ids), STEP):
            part = _Side(query.ids[at : at + STEP], query.matrix[at : at + STEP], query.rotation)
            found_q, found_id, score = best_of_block(part, other, floor[at : at + STEP], k)
            yield found_q + at, found_id, score

    def seed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = _Side(first_ids, first_matrix, rotation)
        for part in parts:
            for _, row in part.iterrows():
                query = _Side(*_matrix(row, width), rotation)
                floor = np.full(len(query.ids), NO_FLOOR)
                for found_q, _, score in some(query, floor.copy(), top):
                    start = np.searchsorted(found_q, found_q)
                    last = np.arange(len(found_q)) - start == k - 1
                    floor[found_q[last]] = score[last]
                lowest = np.where(floor == NO_FLOOR, -np.inf, floor.astype(float))
                reach = np.where(query.length > 0, lowest / np.maximum(query.length, 1e-300), np.where(lowest > 0, np.inf, -np.inf))
                yield pd.DataFrame({"asking": [row["asking"]], "reach": [float(reach.min())], "ids": [row["ids"]], "data": [row["data"]], "floor": [floor.tobytes()]})

    asked = tables.keep(asked.mapInPandas(seed, "asking long, reach double, ids binary, data binary, floor binary"))
    pairs = others.select("block", "longest").join(asked.select("asking", "reach"), F.col("longest") * (1 + 1e-9) >= F.col("reach")).select("block", "asking")
    pairs = tables.keep(pairs)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = right.iloc[0]
        query, other = _Side(*_matrix(row, width), rotation), _Side(*_matrix(left.iloc[0], width), rotation)
        rows = [pd.DataFrame({"query_id": query.ids[q], "asking": row["asking"], "place": q, "vec_id": i, "score": s}) for q, i, s in some(query, np.frombuffer(row["floor"], np.int64), other)]
        return pd.concat(rows)

    keys = ["block", "asking"]
    left = others.select("block", "ids", "data").join(pairs, "block").groupBy(*keys)
    right = asked.select("asking", "ids", "data", "floor").join(pairs, "asking").groupBy(*keys)
    found = left.cogroup(right).applyInPandas(search, "query_id long, asking long, place long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("asking", "place").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
