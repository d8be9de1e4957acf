"""Lexical retrieval: BM25 indexes and rankings, helper rankings, merging and pages."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from hintspark.functions import text as X
from hintspark.plans.numbering import Ordered
from hintspark.plans.shared import SharedTables

K1, B = 1.2, 0.75
#: Documents and queries that meet in one group.
BLOCK_DOCS, BLOCK_QUERIES = 2048, 1024


def postings(docs: DataFrame, terms: Column, id_col: str = "doc_id", catalog: tuple[str, ...] = ()) -> DataFrame:
    """(catalog..., id, length, term, tf): one row for each distinct term of a document."""
    rows = docs.select(*catalog, id_col, terms.alias("terms")).select(*catalog, id_col, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return rows.groupBy(*catalog, id_col, "length", "term").agg(F.count("*").alias("tf"))


def term_stats(index: DataFrame, catalog: tuple[str, ...] = ()) -> DataFrame:
    return index.groupBy(*catalog, "term").agg(F.count("*").alias("df"))


def collection_stats(docs: DataFrame, terms: Column, catalog: tuple[str, ...] = ()) -> DataFrame:
    """(catalog..., n, average): documents and their average number of terms; one row a catalog."""
    return docs.select(*catalog, F.size(terms).alias("length")).groupBy(*catalog).agg(F.count("*").alias("n"), F.avg("length").alias("average"))


def bm25_weight(tf: Column, df: Column, length: Column, n: Column, average: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def rounded(value: Column, places: int) -> Column:
    """A number that is not negative, rounded as SQL rounds a double: scaled, and halves up."""
    return F.floor(value * 10.0**places + 0.5) / 10.0**places


Finish = Callable[[np.ndarray, pa.Array, pa.Array], dict[str, pa.Array | np.ndarray]]


def _meet(finish: Finish, out: pa.Schema, catalog: tuple[str, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """What finish makes of the scores (queries, documents) of a block of documents and a block of queries.

    left: (id, length, codes), right: (query id, code, df, n, average). A score adds a query's terms up in the order of
    their codes, so documents of equal terms have equal scores wherever they lie.
    """
    if not len(left) or not len(right):
        return out.empty_table()
    ids, asking = (t.column(len(catalog)).combine_chunks().dictionary_encode(null_encoding="encode") for t in (left, right))
    number = lambda t, name: t.column(name).to_numpy()
    length, code, query = number(left, "length").astype(float), number(right, "code"), asking.indices.to_numpy()
    terms, first = np.unique(code, return_index=True)
    n, average = right.column("n")[0].as_py(), right.column("average")[0].as_py()
    idf = np.array([math.log(1 + (n - df + 0.5) / (df + 0.5)) for df in number(right, "df")[first].tolist()])
    codes = left.column("codes").combine_chunks()
    row, flat = np.repeat(np.arange(len(left)), np.diff(codes.offsets.to_numpy())), codes.flatten().to_numpy()
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    there = terms[at] == flat
    places, tf = np.unique(at[there] * len(left) + row[there], return_counts=True)
    row = places % len(left)
    weight = idf[places // len(left)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / average))
    ends = np.searchsorted(places, np.arange(len(terms) + 1) * len(left))
    order = np.argsort(code, kind="stable")
    wanted, wanted_ends = query[order], np.append(np.searchsorted(code[order], terms), len(code))
    scores = np.zeros((len(asking.dictionary), len(left)))
    for k in np.flatnonzero(np.diff(ends)):
        some = slice(ends[k], ends[k + 1])
        scores[np.ix_(wanted[wanted_ends[k] : wanted_ends[k + 1]], row[some])] += weight[some]
    if len(ids.dictionary) < len(left):  # an id of several lengths
        merged = np.zeros((len(ids.dictionary), len(scores)))
        np.add.at(merged, ids.indices.to_numpy(), scores.T)
        scores = merged.T
    found = finish(scores, asking.dictionary, ids.dictionary)
    rows = len(next(iter(found.values())))
    fixed = {c: pa.repeat(right.column(c)[0], rows) for c in catalog}
    return pa.Table.from_arrays([pa.array({**fixed, **found}[f.name], f.type) for f in out], schema=out)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Scores of nine decimals, as SQL rounds them."""
    scaled = scores * 1e9
    whole = np.floor(scaled)
    return (whole + (scaled - whole >= 0.5)) / 1e9


def bm25_blocks(
    queries: DataFrame, docs: DataFrame, query_terms: Column, doc_terms: Column, finish: Finish, schema: str, query_id: str = "query_id", id_col: str = "doc_id", catalog: tuple[str, ...] = ()
) -> DataFrame:
    """Rows (catalog..., schema) that finish makes of the BM25 scores of every block of queries and documents.

    Documents and queries are dealt into blocks by their ids, and each block of documents meets each block of queries of
    its catalog in one group, whose scores are a matrix; no row is shuffled for a pair. Only terms that some query has
    are kept of the documents, as numbers. A catalog's queries meet only its own documents and statistics. Repeated
    query terms count once.
    """
    tables = SharedTables(docs.sparkSession, "bm25")
    asked = queries.select(*catalog, query_id, F.explode(query_terms).alias("term")).distinct()
    coded = tables.keep(Ordered(asked.select("term").where("term IS NOT NULL").distinct(), ["term"], tables).numbered("code").withColumn("code", F.col("code").cast("int")))
    held = docs.select(*catalog, id_col, doc_terms.alias("terms")).select(*catalog, id_col, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    held = held.join(coded, "term").groupBy(*catalog, id_col, "length").agg(F.collect_list("code").alias("codes"))
    df = held.select(*catalog, F.explode(F.array_distinct("codes")).alias("code")).groupBy(*catalog, "code").agg(F.count("*").alias("df"))
    in_catalog = lambda rows, other: rows.join(other, list(catalog)) if catalog else rows.join(F.broadcast(other))  # one row
    sizes = in_catalog(collection_stats(docs, doc_terms, catalog), queries.groupBy(*catalog).agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("lots")))
    sizes = tables.keep(sizes.select(*catalog, "n", "average", F.ceil(F.col("n") / BLOCK_DOCS).alias("blocks"), "lots"))
    block = lambda key, count: F.pmod(F.xxhash64(key), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = in_catalog(held, sizes).select(*catalog, id_col, "length", "codes", block(id_col, "blocks").alias("__block"), every("lots").alias("__lot"))
    right = in_catalog(asked.join(coded, "term").join(df, [*catalog, "code"]), sizes)
    right = right.select(*catalog, query_id, "code", "df", "n", "average", every("blocks").alias("__block"), block(query_id, "lots").alias("__lot"))
    kinds = docs.sparkSession.createDataFrame([], schema).schema.fields
    out = T.StructType([*(docs.schema[c] for c in catalog), *kinds])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    keys = [*catalog, "__block", "__lot"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _meet(finish, arrow, catalog, a, b), out)


def bm25_scores(
    queries: DataFrame, docs: DataFrame, query_terms: Column, doc_terms: Column, query_id: str = "query_id", id_col: str = "doc_id", catalog: tuple[str, ...] = (), best: int | None = None
) -> DataFrame:
    """(catalog..., query_id, id, score) of all pairs that share a term; scores have nine decimals.

    With best, a block of documents gives only the scores that reach its best-th for a query, ties included, which is
    all that a ranking of so many places needs.
    """

    def pairs(scores: np.ndarray, asking: pa.Array, ids: pa.Array) -> dict[str, pa.Array | np.ndarray]:
        kept, scores = scores > 0, _rounded(scores)
        if best is not None and best < scores.shape[1]:
            kept &= scores >= np.partition(scores, -best, axis=1)[:, [-best]]
        query, doc = np.nonzero(kept)
        return {query_id: asking.take(pa.array(query)), id_col: ids.take(pa.array(doc)), "score": scores[query, doc]}

    kinds = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double"
    return bm25_blocks(queries, docs, query_terms, doc_terms, pairs, kinds, query_id, id_col, catalog)


def bm25_extent(queries: DataFrame, docs: DataFrame, query_terms: Column, doc_terms: Column, query_id: str = "query_id", id_col: str = "doc_id", catalog: tuple[str, ...] = ()) -> DataFrame:
    """(catalog..., id, pairs, best) of bm25_scores(): how many queries a document shares a term with, and its best score; pairs are
    counted where they are scored, and a document has a row for each block of queries."""

    def extent(scores: np.ndarray, asking: pa.Array, ids: pa.Array) -> dict[str, pa.Array | np.ndarray]:
        pairs = (scores > 0).sum(0)
        some = np.flatnonzero(pairs)
        return {id_col: ids.take(pa.array(some)), "pairs": pairs[some], "best": _rounded(scores.max(0))[some]}

    kinds = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, pairs long, best double"
    return bm25_blocks(queries, docs, query_terms, doc_terms, extent, kinds, query_id, id_col, catalog)


def ranked(scores: DataFrame, by: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """scores with their rank among the rows of the same by columns."""
    out = scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out.where(F.col("rank") <= limit) if limit else out


def bm25_topk(scores: DataFrame, k: int = 10, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """Positive scores by rank, ties to smaller ids."""
    return ranked(scores.where("score > 0"), [query_id], [F.col("score").desc(), F.col(id_col)], k)


def chunk_lines(docs: DataFrame, size: int = 32, stride: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, chunk): windows of lines; lines count from 1, and the last window ends the text."""
    lines = docs.select(id_col, F.split(text_col, "\n").alias("lines")).withColumn("count", F.size("lines"))
    last = F.greatest(F.lit(0), F.ceil((F.col("count") - size) / stride)).cast("int")
    starts = lines.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("at") * stride
    return starts.select(
        id_col, (start + 1).alias("start"), F.least(start + size, F.col("count")).alias("end"), F.array_join(F.slice("lines", start + 1, F.lit(size)), "\n").alias("chunk")
    )


def first_by_digest(rows: DataFrame, by: list[str], digest: Column, limit: int) -> DataFrame:
    """rows with their rank by a hexadecimal digest, up to limit; what can't be among them is left out before any sort.

    Digests are counted by their first three digits, which tells up to where a group has limit rows.
    """
    tables = SharedTables(rows.sparkSession, "digests")
    head = F.substring(digest, 1, 3)
    counts = rows.groupBy(*by, head.alias("__head")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*by).orderBy("__head")) - F.col("__n")
    last = tables.keep(counts.withColumn("__before", before).where(F.col("__before") < limit).groupBy(*by).agg(F.max("__head").alias("__last")))
    some = rows.join(last, by).where(head <= F.col("__last")).drop("__last")
    return ranked(some, by, [digest], limit)


def fuse_rerank(rows: DataFrame, by: list[str], lexical: str, relevance: str, order: list[str]) -> DataFrame:
    """Half the lexical score relative to the group's best, half the relevance."""
    top = F.max(lexical).over(W.partitionBy(*by))
    fused = F.when(top > 0, 0.5 * F.col(lexical) / top).otherwise(0.0) + 0.5 * F.col(relevance)
    return ranked(rows.withColumn("fused", F.round(fused, 9)), by, [F.col("fused").desc(), *map(F.col, order)])


def suppress_overlaps(rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Greedy choice by rank: a chunk that overlaps a chosen one of its path by more than half of
    the shorter is left out, and each group ends at limit. rows: by..., path, start, end, rank.

    Groups are dealt over tasks; a group's rows arrive sorted, and only its chosen ones are held.
    """

    def choose(parts):
        current, chosen = None, []
        for part in parts:
            keep = []
            for row in part.itertuples(index=False):
                key = tuple(getattr(row, c) for c in by)
                if key != current:
                    current, chosen = key, []
                if len(chosen) == limit:
                    keep.append(False)
                    continue
                size = row.end - row.start + 1
                clash = any(p == row.path and 2 * (min(e, row.end) - max(s, row.start) + 1) > min(size, e - s + 1) for p, s, e in chosen)
                keep.append(not clash)
                if not clash:
                    chosen.append((row.path, row.start, row.end))
            yield part[pd.Series(keep, index=part.index, dtype=bool)]

    return rows.repartition(*by).sortWithinPartitions(*by, "rank").mapInPandas(choose, rows.schema)


def field_weighted_terms(docs: DataFrame, fields: dict[str, int], id_col: str = "doc_id") -> DataFrame:
    """docs with terms: the words of every field, each as often as its weight says."""
    parts = [F.flatten(F.array_repeat(X.words(F.coalesce(F.col(f), F.lit(""))), w)) for f, w in fields.items()]
    return docs.withColumn("terms", F.concat(*parts))


def preview_decision(top: Column, second: Column, other_script: Column, least: float = 1.0, margin: float = 0.25) -> Column:
    """struct(decision, reason) from the two best scores of a query."""
    reason = (
        F.when(top.isNull() | (top <= 0), "no_evidence").when(other_script, "language").when(top < least, "confidence").when((top - F.coalesce(second, F.lit(0.0))) / top < margin, "margin").otherwise("clear")
    )
    decision = F.when(reason == "clear", "suggest").when(reason == "margin", "candidate").otherwise("abstain")
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def reciprocal_rank_fusion(rankings: list[DataFrame], by: list[str], id_col: str, k: int = 64, offset: int = 60) -> DataFrame:
    """Sum of 1 / (offset + rank) over rankings of positive scores; ties to smaller ids."""
    rows = rankings[0].select(*by, id_col, "rank")
    for other in rankings[1:]:
        rows = rows.unionByName(other.select(*by, id_col, "rank"))
    fused = rows.groupBy(*by, id_col).agg(F.round(F.sum(1 / (offset + F.col("rank"))), 12).alias("score"))
    return ranked(fused, by, [F.col("score").desc(), F.col(id_col)], k)


def explicit_path_matches(queries: DataFrame, paths: DataFrame, query_id: str, k: int = 64) -> DataFrame:
    """Paths that a query's tokens with / or . name whole or by a suffix from a /.

    Every suffix of a path is a row, so the match is an equi-join. Longer evidence (segments, then
    bytes) ranks first, then the path. queries: (query_id, catalog, text); paths: (catalog, path).
    """
    tokens = F.filter(F.split("text", r"[\s,;:()\"'`<>]+"), lambda t: t.rlike("[/.]") & t.rlike(r"[\p{L}\p{N}]"))
    asked = queries.select(query_id, "catalog", F.explode(F.array_distinct(tokens)).alias("token"))
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    named = paths.select("catalog", "path", F.explode(suffixes).alias("token"))
    found = asked.join(named, ["catalog", "token"]).select(query_id, "path", F.size(F.split("token", "/")).alias("segments"), F.octet_length("token").alias("bytes"))
    best = found.groupBy(query_id, "path").agg(F.max(F.struct("segments", "bytes")).alias("e")).select(query_id, "path", "e.segments", "e.bytes")
    return ranked(best, [query_id], [F.col("segments").desc(), F.col("bytes").desc(), F.col("path")], k)


def zero_runs(positive: DataFrame, places: DataFrame, queries: DataFrame, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """(query_id, first, last, before): for every query the runs of catalog places without a score, and how many scored
    places lie before each. The document at a run's place p has rank positives + p - before.

    positive: (query_id, id) with a score; places: (id, place) of the whole catalog, places counting from 1. There is at
    most one run more than there are scored documents, so a complete order takes no more rows than a positive one.
    """
    size = places.agg(F.max("place").alias("n"))
    ends = queries.select(query_id).distinct().join(F.broadcast(size)).select(query_id, (F.col("n") + 1).alias("place"))  # one row
    scored = positive.select(query_id, id_col).join(places, id_col).select(query_id, "place").unionByName(ends)
    order = W.partitionBy(query_id).orderBy("place")
    gaps = scored.select(query_id, (F.coalesce(F.lag("place").over(order), F.lit(0)) + 1).alias("first"), (F.col("place") - 1).alias("last"), (F.row_number().over(order) - 1).alias("before"))
    return gaps.where("first <= last")


def complete_order(positive: DataFrame, docs: DataFrame, queries: DataFrame, query_id: str = "query_id", id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, rank, score) of every document for every query: scored ones as ranked, then all others in catalog order.

    positive: (query_id, id, rank, score). Ranks of documents without a score come from the runs between scored places,
    which are only unrolled here; no query meets the catalog in a join of all with all.
    """
    tables = SharedTables(docs.sparkSession, "complete-order")
    places = tables.keep(Ordered(docs.select(id_col).distinct(), [id_col], tables).numbered("place"))
    positive = tables.keep(positive.select(query_id, id_col, "rank", "score"))
    counts = positive.groupBy(query_id).agg(F.count("*").alias("positives"))
    runs = zero_runs(positive, places, queries, query_id, id_col).join(counts, query_id, "left")
    rest = runs.select(query_id, "before", "positives", F.explode(F.sequence("first", "last")).alias("place"))
    rank = F.coalesce("positives", F.lit(0)) + F.col("place") - F.col("before")
    zeros = rest.join(places, "place").select(query_id, id_col, rank.cast("int").alias("rank"), F.lit(0.0).alias("score"))
    return positive.unionByName(zeros)


def interleave(ranks: DataFrame, query_id: str, id_col: str, mode: str = "baseline_first", prefix: int = 0) -> DataFrame:
    """A merged order of two rankings that loses nothing.

    ranks: (query_id, id, baseline_rank, hint_rank or null); baseline ranks count from 1 without gaps, ids don't repeat.
    Sides take turns, each emitting its next candidate that isn't emitted yet; with after_prefix the first prefix
    baseline candidates come first. Whether a turn skips depends on the turns before it, but only until a query's hints
    are used up: m hints take m turns, in which the baseline moves past 2 m candidates at most. So a query's group holds
    its hints and that part of its baseline; the rest follows in its order, by arithmetic. ranks is read three times and
    never shuffled but for that part, so store it if it is costly; what is joined to it is small and stored here.
    """

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("baseline_rank")
        places = dict(zip(frame[id_col].iloc[::-1], frame["baseline_rank"].iloc[::-1]))
        base, wanted = frame[id_col].tolist(), frame.dropna(subset=["hint_rank"]).sort_values("hint_rank")[id_col].tolist()
        order = dict.fromkeys(base[:prefix] if mode == "after_prefix" else [])
        sides = [iter(base), iter(wanted)] if mode != "hint_first" else [iter(wanted), iter(base)]
        missing = set(wanted) - set(order)
        while missing:
            for side in sides:
                found = next((x for x in side if x not in order), None)
                if found is not None:
                    order[found] = None
                    missing.discard(found)
        return pd.DataFrame({query_id: frame[query_id].iloc[0], id_col: list(order), "baseline_rank": [places[x] for x in order], "rank": range(1, len(order) + 1)})

    tables = SharedTables(ranks.sparkSession, "interleave")
    given = ranks.select(query_id, id_col, "baseline_rank", "hint_rank")
    hints = tables.keep(given.groupBy(query_id).agg(F.count("hint_rank").alias("__hints")))
    head = given.join(hints, query_id).where(F.col("hint_rank").isNotNull() | (F.col("baseline_rank") <= 2 * F.col("__hints") + prefix)).drop("__hints")
    kinds = given.schema
    merged = tables.keep(head.groupBy(query_id).applyInPandas(merge, T.StructType([kinds[query_id], kinds[id_col], kinds["baseline_rank"], T.StructField("rank", T.IntegerType())])))
    taken = merged.groupBy(query_id).agg(F.sort_array(F.collect_list("baseline_rank")).alias("__taken"))  # as many as the groups above
    rest = given.join(merged.select(query_id, id_col), [query_id, id_col], "left_anti").join(taken, query_id, "left")
    earlier = F.size(F.filter(F.coalesce("__taken", F.array().cast(T.ArrayType(kinds["baseline_rank"].dataType))), lambda r: r < F.col("baseline_rank")))
    after = F.coalesce(F.size("__taken"), F.lit(0)) + F.col("baseline_rank") - earlier
    return merged.select(query_id, id_col, "rank").unionByName(rest.select(query_id, id_col, after.cast("int").alias("rank")))


def page_of(rank: Column, size: int) -> Column:
    return F.ceil(rank / size).cast("int")


def ranking_digest(rows: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """A digest of each group's values in their order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("value")))), lambda s: s["value"]), "\n")
    return rows.groupBy(*by).agg(F.sha2(listed, 256).alias("digest"), F.count("*").alias("rows"))


def group_queries(rows: DataFrame, query: str, target: str, repository: str) -> DataFrame:
    """Distinct normalized queries with their targets, and their repository, or `multiple`."""
    many = F.count_distinct(repository) > 1
    return rows.groupBy(X.normalize_query(F.col(query)).alias("query")).agg(
        F.sort_array(F.collect_set(target)).alias("targets"), F.when(many, "multiple").otherwise(F.min(repository)).alias("repository"), F.count("*").alias("rows")
    )


def linear_rerank(candidates: DataFrame, query_id: str, id_col: str, score: Column, eligible: Column) -> DataFrame:
    """Candidates (query_id, id, rank) in the order of a score; queries with a candidate out of scope keep their order."""
    whole = F.bool_and("__in").over(W.partitionBy(query_id))
    rows = candidates.withColumn("__s", F.round(score, 9)).withColumn("__in", eligible).withColumn("reranked", whole)
    order = [F.when(F.col("reranked"), F.col("__s")).desc_nulls_last(), F.col("rank"), F.col(id_col)]
    return rows.withColumn("new_rank", F.row_number().over(W.partitionBy(query_id).orderBy(*order))).drop("__s", "__in")
