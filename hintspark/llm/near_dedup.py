"""Near-duplicates by Order MinHash.

A text's k-mers, runs of five words, are labelled with their occurrence, so that repeats count.
Each of several hash functions picks the three labelled k-mers with the least values and keeps
them in the order they have in the text; texts agree in such a pick the likelier, the more k-mers
they share in the same order. Texts with a pick in common are candidates, and an alignment inside
a band around the diagonal decides: at most a fifth of the longer text's words may be edited.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hintspark.plans.components import stars
from hintspark.plans.shared import SharedTables, arrow_rows

WORDS, PICKED, HASHES, SIMILARITY = 5, 3, 24, 0.8
#: Rare words that two near-duplicates share at least, beyond those that may be edited, and the bins
#: that tell rare from frequent; bins change what is compared first, never the result.
SHARED, BINS, RUN = 3, 2**20, 2**12
_DRAW = np.random.default_rng(29)
_MIX = _DRAW.integers(1, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_HASH = _DRAW.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def labelled_kmers(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """A hash for every k-mer and its occurrence; a text of fewer words than size is one k-mer."""
    wide = words.astype(np.uint64) + np.uint64(1)
    size = min(size, len(wide))
    if not size:
        return np.zeros(0, np.uint64)
    count = len(wide) - size + 1
    h = np.zeros(count, np.uint64)
    for k in range(size):
        h += wide[k : k + count] * _MIX[k]
    h = _scramble(h)
    order = np.argsort(h, kind="stable")
    new = np.ones(count, bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if not new.all():
        start = np.maximum.accumulate(np.where(new, np.arange(count), 0))
        occurrence = np.empty(count, np.uint64)
        occurrence[order] = (np.arange(count) - start).astype(np.uint64)
        h = np.where(occurrence > 0, _scramble(h + occurrence * _MIX[9]), h)
    return h


def order_minhash(kmers: np.ndarray, hashes: int = HASHES, picked: int = PICKED) -> np.ndarray:
    """One number for each hash function: its least k-mers in text order."""
    if not len(kmers):
        return np.zeros(0, np.int64)
    values = kmers[None, :] * _HASH[:hashes, None]
    rows, least = np.arange(hashes), []
    for _ in range(min(picked, len(kmers))):
        at = values.argmin(1)
        values[rows, at] = np.uint64(2**64 - 1)
        least.append(at)
    at = np.sort(np.array(least).T, axis=1)
    out = np.zeros(hashes, np.uint64)
    for k in range(at.shape[1]):
        out += kmers[at[:, k]] * _MIX[10 + k]
    return _scramble(out + np.arange(hashes, dtype=np.uint64) * _MIX[15]).view(np.int64)


def _full_distance(pattern: list[int], text: list[int]) -> int:
    """Edit distance with one bit for each word of pattern."""
    at: dict[int, int] = {}
    for i, word in enumerate(pattern):
        at[word] = at.get(word, 0) | 1 << i
    whole, last, distance = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1), len(pattern)
    up, down = whole, 0
    for word in text:
        same = at.get(word, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(diagonal | up) & whole, diagonal & up
        distance += bool(right & last) - bool(left & last)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(diagonal | right)) & whole, diagonal & right & whole
    return distance


def _band_distance(pattern: list[int], text: list[int], most: int) -> int | None:
    """Edit distance, or None if over most; only cells within most of the diagonal are seen.

    Bit i of a column stands for the row that lies most - i above the diagonal, so the band moves
    down a row with every column. Needs most < len(pattern) <= len(text) <= len(pattern) + most.
    """
    at: dict[int, int] = {}
    for i, word in enumerate(pattern):
        at[word] = at.get(word, 0) | 1 << i
    rows, columns, width = len(pattern), len(text), 2 * most + 1
    whole, edge = (1 << width) - 1, 1 << (width - 1)
    up, down = whole & ~((1 << most) - 1), 0
    distance, give_up = most, 2 * most + columns - rows
    last = edge
    for j, word in enumerate(text):
        same = at.get(word, 0)
        shift = j - most
        same = (same >> shift if shift > 0 else same << -shift) & whole
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(diagonal | up) & whole, diagonal & up
        if j + most < rows:
            distance += not diagonal & edge
            if distance > give_up:
                return None
        else:
            last >>= 1
            distance += bool(right & last) - bool(left & last)
        slid = (diagonal & whole) >> 1
        up, down = (left | ~(slid | right)) & whole, slid & right & whole
    return distance if distance <= most else None


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Words to insert, delete or replace to turn a into b, or None if more than most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    values, counts = np.unique(a, return_counts=True)
    others, other_counts = np.unique(b, return_counts=True)
    common, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    if len(b) - int(np.minimum(counts[i], other_counts[j]).sum()) > most:
        return None
    differ = np.flatnonzero(a != b[: len(a)])
    start = int(differ[0]) if len(differ) else len(a)
    a, b = a[start:], b[start:]
    if not len(a):
        return len(b)
    differ = np.flatnonzero(a[::-1] != b[len(b) - len(a) :][::-1])
    end = int(differ[0]) if len(differ) else len(a)
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a):
        return len(b)
    short, long = a.tolist(), b.tolist()
    if most < len(short):
        return _band_distance(short, long, most)
    distance = _full_distance(short, long)
    return distance if distance <= most else None


def text_node(text: Column) -> Column:
    """A digest of a text's lower-case words; null and empty texts have the one of no words."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))))


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, node (a digest of the text's words), n_words, picks, and the words as 32-bit hashes."""
    text = F.col(text_col)
    given = docs.select(F.col(id_col).alias("id"), text_node(text).alias("node"), F.lower(F.coalesce(text, F.lit(""))).cast("binary").alias("text"))
    schema = T.StructType([
        given.schema["id"], T.StructField("node", T.BinaryType()), T.StructField("n_words", T.LongType()),
        T.StructField("picks", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()),
    ])

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1000):
                some = part.slice(at, 1000)
                sizes, picks, raws = [], [], []
                for value in some.column(2):
                    words = value.as_py().split()
                    hashed = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
                    sizes.append(len(words))
                    picks.append(order_minhash(labelled_kmers(hashed)))
                    raws.append(hashed.tobytes())
                columns = [some.column(0), some.column(1), pa.array(sizes, pa.int64()), pa.array(picks, pa.list_(pa.int64())), pa.array(raws, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(sketch, schema)


def _ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, keep: tuple[str, str] = ("u", "v")) -> DataFrame:
    """keep of the pairs (u, v) of nodes whose texts (node, words) are near-duplicates."""
    texts = texts.join(_ends_of(pairs), "node", "left_semi")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("words").alias("u_words")), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("words").alias("v_words")), "v").select(*keep, "u_words", "v_words")

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = []
            for x, y in zip(part.column(2), part.column(3)):
                a, b = (np.frombuffer(w.as_py(), np.uint32) for w in (x, y))
                good.append(edit_distance(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)) is not None)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in part.columns[:2]], names=[*keep])

    return both.mapInArrow(align, f"{keep[0]} binary, {keep[1]} binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, class_id, n_words for every row; class_id is the least id of the texts linked to its text.

    Letters' case and white space don't count. Equal texts are one node from the start, so a large
    group of copies costs one row a copy; texts without words are copies of each other. Other
    nodes meet in the buckets of equal picks, where each is paired with three centres: the first
    and the last node and one drawn anew for each bucket. The pair that most buckets propose for a
    node is verified first, and of the others all that lie in different classes after that. Of the
    pairs without a centre, all are verified that lie in different classes even then, but for those
    that can't be near-duplicates by their lengths or their rarest words.
    Null ids are never a class_id if another id is there. Repeated rows share a class; an empty
    table gives no rows. Other columns of docs, whatever their names, play no part.

    Two texts with at least 0.8 of their labelled k-mers in common share a bucket but for one case
    in 10**7. Buckets are never cut: minima and maxima are partial aggregates, the joins can be
    split. A node is first paired with at most three centres for each of its buckets; after that
    only nodes of different classes are.
    """
    return _classes(docs, id_col, text_col, similarity).select(F.col("id").alias(id_col), "class_id", "n_words")


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """id, node, n_words, class (a node of it) and class_id for every row."""
    with arrow_rows(docs.sparkSession, 1000):
        return _found_classes(docs, id_col, text_col, similarity)


def _found_classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    tables = SharedTables(docs.sparkSession, "near-dedup")
    rows = tables.keep(_sketched(docs, id_col, text_col))
    nodes = tables.keep(rows.groupBy("node").agg(F.min("id").alias("id"), F.first("picks").alias("picks")))
    meta = tables.keep(rows.select("id", "node", "n_words"))
    buckets = nodes.select("node", F.explode("picks").alias("pick"))
    centres = buckets.groupBy("pick").agg(*_centres(F.col("node"))).where("low <> high")
    met = tables.keep(buckets.join(centres, "pick"))
    texts = tables.keep(rows.select("node", "words").join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words")))
    tables.drop(rows)
    proposed = met.select(F.explode(F.array_distinct(F.array("low", "high", "any"))).alias("u"), F.col("node").alias("v")).where("u <> v")
    proposed = proposed.repartition("v").groupBy("u", "v").agg(F.count("*").alias("n"))  # a node has three centres a hash function at most
    best = tables.keep(proposed.groupBy("v").agg(F.max(F.struct("n", "u")).alias("b")).select(F.col("b.u").alias("u"), "v"))
    classes = stars(_verified(best, texts, similarity), tables)
    rest = _centres_apart(_with_class(met.select("pick", "node"), classes, "node", "class")).join(best, ["u", "v"], "left_anti")
    links = _verified(tables.keep(rest), texts, similarity, ("u_class", "v_class"))
    placed = tables.keep(_joined(_with_class(nodes.select("node", "id"), classes, "node", "class"), links, tables))
    links = _verified(_unseen_pairs(met, placed, texts, similarity, tables), texts, similarity, ("u_class", "v_class"))
    by_node = tables.keep(_joined(placed, links, tables))
    least = by_node.groupBy("class").agg(F.min("id").alias("class_id"))
    by_node = by_node.join(least, "class").select("node", "class", "class_id")
    return meta.join(by_node, "node").select("id", "node", "n_words", "class", "class_id")


def _with_class(frame: DataFrame, classes: DataFrame, node: str, name: str) -> DataFrame:
    """frame with the class of its column node; a node that isn't there is its own class."""
    other = classes.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    joined = frame.join(other, F.col(node) == F.col("__node"), "left")
    return joined.withColumn(name, F.coalesce("__component", node)).drop("__node", "__component")


def _centres(member: Column) -> list[Column]:
    """A bucket's centres as aggregates of member, its node or a struct that begins with it."""
    return [F.min(member).alias("low"), F.max(member).alias("high"), F.min_by(member, F.xxhash64("pick", "node")).alias("any")]


def _centres_apart(inside: DataFrame) -> DataFrame:
    """(u, v, u_class, v_class): nodes v with the centres u of their buckets that lie in another class.

    inside: pick, node and class of every entry. Only buckets of several classes are joined with
    their centres, so the pairs inside a class are never made, however many copies it has.
    """
    several = F.min("class") != F.max("class")
    centres = inside.groupBy("pick").agg(*_centres(F.struct("node", "class")), several.alias("several")).where("several").drop("several")
    pairs = inside.join(centres, "pick").select(F.explode(F.array("low", "high", "any")).alias("u"), F.col("node").alias("v"), F.col("class").alias("v_class"))
    return pairs.select("u.node", "v", "u.class", "v_class").toDF("u", "v", "u_class", "v_class").where("u_class <> v_class").dropDuplicates(["u", "v"])


def _joined(placed: DataFrame, links: DataFrame, tables: SharedTables) -> DataFrame:
    """placed (node, id, class) with the classes that the pairs (u_class, v_class) of links join."""
    joined = stars(links.select(F.col("u_class").alias("u"), F.col("v_class").alias("v")), tables)
    final = joined.select(F.col("node").alias("__old"), F.col("component").alias("__new"))
    return placed.join(final, F.col("class") == F.col("__old"), "left").select("node", "id", F.coalesce("__new", "class").alias("class"))


def needed(n: int) -> int:
    """Rare words that a text of n words must share with a near-duplicate that needs as many or more."""
    return min(SHARED + n // 20, n)


def _levels(texts: DataFrame) -> np.ndarray:
    """How frequent the labelled words of each bin are: zero for one at most, four more for twice as many.

    Tasks pass on counts of bins; runs of bins are packed into a byte each before they reach the
    driver, which gets BINS bytes, however many texts there are.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for part in parts:
            for raw in part.column(0):
                np.add.at(total, labelled_kmers(np.frombuffer(raw.as_py(), np.uint32), 1) % np.uint64(BINS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bin", "n"])

    def pack(run: pa.Table) -> pa.Table:
        packed = np.zeros(RUN, np.uint8)
        packed[run["bin"].to_numpy() % RUN] = np.ceil(4 * np.log2(run["n"].to_numpy().astype(float)))
        return pa.table({"run": run["run"].slice(0, 1), "levels": pa.array([packed.tobytes()], pa.binary())})

    counted = texts.select("words").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    runs = counted.withColumn("run", F.floor(F.col("bin") / RUN).cast("int")).groupBy("run").applyInArrow(pack, "run int, levels binary")
    levels = np.zeros(BINS, np.uint8)
    for r in runs.collect():
        levels[r["run"] * RUN : (r["run"] + 1) * RUN] = np.frombuffer(r["levels"], np.uint8)
    return levels


def _rare_words(texts: DataFrame, levels: np.ndarray, similarity: float) -> DataFrame:
    """texts (node, class, picks, words) with n, how many words there are, and rare, the rarest labelled ones that another text can have."""
    names = ["node", "class", "picks", "n", "rare"]

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, chosen = [], []
            for raw in part.column(3):
                words = np.frombuffer(raw.as_py(), np.uint32)
                found = labelled_kmers(words, 1)
                level = levels[found % np.uint64(BINS)]
                rarest = np.lexsort((found, level))[: int((1 - similarity) * len(words) + 1e-9) + needed(len(words))]
                sizes.append(len(words))
                chosen.append(found[rarest][level[rarest] > 0].view(np.int64))
            columns = [*part.columns[:3], pa.array(sizes, pa.int64()), pa.array(chosen, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.select(*names[:3], "words").mapInArrow(choose, "node binary, class binary, picks array<long>, n long, rare array<long>")


def _unseen_pairs(met: DataFrame, placed: DataFrame, texts: DataFrame, similarity: float, tables: SharedTables) -> DataFrame:
    """(u, v, u_class, v_class): all pairs of a bucket that lie in different classes and can be near-duplicates.

    met has the entries (pick, node) of the buckets of several nodes. In a bucket of several classes
    the nodes outside its largest class meet all: at most twice the pairs that lie in different
    classes. A pair comes from the least pick that it shares, and only if its lengths and rarest
    words allow it. Words are labelled with their occurrence. A near-duplicate of a text of n words
    lacks m of them at most, a fifth; it has needed(n) of the m + needed(n) rarest in common with
    those of any near-duplicate that needs as many, in whatever order both are ranked; words of a
    passage that fills the bucket come last. All this is part of the join's condition, so that no
    pair that fails it is written.
    """
    buckets = tables.keep(met.select("pick", "node").join(placed.select("node", "class"), "node"))
    sizes = buckets.groupBy("pick", "class").agg(F.count("*").alias("k")).groupBy("pick")
    several = tables.keep(sizes.agg(F.max(F.struct("k", "class"))["class"].alias("largest"), F.count("*").alias("classes")).where("classes > 1").select("pick", "largest"))
    members = buckets.join(several, "pick", "left_semi").groupBy("node", "class").agg(F.array_sort(F.collect_set("pick")).alias("picks"))
    told = tables.keep(texts.join(members, "node"))
    tables.drop(buckets)
    entries = tables.keep(_rare_words(told, _levels(told), similarity))
    tables.drop(told)
    sides = [entries.select(F.explode("picks").alias("pick"), *(F.col(c).alias(f"{side}_{c}") for c in entries.columns)) for side in "uv"]
    most = F.floor((1 - similarity) * F.greatest("u_n", "v_n") + 1e-9).cast("int")
    fewer = F.least("u_n", "v_n")
    met = sides[0].join(several, "pick").where("u_class <> largest").join(sides[1], "pick")
    met = met.where("u_class <> v_class AND (v_class = largest OR u_node < v_node)").where(F.abs(F.col("u_n") - F.col("v_n")) <= most)
    met = met.where(F.get(F.array_intersect("u_picks", "v_picks"), 0) == F.col("pick"))
    met = met.where(F.size(F.array_intersect("u_rare", "v_rare")) >= F.least(SHARED + F.floor(fewer / 20), fewer))
    return tables.keep(met.select(F.col("u_node").alias("u"), F.col("v_node").alias("v"), "u_class", "v_class"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each class: the one with the class's least id, null ids last.

    Rows are told apart by id and text: different texts that share an id are kept or dropped each by
    its own class. Of rows with one id and equal words, one stays. All columns stay as they are.
    """
    tables = SharedTables(docs.sparkSession, "near-dedup")
    judged = tables.keep(_classes(docs, id_col, text_col, SIMILARITY).select("id", "node", "class"))
    least = judged.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("b"))
    kept = least.select(F.col("b.id").alias("__id"), F.col("b.node").alias("__node"))
    copies = judged.groupBy(F.col("id").alias("__id"), F.col("node").alias("__node")).agg(F.count("*").alias("__n"))
    kept = tables.keep(kept.alias("k").join(copies.alias("c"), F.col("k.__id").eqNullSafe(F.col("c.__id")) & (F.col("k.__node") == F.col("c.__node"))).select("k.*", "__n"))
    named = docs.withColumn("__near_node", text_node(F.col(text_col)))

    def those(which: DataFrame) -> DataFrame:
        return named.join(which, named[id_col].eqNullSafe(which["__id"]) & (named["__near_node"] == which["__node"]), "left_semi")

    once = those(kept.where("__n = 1"))
    again = kept.where("__n > 1")
    if again.head(1):
        once = once.unionByName(those(again).dropDuplicates([id_col, "__near_node"]))
    return once.select(*docs.columns)
