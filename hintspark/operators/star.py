"""A star of sources, families and comments, checked as a whole.

sources: id, split, dev_style, source, review. families: id, source_id, frame, frame_schema.
comments: id, family_id, source_id, source, frame, locale, text. source, review, frame and frame_schema are pins,
struct(path, sha256, bytes): a file that must be known by the same bytes wherever it is named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Digest of no bytes, fixed by SHA-256.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def identifier_ok(value: Column) -> Column:
    return F.coalesce(value.cast("string").rlike(r"^[A-Za-z0-9_-]{1,128}\z"), F.lit(False))


def relative_path_ok(path: Column) -> Column:
    """A clean relative path: no empty, . or .. part, no backslash, colon or NUL, 4096 bytes at most."""
    plain = path.rlike(r"^[^\\:\x00/]+(?:/[^\\:\x00/]+)*\z") & ~path.rlike(r"(?:^|/)\.\.?(?:/|\z)")
    return F.coalesce(plain & (F.octet_length(path) <= 4096), F.lit(False))


def pin_ok(pin: Column) -> Column:
    """A clean path, a lower-case SHA-256, and no bytes exactly if the digest is that of none."""
    good = pin["sha256"].rlike(r"^[0-9a-f]{64}\z") & (pin["bytes"] >= 0) & ((pin["bytes"] == 0) == (pin["sha256"] == EMPTY_SHA256))
    return relative_path_ok(pin["path"]) & F.coalesce(good, F.lit(False))


def family_graph_check(sources: DataFrame, families: DataFrame, comments: DataFrame, frame_schema: Column, families_each: int = 3, locales: tuple[str, ...] = ("ko", "en"), splits: tuple[str, ...] = ("train", "dev", "test"), styles: tuple[str, ...] = (), most_bytes: int = 4096) -> DataFrame:
    """(code, id) of every violation: each source has so many families, each family one comment of every locale.

    frame_schema is the pin that all families must carry. A row can break several rules. Counts are by id, so a
    family whose source is unknown counts for none. Only rules, not rows, are held in one place.
    """
    s, f, c = sources, families, comments

    def rows(frame: DataFrame, code: str, bad: Column, id_: str = "id") -> DataFrame:
        return frame.where(bad).select(F.lit(code).alias("code"), F.col(id_).cast("string").alias("id"))

    def ids(frame: DataFrame, code: str) -> DataFrame:
        repeated = frame.groupBy("id").count().where("count > 1")
        return rows(frame, code, ~identifier_ok(F.col("id"))).unionByName(rows(repeated, code, F.lit(True))).distinct()

    dev = F.coalesce(F.col("split") == "dev", F.lit(False))
    style = F.coalesce(F.col("dev_style"), F.lit(""))
    own = s.groupBy("id").agg(F.first("source").alias("__source"))
    held = f.groupBy("id").agg(F.first("source_id").alias("__source_id"), F.first("frame").alias("__frame"))
    placed = f.join(own.select(F.col("id").alias("source_id"), F.lit(True).alias("__known")), "source_id", "left")
    bound = c.join(held.withColumnRenamed("id", "family_id"), "family_id", "left").join(own.withColumnRenamed("id", "__source_id"), "__source_id", "left")
    have = f.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    pairs = c.groupBy("family_id", "locale").agg(F.count("*").alias("n"))
    whole = pairs.where(F.col("locale").isin(*locales)).groupBy(F.col("family_id").alias("id")).agg(F.count("*").alias("n"))
    text = F.col("text")
    blank = text.isNull() | ~text.rlike(r"[^\p{IsWhite_Space}]") | (F.octet_length(text) > most_bytes) | F.contains(text, F.lit("\0")) | ~F.is_valid_utf8(text)
    same = lambda a, b: a.eqNullSafe(b)
    pins = reduce(DataFrame.unionByName, [frame.select(F.col(p).alias("pin")) for frame, p in ((s, "source"), (s, "review"), (f, "frame"), (f, "frame_schema"), (c, "source"), (c, "frame"))])
    aliases = pins.select("pin.*").distinct().groupBy(F.col("path").alias("id")).count().where("count > 1")
    found = [
        ids(s, "source_id"), rows(s, "source_pin", ~(pin_ok(F.col("source")) & pin_ok(F.col("review")))), rows(s, "source_split", ~F.coalesce(F.col("split").isin(*splits), F.lit(False))),
        rows(s, "dev_style", F.when(dev, ~style.isin(*styles) if styles else F.lit(False)).otherwise(style != "")),
        ids(f, "family_id"), rows(placed, "family_source", F.col("__known").isNull()), rows(f, "family_pin", ~pin_ok(F.col("frame")) | ~same(F.col("frame_schema"), frame_schema)),
        rows(s.select("id").distinct().join(have, "id", "left"), "source_family_count", F.coalesce("n", F.lit(0)) != families_each),
        ids(c, "comment_id"), rows(bound, "comment_family", F.col("__frame").isNull()),
        rows(bound, "comment_binding", F.col("__frame").isNotNull() & ~(same(F.col("source_id"), F.col("__source_id")) & same(F.col("source"), F.col("__source")) & same(F.col("frame"), F.col("__frame")))),
        rows(c, "comment_locale", ~F.coalesce(F.col("locale").isin(*locales), F.lit(False))), rows(pairs, "comment_locale_repeated", F.col("n") > 1, "family_id"), rows(c, "comment_text", blank),
        rows(f.select("id").distinct().join(whole, "id", "left"), "family_comment_pair", F.coalesce("n", F.lit(0)) != len(locales)), rows(aliases, "pin_alias", F.lit(True)),
    ]
    return reduce(DataFrame.unionByName, found)


def family_graph_counts(sources: DataFrame, families: DataFrame, comments: DataFrame) -> DataFrame:
    """(split, dev_style, sources, families, comments): how many hang on the sources of each split and style."""
    own = sources.select(F.col("id").alias("source_id"), "split", F.coalesce("dev_style", F.lit("")).alias("dev_style")).dropDuplicates(["source_id"])
    held = families.select(F.col("id").alias("family_id"), "source_id").dropDuplicates(["family_id"])
    said = comments.select("family_id").join(held, "family_id")
    part = lambda frame, n: frame.join(own, "source_id").groupBy("split", "dev_style").agg(F.count("*").alias(n))
    kinds = [part(own.select("source_id"), "sources"), part(held, "families"), part(said, "comments")]
    return reduce(lambda a, b: a.join(b, ["split", "dev_style"], "left"), kinds).fillna(0, ["families", "comments"])
