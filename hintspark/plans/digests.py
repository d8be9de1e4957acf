"""Digests of groups' sorted values, without gathering a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes after which a piece of a group's sorted frames ends.
PIECE = 4096


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a range's frames: group, the first frame's place, the frames end to end."""
    group, first, held, size, kinds = None, None, [], 0, None
    for part in parts:
        kinds, out = part.schema, []
        for g, place, frame in zip(*(c.to_pylist() for c in part.columns)):
            if held and (g != group or size >= PIECE):
                out.append((group, first, b"".join(held)))
                held, size = [], 0
            if not held:
                group, first = g, place
            held.append(frame)
            size += len(frame)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((group, first, b"".join(held)), kinds)], schema=kinds)


def _hash(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group, whose pieces come in order; a piece is held no longer than it takes."""
    whole, group, kind = None, None, None

    def batch(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["group", "digest"])

    for part in parts:
        kind, done = part.schema.field(0).type, []
        for g, piece in zip(*(c.to_pylist() for c in part.columns)):
            if whole is None or g != group:
                if whole is not None:
                    done.append((group, whole.hexdigest()))
                whole, group = hashlib.sha256(), g
            whole.update(piece)
        if done:
            yield batch(done)
    if whole is not None:
        yield batch([(group, whole.hexdigest())])


def with_sorted_digest(groups: DataFrame, rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """groups, one row for each by (an id or a string), with name: SHA-256 of the group's values in rows.

    Values are strings, sorted by their bytes, each framed as `byte length:value` and a line feed;
    repeats count, nulls don't, and a group without values has null. This is framed_list_digest for
    groups of any size: rows are sorted in ranges, so a large group is spread over tasks, and only
    its packed frames pass through one task, in order and a piece at a time, since SHA-256 can't be
    merged.
    """
    frame = F.concat(F.octet_length("value").cast("string"), F.lit(":"), F.col("value"), F.lit("\n")).cast("binary")
    valued = rows.select(F.col(by).alias("group"), value.alias("value")).where("value IS NOT NULL")
    dealt = valued.repartitionByRange("group", "value").sortWithinPartitions("group", "value")
    placed = dealt.select("group", F.monotonically_increasing_id().alias("place"), frame.alias("frames"))
    kind = groups.schema[by].dataType.simpleString()
    pieces = placed.mapInArrow(_pack, f"group {kind}, place long, frames binary")
    digests = pieces.repartition("group").sortWithinPartitions("group", "place").select("group", "frames").mapInArrow(_hash, f"group {kind}, digest string")
    found = digests.select(F.col("group").alias("__group"), F.col("digest").alias(name))
    return groups.join(found, F.col(by).eqNullSafe(F.col("__group")), "left").drop("__group")
