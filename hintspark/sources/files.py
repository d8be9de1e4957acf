"""Strict readers and writers. Schemas are given, never inferred; what doesn't fit becomes a reject row."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hintspark.functions import text as X


def read_strict_jsonl(spark: SparkSession, path: str, schema: T.StructType, most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a file of one JSON object a line.

    Rejects (line, reason): oversize, not_an_object, duplicate_field, unknown_field, missing_field,
    wrong_type. Blank lines don't count. Both frames read the file, so each is scanned when used.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")
    names = [f.name for f in schema.fields]
    keys = F.json_object_keys("line")
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    wrong = F.exists(F.array(*(F.col(f"row.{n}").isNull() & F.get_json_object("line", f"$.{n}").isNotNull() for n in names)), lambda x: x)
    judged = lines.withColumn("keys", keys).withColumn("row", parsed)
    reason = (
        F.when(F.octet_length("line") > most_bytes, "oversize").when(F.col("keys").isNull(), "not_an_object").when(F.size("keys") != F.size(F.array_distinct("keys")), "duplicate_field")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, names)))) > 0, "unknown_field").when(F.size(F.array_except(F.array(*map(F.lit, names)), "keys")) > 0, "missing_field").when(wrong, "wrong_type")
    )
    judged = judged.withColumn("reason", reason)
    return judged.where("reason IS NULL").select("row.*"), judged.where("reason IS NOT NULL").select("line", "reason")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, texts: list[str], label: str) -> DataFrame:
    """Rows of a file that is one JSON array, with a state: ok, blank_text or bad_label (neither 0, 1 nor null)."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    blank = F.exists(F.array(*texts), lambda t: t.isNull() | (F.trim(t) == ""))
    return rows.withColumn("state", F.when(blank, "blank_text").when(~F.coalesce(F.col(label).isin(0, 1), F.lit(True)), "bad_label").otherwise("ok"))


def content_pins(spark: SparkSession, path: str, pins: DataFrame) -> DataFrame:
    """name, problem for pinned files (name, bytes, digest) that are absent or differ, and for files without a pin."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("have"), F.sha2("content", 256).alias("is"))
    both = pins.join(files, "name", "full")
    problem = F.when(F.col("have").isNull(), "absent").when(F.col("digest").isNull(), "not_pinned").when(F.col("have") != F.col("bytes"), "size").when(F.col("is") != F.col("digest"), "digest")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def project_table(rows: DataFrame, columns: dict[str, str], key: str, wanted: DataFrame, text: str, most_bytes: int) -> DataFrame:
    """Wanted rows with renamed columns; oversize texts become null, their size and a flag stay.

    state: ok, missing (a wanted key without a row) or repeated.
    """
    have = rows.select(*(F.col(a).alias(b) for a, b in columns.items()))
    counts = have.groupBy(key).agg(F.count("*").alias("__n"))
    joined = wanted.select(key).distinct().join(counts, key, "left").join(have, key, "left")
    size = F.octet_length(text)
    state = F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "repeated").otherwise("ok")
    return joined.withColumn("bytes", size).withColumn("oversize", F.coalesce(size > most_bytes, F.lit(False))).withColumn("state", state).withColumn(text, F.when(~F.col("oversize"), F.col(text))).drop("__n")


def read_source_tree(spark: SparkSession, path: str, most_bytes: int = 256 << 10) -> DataFrame:
    """path (below the root), text of readable source files: allowed names, bounded size, valid UTF-8 without NUL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.substring_index("path", path.rstrip("/").split("://")[-1] + "/", -1)
    named = files.where(F.col("length") <= most_bytes).select(below.alias("path"), "content").where(X.safe_path(F.col("path")))
    fine = named.where(F.is_valid_utf8(F.col("content").cast("string")))
    return fine.select("path", F.decode("content", "UTF-8").alias("text")).where(~F.contains("text", F.lit("\x00")))


TREE = "sha string, truncated boolean, tree array<struct<path:string,mode:string,type:string,sha:string>>"
#: Modes and the object types they stand for.
MODES = {"100644": "blob", "100755": "blob", "120000": "blob", "040000": "tree", "160000": "commit"}


def read_tree_catalogs(spark: SparkSession, path: str) -> DataFrame:
    """catalog, path, mode, type, sha and problem of every entry of tree catalogs (JSON lines, packed or not).

    Problems: truncated, bad_mode, repeated, no_parent (its folder isn't an entry).
    """
    trees = spark.read.schema(TREE).option("mode", "FAILFAST").json(path)
    rows = trees.select(F.col("sha").alias("catalog"), "truncated", F.explode("tree").alias("e")).select("catalog", "truncated", "e.*")
    counts = rows.groupBy("catalog", "path").agg(F.count("*").alias("__n"))
    folders = rows.where("type = 'tree'").select(F.col("catalog").alias("__c"), F.col("path").alias("__p")).distinct()
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    joined = rows.join(counts, ["catalog", "path"]).join(folders, (F.col("catalog") == F.col("__c")) & (parent == F.col("__p")), "left")
    kind = F.lit(None).cast("string")
    for mode, t in MODES.items():
        kind = F.when(F.col("mode") == mode, t).otherwise(kind)
    problem = F.when(F.col("truncated"), "truncated").when(~F.coalesce(kind == F.col("type"), F.lit(False)), "bad_mode").when(F.col("__n") > 1, "repeated").when((parent != "") & F.col("__p").isNull(), "no_parent")
    return joined.select("catalog", "path", "mode", "type", "sha", problem.alias("problem"))


def read_zip_members(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> DataFrame:
    """archive, member, bytes, content (null if oversize) and problem of archives' files.

    An archive with more than one root folder gives one row without a member and the problem many_roots.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, content in zip(part["archive"], part["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as packed:
                    entries = [e for e in packed.infolist() if not e.is_dir()]
                    if len({e.filename.split("/")[0] for e in entries}) > 1:
                        yield pd.DataFrame({"archive": [archive], "member": [None], "bytes": [None], "content": [None], "problem": ["many_roots"]})
                        continue
                    for e in entries:
                        data = packed.read(e) if e.file_size <= most_bytes else None
                        yield pd.DataFrame({"archive": [archive], "member": [e.filename], "bytes": [e.file_size], "content": [data], "problem": [None]})

    return files.mapInPandas(members, "archive string, member string, bytes long, content binary, problem string")


def write_once(rows: DataFrame, path: str, by: list[str] | None = None, form: str = "parquet") -> None:
    """Write where nothing is yet; an existing path is an error, never overwritten."""
    writer = rows.write.mode("errorifexists").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)

