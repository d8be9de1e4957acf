import hashlib

from pyspark.sql import Row, functions as F

from hintspark.operators.star import family_graph_check, family_graph_counts

PIN = "struct<path:string,sha256:string,bytes:long>"
SOURCES = f"id string, split string, dev_style string, source {PIN}, review {PIN}"
FAMILIES = f"id string, source_id string, frame {PIN}, frame_schema {PIN}"
COMMENTS = f"id string, family_id string, source_id string, source {PIN}, frame {PIN}, locale string, text string"


def pin(name, size=3):
    return Row(path=name, sha256=hashlib.sha256(name.encode() if size else b"").hexdigest(), bytes=size)


def star():
    sources = [["s1", "train", "", pin("s/1"), pin("r/1")], ["s2", "dev", "plain", pin("s/2"), pin("r/2")]]
    families = [[f"f{s}{k}", f"s{s}", pin(f"f/{s}{k}"), pin("schema")] for s in (1, 2) for k in range(3)]
    comments = [[f"c{f[0]}{lang}", f[0], f[1], pin(f"s/{f[1][1]}"), f[2], lang, "words"] for f in families for lang in ("ko", "en")]
    return sources, families, comments


def found(spark, sources, families, comments):
    frames = (spark.createDataFrame([tuple(r) for r in rows], kind) for rows, kind in ((sources, SOURCES), (families, FAMILIES), (comments, COMMENTS)))
    schema = pin("schema")
    schema = F.struct(F.lit(schema.path).alias("path"), F.lit(schema.sha256).alias("sha256"), F.lit(schema.bytes).cast("long").alias("bytes"))
    return sorted((r["code"], r["id"]) for r in family_graph_check(*frames, schema, styles=("plain",)).collect())


def test_a_whole_star_has_no_violation(spark):
    assert found(spark, *star()) == []
    kinds = [spark.createDataFrame([tuple(r) for r in rows], k) for rows, k in zip(star(), (SOURCES, FAMILIES, COMMENTS))]
    assert {tuple(r) for r in family_graph_counts(*kinds).collect()} == {("train", "", 1, 3, 6), ("dev", "plain", 1, 3, 6)}


def test_each_rule_finds_its_case(spark):
    def broken(part, row, field, value):
        rows = star()
        rows[part][row][field] = value
        return {code for code, _ in found(spark, *rows)}

    assert broken(0, 0, 0, "bad id") >= {"source_id", "family_source", "source_family_count"}
    assert broken(0, 0, 1, "other") == {"source_split"} and broken(0, 0, 2, "plain") == {"dev_style"} and broken(0, 1, 2, "odd") == {"dev_style"}
    for path in ("/abs", "a/../b", "a//b", "./a", "a\\b", "a:b", ""):
        assert "source_pin" in broken(0, 0, 4, pin(path)), path
    assert broken(0, 0, 4, Row(path="r/1", sha256="AB" * 32, bytes=3)) == {"source_pin"} and broken(0, 0, 4, pin("r/1", 0)) == set()
    assert broken(1, 0, 3, pin("schema", 9)) == {"family_pin", "pin_alias"}
    assert broken(1, 0, 1, "s2") >= {"source_family_count", "comment_binding"}
    assert broken(2, 0, 1, "gone") == {"comment_family", "family_comment_pair"}
    assert broken(2, 0, 3, pin("s/9")) == {"comment_binding"} and broken(2, 0, 4, pin("f/10", 8)) == {"comment_binding", "pin_alias"}
    assert broken(2, 0, 5, "fr") == {"comment_locale", "family_comment_pair"} and broken(2, 0, 5, "en") == {"comment_locale_repeated", "family_comment_pair"}
    assert all(broken(2, 0, 6, t) == {"comment_text"} for t in ("", " \t", "x" * 5000, "a\0b", None))
    assert broken(2, 0, 0, "cf10en") == {"comment_id"}
