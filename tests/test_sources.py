import hashlib
import zipfile

import pytest
from pyspark.sql.utils import AnalysisException

from hintspark.sources import files as S


def test_content_pins(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_bytes(name.encode() * 3)
    pins = spark.createDataFrame([("a", 3, hashlib.sha256(b"aaa").hexdigest()), ("b", 3, "other"), ("d", 1, "x")], "name string, bytes long, digest string")
    assert {r["name"]: r["problem"] for r in S.content_pins(spark, str(tmp_path), pins).collect()} == {"b": "digest", "c": "not_pinned", "d": "absent"}


def test_source_tree(spark, tmp_path):
    for name, data in {"src/a.go": b"x", "src/.hidden.go": b"x", "vendor/b.go": b"x", "secret.py": b"x", "c.txt": b"x", "bad.py": b"\xff\xfe", "nul.py": b"a\0b", "big.md": b"x" * 400_000, "d.MD": "é".encode()}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    assert {r["path"]: r["text"] for r in S.read_source_tree(spark, str(tmp_path)).collect()} == {"src/a.go": "x", "d.MD": "é"}


def test_zip_members(spark, tmp_path):
    for name, members in {"one.zip": {"r/a": b"1", "r/b/c": b"22" * 10}, "two.zip": {"r/a": b"1", "s/a": b"1"}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m, data in members.items():
                z.writestr(m, data)
    rows = S.read_zip_members(spark, f"{tmp_path}/*.zip", 10).collect()
    assert sorted((r["archive"], r["member"], r["bytes"], r["content"] and bytes(r["content"]), r["problem"]) for r in rows) == [("one.zip", "r/a", 1, b"1", None), ("one.zip", "r/b/c", 20, None, None), ("two.zip", None, None, None, "many_roots")]


def test_write_once(spark, tmp_path):
    S.write_once(spark.range(3), f"{tmp_path}/x")
    with pytest.raises(AnalysisException):
        S.write_once(spark.range(3), f"{tmp_path}/x")


def test_json_array(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.json").write_text('[{"code": "x", "doc": "q", "label": 1}, {"code": " ", "doc": "q", "label": 0}, {"code": "x", "doc": "q", "label": 7}, {"code": "x", "doc": "q"}]')
    schema = T.StructType().add("code", "string").add("doc", "string").add("label", "integer")
    got = S.read_json_array(spark, str(tmp_path / "a.json"), schema, ["code", "doc"], "label").collect()
    assert [r["state"] for r in got] == ["ok", "blank_text", "bad_label", "ok"]
