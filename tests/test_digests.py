import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from hintspark.plans import digests
from hintspark.queries import registered

SF = "/root/testdata/sf0.001"


def listed(values):
    frames = (f"{len(v.encode())}:{v}\n" for v in sorted(values, key=str.encode))
    return hashlib.sha256("".join(frames).encode()).hexdigest()


def reports(spark, name):
    return [r.asDict() for r in registered()[name][0](spark, SF).collect()]


def members(spark):
    """The ids of each component, as strings."""
    found = {}
    for r in registered()["g1_components"][0](spark, SF).collect():
        found.setdefault(r["component"], []).append(str(r["doc_id"]))
    return found


def test_sorted_digests_of_groups_over_many_ranges(spark):
    rng = random.Random(3)
    values = [None, "", "9", "10", "é", "z\n1:z", "\U0001f600", "～"] + [str(n) for n in range(3000)]
    rows = [(g, v) for g in ("hot", "hot", None) for v in values] + [(f"g{n}", rng.choice(values)) for n in range(200)] + [("none", None), ("", "x")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v string").repartition(5)
    got = {r["g"]: r["d"] for r in digests.with_sorted_digest(frame.select("g").distinct(), frame, "g", F.col("v"), "d").collect()}
    held = {}
    for g, v in rows:
        held.setdefault(g, []).extend([] if v is None else [v])
    assert got == {g: listed(v) if v else None for g, v in held.items()}
    assert duckdb.connect().execute("select sha256(string_agg(strlen(v) || ':' || v || chr(10), '' order by v)) from (values ('9'), ('10'), (null), ('é')) t(v)").fetchall()[0][0] == listed(["9", "10", "é"])
    nothing = frame.limit(0)
    assert digests.with_sorted_digest(nothing.select("g"), nothing, "g", F.col("v"), "d").count() == 0


def test_a_component_is_signed_by_its_sorted_members(spark):
    want = members(spark)
    got = reports(spark, "g2_component_report")
    assert {r["component"]: r["signature"] for r in got} == {c: listed(ids) for c, ids in want.items()}
    assert all(r["size"] == len(want[r["component"]]) for r in got)


def test_components_are_drawn_in_order_of_their_sorted_members_digests(spark):
    signed = sorted((listed(ids), c) for c, ids in members(spark).items())
    got = [(r["signature"], r["component"]) for r in reports(spark, "g3_select_components")]
    assert got == signed[:25]


def test_membership_digest_is_of_the_sorted_members(spark):
    held = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id").collect():
        held.setdefault(r["source"], []).append(str(r["doc_id"]))
    assert {r["source"]: (r["digest"], r["members"]) for r in reports(spark, "g11_membership_digest")} == {s: (listed(ids), len(ids)) for s, ids in held.items()}
