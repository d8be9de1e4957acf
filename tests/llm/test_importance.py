import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("hintspark.llm")
from hintspark.llm import importance as I  # noqa: E402
from hintspark.plans.shared import SharedTables  # noqa: E402


def plain(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    own = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, words, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for at, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = at + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


ROWS = [(i, " ".join(f"Wörd{(i * j) % 31},x{j % 7}" for j in range(i % 45))) for i in range(200)]
ROWS += [(3, "same text here " * 10)] * 25 + [(None, "nothing named " * 12), (None, None), (500, ""), (501, "long " * 30_000), (502, "\x00\x0b é😀 A-Z")]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_draw_equals_a_plain_one(spark, longest, percent):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("words", "row", "buckets", "rank", "score", "id")})
    target = ["wörd3 x1 wörd5", "same text", None]
    got = I.resample(docs.repartition(4), spark.createDataFrame([(t,) for t in target], "text string"), longest, 997, 20, percent)
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS, target, longest, 997, 20, percent)


def test_empty_tables_and_targets(spark):
    docs = spark.createDataFrame(ROWS[:40], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert I.resample(docs.limit(0), none).count() == 0
    assert sorted(map(tuple, I.resample(docs, none).collect()), key=str) == plain(ROWS[:40], [])


@pytest.mark.parametrize("wanted", [0, 1, 37, 199, 200, 500])
def test_cutoff_and_ranks_are_exact_among_ties(spark, wanted):
    rows = [(-(i % 3), i % 2, i) for i in range(200)]
    tables = SharedTables(spark, "test")
    kept = tables.keep(spark.createDataFrame(rows, "a long, b long, c long"))
    condition, _ = I.cutoff(kept, ["a", "b", "c"], wanted)
    ranked = I.with_ranks(kept.where(condition), ["a", "b", "c"], tables).orderBy("rank").collect()
    assert [(r["a"], r["b"], r["c"], r["rank"]) for r in ranked] == [(*r, n + 1) for n, r in enumerate(sorted(rows)[:wanted])]
