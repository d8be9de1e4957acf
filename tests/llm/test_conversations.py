import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("hintspark.llm")
from hintspark.llm import conversations as C  # noqa: E402

FIELDS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode("utf-8", "surrogatepass")).hexdigest()))


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        inked = text.strip(SPACE)
        out.append("blank" if not inked else "duplicate" if (role, text) in seen else "truncated" if inked[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def least_edits(turns, found):
    """Cost, audit and repaired turns by a search over whole audits, cheapest and then least first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(turns) and state in ("", "a"):
            return cost, audit, lines
        if (at, state) in done:
            continue
        done.add((at, state))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for letter in allowed.replace("s", ""):
            name = {"u": "user", "a": "assistant"}[letter]
            heapq.heappush(heap, (cost + 3, audit + "I", at, letter, (*lines, f"{name}:")))
            if at < len(turns) and found[at] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 3 + 3 * (found[at] == "truncated"), audit + "R", at + 1, letter, (*lines, f"{name}:{turns[at][3]}")))
        if at < len(turns):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, lines))
            role = turns[at][2]
            if role[:1] and role[:1] in allowed and found[at] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 3 * (found[at] == "truncated"), audit + "K", at + 1, role[:1], (*lines, f"{role}:{turns[at][3]}")))


def plain_repair(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = plain_damage([r for r in rows if r[0] == conv])
        found = faults(turns)
        cost, audit, lines = least_edits(turns, found)
        numbers = [t[1] for t in turns if t[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [t[2][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def some_rows(seed, conversations, most):
    rng, out = random.Random(seed), []
    for conv in range(conversations):
        for _ in range(rng.randint(1, most)):
            out.append((conv if conv else None, rng.choice([None, *range(most)]), rng.choice(["user", "assistant", "system", "User", "", "s", None, "tool"]), rng.choice(["Yes.", "No", " ", "", None, "What?", "fine \n", "So! "])))
    return out


def test_repair_equals_a_search_over_audits():
    rng = random.Random(3)
    for _ in range(400):
        kinds = [(rng.choice("suao"), rng.choice("bdt..")) for _ in range(rng.randint(0, 9))]
        turns = [(0, 0, {"s": "system", "u": "user", "a": "assistant", "o": "tool"}[i], "x") for i, _ in kinds]
        found = [{"b": "blank", "d": "duplicate", "t": "truncated", ".": ""}[f] for _, f in kinds]
        text = "".join(i + f for i, f in kinds)
        end = C.closing_state(*C.forward(text, 0))
        assert C.repair(text, 0, end) + C.CLOSING[end] == least_edits(turns, found)[1]


@pytest.mark.parametrize("block_turns", [2, 3, 512])
def test_conversations_equal_a_plain_repair(spark, block_turns):
    rows = some_rows(5, 12, 25)
    assert rows_of(C.repair_conversations(spark.createDataFrame(rows, FIELDS), block_turns)) == sorted(plain_repair(rows), key=str)


def test_one_long_conversation_goes_through_blocks_of_several_levels(spark):
    rng = random.Random(8)
    rows = [(7, n, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "c!", f"n{n}?", f"m{n}"])) for n in range(700)]
    assert rows_of(C.repair_conversations(spark.createDataFrame(rows, FIELDS).repartition(5), 4)) == plain_repair(rows)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(None, None, None, None), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (2, 5, "assistant", "x" * 100_000), (3, 1, "system", "Only. ")] + [(4, 0, "user", "same.")] * 40
    frame = spark.createDataFrame(rows, FIELDS)
    clash = frame.withColumns({n: F.lit("x") for n in ("key", "block", "place", "digest", "audit", "cost", "salt", "fate")})
    assert rows_of(C.repair_conversations(clash, 4)) == sorted(plain_repair(rows), key=str)
    assert C.repair_conversations(frame.limit(0)).count() == 0
    gone = next(n for n in range(1000) if zlib.crc32(f"9:{n}".encode()) % 20 == 0)
    assert rows_of(C.repair_conversations(spark.createDataFrame([(9, gone, "user", "Hi.")], FIELDS))) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_equals_a_plain_repair(spark):
    from hintspark.llm.queries import op13_conversations

    given = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert rows_of(op13_conversations(spark, "/root/testdata/sf0.01")) == sorted(plain_repair([tuple(r) for r in given.collect()]), key=str)
