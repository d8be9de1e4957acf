"""Conversation repair: cheapest edits to well-formed turns, by divide and conquer in linear space.

A well-formed conversation is empty or one optional system turn and then pairs of user and assistant
turns. Edits are K(eep) 0, R(erole) 3, D(elete) 4 and I(nsert) 3; blank and repeated turns must go, a
truncated one that stays adds 3. Read from its first turn on, a repair stands in one of four states:
nothing yet, after system, after user, after assistant. A repair between two states is split where the
forward costs to a turn in the middle and the backward costs from there meet, in the state of the least
total; halves are split again, so only vectors of four costs are held, never a table of all turns.

Several states may be as cheap. Each of them carries the place of its least audit among the four, so that
the crossing taken is the one whose audit comes first. (Audits of one stretch that end in different states
part somewhere before the end of either, so the first half decides.)

Turns stand in ranges sorted by conversation and turn. A range is dealt in blocks of consecutive turns; a
conversation inside a block is repaired at once. The others are summed up block by block as 4 x 4 costs
between states, which are merged up a tree of 64 children a node; crossings go back down the tree, and each
block then repairs its own stretch between its two states. So no task holds the turns of a long conversation;
only its audit and its hash, which are one value each, pass through one task in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hintspark.plans.shared import SharedTables, arrow_rows

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60
#: Next state of each state by what is put out; -1: not allowed. States: nothing, s, u, a.
NEXT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
ROLES = {"u": "user", "a": "assistant"}
#: The turn that may follow each state, besides a system turn at the start.
FOLLOWS = ("u", "u", "a", "u")
#: Inserts that close a conversation in each state.
CLOSING = ("", "II", "I", "")
BLANK, REPEATED, CUT, SOUND = "b", "d", "t", "."


@lru_cache(maxsize=None)
def moves(kind: str) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """(next state, cost, edits) from each state over one turn, the cheapest and then least edits for each next one.

    kind: the role's initial if it is s, u or a, else another letter, and the fault.
    """
    initial, fault = kind
    out = []
    for start in range(4):
        found: dict[int, tuple[int, str]] = {}
        state, cost, edits = start, 0, ""
        for _ in range(3):  # more inserts than two lead round in a circle
            choices = [(state, DELETE, "D")]
            if fault not in (BLANK, REPEATED):
                late = TRUNCATED if fault == CUT else 0
                kept = NEXT[initial][state] if initial in NEXT else -1
                choices += [(kept, KEEP + late, "K"), (NEXT[FOLLOWS[state]][state], REROLE + late, "R")]
            for then, price, edit in choices:
                if then >= 0:
                    found[then] = min(found.get(then, (FAR, "")), (cost + price, edits + edit))
            state, cost, edits = NEXT[FOLLOWS[state]][state], cost + INSERT, edits + "I"
        out.append(tuple((then, *how) for then, how in sorted(found.items())))
    return tuple(out)


def forward(kinds: str, start: int) -> tuple[list[int], list[int]]:
    """Costs from a state to each of the four after the turns, and the places of their least audits."""
    cost, place = [FAR] * 4, [0] * 4
    cost[start] = 0
    for kind in zip(kinds[::2], kinds[1::2]):
        best: list[tuple | None] = [None] * 4
        table = moves("".join(kind))
        for state in range(4):
            if cost[state] < FAR:
                for then, price, edits in table[state]:
                    here = (cost[state] + price, place[state], edits)
                    if best[then] is None or here < best[then]:
                        best[then] = here
        order = sorted((b[1], b[2], then) for then, b in enumerate(best) if b)
        cost, place = [b[0] if b else FAR for b in best], [0] * 4
        for at, (_, _, then) in enumerate(order):
            place[then] = at
    return cost, place


def backward(kinds: str, end: int) -> list[int]:
    """Costs from each of the four states before the turns to a state after them."""
    cost = [FAR] * 4
    cost[end] = 0
    for at in range(len(kinds) - 2, -1, -2):
        cost = [min((price + cost[then] for then, price, _ in ways), default=FAR) for ways in moves(kinds[at : at + 2])]
    return cost


def crossing(costs: list[int], places: list[int], rest: list[int]) -> int:
    """The state of the least total; among equal ones, that of the first audit."""
    return min((costs[q] + rest[q], places[q], q) for q in range(4))[2]


def repair(kinds: str, start: int, end: int) -> str:
    """Cheapest and then least edits between two states. kinds: two letters a turn."""
    turns = len(kinds) // 2
    if turns == 0:
        return ""
    if turns == 1:
        return next(edits for then, _, edits in moves(kinds)[start] if then == end)
    middle = turns // 2 * 2
    first, second = kinds[:middle], kinds[middle:]
    state = crossing(*forward(first, start), backward(second, end))
    return repair(first, start, state) + repair(second, state, end)


def closing_state(costs: list[int], places: list[int]) -> int:
    return crossing(costs, places, [INSERT * len(c) for c in CLOSING])


def applied(edits: str, roles: list[str], texts: list[str], state: int = 0) -> Iterator[str]:
    """Turns of the repaired conversation as role:text."""
    at = 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        letter = FOLLOWS[state]
        if edit == "K":
            letter = roles[at][:1]
            yield f"{roles[at]}:{texts[at]}"
        else:
            yield f"{ROLES[letter]}:{texts[at] if edit == 'R' else ''}"
        at += edit != "I"
        state = NEXT[letter][state]


def joined_hash(lines: Iterator[str]) -> str:
    whole, some = hashlib.sha256(), False
    for line in lines:
        if some:
            whole.update(b"\n")
        whole.update(line.encode("utf-8", "surrogatepass"))
        some = True
    return whole.hexdigest()


# ---- damage


def damaged(rows: DataFrame) -> DataFrame:
    """rows after damage, as conv_id, turn, role, text; nulls are one space, in the damage's draw too.

    By crc32(conv_id:turn) % 20, 0 drops a turn, 1 empties its text, 2 removes full stops, exclamation and
    question marks, 3 repeats it and 4 gives it the role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def undamaged(rows: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


# ---- what is known of a stretch of turns

#: first and last are roles' initials; low and high the least and largest turn; distinct counts turns.
COUNTS = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, distinct long"
NODE = f"{COUNTS}, costs array<long>, places array<long>"
LEGAL = ("su", "ua", "au")


def merge(nodes: list[dict]) -> dict:
    """What is known of consecutive stretches as one."""
    out = dict(nodes[0])
    for node in nodes[1:]:
        for name in ("blank", "duplicate", "truncated"):
            out[name] += node[name]
        out["illegal"] += node["illegal"] + (out["last"] + node["first"] not in LEGAL)
        out["last"] = node["last"]
        if node["low"] is not None:
            out["distinct"] += node["distinct"] - (out["high"] == node["low"])
            out["low"] = node["low"] if out["low"] is None else out["low"]
            out["high"] = node["high"]
        out["costs"], out["places"] = merged(out, node)
    return out


def merged(one: dict, two: dict) -> tuple[list[int], list[int]]:
    """Costs between states over two stretches, and the places of their least audits."""
    costs, places = [FAR] * 16, [0] * 16
    for start in range(4):
        order = []
        for end in range(4):
            best = min((one["costs"][4 * start + q] + two["costs"][4 * q + end], one["places"][4 * start + q], two["places"][4 * q + end]) for q in range(4))
            if best[0] < FAR:
                costs[4 * start + end] = best[0]
                order.append((best[1:], end))
        for at, (_, end) in enumerate(sorted(order)):
            places[4 * start + end] = at
    return costs, places


def descend(nodes: list[dict], start: int, end: int) -> list[tuple[int, int]]:
    """The states at the ends of each of consecutive stretches, halves meeting in their middle."""
    if len(nodes) == 1:
        return [(start, end)]
    middle = len(nodes) // 2
    one, two = merge(nodes[:middle]), merge(nodes[middle:])
    state = crossing(one["costs"][4 * start : 4 * start + 4], one["places"][4 * start : 4 * start + 4], [two["costs"][4 * q + end] for q in range(4)])
    return descend(nodes[:middle], start, state) + descend(nodes[middle:], state, end)


def stretch(turns: list[tuple], edge: bool) -> dict:
    """What is known of consecutive turns (turn, role, text, first find) and their repair if they are all;
    at a block's edge also their costs between states."""
    kinds, initials = [], []
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text, new in turns:
        inked = text.rstrip(" \t\n\x0b\x0c\r")
        fault = BLANK if not inked else REPEATED if not new else SOUND if inked[-1] in ".!?" else CUT
        if fault != SOUND:
            counts[{BLANK: "blank", REPEATED: "duplicate", CUT: "truncated"}[fault]] += 1
        initials.append(role[:1])
        kinds.append((role[:1] if role[:1] in NEXT else "o") + fault)
    kinds = "".join(kinds)
    known = [t for t, *_ in turns if t is not None]
    costs, places = forward(kinds, 0)
    end = closing_state(costs, places)
    edits = repair(kinds, 0, end) + CLOSING[end]
    ways = [forward(kinds, q) for q in range(4)] if edge else []
    return counts | {
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
        "low": known[0] if known else None, "high": known[-1] if known else None, "distinct": len(set(known)), "kinds": kinds,
        "costs": [c for some, _ in ways for c in some], "places": [p for _, some in ways for p in some],
        "cost": costs[end] + INSERT * len(CLOSING[end]), "audit": edits, "repaired_sha256": joined_hash(applied(edits, [t[1] for t in turns], [t[2] for t in turns])),
    }


# ---- jobs

STRETCH = f"key string, block long, start long, edge boolean, {NODE}, kinds string, cost long, audit string, repaired_sha256 string"
ENDS = "key string, at long, enters long, leaves long"
SHIFT, FAN = 33, 6
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in fields.split(", ")])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of each block. Turns come in order, each first find after a mark of its place."""
    schema = _schema(STRETCH)
    found: list[dict] = []
    held: list[tuple] = []
    own, opens, marked = (None, None), True, None

    def close(edge: bool) -> None:
        if held:
            found.append({"block": own[0], "key": own[1], "start": held[0][0], "edge": edge} | stretch([h[1:] for h in held], edge))
            held.clear()

    for batch in batches:
        for block, place, is_turn, key, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not is_turn:
                marked = place
                continue
            if own != (block, key):
                close(opens or own[0] != block)
                own, opens = (block, key), own[0] != block
            held.append((place, turn, role, text, place == marked))
        if found:
            yield pa.RecordBatch.from_pylist(found, schema)
            found.clear()
    close(True)
    if found:
        yield pa.RecordBatch.from_pylist(found, schema)


def _merge_children(children: pa.Table) -> pa.Table:
    rows = children.sort_by("at").to_pylist()
    out = merge(rows) | {"at": rows[0]["above"]}
    return pa.Table.from_pylist([out], _schema(f"key string, at long, {NODE}"))


def _descend_children(children: pa.Table) -> pa.Table:
    rows = children.sort_by("at").to_pylist()
    ends = descend(rows, rows[0]["enters"], rows[0]["leaves"])
    return pa.Table.from_pylist([{"key": r["key"], "at": r["at"], "enters": a, "leaves": b} for r, (a, b) in zip(rows, ends)], _schema(ENDS))


def _end_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            end = closing_state(r["costs"][:4], r["places"][:4])
            r |= {"enters": 0, "leaves": end, "cost": r["costs"][end] + INSERT * len(CLOSING[end]), "closing": CLOSING[end]}
        yield pa.RecordBatch.from_pylist(rows, _schema(f"{ENDS}, {COUNTS}, cost long, closing string"))


def _repair_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r | {"edits": repair(r["kinds"], r["enters"], r["leaves"])} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, _schema("key string, at long, start long, edits string"))


def _hash_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each conversation, whose turns come in order; a turn's text is held no longer than it takes."""
    whole, own, state, some, done = hashlib.sha256(), None, 0, False, []

    def put(edits: str, role: str | None, text: str | None) -> None:
        nonlocal state, some
        for line in applied(edits, [role], [text], state):
            if some:
                whole.update(b"\n")
            whole.update(line.encode("utf-8", "surrogatepass"))
            some = True
        for edit in edits:
            if edit != "D":
                state = NEXT[role[:1] if edit == "K" else FOLLOWS[state]][state]

    for batch in batches:
        for key, edits, role, text, closing in zip(*(c.to_pylist() for c in batch.columns)):
            if own is not None and own[0] != key:
                put(own[1], None, None)
                done.append({"key": own[0], "repaired_sha256": whole.hexdigest()})
                whole, state, some = hashlib.sha256(), 0, False
            own = (key, closing)
            put(edits, role, text)
        if done:
            yield pa.RecordBatch.from_pylist(done, _schema("key string, repaired_sha256 string"))
            done = []
    if own is not None:
        put(own[1], None, None)
        yield pa.RecordBatch.from_pylist([*done, {"key": own[0], "repaired_sha256": whole.hexdigest()}], _schema("key string, repaired_sha256 string"))


def _repair_long(pieces: DataFrame, placed: DataFrame, tables: SharedTables) -> DataFrame:
    """Repairs of the conversations that lie in several blocks; pieces has a row for each block of theirs."""
    node = ["key", "at", *(f.split()[0] for f in NODE.split(", "))]
    levels = [pieces.withColumnRenamed("block", "at")]
    while levels[-1].groupBy("key").count().where("count > 1").head(1):
        below = levels[-1].select(*node, F.shiftright("at", FAN).alias("above"))
        levels.append(tables.keep(below.groupBy("key", "above").applyInArrow(_merge_children, f"key string, at long, {NODE}")))
    roots = tables.keep(levels[-1].select(*node).mapInArrow(_end_roots, f"{ENDS}, {COUNTS}, cost long, closing string"))
    ends = roots.select("key", "at", "enters", "leaves")
    for level in reversed(levels[:-1]):
        below = level.select(*node, F.shiftright("at", FAN).alias("above")).join(ends.withColumnRenamed("at", "above"), ["key", "above"])
        ends = tables.keep(below.groupBy("key", "above").applyInArrow(_descend_children, ENDS))
    cut = tables.keep(levels[0].select("key", "at", "start", "kinds").join(ends, ["key", "at"]).mapInArrow(_repair_stretches, "key string, at long, start long, edits string"))
    turn = cut.select(F.col("start"), F.posexplode(F.regexp_extract_all("edits", F.lit("I*[DKR]"), F.lit(0))).alias("n", "edits")).select((F.col("start") + F.col("n")).alias("place"), "edits")
    texts = turn.join(placed.select("place", "key", "role", "text"), "place").join(roots.select("key", "closing"), "key")
    hashes = texts.repartition("key").sortWithinPartitions("key", "place").select("key", "edits", "role", "text", "closing").mapInArrow(_hash_long, "key string, repaired_sha256 string")
    audits = cut.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "edits"))), lambda x: x["edits"]), "").alias("edits"))
    return roots.join(audits, "key").join(hashes, "key").withColumn("audit", F.concat("edits", "closing"))


def repair_conversations(rows: DataFrame, block_turns: int = 512, damage: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    rows: conv_id, turn, role, text. Unless damage is False, turns are first damaged as damaged() says.
    Turns of one number stand by role and then by the text's SHA-256; those equal in all stand in any order,
    which shows nowhere. A null conv_id is a conversation of its own, null turns come first and don't count
    for gaps, null roles and texts are one space. A conversation without turns has zeros, an empty audit and
    the hash of an empty string. An empty table gives no rows; extra columns are ignored.
    """
    tables = SharedTables(rows.sparkSession, "conversations")
    named = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    hurt = damaged(rows) if damage else undamaged(rows)
    keyed = hurt.select(named(F.col("conv_id")).alias("key"), "turn", "role", "text", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("salt")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("place", F.monotonically_increasing_id())
    ranged = tables.keep(ranged)
    range_of, inside = F.shiftright("place", SHIFT), F.col("place").bitwiseAND(F.lit((1 << SHIFT) - 1))
    starts, total = [], 0
    for r in ranged.groupBy(range_of.alias("part")).agg(F.max(inside).alias("last")).orderBy("part").collect():  # a row for each range
        starts.append((r["part"], total))
        total += r["last"] // block_turns + 1
    parts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, first_block long"))
    placed = ranged.join(parts, range_of == F.col("part")).withColumn("block", F.col("first_block") + F.floor(inside / block_turns)).drop("part", "first_block")
    marks = placed.groupBy("key", "role", "digest").agg(F.min(F.struct("place", "block")).alias("f")).select("f.block", "f.place", F.lit(0).alias("is_turn"))
    turns = placed.select("block", "place", F.lit(1).alias("is_turn"), "key", "turn", "role", "text").unionByName(marks, allowMissingColumns=True)
    with arrow_rows(rows.sparkSession, 1000):
        found = tables.keep(turns.repartition("block").sortWithinPartitions("block", "place", "is_turn").mapInArrow(_stretches, STRETCH))
        spread = tables.keep(found.where("edge").groupBy("key").count().where("count > 1").select("key"))
        names = ["key", *(f.split()[0] for f in COUNTS.split(", ")), "cost", "audit", "repaired_sha256"]
        done = found.join(spread, "key", "left_anti").select(*names)
        if spread.head(1):
            pieces = found.join(spread, "key", "left_semi")
            done = done.unionByName(tables.keep(_repair_long(pieces, placed, tables).select(*names)))
    everyone = rows.select("conv_id").distinct().withColumn("key", named(F.col("conv_id")))
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0).cast("long")).alias("gaps")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return everyone.join(done, "key", "left").select("conv_id", gaps, *map(number, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
