"""Summaries of event traces, in batch and as a stream, and scoring of messages as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
LINE_SCHEMA = "type string, usage struct<" + ", ".join(f"{u}: bigint" for u in USAGE) + ">"
COUNTS = ("events", "threads", "started", "completed", "failed", "errors", "items", "unknown")


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with kind, usage and code: why a line isn't an event (null if it is one)."""
    parsed = F.from_json(line, LINE_SCHEMA, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(line)
    out = lines.withColumn("__p", parsed).withColumn("kind", F.col("__p.type")).withColumn("usage", F.col("__p.usage"))
    code = F.when(keys.isNull(), "not_an_object").when(F.size(keys) > 64, "too_many_keys").when(F.size(keys) != F.size(F.array_distinct(keys)), "duplicate_key").when(F.col("kind").isNull(), "no_type")
    return out.withColumn("code", code).drop("__p")


def _flags() -> dict:
    k = F.col("kind")
    known = ("thread.started", "turn.started", "turn.completed", "turn.failed", "error")
    return {
        "threads": k == "thread.started", "started": k == "turn.started", "completed": k == "turn.completed", "failed": k == "turn.failed",
        "errors": k == "error", "items": F.startswith(k, F.lit("item.")), "unknown": ~k.isin(*known) & ~F.startswith(k, F.lit("item.")),
    }


def trace_summary(events: DataFrame, trace: str, seq: str) -> DataFrame:
    """Per trace: counts by kind, whether its lifecycle is valid and complete, and its status.

    A turn needs a thread and no open turn; an end or an item needs an open turn; a thread must not
    follow one without a turn. Counts of what came before say all of this as long as it held.
    """
    flags = _flags()
    rows = events.select(trace, seq, "kind", *(F.coalesce(f, F.lit(False)).cast("int").alias(n) for n, f in flags.items()))
    before = W.partitionBy(trace).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    sums = {n: F.coalesce(F.sum(n).over(before), F.lit(0)) for n in ("threads", "started", "completed", "failed")}
    last_thread = F.coalesce(F.max(F.when(F.col("threads") == 1, F.col(seq))).over(before), F.lit(None))
    last_turn = F.max(F.when(F.col("started") == 1, F.col(seq))).over(before)
    seen = rows.select("*", *(s.alias(f"b_{n}") for n, s in sums.items()), last_thread.alias("last_thread"), last_turn.alias("last_turn"))
    active = F.col("b_started") > F.col("b_completed") + F.col("b_failed")
    idle_thread = F.col("last_thread").isNotNull() & (F.col("last_turn").isNull() | (F.col("last_turn") < F.col("last_thread")))
    broken = (
        ((F.col("threads") == 1) & (active | idle_thread)) | ((F.col("started") == 1) & (active | (F.col("b_threads") == 0))) | ((F.col("completed") + F.col("failed") + F.col("items") > 0) & ~active)
    )
    totals = seen.groupBy(trace).agg(
        F.count("*").alias("events"), *(F.sum(n).alias(n) for n in flags), F.bool_or(broken).alias("broken"),
        F.max(F.when(F.col("threads") == 1, F.col(seq))).alias("last_thread"), F.max(F.when(F.col("started") == 1, F.col(seq))).alias("last_turn"),
    )
    whole = (F.col("threads") > 0) & (F.col("last_turn") > F.col("last_thread")) & (F.col("started") == F.col("completed") + F.col("failed"))
    whole = F.coalesce(whole, F.lit(False)) & ~F.col("broken")
    return totals.select(trace, *COUNTS, F.col("broken"), whole.alias("complete"), status(F.col("broken"), F.col("unknown"), F.col("failed") + F.col("errors"), whole).alias("status"))


def status(broken, unknown, failures, whole):
    return F.when(broken, "invalid_lifecycle").when(unknown > 0, "unknown_controls").when(failures > 0, "observed_failure").when(whole, "completed_turns").otherwise("incomplete")


def usage_totals(events: DataFrame, summary: DataFrame, trace: str) -> DataFrame:
    """Per trace and usage field: observed total and turns, missing turns, and the total if every turn has it
    and the trace is complete without failures; unknown stays null, never 0."""
    ends = events.where("kind = 'turn.completed'").select(trace, F.explode(F.array(*(F.struct(F.lit(u).alias("field"), F.col(f"usage.{u}").alias("value")) for u in USAGE))).alias("u")).select(trace, "u.*")
    sums = ends.groupBy(trace, "field").agg(F.sum("value").alias("observed"), F.count("value").alias("turns"), F.count_if(F.col("value").isNull()).alias("missing"))
    joined = sums.join(summary.select(trace, "started", "status"), trace)
    total = F.when((F.col("status") == "completed_turns") & (F.col("turns") == F.col("started")), F.col("observed"))
    return joined.select(trace, "field", "observed", "turns", "missing", total.alias("total"))


#: What a stream keeps of a trace: counts, whether it is broken, an open turn, a thread without a turn, and the last sequence number.
STATE = ", ".join(f"{c} bigint" for c in COUNTS) + ", broken boolean, active boolean, idle boolean, last bigint"
SUMMARY = "trace string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", broken boolean, complete boolean, status string"


def _advance(state: list, kind: str | None, seq: int) -> None:
    """One event of a trace; the state is a list in the order of STATE."""
    counts, (broken, active, idle, last) = dict(zip(COUNTS, state)), state[len(COUNTS) :]
    kind = kind or ""
    counts["events"] += 1
    if kind == "thread.started":
        broken |= active or idle
        idle = True
        counts["threads"] += 1
    elif kind == "turn.started":
        broken |= active or not counts["threads"]
        active, idle = True, False
        counts["started"] += 1
    elif kind in ("turn.completed", "turn.failed"):
        broken |= not active
        active = False
        counts["completed" if kind == "turn.completed" else "failed"] += 1
    elif kind == "error":
        counts["errors"] += 1
    elif kind.startswith("item."):
        broken |= not active
        counts["items"] += 1
    else:
        counts["unknown"] += 1
    state[:] = [*counts.values(), broken or seq < last, active, idle, max(seq, last)]


def _summary(trace: str, state: list) -> pd.DataFrame:
    c = dict(zip(COUNTS, state))
    broken, active, idle, _ = state[len(COUNTS) :]
    whole = not broken and c["threads"] > 0 and not idle and not active
    if broken:
        name = "invalid_lifecycle"
    elif c["unknown"]:
        name = "unknown_controls"
    elif c["failed"] or c["errors"]:
        name = "observed_failure"
    else:
        name = "completed_turns" if whole else "incomplete"
    return pd.DataFrame([[trace, *state[: len(COUNTS)], broken, whole, name]], columns=[x.split()[0] for x in SUMMARY.split(", ")])


def stream_trace_summary(events: DataFrame, idle_time: str = "1 hour") -> DataFrame:
    """A stream of summaries from a stream of (trace string, seq bigint, kind string, ts timestamp).

    Every batch updates the traces that it holds; a trace without events for idle_time leaves the
    state; if it wasn't complete, its summary as incomplete is emitted then. Events of a trace must not arrive in a later batch than ones
    with greater numbers: such a trace is broken.
    """

    idle = int(pd.Timedelta(idle_time).total_seconds() * 1000)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = _summary(key[0], list(state.get))
            state.remove()
            if last.iloc[0, -1] == "incomplete":
                yield last
            return
        held = list(state.get) if state.exists else [0] * len(COUNTS) + [False, False, False, -1]
        rows = pd.concat(list(parts)).sort_values("seq")
        for kind, seq in zip(rows["kind"], rows["seq"]):
            _advance(held, kind, int(seq))
        state.update(tuple(held))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000)) + idle)
        yield _summary(key[0], held)

    return events.withWatermark("ts", idle_time).groupBy("trace").applyInPandasWithState(update, SUMMARY, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def stream_score(messages: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """score, any row-wise transformation, over a stream of messages; rows are only appended."""
    return score(messages)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over what is there; each batch becomes Parquet under path with its batch number.

    A batch that is run again replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}".replace("batch=", "b"))

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
