"""Queries of trace summaries; a user's events are a trace."""

# ruff: noqa: E731
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hintspark.functions import text as X
from hintspark.plans.shared import SharedTables
from hintspark.queries import table
from hintspark.streaming import traces as S

QUERIES: dict = {}
KINDS = {"signup": "turn.started", "view": "item.updated", "click": "item.completed", "error": "error", "purchase": "turn.completed"}


def _lines(events: DataFrame) -> DataFrame:
    """Trace events as JSON lines; a user's first event starts the thread, and a tenth of the users send unknown ones."""
    kind = F.lit(None).cast("string")
    for event, k in KINDS.items():
        kind = F.when(F.col("event_type") == event, k).otherwise(kind)
    kind = F.when(F.col("event_id") % 97 == 0, "thread.started").when((F.col("user_id") % 10 == 0) & (F.col("event_id") % 50 == 0), "surprise").otherwise(kind)
    v = F.col("value").cast("long")
    usage = F.struct(v.alias(S.USAGE[0]), F.when(v % 3 != 0, v % 7).alias(S.USAGE[1]), (v * 2).alias(S.USAGE[2]), F.lit(None).cast("long").alias(S.USAGE[3]))
    line = F.to_json(F.struct(kind.alias("type"), F.when(kind == "turn.completed", usage).alias("usage")))
    return events.select(F.col("user_id").cast("string").alias("trace"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), line.alias("line"))


_KIND_SQL = "CASE WHEN event_id % 97 = 0 THEN 'thread.started' WHEN user_id % 10 = 0 AND event_id % 50 = 0 THEN 'surprise' " + " ".join(f"WHEN event_type = '{e}' THEN '{k}'" for e, k in KINDS.items()) + " END"
_EVENTS_SQL = f"""events_k AS (SELECT user_id::VARCHAR AS trace, event_id AS seq, {_KIND_SQL} AS kind, trunc(value)::BIGINT AS v FROM events),
    f AS (SELECT *, (kind = 'thread.started')::INT AS th, (kind = 'turn.started')::INT AS st, (kind IN ('turn.completed', 'turn.failed'))::INT AS en FROM events_k),
    b AS (SELECT *, coalesce(sum(th) OVER w, 0) AS bth, coalesce(sum(st) OVER w, 0) - coalesce(sum(en) OVER w, 0) > 0 AS active, max(CASE WHEN th = 1 THEN seq END) OVER w AS lt, max(CASE WHEN st = 1 THEN seq END) OVER w AS ls
      FROM f WINDOW w AS (PARTITION BY trace ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT trace, count(*) AS events, sum(th)::BIGINT AS threads, sum(st)::BIGINT AS started, count(*) FILTER (kind = 'turn.completed') AS completed, count(*) FILTER (kind = 'turn.failed') AS failed, count(*) FILTER (kind = 'error') AS errors,
      count(*) FILTER (starts_with(kind, 'item.')) AS items, count(*) FILTER (kind = 'surprise') AS unknown,
      bool_or((th = 1 AND (active OR (lt IS NOT NULL AND (ls IS NULL OR ls < lt)))) OR (st = 1 AND (active OR bth = 0)) OR ((en = 1 OR starts_with(kind, 'item.')) AND NOT active)) AS broken,
      max(CASE WHEN th = 1 THEN seq END) AS lt, max(CASE WHEN st = 1 THEN seq END) AS ls FROM b GROUP BY trace),
    s AS (SELECT trace, events, threads, started, completed, failed, errors, items, unknown, broken, NOT broken AND coalesce(ls > lt AND started = completed + failed, false) AS complete,
      CASE WHEN broken THEN 'invalid_lifecycle' WHEN unknown > 0 THEN 'unknown_controls' WHEN failed + errors > 0 THEN 'observed_failure' WHEN coalesce(ls > lt AND started = completed + failed, false) THEN 'completed_turns' ELSE 'incomplete' END AS status FROM t)"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_lines(_lines(table(spark, sf_dir, "events")))


QUERIES["o1_trace_summary"] = (lambda s, d: S.trace_summary(_parsed(s, d), "trace", "seq"), f"WITH {_EVENTS_SQL} SELECT * FROM s")
QUERIES["o2_usage_totals"] = (
    lambda s, d: S.usage_totals(_parsed(s, d), S.trace_summary(_parsed(s, d), "trace", "seq"), "trace"),
    f"""WITH {_EVENTS_SQL}, u AS (SELECT trace, unnest([{", ".join(f"'{u}'" for u in S.USAGE)}]) AS field, unnest([v, CASE WHEN v % 3 <> 0 THEN v % 7 END, v * 2, NULL]) AS value FROM events_k WHERE kind = 'turn.completed'),
    a AS (SELECT trace, field, sum(value)::BIGINT AS observed, count(value) AS turns, count(*) FILTER (value IS NULL) AS missing FROM u GROUP BY ALL)
    SELECT trace, field, observed, turns, missing, CASE WHEN status = 'completed_turns' AND turns = started THEN observed END AS total FROM a JOIN s USING (trace)""",
)
QUERIES["o4_parse_events"] = (
    lambda s, d: _parsed(s, d).groupBy("kind", "code").agg(F.count("*").alias("events"), F.sum(f"usage.{S.USAGE[0]}").alias("input")),
    f"WITH {_EVENTS_SQL} SELECT kind, NULL::VARCHAR AS code, count(*) AS events, sum(CASE WHEN kind = 'turn.completed' THEN v END)::BIGINT AS input FROM events_k GROUP BY kind",
)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's last summary of each trace; equal to the batch one, as events come in order."""
    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    parsed = S.parse_lines(_lines(source)).select("trace", "seq", "kind", "ts")
    root = SharedTables(spark, "trace-stream").root
    S.run_available(S.stream_trace_summary(parsed), root, "update")
    rows = spark.read.parquet(f"{root}/rows/*")
    last = rows.groupBy("trace").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("trace", "batch"))), "batch").alias("r"))
    return last.select("trace", "r.*")


QUERIES["o1_stream_trace_summary"] = (_streamed, f"WITH {_EVENTS_SQL} SELECT * FROM s")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule intents and question cues of messages, scored as a stream."""
    turns = table(spark, sf_dir, "conversations")
    source = spark.readStream.schema(turns.schema).parquet(f"{sf_dir}/conversations.parquet*")
    t = F.col("text")
    root = SharedTables(spark, "score-stream").root
    S.run_available(S.stream_score(source, lambda m: m.select("conv_id", "turn", X.rule_intent(t).alias("intent"), F.contains(t, F.lit("?")).alias("asks"))), root)
    return spark.read.parquet(f"{root}/rows/*").drop("batch")


def _scored_sql() -> str:
    from hintspark.queries.text import QUERIES as T

    return "SELECT conv_id, turn, intent, contains(text, '?') AS asks FROM conversations JOIN (" + T["t16_rule_intent"][1] + ") ON key = 'c:' || conv_id || ':' || turn"


QUERIES["o3_stream_score"] = (_scored, _scored_sql())
