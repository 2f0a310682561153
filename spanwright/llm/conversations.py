"""Conversations rebuilt from message events with keyed streaming state.

A stream of span events is reduced to compact turns, kept per trace in streaming state and closed by an event-time
timeout: every conversation whose last event lies further back than the gap, by the watermark, is ordered, validated
and emitted once. Late arrivals within the watermark are buffered with the rest. State holds no message text.

Defined cases: rows with a null, blank or all-zero trace id belong to no conversation; rows equal in all but row_no and
received_at are one turn (smallest row_no); ties of order are broken by row_no; an empty table gives an empty result;
extra columns are part of the equality of rows but otherwise ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import emit, ship, work_dir

ROLES = ("system", "user", "assistant", "tool")
#: Bits of a turn's state.
_TEXT, _READABLE = 4, 8

_TURN = "trace_id string, turn_no int, role string, row_no bigint"
_EVENTS = {"gen_ai.system.message": 0, "gen_ai.user.message": 1, "gen_ai.assistant.message": 2, "gen_ai.choice": 2, "gen_ai.tool.message": 3}
_NAMED = {"system": 0, "developer": 0, "user": 1, "human": 1, "assistant": 2, "ai": 2, "model": 2, "bot": 2, "tool": 3, "function": 3}


def _visible(text: Column) -> Column:
    """Whether anything but blanks, control and zero-width characters is left."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[\s\p{Z}\p{C}]+", "")) > 0, F.lit(False))


def turns(events: DataFrame) -> DataFrame:
    """Compact turns (trace, at, seq, flags, same, row_no) of event rows; works on batches and streams alike."""
    a = F.col("attributes")
    name = F.trim(F.col("name"))
    kind = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in _EVENTS.items()])
    said = F.lower(F.trim(a["role"]))
    choice = name == "gen_ai.choice"
    message = a["message"]
    parsed = F.try_parse_json(message)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    body = F.try_variant_get(parsed, "$.content", "variant")
    plain = F.try_variant_get(parsed, "$.content", "string")
    parts = F.try_variant_get(parsed, "$.content", "array<variant>")
    joined = F.concat_ws("", F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"), F.lit(""))))
    shape = F.schema_of_variant(body)
    from_message = F.when(shape.startswith("ARRAY"), joined).when(shape == "STRING", plain)
    readable = F.when(choice & message.isNotNull(), F.coalesce(is_object, F.lit(False))).otherwise(~choice | a["content"].isNotNull())
    text = F.when(choice & message.isNotNull(), from_message).otherwise(a["content"])
    role = F.when(kind.isin(2), kind).otherwise(F.coalesce(*[F.when(said == k, F.lit(v)) for k, v in _NAMED.items()], kind))
    rest = [F.col(f"`{c}`") for c in events.columns if c not in ("row_no", "received_at", "attributes", "trace_id", "trace")]
    pairs = F.array_sort(F.map_entries(a))
    trace = F.lower(F.trim(F.col("trace_id")))
    return (
        events.withColumn("trace", trace)
        .where(kind.isNotNull() & (F.length("trace") > 0) & ~F.col("trace").rlike("^0+$"))
        .select(
            "trace",
            F.greatest(F.least(F.coalesce("event_ts", "received_at", F.lit("1970-01-01").cast("timestamp")), F.lit("2250-01-01").cast("timestamp")), F.lit("1900-01-01").cast("timestamp")).alias("at"),
            F.col("event_ts").cast("double").alias("ts"),
            F.col("event_seq").cast("int").alias("seq"),
            (F.coalesce(role, kind) + F.when(_visible(text), F.lit(_TEXT)).otherwise(0) + F.when(readable, F.lit(_READABLE)).otherwise(0)).cast("int").alias("flags"),
            F.xxhash64("trace", *rest, F.to_json(pairs)).alias("same"),
            F.col("row_no").cast("long").alias("row_no"),
        )
    )


def validate(buffered: list[tuple]) -> list[tuple[int, int]]:
    """(role, row_no) of each turn of an intact conversation in order, or nothing. A turn: (ts, seq, flags, same, row_no)."""
    first: dict[int, tuple] = {}
    for t in buffered:
        k = first.get(t[3])
        if k is None or t[4] < k[4]:
            first[t[3]] = t
    rows = list(first.values())
    numbered = [t for t in rows if t[1] is not None]
    if numbered:
        if len(numbered) < len(rows):
            return []
        rows.sort(key=lambda t: (t[1], t[4]))
        if [t[1] for t in rows] != list(range(len(rows))):
            return []
    else:
        if any(t[0] is None for t in rows):
            return []
        rows.sort(key=lambda t: (t[0], t[4]))
    expect, last = 1, -1
    for n, (_, _, flags, _, _) in enumerate(rows):
        role = flags & 3
        if not flags & _READABLE:
            return []
        if role == 0:
            if n:
                return []
        elif role == 3:
            if last not in (1, 3):
                return []
        else:
            if role != expect or not flags & _TEXT:
                return []
            expect = 3 - role
        last = role
    if last != 2:
        return []
    return [(t[2] & 3, t[4]) for t in rows]


def _close(gap_ms: int):
    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # trace -> [last event, {identity: turn}] of the conversations of this bucket that are still open.
        live: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for pdf in pdfs:
                stamp = pdf["at"].astype("int64") // (10**6 if pdf["at"].dtype == "datetime64[ns]" else 10**3)
                for trace, ts, seq, flags, same, row_no, at in zip(pdf["trace"], pdf["ts"], pdf["seq"], pdf["flags"], pdf["same"], pdf["row_no"], stamp, strict=True):
                    turn = [None if ts is None or ts != ts else float(ts), None if seq is None or seq != seq else int(seq), int(flags), int(same), int(row_no)]
                    one = live.setdefault(trace, [0, {}])
                    one[0] = max(one[0], int(at))
                    kept = one[1].get(str(turn[3]))
                    if kept is None or turn[4] < kept[4]:
                        one[1][str(turn[3])] = turn
        now = state.getCurrentWatermarkMs()
        done = [t for t, (last, _) in live.items() if last + gap_ms <= now]
        rows = [(t, n, ROLES[r], row) for t in done for n, (r, row) in enumerate(validate([tuple(x) for x in live[t][1].values()]))]
        for t in done:
            del live[t]
        if live:
            state.update((json.dumps(live),))
            state.setTimeoutTimestamp(max(min(last for last, _ in live.values()) + gap_ms, now + 1))
        elif state.exists:
            state.remove()
        if rows:
            yield from emit(pd.DataFrame(rows, columns=["trace_id", "turn_no", "role", "row_no"]))

    return step


def conversation_stream(events: DataFrame, delay: str = "45 days", gap_ms: int = 6 * 3600 * 1000, buckets: int = 4096) -> DataFrame:
    """The streaming operator: intact conversations as append-mode rows (trace_id, turn_no, role, row_no).

    State is keyed by the hash of the trace, so that one call serves the open conversations of a bucket; each of them
    still closes at its own time. Raise buckets with the number of conversations open at once.
    """
    ship(events.sparkSession)
    t = turns(events).withColumn("bucket", F.pmod(F.xxhash64("trace"), F.lit(buckets))).withWatermark("at", delay)
    return t.groupBy("bucket").applyInPandasWithState(_close(gap_ms), _TURN, "open string", "append", "EventTimeTimeout")


def rebuild_log(spark: SparkSession, path: str, schema: T.StructType, delay: str = "45 days") -> DataFrame:
    """Replays a bounded event log through the stream until every conversation is closed, and returns the table.

    The log is read with an end mark, an event of no conversation far ahead in time, so that the watermark passes the
    last conversation. State, offsets and output live in the shared folder; a lost executor only repeats its tasks.
    """
    root = work_dir(spark, "conversations")
    mark = spark.range(1).select(*[(F.lit("~end") if f.name == "trace_id" else F.lit("gen_ai.user.message") if f.name == "name" else F.lit("2250-01-01 00:00:00").cast("timestamp") if f.name in ("event_ts", "received_at") else F.lit(-1) if f.name == "row_no" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    mark.write.parquet(f"{root}/mark")
    # A pattern that matches the path alone: the stream source takes a single file only by pattern.
    log = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    end = spark.readStream.schema(schema).parquet(f"{root}/mark")
    out = conversation_stream(log.unionByName(end), delay).where(F.col("trace_id") != "~end")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start(f"{root}/out")
    query.awaitTermination()
    return spark.read.schema(_TURN).parquet(f"{root}/out")
