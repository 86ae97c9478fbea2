"""Run telemetry, in batches and streams: metric points, logs, sinks."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Batch sizes, intervals and limits of the telemetry.
BATCH, FLUSH_SECONDS, CHUNK_CHARS, PAGE = 256, 1.5, 8192, 64
SHORTEST, SHORT, MIDDLE, LONG, TIER_1, TIER_2 = 5.0, 10.0, 30.0, 60.0, 10, 50
BACKOFF_MAX = 30.0
GPU_KEY = r"^gpu\.([0-9]+)(?:\.|$)"
VALIDATION_STEP = r"Starting validation at step (\d+)"


def prefixed(key: Column, prefix: str) -> Column:
    return F.when(key.startswith(f"{prefix}/"), key).otherwise(F.concat(F.lit(f"{prefix}/"), key))


def metric_points(snapshots: DataFrame, keys: list[str], metrics: str = "metrics", uuids: str | None = "gpu_uuids") -> DataFrame:
    """A snapshot's map of metrics as rows: keys, key, value, gpu_idx and
    gpu_uuid. Values that are no numbers are left out."""
    long = snapshots.select(*keys, *([uuids] if uuids else []), F.explode(metrics).alias("key", "value")).where("value IS NOT NULL")
    index = F.regexp_extract("key", GPU_KEY, 1)
    out = long.withColumn("gpu_idx", F.when(index != "", index.cast("int")))
    uuid = F.try_element_at(F.col(uuids), F.col("gpu_idx")) if uuids else F.lit(None).cast("string")
    return out.withColumn("gpu_uuid", uuid).select(*keys, "key", "value", "gpu_idx", "gpu_uuid")


def sampling_interval(collected: Column, base: float = SHORT, dynamic: bool = True) -> Column:
    least = max(SHORTEST, base)
    if not dynamic:
        return F.lit(least)
    return F.when(collected < TIER_1, least).when(collected < TIER_2, max(least, MIDDLE)).otherwise(max(least, LONG))


def backoff(attempt: Column, first: float = 1.0) -> Column:
    """Seconds before a retry, doubled each time up to a bound; jitter of a
    quarter at most goes on top."""
    return F.least(F.lit(BACKOFF_MAX), first * F.pow(F.lit(2.0), attempt))


def retryable(status: Column) -> Column:
    return (status >= 500) | (status == 429) | status.isNull()


def chunked(text: Column, size: int = CHUNK_CHARS) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.when(F.length(text) > 0, F.transform(starts, lambda at: F.substr(text, at, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def latest_parameters(rows: DataFrame, run: str, seq: str, params: str) -> DataFrame:
    return rows.groupBy(run).agg(F.max_by(params, seq).alias(params))


def active_step(logs: DataFrame, run: str, order: str, line: str) -> DataFrame:
    """Adds the validation step that the log announced last."""
    found = F.regexp_extract(line, VALIDATION_STEP, 1)
    upto = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return logs.withColumn("step", F.last(F.when(found != "", found.cast("long")), ignorenulls=True).over(upto))


def gated_results(results: DataFrame, steps: DataFrame, run: str = "run_id") -> DataFrame:
    """Validation results whose step is the one under way."""
    return results.join(steps.select(run, "step"), [run, "step"], "left_semi")


def role_text(messages: DataFrame, conv: str, order: str, role: str, content: str) -> DataFrame:
    """(conv, user_text, assistant_text, env_text): each role's turns in order,
    joined by lines; the system's where the environment says nothing."""

    def said(name: str) -> Column:
        turns = F.array_sort(F.collect_list(F.when(F.col(role) == name, F.struct(order, content))))
        return T.strip(F.array_join(F.transform(turns, lambda x: x[content]), "\n"))

    out = messages.groupBy(conv).agg(said("user").alias("user_text"), said("assistant").alias("assistant_text"), said("environment").alias("_e"), said("system").alias("_s"))
    return out.select(conv, "user_text", "assistant_text", F.when(F.col("_e") != "", F.col("_e")).otherwise(F.col("_s")).alias("env_text"))


def post_json(url: str, timeout: float = 10.0) -> Callable[[list[dict]], None]:
    def send(rows: list[dict]) -> None:
        body = json.dumps({"points": rows}, ensure_ascii=False, default=str).encode()
        urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout).close()

    return send


def batch_sink(send: Callable[[list[dict]], None], dead_letters: str, size: int = BATCH) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: executors send rows in groups of ``size``; groups that
    fail are kept as JSON lines under ``dead_letters``, by batch, so that a
    batch that is run again replaces them. At least once."""

    def write(batch: DataFrame, number: int) -> None:
        def run(parts):
            import pandas as pd

            for part in parts:
                rows = json.loads(part.to_json(orient="records", date_format="iso"))
                for at in range(0, len(rows), size):
                    group = rows[at:at + size]
                    try:
                        send(group)
                    except OSError as e:
                        yield pd.DataFrame({"row": [json.dumps(r, ensure_ascii=False) for r in group], "error": [str(e)] * len(group)})

        failed = batch.mapInPandas(run, "row string, error string")
        failed.write.mode("overwrite").json(f"{dead_letters}/batch={number}")

    return write


def start_sink(stream: DataFrame, send: Callable[[list[dict]], None], dead_letters: str, checkpoint: str, available_now: bool = False):
    writer = stream.writeStream.foreachBatch(batch_sink(send, dead_letters)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{FLUSH_SECONDS} seconds")).start()


def with_retries(send: Callable[[list[dict]], None], attempts: int = 3, wait: Callable[[float], None] = time.sleep, first: float = 1.0) -> Callable[[list[dict]], None]:
    """A sender that tries again, after waits that double; the last failure is raised."""

    def again(rows: list[dict]) -> None:
        for k in range(attempts):
            try:
                return send(rows)
            except OSError:
                if k + 1 == attempts:
                    raise
                wait(min(BACKOFF_MAX, first * 2.0**k))

    return again


def log_chunks(lines: DataFrame, stream: str, order: str, text: str, ended: str | None = None, size: int = CHUNK_CHARS) -> DataFrame:
    """(stream, order, chunk, text, end): each log text in pieces, and for rows
    that end their stream (``ended``) a marker after their last piece."""
    pieces = F.transform(chunked(F.coalesce(text, F.lit("")), size), lambda x: F.struct(x.alias("text"), F.lit(False).alias("end")))
    marker = F.array(F.struct(F.lit("").alias("text"), F.lit(True).alias("end")))
    every = pieces if ended is None else F.concat(pieces, F.when(F.col(ended), marker).otherwise(F.array().cast("array<struct<text:string,end:boolean>>")))
    return lines.select(stream, order, F.posexplode(every).alias("chunk", "piece")).select(stream, order, "chunk", "piece.text", "piece.end")


def resumed(events: DataFrame, seen: DataFrame, stream: str = "stream", order: str = "event_no") -> DataFrame:
    """The events of a replayed stream that come after the last one seen
    (``seen``: stream, event_id), up to its end event, which is left out. A stream
    whose last event id is not in the replay starts anew."""
    last = seen.select(stream, F.col("event_id").alias("_seen"))
    found = events.join(last, stream, "left")
    upto = Window.partitionBy(stream)
    after = F.max(F.when(F.col("event_id") == F.col("_seen"), F.col(order))).over(upto)
    end = F.min(F.when((F.col("event") == "end") & (F.col(order) > F.coalesce(F.col("_after"), F.lit(-1))), F.col(order))).over(upto)
    out = found.withColumn("_after", after).withColumn("_end", end)
    return out.where((F.col("_after").isNull() | (F.col(order) > F.col("_after"))) & (F.col("_end").isNull() | (F.col(order) < F.col("_end")))).drop("_seen", "_after", "_end")


def cached_values(rows: DataFrame, key: str, time_: str, value: str, ttl: float = 60.0) -> DataFrame:
    """Adds what a cache with a time to live answers at each row's time: the
    value that was found when the entry was made, which is kept for ``ttl``
    seconds. Rows of a key are followed in order."""
    kind = rows.schema[value].dataType.simpleString()
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(time_, F.col(value).alias("found")))).alias("asked"))
    at = lambda x: x[time_].cast("timestamp").cast("double")
    start = F.struct(F.lit(None).cast("double").alias("made"), F.lit(None).cast(kind).alias("value"), F.array().cast(f"array<struct<{time_}:{rows.schema[time_].dataType.simpleString()},found:{kind},cached:{kind}>>").alias("out"))

    def follow(s: Column, x: Column) -> Column:
        fresh = s["made"].isNull() | (at(x) - s["made"] >= ttl)
        made, now = F.when(fresh, at(x)).otherwise(s["made"]), F.when(fresh, x["found"]).otherwise(s["value"])
        return F.struct(made.alias("made"), now.alias("value"), F.concat(s["out"], F.array(F.struct(x[time_].alias(time_), x["found"].alias("found"), now.alias("cached")))).alias("out"))

    done = listed.select(key, F.explode(F.aggregate("asked", start, follow, lambda s: s["out"])).alias("x"))
    return done.select(key, f"x.{time_}", F.col("x.found").alias(value), "x.cached")


def node_snapshots(nodes: DataFrame, collect: Callable[[str], dict[str, float]], keys: list[str] = ["node_id"], tasks: int | None = None) -> DataFrame:  # noqa: B006
    """(keys, metrics) of every node, collected at once: nodes are dealt over
    the cluster's tasks, and ``collect`` is called for each where its task runs."""

    def run(batches):
        for batch in batches:
            yield batch.assign(metrics=[{k: float(v) for k, v in collect(n).items() if v is not None} for n in batch[keys[0]]])

    dealt = nodes.select(*keys) if tasks is None else nodes.select(*keys).repartition(tasks, *keys)
    return dealt.mapInPandas(run, dealt.withColumn("metrics", F.lit(None).cast("map<string,double>")).schema)


def windowed_rates(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per key and time window; in a stream, late rows up to a bound."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
