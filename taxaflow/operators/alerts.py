"""Log alerting: flatten, filter, match, parse, count, and thread alerts.

Everything up to the counts is row-wise and works on streams as it stands.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions.rows import evaluated_once
from taxaflow.session import settle

# Text searched for in messages and the alert it raises.
ALERT_PATTERNS = {
    "AmrAlleleMismatchError": "AmrAlleleMismatchError",
    "Background computation failed for background_id": "BackgroundComputationFailed",
    "Failed to upload S3 sample": "S3UploadFailed",
    "LargeBulkUploadEvent": "LargeBulkUploadEvent",
    "Phylo tree creation failed for": "PhyloTreeCreationFailed",
    "Phylo tree failed to kick off for": "PhyloTreeKickoffFailed",
    "PhyloTreeNgFailedEvent": "PhyloTreeNgFailedEvent",
    "SampleFailedEvent": "SampleFailedEvent",
    "subprocess.CalledProcessError": "CalledProcessError",
    "UploadFailedEvent": "UploadFailedEvent",
    "WorkflowUpgradeEvent": "WorkflowUpgradeEvent",
    "TaxonIndexEvictionError": "TaxonIndexEvictionError",
}
# Messages holding any of these are dropped.
IGNORED_TEXT = [
    "The client method is deprecated",
    "actionpack (5.1.6) lib/action_dispatch/middleware/debug_exceptions.rb:63:in",
    'ActionController::RoutingError (No route matches [GET] "/ws")',
    "binary data at marker",
    "Got new marker",
    "Known user error",
    "spades.py",
]
# Log group and the source it stands for.
LOG_SOURCES = {
    "ecs-logs-staging": "Staging",
    "ecs-logs-prod": "Prod",
    "/aws/batch/job": "/aws/batch/job",
}
UNREADABLE = "Error occurred while processing logs"
LOG_VIEWER = (
    "https://us-west-2.console.aws.amazon.com/cloudwatch/home?"
    "region=us-west-2#logEventViewer:group=/aws/batch/job;stream="
)
CREDENTIAL_PROBE = "aws sts get-caller-identity"
THREAD_HOURS = 2
BLOCK_SPANS = 84  # thread lengths in a block of time that one task works on: a week
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def flatten_logs(batches: DataFrame) -> DataFrame:
    """One row per log event with its group and stream."""
    return batches.select("logGroup", "logStream", F.explode("logEvents").alias("e")).select(
        F.col("logGroup").alias("log_group"),
        F.col("logStream").alias("log_stream"),
        F.col("e.id").alias("id"),
        F.col("e.timestamp").alias("timestamp_ms"),
        F.col("e.message").alias("message"),
    )


def ignore_filter(logs: DataFrame, ignored: Sequence[str] = IGNORED_TEXT) -> DataFrame:
    """Drop messages that hold any of the ignored texts."""
    return logs.filter(~reduce(or_, [F.col("message").contains(text) for text in ignored]))


def pattern_alerts(logs: DataFrame, patterns: Mapping[str, str] = ALERT_PATTERNS) -> DataFrame:
    """One row per pattern a message holds, with the name of the event.

    Most messages hold none and are dropped before any row is built for them.
    """
    hits = {p: F.col("message").contains(p) for p in patterns}
    matching = logs.filter(reduce(or_, hits.values()))
    names = F.array(*[F.when(hits[p], F.lit(event)) for p, event in patterns.items()])
    return matching.withColumn("event", F.explode(names)).filter("event IS NOT NULL")


def _whole_json(text: Column) -> Column:
    """JSON value of a text that is nothing but JSON, else NULL.

    The parser accepts text after a value. Wrapped once as an object field and once as an array
    item, such text breaks one of the two. Most plain lines are told by their first character.
    """
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    as_item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    value = F.when(as_item.isNotNull(), F.try_variant_get(as_field, "$.v", "variant"))
    return F.when(text.rlike(r"^\s*[\[{\"tfn0-9-]"), value)


def parse_alert(alerts: DataFrame, now: Column) -> DataFrame:
    """Time and text of each alert.

    * not JSON: event time in seconds, the whole record as text
    * JSON object with a text timestamp: cut at its first dot, text from ``message``
    * without timestamp: event time, text from ``message``
    * timestamp of another type: ``now``, the whole object as text
    * no ``message``, or not an object: ``now`` and a placeholder text

    ``alert_time`` is the time as printed; ``alert_ts`` is NULL when that is no time.
    """
    field_kind = "schema_of_variant(try_variant_get(_doc, '$.{}', 'variant'))"
    typed = alerts.withColumn("_doc", _whole_json(F.col("message"))).withColumns(
        {
            "_is_object": F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False)),
            "_stamp_kind": F.expr(field_kind.format("timestamp")),
            "_message_kind": F.expr(field_kind.format("message")),
            "_event_time": F.timestamp_seconds(F.expr("timestamp_ms div 1000")).cast("timestamp_ntz"),
            "_stamp": F.split_part(F.try_variant_get("_doc", "$.timestamp", "string"), F.lit("."), F.lit(1)),
        }
    )
    stamped = F.col("_stamp_kind") == "STRING"
    path = (
        F.when(F.col("_doc").isNull(), "plain")
        .when(~F.col("_is_object"), "unreadable")
        .when(~stamped, "bad_timestamp")
        .when(F.col("_message_kind").isNull(), "unreadable")
        .when(stamped, "stamped")
        .otherwise("unstamped")
    )
    pathed = evaluated_once(typed, path.alias("parse_path"))
    record = F.to_json(
        F.struct("id", F.col("timestamp_ms").alias("timestamp"), "message", F.col("log_group").alias("logGroup"),
                 F.col("log_stream").alias("logStream"))
    )
    is_path = F.col("parse_path")
    by_event = is_path.isin("plain", "unstamped")
    time = (
        F.when(is_path == "stamped", F.col("_stamp"))
        .when(by_event, F.date_format("_event_time", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(now, ISO_SECONDS))
    )
    stamp_ts = F.try_to_timestamp(F.translate("_stamp", "T", " ")).cast("timestamp_ntz")
    ts = F.when(is_path == "stamped", stamp_ts).when(by_event, F.col("_event_time")).otherwise(F.date_trunc("SECOND", now))
    # A JSON null reads as None.
    text = F.when(F.col("_message_kind") == "VOID", "None").otherwise(F.try_variant_get("_doc", "$.message", "string"))
    message = (
        F.when(is_path == "plain", record)
        .when(is_path == "bad_timestamp", F.col("message"))
        .when(is_path == "unreadable", UNREADABLE)
        .otherwise(text)
    )
    parsed = evaluated_once(
        pathed, time.alias("alert_time"), ts.cast("timestamp_ntz").alias("alert_ts"), message.alias("alert_message")
    )
    return parsed.select(*alerts.columns, "parse_path", "alert_time", "alert_ts", "alert_message")


def source_dimension(alerts: DataFrame, sources: Mapping[str, str] = LOG_SOURCES) -> DataFrame:
    """Source of each alert's log group; unknown groups stay NULL and belong in quarantine."""
    table = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair])
    return alerts.withColumn("log_source", F.try_element_at(table, F.col("log_group")))


def alert_text(alerts: DataFrame, account: str) -> DataFrame:
    """Thread topic and message text; an alert of an unknown source has no topic."""
    topic = F.format_string("[%s] [%s] %s", F.lit(account), F.col("log_source"), F.col("event"))
    return alerts.withColumn("topic", F.when(F.col("log_source").isNotNull(), topic)).withColumn(
        "text",
        F.format_string(
            "*%s* \n *Log stream:* %s \n *Timestamp:* %s \n %s", "topic", "log_stream", "alert_time", "alert_message"
        ),
    )


def log_alerts(batches: DataFrame, account: str, now: Column) -> DataFrame:
    """Log batches to alerts with time, source, topic and text."""
    found = pattern_alerts(ignore_filter(flatten_logs(batches)))
    return alert_text(source_dimension(parse_alert(found, now)), account)


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per minute, source and event; spaces in an event name become underscores.

    On a stream give ``alert_ts`` as a watermarked TIMESTAMP.
    """
    event = F.replace(F.col("event"), F.lit(" "), F.lit("_"))
    return (
        alerts.filter("log_source IS NOT NULL AND alert_ts IS NOT NULL")
        .groupBy(F.window("alert_ts", "1 minute").alias("_w"), "log_source", event.alias("event_name"))
        .agg(F.count("*").alias("occurrences"))
        .select(
            F.concat("log_source", F.lit("-log-count")).alias("namespace"),
            "event_name",
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "occurrences",
        )
    )


# ---- threads --------------------------------------------------------------------------------


def next_starts(seconds: np.ndarray, open_since: int | None, span: int) -> tuple[list[int], int | None]:
    """Thread starts among sorted times, given the open thread; returns them and the last one."""
    starts: list[int] = []
    at = 0
    while at < len(seconds):
        if open_since is not None:
            at = int(np.searchsorted(seconds, open_since + span, side="left"))
            if at == len(seconds):
                break
        open_since = int(seconds[at])
        starts.append(open_since)
    return starts, open_since


def block_outcomes(seconds: np.ndarray, begin: int, span: int) -> np.ndarray:
    """Last thread start in a block of time for every earliest second that a thread may start there.

    ``seconds`` are the block's sorted times. Entry ``i`` is for ``begin + i``; -1 means no start.
    """
    earliest = begin + np.arange(span, dtype="int64")
    last = np.full(span, -1, dtype="int64")
    while True:
        at = np.searchsorted(seconds, earliest, side="left")
        found = at < len(seconds)
        if not found.any():
            return last
        last[found] = seconds[at[found]]
        earliest[found] = last[found] + span
        earliest[~found] = seconds[-1] + 1


def thread_starts(alerts: DataFrame, hours: int = THREAD_HOURS) -> DataFrame:
    """Start of each thread per topic: the first alert, then the first one ``hours`` or more later.

    The chain depends only on which seconds have an alert, so alerts are first reduced to distinct
    seconds. A topic is split into blocks of time: each block first works out, for every second that
    a thread may start at, its last start; those outcomes are chained per topic, a short row per
    block; then every block lists its starts from the thread open before it.
    """
    span = hours * 3600
    length = BLOCK_SPANS * span
    seconds = settle(
        alerts.select("topic", F.unix_seconds(F.col("alert_ts").cast("timestamp")).alias("second"))
        .distinct()
        .withColumn("block", F.floor(F.col("second") / length))
    )

    def outcomes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        last = block_outcomes(np.sort(rows["second"].to_numpy()), int(key[1]) * length, span)
        return pd.DataFrame({"topic": [key[0]], "block": [key[1]], "last": [last]})

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        open_since, before = None, []
        for block, last in zip(rows["block"], rows["last"], strict=True):
            before.append(open_since)
            wait = 0 if open_since is None else max(0, open_since + span - int(block) * length)
            open_since = int(last[wait]) if last[wait] >= 0 else open_since
        return pd.DataFrame({"topic": rows["topic"], "block": rows["block"], "open_since": pd.array(before, dtype="Int64")})

    def starts(key: tuple, rows: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
        open_since = opened["open_since"].iloc[0]
        found, _ = next_starts(np.sort(rows["second"].to_numpy()), None if pd.isna(open_since) else int(open_since), span)
        return pd.DataFrame({"topic": key[0], "thread_second": np.array(found, dtype="int64")})

    lasts = seconds.groupBy("topic", "block").applyInPandas(outcomes, "topic STRING, block BIGINT, last ARRAY<BIGINT>")
    opened = lasts.groupBy("topic").applyInPandas(chain, "topic STRING, block BIGINT, open_since BIGINT")
    return (
        seconds.groupBy("topic", "block")
        .cogroup(opened.groupBy("topic", "block"))
        .applyInPandas(starts, "topic STRING, thread_second BIGINT")
    )


def attach_threads(alerts: DataFrame, starts: DataFrame, hours: int = THREAD_HOURS) -> DataFrame:
    """Alerts with the start of the thread that covers them.

    Alerts and threads meet on the topic and the ``hours``-long slot of time; a thread touches at
    most two slots.
    """
    span = hours * 3600
    slots = F.array_distinct(
        F.array(F.expr(f"thread_second div {span}"), F.expr(f"(thread_second + {span - 1}) div {span}"))
    )
    covered = starts.select("topic", "thread_second", F.explode(slots).alias("_slot"))
    second = F.unix_seconds(F.col("alert_ts").cast("timestamp"))
    placed = alerts.withColumn("_second", second).withColumn("_slot", F.expr(f"_second div {span}"))
    joined = placed.join(covered, ["topic", "_slot"]).filter(
        (F.col("_second") >= F.col("thread_second")) & (F.col("_second") < F.col("thread_second") + span)
    )
    started = F.timestamp_seconds("thread_second").cast("timestamp_ntz")
    return joined.withColumn("thread_start", started).select(*alerts.columns, "thread_start")


def alert_threads(alerts: DataFrame, hours: int = THREAD_HOURS) -> DataFrame:
    """Alerts with the start of the thread they belong to.

    Only topics and seconds are settled for the starts; the alerts themselves are read again.
    """
    usable = alerts.filter("log_source IS NOT NULL AND alert_ts IS NOT NULL")
    return attach_threads(usable, thread_starts(usable, hours), hours)


# ---- notices and views ----------------------------------------------------------------------


def execution_notice(events: DataFrame) -> DataFrame:
    """Notice text of finished executions; a failed container adds its cause, exit code and log.

    ``events`` has ``result, service, name, start_time, end_time, error, cause``.
    """
    cause = F.from_json(
        "cause", "StatusReason STRING, JobId STRING, Container STRUCT<ExitCode: STRING, LogStreamName: STRING>"
    )
    base = F.format_string(
        "*Alert from %s:*\n\n_Result_: *%s*\n_Execution Name_: %s\n_Start Time_: %s\n_End Time_: %s\n",
        "service", "result", "name", "start_time", "end_time",
    )
    container = F.format_string(
        f"_Cause_: %s\n_Exit Code_: %s\n_Container Log_: {LOG_VIEWER}%s\n_Batch Job Id_: %s\n",
        F.col("_c.StatusReason"), F.col("_c.Container.ExitCode"), F.col("_c.Container.LogStreamName"), F.col("_c.JobId"),
    )
    failure = F.concat(
        F.format_string("_Error_: %s\n", "error"),
        F.when(F.col("_c.Container").isNotNull(), container).otherwise(""),
    )
    return (
        events.withColumn("_c", cause)
        .withColumn("text", F.concat(base, F.when(F.col("result") == "Failure", failure).otherwise("")))
        .drop("_c")
    )


def alarm_notice(notifications: DataFrame, account: str, source: str, now: Column) -> DataFrame:
    """Topic and text of alarm notifications; ``notifications`` has ``Records``.

    A record whose message is not JSON has no alarm name; its topic is NULL and it belongs in
    quarantine.
    """
    records = notifications.select(F.explode("Records").alias("r")).select(
        F.col("r.Sns.Message").alias("message"), F.col("r.Sns.Timestamp").alias("sent_at")
    )
    readable = F.try_parse_json("message").isNotNull()
    return (
        records.withColumn("alarm_name", F.get_json_object("message", "$.AlarmName"))
        .withColumn("time", F.when(readable, F.col("sent_at")).otherwise(F.date_format(now, ISO_SECONDS)))
        .withColumn("topic", F.concat(F.lit(f"[{account}] [{source}] "), F.col("alarm_name")))
        .withColumn("text", F.format_string("*%s* \n *Timestamp:* %s\n ```\n%s```", "topic", "time", "message"))
        .withColumn("text", F.when(F.col("topic").isNotNull(), F.col("text")))
        .select("alarm_name", "time", "topic", "text")
    )


def stderr_view(logs: DataFrame) -> DataFrame:
    """Lines of stderr sources as printed; ``logs`` has ``timestamp_ms, message``.

    Structured lines need a source ending in ``.stderr`` and no ``data``; credential probes are
    dropped, the VERBOSE level is blank, and lines that are not JSON pass through.
    """
    fields = F.from_json("message", "source STRING, level STRING, message STRING, data STRING")
    keys = F.expr("json_object_keys(message)")
    structured = F.col("_keys").isNotNull()
    shown = (
        F.col("_f.source").endswith(".stderr")
        & ~F.array_contains("_keys", F.lit("data"))
        & ~F.coalesce(F.contains(F.col("_f.message"), F.lit(CREDENTIAL_PROBE)), F.lit(False))
    )
    level = (
        F.when(F.col("_f.level") == "VERBOSE", "")
        .when(F.col("_f.level").isin("ERROR", "WARNING", "NOTICE"), F.concat(F.lit(" "), F.col("_f.level")))
        .otherwise(F.coalesce("_f.level", F.lit("")))
    )
    time = F.date_format(F.timestamp_seconds(F.expr("timestamp_ms div 1000")), "yyyy-MM-dd HH:mm:ss")
    parsed = evaluated_once(
        logs.filter(~F.contains(F.col("message"), F.lit(CREDENTIAL_PROBE))), fields.alias("_f"), keys.alias("_keys")
    )
    return (
        parsed.filter(~structured | F.coalesce(shown, F.lit(False)))
        .withColumn(
            "line",
            F.when(
                structured, F.concat_ws(" ", time, F.concat(F.col("_f.source"), level), F.col("_f.message"))
            ).otherwise(F.concat_ws(" ", time, F.col("message"))),
        )
        .drop("_f", "_keys")
    )
