"""Queries over a log of jobs' messages and commands, each with SQL that computes the same over the same table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.progress import ALLOWED, checked, throttled
from .sources import table

#: Milliseconds between messages, and how many such spans are read at once.
INTERVAL, SPAN = 3_600_000, 24
#: Milliseconds of the log's clock, whatever the time zone of the session.
_MILLIS = "CAST(floor(CAST(CAST(CAST(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 6)) * 1000) AS BIGINT)"
COMMANDS = {"signup": "add", "click": "start", "view": "progress", "purchase": "finish", "error": "fail"}


def throttled_events(s: SparkSession, d: str) -> DataFrame:
    """Messages that are passed on: a job is one of ten groups of users, its shape whether an event is an error."""
    log = table(s, d, "events").select("event_id", (F.col("user_id") % 10).alias("job"), (F.col("event_type") == "error").alias("failing"), F.expr(_MILLIS).alias("at"))
    return throttled(log, "job", "at", "event_id", "failing", INTERVAL, SPAN).select("event_id", "job", "failing")


def commands(events: DataFrame) -> DataFrame:
    """event_id, job, at and command: a job is a user, its commands the types of events; every other one in progress asks for another target."""
    of = F.element_at(F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv]), F.col("event_type"))
    return events.select("event_id", F.col("user_id").alias("job"), F.expr(_MILLIS).alias("at"), F.when((of == "progress") & (F.col("event_id") % 2 == 1), "retarget").otherwise(of).alias("command"))


def job_transitions(s: SparkSession, d: str) -> DataFrame:
    """Each command with the state before and after it, and whether it was refused."""
    return checked(commands(table(s, d, "events")), "job", "at", "event_id", "command").drop("at")


_cases = " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in COMMANDS.items())
_steps = lambda s: " ".join(f"WHEN {s} = '{a}' AND e.command = '{c}' THEN '{b}'" for (a, c), b in ALLOWED.items())
SQL = {
    "throttled_events": f"""WITH RECURSIVE log AS (SELECT event_id, user_id % 10 AS job, event_type = 'error' AS failing, epoch_ms(ts) AS ms, row_number() OVER w AS n, lag(event_type = 'error') OVER w IS DISTINCT FROM (event_type = 'error') AS changed FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY epoch_ms(ts), event_id)),
        kept(job, n, ms) AS (SELECT job, n, ms FROM log WHERE n = 1 UNION ALL
            SELECT k.job, min(l.n), arg_min(l.ms, l.n) FROM kept k JOIN log l ON l.job = k.job AND l.n > k.n AND (l.changed OR l.ms >= k.ms + {INTERVAL}) GROUP BY k.job)
        SELECT event_id, job, failing FROM log JOIN kept USING (job, n)""",
    "job_transitions": f"""WITH RECURSIVE log AS (SELECT event_id, user_id AS job, CASE WHEN event_type = 'view' AND event_id % 2 = 1 THEN 'retarget' {_cases} END AS command, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events WHERE user_id IS NOT NULL),
        states(job, n, was, now) AS (SELECT job, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), '' FROM log WHERE n = 1 UNION ALL
            SELECT e.job, e.n, s.now, CASE {_steps('s.now')} ELSE s.now END FROM states s JOIN log e ON e.job = s.job AND e.n = s.n + 1)
        SELECT event_id, job, command, was, now, CASE WHEN (was, command) IN ({', '.join(str(k) for k in ALLOWED)}) THEN 'ok' ELSE 'refused' END AS status FROM log JOIN states USING (job, n)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n in SQL}
