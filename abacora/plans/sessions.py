"""Queries on sessions and events: the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as X
from ..streaming import folds, machines
from ..views import Views
from .registry import query

NOW = "2024-01-30 00:00:00"


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_first_event(v: Views):
    return X.first_events(v.activity, ["user_id", "event_type", "day"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) > 1")
def rate_limit_windows(v: Views):
    return X.over_rate(v.activity, 1, "1 hour").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


@query("""WITH s AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events),
f AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM s)
SELECT user_id, event_id, CAST(failures AS BIGINT) AS failures, failures >= 5 AS locked FROM f""")
def lockout_running_count(v: Views):
    return X.lockouts(v.activity, "error", "purchase", 5).select("user_id", "event_id", "failures", "locked")


@query(f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_status, CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts))) AS BIGINT) AS age, CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(max(ts))) AS BIGINT) > 86400 AS stale FROM events GROUP BY user_id")
def stale_state(v: Views):
    return X.last_status(v.activity, NOW, 86400)


@query(f"SELECT event_id FROM events WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) BETWEEN 0 AND 36000")
def ttl_filter(v: Views):
    return X.within_ttl(v.activity, NOW, 36000).select("event_id")


@query(f"SELECT event_id, greatest(0, CAST(floor(epoch(ts)) + 600 * 144 - epoch(TIMESTAMP '{NOW}') AS BIGINT)) AS remaining FROM events")
def timer_remaining(v: Views):
    return v.activity.select("event_id", F.greatest(F.lit(0).cast("long"), X.seconds(F.col("ts")) + 86400 - X.seconds(F.lit(NOW).cast("timestamp"))).alias("remaining"))


@query("SELECT conv_id, count(*) AS n_turns, count(DISTINCT turn) = max(turn) + 1 AS complete, CAST(ceil(count(*) / 5.0) AS BIGINT) AS batches FROM conversations GROUP BY conv_id")
def batch_completeness(v: Views):
    return X.completeness(v.table("conversations"), 5)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_missing(v: Views):
    return X.still_to_do(v.table("documents").select("doc_id"), v.table("labels").where("quality = 1"), "doc_id")


@query("""WITH a AS (SELECT l_orderkey AS attempt_id, count(*) AS loaded, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS answered, CAST(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS correct, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey)
SELECT attempt_id, loaded, answered, correct, loaded - correct AS incorrect, last > o_orderdate + INTERVAL 60 DAY AS timed_out, answered = loaded OR last > o_orderdate + INTERVAL 60 DAY AS accepted FROM a JOIN orders ON o_orderkey = attempt_id""")
def late_submit_rule(v: Views):
    line = v.table("lineitem").select(F.col("l_orderkey").alias("attempt_id"), (F.col("l_returnflag") == "N").alias("answered"), (F.col("l_linestatus") == "O").alias("right"), F.col("l_shipdate").alias("at"))
    start = v.table("orders").select(F.col("o_orderkey").alias("attempt_id"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("expires_at"))
    return X.submitted(line, start)


_STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'preparing' WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'complete' ELSE 'failed' END"
_QUIZ = "user_id * 100 + CAST(floor(day(ts) / 3) AS BIGINT)"
UNTIL = 1_706_832_000_000  # 2024-02-02, when the last timers have gone off


def _moves(v: Views):
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "preparing").when(F.col("event_type") == "click", "ready").when(F.col("event_type") == "purchase", "complete").otherwise("failed")
    return folds.timed(v.activity).select((F.col("user_id") * 100 + F.floor(F.dayofmonth("ts") / 3).cast("long")).alias("quiz_id"), "ms", "event_id", status.alias("status"))


_LAPSED = "prev.st IN ('queued', 'preparing') AND e.ms > prev.since + 36000000"
_FROM = f"CASE WHEN {_LAPSED} THEN 'stale' ELSE prev.st END"
_MAY = f"""(({_FROM} IN ('idle', 'failed', 'stale') AND e.status = 'queued') OR ({_FROM} = 'queued' AND e.status IN ('preparing', 'failed'))
OR ({_FROM} = 'preparing' AND e.status IN ('ready', 'complete', 'failed')) OR ({_FROM} = 'ready' AND e.status IN ('preparing', 'complete', 'failed')))"""


@query(f"""WITH RECURSIVE ev AS (SELECT {_QUIZ} AS quiz_id, epoch_us(ts) // 1000 AS ms, event_id, {_STATUS} AS status, row_number() OVER (PARTITION BY {_QUIZ} ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
run AS (SELECT quiz_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS ms, 'idle' AS was, 'idle' AS st, 0::BIGINT AS since, false AS ok, NULL::VARCHAR AS lapsed, NULL::BIGINT AS lapsed_at FROM (SELECT DISTINCT quiz_id FROM ev)
UNION ALL SELECT e.quiz_id, e.n, e.event_id, e.ms, {_FROM}, CASE WHEN {_MAY} THEN e.status ELSE {_FROM} END, CASE WHEN {_MAY} THEN e.ms WHEN {_LAPSED} THEN prev.since + 36000001 ELSE prev.since END, {_MAY},
CASE WHEN {_LAPSED} THEN prev.st END, CASE WHEN {_LAPSED} THEN prev.since + 36000001 END FROM run prev JOIN ev e ON e.quiz_id = prev.quiz_id AND e.n = prev.n + 1)
SELECT quiz_id, event_id, ms AS "at", was AS before, st AS after, ok AS accepted FROM run WHERE n > 0
UNION ALL SELECT quiz_id, NULL, lapsed_at, lapsed, 'stale', true FROM run WHERE lapsed IS NOT NULL
UNION ALL SELECT quiz_id, NULL, since + 36000001, st, 'stale', true FROM run WHERE st IN ('queued', 'preparing') AND since + 36000001 <= {UNTIL} AND (quiz_id, n) IN (SELECT quiz_id, max(n) FROM run GROUP BY quiz_id)""")
def prefetch_transitions(v: Views):
    """T5: every status a quiz was asked to take, whether it did, and when it went stale by itself (after ten hours)."""
    return folds.fold_batch(_moves(v), machines.Prefetch("quiz_id", 36000), UNTIL)


@query("""WITH RECURSIVE ev AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
run AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS times, NULL::BIGINT AS full_ FROM (SELECT DISTINCT user_id FROM ev)
UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN c.full_ IS NULL THEN list_append(prev.times, e.ms) ELSE prev.times END, c.full_ FROM run prev JOIN ev e ON e.user_id = prev.user_id AND e.n = prev.n + 1,
LATERAL (SELECT CASE WHEN len(list_filter(prev.times, lambda t: t > e.ms - 28800000)) >= 1 THEN 28800 WHEN len(list_filter(prev.times, lambda t: t > e.ms - 172800000)) >= 4 THEN 172800 END AS full_) c)
SELECT user_id, event_id, full_ IS NULL AS accepted, full_ AS limited_by FROM run WHERE n > 0""")
def sliding_limits(v: Views):
    """At most one event of a user in any eight hours and four in any two days, of those let through."""
    return folds.fold_batch(folds.timed(v.activity).select("user_id", "ms", "event_id"), machines.SlidingLimits("user_id", ((1, 28800), (4, 172800))))


@query("""WITH e AS (SELECT user_id AS token, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'signup' THEN 'issue' ELSE 'consume' END AS kind FROM events),
i AS (SELECT *, max(CASE WHEN kind = 'issue' THEN ms END) OVER (PARTITION BY token ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS issued, count(CASE WHEN kind = 'issue' THEN 1 END) OVER (PARTITION BY token ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM e),
f AS (SELECT *, kind = 'consume' AND issued IS NOT NULL AND ms < issued + 86400000 AS could FROM i),
g AS (SELECT *, count(CASE WHEN could THEN 1 END) OVER (PARTITION BY token, epoch ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
SELECT token, event_id, kind = 'issue' OR (could AND before = 0) AS accepted, CASE WHEN kind = 'issue' OR (could AND before = 0) THEN NULL WHEN issued IS NULL THEN 'unknown' WHEN before > 0 THEN 'used' ELSE 'expired' END AS reason FROM g""")
def single_use_tokens(v: Views):
    """A sign-up issues a token for a day, whatever comes next consumes it."""
    rows = folds.timed(v.activity).select(F.col("user_id").alias("token"), "ms", "event_id", F.when(F.col("event_type") == "signup", "issue").otherwise("consume").alias("kind"))
    return folds.fold_batch(rows, machines.SingleUse("token", 86400))


@query()
def batch_reveals(v: Views):
    """T4: what quizzes of 12 questions revealed and refused: a sign-up opens one, views and clicks answer, errors ask for more."""
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "next").when(F.col("event_type") == "purchase", "submit").otherwise("answer")
    index = F.when(F.col("event_type") == "error", 5).otherwise(F.col("event_id") % 6)
    rows = folds.timed(v.activity).select(F.col("user_id").alias("quiz_id"), "ms", "event_id", kind.alias("kind"), index.cast("long").alias("index"), F.substring(F.lit("ABCDE"), (1 + F.col("event_id") % 5).cast("int"), 1).alias("answer"), F.lit(12).cast("long").alias("target"))
    return folds.fold_batch(rows, machines.Reveal("quiz_id"))
