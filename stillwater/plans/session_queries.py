"""Queries of sessions and histories over event timelines: one session a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import STATUS, from_service_code, status_table, message
from ..operators import sessions as O
from ..operators.segments import placed
from ..sources import frames as S
from .registry import query, scalar

_FRAMES = """SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_id,
  640 * 480 * 3 AS bytes, max(1) OVER () AS one FROM events"""
_NEWEST = f"SELECT *, max(frame_id) OVER (PARTITION BY session_id) AS newest FROM ({_FRAMES})"
_SUMMARY = f"""SELECT session_id, 8 AS capacity, least(count(*), 8) AS retained, max(frame_id) - least(count(*), 8) + 1 AS oldest_id,
  max(frame_id) AS newest_id, count(*) AS captured_total, least(count(*), 8) * 921600 AS retained_bytes FROM ({_FRAMES}) GROUP BY session_id"""


def _frames(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts")
    return S.assign_frame_ids(e, "session_id", "ts", "event_id").select("session_id", "event_id", "frame_id", F.lit(921600).alias("bytes"))


@query("retained_window", f"SELECT session_id, frame_id, event_id FROM ({_NEWEST}) WHERE frame_id > newest - 8")
def retained_window(spark, sf_dir):
    return O.retained_window(_frames(spark, sf_dir), 8).select("session_id", "frame_id", "event_id")


@query("history_insert_evict", f"SELECT session_id, frame_id FROM ({_NEWEST}) WHERE frame_id > newest - 4")
def history_insert_evict(spark, sf_dir):
    return O.retained_window(_frames(spark, sf_dir), 4).select("session_id", "frame_id")


@query("evicted_frames", f"SELECT session_id, frame_id FROM ({_NEWEST}) WHERE frame_id <= newest - 8")
def evicted_frames(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return O.evicted_frames(f, O.retained_window(f, 8))


@query("history_summary", _SUMMARY)
def history_summary(spark, sf_dir):
    return O.history_summary(_frames(spark, sf_dir), 8)


@query(
    "frame_lookup",
    f"""SELECT o_orderkey AS request_id, CASE WHEN newest_id IS NULL THEN 'session_not_found'
  WHEN o_custkey % 150 > newest_id THEN 'frame_not_available (future)'
  WHEN o_custkey % 150 < oldest_id THEN 'frame_not_available (evicted)' ELSE 'ok' END AS status
FROM orders LEFT JOIN ({_SUMMARY}) s ON s.session_id = o_orderkey % 200""",
)
def frame_lookup(spark, sf_dir):
    r = S.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id", "o_orderkey % 200 AS session_id", "o_custkey % 150 AS frame_id"
    )
    return O.frame_lookup(r, history_summary(spark, sf_dir))


@query("session_get", f"""SELECT o_orderkey AS request_id, CASE WHEN s.session_id IS NULL THEN 'session_not_found' ELSE 'ok' END AS status
FROM orders LEFT JOIN ({_SUMMARY}) s ON s.session_id = o_orderkey % 200""")  # fmt: skip
def session_get(spark, sf_dir):
    r = S.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS request_id", "o_orderkey % 200 AS session_id")
    s = history_summary(spark, sf_dir).select("session_id", F.lit(True).alias("there"))
    return r.join(s, "session_id", "left").select(
        "request_id", F.when(F.col("there").isNull(), "session_not_found").otherwise("ok").alias("status")
    )


@query("latest_frame", f"SELECT session_id, frame_id, event_id FROM ({_NEWEST}) WHERE frame_id = newest")
def latest_frame(spark, sf_dir):
    return O.latest_frame(_frames(spark, sf_dir)).select("session_id", "frame_id", "event_id")


@query("session_frame_source", f"SELECT session_id, 1 AS baseline_id, max(frame_id) AS last_id FROM ({_FRAMES}) GROUP BY session_id")
def session_frame_source(spark, sf_dir):
    return _frames(spark, sf_dir).groupBy("session_id").agg(F.min("frame_id").alias("baseline_id"), F.max("frame_id").alias("last_id"))


@query(
    "history_accessors",
    f"""SELECT session_id, count(*) AS len, any_value(newest) AS captured_total, any_value(newest) + 1 AS next_id, min(frame_id) AS oldest_id,
  max(frame_id) AS latest_id, list(frame_id ORDER BY frame_id) AS ids FROM ({_NEWEST}) WHERE frame_id > newest - 8 GROUP BY session_id""",
)
def history_accessors(spark, sf_dir):
    kept = O.retained_window(_frames(spark, sf_dir), 8)  # at most 8 rows a session from here
    h = kept.groupBy("session_id").agg(
        F.count("*").alias("len"), F.min("frame_id").alias("oldest_id"), F.max("frame_id").alias("latest_id"),
        F.array_sort(F.collect_list("frame_id")).alias("ids"),
    )
    return h.withColumns({"captured_total": F.col("latest_id"), "next_id": F.col("latest_id") + 1})


def _with_newest(spark, sf_dir):
    """All frames with the newest id of their session."""
    f = _frames(spark, sf_dir)
    return f.join(f.groupBy("session_id").agg(F.max("frame_id").alias("newest")), "session_id")


@query("newest_flag", f"SELECT session_id, frame_id, frame_id = newest AS is_newest FROM ({_NEWEST})")
def newest_flag(spark, sf_dir):
    return _with_newest(spark, sf_dir).select("session_id", "frame_id", (F.col("frame_id") == F.col("newest")).alias("is_newest"))


@query(
    "older_priority",
    f"SELECT session_id, frame_id, CASE newest - frame_id WHEN 0 THEN 220 WHEN 1 THEN 60 ELSE 40 END AS priority FROM ({_NEWEST})",
)
def older_priority(spark, sf_dir):
    back = F.col("newest") - F.col("frame_id")
    return _with_newest(spark, sf_dir).select(
        "session_id", "frame_id", F.when(back == 0, 220).when(back == 1, 60).otherwise(40).alias("priority")
    )


#: Frames of a stack at most.
_STACK = 8


@query("frame_stack_limit", f"SELECT session_id, (frame_id - 1) // {_STACK} AS stack, count(*) AS frames, min(frame_id) AS first_id FROM ({_FRAMES}) GROUP BY ALL")
def frame_stack_limit(spark, sf_dir):
    """Stacks of eight frames at most over all of a session."""
    f = _frames(spark, sf_dir).withColumn("stack", F.expr(f"(frame_id - 1) div {_STACK}"))
    return f.groupBy("session_id", "stack").agg(F.count("*").alias("frames"), F.min("frame_id").alias("first_id"))


@query("stack_order", f"SELECT session_id, (frame_id - 1) // {_STACK} AS place, list(event_id ORDER BY frame_id) AS stack FROM ({_FRAMES}) GROUP BY ALL")
def stack_order(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("place", F.expr(f"(frame_id - 1) div {_STACK}"))  # eight rows a stack at most
    s = f.groupBy("session_id", "place").agg(F.array_sort(F.collect_list(F.struct("frame_id", "event_id"))).alias("s"))
    return s.select("session_id", "place", F.col("s.event_id").alias("stack"))


@query(
    "list_sessions",
    f"SELECT 's-' || session_id AS session, row_number() OVER (ORDER BY 's-' || session_id) AS place, captured_total FROM ({_SUMMARY})",
)
def list_sessions(spark, sf_dir):
    s = O.list_sessions(history_summary(spark, sf_dir))  # a row a session
    return placed(s.select("session", "captured_total"), "session")


@query("session_count", "SELECT count(DISTINCT user_id) AS sessions FROM events")
def session_count(spark, sf_dir):
    return S.table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("sessions"))


_EVENTS = ["begin", "end", "capture", "close", "fail"]
_KIND = "CASE WHEN event_id % 61 = 0 THEN 'fail' WHEN event_id % 23 = 0 THEN 'close' WHEN event_id % 3 = 0 THEN 'begin' WHEN event_id % 3 = 1 THEN 'end' ELSE 'capture' END"
_LOG = f"SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {_KIND} AS event FROM events"


def _log(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").selectExpr("user_id AS session_id", "ts", "event_id", f"{_KIND} AS event")
    return S.assign_frame_ids(e, "session_id", "ts", "event_id").withColumnRenamed("frame_id", "seq").select("session_id", "seq", "event")


@query(
    "state_machine",
    f"""WITH RECURSIVE log AS ({_LOG}),
m AS (
  SELECT session_id, 0::BIGINT AS seq, NULL::VARCHAR AS event, 'ok' AS status, 'ready' AS state FROM (SELECT DISTINCT session_id FROM log)
  UNION ALL
  SELECT log.session_id, log.seq, log.event,
    CASE WHEN m.state = 'closed' THEN 'session_closed' WHEN m.state = 'failed' THEN 'session_closed (failed)'
         WHEN log.event IN ('begin', 'close') AND m.state = 'observing' THEN 'session_busy' ELSE 'ok' END,
    CASE WHEN m.state IN ('closed', 'failed') THEN m.state WHEN log.event = 'fail' THEN 'failed'
         WHEN log.event = 'close' AND m.state = 'ready' THEN 'closed' WHEN log.event = 'begin' THEN 'observing'
         WHEN log.event = 'end' THEN 'ready' ELSE m.state END
  FROM m JOIN log ON log.session_id = m.session_id AND log.seq = m.seq + 1)
SELECT session_id, seq, event, status, state FROM m WHERE seq > 0""",
)
def state_machine(spark, sf_dir):
    return O.state_machine(_log(spark, sf_dir))


@query(
    "session_info",
    f"""WITH s AS ({_SUMMARY})
SELECT session_id, 's-' || session_id AS session, CASE session_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'region' ELSE 'window 0x' || printf('%x', session_id) END AS target,
  captured_total, retained FROM s""",
)
def session_info(spark, sf_dir):
    s = history_summary(spark, sf_dir)
    kind = F.col("session_id") % 3
    target = F.when(kind == 0, "desktop").when(kind == 1, "region").otherwise(F.concat(F.lit("window 0x"), F.lower(F.hex("session_id"))))
    return s.select("session_id", F.concat(F.lit("s-"), F.col("session_id")).alias("session"), target.alias("target"), "captured_total", "retained")


@query("session_capture", f"""SELECT session_id, event_id, CASE WHEN ok THEN sum(CAST(ok AS INT)) OVER (PARTITION BY session_id ORDER BY seq) END::BIGINT AS frame_id,
  CASE WHEN ok THEN 'ok' ELSE 'geometry_changed' END AS status
FROM (SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id % 31 <> 0 AS ok FROM events)""")  # fmt: skip
def session_capture(spark, sf_dir):
    """An id is consumed only by captures whose geometry is right."""
    from pyspark.sql import Window

    e = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", (F.col("event_id") % 31 != 0).alias("ok"))
    n = F.sum(F.col("ok").cast("int")).over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    return e.select("session_id", "event_id", F.when(F.col("ok"), n).alias("frame_id"), F.when(F.col("ok"), "ok").otherwise("geometry_changed").alias("status"))


_CODES = [c for c, _, _ in STATUS]
_CODE_SQL = "[" + ", ".join(f"'{c}'" for c in _CODES) + "]"
_TABLE_SQL = "(VALUES " + ", ".join(f"('{c}', {n}, '{p}')" for c, n, p in STATUS) + ") AS t(code, exit_status, prefix)"
_FATAL = "('session_not_found', 'session_closed', 'target_lost', 'display_unavailable')"


@query("error_code", f"SELECT code, exit_status FROM {_TABLE_SQL}")
def error_code(spark, sf_dir):
    return status_table(spark).select("code", "exit_status")


@query("exit_code", f"SELECT event_id, exit_status FROM events JOIN {_TABLE_SQL} ON exit_status = event_id % 26 + 1")
def exit_code(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 26 + 1).alias("n"))
    return e.join(F.broadcast(status_table(spark)), F.col("n") == F.col("exit_status")).select("event_id", "exit_status")


@query("is_session_fatal", f"SELECT code, code IN {_FATAL} AS session_fatal FROM {_TABLE_SQL}")
def is_session_fatal(spark, sf_dir):
    return status_table(spark).select("code", "session_fatal")


@query("error_message", f"""SELECT code, CASE code WHEN 'display_unavailable' THEN 'unable to connect to X11 display :' || exit_status || ': cause ' || exit_status
  WHEN 'window_not_found' THEN 'X11 window not found: 0x5' ELSE prefix || 'cause ' || exit_status END AS message FROM {_TABLE_SQL}""")
def error_message(spark, sf_dir):
    n = F.col("exit_status").cast("string")
    text = message(F.col("code"), F.col("prefix"), F.concat(F.lit("cause "), n), F.concat(F.lit(":"), n), F.concat(F.lit("0x"), n))
    return status_table(spark).select("code", text.alias("message"))


@query(
    "error_to_json",
    f"SELECT code, '{{\"error\":{{\"code\":\"' || code || '\",\"message\":\"' || prefix || 'detail\"}}}}' AS document FROM {_TABLE_SQL}",
)
def error_to_json(spark, sf_dir):
    from ..errors import error_to_json as to_json

    return status_table(spark).select("code", to_json(F.col("code"), F.concat("prefix", F.lit("detail"))).alias("document"))


def _coded(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("event_id") % 26 + 1).cast("int"))
    return S.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), code.alias("code"), (F.col("event_id") % 2 == 0).alias("created"))


_CODED = f"SELECT event_id AS id, {_CODE_SQL}[event_id % 26 + 1] AS code, event_id % 2 = 0 AS created FROM events"
_STRANGE = "'the service reported \"' || code || '\", which this client does not recognise: m'"
scalar(
    "window_lost_mapping",
    _coded,
    _CODED,
    ["id"],
    lambda: {"code": O.window_lost(F.col("code"), F.col("created"))},
    {"code": "CASE WHEN code = 'window_not_found' AND created THEN 'target_lost' ELSE code END"},
)
scalar(
    "state_after_error",
    _coded,
    _CODED,
    ["id"],
    lambda: {"state": O.state_after(F.col("code"))},
    {"state": f"CASE WHEN code IN {_FATAL} THEN 'failed' ELSE 'ready' END"},
)
scalar(
    "from_service_code",
    _coded,
    _CODED,
    ["id"],
    lambda: {c: from_service_code(F.col("code"), F.lit("m"))[c] for c in ("code", "message")},
    {
        "code": "CASE WHEN code = 'internal_error' THEN 'service_protocol_error' ELSE code END",
        "message": f"CASE WHEN code = 'internal_error' THEN {_STRANGE} ELSE 'm' END",
    },
)


@query("try_get_exclusive", f"""WITH t AS (SELECT event_id AS id, ['ready', 'observing', 'closed', 'failed'][event_id % 4 + 1] AS state FROM events)
SELECT id, CASE state WHEN 'observing' THEN 'session_busy' WHEN 'ready' THEN 'ok' ELSE 'session_closed' END AS status FROM t""")  # fmt: skip
def try_get_exclusive(spark, sf_dir):
    state = F.element_at(F.array(*[F.lit(s) for s in ("ready", "observing", "closed", "failed")]), (F.col("event_id") % 4 + 1).cast("int"))
    return S.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), O.exclusive(state).alias("status"))
