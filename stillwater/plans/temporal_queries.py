"""Queries of temporal operators over embedding frames, and of schedules over event timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import temporal as T
from ..operators.segments import Scan
from ..sources import frames as S
from . import frame_sql as Q
from .registry import query, scalar

_OPTIONS = C.CompareOptions("rgb", 40, 0.1)
_ARGS = ("rgb", 40, 0.1)
_SCHEDULE = T.Schedule(100, 5000, 300)

#: smp(session_id, i, frame_id, again), cb and cc: samples with comparisons to the baseline and the previous frame
_SAMPLES = f"""WITH {Q.EMB},
smp AS (SELECT session_id, i, least(i + 1, last) AS frame_id, i + 1 > last AS again
  FROM (SELECT session_id, max(frame_id) AS last FROM emb GROUP BY session_id), (SELECT unnest(range({_SCHEDULE.samples})) AS i)),
qb AS ({Q.emb_baseline(*_ARGS)}),
qc AS ({Q.emb_consecutive(*_ARGS)}),
cb AS (SELECT smp.*, coalesce(changed, false) AS changed, coalesce(changed_pixels, 0) AS changed_pixels
  FROM smp LEFT JOIN qb USING (session_id, frame_id)),
cc AS (SELECT smp.*, coalesce(changed, false) AND NOT again AS moved FROM smp LEFT JOIN qc USING (session_id, frame_id))"""


def _comparisons(spark, sf_dir):
    lines = S.embedding_scanlines(spark, sf_dir)
    samples = S.scripted_samples(S.embedding_frames(spark, sf_dir), _SCHEDULE.samples)
    baseline = T.sampled(samples, C.compare_to_baseline(lines, _OPTIONS, "lines"))
    consecutive = T.sampled(samples, C.compare_consecutive(lines, _OPTIONS, "lines"))
    return samples, baseline, consecutive


@query("scripted_source", f"{_SAMPLES} SELECT session_id, i, frame_id FROM smp")
def scripted_source(spark, sf_dir):
    return S.scripted_samples(S.embedding_frames(spark, sf_dir), _SCHEDULE.samples)


@query(
    "wait_change",
    f"""{_SAMPLES}, r AS (SELECT session_id, min(i) FILTER (WHERE changed) AS k, max(i) AS last FROM cb GROUP BY session_id)
SELECT r.session_id, CASE WHEN k IS NULL THEN 'timeout' ELSE 'changed' END AS outcome, cb.frame_id AS final_frame_id,
  cb.changed_pixels, i + 1 AS captures, i AS comparisons, coalesce(k * 100, 5000) AS elapsed_ms
FROM r JOIN cb ON cb.session_id = r.session_id AND cb.i = coalesce(k, last)""",
)
def wait_change(spark, sf_dir):
    return T.wait_change(_comparisons(spark, sf_dir)[1], _SCHEDULE)


@query(
    "wait_stable",
    f"""{_SAMPLES}, lc AS (SELECT *, coalesce(max(CASE WHEN moved AND i > 0 THEN i * 100 END) OVER (PARTITION BY session_id ORDER BY i), 0) AS last_change FROM cc),
r AS (SELECT session_id, min(i) FILTER (WHERE i > 0 AND NOT moved AND i * 100 - last_change >= 300) AS k, max(i) AS last FROM lc GROUP BY session_id)
SELECT r.session_id, CASE WHEN k IS NULL THEN 'timeout' ELSE 'stable' END AS outcome, lc.frame_id AS final_frame_id,
  CASE WHEN k IS NULL THEN 5000 - last_change ELSE i * 100 - last_change END AS stable_ms, i + 1 AS captures, i AS comparisons
FROM r JOIN lc ON lc.session_id = r.session_id AND lc.i = coalesce(k, last)""",
)
def wait_stable(spark, sf_dir):
    return T.wait_stable(_comparisons(spark, sf_dir)[2], _SCHEDULE)


@query(
    "observe",
    f"""{_SAMPLES}, f AS (SELECT session_id, min(i) FILTER (WHERE changed AND i > 0) AS c FROM cb GROUP BY session_id),
lc AS (SELECT cc.*, f.c, greatest(f.c * 100, max(CASE WHEN moved AND i > f.c THEN i * 100 END) OVER (PARTITION BY cc.session_id ORDER BY i)) AS last_change
  FROM cc JOIN f ON f.session_id = cc.session_id),
r AS (SELECT session_id, min(i) FILTER (WHERE i > c AND NOT moved AND i * 100 - last_change >= 300) AS k, max(i) AS last, any_value(c) AS c FROM lc GROUP BY session_id)
SELECT r.session_id, CASE WHEN k IS NULL THEN 'timeout' ELSE 'observed' END AS outcome, r.c * 100 AS change_detected_ms,
  first.frame_id AS first_change_frame_id, lc.frame_id AS final_frame_id, lc.i + 1 AS captures, lc.i AS comparisons,
  CASE WHEN k IS NOT NULL THEN lc.i * 100 - last_change END AS stable_ms
FROM r JOIN lc ON lc.session_id = r.session_id AND lc.i = coalesce(k, last)
LEFT JOIN smp AS first ON first.session_id = r.session_id AND first.i = r.c""",
)
def observe(spark, sf_dir):
    _, baseline, consecutive = _comparisons(spark, sf_dir)
    return T.observe(baseline, consecutive, _SCHEDULE)


@query(
    "last_change_at",
    f"""{_SAMPLES} SELECT session_id, i, coalesce(max(CASE WHEN moved AND i > 0 THEN i * 100 END)
  OVER (PARTITION BY session_id ORDER BY i), 0) AS last_change_ms FROM cc""",
)
def last_change_at(spark, sf_dir):
    c = _comparisons(spark, sf_dir)[2]
    moved = F.col("changed") & ~F.col("again") & (F.col("i") > 0)
    scan = Scan(c.select("session_id", "i", moved.alias("moved")), "session_id", "i")
    r = scan.running_max(F.when(F.col("moved"), F.col("i") * 100), "last_change_ms")
    return r.select("session_id", "i", F.coalesce("last_change_ms", F.lit(0)).alias("last_change_ms"))


@query(
    "first_change_frame",
    f"WITH {Q.EMB} SELECT session_id, min(frame_id) FILTER (WHERE changed) AS first_change_frame_id FROM ({Q.emb_baseline(*_ARGS)}) GROUP BY session_id",
)
def first_change_frame(spark, sf_dir):
    c = C.compare_to_baseline(S.embedding_scanlines(spark, sf_dir), _OPTIONS, "lines")
    return c.groupBy("session_id").agg(F.min(F.when(F.col("changed"), F.col("frame_id"))).alias("first_change_frame_id"))


@query(
    "observation_ledger",
    """WITH e AS (SELECT user_id AS session_id, epoch_us(ts) AS at_us, CAST(round(value * 1000) AS BIGINT) AS d FROM events)
SELECT session_id, count(*) AS captures, count(*) - 1 AS comparisons, sum(d)::BIGINT AS capture_us, max(at_us + d) - min(at_us) AS elapsed_us,
  greatest(0, max(at_us + d) - min(at_us) - sum(d))::BIGINT AS sleep_us FROM e GROUP BY session_id""",
)
def observation_ledger(spark, sf_dir):
    """Where the time of each session went: captures by their durations, and what was slept between."""
    return T.ledger(S.event_timeline(spark, sf_dir))


_DEADLINES = "SELECT event_id AS id, event_id % 50 * 100 AS due, CAST(round(value * 20) AS BIGINT) AS now FROM events"
scalar(
    "poll_schedule",
    lambda spark, d: S.table(spark, d, "events").selectExpr(
        "event_id AS id", "event_id % 50 * 100 AS due", "CAST(round(value * 20) AS BIGINT) AS now"
    ),
    _DEADLINES,
    ["id"],
    lambda: {"deadline": T.next_deadline(F.col("due"), F.col("now"), F.lit(100))},
    {"deadline": "CASE WHEN now <= due THEN due ELSE due + 100 * ((now - due) // 100 + 1) END"},
)
scalar(
    "ideal_offset",
    lambda spark, d: S.table(spark, d, "events").selectExpr("event_id AS id"),
    "SELECT event_id AS id FROM events",
    ["id"],
    lambda: {"offset_ms": T.ideal_offset(F.col("id") % 8, F.lit(50))},
    {"offset_ms": "id % 8 * 50"},
)

_DURATIONS = """SELECT session_id, stack, list(d ORDER BY n) AS d
FROM (SELECT user_id AS session_id, CAST(round(value) AS BIGINT) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
        (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS stack FROM events) GROUP BY session_id, stack"""


@query(
    "sample_stack",
    f"""WITH RECURSIVE d AS ({_DURATIONS}),
s AS (
  SELECT session_id, stack, d, 0::BIGINT AS i, 0::BIGINT AS now, 0::BIGINT AS skipped, []::BIGINT[] AS offsets, true AS open FROM d
  UNION ALL
  SELECT session_id, stack, d, i + 1,
    CASE WHEN NOT open THEN now WHEN ready THEN greatest(now, slot) + d[i + 1] ELSE greatest(now, slot) END,
    CASE WHEN open THEN skipped + (slot - i * 100) // 100 ELSE skipped END,
    CASE WHEN open AND ready THEN list_append(offsets, greatest(now, slot) + d[i + 1]) ELSE offsets END,
    open AND ready
  FROM (SELECT *, now < 900 AND greatest(now, slot) < 900 AS ready
        FROM (SELECT *, greatest(i * 100, (now + 99) // 100 * 100) AS slot FROM s WHERE i < len(d))))
SELECT session_id, stack, offsets, len(offsets) AS captured, skipped,
  CASE WHEN len(offsets) >= 5 THEN 'complete' ELSE 'partial' END AS outcome FROM s WHERE i = len(d)""",
)
def sample_stack(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "ts", "event_id", F.round("value").cast("long").alias("d")
    )
    e = S.assign_frame_ids(e, "session_id", "ts", "event_id").withColumn("stack", F.expr("(frame_id - 1) div 5"))
    d = e.groupBy("session_id", "stack").agg(F.array_sort(F.collect_list(F.struct("frame_id", "d"))).alias("d"))  # five a stack at most
    return T.sample_stack(d.select("session_id", "stack", F.col("d.d").alias("d")), 5, 100, 900, ["session_id", "stack"])


@query(
    "sample_gaps",
    "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events",
)
def sample_gaps(spark, sf_dir):
    from pyspark.sql import Window

    at = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return S.table(spark, sf_dir, "events").select("event_id", (at - F.lag(at).over(w)).alias("gap_us"))


_OPT = "SELECT event_id AS id, event_id % 7 - 1 AS interval_ms, event_id % 11 - 1 AS timeout_ms, event_id % 5 - 1 AS stable_ms, (event_id % 13 - 1) / 10.0::DOUBLE AS area, event_id % 10 AS frames FROM events"
_OPT_COLUMNS = ["event_id AS id", "event_id % 7 - 1 AS interval_ms", "event_id % 11 - 1 AS timeout_ms", "event_id % 5 - 1 AS stable_ms",
                "(event_id % 13 - 1) / 10D AS area", "event_id % 10 AS frames"]


def _options(spark, sf_dir):
    return S.table(spark, sf_dir, "events").selectExpr(*_OPT_COLUMNS)


scalar(
    "validate_temporal",
    _options,
    _OPT,
    ["id"],
    lambda: {
        "status": T.validate_temporal(F.col("interval_ms"), F.col("timeout_ms"), F.col("stable_ms"), F.col("area"))
    },
    {
        "status": "CASE WHEN interval_ms <= 0 OR timeout_ms <= 0 OR stable_ms <= 0 THEN 'invalid_duration' "
            "WHEN area < 0 OR area > 1 THEN 'invalid_arguments' ELSE 'ok' END"
    },
)
scalar(
    "validate_realtime",
    _options,
    _OPT,
    ["id"],
    lambda: {
        "status": T.validate_realtime(F.col("frames"), F.col("timeout_ms"), F.col("interval_ms"))
    },
    {
        "status": "CASE WHEN frames < 1 OR frames > 8 THEN 'invalid_arguments' WHEN timeout_ms <= 0 OR frames > 1 AND interval_ms <= 0 "
            "THEN 'invalid_duration' ELSE 'ok' END"
    },
)


@query(
    "frame_ages",
    f"""WITH t AS (SELECT user_id AS session_id, event_id, epoch_us(ts) AS at_us FROM events)
SELECT event_id, greatest(m.now_us - at_us, 0) AS age_us FROM t JOIN (SELECT session_id, max(at_us) AS now_us FROM t GROUP BY session_id) m USING (session_id)""",
)
def frame_ages(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("at_us")
    )
    now = e.groupBy("session_id").agg(F.max("at_us").alias("now_us"))
    return e.join(now, "session_id").select("event_id", F.greatest(F.col("now_us") - F.col("at_us"), F.lit(0)).alias("age_us"))


@query(
    "stack_geometry_check",
    """WITH g AS (SELECT user_id, event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events)
SELECT user_id AS session_id, CASE WHEN bool_and((event_id % 97 = 0) = (first % 97 = 0) AND (event_id % 89 = 0) = (first % 89 = 0) AND (event_id % 83 = 0) = (first % 83 = 0))
  THEN 'ok' ELSE 'geometry_changed' END AS status FROM g GROUP BY user_id""",
)
def stack_geometry_check(spark, sf_dir):
    """Origin, size and format of all frames are those of the first."""
    odd = lambda n: (F.col("event_id") % n == 0).cast("int")
    geometry = F.struct(odd(97).alias("x"), (640 + odd(89)).alias("width"), (480 + odd(83)).alias("height"))
    g = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), geometry.alias("geometry"))
    return g.groupBy("session_id").agg(T.same_geometry(F.col("geometry")).alias("status"))


scalar(
    "empty_stack_error",
    _options,
    _OPT,
    ["id"],
    lambda: {
        "status": T.stack_status(F.col("frames"))
    },
    {
        "status": "CASE WHEN frames = 0 THEN 'observation_failed' ELSE 'ok' END"
    },
)
