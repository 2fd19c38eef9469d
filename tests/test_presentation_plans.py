"""Plans of the presentation queries stay small: what is made once a kind of frames is written and read back."""

import pytest
from pyspark.sql import functions as F

from stillwater import plans
from stillwater.operators import presentation as P
from stillwater.plans import presentation_queries as Q


@pytest.mark.parametrize("name", ["present_stack", "to_response"])
def test_documents_read_the_events_once(name, spark, sf_dir):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and plan.count("Join ") == 2  # events, sizes and views of kinds
    assert plan.count("Window [") == 2 and "MapInArrow" not in plan


def test_views_of_few_kinds_are_not_shuffled(spark, sf_dir, monkeypatch):
    """They are broadcast by their own measure, not by the files' size, and either join gives the same documents."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = Q.to_response(spark, sf_dir)
        with monkeypatch.context() as m:
            m.setattr(P, "BROADCAST_BYTES", 1)
            many = Q.to_response(spark, sf_dir)
        with monkeypatch.context() as m:
            m.setattr(P, "BROADCAST_KINDS", 1)
            plans_of = [d._jdf.queryExecution().executedPlan().toString() for d in (few, many, Q.to_response(spark, sf_dir))]
        assert [p.count("BroadcastHashJoin") for p in plans_of] == [1, 0, 0]
        assert [p.count("SortMergeJoin") for p in plans_of] == [1, 2, 2]  # the sizes' join is Spark's own choice
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_are_gathered_in_parts(spark, sf_dir, monkeypatch):
    """Parts are bounded by what their images take: frames are dealt out once, before they have any."""
    monkeypatch.setattr(P, "GATHERED_BYTES", 1 << 20)
    docs = Q.to_response(spark, sf_dir)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ObjectHashAggregate") < plan.index("BroadcastHashJoin") < plan.index("REPARTITION_BY_NUM")
    sizes = [r.n for r in docs.groupBy(F.spark_partition_id()).agg(F.sum(F.length("document")).alias("n")).collect()]
    assert len(sizes) > 2 and max(sizes) < 2 << 20 and sum(sizes) < len(sizes) << 20


def _copies(spark, sf_dir, tmp_path, n, rows="true"):
    """A folder of n copies of the events that ``rows`` names: other users and ids, the same contents in the same order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter(rows).crossJoin(spark.range(n).withColumnRenamed("id", "i"))
    e = e.withColumns({"user_id": F.expr("user_id + i * 100000"), "event_id": F.expr("event_id + i * 32000000")}).drop("i")
    e.write.parquet(f"{tmp_path}/copies/events.parquet")
    return f"{tmp_path}/copies"


def test_documents_that_show_the_same_lie_together(spark, sf_dir, tmp_path):
    """Their images are repeated, which the codec of the files finds only in rows that are near each other."""
    d = _copies(spark, sf_dir, tmp_path, 40, "user_id < 5")
    docs, size = Q.to_response(spark, d), lambda at: sum(f.stat().st_size for f in at.rglob("*.parquet"))
    docs.write.parquet(f"{tmp_path}/docs")
    spark.read.parquet(f"{tmp_path}/docs").orderBy("stack_id").write.parquet(f"{tmp_path}/any")
    assert size(tmp_path / "docs") < 0.5 * size(tmp_path / "any")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.index("BroadcastHashJoin") < plan.index("Exchange rangepartitioning")


def test_documents_that_all_show_the_same_are_dealt_out(spark, sf_dir, tmp_path, monkeypatch):
    d = _copies(spark, sf_dir, tmp_path, 400, "event_id = 31")
    monkeypatch.setattr(P, "GATHERED_BYTES", 1 << 20)
    docs = Q.to_response(spark, d)
    parts = docs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.length("document")).alias("chars")).collect()
    assert sum(r.n for r in parts) == 400 and docs.select("stack_id").distinct().count() == 400
    assert len(parts) > 2 and max(r.chars for r in parts) < 2 << 20


def test_states_are_told_from_one_row_a_view(spark, sf_dir):
    lines = plans.QUERIES["older_views_exhausted"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert lines.index("Generate explode") < lines.index("Aggregate [")  # the states come after the sums
    for name in ("rung_lower_quality", "rung_lower_resolution", "rung_omit_optional"):
        assert plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1


def test_exhaustion_is_that_of_the_states(spark, sf_dir):
    """Odd settings too: no views of older frames, formats without images, widths below all steps."""
    plan = Q._fitted(spark, sf_dir).filter("stack_id % 7 = 0")
    odd = plan.withColumns({"quality": F.when(F.col("format") == "jpeg", (F.col("frame_id") % 90 + 5).cast("int")), "width_policy": F.when(F.col("frame_id") % 3 > 0, (F.col("frame_id") % 2000 + 300).cast("int")),
                            "format": F.when(F.col("frame_id") % 11 == 0, "metadata").otherwise(F.col("format"))})
    for p in (plan, odd):
        expected = {}
        for r in P.ladder_states(p).collect():
            e = expected.setdefault((r.stack_id, r.state), [True, False])
            width = r.width_policy or r.frame_width
            below = any(r.min_quality <= s < r.actual_quality for s in P.QUALITY_LADDER) if r.format == "jpeg" else False
            below |= any(r.min_width <= s < r.actual_width for s in P.WIDTH_LADDER)
            if not r.is_newest and r.shown:
                e[0] &= not below
            if r.is_newest:
                e[1] |= r.actual_quality != r.quality or r.actual_width != width or not r.shown and r.format != "metadata"
        got = {(r.stack_id, r.state): [r.exhausted, r.newest_degraded] for r in P.exhaustion(p, "stack_id").collect()}
        assert got == expected
        assert len({tuple(e) for e in expected.values()}) == 3  # the newest gives way after the older ones only


@pytest.mark.parametrize("name", ["fit_measured", "measure_plan"])
def test_sizes_come_from_kinds_of_frames(name, spark, sf_dir):
    """No view and no step of the frames themselves: they meet the sizes of their kind, and are added up."""
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Generate" not in plan and "MapInArrow" not in plan
    assert plan.count("Relation [") == 2
