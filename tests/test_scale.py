"""Hot sessions and many regions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stillwater.operators import regions as R
from stillwater.operators import segments as G


@pytest.mark.parametrize("least", [50, 10_000_000])
def test_hot_sessions_are_cut(spark, monkeypatch, least):
    monkeypatch.setattr(G, "LEAST_ROWS", least)
    rows = spark.range(4_000).selectExpr("CASE WHEN id % 2 = 0 THEN 1 WHEN id % 5 = 1 THEN NULL ELSE id % 40 END AS s", "cast(id * 7919 % 3001 as int) AS t", "id AS e", "id % 11 = 0 AS f")
    scan = G.Scan(rows, "s", "t", "e")
    sizes = [r["count"] for r in scan.rows.groupBy("s", "_segment").count().collect()]
    assert bool(scan.hot) == (least == 50) and (max(sizes) <= 1_000 if scan.hot else max(sizes) == 2_000)
    w = Window.partitionBy("s").orderBy("t", "e")
    plain = rows.select("s", "e", F.row_number().over(w).cast("long").alias("n"), F.lag("e").over(w).alias("b"), F.first("e").over(w).alias("a"), F.max(F.when(F.col("f"), F.col("e"))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    expected = {r.e: r for r in plain.collect()}
    numbered = scan.numbered("n").collect()
    assert len(numbered) == 4_000 and all(r.n == expected[r.e].n for r in numbered)
    near = G.Scan(rows, "s", "t", "e").neighbours("e", "b", "a").collect()
    assert len(near) == 4_000 and all((r.b, r.a) == (expected[r.e].b, expected[r.e].a) for r in near)
    most = G.Scan(rows, "s", "t", "e").running_max(F.when(F.col("f"), F.col("e")), "m").collect()
    assert len(most) == 4_000 and all(r.m == expected[r.e].m for r in most)
    assert G.Scan(rows.limit(0), "s", "t", "e").numbered().count() == 0


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_regions_meet_pixels_by_tile(spark, monkeypatch, most):
    monkeypatch.setattr(R, "BROADCAST_TILES", most)
    regions = spark.range(10_000).selectExpr("id AS name", "cast(id * 31 % 300 - 20 as int) AS rx", "cast(id * 17 % 200 - 10 as int) AS ry", "cast(id % 23 as int) AS rw", "cast(id % 9 as int) AS rh")
    pixels = spark.range(280 * 200).selectExpr("cast(id % 280 as int) AS x", "cast(id div 280 as int) AS y").filter("x % 7 = 0 AND y % 5 = 0")
    j = R.pixels_in(pixels, regions, tile=16)
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.name, r.n) for r in j.groupBy("name").agg(F.count("*").alias("n")).collect()}
    inside = lambda low, size, step, end: sum(v % step == 0 for v in range(max(0, low), min(end, low + size)))
    expected = {(i, n) for i in range(10_000) if (n := inside(i * 31 % 300 - 20, i % 23, 7, 280) * inside(i * 17 % 200 - 10, i % 9, 5, 200))}
    assert got == expected
