"""Plans, their steps, measured sizes, fits and documents against plain Python."""

import base64
import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.functions import codec
from stillwater.functions import kernels as K
from stillwater.operators import presentation as P
from stillwater.plans import presentation_queries as Q
from stillwater.sources.strips import texture_frames


def test_steps_are_the_states(spark, sf_dir):
    """A view's steps cover all states once and say in each what ladder_states says."""
    plan = Q._fitted(spark, sf_dir).filter("stack_id % 5 = 0")
    odd = plan.withColumns({"quality": F.when(F.col("format") == "jpeg", (F.col("frame_id") % 90 + 5).cast("int")), "width_policy": F.when(F.col("frame_id") % 3 > 0, (F.col("frame_id") % 2000 + 300).cast("int")),
                            "format": F.when(F.col("frame_id") % 11 == 0, "metadata").otherwise(F.col("format"))})
    names = ["stack_id", "frame_index", "view"]
    for p in (plan, odd):
        states = {(*[r[n] for n in names], r.state): (r.shown, r.actual_quality, r.actual_width) for r in P.ladder_states(p).collect()}
        covered = {}
        for r in P.view_steps(p).collect():
            for state in range(r.from_state, r.to_state):
                key = (*[r[n] for n in names], state)
                assert key not in covered
                covered[key] = (r.shown, r.actual_quality if r.shown else None, r.actual_width if r.shown else None)
        shown = {k: v if v[0] else (False, None, None) for k, v in states.items()}
        assert covered == shown


def encoded(content, r, quality, width):
    """Base64 length of a view, by the same codec, a view at a time."""
    rgb = K.texture(64, 48, content * 40 % 256)
    x, y, w, h = (r.x, r.y, r.w, r.h) if r.w else (0, 0, 64, 48)
    tw = w if r.width_policy is None and width == 64 else width
    out = K.resize(np.ascontiguousarray(rgb[y : y + h, x : x + w]), tw, max(1, int(h * tw / w + 0.5)))
    data = codec.encode_jpeg(out, quality) if r.format == "jpeg" else codec.encode_png(out)
    return len(base64.b64encode(data))


def test_fit_measured(spark, sf_dir):
    steps = Q._small_steps(spark, sf_dir)
    plan = steps.filter("from_state = 0").drop("from_state", "to_state", "shown", "actual_quality", "actual_width")
    some = plan.filter("stack_id % 1000000000 < 2")
    memo, totals = {}, defaultdict(int)
    for r in P.ladder_states(some).collect():
        if r.shown:
            key = (r.content, r.view, r.frame_index, r.is_newest, r.actual_quality, r.actual_width)
            if key not in memo:
                memo[key] = encoded(r.content, r, r.actual_quality, r.actual_width)
            totals[r.stack_id, r.state] += memo[key]
        else:
            totals[r.stack_id, r.state] += 0
    fits = {r.stack_id: r for r in P.fit_plans(Q._measured(spark, sf_dir), Q._small_budget(), "stack_id").collect()}
    kinds = set()
    for stack in {s for s, _ in totals}:
        budget = 6000 + stack % 1000003 * 7919 % 40000
        sizes = [totals[stack, k] for k in range(P.STATES)]
        state = next((k for k, b in enumerate(sizes) if b <= budget), None)
        r = fits[stack]
        assert (r.state, r.least_bytes, r.actual_bytes) == (state, min(sizes), None if state is None else sizes[state])
        kinds.add(r.fit)
        assert r.fit == ("payload_budget_exceeded" if state is None else "exact" if state == 0 else "adjusted")
    assert len(kinds) == 3


def test_each_setting_is_encoded_once(spark, sf_dir):
    s = P.with_setting(Q._small_steps(spark, sf_dir).filter("shown"))
    seeds = spark.range(32).selectExpr("id AS content", "id * 40 % 256 AS seed")
    images, seen = P.observe_stages(P.images_of(s, texture_frames(seeds, 64, 48)))
    n = images.count()
    distinct = s.select("content", *P.SETTING).distinct().count()
    assert n == distinct < s.count() / 3
    assert seen.get["images"] == n and seen.get["encoded_bytes"] > 0
    assert seen.get["encode_us"] > 0 and seen.get["crop_us"] >= 0 and seen.get["resize_us"] >= 0


def test_documents_hold_the_images(spark, sf_dir):
    rows = Q.to_response(spark, sf_dir).limit(40).collect()
    assert rows
    for r in rows:
        d = json.loads(r.document)
        assert [f["frame_index"] for f in d["frames"]] == sorted(f["frame_index"] for f in d["frames"])
        images = 0
        for f in d["frames"]:
            assert f["views"][0]["view"] == "overview"
            for v in f["views"]:
                if v["shown"]:
                    data = base64.b64decode(v["base64"])
                    images += 1
                    assert len(data) == v["bytes"]
                    if v["format"] == "png":
                        assert codec.decode_png(data).shape == (v["image_height"], v["image_width"], 3)
                    else:
                        assert data[:2] == b"\xff\xd8"
                    assert v["transform"]["scale_x"] == v["source"]["width"] / v["image_width"]
                else:
                    assert "base64" not in v
            assert f["bytes"] == sum(v.get("bytes", 0) for v in f["views"])
        assert d["images"] == images and d["bytes"] == sum(f["bytes"] for f in d["frames"])


def test_number_of_regions_is_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(P, "MAX_REGIONS", 3)
    with pytest.raises(Exception, match="at most 3 regions"):
        Q._plan(spark, sf_dir)
