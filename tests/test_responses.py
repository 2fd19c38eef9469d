import json

from stillwater import plans
from stillwater.sources import frames as S


def test_responses_hold_every_frame(spark, sf_dir):
    lines = S.embedding_scanlines(spark, sf_dir)
    frames = {tuple(r) for r in lines.select("session_id", "frame_id").distinct().collect()}
    assert max(f for _, f in frames) > 3
    for name in ("prepare_image", "encode_view", "capture"):
        got = [(r.session_id, r.frame_id) for r in plans.QUERIES[name](spark, sf_dir).collect()]
        assert len(got) == len(frames) and set(got) == frames, name
    documents = plans.QUERIES["session_document"](spark, sf_dir).collect()
    held = [(r.session_id, f["frame_id"]) for r in documents for f in json.loads(r.document)["frames"]]
    assert len(held) == len(frames) and set(held) == frames
    assert plans.QUERIES["stage_totals"](spark, sf_dir).first().cropped == 108 * len(frames)
