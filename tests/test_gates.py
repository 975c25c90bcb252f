"""Gates, and the paged source over files."""

import json

from pyspark.sql import functions as F

from tidemark.operators import gates
from tidemark.sources import transcripts
from tidemark.sources.paged import PagedSource


def test_verified(spark):
    schema = "expected double, duration double, streams array<struct<codec_type:string,codec_name:string,pix_fmt:string>>"
    good = [("video", "h264", "yuv420p"), ("audio", "aac", None)]
    rows = spark.createDataFrame([(120.0, 120.5, good), (120.0, 130.5, good), (120.0, 120.0, [("video", "vp9", "yuv420p")])], schema)
    assert [(r.duration_ok, r.video_ok, r.audio_ok) for r in gates.verified(rows).collect()] == [(True, True, True), (False, True, True), (True, False, False)]


def test_plan(spark):
    s = spark.createDataFrame([("v", 1, 0, 60, "a"), ("v", 2, 50, 50, "b"), ("v", 3, 2000, 2100, "c")], "video_id string, scene int, start long, end long, label string")
    got = {r.scene: (r.duration, r.invalid, r.overlaps) for r in gates.scene_plan(s).collect()}
    assert got == {1: (60, False, True), 2: (0, True, False), 3: (100, False, False)}
    head = gates.plan_header(s).first()
    assert head.total_expected_duration_seconds == 160 and [x.start for x in head.scenes] == ["00:00:00", "00:00:50", "00:33:20"]
    assert {r.scene: r.start for r in gates.buffered(s).collect()} == {1: 0, 2: 50, 3: 1700}


def test_speed_and_density(spark):
    row = spark.range(1).select(gates.predicted_hours(F.lit(36000.0), F.lit(1.0)).alias("h"), gates.too_slow(F.lit(360000.0), F.lit(5.0)).alias("slow")).first()
    assert abs(row.h - 1.0) < 1e-9 and row.slow
    m = spark.createDataFrame([(1, k * 600) for k in range(7)] + [(2, 0), (2, 7200)], "stream int, sec long")
    assert {r.stream: r.status for r in gates.density(m).collect()} == {1: "OK", 2: "SPARSE"}


def test_paged(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"data": {"cards": [{"id": k * 10 + j} for j in range(2)]}}))
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").options(url=f"file://{tmp_path}/{{page}}.json", pages="3", path="data.cards").load()
    assert sorted((r.page, r.pos, json.loads(r.value)["id"]) for r in rows.collect()) == [(k, j, k * 10 + j) for k in range(3) for j in range(2)]


def test_items_keep_their_places(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "x", "start": 1.0}, {"text": "y", "start": 2.0, "uncertain": True}]))
    rows = transcripts.items(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.text, r.uncertain) for r in rows] == [(0, "x", None), (1, "y", True)]
    assert gates.search(transcripts.items(spark, str(tmp_path)), "Y", 1.5, 3).count() == 1
