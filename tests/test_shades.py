"""Queries that show scores to a model or a file as shades: scores above 1 keep their whole value."""

import datetime

import pytest

import __spark_entry__ as entry

VALUES = [10.0, 510.0, 560.21, 512.0, 1400.0, 300.0]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, datetime.datetime(2024, 1, 1 + i, tzinfo=datetime.timezone.utc), 4, "view", v, "{}") for i, v in enumerate(VALUES * 2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def run(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def shades():
    return [int(v / 500 * 250) for v in VALUES * 2]


def test_frame_ranges(spark, folder):
    assert {r.frame_no: r.shade for r in run(spark, folder, "frame_ranges")} == {i: s for i, s in enumerate(shades()) if i >= 5}


def test_model_scores(spark, folder):
    assert {r.frame_no: r.score for r in run(spark, folder, "model_scores")} == {i: round(s / 255, 6) for i, s in enumerate(shades())}


def test_model_odd_frames(spark, folder):
    assert {r.frame_no: r.score for r in run(spark, folder, "model_odd_frames")} == {i: None if i % 7 == 3 else round(s / 255, 6) for i, s in enumerate(shades())}


def test_model_cuts(spark, folder):
    assert sorted(r.t for r in run(spark, folder, "model_cuts")) == [0.3, 0.9]  # islands of frames 1-5 and 7-11, one a tenth of a second
