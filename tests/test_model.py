"""The scoring seam: several windows a call, frames that cannot be read, repeats, output shapes."""

import numpy as np
import pytest

from segmill.operators.model import FRAME_BYTES, score_frames, tensors, window_scores

SCHEMA = "video_id string, frame_no long, rgb binary"


def frame(v):
    return bytes([v]) * FRAME_BYTES


def first_pixel():
    return lambda x: x[:, :, 0, 0, :1]


def scores(spark, rows, make=first_pixel, calls=3):
    got = score_frames(spark.createDataFrame(rows, SCHEMA).repartition(3), make, calls).collect()
    return sorted(((r.video_id or "", r.frame_no, None if r.score is None else round(r.score * 255)) for r in got), key=str)


def test_windows_together(spark):
    rows = [(v, n, frame((n + k) % 200)) for k, v in enumerate("abc") for n in range(450)]
    assert scores(spark, rows) == sorted(((v, n, (n + k) % 200) for k, v in enumerate("abc") for n in range(450)), key=str)


def test_the_model_sees_whole_windows(spark):
    def make():
        def model(x):
            assert x.shape[1:] == (100, 27, 48, 3) and x.dtype == np.float32 and len(x) <= 3
            return np.repeat(x[:, -1:, 0, 0, :1], 100, axis=1)  # the last frame tells

        return model

    got = scores(spark, [("a", n, frame(n % 250)) for n in range(130)], make)
    assert {s for _, n, s in got if n < 100} == {99} and {s for _, n, s in got if n >= 100} == {129}


def test_frames_that_cannot_be_read(spark):
    def make():
        return lambda x: np.cumsum(x[:, :, 0, 0, 0], axis=1)  # tells what was shown before

    rows = [("a", 0, None), ("a", 1, frame(1)), ("a", 2, b"short"), ("a", 3, frame(10)), ("b", 7, None), ("b", 8, None), ("a", None, frame(9)), (None, 0, frame(3))]
    assert scores(spark, rows, make) == sorted([("a", 0, None), ("a", 1, 2), ("a", 2, None), ("a", 3, 13), ("b", 7, None), ("b", 8, None), ("", 0, 3)], key=str)


def test_repeated_frames(spark):
    rows = [("a", n, frame(n)) for n in range(100)] + [("a", 5, frame(200))] * 150 + [("a", 6, frame(2)), ("a", 7, None)]
    got = scores(spark, rows)
    assert len(got) == len(rows) and [s for _, n, s in got if n == 5] == [5] * 151 and {s for _, n, s in got if n == 6} == {2} and [s for _, n, s in got if n == 7] == [7, 7]


def test_empty(spark):
    assert score_frames(spark.createDataFrame([], SCHEMA), first_pixel).count() == 0


@pytest.mark.parametrize("windows", [1, 4])
def test_output_shapes(windows):
    want = np.arange(windows * 100, dtype=float).reshape(windows, 100)
    two = np.stack([want, -want], axis=-1)
    for out in (two, want, two.reshape(-1, 2), want.ravel(), two[..., :1].reshape(-1, 1)):
        assert np.array_equal(window_scores(out, windows), want)
    assert np.allclose(tensors([[frame(255)], [frame(0), frame(51)]], 4)[:, :, 0, 0, 0], [[1] * 4, [0, 0.2, 0.2, 0.2]])
