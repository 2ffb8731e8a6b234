"""Fused picture kernels against the plain steps; picture files, padded rows, modes and short buffers."""

import struct

import numpy as np
import pytest

from segmill.functions import images
from segmill.sources import tables

SCHEMA = "video_id string, idx int, height int, width int, mode string, data binary"


def plain_hash(rgb):
    """Grey, resize, transform and bits one after another, each by its definition."""
    return images.bits_over_mean(images.dct_low(np.einsum("ij,jk,lk->il", images._cubic(rgb.shape[0], 32), images.grey(rgb), images._cubic(rgb.shape[1], 32))))


def plain_counts(rgb):
    small = np.einsum("ij,jkc,lk->ilc", images._cubic(rgb.shape[0], 16), rgb.astype(float), images._cubic(rgb.shape[1], 16))
    level = np.clip(np.rint(np.round(small, 6)), 0, 255).astype(int) // 32
    return np.concatenate([np.bincount(level[..., c].ravel(), minlength=8) for c in range(3)])


@pytest.mark.parametrize("size", [(16, 16), (20, 30), (48, 27), (90, 160), (7, 200), (1, 1)])
def test_fused_kernels(size):
    rng = np.random.default_rng(size[0])
    smooth = np.cumsum(rng.integers(-3, 4, (*size, 3)), axis=1) + 128
    for rgb in (rng.integers(0, 256, (*size, 3)), np.clip(smooth, 0, 255)):
        rgb = rgb.astype(np.uint8)
        assert images.picture_hash(rgb) == plain_hash(rgb) and images.histogram(rgb).tolist() == plain_counts(rgb).tolist()
        assert np.allclose(images.resize(rgb.astype(float), 5, 9), np.einsum("ij,jkc,lk->ilc", images._cubic(size[0], 5), rgb.astype(float), images._cubic(size[1], 9)))


def bmp(rgb):
    """A 24-bit bitmap file: rows from the bottom, blue first, padded to four bytes."""
    h, w, _ = rgb.shape
    pad = -(w * 3) % 4
    body = b"".join(row[:, ::-1].tobytes() + b"\0" * pad for row in rgb[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def test_one_picture_in_all_forms(spark, tmp_path):
    rng = np.random.default_rng(2)
    rgb = np.clip(np.cumsum(rng.integers(-6, 7, (45, 70, 3)), axis=0) + 120, 0, 255).astype(np.uint8)
    (tmp_path / "a.bmp").write_bytes(bmp(rgb))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    alpha = np.full((45, 70, 1), 9, np.uint8)
    forms = {
        "rgb24": rgb.tobytes(), "bgr24": rgb[..., ::-1].tobytes(), "bgra": np.concatenate([rgb[..., ::-1], alpha], axis=2).tobytes(), "rgba": np.concatenate([rgb, alpha], axis=2).tobytes(),
        "padded": np.concatenate([rgb.reshape(45, 210), np.zeros((45, 14), np.uint8)], axis=1).tobytes(), None: rgb.tobytes(),
    }
    rows = [("v", i, 45, 70, "rgb24" if m == "padded" else m, d) for i, (m, d) in enumerate(forms.items())]
    read = tables.images(spark, str(tmp_path))
    assert {r.video_id[-10:]: r.error for r in read.collect()} == {f"{tmp_path}/a.bmp"[-10:]: None, "broken.png": "no picture"}
    want = (images.picture_hash(rgb), images.histogram(rgb).tolist())
    got = images.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect() + images.fingerprints(read.where("error is null")).collect()
    assert len(got) == 7 and {r.p & (2**64 - 1) for r in got} == {want[0]} and len({r.c for r in got}) == 1
    none = images.fingerprints(read.where("error is not null")).collect()
    assert len(none) == 1 and none[0].p is None and none[0].c is None
    counts = images.histograms(read).orderBy("channel", "level").collect()
    assert [r.n for r in counts] == want[1] and sum(r.share for r in counts) == pytest.approx(1)


def test_what_cannot_be_read(spark):
    rows = [("v", 0, 2, 2, "bgra", b"x" * 13), ("v", 1, 2, 2, "rgb24", b"x" * 11), ("v", 2, 2, 2, "yuv", b"x" * 99), ("v", 3, None, 2, "rgb24", b"x" * 12), ("v", 4, 0, 2, "rgb24", b""), ("v", 5, -1, 2, "rgb24", b"x" * 12), ("v", 6, 2, 2, "bgra", None), ("v", 7, 2, 2, "gray8", b"abcd")]
    got = {r.idx: r.p for r in images.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i, p in got.items() if p is not None] == [7] and len(got) == 8
    assert {r.idx for r in images.histograms(spark.createDataFrame(rows, SCHEMA)).collect()} == {7}


def test_pictures_with_nulls_have_no_coefficients(spark):
    rows = [(1, [1.0] * 64), (2, [1.0] * 63 + [None]), (3, [1.0] * 9), (4, None)]
    got = images.coefficients(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v").collect()
    assert len(got) == 64 and {r.id for r in got} == {1}
