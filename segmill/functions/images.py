"""Pixel functions in numpy, and fingerprints of frame tables in Arrow batches."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GREY = np.array([0.299, 0.587, 0.114])  # fixed weights of red, green, blue
#: Modes: bytes per pixel, and which of them are red, green and blue.
MODES = {"rgb24": (3, (0, 1, 2)), "bgr24": (3, (2, 1, 0)), "bgra": (4, (2, 1, 0)), "rgba": (4, (0, 1, 2)), "gray8": (1, (0, 0, 0))}
CHUNK_BYTES = 16 << 20  # of the frames that are worked on at once, as doubles


def readable(data: bytes | None, height: int | None, width: int | None, mode: str | None) -> bool:
    """Whether a buffer holds all pixels of its mode; a null mode is rgb24, unknown modes cannot be read."""
    mode = mode or "rgb24"
    return data is not None and bool(height) and bool(width) and height > 0 and width > 0 and mode in MODES and len(data) >= height * width * MODES[mode][0]


def raw_pixels(data: bytes, height: int, width: int, mode: str = "rgb24") -> np.ndarray:
    """Bytes as [height, width, channels], in the order of the mode.  Rows may be padded."""
    channels = MODES[mode][0]
    stride = len(data) // height
    return np.frombuffer(data, np.uint8)[: stride * height].reshape(height, stride)[:, : width * channels].reshape(height, width, channels)


def pixels(data: bytes, height: int, width: int, mode: str = "rgb24") -> np.ndarray:
    """Bytes as [height, width, 3] in red, green, blue; a fourth channel is dropped."""
    return raw_pixels(data, height, width, mode)[..., list(MODES[mode][1])]


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb @ GREY / 255


@functools.lru_cache(256)
def _cubic(n_in: int, n_out: int) -> np.ndarray:
    """Weights of a bicubic resize (a = -0.5, pixel centres, edges repeated; wider kernel when shrinking)."""
    scale = max(1.0, n_in / n_out)
    out = np.zeros((n_out, n_in))
    for i in range(n_out):
        centre = (i + 0.5) * n_in / n_out - 0.5
        at = np.arange(int(np.floor(centre - 2 * scale)), int(np.ceil(centre + 2 * scale)) + 1)
        d = np.abs(at - centre) / scale
        w = np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
        np.add.at(out[i], np.clip(at, 0, n_in - 1), w)
        out[i] /= out[i].sum()
    out.setflags(write=False)
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A picture [height, width] or [height, width, channels] at another size."""
    rows, cols = _cubic(image.shape[0], height), _cubic(image.shape[1], width)
    tall = np.tensordot(rows, image, 1)
    return tall @ cols.T if image.ndim == 2 else np.moveaxis(np.moveaxis(tall, 1, -1) @ cols.T, -1, 1)


def dct_basis(n: int, low: int) -> np.ndarray:
    """The first ``low`` rows of the orthonormal DCT-II of ``n`` points."""
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    return np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos((2 * x + 1) * k * np.pi / (2 * n))


def dct_low(image: np.ndarray, low: int = 8) -> np.ndarray:
    return dct_basis(image.shape[0], low) @ image @ dct_basis(image.shape[1], low).T


def bits_over_mean(values: np.ndarray) -> int:
    """Unsigned integer with bit ``i`` set iff value ``i`` exceeds the mean of all, the constant term included."""
    flat = values.ravel()
    return int(sum(1 << i for i in np.flatnonzero(flat > flat.mean()).tolist()))


@functools.lru_cache(64)
def _kernels(height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pictures of one size: the rows of the 32 x 32 resize and its low frequencies in one matrix, over those of the 16 x 16 resize; the columns of either."""
    rows = np.concatenate([dct_basis(32, 8) @ _cubic(height, 32), _cubic(height, 16)])
    return rows, (dct_basis(32, 8) @ _cubic(width, 32)).T, _cubic(width, 16).T


def analyse(stack: np.ndarray, order: tuple[int, int, int] = (0, 1, 2)) -> tuple[np.ndarray, np.ndarray]:
    """Low 8 x 8 frequencies of the grey 32 x 32 pictures, and counts of 8 levels of red, green and blue of the 16 x 16 ones, of frames [n, height, width, channels].

    A channel's value is rounded to a millionth before it is rounded to a whole level, so that the order of additions does not decide halves.
    """
    n, height, width, channels = stack.shape
    rows, low, small = _kernels(height, width)
    weights = np.bincount(order, GREY, channels)
    tall = (rows @ stack.reshape(n, height, width * channels).astype(np.float64)).reshape(n, 24, width, channels)
    coef = (tall[:, :8] @ weights) / 255 @ low
    rgb = np.moveaxis(tall[:, 8:], -1, 1)[:, list(order)] @ small
    level = np.clip(np.rint(np.round(rgb, 6)), 0, 255).astype(np.int64).reshape(n, 3, 256) // 32
    cells = level + 8 * np.arange(3)[:, None] + 24 * np.arange(n)[:, None, None]
    return coef, np.bincount(cells.ravel(), minlength=24 * n).reshape(n, 24)


def picture_hash(rgb: np.ndarray) -> int:
    """64 bits over the low 8 x 8 frequencies of the grey picture at 32 x 32."""
    return bits_over_mean(analyse(rgb[None])[0][0])


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of 8 levels of red, then green, then blue, of the picture at 16 x 16."""
    return analyse(rgb[None])[1][0]


def normalised_histogram(rgb: np.ndarray) -> np.ndarray:
    counts = histogram(rgb)
    return counts / counts.sum()


def colour_hash(rgb: np.ndarray) -> int:
    """24 bits: levels that hold over an eighth of their channel."""
    return int(sum(1 << i for i in np.flatnonzero(histogram(rgb) > 32).tolist()))


def _analysed(b: pa.RecordBatch):
    """Places in a batch of the frames that can be read, their frequencies and their counts, by size and mode and a bounded number at a time."""
    kinds: dict[tuple, list[int]] = {}
    data, *shape = (b.column(k).to_pylist() for k in ("data", "height", "width", "mode"))
    for i, (d, h, w, mode) in enumerate(zip(data, *shape, strict=True)):
        if readable(d, h, w, mode):
            kinds.setdefault((h, w, mode or "rgb24"), []).append(i)
    for (h, w, mode), places in kinds.items():
        channels, order = MODES[mode]
        step = max(1, CHUNK_BYTES // (8 * h * w * channels))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            yield part, *analyse(np.stack([raw_pixels(data[i], h, w, mode) for i in part]), order)


_BITS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).view(np.int64)


def _fingerprints(batches):
    for b in batches:
        p, c, known = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, bool)
        for places, coef, counts in _analysed(b):
            flat = coef.reshape(-1, 64)
            p[places] = (flat > flat.mean(axis=1, keepdims=True)) @ _BITS
            c[places] = (counts > 32) @ _BITS[:24]
            known[places] = True
        yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("idx"), pa.array(p, mask=~known), pa.array(c, mask=~known)], ["video_id", "idx", "p", "c"])


def fingerprints(frames: DataFrame) -> DataFrame:
    """video_id, idx, p, c of frames(video_id, idx, height, width, mode, data); a frame that cannot be read (:func:`readable`) has null hashes.

    No shuffle: pixels stay where they are read and leave as sixteen bytes a frame.
    """
    cols = [F.col("video_id").cast("string"), F.col("idx").cast("long"), *(F.col(c) for c in ("height", "width", "mode", "data"))]
    return frames.select(*cols).mapInArrow(_fingerprints, "video_id string, idx long, p long, c long")


def histograms(frames: DataFrame) -> DataFrame:
    """video_id, idx, channel (0 red, 1 green, 2 blue), level, n, share of frames that can be read: 24 rows a frame, shares of all three channels add up to 1."""

    def run(batches):
        for b in batches:
            for places, _, counts in _analysed(b):
                each, at = pa.array(np.repeat(places, 24)), np.tile(np.arange(24), len(places))
                n = counts.ravel()
                cols = [b.column("video_id").take(each), b.column("idx").take(each), pa.array(at // 8), pa.array(at % 8), pa.array(n), pa.array(n / 768)]
                yield pa.RecordBatch.from_arrays(cols, ["video_id", "idx", "channel", "level", "n", "share"])

    cols = [F.col("video_id").cast("string"), F.col("idx").cast("long"), *(F.col(c) for c in ("height", "width", "mode", "data"))]
    return frames.select(*cols).mapInArrow(run, "video_id string, idx long, channel long, level long, n long, share double")


def coefficients(rows: DataFrame, id_col: str, values_col: str, side: int = 8, low: int = 8) -> DataFrame:
    """id, u, v, coef: the low frequencies of square pictures given as arrays of side * side values.  Shorter arrays and those with a null have no picture and give no rows."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            values = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, side, side) if b.num_rows else np.zeros((0, side, side))
            coef = dct_basis(side, low) @ values @ dct_basis(side, low).T
            at = np.tile(np.arange(low * low), len(values))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(b.column(0).to_pylist(), object), low * low), b.schema.field(0).type), pa.array(at // low), pa.array(at % low), pa.array(coef.ravel())], [id_col, "u", "v", "coef"])

    cells = rows.select(id_col, F.slice(values_col, 1, side * side).alias("cells")).where((F.size("cells") == side * side) & ~F.exists("cells", lambda x: x.isNull()))
    return cells.mapInArrow(run, f"{id_col} {kind}, u long, v long, coef double")
