"""The seam for a scoring model: tensors, windows, output shapes.  The caller brings the model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import WINDOW_FRAMES, decode_cuts

HEIGHT, WIDTH = 27, 48
FRAME_BYTES = HEIGHT * WIDTH * 3


def tensor(frames: list[bytes], size: int = WINDOW_FRAMES) -> np.ndarray:
    """[1, size, HEIGHT, WIDTH, 3] in 0..1; the last frame is repeated to fill the window."""
    return tensors([frames], size)


def frame_scores(output: np.ndarray, n: int) -> np.ndarray:
    """First score of each of ``n`` frames from an output of shape [1, n, k], [1, n], [n, k] or flat."""
    a = np.asarray(output)
    if a.ndim == 3:
        a = a[0, :, 0]
    elif a.ndim == 2:
        a = a[0] if a.shape[0] == 1 else a[:, 0]
    return a.ravel()[:n].astype(np.float32)


def tensors(windows: list[list[bytes]], size: int = WINDOW_FRAMES) -> np.ndarray:
    """[windows, size, HEIGHT, WIDTH, 3] in 0..1; each window's last frame is repeated to fill it."""
    stack = np.empty((len(windows), size, FRAME_BYTES), np.uint8)
    for out, frames in zip(stack, windows, strict=True):
        out[: len(frames)] = np.frombuffer(b"".join(frames), np.uint8).reshape(-1, FRAME_BYTES)
        out[len(frames) :] = out[len(frames) - 1]
    return stack.reshape(len(windows), size, HEIGHT, WIDTH, 3).astype(np.float32) / 255


def window_scores(output: np.ndarray, windows: int) -> np.ndarray:
    """First score of each frame, as [windows, size], from an output of shape [windows, size, k], [windows, size], [windows * size, k] or flat."""
    a = np.asarray(output)
    if a.ndim == 3:
        a = a[..., 0]
    elif a.ndim == 2 and a.shape[0] != windows:
        a = a[:, 0]
    return a.reshape(windows, -1).astype(np.float32)


def _shown(frames: list[bytes | None]) -> list[bytes]:
    """A window's frames with those that cannot be read replaced by the one before, the first ones by the first that can be read."""
    out, last = [], next(f for f in frames if f is not None)
    for f in frames:
        last = last if f is None else f
        out.append(last)
    return out


def score_frames(frames: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], windows_per_call: int = 8) -> DataFrame:
    """video_id, frame_no, score of frames(video_id, frame_no, rgb); the model gets up to ``windows_per_call`` windows at once, and opens once per task.

    Rows come sorted and are streamed: a task holds the frames of the windows of one call.  A window is the frames of one hundred frame numbers.  A frame that is null
    or of another size has a null score; the model sees the frame before it in its window instead (at the beginning the first that can be
    read), and windows without any are not shown to it.  Of rows with one frame number the least picture by bytes is shown, and each row gets its
    score.  Rows without a frame number give none.
    """

    def run(batches):
        model = None
        ready: list[tuple] = []  # (video, {frame number: [rows, least picture]})
        now, held = None, {}

        def scored() -> pa.RecordBatch:
            nonlocal model
            shown = [[f for _, f in w.values()] for _, w in ready]
            run_on = [i for i, w in enumerate(shown) if any(f is not None for f in w)]
            scores: dict[int, np.ndarray] = {}
            if run_on:
                model = model or make_model()
                out = window_scores(model(tensors([_shown(shown[i]) for i in run_on])), len(run_on))
                scores = dict(zip(run_on, out, strict=True))
            videos, numbers, values = [], [], []
            for i, (video, w) in enumerate(ready):
                for slot, (number, (rows, frame)) in enumerate(w.items()):
                    videos += [video] * rows
                    numbers += [number] * rows
                    values += [None if frame is None else float(scores[i][slot])] * rows
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(videos, pa.string()), pa.array(numbers, pa.int64()), pa.array(values, pa.float32())], ["video_id", "frame_no", "score"])

        for b in batches:
            for video, window, number, frame in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (video, window) != now:
                    if held:
                        ready.append((now[0], held))
                    now, held = (video, window), {}
                    if len(ready) == windows_per_call:
                        yield scored()
                frame = frame if frame is not None and len(frame) == FRAME_BYTES else None
                rows, least = held.get(number, (0, None))
                held[number] = (rows + 1, frame if least is None else least if frame is None else min(least, frame))
        if held:
            ready.append((now[0], held))
            yield scored()

    numbered = frames.select(F.col("video_id").cast("string"), F.col("frame_no").cast("long"), "rgb").where("frame_no is not null")
    windowed = numbered.select("video_id", F.floor(F.col("frame_no") / WINDOW_FRAMES).alias("window"), "frame_no", "rgb")
    sorted_rows = windowed.repartition("video_id", "window").sortWithinPartitions("video_id", "window", "frame_no")
    return sorted_rows.mapInArrow(run, "video_id string, frame_no long, score float")


def detect(frames: DataFrame, make_model: Callable, threshold: float = 0.5, fps: float = 25.0) -> DataFrame:
    """Cuts of raw frames: score, decode, space."""
    return decode_cuts(score_frames(frames, make_model), threshold, fps)


def model_info(path: str) -> dict:
    """Path, first input's name and dimensions, and output names of a model file."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path)
    first = session.get_inputs()[0]
    return {"path": path, "input": first.name, "dims": [d if isinstance(d, int) else -1 for d in first.shape], "outputs": [o.name for o in session.get_outputs()]}


def windows_of(frames: Iterator[bytes], size: int = WINDOW_FRAMES) -> Iterator[list[bytes]]:
    """Windows of a frame stream, the last one short."""
    window: list[bytes] = []
    for f in frames:
        window.append(f)
        if len(window) == size:
            yield window
            window = []
    if window:
        yield window
