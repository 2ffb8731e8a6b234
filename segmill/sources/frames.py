"""Raw frame files as a source that Spark can split: a task reads a range of frames, and nothing but its bytes."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .tables import split_frames

SPLIT_BYTES = 64 << 20  # of a task's range, about; at least one frame
BATCH_BYTES = 8 << 20  # of an Arrow batch; at least one frame
BYTES_PER_PIXEL = {"rgb24": 3, "bgr24": 3, "bgra": 4, "gray8": 1}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def file_system(path: str):
    """Arrow's file system for a path or URI (local files, hdfs, viewfs, s3, gs, abfs), and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def video_files(path: str) -> list[tuple[str, int]]:
    """Path and length of a file, or of all files below a folder; several paths are divided by commas.  Hidden files are left out."""
    from pyarrow import fs

    out = []
    for p in filter(None, path.split(",")):
        store, place = file_system(p)
        info = store.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        if info.type == fs.FileType.File:
            out.append((p, info.size))
            continue
        scheme = p[: p.index("://") + 3] if "://" in p else ""
        found = store.get_file_info(fs.FileSelector(place, recursive=True))
        out += [(scheme + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return out


@dataclass
class FrameRanges(InputPartition):
    """What a task reads: a range of a long file's frames, or whole short files, as (path, first, stop)."""

    parts: list[tuple[str, int, int]]


class RawFrameSource(DataSource):
    """``spark.read.format("rawframes")``: video_id (the file's path), frame_no, rgb of raw frame files; a broken last frame is dropped.

    Options: ``path`` (see :func:`video_files`), ``width``, ``height``, ``mode`` (rgb24 by default), ``splitBytes``, and ``push``: with ``true``, conditions
    on video_id and frame_no choose the files and ranges that are read at all, for which Spark wants ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return "video_id string, frame_no long, rgb binary"

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("push", "false") == "true" else FrameReader)(dict(self.options))


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.size = int(options["width"]) * int(options["height"]) * BYTES_PER_PIXEL[options.get("mode", "rgb24")]
        if self.size <= 0:
            raise ValueError("frames need a width and a height")
        self.path = options["path"]
        self.per_split = max(1, int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES))) // self.size)
        self.videos: set[str] | None = None
        self.first, self.stop = 0, None

    def partitions(self) -> list[FrameRanges]:
        out, room = [FrameRanges([])], self.per_split
        for path, length in video_files(self.path):
            if self.videos is not None and path not in self.videos:
                continue
            stop = length // self.size if self.stop is None else min(self.stop, length // self.size)
            for at in range(self.first, stop, self.per_split):
                part = (path, at, min(at + self.per_split, stop))
                if part[2] - at > room:
                    out.append(FrameRanges([]))
                    room = self.per_split
                out[-1].parts.append(part)
                room -= part[2] - at
        return out

    def read(self, partition: FrameRanges) -> Iterator[pa.RecordBatch]:
        per_batch = max(1, BATCH_BYTES // self.size)
        for path, first, stop in partition.parts:
            store, place = file_system(path)
            with store.open_input_file(place) as f:
                f.seek(first * self.size)
                frames = split_frames(f, self.size)
                for at in range(first, stop, per_batch):
                    batch = list(itertools.islice(frames, min(per_batch, stop - at)))  # fewer, or none, if the file became shorter
                    yield self._batch(path, at, batch)

    @staticmethod
    def _batch(path: str, first: int, frames: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(frames)), pa.array(range(first, first + len(frames)), pa.int64()), pa.array(frames, pa.binary())], ["video_id", "frame_no", "rgb"])


class PushingReader(FrameReader):
    """Takes over conditions on video_id and frame_no that compare with constants, and leaves all others to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = getattr(f, "attribute", None)
        if column == ("video_id",) and isinstance(f, EqualTo | In):
            names = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.videos = names if self.videos is None else self.videos & names
            return True
        if column != ("frame_no",):
            return False
        match f:
            case EqualTo(_, n):
                self._between(n, n + 1)
            case GreaterThan(_, n):
                self._between(n + 1, None)
            case GreaterThanOrEqual(_, n):
                self._between(n, None)
            case LessThan(_, n):
                self._between(0, n)
            case LessThanOrEqual(_, n):
                self._between(0, n + 1)
            case In(_, numbers) if numbers:
                self._between(min(numbers), max(numbers) + 1)
                return False  # Spark still picks the frames between
            case _:
                return False
        return True

    def _between(self, first: int, stop: int | None) -> None:
        self.first = max(self.first, first)
        if stop is not None:
            self.stop = stop if self.stop is None else min(self.stop, stop)


def frame_table(spark: SparkSession, path: str, width: int, height: int, mode: str = "rgb24", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames of raw files, with conditions pushed into the scan where the session allows that."""
    spark.dataSource.register(RawFrameSource)
    push = spark.conf.get(PUSHDOWN, "false")
    options = {"path": path, "width": width, "height": height, "mode": mode, "splitBytes": split_bytes, "push": push}
    return spark.read.format("rawframes").options(**options).load()


def write_frames(frames: DataFrame, folder: str, key: str = "video_id", order: str = "frame_no", data: str = "rgb") -> DataFrame:
    """Writes frames(key, order, data) as one raw file per key below ``folder``, in order; returns key, path, frames.  The result is lazy: each action writes.

    A file is written under a name of its own and moved to its place when it is whole, so a lost or repeated task leaves no
    broken file.  Frames of one key go through one task, a batch at a time.  Null keys and null frames are left out.
    """

    def run(batches):
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        key_now, sink, part, count = None, None, "", 0

        def close() -> pa.RecordBatch:
            sink.close()
            place = f"{root.rstrip('/')}/{key_now}.raw"
            store.move(part, place)
            return pa.RecordBatch.from_arrays([pa.array([str(key_now)]), pa.array([f"{folder.rstrip('/')}/{key_now}.raw"]), pa.array([count], pa.int64())], ["video_id", "path", "frames"])

        for b in batches:
            for k, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key_now:
                    if sink:
                        yield close()
                    key_now, count, part = k, 0, f"{root.rstrip('/')}/.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(part)
                sink.write(frame)
                count += 1
        if sink:
            yield close()

    ordered = frames.where(f"{key} is not null and {data} is not null").repartition(key).sortWithinPartitions(key, order).select(key, data)
    return ordered.mapInArrow(run, "video_id string, path string, frames long")
