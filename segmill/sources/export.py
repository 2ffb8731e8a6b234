"""Export of segments as files: a sink that goes on after a failed segment, tells its progress, and commits what it did."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .frames import file_system

EVERY_SECONDS = 1.0  # between two notes of a task's progress; the first and last one are always written
RESULT = pa.schema([("folder", pa.string()), ("name", pa.string()), ("dur", pa.float64()), ("bytes", pa.int64()), ("error", pa.string())])


@dataclass
class Exported(WriterCommitMessage):
    """What a task did."""

    done: int = 0
    failed: int = 0
    seconds: float = 0.0
    results: list[str] = field(default_factory=list)


class SegmentExport(DataSource):
    """``df.write.format("segments")``: a file ``folder/name`` with ``data`` below ``path`` for each row (folder, name, dur, data).

    To make files in another way (cut a clip, say), override :meth:`data_of` and ``name`` in a subclass and register that.
    A segment that fails (a null or a broken name, an error of ``data_of`` or of the store) leaves no file but a row with its error, and the others go on.

    A task writes its files below ``_staging``, then a row per segment to a file in ``_results``, and moves the files to their places last.  So a file is
    whole or absent, a repeated task does the same again, and a job that fails as a whole can remove all that its tasks moved, lost ones included.
    Tasks may still be at work when their job is given up: it puts an empty file in the place of its folder in ``_staging``, so that they can neither stage
    nor move anything more; where they meet it they remove what else they made and end.
    ``_progress`` has the tasks' notes while they run, ``_summary.json`` the totals of the commit messages.
    """

    @classmethod
    def name(cls) -> str:
        return "segments"

    def data_of(self, row: Row) -> bytes:
        return row["data"]

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self, self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, source: SegmentExport, path: str):
        self.source, self.path, self.job = source, path.rstrip("/"), uuid.uuid4().hex

    def _place(self):
        return file_system(self.path)

    def _export(self, store, stage: str, row: Row) -> int:
        folder, name = row["folder"], row["name"]
        if not folder or not name or ".." in f"{folder}/{name}".split("/") or "/" in name:
            raise ValueError(f"no place for {folder!r} / {name!r}")
        data = self.source.data_of(row)
        if data is None:
            raise ValueError("no data")
        store.create_dir(f"{stage}/{folder.strip('/')}", recursive=True)
        with store.open_output_stream(f"{stage}/{folder.strip('/')}/{name}") as f:
            f.write(bytes(data))
        return len(data)

    def write(self, iterator: Iterator[Row]) -> Exported:
        store, root = self._place()
        told, rows, noted = Exported(), [], 0.0
        attempt = uuid.uuid4().hex
        task, stage = f"{self.job}-{TaskContext.get().partitionId()}", f"{root}/_staging/{self.job}/{attempt}"
        for d in ("_progress", "_results", f"_staging/{self.job}/{attempt}"):
            store.create_dir(f"{root}/{d}", recursive=True)
        result = f"{root}/_results/{task}-{attempt}.parquet"
        own = [result, f"{root}/_progress/{task}.json"]
        self._go_on(store, root, stage, own)
        with pq.ParquetWriter(result, RESULT, filesystem=store) as out:
            for row in iterator:
                size, error = None, None
                try:
                    size = self._export(store, stage, row)
                    told.done += 1
                    told.seconds += row["dur"] or 0.0
                except Exception as e:  # noqa: BLE001  any failure belongs to its segment alone
                    error = f"{type(e).__name__}: {e}"
                    told.failed += 1
                rows.append((row["folder"], row["name"], row["dur"], size, error))
                if len(rows) == 10_000:
                    out.write_table(_table(rows))
                    rows = []
                if time.monotonic() - noted >= EVERY_SECONDS:
                    noted = time.monotonic()
                    self._go_on(store, root, stage, own)
                    self._note(store, root, task, told)
            out.write_table(_table(rows))
        self._go_on(store, root, stage, own)
        for place in _places(store, result):
            store.create_dir(os.path.dirname(f"{root}/{place}"), recursive=True)
            try:
                store.move(f"{stage}/{place}", f"{root}/{place}")
            except FileNotFoundError:  # two segments of one place
                pass
        self._note(store, root, task, told)
        self._go_on(store, root, stage, own, moved=result)
        told.results.append(os.path.basename(result))
        return told

    def _go_on(self, store, root: str, stage: str, own: list[str], moved: str | None = None) -> None:
        """Ends a task whose job has been aborted meanwhile, and removes what it made: the files ``own``, those staged, and those that ``moved`` tells of."""
        if store.get_file_info(f"{root}/_staging/{self.job}").is_file:
            if moved:
                try:
                    _remove(store, [f"{root}/{place}" for place in _places(store, moved)])
                except FileNotFoundError:  # the job has removed them
                    pass
            _remove(store, own)
            _remove_folder(store, stage)
            raise RuntimeError("the export was aborted")

    @staticmethod
    def _note(store, root: str, task: str, told: Exported) -> None:
        part = f"{root}/_progress/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(json.dumps({"done": told.done, "failed": told.failed}).encode())
        store.move(part, f"{root}/_progress/{task}.json")

    def commit(self, messages: list[Exported | None]) -> None:
        store, root = self._place()
        told = [m for m in messages if m]
        kept = {name for m in told for name in m.results}
        _remove(store, [f.path for f in self._own(store, root, "_results") if f.base_name not in kept])  # of attempts that were repeated
        self._clear(store, root)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_summary.json") as f:
            f.write(json.dumps({"tasks": sum(m.done + m.failed for m in told), "done": sum(m.done for m in told), "failed": sum(m.failed for m in told), "seconds": sum(m.seconds for m in told)}).encode())

    def abort(self, messages: list[Exported | None]) -> None:
        store, root = self._place()
        self._end_staging(store, root)
        for f in self._own(store, root, "_results"):
            try:
                for place in _places(store, f.path):
                    _remove(store, [f"{root}/{place}"])
            except pa.ArrowInvalid:  # of a task that had moved nothing yet
                pass
            _remove(store, [f.path])
        self._clear(store, root)

    def _end_staging(self, store, root: str) -> None:
        """Puts a file in the place of the job's staging folder."""
        stage = f"{root}/_staging/{self.job}"
        for turn in range(100):
            gone = f"{stage}-{turn}"
            try:
                store.move(stage, gone)
            except OSError:  # nothing staged, or a store without folders
                gone = stage
            _remove_folder(store, gone)
            try:
                store.create_dir(f"{root}/_staging", recursive=True)
                store.open_output_stream(stage).close()
                return
            except OSError:  # a task has just made the folder anew
                continue

    def _own(self, store, root: str, folder: str):
        return [f for f in _files(store, f"{root}/{folder}") if f.base_name.startswith(self.job)]

    def _clear(self, store, root: str) -> None:
        _remove(store, [f.path for f in self._own(store, root, "_progress")])
        _remove_folder(store, f"{root}/_staging/{self.job}")


def _places(store, result: str) -> Iterator[str]:
    """Places of the files that a result file tells of."""
    with store.open_input_file(result) as f:
        for batch in pq.ParquetFile(f).iter_batches(columns=["folder", "name", "bytes"]):
            yield from (f"{r['folder'].strip('/')}/{r['name']}" for r in batch.to_pylist() if r["bytes"] is not None)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RESULT)], schema=RESULT)


def _files(store, folder: str):
    from pyarrow import fs

    return store.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def _remove(store, places: list[str]) -> None:
    for place in places:
        try:
            store.delete_file(place)
        except (FileNotFoundError, OSError):
            pass


def _remove_folder(store, place: str) -> None:
    for _ in range(100):
        try:
            store.delete_dir(place)
        except FileNotFoundError:
            return
        except OSError:  # a task has just put a file into it, or it is none
            if store.get_file_info(place).is_file:
                return


def export_segments(segments: DataFrame, path: str, threads: int = 3, source: type[SegmentExport] = SegmentExport) -> dict:
    """Exports segments(folder, name, dur, and what ``source`` needs) with at most ``threads`` tasks at a time; returns tasks, done, failed and seconds.

    The stage before keeps its own tasks.  Of segments with one place the last one written stays.
    """
    spark = segments.sparkSession
    spark.dataSource.register(source)
    segments.repartition(max(1, threads)).write.format(source.name()).option("path", path).mode("append").save()
    store, root = file_system(path.rstrip("/"))
    with store.open_input_stream(f"{root}/_summary.json") as f:
        return json.loads(f.read())


def export_progress(path: str) -> dict:
    """Segments done and failed so far by the tasks that are at work below ``path``."""
    store, root = file_system(path.rstrip("/"))
    total = {"done": 0, "failed": 0}
    for info in _files(store, f"{root}/_progress"):
        if info.base_name.endswith(".json"):
            try:
                with store.open_input_stream(info.path) as f:
                    note = json.loads(f.read())
            except FileNotFoundError:  # just being replaced
                continue
            total = {k: total[k] + note[k] for k in total}
    return total


def export_results(spark: SparkSession, path: str) -> DataFrame:
    """folder, name, dur, bytes, error of each exported segment: error is null for those that have their file."""
    return spark.read.schema("folder string, name string, dur double, bytes long, error string").parquet(f"{path.rstrip('/')}/_results")
