"""Landing folders of document files, as a Spark data source ``landing``.

Spark reads a file a row (``binaryFile``) but cannot write one, and a file stream may see half
a load. This source does both: ``write`` makes one file of each row ``(name, content)``, and a
load is published by one small manifest when all its tasks are done; ``read`` and ``readStream``
serve published loads only. Each task lists what it wrote in a file of its own, so neither
writing nor reading sends names through the driver: a partition is one such list.

    <folder>/<name>                       the documents; other readers see plain files
    <folder>/_loads/<load>/<task>.jsonl   name, length and time of what a task wrote
    <folder>/_loads/<number>.json         a published load: its lists, files and bytes

The options on name, length and time are applied to the lists, before a document is opened.
(They are options, not pushed filters: Spark 4.1 keeps what was pushed to a Python source with the
relation, so two differently filtered uses of one DataFrame would share their filters.) Folders
may be anywhere pyarrow reaches. One writer publishes to a folder at a time.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from caseflow.sources.tables import spread

LOADS = "_loads"
COLUMNS = "name string, path string, modificationTime timestamp, length bigint"
BATCH_BYTES = 16 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _read(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as f:
        return f.read()


def _write(files: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes beside the target, then moves: readers see the whole file or none, and a retried task replaces its own."""
    folder, _, name = path.rpartition("/")
    files.create_dir(folder, recursive=True)
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as f:
        f.write(data)
    files.move(beside, path)


def _names(files: fs.FileSystem, folder: str) -> list[str]:
    return [i.base_name for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File]


def published(path: str) -> list[tuple[int, dict]]:
    """The published loads of a folder, in order: (number, manifest)."""
    files, root = store(path)
    numbers = sorted(int(n[:-5]) for n in _names(files, f"{root}/{LOADS}") if n.endswith(".json") and n[:-5].isdigit())
    return [(k, json.loads(_read(files, f"{root}/{LOADS}/{k:012d}.json"))) for k in numbers]


@dataclass
class Part(D.InputPartition):
    """One task's list of documents."""

    list: str


@dataclass
class Written(D.WriterCommitMessage):
    list: str
    files: int
    bytes: int


class LandingWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.load = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.path)
        rows, total = [], 0
        for b in iterator:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                if not name or any(p in ("", "..") or p[0] in "._" for p in name.split("/")):
                    raise ValueError(f"not a name of a document below the folder: {name!r}")
                data = content.encode() if isinstance(content, str) else content or b""
                _write(files, f"{root}/{name}", data)
                rows.append({"name": name, "length": len(data), "time": files.get_file_info(f"{root}/{name}").mtime_ns})
                total += len(data)
        task = f"{TaskContext.get().partitionId()}-{TaskContext.get().attemptNumber()}"
        if rows:
            _write(files, f"{root}/{LOADS}/{self.load}/{task}.jsonl", "".join(json.dumps(r) + "\n" for r in rows).encode())
        return Written(f"{self.load}/{task}.jsonl", len(rows), total)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        done = [m for m in messages if m and m.files]
        number = max((k for k, _ in published(self.path)), default=0) + 1
        load = {"lists": sorted(m.list for m in done), "files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}
        _write(files, f"{root}/{LOADS}/{number:012d}.json", json.dumps(load).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Takes back the documents of tasks that had finished; a list is never published without its load."""
        files, root = store(self.path)
        for m in messages:
            if m and m.files:
                for line in _read(files, f"{root}/{LOADS}/{m.list}").splitlines():
                    files.delete_file(f"{root}/{json.loads(line)['name']}")


class Documents:
    """Reads lists of documents: what batches and streams share."""

    def __init__(self, path: str, options: dict[str, str]):
        self.path, self.glob = path, options.get("glob", "*")
        self.content = options.get("content", "true") == "true"
        self.least, self.most = int(options.get("minlength", 0)), int(options.get("maxlength", 1 << 62))
        self.after, self.before = (dt.datetime.fromisoformat(options[o]).replace(tzinfo=dt.UTC) if o in options else None for o in ("after", "before"))

    def lists(self, after: int = 0, upto: int | None = None) -> list[Part]:
        return [Part(x) for k, load in published(self.path) if after < k and (upto is None or k <= upto) for x in load["lists"]]

    def wanted(self, row: dict) -> bool:
        """The tests that need no document: its name, length and time as listed."""
        at = row["modificationTime"]
        return (fnmatch.fnmatch(row["name"], self.glob) and self.least <= row["length"] <= self.most
                and (self.after is None or at > self.after) and (self.before is None or at < self.before))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        files, root = store(self.path)
        scheme = "" if "://" in self.path else "file:"
        rows, size = [], 0
        for line in _read(files, f"{root}/{LOADS}/{part.list}").splitlines():
            row = json.loads(line)
            row["modificationTime"] = dt.datetime.fromtimestamp(row["time"] // 1000 / 1e6, dt.UTC)
            if not self.wanted(row):
                continue
            info = files.get_file_info(f"{root}/{row['name']}")
            if info.type != fs.FileType.File or info.mtime_ns != row["time"]:
                continue  # gone, or a later load has replaced it and lists it itself
            row["path"] = f"{scheme}{root}/{row['name']}" if scheme else f"{self.path.rstrip('/')}/{row['name']}"
            if self.content:
                row["content"] = _read(files, f"{root}/{row['name']}")
                size += len(row["content"])
            rows.append(row)
            if size >= BATCH_BYTES or len(rows) == 4096:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = [("name", pa.string()), ("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())]
        kinds += [("content", pa.binary())] * self.content
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds], [c for c, _ in kinds])


class LandingReader(Documents, D.DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.lists()


class LandingStream(Documents, D.DataSourceStreamReader):
    """Offsets are numbers of published loads, so a load is read once and whole."""

    def initialOffset(self) -> dict:
        return {"load": 0}

    def latestOffset(self, *_) -> dict:
        return {"load": max((k for k, _ in published(self.path)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.lists(start["load"], end["load"])

    def commit(self, end: dict) -> None:
        """Loads stay; the checkpoint remembers how far the stream has read."""


class Landing(D.DataSource):
    """Options: ``path``; ``glob`` (of names); ``content`` (``false``: names, lengths and times only); ``minLength``,
    ``maxLength``; ``after``, ``before`` (UTC times in ISO form)."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return COLUMNS + (", content binary" if self.options.get("content", "true") == "true" else "")

    def reader(self, schema) -> LandingReader:
        return LandingReader(self.options["path"], self.options)

    def streamReader(self, schema) -> LandingStream:
        return LandingStream(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> LandingWriter:
        return LandingWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Landing)


def land(docs: DataFrame, folder: str, name: str = "name", content: str = "content") -> str:
    """One file below ``folder`` for each row, published as one load; a name that is there already is replaced."""
    register(docs.sparkSession)
    spread(docs.selectExpr(f"`{name}` AS name", f"CAST(`{content}` AS BINARY) AS content")).write.format("landing").mode("append").save(folder)
    return folder


def documents(spark: SparkSession, folder: str, glob: str = "*", content: bool = True, **options) -> DataFrame:
    """The documents of all published loads; ``options`` as of :class:`Landing`."""
    register(spark)
    return spark.read.format("landing").options(glob=glob, content=str(content).lower(), **options).load(folder)


def arriving(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The documents as a stream: each published load once."""
    register(spark)
    return spark.readStream.format("landing").option("glob", glob).load(folder)
