"""Arrow IPC files as a Spark data source, for exchange with other Arrow tools.

Read:  ``spark.read.format("arrow_ipc").schema(...).option("columns", "id,title").load(path)``
Write: ``df.write.format("arrow_ipc").mode("append").save(directory)`` (zstd, one file per task)

Tasks write under final, unique names. A job is made valid by one small manifest, written last and renamed into place, that names its
files and, when it overwrites, the manifests it replaces; readers take the files of the manifests in force. So a job that fails
or is killed leaves the table as it was, its files belong to no manifest, and nothing is moved one by one. Folders without manifests, as other
tools write them, are read whole; the first job that appends to one names their files in its manifest.

Parquet stays the better store for threads, as it can skip nested fields.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: Files above this size are cut into runs of record batches; smaller ones are one task each.
SPLIT_BYTES = 128 * 1024 * 1024
_MANIFEST = "_manifest-"
#: Names of files that tasks wrote, which count only if a manifest names them.
_OWN = re.compile(r"part-[0-9a-f]{32}-[0-9a-f]{32}\.arrow")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; ``file:/x`` as Spark writes it is accepted too."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:") :]
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _data_files(path: str) -> list[pafs.FileInfo]:
    fs, root = _open(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [info]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
    files = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    manifests = _manifests(path)
    valid = {name for m in manifests.values() for name in m["files"]}
    files = [f for f in files if (f.base_name in valid if manifests else not _OWN.fullmatch(f.base_name))]
    return sorted(files, key=lambda f: f.path)


def _manifests(path: str) -> dict[str, dict]:
    """The manifests in force by name, which are those that no other one replaces."""
    fs, root = _open(path)
    if fs.get_file_info(root).type != pafs.FileType.Directory:
        return {}
    found = {}
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=False)):
        if f.base_name.startswith(_MANIFEST) and f.base_name.endswith(".json"):
            with fs.open_input_stream(f.path) as source:
                found[f.base_name] = json.loads(source.read())
    replaced = {name for m in found.values() for name in m["replaces"]}
    return {name: m for name, m in found.items() if name not in replaced}


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type with 64-bit offsets and views replaced by the forms that Spark knows."""
    if pa.types.is_large_string(kind) or pa.types.is_string_view(kind):
        return pa.string()
    if pa.types.is_large_list(kind) or pa.types.is_list(kind):
        return pa.list_(_plain(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _plain(f.type), f.nullable) for f in kind])
    return kind


@dataclass
class _Run(InputPartition):
    """A run of record batches in one file; ``stop`` of None means to the end."""

    path: str
    start: int
    stop: int | None


class ArrowIpcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split_bytes: int):
        self.path, self.schema, self.split_bytes = path, schema, split_bytes

    def partitions(self) -> list[InputPartition]:
        fs, _ = _open(self.path)
        runs: list[InputPartition] = []
        for file in _data_files(self.path):
            if file.size <= self.split_bytes:
                runs.append(_Run(file.path, 0, None))
                continue
            with fs.open_input_file(file.path) as source:
                batches = ipc.open_file(source).num_record_batches
            per_run = max(1, batches * self.split_bytes // file.size)
            runs.extend(_Run(file.path, at, min(at + per_run, batches)) for at in range(0, batches, per_run))
        return runs

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        target = to_arrow_schema(self.schema)
        with fs.open_input_file(partition.path) as source:
            reader = ipc.open_file(source)
            fields = [reader.schema.get_field_index(name) for name in target.names]
            options = ipc.IpcReadOptions(included_fields=fields)
            reader = ipc.open_file(source, options=options)
            stop = reader.num_record_batches if partition.stop is None else partition.stop
            for at in range(partition.start, stop):
                table = pa.Table.from_batches([reader.get_batch(at)]).select(target.names).cast(target)
                yield from table.to_batches()


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class ArrowIpcWriter(DataSourceArrowWriter):
    """Tasks write files of their own; the job's manifest makes those of committed tasks valid, all at once."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.job = uuid.uuid4().hex
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        self.before = sorted(_manifests(path))
        self.old = [f.base_name for f in _data_files(path)] if overwrite or not self.before else []

    def _new_file(self) -> tuple[str, str]:
        _, root = _open(self.path)
        name = f"part-{self.job}-{uuid.uuid4().hex}.arrow"
        return name, f"{root}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _ = _open(self.path)
        name, place = self._new_file()
        target = to_arrow_schema(self.schema)
        with fs.open_output_stream(place) as sink:
            writer = ipc.new_file(sink, target, options=ipc.IpcWriteOptions(compression="zstd"))
            rows = 0
            for batch in iterator:
                writer.write_table(pa.Table.from_batches([batch]).cast(target))
                rows += batch.num_rows
            writer.close()
        if not rows:
            fs.delete_file(place)
        return _Written(name if rows else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        if not names:
            name, place = self._new_file()
            with fs.open_output_stream(place) as sink:
                ipc.new_file(sink, to_arrow_schema(self.schema)).close()
            names = [name]
        kept = [] if self.overwrite else self.old
        manifest = {"files": kept + names, "replaces": self.before if self.overwrite else []}
        written, place = f"{root}/.{self.job}.json", f"{root}/{_MANIFEST}{self.job}.json"
        with fs.open_output_stream(written) as sink:
            sink.write(json.dumps(manifest).encode())
        fs.move(written, place)  # from here on the job counts
        if self.overwrite:
            self._clear(self.old)

    def _clear(self, names: list[str]) -> None:
        """Delete files that no manifest in force names; one that stays behind does no harm."""
        fs, root = _open(self.path)
        for name in names:
            try:
                fs.delete_file(f"{root}/{name}")
            except OSError:
                continue

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
        self._clear([f.base_name for f in found if self.job in f.base_name])


class ArrowIpcDataSource(DataSource):
    """Options: ``path``; ``columns``, a comma-separated list to read; ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> T.StructType:
        files = _data_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no Arrow IPC files in {self.options['path']}")
        fs, _ = _open(self.options["path"])
        with fs.open_input_file(files[0].path) as source:
            found = ipc.open_file(source).schema
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        fields = [found.field(c) for c in wanted] if wanted else list(found)
        return from_arrow_schema(pa.schema([pa.field(f.name, _plain(f.type)) for f in fields]))

    def reader(self, schema: T.StructType) -> ArrowIpcReader:
        return ArrowIpcReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrowIpcWriter:
        return ArrowIpcWriter(self.options["path"], schema, overwrite)


def register_arrow_ipc(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ArrowIpcDataSource)
