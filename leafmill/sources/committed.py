"""A registered data source: a folder of JSON lines files that commits make visible.

``spark.read.format("committed_json")``, ``readStream`` and ``write`` after ``register(spark)``. Option
``path`` is any address that pyarrow can open; ``key`` names a column whose least and greatest value each
file's entry has, ``files_per_partition`` how many files a task reads.

Writing has two phases: a task writes a file under a name that no reader knows and reports it; the
driver then adds one commit, a numbered file that lists them, which is made under another name and moved. Names of
files begin with the write's own; once it has committed or failed, those of them that no commit lists are removed. Readers take the files of all
commits, and leave out those whose range of ``key`` no pushed filter can meet; rows are filtered in the task as
well. A stream's offset is the number of a commit, so every row is read once.

Columns may have the types that JSON has: strings, whole numbers, doubles, booleans, and arrays and structs of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    Row,
    StringType,
    StructType,
)

NAME = "committed_json"
BATCH = 1000
_ATOMS = (StringType, LongType, IntegerType, DoubleType, BooleanType)


def register(spark: SparkSession) -> None:
    """Let the session read and write ``committed_json``, and push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommittedJson)


def _fits(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _fits(kind.elementType)
    if isinstance(kind, StructType):
        return all(_fits(f.dataType) for f in kind)
    return isinstance(kind, _ATOMS)


class Folder:
    """The files of a folder: ``data/*.jsonl`` and ``commits/*.json``."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self._fs = fs

    def commits(self, after: int = 0, until: int | None = None) -> list[dict]:
        """Commits in order, each with number, schema and files."""
        found = self.files.get_file_info(self._fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())
        wanted = [n for n in names if after < int(n[:-5]) and (until is None or int(n[:-5]) <= until)]
        return [self._read(f"commits/{n}") for n in wanted]

    def data(self) -> list[str]:
        found = self.files.get_file_info(self._fs.FileSelector(f"{self.root}/data", allow_not_found=True))
        return [f"data/{f.base_name}" for f in found]

    def last(self) -> int:
        return max((c["number"] for c in self.commits()), default=0)

    def _read(self, name: str) -> dict:
        with self.files.open_input_stream(f"{self.root}/{name}") as file:
            return json.loads(file.read().decode())

    def lines(self, name: str) -> Iterator[dict]:
        with self.files.open_input_stream(f"{self.root}/{name}") as file:
            rest = b""
            while chunk := file.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                yield from map(json.loads, whole)
            if rest:
                yield json.loads(rest)

    def put(self, name: str, data: bytes) -> None:
        """Under another name first, so that it is there as a whole or not at all."""
        target, draft = f"{self.root}/{name}", f"{self.root}/{name}.{uuid.uuid4().hex}"
        self.files.create_dir(target.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(draft) as file:
            file.write(data)
        self.files.move(draft, target)

    def remove(self, name: str) -> None:
        if self.files.get_file_info(f"{self.root}/{name}").type != self._fs.FileType.NotFound:
            self.files.delete_file(f"{self.root}/{name}")


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    least: object
    greatest: object


def _may_meet(entry: dict, filters: list[Filter], key: str | None) -> bool:
    """Whether a file can have rows that all ``filters`` let through, by its range of ``key``."""
    low, high = entry["least"], entry["greatest"]
    for f in filters:
        if key is None or f.attribute != (key,):
            continue
        if low is None:
            if not (isinstance(f, EqualNullSafe) and f.value is None):
                return False  # only nulls, which no comparison lets through
        elif isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
            if not low <= f.value <= high:
                return False
        elif isinstance(f, In):
            if not any(v is not None and low <= v <= high for v in f.value):
                return False
        elif (isinstance(f, GreaterThan) and high <= f.value) or (isinstance(f, GreaterThanOrEqual) and high < f.value):
            return False
        elif (isinstance(f, LessThan) and low >= f.value) or (isinstance(f, LessThanOrEqual) and low > f.value):
            return False
    return True


def _passes(row: dict, f: Filter) -> bool:
    value = row.get(f.attribute[0])
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, GreaterThan):
        return value > f.value
    if isinstance(f, GreaterThanOrEqual):
        return value >= f.value
    return value < f.value if isinstance(f, LessThan) else value <= f.value


_PUSHED = EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual


class _Lines:
    """Rows of files as Arrow batches."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.filters: list[Filter] = []

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        arrow, folder, rows = to_arrow_schema(self.schema), Folder(self.path), []
        for name in partition.names:
            for row in folder.lines(name):
                if all(_passes(row, f) for f in self.filters):
                    rows.append(row)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


def _dealt(files: list[dict], each: int) -> list[Files]:
    names = [f["name"] for f in files]
    return [Files(tuple(names[i : i + each])) for i in range(0, len(names), each)]


class _Reader(_Lines, DataSourceReader):
    def __init__(self, path: str, schema: StructType, key: str | None, each: int):
        super().__init__(path, schema)
        self.key, self.each = key, each

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        atoms = {f.name for f in self.schema if isinstance(f.dataType, _ATOMS) and not isinstance(f.dataType, DoubleType)}
        for f in filters:
            if isinstance(f, _PUSHED) and len(f.attribute) == 1 and f.attribute[0] in atoms:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        files = [f for c in Folder(self.path).commits() for f in c["files"]]
        return _dealt([f for f in files if _may_meet(f, self.filters, self.key)], self.each) or [Files(())]


class _StreamReader(_Lines, DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, each: int):
        super().__init__(path, schema)
        self.each = each

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": Folder(self.path).last()}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt([f for c in Folder(self.path).commits(start["commit"], end["commit"]) for f in c["files"]], self.each)


class _Writing:
    """Files by tasks, and a commit that lists them."""

    def __init__(self, path: str, schema: StructType, key: str | None):
        bad = [f.name for f in schema if not _fits(f.dataType)]
        if bad:
            raise ValueError(f"JSON lines cannot hold the columns {bad}")
        self.path, self.schema, self.key, self.own = path, schema, key, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        folder, name = Folder(self.path), f"data/{self.own}-{uuid.uuid4().hex}.jsonl"
        folder.files.create_dir(f"{folder.root}/data", recursive=True)
        n, least, greatest = 0, None, None
        with folder.files.open_output_stream(f"{folder.root}/{name}") as file:
            for row in rows:
                told = row.asDict(recursive=True)
                file.write(json.dumps(told, ensure_ascii=False).encode() + b"\n")
                n += 1
                if self.key and (value := told[self.key]) is not None:
                    least = value if least is None else min(least, value)
                    greatest = value if greatest is None else max(greatest, value)
        return Written(name, n, least, greatest)

    def _commit(self, messages: list[Written | None], number: int, batch: int | None = None) -> None:
        files = [m.__dict__ for m in messages if m is not None and m.rows]
        told = {"number": number, "batch": batch, "schema": self.schema.jsonValue(), "files": files}
        Folder(self.path).put(f"commits/{number:010}.json", json.dumps(told).encode())
        self._tidy()

    def _tidy(self) -> None:
        """Remove this write's files that no commit lists: those of failed and repeated tasks, and empty ones."""
        folder = Folder(self.path)
        listed = {f["name"] for c in folder.commits() for f in c["files"]}
        for name in folder.data():
            if name.startswith(f"data/{self.own}-") and name not in listed:
                folder.remove(name)


class _Writer(_Writing, DataSourceWriter):
    def __init__(self, path: str, schema: StructType, key: str | None, overwrite: bool):
        super().__init__(path, schema, key)
        self.overwrite = overwrite

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        old = folder.commits() if self.overwrite else []
        self._commit(messages, folder.last() + 1)
        for c in old:
            folder.remove(f"commits/{c['number']:010}.json")
            for f in c["files"]:
                folder.remove(f["name"])

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy()


class _StreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        """One commit a batch; a batch that is written again after a failure is not added twice."""
        folder = Folder(self.path)
        if any(c["batch"] == batchId for c in folder.commits()):
            self._tidy()
        else:
            self._commit(messages, folder.last() + 1, batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._tidy()


class CommittedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        """The schema of the last commit."""
        commits = Folder(self.options["path"]).commits()
        if not commits:
            raise ValueError(f"{self.options['path']} has no commit yet: give a schema")
        return StructType.fromJson(commits[-1]["schema"])

    def _each(self) -> int:
        return int(self.options.get("files_per_partition", "4"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, self.options.get("key"), self._each())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], schema, self._each())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, self.options.get("key"), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options["path"], schema, self.options.get("key"))
