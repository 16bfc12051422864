"""The dataset store as a Spark data source: ``spark.read.format("vellum")`` and ``spark.readStream.format("vellum")``.

    register(spark)
    spark.read.format("vellum").option("root", root).option("dataset", "d").load()

Options: ``root`` (the store's folder), ``dataset``, and for reads ``upload`` (one upload only). The columns are those of
the store's log plus ``upload``; only logged uploads are read, so an upload that failed before its log is never seen.
A partition is a file of an upload. Filters that compare ``upload`` with a value are taken over and leave out whole
uploads before a file is opened. A stream's offset is the number of the last upload in the log: a restart goes
on after it, and a micro-batch holds whole uploads.

Files and logs are opened through Arrow's file systems by their URI, in tasks and where Spark plans the read, so the
store can stand wherever Arrow reaches it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset as pds
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual)
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.session import ship_code

# Spark types of the log's type names.
LOGGED_TYPES = {"BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType()}


def _at(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class _Log:
    """The uploads of one dataset in the schema log: (number, upload, columns)."""

    def __init__(self, root: str, dataset: str):
        self.root, self.dataset = root.rstrip("/"), dataset
        fs, path = _at(f"{self.root}/schemas")
        rows = []
        if fs.get_file_info(path).type == pfs.FileType.Directory:
            names = ["seq", "upload", "ordinal", "column_name", "type"]
            rows = pds.dataset(path, filesystem=fs, format="parquet").to_table(columns=names, filter=pds.field("dataset_id") == dataset).to_pylist()
        self.uploads = sorted({(r["seq"], r["upload"]) for r in rows})
        # the latest type of every column that any upload has, in order of appearance
        columns = {}
        for r in sorted(rows, key=lambda r: (r["seq"], r["ordinal"])):
            columns[r["column_name"]] = r["type"]
        self.columns = columns

    def schema(self) -> T.StructType:
        return T.StructType([*[T.StructField(c, LOGGED_TYPES.get(t, T.StringType())) for c, t in self.columns.items()], T.StructField("upload", T.StringType())])

    def files(self, upload: str) -> list[str]:
        fs, path = _at(f"{self.root}/data/dataset_id={self.dataset}/upload={upload}")
        found = fs.get_file_info(pfs.FileSelector(path, recursive=True))
        return sorted(f.path for f in found if f.type == pfs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class UploadFile(InputPartition):
    def __init__(self, upload: str, path: str):
        super().__init__(path)
        self.upload, self.path = upload, path


def _rows(root: str, part: UploadFile, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """A file's rows under the source's columns; those that the upload lacks are null."""
    fs, _ = _at(root)
    wanted = to_arrow_schema(schema)
    with fs.open_input_file(part.path) as f:
        file = pq.ParquetFile(f)
        names = [n for n in wanted.names if n in file.schema_arrow.names]
        for batch in file.iter_batches(columns=names):
            columns = [pa.array([part.upload] * batch.num_rows, type=pa.string()) if field.name == "upload"
                       else batch.column(field.name).cast(field.type) if field.name in names else pa.nulls(batch.num_rows, field.type) for field in wanted]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)


class UploadReader(DataSourceReader):
    def __init__(self, root: str, dataset: str, schema: T.StructType, upload: str | None):
        self.root, self.dataset, self.schema, self.tests = root, dataset, schema, []
        if upload is not None:
            self.tests.append(("=", upload))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over what compares ``upload``; the rest is Spark's."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in signs and f.attribute == ("upload",):
                self.tests.append((signs[type(f)], list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _wanted(self, upload: str) -> bool:
        def passes(sign: str, value) -> bool:
            return {"=": lambda: upload == value, ">": lambda: upload > value, ">=": lambda: upload >= value, "<": lambda: upload < value,
                    "<=": lambda: upload <= value, "in": lambda: upload in value}[sign]()
        return all(passes(s, v) for s, v in self.tests)

    def partitions(self) -> list[InputPartition]:
        log = _Log(self.root, self.dataset)
        return [UploadFile(u, f) for _, u in log.uploads if self._wanted(u) for f in log.files(u)]

    def read(self, partition: UploadFile) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.root, partition, self.schema)


class UploadStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, dataset: str, schema: T.StructType):
        self.root, self.dataset, self.schema = root, dataset, schema

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def latestOffset(self) -> dict:
        return {"seq": max((n for n, _ in _Log(self.root, self.dataset).uploads), default=0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = _Log(self.root, self.dataset)
        return [UploadFile(u, f) for n, u in log.uploads if start["seq"] < n <= end["seq"] for f in log.files(u)]

    def read(self, partition: UploadFile) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.root, partition, self.schema)

    def commit(self, end: dict) -> None:
        pass


class DatasetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellum"

    def _of(self) -> tuple[str, str]:
        return self.options["root"], self.options["dataset"]

    def schema(self) -> T.StructType:
        log = _Log(*self._of())
        if not log.uploads:
            raise ValueError(f"dataset {self.options['dataset']!r} has no logged upload")
        return log.schema()

    def reader(self, schema: T.StructType) -> UploadReader:
        return UploadReader(*self._of(), schema, self.options.get("upload"))

    def streamReader(self, schema: T.StructType) -> UploadStreamReader:
        return UploadStreamReader(*self._of(), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; filters on ``upload`` reach the reader."""
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DatasetSource)
