"""CSV ingest into versioned Parquet datasets.

Store layout under one root folder (shared storage)::

    {root}/data/dataset_id={id}/upload={YYYYMMDD_HHMMSS[_n]}/part-*.parquet
    {root}/schemas/   one row per (dataset, upload, column) -- the schema log
    {root}/uploads/   one report row per upload attempt
    {root}/files/     the files that a version (a set of files taken together) consists of

One upload = one folder of Parquet parts ("one file = one upload" of the
reference becomes "one partition = one upload").  An upload source is any
path Spark reads as CSV -- a single file or a folder of part files -- and its
name is what the extension gate looks at.

An upload is committed by its rows in the schema log, written after the data:
readers only see logged uploads, so a failure in between leaves nothing behind
that anyone reads.  Uploads of a dataset are numbered in the log; the number,
not the stamp's text, says which is the latest.

A CSV source is read twice: once as text for one aggregate over all columns (row
count, cells per candidate type, malformed rows), once to store it under the
chosen types.  Types look at every row, so they never depend on a prefix.
"""

from __future__ import annotations

import datetime as _dt
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import scalar as S
from vellum.operators import schema as C
from vellum.session import saved

# Cell patterns of the types a column may get, next to what try_cast accepts.
SHORT_INTEGER_CELL = r"^\s*[+-]?[0-9]{1,18}\s*$"
INTEGER_CELL = r"^\s*[+-]?[0-9]+\s*$"
DOUBLE_CELL = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Infinity)\s*$"
BOOLEAN_CELL = r"(?i)^(true|false)$"
DATE_CELL = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
STAMP_CELL = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"
TIME_CELL = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$"
# Column that holds the text of a row with too many or too few cells.
MALFORMED = "_malformed_row"
# Uploads of a batch that are read or written at the same time.
PARALLEL = 4
# Size limits per file and per dataset (bytes).
MAX_FILE_BYTES = 1 << 30
MAX_DATASET_BYTES = 10 << 30

REPORT_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("version", T.StringType()),
    T.StructField("accepted", T.BooleanType()), T.StructField("upload", T.StringType()),
    T.StructField("row_count", T.LongType()), T.StructField("n_columns", T.IntegerType()),
    T.StructField("is_first_upload", T.BooleanType()),
    T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("warnings", T.ArrayType(T.StringType())),
])

FILE_LOG = T.StructType([
    T.StructField("dataset_id", T.StringType()), T.StructField("version", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType()),
])

SCHEMA_LOG = T.StructType([
    T.StructField("ordinal", T.IntegerType()), T.StructField("column_name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("nullable", T.BooleanType()), T.StructField("dataset_id", T.StringType()), T.StructField("upload", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("source", T.StringType()), T.StructField("row_count", T.LongType()), T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("version", T.StringType()),
])


def source_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def csv_gate_ok(name: str) -> bool:
    """Only names ending in .csv, any case."""
    return name.lower().endswith(".csv")


def list_drop_folder(spark: SparkSession, folder: str) -> DataFrame:
    """S2 / S5 input: the upload sources in a drop folder (a file or a folder
    directly under it), their bytes and the gate verdict.  A distributed
    listing: file contents are not read."""
    folder = folder.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select("path", "length"))
    return (files.select(source_in(folder).alias("source"), "length")
            .groupBy("source").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
            .withColumn("accepted", F.lower("source").endswith(".csv")))


def list_source_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source, path, length, modified) of every file in a drop folder's sources; contents are not read."""
    folder = folder.rstrip("/")
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select(source_in(folder).alias("source"), "path", "length", F.col("modificationTime").alias("modified")))


def source_in(folder: str, path: str = "path") -> Column:
    """The name directly under ``folder`` that a file's path goes through."""
    return F.regexp_extract(F.col(path), r"^.*?" + re.escape(source_name(folder)) + r"/([^/]+)", 1)


def csv_reader(spark: SparkSession, sep: str = ",", multi_line: bool = True):
    """Reader for CSV as tools write it: quoted line breaks and doubled quotes.
    An empty cell is null, quoted or not.

    ``multi_line`` keeps a quoted cell with line breaks whole; a file is then
    read by one task, so large uploads should come as folders of parts.
    """
    return (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("enforceSchema", False))


# What a cell is, first test first: name -> (bit, test).  A cell gets one bit; no cell passes two of the tests but a date is a
# stamp.  A look at one character or the length, which every cell of the kind passes, goes before the patterns.
CELL_KINDS = {
    "date": (4, lambda c: _at(c, 5, "-") & c.rlike(DATE_CELL) & c.try_cast("date").isNotNull()),
    "stamp": (8, lambda c: _at(c, 5, "-") & c.rlike(STAMP_CELL) & c.try_cast("timestamp_ntz").isNotNull()),
    "integer": (1, lambda c: c.rlike(SHORT_INTEGER_CELL) | ((F.length(c) > 18) & c.rlike(INTEGER_CELL) & c.try_cast("bigint").isNotNull())),
    "decimal": (2, lambda c: c.rlike(DOUBLE_CELL)),
    "time": (16, lambda c: (_at(c, 2, ":") | _at(c, 3, ":")) & c.rlike(TIME_CELL)),
    "truth": (32, lambda c: F.substring(c, 1, 1).isin(*"tTfF") & c.rlike(BOOLEAN_CELL)),
}
OTHER_CELL = 64
# What a cell of one of the kinds starts with: white space as patterns have it, digits, signs, words.
CELL_STARTS = " \t\n\x0b\f\r0123456789+-.NItTfF"
# Types in order of preference: canonical name -> (Spark type, the kinds its cells may be of).
CELL_TYPES = {
    "BIGINT": ("bigint", ("integer",)),
    "DOUBLE": ("double", ("integer", "decimal")),
    "BOOLEAN": ("boolean", ("truth",)),
    "DATE": ("date", ("date",)),
    "TIMESTAMP": ("timestamp_ntz", ("date", "stamp")),
    "TIME": ("string", ("time",)),
}


def _at(c: Column, place: int, char: str) -> Column:
    return F.substring(c, place, 1) == F.lit(char)


def cell_kind(c: Column) -> Column:
    """The bit of a cell's kind, 0 for an empty cell."""
    kind = F.when(c.isNull(), F.lit(0))
    # None of the tests passes on a cell that starts with another character.
    kind = kind.when(~F.substring(c, 1, 1).isin(*CELL_STARTS), F.lit(OTHER_CELL))
    for bit, test in CELL_KINDS.values():
        kind = kind.when(test(c), F.lit(bit))
    return kind.otherwise(F.lit(OTHER_CELL))


def type_of(kinds: int) -> str:
    """The type of a column whose cells are of these kinds (an or of their bits)."""
    for name, (_, members) in CELL_TYPES.items():
        if kinds and not kinds & ~sum(CELL_KINDS[k][0] for k in members):
            return name
    return "VARCHAR"


def spans_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted cell may reach over a line end: some line has an odd number of quotes.
    Lines are read in parallel, whatever the number of files."""
    lines = spark.read.text(path)
    return not lines.filter(F.contains("value", F.lit('"')) & (F.length(F.translate("value", '"', "")) % 2 != F.length("value") % 2)).limit(1).isEmpty()


class CsvSource:
    """One CSV source, inferred: ``types`` by column, ``row_count`` and the
    number of ``malformed`` rows, all from one pass over the whole source.

    A file of a source without line breaks in cells is read by many tasks; ``multi_line``
    says whether there are any (None: look, in a pass over the bare lines)."""

    def __init__(self, spark: SparkSession, path: str | list[str], sep: str = ",", multi_line: bool | None = None):
        self.spark, self.path = spark, path
        reader = csv_reader(spark, sep, spans_lines(spark, path) if multi_line is None else multi_line)
        self.columns = reader.csv(path).columns
        text = T.StructType([*[T.StructField(c, T.StringType()) for c in self.columns], T.StructField(MALFORMED, T.StringType())])
        self.text = reader.option("columnNameOfCorruptRecord", MALFORMED).schema(text).csv(path)
        kinds = [F.bit_or(cell_kind(F.col(f"`{c}`"))).alias(f"k{i}") for i, c in enumerate(self.columns)]
        found = self.text.agg(F.count(F.lit(1)).alias("rows"), F.count(MALFORMED).alias("bad"), *kinds).first()
        self.row_count, self.malformed = found["rows"], found["bad"]
        self.types = {c: type_of(found[f"k{i}"] or 0) for i, c in enumerate(self.columns)}

    def typed(self) -> DataFrame:
        """The rows under the inferred types (a time of day stays text)."""
        return self.text.select(*[F.trim(F.col(f"`{c}`")).cast(CELL_TYPES[t][0]).alias(c)
                                  if t in CELL_TYPES and t != "TIME" else F.col(f"`{c}`") for c, t in self.types.items()])

    def schema(self) -> DataFrame:
        rows = [(i, c, t, True) for i, (c, t) in enumerate(self.types.items())]
        return self.spark.createDataFrame(rows, C.SCHEMA_TABLE).coalesce(1)


def infer_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Header CSV with full type inference over all rows.  Returns the
    typed rows, the schema table and the columns reported as TIME.  Rows with
    too many or too few cells raise, with their number."""
    source = CsvSource(spark, path, sep, multi_line)
    if source.malformed:
        raise ValueError(f"{source_name(path)}: {source.malformed} rows with too many or too few cells")
    return source.typed(), source.schema(), {c: t for c, t in source.types.items() if t == "TIME"}


class DatasetStore:
    """A versioned dataset store rooted in one (shared) folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- paths
    def data_dir(self, dataset_id) -> str:
        return f"{self.root}/data/dataset_id={dataset_id}"

    @property
    def schemas_dir(self) -> str:
        return f"{self.root}/schemas"

    @property
    def uploads_dir(self) -> str:
        return f"{self.root}/uploads"

    # -- tables
    def schemas(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(SCHEMA_LOG).parquet(self.schemas_dir)
        except Exception as e:  # noqa: BLE001 -- no schema log yet
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return None
            raise

    def uploads(self) -> DataFrame:
        return self.spark.read.schema(REPORT_SCHEMA).parquet(self.uploads_dir)

    def current_schema(self, dataset_id) -> DataFrame | None:
        """The schema the last accepted upload left (None = first upload).
        A read error is raised, never taken as "first upload"."""
        s = self.schemas()
        if s is None:
            return None
        mine = s.filter(F.col("dataset_id") == str(dataset_id))
        if mine.isEmpty():
            return None
        return C.current_schema(mine).select("ordinal", "column_name", "type", "nullable")

    def committed(self, dataset_id) -> list[tuple[int, str]]:
        """(number, upload) of every logged upload: a row per upload."""
        s = self.schemas()
        if s is None:
            return []
        mine = s.filter(F.col("dataset_id") == str(dataset_id)).groupBy("seq", "upload").agg(F.lit(1))
        return sorted((r["seq"], r["upload"]) for r in mine.collect())

    def _log(self, folder: str, schema: T.StructType) -> DataFrame:
        """A log table, empty before its first row.  A read error is raised."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except Exception as e:  # noqa: BLE001 -- no such log yet
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def taken_files(self, dataset_id) -> DataFrame:
        """(path, length, modified) of every file that is stored or was refused: the files
        of the versions that the schema log or a report names.  Files logged by an
        upload that failed before it was logged itself don't count."""
        mine = F.col("dataset_id") == str(dataset_id)
        seen = [self._log(name, schema).filter(mine).select("version") for name, schema in (("schemas", SCHEMA_LOG), ("uploads", REPORT_SCHEMA))]
        files = self._log("files", FILE_LOG).filter(mine)
        return files.join(seen[0].unionByName(seen[1]).distinct(), "version", "left_semi").select("path", "length", "modified").distinct()

    def new_files(self, dataset_id, folder: str, names: list[str] | None = None, settle: str | None = None) -> DataFrame:
        """(source, path, length, modified, whole) of the files that weren't taken as they stand now: new
        ones, parts that came late, and files written again under a name that was taken.  ``whole``: no
        file of the source was taken.  With ``settle`` (an interval, e.g. ``10 minutes``) a source counts as
        complete, and is listed, once none of its files has changed for that long."""
        files = list_source_files(self.spark, folder)
        if names is not None:
            files = files.filter(F.col("source").isin(names))
        taken = self.taken_files(dataset_id).withColumn("taken", F.lit(True))
        files = files.join(taken, ["path", "length", "modified"], "left")
        per = files.groupBy("source").agg(F.count("taken").alias("n_taken"), F.max("modified").alias("last"))
        if settle:
            per = per.filter(F.col("last") <= F.current_timestamp() - F.expr(f"interval {settle}"))
        return (files.filter("taken is null").join(per, "source")
                .select("source", "path", "length", "modified", (F.col("n_taken") == 0).alias("whole")))

    def upload_new(self, dataset_id, folder: str, names: list[str] | None = None, now: _dt.datetime | None = None,
                   settle: str | None = None) -> list[dict]:
        """Takes what ``new_files`` lists, an upload a source, in name order.  A version's files are logged
        first and count once its report or its schema is logged, so a failure in between loses and
        doubles nothing.  Names and paths of what is new reach the driver."""
        new = saved(self.new_files(dataset_id, folder, names, settle), "new-files")
        one = F.xxhash64("path", "length", "modified").cast("decimal(38,0)")
        versions = new.groupBy("source").agg(F.hex(F.sum(one).cast("string")).alias("version"), F.min("whole").alias("whole"))
        found = {r["source"]: r for r in versions.collect()}
        if not found:
            return []
        # A source is read by the very files that were listed, whatever comes meanwhile.
        paths: dict[str, list[str]] = {}
        for r in new.select("source", "path").orderBy("path").collect():
            paths.setdefault(r["source"], []).append(r["path"])
        (new.join(versions.select("source", "version"), "source").select(F.lit(str(dataset_id)).alias("dataset_id"), "version", "path", "length", "modified")
         .write.mode("append").parquet(f"{self.root}/files"))
        order = sorted(found)
        sources = [(n, paths[n], now + _dt.timedelta(seconds=i) if now else None) for i, n in enumerate(order)]
        notes = {n: [f"{len(paths[n])} files came after the source was taken"] for n in order if not found[n]["whole"]}
        return self._upload(dataset_id, sources, versions={n: found[n]["version"] for n in order}, notes=notes)

    # -- S4
    def upload_csv(self, dataset_id, source: str, now: _dt.datetime | None = None, sep: str = ",") -> dict:
        """Gate -> infer -> drift check -> append Parquet -> log.  Returns
        the report row as a dict (also appended to the uploads table)."""
        return self._upload(dataset_id, [(source_name(source), source, now)], sep)[0]

    def _upload(self, dataset_id, sources: list[tuple[str, str | list[str], _dt.datetime | None]], sep: str = ",",
                versions: dict[str, str] | None = None, notes: dict[str, list[str]] | None = None) -> list[dict]:
        """Several sources in order, each accepted or rejected on its own: read
        side by side, checked one after the other on their schemas (a few names
        each), written side by side, logged last."""
        done = self.committed(dataset_id)
        old = self.current_schema(dataset_id)
        in_force = None if old is None else {r["column_name"]: r["type"] for r in old.orderBy("ordinal").collect()}
        taken, seq = {u for _, u in done}, max((n for n, _ in done), default=0)
        with ThreadPoolExecutor(PARALLEL) as pool:
            read = list(pool.map(lambda x: CsvSource(self.spark, x[1], sep) if csv_gate_ok(x[0]) else None, sources))
            reports, accepted = [], []
            for (name, _, now), src in zip(sources, read):
                rep = dict(dataset_id=str(dataset_id), source=name, version=(versions or {}).get(name), accepted=False, upload=None, row_count=None,
                           n_columns=None, is_first_upload=None, errors=[], warnings=[])
                reports.append(rep)
                if src is None:
                    rep["errors"] = ["not a .csv source"]
                    continue
                errors, warnings = C.drift_lists(src.types, in_force)
                rep["warnings"] = [*warnings, *(notes or {}).get(name, [])]
                bad = [f"{src.malformed} rows with too many or too few cells"] if src.malformed else []
                rep.update(is_first_upload=in_force is None, n_columns=len(src.columns), errors=errors + bad)
                if rep["errors"]:
                    continue
                at = now or _dt.datetime.now(_dt.timezone.utc)
                base = stamp = at.strftime("%Y%m%d_%H%M%S")
                n = 1
                while stamp in taken:  # a second upload in the same second never replaces the first
                    n += 1
                    stamp = f"{base}_{n}"
                taken.add(stamp)
                seq += 1
                rep.update(accepted=True, upload=stamp, row_count=src.row_count)
                in_force = src.types
                accepted.append((rep, src, seq, at.replace(tzinfo=None)))

            def write(x: tuple) -> None:
                # what an upload that failed before it was logged may have left here is replaced
                x[1].typed().write.mode("overwrite").parquet(f"{self.data_dir(dataset_id)}/upload={x[0]['upload']}")

            list(pool.map(write, accepted))
        log = [(i, c, t, True, str(dataset_id), rep["upload"], n, rep["source"], rep["row_count"], at, rep["version"])
               for rep, src, n, at in accepted for i, (c, t) in enumerate(src.types.items())]
        if log:
            self.spark.createDataFrame(log, SCHEMA_LOG).coalesce(1).write.mode("append").parquet(self.schemas_dir)
        self.spark.createDataFrame(reports, REPORT_SCHEMA).coalesce(1).write.mode("append").parquet(self.uploads_dir)
        return reports

    # -- S5
    def upload_many(self, dataset_id, folder: str, now: _dt.datetime | None = None) -> DataFrame:
        """Every source of a drop folder in name order, each accepted or
        rejected on its own; returns the report rows of this batch."""
        names = sorted(r["source"] for r in list_drop_folder(self.spark, folder).select("source").collect())
        return self.spark.createDataFrame(self.upload_sources(dataset_id, folder, names, now), REPORT_SCHEMA)

    def upload_sources(self, dataset_id, folder: str, names: list[str], now: _dt.datetime | None = None) -> list[dict]:
        """The named sources of a drop folder, in order."""
        at = [now + _dt.timedelta(seconds=i) if now else None for i in range(len(names))]
        return self._upload(dataset_id, [(n, f"{folder.rstrip('/')}/{n}", t) for n, t in zip(names, at)])

    # -- S6 / S8
    def read_all(self, dataset_id) -> DataFrame:
        """The dataset over all logged uploads; columns absent from
        older uploads come back null.  A damaged file raises.  The columns come from the
        log, a row per column, so no file is opened before the scan."""
        paths = [f"{self.data_dir(dataset_id)}/upload={u}" for _, u in self.committed(dataset_id)]
        return self.spark.read.schema(self.logged_schema(dataset_id)).option("basePath", f"{self.root}/data").parquet(*paths)

    def logged_schema(self, dataset_id) -> T.StructType:
        """Every column that a logged upload has, in order of appearance, under the type of the last upload that
        has it, and the partition columns."""
        mine = self.schemas().filter(F.col("dataset_id") == str(dataset_id))
        last = mine.groupBy("column_name").agg(F.min(F.struct("seq", "ordinal")).alias("first"), F.max_by("type", "seq").alias("type"))
        kinds = {t: spark_type for t, (spark_type, _) in CELL_TYPES.items()}
        columns = [T.StructField(r["column_name"], T.StructType.fromDDL(f"c {kinds.get(r['type'], 'string')}")[0].dataType)
                   for r in last.orderBy("first").collect()]
        return T.StructType([*columns, T.StructField("dataset_id", T.StringType()), T.StructField("upload", T.StringType())])

# -- S7
    def list_uploads(self, dataset_id) -> DataFrame:
        return list_uploads(self.spark, self.data_dir(dataset_id))


def list_uploads(spark: SparkSession, dataset_dir: str) -> DataFrame:
    """Every stored file with its upload and bytes, in name order (a
    listing -- no data pages are read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(dataset_dir.rstrip("/")).select("path", "length"))
    return (files.filter(~F.regexp_extract("path", r"([^/]+)$", 1).startswith("_")
                         & ~F.regexp_extract("path", r"([^/]+)$", 1).startswith("."))
            .select(F.col("path").alias("file_path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
                    F.col("length").alias("file_size"), F.regexp_extract("path", r"upload=([^/]+)", 1).alias("upload"))
            .orderBy("upload", "file_name"))


def upload_order(upload: str = "upload") -> list[Column]:
    """Order of upload names: by stamp, then by its number within the second
    (``_10`` after ``_9``); other names by their text."""
    stamp = F.regexp_extract(upload, r"^([0-9]{8}_[0-9]{6})(_[0-9]+)?$", 1)
    n = F.regexp_extract(upload, r"^[0-9]{8}_[0-9]{6}_([0-9]+)$", 1)
    return [F.when(stamp != "", stamp).otherwise(F.col(upload)), F.coalesce(n.try_cast("bigint"), F.lit(1)), F.col(upload)]


# Silent files up to this size are opened all together, larger ones (damaged as a rule, and few) by their paths.
SMALL_FILE_BYTES = 16 << 20


def file_rows(spark: SparkSession, dataset_dir: str) -> DataFrame:
    """(file_path, upload, file_size, rows, damaged) of every stored file.  Counts come from one column-less scan (footers
    only) grouped by file; files that gave no rows are opened by tasks, which tell empty files from damaged ones."""
    import pyarrow as pa

    files = list_uploads(spark, dataset_dir).select("file_path", "upload", "file_size")
    data = spark.read.option("ignoreCorruptFiles", True).parquet(dataset_dir)
    counts = data.select(F.col("_metadata.file_path").alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("rows"))
    listed = saved(files.join(counts, F.col("file_path") == F.col("of"), "left").drop("of"), "file-rows")
    silent = listed.filter("rows is null")

    def look(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for content in batch.column("content"):
                try:
                    rows.append(pq.read_metadata(pa.BufferReader(content.as_buffer())).num_rows)
                except (pa.ArrowException, OSError):
                    rows.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rows, type=pa.int64())], names=["looked_at", "found"])

    def opened(files: DataFrame) -> DataFrame:
        return files.select("path", "content").mapInArrow(look, "looked_at string, found long")

    reader = spark.read.format("binaryFile")
    looked = []
    # The range of the small ones' sizes is pushed into the listing: other files' contents are not read.
    small = silent.filter(F.col("file_size") <= SMALL_FILE_BYTES)
    span = small.agg(F.min("file_size").alias("least"), F.max("file_size").alias("most")).first()
    if span["most"] is not None:
        near = reader.option("recursiveFileLookup", "true").load(dataset_dir).filter((F.col("length") >= span["least"]) & (F.col("length") <= span["most"]))
        looked.append(opened(near.join(small.select("file_path"), F.col("path") == F.col("file_path"), "left_semi")))
    large = [r["file_path"] for r in silent.filter(F.col("file_size") > SMALL_FILE_BYTES).select("file_path").collect()]
    if large:
        looked.append(opened(spark.read.format("binaryFile").load(large)))
    out = listed
    for found in looked:
        out = out.join(found, F.col("file_path") == F.col("looked_at"), "left").withColumn("rows", F.coalesce("rows", "found")).drop("looked_at", "found")
    return out.select("file_path", "upload", "file_size", "rows", F.col("rows").isNull().alias("damaged"))


def dataset_history(spark: SparkSession, dataset_dir: str) -> DataFrame:
    """Per upload in order: ISO timestamp (raw text when the name is no
    stamp), name, rows added, cumulative rows, bytes, cumulative bytes, and how many
    damaged files were left out.  These count neither in rows nor in bytes; an
    upload of nothing else has no row (``file_rows`` lists it).  Only the sums per upload are ordered.
    """
    good = F.when(~F.col("damaged"), F.col("file_size"))
    per_upload = file_rows(spark, dataset_dir).groupBy("upload").agg(
        F.sum("rows").alias("rows_added"), F.sum(good).alias("file_size_bytes"), F.count_if("damaged").alias("damaged_files")).filter("file_size_bytes is not null")
    # one row per upload of one dataset
    w = Window.orderBy(*upload_order()).rowsBetween(Window.unboundedPreceding, 0)
    return per_upload.select(
        S.parse_upload_stamp("upload").alias("timestamp"), F.col("upload").alias("filename"),
        "rows_added", F.sum("rows_added").over(w).alias("cumulative_rows"),
        "file_size_bytes", F.sum("file_size_bytes").over(w).alias("cumulative_file_size_bytes"), "damaged_files")


def preview(spark: SparkSession, dataset_dir: str, n: int = 10, upload: str | None = None) -> DataFrame:
    """L2: the first n rows of one upload (the oldest unless named), ordered by
    the first column, temporal values as ISO text, with that upload's row count."""
    if upload is None:
        upload = list_uploads(spark, dataset_dir).select("upload").distinct().orderBy(*upload_order()).first()[0]
    df = spark.read.parquet(f"{dataset_dir.rstrip('/')}/upload={upload}")
    cols = [S.isoformat(c).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.orderBy(df.columns[0]).limit(n).select(*cols)
            .withColumn("file_row_count", total).withColumn("upload", F.lit(upload)))


def check_upload_size(listing: DataFrame, max_file: int = MAX_FILE_BYTES,
                      max_dataset: int = MAX_DATASET_BYTES, dataset: str = "dataset_id") -> DataFrame:
    """V9: files over the per-file limit and datasets over the total limit."""
    big_files = listing.filter(F.col("file_size") > max_file).select(
        F.col(dataset), F.col("file_name").alias("id"), F.lit("file_too_large").alias("rule"))
    totals = listing.groupBy(dataset).agg(F.sum("file_size").alias("_b"))
    big_sets = totals.filter(F.col("_b") > max_dataset).select(
        F.col(dataset), F.col(dataset).cast("string").alias("id"), F.lit("dataset_too_large").alias("rule"))
    return big_files.unionByName(big_sets)


def export_rows(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Export rows as CSV (with header) or JSON lines; returns the path."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        _csv_options(w.option("header", True)).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")
    return path


def _csv_options(writer, sep: str = ","):
    """Quotes doubled inside quotes, spaces kept: what ``csv_reader`` reads."""
    return (writer.option("sep", sep).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_run_table(df: DataFrame, path: str, run: str, order: list[str], partition_col: str,
                    partitions: int | None = None) -> str:
    """Append a run table partitioned by ``partition_col`` (e.g. day),
    rows sorted by (run, order...) inside each file so row-group statistics
    prune on run.  Range partitioning keeps each task on a contiguous
    (partition, run, time) range -- few files per directory, and a run with a
    third of all rows is still spread over many tasks."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(parts, partition_col, run, *order)
     .sortWithinPartitions(partition_col, run, *order)
     .write.mode("append").partitionBy(partition_col).parquet(path))
    return path


def stage_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> str:
    """Write a CSV upload source (a folder of part files)."""
    _csv_options(df.write.mode("overwrite").option("header", header), sep).csv(path)
    return path

