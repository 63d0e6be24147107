"""A4 + B1/B2/B4: wide parquet panels -> long observations.

A panel is ``Date`` plus one value column per series; every file may have a
different set of columns. Panels up to ``PANEL_BYTES`` are read by ONE job
whatever their number and their schemas: Spark's binary file source deals the
files to tasks, each task decodes its panels with Arrow and gives their cells,
a bounded number at a time. Nothing is read on the driver and the plan doesn't
grow with the files. Larger panels are grouped by schema; each group is one
parquet scan, so that a panel's row groups are read in parallel. Dates and
values are coerced by the same expressions either way.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.functions.dates import day_from_nanos
from seriesforge.plans.broadcast import broadcast_if_small

DATE_COLUMN = "Date"
_INDEX_COL = re.compile(r"^__index_level_\d+__$")
LONG_SCHEMA = "source_file string, country string, frequency string, date date, name string, value double"
#: Panels up to this size are decoded whole in a task.
PANEL_BYTES = 64 << 20
#: Cells that a task decodes at a time, and cells of an Arrow batch that it gives.
DECODED, GIVEN = 1 << 20, 1 << 16
CELLS = "source_uri string, day date, day_text string, name string, number double, number_text string"
#: Forms of text dates other than ISO that are read (month first, as the usual reader does).
TEXT_DATES = ("yyyy/M/d", "M/d/yyyy", "yyyyMMdd", "yyyy.M.d", "d MMM yyyy", "MMM d, yyyy", "MMM yyyy")


def quote(name: str) -> str:
    """Back-tick a column name; inner back-ticks doubled (dots, commas, spaces)."""
    return "`" + name.replace("`", "``") + "`"


@contextmanager
def case_sensitive(spark: SparkSession):
    """Series names may differ only by case: resolve columns case-sensitively. Nanosecond dates are read as numbers
    (S-1). Holds while a panel is read, so run what ``read_panels`` returns inside it."""
    conf = {"spark.sql.caseSensitive": "true", "spark.sql.legacy.parquet.nanosAsLong": "true"}
    old = {k: spark.conf.get(k, "false") for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def normalize_date(col: Column, dtype: T.DataType) -> Column:
    """B1: any date-like column -> calendar day (UTC)."""
    if isinstance(dtype, T.DateType):
        return col
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType)):
        return day_from_nanos(col.cast("long"))  # ns since epoch (S-1)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(col)
    if isinstance(dtype, T.StringType):
        # ISO first, then the day-first/month-first forms with a separator, compact digits and month names
        forms = [F.to_date(F.try_to_timestamp(F.trim(col), F.lit(f))) for f in TEXT_DATES]
        return F.coalesce(F.to_date(col.try_cast("timestamp")), *forms)
    return F.lit(None).cast("date")


def coerce_value(col: Column, dtype: T.DataType) -> Column:
    """Stored values are doubles; text that is not a number becomes null."""
    if isinstance(dtype, T.DoubleType):
        return col
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    if isinstance(dtype, T.StringType):
        return col.try_cast("double")
    return F.lit(None).cast("double")


def unpivot_panel(wide: DataFrame, ids: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """B2: wide -> long (ids…, name, value); names keep commas, dots, case."""
    return wide.unpivot([F.col(quote(c)) for c in ids], [F.col(quote(c)) for c in value_cols],
                        "name", "value")


def panel_schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(path).schema


def _scan_group(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame | None:
    names = [f.name for f in schema.fields]
    if DATE_COLUMN not in names:
        return None  # no Date column -> the file yields nothing
    value_idx = [i for i, f in enumerate(schema.fields)
                 if f.name != DATE_COLUMN and not _INDEX_COL.match(f.name)]
    if not value_idx:
        return None
    date_idx = names.index(DATE_COLUMN)
    # Positional renaming: series names may hold dots, back-ticks or differ
    # only by case, so after the scan columns are addressed as c0, c1, …
    raw = spark.read.schema(schema).parquet(*paths)
    raw = raw.select(F.col("_metadata.file_path").alias("source_uri"), *[F.col(quote(n)) for n in names])
    safe = raw.toDF("source_uri", *[f"c{i}" for i in range(len(names))])
    cells = [F.struct(F.lit(names[i]).alias("name"),
                      coerce_value(F.col(f"c{i}"), schema.fields[i].dataType).alias("value"))
             for i in value_idx]
    return safe.select("source_uri",
                       normalize_date(F.col(f"c{date_idx}"), schema.fields[date_idx].dataType).alias("date"),
                       F.inline(F.array(*cells)))


def _cell_reader() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with whole panel files (source_uri, content): a row a cell (``CELLS``). Dates are days (from
    nanoseconds, S-1, or any timestamp) or text, values doubles or text; other types give nulls. All of it is inside, so
    that executors need no copy of the library."""
    date_column, index_column, decoded, given = DATE_COLUMN, _INDEX_COL.pattern, DECODED, GIVEN
    per_day = {"s": 86_400, "ms": 86_400_000, "us": 86_400_000_000, "ns": 86_400_000_000_000}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        is_ = pa.types

        def plain(column: pa.Array) -> pa.Array:
            return column.cast(column.type.value_type) if is_.is_dictionary(column.type) else column

        def text_of(column: pa.Array) -> pa.Array | None:
            return column.cast(pa.string()) if is_.is_string(column.type) or is_.is_large_string(column.type) else None

        def days(column: pa.Array) -> pa.Array:
            kind = column.type
            if is_.is_date(kind):
                return column.cast(pa.date32())
            if is_.is_timestamp(kind):
                unit = per_day[kind.unit]
            elif is_.is_signed_integer(kind):
                unit = per_day["ns"]
            else:
                return pa.nulls(len(column), pa.date32())
            empty = column.is_null().to_numpy(zero_copy_only=False)
            ticks = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            return pa.array(np.floor_divide(ticks, unit).astype(np.int32), pa.int32(), mask=empty).cast(pa.date32())

        def numbers(column: pa.Array) -> pa.Array:
            kind = column.type
            if is_.is_duration(kind):
                column = column.cast(pa.int64())
            elif is_.is_boolean(kind):
                column = column.cast(pa.int8())
            elif not (is_.is_integer(kind) or is_.is_floating(kind) or is_.is_decimal(kind)):
                return pa.nulls(len(column), pa.float64())
            return column.cast(pa.float64(), safe=False)

        def cells(uri: str, content: bytes) -> Iterator[pa.RecordBatch]:
            file = pq.ParquetFile(pa.BufferReader(content))
            names = file.schema_arrow.names
            values = [i for i, n in enumerate(names) if n != date_column and not re.match(index_column, n)]
            if date_column not in names or not values:
                return  # such a file yields nothing
            at = names.index(date_column)
            for rows in file.iter_batches(batch_size=min(max(1, decoded // len(names)), given)):
                n = rows.num_rows
                date = plain(rows.column(at))
                day, day_text = days(date), text_of(date)
                step = max(1, given // max(n, 1))
                for k in range(0, len(values), step):
                    part = values[k:k + step]
                    columns = [plain(rows.column(i)) for i in part]
                    texts = [text_of(c) for c in columns]
                    m = n * len(part)
                    yield pa.record_batch([
                        pa.repeat(pa.scalar(uri, pa.string()), m), pa.concat_arrays([day] * len(part)),
                        pa.nulls(m, pa.string()) if day_text is None else pa.concat_arrays([day_text] * len(part)),
                        pa.array([names[i] for i in part], pa.string()).take(pa.array(np.repeat(np.arange(len(part)), n))),
                        pa.concat_arrays([numbers(c) for c in columns]),
                        pa.concat_arrays([pa.nulls(n, pa.string()) if t is None else t for t in texts])],
                        names=["source_uri", "day", "day_text", "name", "number", "number_text"])

        for batch in batches:
            uris, contents = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                uri = uris[i].as_py()
                try:
                    yield from cells(uri, contents[i].as_buffer())
                except pa.ArrowInvalid as e:
                    raise ValueError(f"{uri} can't be read as a panel: {e}") from e
    return run


def _decoded_panels(files: DataFrame) -> DataFrame:
    """(source_uri, date, name, value) of whole panel files (path, content), decoded in tasks."""
    cells = files.select(F.col("path").alias("source_uri"), "content").mapInArrow(_cell_reader(), CELLS)
    return cells.select(
        "source_uri", F.coalesce("day", normalize_date(F.col("day_text"), T.StringType())).alias("date"), "name",
        F.coalesce("number", coerce_value(F.col("number_text"), T.StringType())).alias("value"))


def _scanned_panels(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """(source_uri, date, name, value) of large panels, a parquet scan for each schema."""
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    with ThreadPoolExecutor(16) as pool:
        for path, schema in zip(paths, pool.map(lambda p: panel_schema(spark, p), paths)):
            groups.setdefault(schema.json(), (schema, []))[1].append(path)
    return [p for p in (_scan_group(spark, some, schema) for schema, some in groups.values()) if p is not None]


def read_panels(spark: SparkSession, files: DataFrame, panel_bytes: int = PANEL_BYTES) -> DataFrame:
    """A4: read the panel files listed in ``files`` (path, country, frequency).

    Returns raw long rows ``(source_file, country, frequency, date, name, value)``
    where value may be null/NaN and date may be null (see B3/B5). Panels of more
    than ``panel_bytes`` are scanned by schema, the others decoded in tasks; the
    rows are the same. A file without ``Date`` or without value columns yields
    nothing, no files no rows; a file that isn't parquet fails the job by name.
    """
    meta = files.select("path", "country", "frequency").distinct().collect()  # file list: planning metadata
    if not meta:
        return spark.createDataFrame([], LONG_SCHEMA)
    with case_sensitive(spark):
        listed = spark.read.format("binaryFile").load([r["path"] for r in meta])
        large = [r["path"] for r in listed.where(F.col("length") > panel_bytes).select("path").collect()]
        long = _decoded_panels(listed.where(F.col("length") <= panel_bytes))
        for part in _scanned_panels(spark, large):
            long = long.unionByName(part)
    # file attributes: one row per file, known on the driver -> size-checked broadcast
    attrs = spark.createDataFrame([(r["path"], r["country"], r["frequency"]) for r in meta],
                                  "path string, country string, frequency string")
    attrs = attrs.withColumn("source_uri", _as_uri(F.col("path")))
    long = long.withColumn("source_uri", _as_uri(F.col("source_uri")))
    joined = long.join(broadcast_if_small(attrs, len(meta)), "source_uri")
    return joined.select(F.col("path").alias("source_file"), "country", "frequency", "date", "name", "value")


def _as_uri(path: Column) -> Column:
    """Canonical ``scheme:/path`` form used by both the listing and ``_metadata``."""
    return (F.when(path.startswith("/"), F.concat(F.lit("file:"), path))
            .when(path.startswith("file:///"), F.concat(F.lit("file:"), F.substring(path, 8, 1 << 30)))
            .otherwise(path))
