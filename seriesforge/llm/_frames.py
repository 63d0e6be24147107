"""Session and frame helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.session import ensure_checkpoint_dir

#: Rows per Arrow batch: a batch of whole texts stays at a few MB even when some texts are long.
ARROW_ROWS = 500


def ship_package(spark: SparkSession) -> None:
    """Send the library to the executors' Python workers, once a session: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_corpus_package", None):
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(os.path.realpath(path))
    sc._corpus_package = path


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every corpus operator relies on."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: the cluster's spark.checkpoint.dir."""
    return ensure_checkpoint_dir(spark).rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage, survives lost
    executors, and keeps column pruning. The folder is deleted when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch, on its own; batches that give None or no rows are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def documents(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text, as long and string, and the columns of ``keep``: other columns, whatever their names, don't reach
    an operator."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *kept_aside(docs, keep))


def kept_aside(docs: DataFrame, keep: tuple[str, ...]) -> list:
    """The columns of ``keep`` under names of their own, so that none clashes on the way."""
    return [docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)]


def ddl(docs: DataFrame, keep: tuple[str, ...]) -> str:
    """The columns of ``keep`` as the end of a schema."""
    return "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def salt(*cols: str):
    """A pseudo-random long of a row's own values: the same again when a lost task is run again."""
    return F.xxhash64(*cols)
