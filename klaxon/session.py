"""Session helpers: settings, small local tables, and storing intermediate tables."""

from __future__ import annotations

import io
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the JSON adapters rely on: the last of duplicate keys wins."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


@contextmanager
def lenient(spark: SparkSession):
    """Plans made inside treat a value that cannot be converted as NULL, so that one rule never ends the query of all."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the configured checkpoint folder.

    Only a local session without one gets a temporary folder.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="klaxon-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source files to the application, once for each, by way of the shared folder, for Python workers without it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top, packed = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, files in os.walk(top):
            for name in sorted(n for n in files if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    place = f"{shared_folder(spark)}/package-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    sink = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    sink.write(bytearray(packed.getvalue()))
    sink.close()
    context.addPyFile(place)
    _shipped.add(context.applicationId)


# Folders of the tables that ``materialize`` wrote in this process, oldest first; long-running jobs remove theirs.
stored: list[str] = []
_own = threading.local()


def track(path: str) -> None:
    """Notes a folder that this library wrote, for whoever collects them in this thread."""
    stored.append(path)
    for paths in getattr(_own, "open", []):
        paths.append(path)


@contextmanager
def collecting():
    """The folders that are written inside, by this thread only: streams that run side by side each see their own."""
    paths: list[str] = []
    _own.open = [*getattr(_own, "open", []), paths]
    try:
        yield paths
    finally:
        _own.open = [p for p in _own.open if p is not paths]


def materialize(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """Write an intermediate table once and read it back.

    ``spread`` evens out the files first, for unions whose parts differ much in size.

    Used where several branches of a plan need the same result. The stored table survives the loss of
    executors and gives the optimizer real sizes, so later joins broadcast only what is small.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if spread:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.write.parquet(path)
    track(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that this library has written, on any file system."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def local_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A small driver-side table whose size the optimizer knows."""
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([_plain(r[i], f.type) for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def _plain(value, kind: pa.DataType):
    if value is None:
        return None
    if pa.types.is_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    if pa.types.is_struct(kind) and isinstance(value, (tuple, list)):
        return {kind.field(i).name: _plain(v, kind.field(i).type) for i, v in enumerate(value)}
    if pa.types.is_map(kind):
        return list(value.items())
    return value
