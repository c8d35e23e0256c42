"""Session helpers shared by queries, tests and bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def get_spark(app: str = "regionlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; existing sessions are reused as they are."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package known to the Python workers of all executors, once per application.

    Workers import what UDFs name; they need not run where the repository lies. Spark distributes the file as it does ``--py-files``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="regionlab-")  # of the driver, for this file only
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "regionlab.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("regionlab", os.path.relpath(full, home)))
    sc.addPyFile(path)


def narrowed(dtype: T.DataType, members: Sequence[str]) -> T.DataType:
    """A struct, or an array of structs, of some of its members in the order they are stored."""
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(narrowed(dtype.elementType, members), dtype.containsNull)
    if lacking := [m for m in members if m not in dtype.fieldNames()]:
        raise ValueError(f"no members: {lacking}")
    return T.StructType([f for f in dtype.fields if f.name in members])


def table(spark: SparkSession, sf_dir: str, name: str, **members: Sequence[str]) -> DataFrame:
    """A table. ``members`` names, by column, what is to be read of an array of structs (for its size, any plain member will do).

    Spark drops unread members of nested columns only as long as no lambda, generator of whole elements or shuffle lies between them
    and the scan; a narrowed read schema never reads them.
    """
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not members:
        return df
    fields = [T.StructField(f.name, narrowed(f.dataType, members[f.name]) if f.name in members else f.dataType, f.nullable) for f in df.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) a temporary folder is set, and only in local mode.
    """
    # the setting says where; the context holds a folder below it once it was made known to it
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        named = os.path.join(tempfile.gettempdir(), "regionlab-checkpoint")
        sc.setCheckpointDir(named)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``checkpoint`` into the shared folder: lineage is cut, a lost executor costs nothing that was written."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/regionlab-{kind}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def until_exit(spark: SparkSession, path: str) -> None:
    """An existing folder of the shared folder goes at the end of the ``temporary`` scope that it was made in, or else when the driver's JVM ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What operators write for themselves inside goes at the end; results must have been read or written by then.

    A session that runs many queries holds no more than one query's tables that way.
    """
    _scopes.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            fs = where.getFileSystem(conf)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back (column pruning stays possible, unlike checkpoint)."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Rows dealt evenly over the cluster's cores where a scan gives fewer tasks than there are cores; otherwise unchanged.

    A single small Parquet file is one task; CPU-bound operators need more. The row order carries no meaning anywhere here.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n * factor)


def kept(columns: list[str] | tuple[str, ...], made: set[str]) -> dict[str, str]:
    """Names that carried columns get beside those an operator makes: a clashing one comes out as ``kept_<name>``."""
    return {c: f"kept_{c}" if c in made else c for c in columns}
