"""Session settings and the few helpers that depend on the cluster."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark's own setting: the shuffle files of a query go when it ends, instead of when the driver next collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A broadcast side stays below this many (narrow) rows; beyond it Spark shuffles.
BROADCAST_ROWS = 100_000
# For tables whose rows are megabytes: the writer looks at its pages and row groups after every row, not after a hundred rows,
# so that neither it nor a reader holds more than a few rows at a time.
LARGE_ROWS = {
    "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
}


def build(app: str = "textassay", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Rows of a small shuffle may still cost much work each (regexes, term joins).
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="textassay-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, *by: str, options: dict[str, str] | None = None) -> str:
    """Write a frame to a new folder in the shared one, partitioned ``by`` columns, with the writer's ``options``.

    Nothing reads the shuffles of the write again, so their files go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textassay/{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.options(**(options or {})).partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return path


def settle(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    It is computed once, its lineage is cut, lost executors cost nothing, and the
    files tell the optimizer the size of each side of a later join.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, options=options))


def discard(*frames: DataFrame) -> None:
    """Delete the files of settled frames that nothing reads any more; a file system unknown to Arrow keeps them."""
    for frame in frames:
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            uri = folder if "://" in folder or not folder.startswith("file:/") else "file://" + folder[len("file:"):]
            try:
                system, path = fs.FileSystem.from_uri(uri)
            except pa.ArrowInvalid:
                continue
            system.delete_dir(path)


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a settled frame of checked size, else a plain join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that planned fewer splits than there are cores one split per core.

    A scan with so few splits holds at most ``cores x maxPartitionBytes``; a large
    table plans more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not have it installed.

    Spark's own file server carries the driver's zip; no executor reads the driver's folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="textassay-code-")) / "textassay_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def release() -> None:
    """Give memory that a task has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # not every C library has it
        trim(0)
