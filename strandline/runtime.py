"""What a session needs for this package: its sources on the executors, batches of bounded size, a shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows go to Python in batches of at most so many bytes, however long their texts are.
BATCH_BYTES = 4 << 20
#: No table of more bytes is moved only to have more tasks.
SPREAD_BYTES = 4 << 30
#: Bytes of a source, as Spark estimates them, whose k-mers one task counts; and what no source has, an estimate that is none.
TASK_BYTES, UNKNOWN_BYTES = 4 << 20, 1 << 50
_done: set[str] = set()
_local_roots: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Bound the session's batches, and send the package's sources to the executors, once per application."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="strandline-ship-")) / "strandline.zip"  # the driver's own; Spark sends it on
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def bytes_of(table: DataFrame) -> int:
    """Spark's estimate of a table's size."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by keys: to the session's number of tasks, or to more if ``source``, which they are made of, has over TASK_BYTES for each.

    Of a source without an estimate of its size nothing is known, and the session's number stays.
    """
    size = bytes_of(source)
    tasks = size // TASK_BYTES if size < UNKNOWN_BYTES else 0
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys) if tasks > usual else rows.repartition(*keys)


def spread(table: DataFrame) -> DataFrame:
    """``table`` dealt over all cores if it has fewer splits than there are cores and at most SPREAD_BYTES; as it is otherwise."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores or bytes_of(table) > SPREAD_BYTES:
        return table
    return table.repartition(cores)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's settings.

    Only where that setting is absent and the master is this machine (tests) a temporary folder of it
    is used; on a cluster that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _local_roots:
            _local_roots[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="strandline-")
        root = _local_roots[context.applicationId]
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this name in the shared one; it goes when the driver's Python ends."""
    path = f"{shared_root(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        context = spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session or its JVM may be gone by now
        pass
