"""Shared helpers: a work folder that all executors see, stable row preparation, tables on disk.

Intermediate results that must survive the loss of an executor are written as Parquet tables
below the folder named in ``spark.checkpoint.dir``. Only where that setting is absent and the master is
this machine (tests) a temporary folder of it is used; on a cluster that is an error.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.runtime import delete, scratch, ship, spread


class Workspace:
    """Tables of one job in the shared folder.

    ``save`` writes a DataFrame and gives it back as a scan of the written files, which cuts
    the lineage; ``drop`` deletes a table that is no longer read. Whatever is left goes when
    the driver's Python ends, as lazily evaluated results may still read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, scratch(spark, name)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.path}/{table}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        for table in tables:
            delete(self.spark, f"{self.path}/{table}")
        self.release()

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more, now rather than some time."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; the operators' functions are sent along to the executors."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def most_frequent(rows: DataFrame, at_most: int, n: str = "n") -> DataFrame:
    """The rows of ``rows`` with the largest numbers ``n`` (positive), no more than ``at_most`` and with their ties.

    The bound comes from a histogram of a thousand classes at most, so no task sends a list of its own
    to the driver, which would be as many lists as there are tasks.
    """
    klass = F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int")
    total, least = 0, None
    for row in sorted(rows.groupBy(klass.alias("klass")).agg(F.count("*").alias("many")).collect(), key=lambda r: -r["klass"]):
        total += row["many"]
        if total > at_most:
            break
        least = row["klass"]
    return rows.where(klass >= least) if least is not None else rows.where("false")
