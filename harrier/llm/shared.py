"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT = "spark.checkpoint.dir"
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    root = spark.conf.get(_CHECKPOINT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"set {_CHECKPOINT} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="harrier-shared-")
        spark.conf.set(_CHECKPOINT, root)
    return root.rstrip("/")


class Scratch:
    """A folder of intermediate tables of one query run.

    A table is written before it is read, so a lost executor never costs more than the tasks it was running, and what
    stood before the table (its lineage and shuffle files) can go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/harrier-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        # Results read from these tables when they are used, so the folder stays as long as the session, and no longer.
        path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path), spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).deleteOnExit(path)
        # Fewer rows in an Arrow batch: what a worker and the JVM's off-heap buffers hold does not depend on luck.
        if int(spark.conf.get(_ARROW)) > ARROW_ROWS:
            spark.conf.set(_ARROW, str(ARROW_ROWS))

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write df and return it as read from what was written."""
        self._n += 1
        at = f"{self.path}/{self._n:02d}-{name}"
        df.write.option("compression", compression).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._harrier_path = at
        return out

    def free(self) -> None:
        """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more. On small inputs, plans are
        most of what a long query leaves in the driver, whose heap grows with them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        at = getattr(df, "_harrier_path", None)
        if at:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, text string) of any table; other columns, whatever their names, are left behind."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
