"""Session helper shared by the bench, the tests and interactive use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC, AQE and a modest number of shuffle partitions."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillmill")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer partitions than those, as for a table of one file; a large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows and bytes of an Arrow batch on its way to Python, at most (one row may be longer).
BATCH_ROWS, BATCH_BYTES = 4096, 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch sizes to BATCH_ROWS and BATCH_BYTES, so that memory does not follow 10,000 long texts."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < size(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests, a laptop) a temporary folder is
    made and set; on a cluster an unset folder is an error, as executors share no local one.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    found = found or (now.get() if now.isDefined() else None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmill-")
    if not now.isDefined():
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written in the shared folder to cut lineage; dropped at the end of a ``with`` block, after errors too."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quillmill-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def stash(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read again."""
        self.n += 1
        path = f"{self.path}/t{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """``df`` checkpointed, all tables dropped. Spark removes the checkpoint with its last reference where
        spark.cleaner.referenceTracking.cleanCheckpoints is set, as ``local_session`` does; else it stays in the shared folder."""
        out = df.checkpoint(eager=True)
        self.drop()
        return out
