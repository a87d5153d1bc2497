"""Tables in the folder that all machines share: they cut lineage, are computed once and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a single-process session gets a temporary one; a cluster, whose
    machines would not see it, an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # the driver starts processes for that file
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def spent(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bounds the bytes of an Arrow batch, as rows may be large; a setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(most))


def placed(spark: SparkSession, writer, path: str) -> bool:
    """Saves by a ``DataFrameWriter`` beside ``path``, then moves the whole there, so that what is at ``path`` is complete; what is
    there already stays. Whether it was moved."""
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}.aside"
    writer.save(aside)
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target) and files.rename(source, target):
        return True
    files.delete(source, True)
    return False


def present(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
