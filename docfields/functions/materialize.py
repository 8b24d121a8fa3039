"""Cut a long plan by writing an intermediate table to the cluster's shared checkpoint folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from docfields.session import checkpoint_dir

_written: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared one; ``release`` deletes it with the stored tables."""
    path = f"{checkpoint_dir(spark)}/docfields-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    For results that several later steps use: the steps neither recompute nor re-plan what came before,
    and a lost executor costs a re-read, not the whole lineage. The files are Parquet, so later steps
    still read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done. It does so when the driver collects its garbage, which may be
    long after the results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the stored tables ``df`` reads, once all that was made of them is stored itself."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    names = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}
    for path in [p for p in _written if p.rsplit("/", 1)[1] in names]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        _written.remove(path)


def release(spark: SparkSession) -> int:
    """Delete the tables and folders this driver has written, once no result that reads them is needed; returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone
