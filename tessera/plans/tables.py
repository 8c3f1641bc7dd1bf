"""Tables written to the cluster's shared folder, to cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_hand.isDefined():
            return set_by_hand.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes the rows to the shared folder as Parquet and reads them back.

    Later jobs read these files: they neither compute the rows again nor depend on the
    disks of single executors.
    """
    path = f"{shared_folder(df.sparkSession)}/tessera/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def unsent(df: DataFrame) -> DataFrame:
    """The rows, for a join that sorts both sides and broadcasts neither.

    Rows that explode from a small table, and saved ones that compress well, are far more than Spark takes them to be from the size of the files.
    """
    return df.hint("merge")


def freed(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``saved`` gave and that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
