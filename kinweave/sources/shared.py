"""Tables written to the shared folder, used to cut lineage and to share work between reports.

A written table survives the loss of any executor, is read back column by column, and is computed once
(``DataFrame.checkpoint`` runs its last stage twice and stores whole rows).
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="kinweave-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/kinweave/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application has put below the shared folder. Call it when all results are stored: some
    operators leave a small table there that their result still reads."""
    _delete(spark, _own_folder(spark))


def claim(spark: SparkSession, folder: str, name: str, body: str) -> bool:
    """Write a small file that must not exist yet, by renaming a temporary one to it; false if it stands already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    temporary, final = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (f".{uuid.uuid4().hex}.tmp", name))
    files = temporary.getFileSystem(conf)
    out = files.create(temporary, True)
    out.write(body.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(temporary).toUri(), conf)
    try:
        # Fails if the target stands.
        context.rename(files.makeQualified(temporary), files.makeQualified(final), options)
    except Exception as error:  # py4j wraps what Java throws.
        files.delete(temporary, False)
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


@dataclass(frozen=True)
class SharedTable:
    """A materialised DataFrame and where it lies."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files; call it once nothing reads the table any more."""
        _delete(self.df.sparkSession, self.path)


def materialise(df: DataFrame, name: str) -> SharedTable:
    """Write ``df`` as parquet below the shared folder and read it back (no lineage left)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return SharedTable(spark.read.schema(schema).parquet(path), path)
