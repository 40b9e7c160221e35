"""Work tables in the folder that driver and executors share, so that lost executors cost no lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset (tests on a local master) a temporary one becomes the checkpoint folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="guildward-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/guildward/{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """A path of the Hadoop file system and that file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    path, files = _files(spark, path)
    return files.exists(path)


def make_folder(spark: SparkSession, path: str) -> str:
    at, files = _files(spark, path)
    files.mkdirs(at)
    return path


def delete(spark: SparkSession, path: str) -> None:
    path, files = _files(spark, path)
    files.delete(path, True)


def folders(spark: SparkSession, path: str, begins: str) -> list[str]:
    """Folders below path, at any depth, whose names begin so."""
    at, files = _files(spark, path)
    if not files.exists(at):
        return []
    out = []
    for status in files.listStatus(at):
        if status.isDirectory():
            below = f"{path}/{status.getPath().getName()}"
            out += [below] if status.getPath().getName().startswith(begins) else folders(spark, below, begins)
    return out


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder; its parent is made, a target that is there is an error."""
    (a, files), (b, _) = _files(spark, source), _files(spark, target)
    files.mkdirs(b.getParent())
    if files.exists(b) or not files.rename(a, b):
        raise OSError(f"{source} could not become {target}")


def write_once(df: DataFrame, folder: str, name: str, part: str) -> bool:
    """Writes df to folder/name/part in one step: readers see all of it or nothing. False if it is there already, which is left as it is.

    The rows are written to a folder beside that readers pass over, which is then renamed.
    """
    spark, target = df.sparkSession, f"{folder}/{name}/{part}"
    if exists(spark, target):
        return False
    staged = f"{folder}/_staged/{name}/{part}"
    df.write.mode("overwrite").parquet(staged)
    move(spark, staged, target)
    return True


def unsettled(df: DataFrame) -> DataFrame:
    """What functions with a parameter settle take where no table is to be written."""
    return df


class Work:
    """The tables of one run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, work_folder(spark), 0
        atexit.register(self.close)

    def close(self) -> None:
        """Deletes the folder, at the driver's end at the latest: results are lazy and may read it till then."""
        atexit.unregister(self.close)
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.folder)

    def _delete(self, path: str) -> None:
        delete(self.spark, path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.folder}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Writes df and reads it back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def settled(self, df: DataFrame) -> DataFrame:
        """``table``; the shuffles that df was made by go once it is written, not when the driver happens to collect its garbage."""
        conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(name)
        conf.set(name, "true")
        try:
            return self.table(df)
        finally:
            conf.set(name, before)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later plan reads."""
        self._delete(df._written_at)
