"""Tables that are written once, to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it names none, a temporary folder, but only if all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lorespark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns. The first is dealt out anew: were all hashed by one key, Spark would pair up their partitions, whose numbers adaptive execution may change."""
    return reduce(DataFrame.unionByName, [parts[0].repartition(partitions(parts[0].sparkSession)), *parts[1:]])


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which users set in proportion to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, with no lineage to lose. It is deleted when the session's JVM ends, or by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lorespark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    fs, folder = _folder(df.sparkSession, df.written_to)
    fs.delete(folder, True)
    fs.cancelDeleteOnExit(folder)


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a small file that is not there yet; False if it is. Of several writers at a time one gets True, and nobody sees the file without its content."""
    fs, file = _folder(spark, path)
    fs.mkdirs(file.getParent())
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(file.getParent(), f".{file.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            # Hadoop's local rename replaces; a hard link fails if the name is taken, and gives the whole file its name at once
            path_of = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                jvm.java.nio.file.Files.createLink(path_of(file), path_of(draft))
            except Exception:  # noqa: BLE001
                if not fs.exists(file):
                    raise
                return False
            return True
        # a rename onto a name that is taken fails
        return not fs.exists(file) and bool(fs.rename(draft, file))
    finally:
        fs.delete(draft, False)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, sorted, drafts left out; nothing if there is none."""
    fs, folder = _folder(spark, path)
    return sorted(n for s in fs.listStatus(folder) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(folder) else []


def ages(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """What a folder holds, and when each was changed, in seconds since 1970."""
    fs, folder = _folder(spark, path)
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(folder)] if fs.exists(folder) else []


def unreadable(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path and error of those Parquet tables of one schema that cannot be read. The footers of all files are looked at in one job; table by table only where that fails."""

    def error(paths: list[str]) -> str | None:
        try:
            spark.read.parquet(*paths).count()
        except Exception as e:  # noqa: BLE001  the state is the report
            return type(e).__name__
        return None

    bad = [(p, e) for p in folders if (e := error([p]))] if folders and error(folders) else []
    return spark.createDataFrame(bad, "path string, error string")


def delete(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return bool(fs.delete(folder, True))


def read_small(spark: SparkSession, path: str) -> str:
    fs, file = _folder(spark, path)
    stream = fs.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
