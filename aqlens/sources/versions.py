"""Published folders: results that readers see whole or not at all.

A root holds versions ``v-000001``, ``v-000002``, ...  A writer fills the next
one and marks it last; readers take the highest that is marked.  A write that
is killed leaves an unmarked folder that nobody reads, so what was published
before stays readable; nothing is renamed, which object stores can't do at
once.  Versions before the last KEEP are deleted after a publication, so that
readers at the one before can finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MARK = "_PUBLISHED"
KEEP = 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """(folder, whether it is published) of every version, oldest first."""
    path, fs = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("v-"))
    return [(f"{root}/{n}", _exists(spark, f"{root}/{n}/{MARK}")) for n in names]


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the last published version; None where there is none."""
    return next((folder for folder, published in reversed(versions(spark, root)) if published), None)


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill the folder of a new version and publish it."""
    taken = versions(spark, root)
    number = int(taken[-1][0].rsplit("-", 1)[1]) + 1 if taken else 1
    folder = f"{root}/v-{number:06d}"
    path, fs = _fs(spark, folder)
    if not fs.mkdirs(path):
        raise FileExistsError(f"{folder} can't be made")
    write(folder)
    fs.create(_fs(spark, f"{folder}/{MARK}")[0], False).close()
    published = [f for f, done in taken if done] + [folder]
    for old, _ in taken:
        if old < published[-KEEP:][0]:
            fs.delete(_fs(spark, old)[0], True)
    return folder


def publish_table(df: DataFrame, root: str, partition_by: list[str] | None = None) -> DataFrame:
    """Publish ``df`` as Parquet and read it back from there.

    An empty table with partitions has no files to read the schema from, so
    that is written beside it, where readers of the whole root don't look."""
    spark = df.sparkSession

    def write(folder: str) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/table")
        spark.createDataFrame([], df.schema).write.parquet(f"{folder}/_schema")

    return _table(spark, publish(spark, root, write))


def _table(spark: SparkSession, folder: str) -> DataFrame:
    reader = spark.read
    for name in ("_schema", "schema"):  # versions published before have the latter or none
        if _exists(spark, f"{folder}/{name}"):
            reader = reader.schema(spark.read.parquet(f"{folder}/{name}").schema)
            break
    return reader.parquet(f"{folder}/table")


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The last published version of a table."""
    folder = current(spark, root)
    if folder is None:
        raise FileNotFoundError(f"{root} not found: run the step that produces it first")
    return _table(spark, folder)
