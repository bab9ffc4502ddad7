"""Files that tasks open by themselves."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Folder of the manifests of published submissions; Spark's readers pass over names that begin so.
MANIFESTS = "_manifests"
MANIFEST = "submission_id string, name string, job string, bytes long, fault string, parts array<string>"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; one without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shared_path(spark, path: str) -> str:
    """The path, if all executors can mean the same by it: on a cluster it must name its file system."""
    master = spark.sparkContext.master
    one_machine = master == "local" or master.startswith("local[")
    if "://" not in path and not path.startswith("file:") and not one_machine:
        raise ValueError(f"{path}: name the file system (such as s3:// or hdfs://); without one each executor opens its own disk")
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system named: the session's default one, which all executors share, if the path names none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifests of a folder that submissions are published in (one row each, with the parts in file order); None for other folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MANIFESTS}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/{MANIFESTS}/*.json")


def file_paths(spark: SparkSession, path: str) -> list[str]:
    """What to read below a path: the parts that manifests list, else all of it."""
    manifests = published(spark, path)
    if manifests is None:
        return [path]
    rows = manifests.selectExpr("explode(parts) as part").toLocalIterator()  # names of files, as any reader lists them
    return [f"{path.rstrip('/')}/{r.part}" for r in rows]
