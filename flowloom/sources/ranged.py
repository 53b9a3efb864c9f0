"""Reading parts of files in tasks, by pyarrow's file systems."""

from __future__ import annotations

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of the session's default file system where it has none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a URI and the path in it; a scheme that pyarrow doesn't know raises."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    return arrow_fs.FileSystem.from_uri(uri)


def files_of(uri: str) -> list[str]:
    """The URI itself, or those of the files in the folder that it names, in order; hidden ones don't count."""
    fs, path = system(uri)
    if fs.get_file_info(path).type != arrow_fs.FileType.Directory:
        return [uri]
    found = fs.get_file_info(arrow_fs.FileSelector(path))
    names = sorted(f.base_name for f in found if f.type == arrow_fs.FileType.File and not f.base_name.startswith(("_", ".")))
    return [f"{uri.rstrip('/')}/{n}" for n in names]
