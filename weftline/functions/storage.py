"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where none is (local tests)."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it below the shared folder and read it back.

    The table survives the loss of executors, and a second action reads it instead of
    computing it again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(*actions: Callable[[], object]) -> list[object]:
    """The results of several Spark actions that run at the same time."""
    with ThreadPoolExecutor(len(actions)) as pool:
        return [f.result() for f in [pool.submit(a) for a in actions]]


def _file_system(path: str):  # noqa: ANN202
    spark = SparkSession.active()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def first_bytes(path: str, most: int) -> bytes:
    """The first bytes of a file on any file system that Spark reads; a path without a scheme is local."""
    if ":/" not in path or path.startswith("file:/"):
        with open(re.sub(r"^file:(//)?", "", path), "rb") as f:
            return f.read(most)
    where, fs = _file_system(path)
    stream = fs.open(where)
    try:
        size = min(most, fs.getFileStatus(where).getLen())
        return bytes(SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def put(path: str, data: bytes) -> str:
    """A small file written on any file system that Spark writes; its path."""
    where, fs = _file_system(path)
    stream = fs.create(where)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return path
