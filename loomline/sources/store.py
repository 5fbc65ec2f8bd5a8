"""Small texts in whatever store Spark reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    made, files = _path(spark, path)
    return files.exists(made)


def is_file(spark: SparkSession, path: str) -> bool:
    made, files = _path(spark, path)
    return files.getFileStatus(made).isFile()


def read_text(spark: SparkSession, path: str) -> str | None:
    made, files = _path(spark, path)
    if not files.exists(made):
        return None
    stream = files.open(made)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the text by way of a second file, so that a reader never sees half of it."""
    draft, files = _path(spark, f"{path}.draft")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    made, _ = _path(spark, path)
    files.delete(made, False)
    files.rename(draft, made)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir). Where the
    session names none, a temporary folder is set if all runs on this machine, else this fails."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomline.scratch", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("loomline.scratch", root)
    return f"{root.rstrip('/')}/loomline/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete the folder, if it is there."""
    made, files = _path(spark, path)
    files.delete(made, True)
