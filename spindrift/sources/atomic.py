"""Small files replaced as a whole, on any file system that the cluster reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path), hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fc = _fs(spark, path)
    return fc.util().exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """The whole text of a small file; a missing one is a FileNotFoundError."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    _, p, _ = _fs(spark, path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then rename over it: readers see the old text or the new one."""
    hadoop, target, fc = _fs(spark, path)
    beside = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    fs = beside.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(beside, True)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    rename = getattr(hadoop, "Options$Rename")
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fc.rename(beside, target, how)


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def replace_json(spark: SparkSession, path: str, value) -> None:
    replace_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))
