"""Bytes by content: a folder of files named by key, and the same as a table."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Protocol
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Blobs(Protocol):
    def put(self, key: str, data: bytes) -> str: ...

    def get(self, uri: str) -> bytes: ...

    def exists(self, key: str) -> bool: ...


class LocalBlobs:
    """Files ``<root>/<first two characters>/<key>``, staged and then renamed; addresses are ``file://`` URIs."""

    def __init__(self, root: str | os.PathLike):
        self.root = Path(root).absolute()

    def _file(self, key: str) -> Path:
        if not key or "/" in key or ".." in key:
            raise ValueError(f"no key for a blob: {key!r}")
        return self.root / (key[:2] if len(key) >= 2 else "_") / key

    def put(self, key: str, data: bytes) -> str:
        target = self._file(key)
        if not target.exists():
            target.parent.mkdir(parents=True, exist_ok=True)
            staged = target.with_name(f"{target.name}.{os.getpid()}.tmp")
            staged.write_bytes(data)
            staged.replace(target)
        return target.as_uri()

    def get(self, uri: str) -> bytes:
        parts = urlparse(uri)
        if parts.scheme != "file":
            raise ValueError(f"no file URI: {uri!r}")
        path = Path(unquote(parts.path))
        if not path.is_file():
            raise FileNotFoundError(uri)
        return path.read_bytes()

    def exists(self, key: str) -> bool:
        return self._file(key).is_file()


def backend(name: str, path: str) -> Blobs:
    if name != "local":
        raise ValueError(f"unknown storage backend {name!r}")
    return LocalBlobs(path)


def store(bodies: DataFrame, folder: str) -> DataFrame:
    """Adds ``content_hash``, ``byte_size`` and ``storage_uri`` to ``bodies`` (body) and appends the bytes that are new.

    The table in ``folder`` has (content_hash, body) and one folder for each two first characters; a URI names it.
    """
    spark = bodies.sparkSession
    out = bodies.withColumn("content_hash", F.sha2("body", 256)).withColumn("byte_size", F.octet_length("body").cast("long"))
    out = out.withColumn("storage_uri", F.concat(F.lit(f"{folder}#"), F.col("content_hash")))
    new = out.where("body is not null").groupBy("content_hash").agg(F.first("body").alias("body"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        new = new.join(load(spark, folder).select("content_hash"), "content_hash", "left_anti")
    new.withColumn("prefix", F.substring("content_hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(folder)
    return out


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(content_hash, body) of a folder that :func:`store` wrote."""
    return spark.read.schema("content_hash string, body binary, prefix string").parquet(folder).select("content_hash", "body")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(storage_uri, body) of the files of :class:`LocalBlobs`, by Spark's reader of binary files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_replace("path", "^file:/+", "file:///").alias("storage_uri"), F.col("content").alias("body"))
