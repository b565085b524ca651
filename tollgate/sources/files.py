"""Small files through Hadoop's file systems, so any storage that Spark reads works, and strict JSON."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return bool(fs.exists(at))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _path(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _path(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(int(size))).decode()
    finally:
        stream.close()


def sha256(spark: SparkSession, path: str) -> str:
    """Digest of one file, read in pieces on the driver."""
    fs, at = _path(spark, path)
    digest, stream = hashlib.sha256(), fs.open(at)
    try:
        while piece := bytes(stream.readNBytes(1 << 22)):
            digest.update(piece)
    finally:
        stream.close()
    return digest.hexdigest()


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modified) of every file below, in name order; what an input's fingerprint is made of."""
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return []
    files, out = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def clean(value: Any) -> Any:
    """The value with NaN and infinities as null, at any depth."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    return [clean(v) for v in value] if isinstance(value, (list, tuple)) else value


def dumps(value: Any, **options: Any) -> str:
    """Strict JSON of ``clean(value)``."""
    return json.dumps(clean(value), allow_nan=False, default=str, **options)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, dumps(value, indent=1))


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))
