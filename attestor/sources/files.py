"""Small files and folders on whatever file system Spark writes to."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession

from ..errors import ValidationError


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # people edit these files by hand, so a local disk's checksum files are left out
    return (fs.getRawFileSystem() if fs.getScheme() == "file" else fs), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; nothing if there is no such folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    if not fs.exists(p):
        raise ValidationError(f"there is no {path}")
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place first, so that readers see the old text or the new one."""
    fs, p = _at(spark, path)
    _, draft = _at(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(p, False)
    if not fs.rename(draft, p):
        raise ValidationError(f"cannot write {path}")


def read_json(spark: SparkSession, path: str) -> dict:
    body = json.loads(read_text(spark, path))
    if body.get("version") != 1:
        raise ValidationError(f"{path}: version 1 is required")
    return body


def write_json(spark: SparkSession, path: str, body: dict) -> None:
    write_text(spark, path, json.dumps(body, indent=1, sort_keys=True, default=str))


def digest(spark: SparkSession, path: str) -> str:
    """sha256 of a file's bytes, read as a stream; of a folder, of its files' names and digests."""
    fs, p = _at(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return hashlib.sha256("".join(f"{n}:{digest(spark, f'{path}/{n}')};" for n in names(spark, path)).encode()).hexdigest()
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
