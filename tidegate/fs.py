"""Small files on whatever file system the cluster uses, through Hadoop's API."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _at(spark, path)
    if not fs.rename(p, _at(spark, to)[1]):
        raise OSError(f"cannot rename {path} to {to}")


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: write beside it, then rename."""
    fs, p = _at(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    fs.mkdirs(p.getParent())
    out = fs.create(_at(spark, beside)[1], True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    rename(spark, beside, path)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def heads(spark: SparkSession, path: str, first: int = 1 << 16) -> Iterator[str]:
    """Ever longer beginnings of a text file, up to all of it; characters cut at their end are left out."""
    fs, p = _at(spark, path)
    size, n = fs.getFileStatus(p).getLen(), first
    while True:
        stream = fs.open(p)
        try:
            yield bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, size))).decode("utf-8", "ignore").removeprefix("\ufeff")
        finally:
            stream.close()
        if n >= size:
            return
        n *= 4


def join_files(spark: SparkSession, paths: list[str], to: str) -> None:
    """Put files behind each other under a new name, by streams, so none is held in memory."""
    fs, p = _at(spark, to)
    beside = f"{to}.{uuid.uuid4().hex}.tmp"
    conf, utils = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
    out = fs.create(_at(spark, beside)[1], True)
    try:
        for path in paths:
            stream = fs.open(_at(spark, path)[1])
            try:
                utils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()
    fs.delete(p, False)
    rename(spark, beside, to)


def swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the folder ``fresh`` in the place of ``path``; the old one goes only when the new one is there.

    Between two renames there is nothing at ``path``; after a failure there the old rows are in ``path.old-*``.
    """
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    if exists(spark, path):
        rename(spark, path, old)
        rename(spark, fresh, path)
        delete(spark, old)
    else:
        rename(spark, fresh, path)


def write_single(spark: SparkSession, path: str, write: Callable[[str], None], append: bool = False) -> None:
    """Let ``write`` fill a folder with one part file and put that file at ``path``, or behind what is there."""
    folder = f"{path}.{uuid.uuid4().hex}.parts"
    write(folder)
    parts = [n for n in children(spark, folder) if n.startswith("part-")]
    fs, target = _at(spark, path)
    if append:
        join_files(spark, [*([path] if exists(spark, path) else []), *[f"{folder}/{n}" for n in parts]], path)
    else:
        fs.delete(target, True)
        if parts:
            rename(spark, f"{folder}/{parts[0]}", path)
        else:
            write_text(spark, path, "")
    delete(spark, folder)
