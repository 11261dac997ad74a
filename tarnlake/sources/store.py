"""Files in any store that Hadoop's file systems know: copies, moves and small texts, with the driver as the one who acts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def retrying(action: Callable, attempts: int = 5, first_wait: float = 2.0, most: float = 30.0, sleep: Callable = time.sleep):
    """Run an action again after failures of input or output, waiting twice as long each time."""
    for i in range(attempts):
        try:
            return action()
        except Exception as e:
            java = getattr(e, "java_exception", None)
            if not isinstance(e, OSError) and "java.io." not in f"{java.getClass().getName() if java else ''} {java or ''}":
                raise
            if i == attempts - 1:
                raise
            sleep(min(most, first_wait * 2**i))


def make(spark: SparkSession, path: str) -> str:
    fs, p = at(spark, path)
    fs.mkdirs(p)
    return path


def size(spark: SparkSession, path: str) -> int:
    fs, p = at(spark, path)
    return fs.getFileStatus(p).getLen()


def copy(spark: SparkSession, source: str, target: str, move: bool = False) -> None:
    """Copy one file, from store to store; a whole copy appears under its name at once, so a copy that fails leaves none."""
    (a, x), (b, y) = at(spark, source), at(spark, target)
    _, draft = at(spark, f"{target}._COPYING_")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, draft, False, True, spark._jsc.hadoopConfiguration())
    b.delete(y, False)
    if not b.rename(draft, y):
        raise OSError(f"{target} could not be written")
    if move:
        a.delete(x, False)


def write(spark: SparkSession, path: str, text: str) -> None:
    fs, p = at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read(spark: SparkSession, path: str) -> str:
    fs, p = at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def lines(spark: SparkSession, path: str, most: int) -> list[str]:
    """The first lines of a text, without reading the rest."""
    fs, p = at(spark, path)
    jvm = spark._jvm.java.io
    reader = jvm.BufferedReader(jvm.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        out = []
        while len(out) < most and (line := reader.readLine()) is not None:
            out.append(line)
        return out
    finally:
        reader.close()
