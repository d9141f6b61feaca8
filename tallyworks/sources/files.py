"""Small files and folders on any Hadoop file system, from the driver: atomic creation, pointers, retries."""

from __future__ import annotations

import os
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def file_system(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under a name that nothing has yet; False if something has. Nobody ever sees part of it.

    Where renaming refuses an existing name, as in HDFS, that decides; on a local file system a hard link does.
    """
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    _, own = file_system(spark, f"{p.getParent()}/.{uuid.uuid4().hex}")
    out = fs.create(own)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(own.toUri().getPath(), p.toUri().getPath())
        else:
            hadoop = spark._jvm.org.apache.hadoop.fs
            hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(own, p, spark._sc._gateway.new_array(hadoop.Options.Rename, 0))
        return True
    except Exception as e:
        if isinstance(e, FileExistsError) or "FileAlreadyExistsException" in str(e):
            return False
        raise
    finally:
        fs.delete(own, False)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def with_retry(act: Callable[[], object], attempts: int = 4, wait: float = 0.2, errors: tuple[str, ...] = ("IOException", "lock", "Lock")) -> object:
    """``act()``, again after a growing pause while it fails on something that passes (a lock, a file in use)."""
    for attempt in range(attempts):
        try:
            return act()
        except Exception as e:
            if attempt == attempts - 1 or not any(x in f"{type(e).__name__} {e}" for x in errors):
                raise
            time.sleep(wait * 2**attempt * (1 + random.random()))
    return None


def write_versioned(df: DataFrame, path: str, kind: str = "json") -> str:
    """A folder's new contents beside the old; the pointer to them is put in place at once, so a reader finds the old or the new."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    getattr(df.write, kind)(f"{path.rstrip('/')}/{name}")
    while True:
        numbers = [int(n) for n in child_names(spark, f"{path}/pointers") if n.isdigit()]
        if put_if_absent(spark, f"{path}/pointers/{max(numbers, default=0) + 1:08d}", name):
            return f"{path.rstrip('/')}/{name}"


def current_path(spark: SparkSession, path: str) -> str:
    """Where the contents of a folder of ``write_versioned`` lie now; any other path is itself."""
    numbers = [n for n in child_names(spark, f"{path}/pointers") if n.isdigit()] if exists(spark, f"{path}/pointers") else []
    return f"{path.rstrip('/')}/{read_text(spark, f'{path}/pointers/{numbers[-1]}')}" if numbers else path
