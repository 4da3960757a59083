"""A few file-system calls through Spark's own Hadoop client, so any shared folder works."""

import time
import uuid
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@lru_cache(maxsize=64)
def _class(jvm, name: str):
    """A class of the JVM. Looking it up takes a call for each part of its name, so it is kept."""
    found = jvm
    for part in name.split("."):
        found = getattr(found, part)
    return found


def _path(spark: SparkSession, path: str):
    return _class(spark._jvm, "org.apache.hadoop.fs.Path")(path)


def _open(spark: SparkSession, path: str):
    handle = _path(spark, path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()), handle


def exists(spark: SparkSession, path: str) -> bool:
    fs, handle = _open(spark, path)
    return fs.exists(handle)


def delete(spark: SparkSession, path: str) -> None:
    fs, handle = _open(spark, path)
    fs.delete(handle, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, brought over as one text: a call for each of thousands of children would take longer than listing them."""
    fs, handle = _open(spark, path)
    if not fs.exists(handle):
        return []
    paths = _class(spark._jvm, "org.apache.hadoop.fs.FileUtil").stat2Paths(fs.listStatus(handle))
    if len(paths) == 0:
        return []
    # "{folder/a,folder/b}": no name holds a slash, so what stands between names cannot be part of one.
    text = _class(spark._jvm, "org.apache.commons.lang3.ArrayUtils").toString(paths)
    folder = paths[0].getParent().toString().rstrip("/")
    return text[len(folder) + 2 : -1].split(f",{folder}/")


def make(spark: SparkSession, path: str) -> None:
    """An empty folder, for what its name alone records."""
    fs, handle = _open(spark, path)
    fs.mkdirs(handle)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, handle = _open(spark, path)
    if not fs.rename(handle, _path(spark, to)):
        raise OSError(f"cannot rename {path} to {to}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, handle = _open(spark, path)
    stream = fs.open(handle)
    try:
        return _class(spark._jvm, "org.apache.commons.io.IOUtils").toString(stream, "UTF-8")
    finally:
        stream.close()


def create_with(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file that must not exist yet, with its whole content in one step; False if it exists.

    Of any number of writers exactly one succeeds, and no reader sees half a file: the content is written aside and
    linked (local folders) or renamed (HDFS, where a rename never replaces) to its name. A store without such a rename
    is no place for offsets.
    """
    fs, handle = _open(spark, path)
    fs.mkdirs(handle.getParent())
    aside = f"{handle.getParent()}/.{handle.getName()}-{uuid.uuid4().hex}"
    temporary = _path(spark, aside)
    if fs.getUri().getScheme() != "file":
        out = fs.create(temporary)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            return fs.rename(temporary, handle)
        finally:
            fs.delete(temporary, False)
    # Without a checksum file, which would start two processes to set modes.
    local = _class(spark._jvm, "java.io.File")
    from_, to = (local(p.toUri().getPath()) for p in (temporary, handle))
    _class(spark._jvm, "org.apache.commons.io.FileUtils").writeStringToFile(from_, text, "UTF-8")
    try:
        try:
            _class(spark._jvm, "java.nio.file.Files").createLink(to.toPath(), from_.toPath())
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
    finally:
        from_.delete()


def move_once(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder unless it is gone, that is, was moved before. What no one moved there and stands in the way goes."""
    (fs, handle), target = _open(spark, path), _path(spark, to)
    if fs.exists(handle):
        # Looked at in this order: a folder that is still here has not been moved to where another one is.
        if fs.exists(target) and fs.exists(handle):
            fs.delete(target, True)
        try:
            if not fs.rename(handle, target):
                raise OSError(f"cannot rename {path} to {to}")
        except (OSError, Py4JJavaError):
            if fs.exists(handle):  # else someone else moved it in between
                raise


def drop_stale(spark: SparkSession, folder: str, prefix: str, seconds: float) -> None:
    """Delete children of ``folder`` whose names begin with ``prefix`` and that nobody has written to for so long."""
    fs, handle = _open(spark, folder)
    if fs.exists(handle):
        for status in fs.listStatus(handle):
            if status.getPath().getName().startswith(prefix) and status.getModificationTime() < (time.time() - seconds) * 1000:
                fs.delete(status.getPath(), True)
