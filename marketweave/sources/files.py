"""Small files by any path that Spark can open, local or remote."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    """The path and its file system, as Spark resolves them."""
    spark = SparkSession.builder.getOrCreate()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration()), spark


def exists(path: str) -> bool:
    place, store, _ = _at(path)
    return store.exists(place)


def read_text(path: str) -> str:
    """A whole small file as UTF-8."""
    place, store, spark = _at(path)
    stream = store.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Write a small file, with its folders; one that is there is replaced."""
    place, store, _ = _at(path)
    stream = store.create(place, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
