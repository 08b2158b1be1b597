"""Small file-system helpers: everything goes through the Hadoop file system Spark itself reads from."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path object) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def data_files(spark: SparkSession, paths) -> list[str]:
    """The non-empty files under paths, folders or globs, sorted; names that begin with ``_`` or ``.`` are not data."""
    found: set[str] = set()
    for path in [paths] if isinstance(paths, str) else list(paths):
        fs, p = file_system(spark, path)
        matches = list(fs.globStatus(p) or [])
        if not matches:
            raise FileNotFoundError(f"nothing at {path}")
        while matches:
            status = matches.pop()
            if status.isDirectory():
                matches += [s for s in fs.listStatus(status.getPath()) if s.getPath().getName()[0] not in "_."]
            elif status.getLen() > 0:
                found.add(status.getPath().toString())
    return sorted(found)


def first_line(spark: SparkSession, path: str) -> str:
    """A text file's first line (compressed files by their ending), without a byte order mark."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        line = jvm.org.apache.hadoop.io.Text()
        jvm.org.apache.hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream).readLine(line)
        return line.toString().removeprefix("\ufeff")
    finally:
        stream.close()


def header_catalogue(spark: SparkSession, paths, sep: str = ",", threads: int = 16) -> dict[tuple[str, ...], list[str]]:
    """The distinct headers of CSV files and the files of each; a file's first line is read once, its rows are not."""
    names = data_files(spark, paths)
    with ThreadPoolExecutor(threads) as pool:
        lines = list(pool.map(lambda name: first_line(spark, name), names))
    catalogue: dict[tuple[str, ...], list[str]] = {}
    for name, line in zip(names, lines):
        catalogue.setdefault(tuple(next(csv.reader([line], delimiter=sep), [])), []).append(name)
    return catalogue


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new small file; False if it is there already (it then stays as it is)."""
    fs, p = file_system(spark, path)
    if fs.exists(p):
        return False
    try:
        stream = fs.create(p, False)
    except Exception as error:   # somebody else was faster
        if "FileAlreadyExists" in str(error):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True
