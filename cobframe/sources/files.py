"""Hadoop FileSystem calls through the session, so the same code works on the
shared folder of a cluster (HDFS, object stores) and on a local disk."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Small marker file (overwritten), e.g. the folder of a finished attempt."""
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def paths_match(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches a glob pattern."""
    fs, p = file_system(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def signature(spark: SparkSession, paths: list[str]) -> str:
    """Names, lengths and times of the files at the given paths (a folder's own
    files): the same as long as nothing was written there."""
    seen = []
    for path in paths:
        fs, p = file_system(spark, path)
        if fs.exists(p):
            seen += sorted(f"{st.getPath().getName()}|{st.getLen()}|{st.getModificationTime()}" for st in fs.listStatus(p))
        seen.append(path)
    return "\n".join(seen)


def folder_files(spark: SparkSession, root: str, folders: list[str]) -> set[str]:
    """``folder/name`` of every file that lies directly in the given folders of ``root``."""
    base, out = root.rstrip("/"), set()
    for folder in folders:
        fs, p = file_system(spark, f"{base}/{folder}")
        if fs.exists(p):
            out |= {f"{folder}/{st.getPath().getName()}" for st in fs.listStatus(p) if st.isFile()}
    return out


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, p = file_system(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def delete_tree(spark: SparkSession, path: str) -> None:
    """Remove a work folder and what is in it."""
    fs, p = file_system(spark, path)
    fs.delete(p, True)
