"""File system calls for committed outputs (names only, never contents)."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Fixed value: a gzip member with no content.
EMPTY_GZIP = bytes.fromhex("1f8b080000000000000303000000000000000000")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names right below a folder, without those of partition directories."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [n for n in names if "=" not in n]


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.option("wholetext", True).text(path).collect()
    return rows[0]["value"]
