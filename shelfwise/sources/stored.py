"""A stored table that knows its source.

A table built from files is kept in a folder named by a fingerprint of those files:
path, length and time of change of each.  As long as the listing gives the same
fingerprint, the stored table is read; a changed, added or removed file gives another,
and the table is built again beside the old one.  A folder without Spark's success
marker is not a table, so a build that was cut short or cleared away counts as none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _listing(spark: SparkSession, path: str) -> Iterator[tuple[str, int, int]]:
    fs, at = _hadoop(spark, path)
    for top in fs.globStatus(at) or ():
        files = fs.listFiles(top.getPath(), True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                yield f.getPath().toString(), f.getLen(), f.getModificationTime()


def fingerprint(spark: SparkSession, paths: str | Sequence[str]) -> str:
    """A hash of the path, length and time of change of every data file below ``paths``."""
    found = hashlib.sha256()
    for path in [paths] if isinstance(paths, str) else paths:
        for entry in sorted(_listing(spark, path)):
            found.update(repr(entry).encode())
        found.update(b"\n")
    return found.hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a table whose writer has finished."""
    fs, at = _hadoop(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(at)


def stored_table(spark: SparkSession, base: str, sources: str | Sequence[str], write: Callable[[str], None]) -> str:
    """The path of the table below ``base`` that belongs to the present ``sources``.

    ``write(path)`` builds it if there is none.
    """
    path = f"{base.rstrip('/')}/{fingerprint(spark, sources)[:32]}"
    if not exists(spark, path):
        write(path)
    return path


def read_stored(spark: SparkSession, base: str, sources: str | Sequence[str],
                build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes of ``sources``, from the store while they are unchanged."""
    return spark.read.parquet(stored_table(spark, base, sources,
                                           lambda path: build().write.mode("overwrite").parquet(path)))
