"""Written tables in the shared checkpoint folder.

Multi-pass work (a fit that aggregates the same rows several times, an
iterative trainer) reads a table written once to the folder the cluster
names in ``spark.checkpoint.dir``: lineage is cut, a lost executor only
re-reads files, and later passes get parquet column pruning.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from eventsurv.session import ensure_checkpoint_dir

_CACHE: dict[tuple, str] = {}


def table_dir(spark: SparkSession) -> str:
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/eventsurv-tables"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs run inside; the caller's come back afterwards."""
    before = {n: spark.conf.get(n, None) for n in values}
    for n, v in values.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def write_table(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Writes ``df``; its shuffle files go when it is written.  Else they stay until
    the driver happens to collect its garbage, and a long job's add up."""
    with settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.mode("overwrite").parquet(path, compression=compression)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{table_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_table(df, path)
    return spark.read.parquet(path)


def source_key(path: str) -> tuple:
    """Identity of an input file or folder (path, size, modification time)."""
    try:
        st = os.stat(path)
        return (os.path.realpath(path), st.st_size, st.st_mtime_ns)
    except OSError:
        return (path,)


def materialize_once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Materialize ``build()`` once per key and session; later calls re-read
    the written table."""
    full = (spark.sparkContext.applicationId, table_dir(spark), *key)
    path = _CACHE.get(full)
    if path is None:
        df = build()
        path = f"{table_dir(spark)}/{key[0]}-{uuid.uuid4().hex}"
        write_table(df, path)
        _CACHE[full] = path
    return spark.read.parquet(path)


class Scratch:
    """Tables of one long job: written to the checkpoint folder, dropped as
    soon as nothing reads them any more (all of them at the end of a ``with``)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = f"{table_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        write_table(df, path, compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t), (None, None))
            if path:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        self.drop(*[t for t, _ in list(self.paths.values())])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    @contextmanager
    def arrow(self, rows: int, size: str) -> Iterator[None]:
        """Arrow batches of bounded rows and bytes for the jobs run inside."""
        with settings(self.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}):
            yield
