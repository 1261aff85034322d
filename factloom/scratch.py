"""Lineage cuts that survive lost executors.

Every cut is a table written under the folder the cluster names in ``spark.checkpoint.dir``, which all executors share.
Only where nothing is configured (tests, a laptop) a folder of this machine is used. A written table also frees the plan
of what came before it and gives the optimizer true sizes. Tables go when they are released, at the latest with the
driver's JVM.
"""

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def folder(spark: SparkSession):
    """(Hadoop path, file system) of a new scratch table."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    named = known.get() if known.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "factloom-checkpoints")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{named}/factloom-{uuid.uuid4().hex}")
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())


def cut(df: DataFrame, **measures: Column) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; ``measured`` has aggregates taken while they were written."""
    spark = df.sparkSession
    path, fs = folder(spark)
    seen = Observation() if measures else None
    watched = df.observe(seen, *[c.alias(n) for n, c in measures.items()]) if measures else df
    watched.write.parquet(path.toString())
    fs.deleteOnExit(path)
    kept = spark.read.schema(df.schema).parquet(path.toString())
    kept.scratch = (path, fs)
    kept.measured = seen.get if measures else {}
    return kept


def release(*kept: DataFrame) -> None:
    """Deletes tables made by ``cut`` that nothing reads any more."""
    for df in kept:
        path, fs = df.scratch
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)
