"""Parquet tables of one directory, by name."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The same table as a stream of its files; a table of one file is found by its name in the directory."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}.parquet")
    several = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, directory, name).schema)
    return reader.parquet(path.toString()) if several else reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
