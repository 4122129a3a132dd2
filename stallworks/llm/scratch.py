"""Deleting written tables that nothing reads any more, before the application ends."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stallworks.operators.ranking import own_folder


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` once the tables made from them are written too.

    Whatever follows starts from those, so a lost executor never needs what is deleted here.
    """
    for table in tables:
        spark = table.sparkSession
        path_type = spark._jvm.org.apache.hadoop.fs.Path
        own = path_type(own_folder(spark))
        files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = path_type(folder)
            if path.getParent().toUri().getPath() != own.toUri().getPath():
                raise ValueError(f"{folder} was not written by this application")
            files.delete(path, True)
