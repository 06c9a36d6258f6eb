"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is set and all tasks run here, as in tests."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not context.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_SETTING} must name a folder that all machines share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="larkspur-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs read it and don't depend on lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table of this module through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that one operator writes; those given to ``drop`` are removed as soon as no job needs them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def write(self, df: DataFrame, part: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{part}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._larkspur_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            drop_table(self.spark, table._larkspur_path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer until no column of ``df`` has them in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key that holds more than one row in so many is joined by broadcast; there are fewer such keys.
HEAVY = 1000


def join_shared(rows: DataFrame, keys: DataFrame, on: str, total: DataFrame) -> DataFrame:
    """``rows`` with what ``keys`` say of them: one row a key, with its count n of the ``total`` (one row) rows.

    Heavy keys, of which there are less than HEAVY, are broadcast, so that none fills a task.
    """
    sized = keys.crossJoin(F.broadcast(total.select(F.col(total.columns[0]).alias("__total"))))
    heavy = sized.where(F.col("n") * HEAVY > F.col("__total")).drop("__total")
    light = sized.where(F.col("n") * HEAVY <= F.col("__total")).drop("__total")
    return rows.join(F.broadcast(heavy), on).unionByName(rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on))
