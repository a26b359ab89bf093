"""Row-level plan helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once(df: DataFrame, *names: str) -> DataFrame:
    """Pin costly derived columns: they are computed once per row and never inlined again.

    Catalyst pushes a later filter through projections by pasting the column's whole expression
    into the predicate, which re-evaluates JSON parsing or tokenising many times. The columns are
    re-emitted by a one-element generator, which such rewrites do not cross. No shuffle.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: ``spark.checkpoint.dir``, else a folder of the warehouse.

    On a cluster this must be storage that all executors reach; with neither set to a place on such storage
    there (the warehouse's default is a local folder) intermediate tables could not be read back, so that is refused.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    place = spark.conf.get("spark.sql.warehouse.dir")
    local_master = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if not local_master and place.startswith("file:") and place.endswith("/spark-warehouse"):
        raise ValueError("set spark.checkpoint.dir: intermediate tables need storage that all executors share")
    return place + "/_intermediate"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder (written with ``options``), read back: lineage ends there.

    The table goes when the application ends, or with ``drop_written``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def small(df: DataFrame) -> bool:
    """Whether Spark will broadcast the frame of itself, by the sizes of the files behind it."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= conf.autoBroadcastJoinThreshold()


def drop_written(df: DataFrame) -> None:
    """Delete the table behind a frame that ``written`` returned; whoever reads it must be done."""
    place, system = _place(df.sparkSession, df._written_path)
    system.delete(place, True)
    system.cancelDeleteOnExit(place)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


class Folder:
    """Small files on the storage that Spark uses, handled by the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def names(self) -> list[str]:
        place, system = _place(self.spark, self.path)
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).head()[0]

    def write(self, name: str, text: str) -> None:
        """The file appears whole under its name, in place of an older one."""
        draft, system = _place(self.spark, f"{self.path}/.{uuid.uuid4().hex}")
        out = system.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = _place(self.spark, f"{self.path}/{name}")
        system.delete(final, False)
        system.rename(draft, final)

    def delete(self, name: str) -> None:
        place, system = _place(self.spark, f"{self.path}/{name}")
        system.delete(place, True)
