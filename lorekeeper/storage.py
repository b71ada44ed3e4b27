"""Tables that a job writes in the folder which driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster
    that is an error, as executors do not see the driver's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"lorekeeper-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def delete_tables(spark: SparkSession) -> bool:
    """Delete what this application has materialised, at the end of a run; whether there was anything.

    Results that are still to be read must have been written elsewhere.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Tables that an application writes once: their folders by application and name.
_ONCE: dict[tuple[str, str], str] = {}


def written_once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a name that this application has written before, or a new one if it has none or it is gone."""
    key = (spark.sparkContext.applicationId, name)
    if key in _ONCE:
        try:
            return spark.read.parquet(_ONCE[key])
        except AnalysisException:
            del _ONCE[key]
    _ONCE[key] = f"{_tables(spark)}/once-{uuid.uuid4().hex}"
    make().write.parquet(_ONCE[key])
    return spark.read.parquet(_ONCE[key])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor, and
    keeps an expensive scan from running twice.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
