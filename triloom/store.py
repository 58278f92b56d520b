"""Written tables that cut lineage and survive lost executors.

Tables go below ``spark.checkpoint.dir``, the folder that all executors share.
Where that setting is absent a folder of our own is used, but only with a local
master: on a cluster a machine-local folder would not be seen by others.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written tables."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="triloom-")
    spark.sparkContext.setCheckpointDir(own)
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/triloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)  # noqa: SLF001
    return spark.read.schema(df.schema).parquet(path)
