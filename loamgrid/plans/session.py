"""Session helpers: where shared intermediate tables live and how workers find this package.

Lineage is cut by writing a table to the folder named by ``spark.checkpoint.dir``; every executor
can read it again after another one is lost. Only where that setting is unset (tests, a laptop) a
temporary folder is made for the session.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])
_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver was started from elsewhere."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one made for this application, on a single machine only."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-loamgrid-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Durable intermediate tables of one operator call.

    ``keep`` writes a table and returns it reread, so that no later failure recomputes what came
    before. ``finish`` writes the (small) result and drops the intermediates.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.name = spark, name
        self.root = f"{shared_dir(spark)}/loamgrid/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def keep(self, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
        at = self.path(label)
        df.write.option("compression", codec).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.scratch_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        if getattr(df, "scratch_path", None):
            delete_path(self.spark, df.scratch_path)

    def finish(self, df: DataFrame, label: str = "result") -> DataFrame:
        at = f"{self.root}-{label}"
        df.write.option("compression", "zstd").parquet(at)
        delete_path(self.spark, self.root)
        return self.spark.read.schema(df.schema).parquet(at)
