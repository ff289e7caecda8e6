"""Materialised stages: a table for each stage and set of parameters, written once and read afterwards."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder that the cluster names (spark.checkpoint.dir). A folder of this
    machine is taken only by a local session that names none; a cluster without one gets an error."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "bandweave-checkpoints"))
    return df.checkpoint(eager=True)


class Stages:
    """A folder of tables. A stage that is asked for again with the same parameters and the same input is read, not computed."""

    def __init__(self, spark: SparkSession, root: str, source: str = ""):
        self.spark, self.root, self.source = spark, root.rstrip("/"), source

    def of(self, df: DataFrame) -> Stages:
        """The same folder for stages made from df, which is told apart by its files and its plan."""
        plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().optimizedPlan().toString())
        return Stages(self.spark, self.root, hashlib.sha256(json.dumps([sorted(df.inputFiles()), plan]).encode()).hexdigest())

    def path(self, name: str, **parameters: object) -> str:
        key = hashlib.sha256(json.dumps([self.source, parameters], sort_keys=True, default=str).encode()).hexdigest()[:16]
        return f"{self.root}/{name}/{key}"

    def exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def get(self, name: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = (), **parameters: object) -> DataFrame:
        """The stage's table; made and written if no complete one is there."""
        path = self.path(name, **parameters)
        if not self.exists(path):
            make().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return self.spark.read.parquet(path)
